"""Queries of the core training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from factmill.operators import flatten, hierarchy, incremental, references

QUERIES = {
    "p1_found": incremental.p1_found,
    "p2_found": hierarchy.p2_found,
    "p2_paths": hierarchy.p2_paths,
    "p2_descendants": hierarchy.p2_descendants,
    "p2_all_paths": hierarchy.p2_all_paths,
    "p2_all_descendants": hierarchy.p2_all_descendants,
    "p4_found": flatten.p4_found,
    "p4_triples": flatten.p4_triples,
    "p4_controllers": flatten.p4_controllers,
    "p4_methods": flatten.p4_methods,
    "p4_usages": flatten.p4_usages,
    "p5_found": references.p5_found,
    "p5_report": references.p5_report,
}

SQL = {
    "p1_found": incremental.P1_FOUND_SQL,
    "p2_found": hierarchy.P2_FOUND_SQL,
    "p2_paths": hierarchy.P2_PATHS_SQL,
    "p2_descendants": hierarchy.P2_DESCENDANTS_SQL,
    "p2_all_paths": hierarchy.P2_ALL_PATHS_SQL,
    "p2_all_descendants": hierarchy.P2_ALL_DESCENDANTS_SQL,
    "p4_found": flatten.P4_FOUND_SQL,
    "p4_triples": flatten.P4_TRIPLES_SQL,
    "p4_controllers": flatten.P4_CONTROLLERS_SQL,
    "p4_methods": flatten.P4_METHODS_SQL,
    "p4_usages": flatten.P4_USAGES_SQL,
    "p5_found": references.P5_FOUND_SQL,
    "p5_report": references.P5_REPORT_SQL,
}
