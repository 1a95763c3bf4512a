"""All queries on texts, by name, and the SQL they are compared with."""

from __future__ import annotations

from factmill.llm import packing, spans, syntax, tokenizer

QUERIES = {
    "p3_found": syntax.p3_found,
    "p3_rates": syntax.p3_rates,
    "p6_ids": tokenizer.p6_ids,
    "p7_containers": packing.p7_containers,
    "p7_report": packing.p7_report,
    "p7_checks": packing.p7_checks,
    "p8_found": spans.p8_found,
    "p8_shared": spans.p8_shared,
}

SQL: dict[str, str] = {
    "p7_checks": packing.P7_CHECKS_SQL,
    "p8_found": spans.P8_FOUND_SQL,
    "p8_shared": spans.P8_SHARED_SQL,
}
