"""All queries of the core, by name, and the SQL they are compared with."""

from __future__ import annotations

from factmill.plans import contract_queries, kernel_queries, pipeline_queries  # noqa: F401, the contract's queries register beside the kernel's

QUERIES = pipeline_queries.QUERIES | kernel_queries.QUERIES
SQL = pipeline_queries.SQL | kernel_queries.SQL
