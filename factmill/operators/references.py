"""References to records that do not exist.

A reference is a composite key of which any part may be null. References are
grouped by their null mask; each mask is anti-joined on its non-null columns
under the match semantics declared for nulls.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.names import php_name
from factmill.io import table

SEMANTICS = ("simple", "partial", "full")


def orphans(refs: DataFrame, targets: DataFrame, keys: Sequence[str], target_keys: Sequence[str], semantics: str = "simple", residual: Column | None = None) -> DataFrame:
    """Rows of ``refs`` whose key has no row in ``targets``.

    ``simple``: a key with any null refers to nothing and is no orphan.
    ``partial``: the non-null parts must be met by one target row; a key of nulls
    alone refers to nothing. ``full``: a key of nulls alone refers to nothing, one
    that mixes nulls and values is an orphan. Target rows are never filtered by
    nulls of their own beyond that equality fails on them. ``residual`` is a
    further condition between both rows. Repeated reference rows are all kept.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    kept = None
    for mask in product((False, True), repeat=len(keys)):
        if all(mask) or (any(mask) and semantics == "simple"):
            continue
        rows = refs
        for k, null in zip(keys, mask):
            rows = rows.where(F.col(k).isNull() if null else F.col(k).isNotNull())
        if any(mask) and semantics == "full":
            lost = rows
        else:
            on = F.lit(True) if residual is None else residual
            for k, t, null in zip(keys, target_keys, mask):
                if not null:
                    on = on & (rows[k] == targets[t])
            lost = rows.join(targets, on, "left_anti")
        kept = lost if kept is None else kept.unionByName(lost)
    return kept


def _methods(methods: DataFrame) -> DataFrame:
    return methods.select(
        F.col("project_id").alias("t_project"), php_name("fqcn").alias("t_class"), php_name("method_name").alias("t_method"), F.col("seen_at").alias("t_seen"), F.col("deleted_at").alias("t_deleted")
    )


def _bindings(bindings: DataFrame) -> DataFrame:
    method = php_name("method_name")
    return bindings.select(
        "binding_id", "project_id", php_name("controller_fqcn").alias("class"), F.coalesce(F.nullif(method, F.lit("")), F.lit("__invoke")).alias("method"), "seen_at"
    ).distinct()


def orphan_bindings(bindings: DataFrame, methods: DataFrame) -> DataFrame:
    """(binding_id, project_id, seen_at, reason): bindings without a method that lived when they were seen.

    ``missing``: no row of that method; ``late``: all its rows were seen later;
    ``deleted``: some were seen by then, all of these gone by then. A null class
    refers to nothing (mask semantics ``simple``); a null or empty method means
    ``__invoke``. A binding without time is an orphan only where the method is
    missing; a method row without time never counts as seen. Repeats count once.
    """
    refs, rows = _bindings(bindings), _methods(methods)
    # Few methods take most bindings. The large side stands left of the anti-join, where
    # AQE splits a hot method's rows over many tasks; the exchange behind it keeps the
    # next join from asking for that partitioning again, and moves orphans only.
    ever = rows.groupBy("t_project", "t_class", "t_method").agg(F.min("t_seen").alias("t_first"))
    alive = F.col("t_seen").isNotNull() & (F.col("t_seen") <= F.col("seen_at")) & (F.col("t_deleted").isNull() | (F.col("t_deleted") > F.col("seen_at")))
    keys, target = ["project_id", "class", "method"], ["t_project", "t_class", "t_method"]
    lost = orphans(refs, rows, keys, target, "simple", alive).repartition("binding_id")
    on = [F.col(k) == F.col(t) for k, t in zip(keys, target)]
    reason = (
        F.when(F.col("t_class").isNull(), "missing")
        .when(F.col("seen_at").isNull(), F.lit(None))
        .when(F.col("t_first").isNull() | (F.col("t_first") > F.col("seen_at")), "late")
        .otherwise("deleted")
    )
    told = lost.join(ever, on, "left").select("binding_id", "project_id", "seen_at", reason.alias("reason"))
    return told.where(F.col("reason").isNotNull())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_bindings(table(spark, sf_dir, "route_bindings"), table(spark, sf_dir, "controller_methods")).select("binding_id", "reason")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, month, reason, orphans): orphans of every referring table by month of seen_at."""
    lost = orphan_bindings(table(spark, sf_dir, "route_bindings"), table(spark, sf_dir, "controller_methods"))
    month = F.date_format("seen_at", "yyyy-MM")
    return lost.groupBy(F.lit("route_bindings").alias("table_name"), month.alias("month"), "reason").agg(F.count("*").alias("orphans"))


_P5_SQL = r"""
WITH b AS (SELECT DISTINCT binding_id, project_id, lower(regexp_replace(trim(controller_fqcn, ' ' || chr(9) || chr(10) || chr(13)), '^\\', '')) AS c,
             coalesce(nullif(lower(trim(method_name, ' ' || chr(9) || chr(10) || chr(13))), ''), '__invoke') AS m, seen_at FROM route_bindings WHERE controller_fqcn IS NOT NULL),
t AS (SELECT project_id, lower(regexp_replace(trim(fqcn, ' ' || chr(9) || chr(10) || chr(13)), '^\\', '')) AS c, lower(trim(method_name, ' ' || chr(9) || chr(10) || chr(13))) AS m, seen_at, deleted_at FROM controller_methods),
j AS (SELECT b.binding_id, b.seen_at, count(t.c) AS n, count(CASE WHEN t.seen_at <= b.seen_at THEN 1 END) AS seen,
        count(CASE WHEN t.seen_at <= b.seen_at AND (t.deleted_at IS NULL OR t.deleted_at > b.seen_at) THEN 1 END) AS alive
      FROM b LEFT JOIN t ON t.project_id = b.project_id AND t.c = b.c AND t.m = b.m GROUP BY 1, 2),
o AS (SELECT binding_id, seen_at, CASE WHEN n = 0 THEN 'missing' WHEN seen = 0 THEN 'late' ELSE 'deleted' END AS reason FROM j WHERE alive = 0)
"""
P5_FOUND_SQL = _P5_SQL + "SELECT binding_id, reason FROM o"
P5_REPORT_SQL = _P5_SQL + "SELECT 'route_bindings' AS table_name, strftime(seen_at, '%Y-%m') AS month, reason, count(*) AS orphans FROM o GROUP BY ALL"
