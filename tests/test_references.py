import pytest
from pyspark.sql import functions as F

from factmill.operators.references import orphan_bindings, orphans

B = "binding_id long, project_id string, controller_fqcn string, method_name string, seen_at string, t_class string"
M = "project_id string, fqcn string, method_name string, seen_at string, deleted_at string, reason string"


def _dated(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def test_reasons(spark, rows):
    methods = [
        ("p", "App\\A", "index", "2024-02-01", None, ""),
        ("p", "App\\A", "gone", "2024-01-01", "2024-02-01", ""),
        ("p", "App\\A", "back", "2024-01-01", "2024-02-01", ""),
        ("p", "App\\A", "back", "2024-04-01", None, ""),
        ("p", "App\\I", "__INVOKE", "2024-01-01", None, ""),
        ("p", "App\\A", "index", "2024-02-01", None, ""),
        ("q", "App\\X", "index", None, None, ""),
        (None, "App\\A", "index", "2024-02-01", None, ""),
    ]
    bindings = [
        (1, "p", "\\app\\a ", " INDEX", "2024-03-01", ""),  # lives
        (2, "p", "App\\A", "index", "2024-01-15", ""),  # late
        (3, "p", "App\\A", "gone", "2024-02-01", ""),  # deleted at that moment
        (4, "p", "App\\A", "gone", "2024-01-31", ""),  # still lives
        (5, "p", "App\\A", "back", "2024-03-01", ""),  # deleted, back later
        (6, "p", "App\\A", "back", "2024-04-01", ""),
        (7, "p", "App\\A", "nope", "2024-04-01", ""),  # missing
        (8, "q", "App\\A", "index", "2024-04-01", ""),  # missing: of another project
        (9, "p", "App\\I", None, "2024-04-01", ""),
        (10, "p", "App\\I", "", "2024-04-01", ""),
        (11, "p", None, "index", "2024-04-01", ""),  # refers to nothing
        (12, "p", "App\\A", None, "2024-04-01", ""),  # missing: no __invoke
        (13, "p", "App\\A", "index", None, ""),  # no time: not told
        (14, "p", "App\\A", "nope", None, ""),  # missing whenever
        (15, "q", "App\\X", "index", "2024-04-01", ""),  # a method without time was never seen
        (2, "p", "App\\A", "index", "2024-01-15", ""),
    ]
    b, m = _dated(spark.createDataFrame(bindings, B), "seen_at"), _dated(spark.createDataFrame(methods, M), "seen_at", "deleted_at")
    got = rows(orphan_bindings(b, m), "binding_id", "reason")
    assert got == sorted([(2, "late"), (3, "deleted"), (5, "deleted"), (7, "missing"), (8, "missing"), (12, "missing"), (14, "missing"), (15, "late")], key=str)
    assert orphan_bindings(b.limit(0), m).collect() == []
    assert rows(orphan_bindings(b.where("binding_id = 1"), m.limit(0)), "reason") == [("missing",)]


def test_mask_semantics(spark, rows):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "z"), (4, None, None), (5, "c", None), (1, "a", "x"), (6, "b", "x")], "i long, k string, l string")
    targets = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "tk string, tl string")
    get = lambda s: [r[0] for r in rows(orphans(refs, targets, ["k", "l"], ["tk", "tl"], s), "i")]
    assert get("simple") == [6]
    assert get("partial") == [3, 5, 6]
    assert get("full") == [2, 3, 5, 6]
    with pytest.raises(ValueError):
        orphans(refs, targets, ["k"], ["tk"], "other")
