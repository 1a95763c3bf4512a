import pytest
from pyspark.sql import functions as F

from factmill.functions import php_text as P
from factmill.functions.names import php_name
from factmill.operators import relational as R


def test_php_names(spark, rows):
    df = spark.createDataFrame([(" \\App\\A\t",), ("APP\\a",), ("\\\\x",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(php_name("n")).collect()] == ["app\\a", "app\\a", "\\x", "", None]


def test_first_seen_list(spark, rows):
    df = spark.createDataFrame([("k", 2, ["b", "a"]), ("k", 1, ["c", None, "a"]), ("k", 3, None), (None, 1, ["z"]), ("e", 1, [])], "k string, o int, v array<string>")
    assert rows(R.first_seen_list(df, ["k"], ["o"], "v", "v")) == sorted([("k", ["c", "a", "b"]), (None, ["z"])], key=str)


def test_unique_owner_and_sets(spark, rows):
    df = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", "X"), ("b", "Y"), ("c", None)], "k string, o string")
    assert rows(R.unique_owner(df, ["k"], "o")) == [("a", "X", 1), ("b", None, 2), ("c", None, 0)]
    assert rows(R.sorted_set(df, ["k"], "o", "s")) == [("a", ["X"]), ("b", ["X", "Y"]), ("c", [])]


def test_keep_first_and_consecutive(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (1, 5, None), (1, 6, None)], "k int, o int, v string")
    assert [r[1] for r in rows(R.drop_consecutive(df, ["k"], ["o"], ["v"]))] == [1, 3, 4, 5]
    assert sorted(r[1] for r in rows(R.keep_first(df, ["k", "v"], ["o"]))) == [1, 3, 5]
    assert R.keep_first(df.limit(0), ["k"], ["o"]).collect() == []


def test_merges(spark, rows):
    df = spark.createDataFrame([(1, 1, None, ["b"], "array"), (1, 2, "x", ["a"], "collection"), (1, 3, "y", None, None)], "k int, o int, v string, s array<string>, kind string")
    got = R.merge_first_non_null(df.where("s is not null"), ["k"], ["o"], ["v"], ["s"])
    assert rows(got) == [(1, "x", ["a", "b"])]
    assert rows(df.groupBy("k").agg(R.merged_kind("kind", ["o"]).alias("kind"))) == [(1, "collection")]
    assert rows(df.where("o > 1").groupBy("k").agg(R.merged_kind("kind", ["o"]).alias("kind"))) == [(1, "collection")]


def test_match(spark, rows):
    routes = spark.createDataFrame([(1, "controller_method", "A::a"), (2, "controller_method", "A::b"), (3, "closure", None), (4, None, "A::a"), (5, "invokable_controller", None)], "i int, action_kind string, action_key string")
    got = rows(R.match_routes(routes, spark.createDataFrame([("A::a",), ("A::a",)], "action_key string")), "i", "match_status", "reason_code")
    assert got == [(1, "matched", None), (2, "missing_static", "missing_static_action"), (3, "runtime_only", "closure_action"), (4, "unsupported", "unknown_action"), (5, "missing_static", "missing_static_action")]


def test_subclasses_end_on_loops(spark, rows):
    data = [("p", "A", "Base"), ("p", "B", "A"), ("p", "C", "B"), ("p", "X", "Y"), ("p", "Y", "X"), ("p", "Z", "Z"), ("q", "B", "A"), ("p", "N", None)]
    df = spark.createDataFrame(data, "project_id string, fqcn string, extends string")
    assert rows(R.subclasses(df, "Base"), "project_id", "fqcn") == [("p", "A"), ("p", "B"), ("p", "C")]
    assert rows(R.subclasses(df, "Z"), "fqcn") == [("Z",)]


def test_ancestry_on_and_below_loops(spark, rows):
    data = [("p", "X", "Y"), ("p", "Y", "X"), ("p", "M", "X"), ("p", "N", "M"), ("p", "O", "N"), ("p", "A", "Base"), ("p", "B", "A")]
    got = rows(R.ancestry(spark.createDataFrame(data, "project_id string, fqcn string, extends string")), "fqcn", "base")
    below = {"X": "XY", "Y": "XY", "M": "XY", "N": "MXY", "O": "NMXY"}
    assert got == sorted([(c, b) for c, bs in below.items() for b in bs] + [("A", "Base"), ("B", "A"), ("B", "Base")], key=str)


def test_dependency_edges(spark, rows):
    owners = spark.createDataFrame([("p", "a.php", "A"), ("p", "b.php", "B"), ("q", "c.php", "C")], "project_id string, relative_path string, fqcn string")
    uses = spark.createDataFrame([("p", "a.php", "B"), ("p", "a.php", "A"), ("p", "a.php", "B"), ("p", "b.php", "C"), ("p", "b.php", None)], "project_id string, relative_path string, fqcn string")
    assert rows(R.dependency_edges([uses, uses], owners)) == [("p", "a.php", "b.php")]


@pytest.mark.parametrize(
    ("body", "status"),
    [("return response()->json(['a' => f(1, 2)], 201);", 201), ("response('x', 418)", 418), ("abort(404)", 404), ("->setStatusCode(202)", 202), ("response()->noContent()", 204), ("nothing", None), (None, None), ("x" * 40_000 + "response()->json(1)\n" * 2000, None)],
)
def test_http_status(spark, body, status):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(P.http_status(F.col("b"))).first()[0] == status


def test_imports(spark):
    text = "<?php\nuse A\\B;\n use \\C\\D as E;\nuse F\\{G, H};\nuse function x;\nclass Z {\n  use B2\\B;\n}\n"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    first, none, empty = (r[0] for r in df.select(P.imports(F.col("t"))).collect())
    assert first == {"B": "B2\\B", "E": "C\\D", "function x": "function x"} and none is None and empty == {}
    assert df.select(P.imports(F.col("t"), aliases=False)).first()[0]["D as E"] == "C\\D as E"
