import pytest
from pyspark.sql import functions as F

from factmill.operators import incremental
from factmill.operators.incremental import Conflict, StateTarget, final_status, unheld, unprocessed_files

FILES = "file_id long, project_id string, relative_path string, modified_ms long, size_bytes long, sha256 string, kind string, d string"
ENTRIES = "entry_id long, run_id long, project_id string, schema_version string, kind string, relative_path string, modified_ms long, size_bytes long, sha256 string, dependencies array<struct<relative_path string, modified_ms long, size_bytes long, sha256 string>>, stored_at timestamp"
RUNS = "run_id long, status string, logged_at timestamp, extra string"


def _tables(spark, files, entries, runs):
    f = spark.createDataFrame([(*x, "clash", "clash") for x in files], FILES)
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(entries)], ENTRIES.replace(", stored_at timestamp", "")).withColumn("stored_at", F.lit("2024-01-01").cast("timestamp"))
    r = spark.createDataFrame([(a, b, c, "x") for a, b, c in runs], "run_id long, status string, logged_at string, extra string").withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    return f, e, r


RUN_LOG = [(1, "running", "2024-01-01"), (1, "succeeded", "2024-01-02"), (2, "succeeded", "2024-01-03"), (2, "rolled_back", "2024-01-04"), (3, "running", "2024-01-05"), (4, "succeeded", "2024-01-06"), (4, "running", "2024-01-05")]


def test_cases(spark, rows):
    files = [(i, "p", f"f{i}.php", 10, 5, "h") for i in range(1, 13)] + [(1, "p", "f1.php", 10, 5, "h"), (20, None, "x", 1, 1, "h"), (21, "p", None, 1, 1, "h")]
    s = lambda path, ms=10, sha="h": (path, ms, 5, sha)
    e = lambda run, path, kind="sha256+mtime", ms=10, sha="h", deps=None, version="v3": (run, "p", version, kind, path, ms, 5, sha, deps)
    entries = [
        e(1, "f1.php"),  # held
        e(2, "f2.php"),  # its run was rolled back
        e(3, "f3.php"),  # its run never ended
        e(1, "f4.php", version="v2"),
        e(1, "f5.php", ms=9),
        e(1, "f6.php", sha="old"),
        e(1, "f7.php", kind="mtime", sha=None),  # held without hash
        e(1, "f8.php", deps=[s("f1.php"), s("f2.php", 11)]),  # a dependency changed
        e(1, "f9.php", deps=[s("gone.php")]),
        e(1, "f10.php", deps=[s("f1.php")]),  # held
        e(1, "f11.php"), e(4, "f11.php", ms=9),  # the higher run holds
        e(1, "f12.php", deps=[None]),  # a null member names no file
        e(1, "f1.php"),
    ]
    found = unprocessed_files(*_tables(spark, files, entries, RUN_LOG))
    assert rows(found) == sorted([(i,) for i in (2, 3, 4, 5, 6, 8, 9, 11, 12, 20, 21)], key=str)


def test_empty_tables(spark, rows):
    f, e, r = _tables(spark, [(1, "p", "a", 1, 1, None)], [], [])
    assert rows(unprocessed_files(f, e, r)) == [(1,)]
    assert rows(unprocessed_files(f.limit(0), e, r)) == []


def test_final_status_takes_the_latest_row(spark, rows):
    _, _, r = _tables(spark, [], [], RUN_LOG + [(4, "running", "2024-01-05")])
    assert rows(final_status(r)) == [(1, "succeeded"), (2, "rolled_back"), (3, "running"), (4, "succeeded")]


def test_unheld_is_null_safe_in_versions_only(spark, rows):
    src = spark.createDataFrame([(1, None), (2, 5), (None, 5)], "k long, v long")
    held = spark.createDataFrame([(1, None), (2, 6), (None, 5)], "k long, v long")
    assert rows(unheld(src, held, ["k"], ["v"])) == sorted([(2, 5), (None, 5)], key=str)


def test_target_processes_each_change_once_and_survives_failures(spark, rows, tmp_path):
    at = StateTarget(spark, f"file://{tmp_path}/t", ["k"], ["v"])
    src = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 1, "b")], "k long, v long, x string")
    done: list[int] = []

    def process(df):
        done.append(df.count())
        return df

    assert at.current() is None
    assert at.run(src, process) == 1

    def fails(df):
        raise RuntimeError("lost")

    changed = spark.createDataFrame([(1, 2, "a2"), (2, 1, "b"), (3, 1, "c")], "k long, v long, x string")
    with pytest.raises(RuntimeError):
        at.run(changed, fails)
    assert at.current() == 1  # nothing was published
    assert at.run(changed, process) == 2
    assert rows(at.read()) == [(1, 2, "a2"), (2, 1, "b"), (3, 1, "c")]
    assert at.run(changed.where("k <> 3"), process) == 3
    assert rows(at.read()) == [(1, 2, "a2"), (2, 1, "b")]
    assert done == [2, 2, 0]
    with pytest.raises(RuntimeError):
        at.publish(changed, after=1)  # another run was first


def _target(spark, tmp_path, **how):
    return StateTarget(spark, f"file://{tmp_path}/t", ["k"], ["v"], **how)


def _kv(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v long, x string")


def test_of_two_interleaved_writers_one_fails_and_loses_nothing(spark, rows, tmp_path):
    one, two = _target(spark, tmp_path), _target(spark, tmp_path)
    src = _kv(spark, (1, 1, "a"), (2, 1, "b"))
    assert one.run(src, lambda df: df) == 1
    after = one.current()

    def slow(df):  # while this run works, another one reads the same version and publishes first
        assert two.run(_kv(spark, (1, 3, "two"), (2, 1, "b")), lambda d: d) == 2
        return df

    with pytest.raises(Conflict):
        one.run(_kv(spark, (1, 2, "one"), (2, 1, "b")), slow)
    assert rows(one.read()) == [(1, 3, "two"), (2, 1, "b")]
    for writer in (one, two):
        with pytest.raises(Conflict):
            writer.publish(src, after)
    assert len(one.parts(2)) == 2
    one.vacuum(keep=1)
    assert one._numbers() == [2] and rows(one.read()) == [(1, 3, "two"), (2, 1, "b")]
    left = {p.name for p in (tmp_path / "t" / "parts").iterdir()}
    assert left == set(one.parts(2))


def test_runs_write_changes_only_and_parts_are_merged(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_PARTS", 3)
    t = _target(spark, tmp_path)
    state = {k: (1, "a") for k in range(3)}
    for n in range(2, 8):
        state[n % 3] = (n, "b")
        state[100 + n] = (n, "c")
        version = t.run(_kv(spark, *[(k, *x) for k, x in state.items()]), lambda df: df)
        assert rows(t.read()) == sorted([(k, *x) for k, x in state.items()], key=str)
        assert version == n - 1 and len(t.parts(version)) <= 3
    assert t.run(_kv(spark, *[(k, *x) for k, x in state.items()]), lambda df: df) == version  # nothing to do
    assert t.run(_kv(spark, (None, 1, "n"), (None, 1, "n"), (5, 5, "e")), lambda df: df) == version + 1
    assert t.run(_kv(spark, (None, 2, "m"), (5, 5, "e")), lambda df: df) == version + 2
    assert rows(t.read()) == sorted([(None, 2, "m"), (5, 5, "e")], key=str)


def test_target_with_dependencies(spark, rows, tmp_path):
    dep = "array<struct<k long, v long>>"
    t = _target(spark, tmp_path, dependencies="deps")
    src = _kv(spark, (1, 1, "a"), (2, 1, "b"), (3, 1, "c"))
    on = {1: "array(struct(2L, 1L))", 2: "null", 3: "array()"}
    deps = "CASE k " + " ".join(f"WHEN {k} THEN CAST({e} AS {dep.replace(' long', ':long')})" for k, e in on.items()) + " END"
    t.publish(src.selectExpr("*", f"{deps} AS deps"), None)
    assert rows(t.pending(src)) == []
    assert rows(t.pending(_kv(spark, (1, 1, "a"), (2, 2, "b"), (3, 1, "c"))), "k") == [(1,), (2,)]
    assert rows(t.pending(_kv(spark, (1, 1, "a"), (3, 1, "c"))), "k") == [(1,)]
