"""Processing only new or changed records: the target is the state.

Every row of the target carries the key and the version of the source record it
was made from, and, where its facts rest on others, the states of those. A run
takes up exactly the source records that the published target doesn't hold in
their present version (an anti-join), writes only what it made of them, and
publishes the next target version with one atomic step. A run that dies leaves
no version behind, so its records are taken up again; a run that published is
never repeated.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.io import materialize, register_temporary, shared_dir, table

STATE = ("modified_ms", "size_bytes", "sha256")
SCHEMA_VERSION = "v3"
MOST_PARTS = 8  # a version of so many parts is written as one next time


def unheld(source: DataFrame, held: DataFrame, keys: Sequence[str], versions: Sequence[str], counts: dict[str, Column] | None = None) -> DataFrame:
    """Source rows that ``held`` doesn't have with the same keys and versions.

    Keys compare by equality (a null key is held by nothing and is always taken
    up), versions null-safely. ``counts`` may give conditions on ``held`` under
    which a version column is compared at all. Repeated rows of ``held`` count
    once; other columns of ``held``, whatever their names, are not looked at.
    """
    counts = counts or {}
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)] + [F.col(v).alias(f"__v{i}") for i, v in enumerate(versions)]
    h = held.select(*named, *[F.coalesce(c, F.lit(True)).alias(f"__c{versions.index(v)}") for v, c in counts.items()])
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (source[k] == h[f"__k{i}"])
    for i, v in enumerate(versions):
        same = source[v].eqNullSafe(h[f"__v{i}"])
        on = on & ((same | ~h[f"__c{i}"]) if v in counts else same)
    return source.join(h, on, "left_anti")


class Conflict(RuntimeError):
    """Another run published the version first."""


class StateTarget:
    """A target table that is its own processing state.

    ``keys`` name a record, ``versions`` its state. ``counts`` gives conditions
    on target rows under which a version column counts. ``dependencies`` names
    an array column of structs with the last key (of the row's other keys) and
    the version columns: a row is held only while all of these are source
    records in that state; a null member is none.

    ``parts`` holds what runs wrote: the rows and the keys they speak for.
    ``versions/N`` lists the parts of version N; of a key the rows of the last
    part that speaks for it hold, null keys being equal here. The list appears
    under its final name complete and only if no other run put one there.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], versions: Sequence[str], counts: dict[str, Column] | None = None, dependencies: str | None = None):
        self.spark, self.path, self.keys, self.versions = spark, path.rstrip("/"), tuple(keys), tuple(versions)
        self.counts, self.dependencies = counts or {}, dependencies
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._Path(f"{self.path}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n.isdigit())

    def current(self) -> int | None:
        """Number of the newest published version, None before the first."""
        return max(self._numbers(), default=None)

    def parts(self, version: int | None) -> list[str]:
        if version is None:
            return []
        with_stream = self._fs.open(self._Path(f"{self.path}/versions/{version}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8"))["parts"]
        finally:
            with_stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, of the current one if not given; None if there is none."""
        parts = self.parts(self.current() if version is None else version)
        if not parts:
            return None
        rows = [self.spark.read.parquet(f"{self.path}/parts/{p}/rows") for p in parts]
        if len(rows) == 1:
            return rows[0]
        # Later parts are changes, small beside the first: their keys tell which older rows still hold.
        spoken = [self.spark.read.parquet(f"{self.path}/parts/{p}/keys").withColumn("__n", F.lit(n)) for n, p in enumerate(parts) if n]
        last = reduce(DataFrame.unionByName, spoken).groupBy(*self.keys).agg(F.max("__n").alias("__n"))
        last = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], F.col("__n").alias("__last"))
        every = reduce(DataFrame.unionByName, [r.withColumn("__n", F.lit(n)) for n, r in enumerate(rows)])
        on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        return every.join(last, on, "left").where(F.col("__last").isNull() | (F.col("__n") == F.col("__last"))).select(*rows[0].columns)

    def held(self, source: DataFrame, version: int | None = None) -> DataFrame | None:
        """Target rows that rest on nothing that ``source`` lacks or has in another state."""
        rows = self.read(version)
        if rows is None or self.dependencies is None:
            return rows
        owners, member = list(self.keys[:-1]), self.keys[-1]
        on = [F.col(o) for o in owners]
        each = rows.select(*on, F.col(member).alias("__of"), *[c.alias(f"__if_{v}") for v, c in self.counts.items()], F.explode(self.dependencies).alias("__d"))
        each = each.select(*on, "__of", *[F.col(f"__if_{v}") for v in self.counts], *[F.col("__d")[c].alias(c) for c in (member, *self.versions)])
        gone = self._absent(each, source)
        gone = gone.select(*owners, F.col("__of").alias(member)).distinct()
        return rows.join(gone, list(self.keys), "left_anti")

    def _absent(self, members: DataFrame, source: DataFrame) -> DataFrame:
        """Members that no source record equals."""
        at = source.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], *[F.col(v).alias(f"__v{i}") for i, v in enumerate(self.versions)])
        on = reduce(Column.__and__, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(self.keys)])
        for i, v in enumerate(self.versions):
            same = F.col(v).eqNullSafe(F.col(f"__v{i}"))
            on = on & ((same | ~F.coalesce(F.col(f"__if_{v}"), F.lit(True))) if v in self.counts else same)
        return members.join(at, on, "left_anti")

    def pending(self, source: DataFrame, version: int | None = None, once: bool = True) -> DataFrame:
        """Source rows that the published target doesn't hold in their present version; with ``once`` one of each key and version."""
        held = self.held(source, version)
        source = source.dropDuplicates([*self.keys, *self.versions]) if once else source
        return source if held is None else unheld(source, held, self.keys, self.versions, self.counts)

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process what is pending and publish the next version; its number.

        ``process`` must keep the key and version columns. Rows of the former
        version stay unless their key is made anew or has left the source. The
        source is read once; a run that finds nothing to do publishes nothing.
        """
        v = self.current()
        source = materialize(source, "source")
        todo = materialize(self.pending(source, v), "pending")
        keys = todo.select(*self.keys)
        if v is not None:
            on = source.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)])
            left = self.read(v).select(*self.keys).join(on, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]), "left_anti")
            keys = materialize(keys.unionByName(left).distinct(), "spoken")
            if keys.isEmpty():
                return v
        return self.publish(process(todo), v, keys)

    def publish(self, rows: DataFrame, after: int | None, keys: DataFrame | None = None) -> int:
        """Publish the version that follows ``after``, the one that was read (None: the first); its number.

        With ``keys``, ``rows`` replace what version ``after`` holds of these
        keys; without, they are the whole target. Raises ``Conflict`` if another
        run has published that version already.
        """
        new = (after or 0) + 1
        part, old = f"{new}-{uuid.uuid4().hex}", [] if keys is None else self.parts(after)
        to = f"{self.path}/parts/{part}"
        rows.write.parquet(f"{to}/rows")
        (keys if keys is not None else self.spark.read.parquet(f"{to}/rows").limit(0)).select(*self.keys).distinct().write.parquet(f"{to}/keys")
        names = [*old, part]
        if len(names) > MOST_PARTS:
            whole = f"{new}-{uuid.uuid4().hex}"
            self._merged(names).write.parquet(f"{self.path}/parts/{whole}/rows")
            self._fs.delete(self._Path(to), True)
            names = [whole]
        if not self._claim(new, json.dumps({"parts": names})):
            self._fs.delete(self._Path(f"{self.path}/parts/{names[-1]}"), True)
            raise Conflict(f"version {new} of {self.path} was published by another run")
        return new

    def _merged(self, names: list[str]) -> DataFrame:
        other = StateTarget(self.spark, self.path, self.keys, self.versions)
        other.parts = lambda version: names  # type: ignore[method-assign]
        return other.read(0)

    def _claim(self, version: int, text: str) -> bool:
        """Put the list of a version in its place, complete, unless there is one."""
        tmp, final = f"{self.path}/tmp/{uuid.uuid4().hex}", f"{self.path}/versions/{version}"
        self._fs.mkdirs(self._Path(f"{self.path}/versions"))
        out = self._fs.create(self._Path(tmp), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # whose rename replaces; a link does not
                plain = lambda p: self._Path(p).toUri().getPath()
                try:
                    os.link(plain(tmp), plain(final))
                except FileExistsError:
                    return False
                return True
            return bool(self._fs.rename(self._Path(tmp), self._Path(final)))
        finally:
            self._fs.delete(self._Path(tmp), False)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all versions but the last ``keep``, and the parts that none of these names.

        Parts of versions not yet published are left alone: their writers may live.
        """
        numbers = self._numbers()
        if not numbers:
            return
        used = {p for n in numbers[-keep:] for p in self.parts(n)}
        for n in numbers[:-keep]:
            self._fs.delete(self._Path(f"{self.path}/versions/{n}"), False)
        for s in self._fs.listStatus(self._Path(f"{self.path}/parts")):
            name = s.getPath().getName()
            if name not in used and int(name.split("-")[0]) <= numbers[-1]:
                self._fs.delete(s.getPath(), True)


def final_status(runs: DataFrame) -> DataFrame:
    """(run_id, status): the status with the latest logged_at; of equal times the greatest text, null times count least."""
    return runs.groupBy("run_id").agg(F.max_by("status", F.struct("logged_at", "status")).alias("status"))


def valid_entries(entries: DataFrame, runs: DataFrame, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """Of each project and path the entry of the highest successful run; of equal runs the one stored last."""
    ok = final_status(runs).where(F.col("status") == "succeeded").select("run_id")
    held = entries.where(F.col("schema_version") == schema_version).join(ok, "run_id", "left_semi")
    # Facts of one file stay together through the aggregate; the struct moves once.
    best = F.max_by(F.struct("kind", *STATE, "dependencies"), F.struct("run_id", "stored_at", "entry_id"))
    return held.groupBy("project_id", "relative_path").agg(best.alias("e")).select("project_id", "relative_path", "e.*")


def unprocessed_files(files: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id): files whose facts no successful run holds for their present state and that of their dependencies.

    What successful runs stored is published as the target, a row per file with
    its key, state and dependencies; what the target doesn't hold is pending.
    Repeated rows count once. Null or empty dependencies are none; a null member
    or one without path names no file and makes its entry stale. Kind ``mtime``
    ignores hashes, any other kind compares them. Files without project or path
    are always taken up. Extra columns don't matter; empty tables give all files
    (no entries) or nothing (no files).
    """
    spark = files.sparkSession
    keys = ("project_id", "relative_path")
    target = StateTarget(spark, f"{shared_dir(spark)}/factmill/facts-{uuid.uuid4().hex}", keys, STATE, {"sha256": F.col("kind") != "mtime"}, "dependencies")
    register_temporary(spark, target.path)
    target.publish(valid_entries(entries, runs), None)
    f = files.select("file_id", *keys, *STATE).distinct()
    return target.pending(f, once=False).select("file_id").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unprocessed_files(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "cache_entries"), table(spark, sf_dir, "cache_runs"))


P1_FOUND_SQL = """
WITH f AS (SELECT DISTINCT file_id, project_id, relative_path, modified_ms, size_bytes, sha256 FROM source_files),
ok AS (SELECT run_id FROM (SELECT run_id, arg_max(status, logged_at) AS status FROM cache_runs GROUP BY run_id) WHERE status = 'succeeded'),
v AS (SELECT *, row_number() OVER (PARTITION BY project_id, relative_path ORDER BY run_id DESC, stored_at DESC, entry_id DESC) AS rn
      FROM cache_entries WHERE schema_version = 'v3' AND run_id IN (SELECT run_id FROM ok)),
e AS (SELECT * FROM v WHERE rn = 1),
d AS (SELECT project_id, relative_path, kind, unnest(dependencies) AS d FROM e),
stale AS (SELECT DISTINCT d.project_id, d.relative_path FROM d LEFT JOIN f ON f.project_id = d.project_id AND f.relative_path = d.d.relative_path
          WHERE f.file_id IS NULL OR f.modified_ms IS DISTINCT FROM d.d.modified_ms OR f.size_bytes IS DISTINCT FROM d.d.size_bytes
             OR (d.kind <> 'mtime' AND f.sha256 IS DISTINCT FROM d.d.sha256))
SELECT DISTINCT f.file_id FROM f LEFT JOIN e ON e.project_id = f.project_id AND e.relative_path = f.relative_path
LEFT JOIN stale s ON s.project_id = f.project_id AND s.relative_path = f.relative_path
WHERE e.entry_id IS NULL OR s.project_id IS NOT NULL OR e.modified_ms IS DISTINCT FROM f.modified_ms OR e.size_bytes IS DISTINCT FROM f.size_bytes
   OR (e.kind <> 'mtime' AND e.sha256 IS DISTINCT FROM f.sha256)
"""
