"""Source scan: PHP files below the targets of a project root, as a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from factmill.functions.php_text import relative_path

FILES = "project_id string, relative_path string, path string, source_text string, modified_ms bigint, size_bytes bigint, sha256 string"


def is_php(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".php"))


def kept_vendor(path: Column, whitelist: Sequence[str]) -> Column:
    """False for files under vendor/ that no whitelist entry is a prefix of."""
    vendor = F.startswith(path, F.lit("vendor/")) | F.contains(path, F.lit("/vendor/"))
    listed = F.lit(False)
    for w in whitelist:
        listed = listed | F.startswith(path, F.lit(w))
    return ~vendor | listed


def limit_files(files: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` files of every project by path, with ``partial``: whether the limit was reached."""
    if most is None:
        return files.withColumn("partial", F.lit(False))
    w = Window.partitionBy("project_id")
    ranked = files.withColumn("__n", F.row_number().over(w.orderBy("relative_path"))).withColumn("partial", F.count("*").over(w) >= most)
    return ranked.where(F.col("__n") <= most).drop("__n")


def _hidden_name(name: str) -> bool:
    """Whether Spark's own listing passes a name over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def hidden_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, modificationTime, length, content) of PHP files that Spark's listing leaves out for a name on their way that begins with ``.`` or ``_``."""
    jvm, found = spark.sparkContext._jvm, {}
    for root in roots:
        at = jvm.org.apache.hadoop.fs.Path(root)
        listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
        own = len(root.rstrip("/").split("/")) - 1  # the target's own name counts
        while listed.hasNext():
            f = listed.next()
            path = f.getPath().toString()
            if path.lower().endswith(".php") and any(map(_hidden_name, path.split("/")[own:])):
                found[path] = (path, f.getModificationTime(), f.getLen())
    names = spark.createDataFrame(list(found.values()), "path string, ms long, length long")

    def read(batches):
        from pyarrow import fs

        for pdf in batches:
            texts = []
            for path in pdf["path"]:
                where, name = (fs.LocalFileSystem(), path.split(":", 1)[1]) if path.startswith("file:") else fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as f:
                    texts.append(f.read())
            yield pdf.assign(content=texts)

    rows = names.mapInPandas(read, "path string, ms long, length long, content binary")
    return rows.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "content")


def scan_project(spark: SparkSession, root: str, targets: Sequence[str] = ("app", "routes"), whitelist: Sequence[str] = (), max_files: int | None = None, max_depth: int | None = None, project_id: str | None = None) -> DataFrame:
    """(FILES, partial) of a project on any file system Spark reads.

    Targets that don't exist are skipped; a target that is a file counts itself.
    ``max_depth`` counts directories below a target, the target's own files being
    at depth 1. Overlapping targets give a file once. Bytes that aren't UTF-8 are
    replaced, and the file is kept.
    """
    base = root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)
    paths = []
    jvm = spark.sparkContext._jvm
    for t in targets:
        p = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{t.strip('/')}" if t not in ("", ".") else base)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            paths.append((t.strip("/"), p.toString()))
    if not paths:
        return spark.createDataFrame([], FILES + ", partial boolean")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][hH][pP]")
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    root_path = "/" + base.split(":", 1)[1].lstrip("/")
    rel = relative_path(plain, root_path)
    # Spark passes over names that begin with a dot or underscore; those files are read beside it.
    seen = [p for _, p in paths if not _hidden_name(p.rstrip("/").rsplit("/", 1)[-1])]
    rows = hidden_files(spark, [p for _, p in paths])
    if seen:
        rows = read.load(seen).select("path", "modificationTime", "length", "content").unionByName(rows)
    rows = rows.withColumn("relative_path", rel)
    if max_depth is not None:
        depth = F.lit(2**30)
        for t, _ in paths:
            below = F.size(F.split("relative_path", "/")) - len([x for x in t.split("/") if x])
            depth = F.least(depth, F.when(F.startswith("relative_path", F.lit(t)), below).otherwise(2**30))
        rows = rows.where(depth <= max_depth)
    rows = rows.where(kept_vendor(F.col("relative_path"), whitelist)).dropDuplicates(["relative_path"])
    files = rows.select(
        F.lit(project_id or root_path).alias("project_id"),
        "relative_path",
        plain.alias("path"),
        F.decode("content", "UTF-8").alias("source_text"),
        F.unix_millis("modificationTime").alias("modified_ms"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    return limit_files(files, max_files)
