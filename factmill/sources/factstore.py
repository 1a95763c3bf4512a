"""The incremental fact store: facts per file, kept with the state they were made from.

A file's facts are valid while schema version, kind, feature signature, its own
state and the states of all files it depends on are as stored. What isn't valid
is extracted anew; the next version of the store appears by one rename. Stored
class facts come before any global join, which always runs fresh; routes,
channels and the class index are read from the files each time.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.io import materialize
from factmill.operators import extraction as X
from factmill.operators import relational as R
from factmill.operators.incremental import SCHEMA_VERSION, STATE, StateTarget, unheld

DEPENDENCY = "struct<relative_path:string,modified_ms:bigint,size_bytes:bigint,sha256:string>"


def feature_signature(features: dict[str, bool]) -> str:
    return hashlib.sha256(json.dumps(features, separators=(",", ":")).encode()).hexdigest()


def entry_key(signature: Column, path: Column) -> Column:
    return F.sha2(F.concat(signature, F.lit(":"), path), 256)


def current_states(files: DataFrame, kind: str) -> DataFrame:
    """(project_id, relative_path, modified_ms, size_bytes, sha256): what a file is now; kind ``mtime`` has no hash."""
    digest = F.lit(None).cast("string") if kind == "mtime" else F.coalesce("sha256", F.sha2("source_text", 256))
    return files.select("project_id", "relative_path", "modified_ms", "size_bytes", digest.alias("sha256"))


def dependencies(files: DataFrame, methods: DataFrame, models: DataFrame, bindings: DataFrame) -> DataFrame:
    """(project_id, relative_path, dep_path): from imports, parents, routes, resources, requests and relations."""
    index = X.class_index(files)
    of = lambda df, c: df.select("project_id", "relative_path", c.alias("fqcn"))
    uses = [
        of(index, F.explode(F.map_values("imports"))),
        of(index.where(F.col("extends").isNotNull()), F.col("extends")),
        of(bindings, F.col("controller_fqcn")),
        of(methods, F.explode(F.transform("resource_usage", lambda r: r["class_name"]))),
        of(methods, F.explode(F.array_compact(F.transform("request_usage", lambda r: r["class_name"])))),
        of(models, F.explode(F.array_compact(F.transform("relationships", lambda r: r["related"])))),
    ]
    return R.dependency_edges(uses, index)


@dataclass
class Refresh:
    """What a refresh did: the published version, the store's rows and how many files were reused and extracted."""

    version: int
    facts: DataFrame
    hits: int
    misses: int


def refresh(spark: SparkSession, path: str, files: DataFrame, features: dict[str, bool], kind: str = "sha256+mtime") -> Refresh:
    """Bring the store at ``path`` up to ``files`` (with modified_ms and size_bytes) and publish the next version.

    Only what changed is written; where nothing did, the version stays. Files
    that left are dropped. A run that fails publishes nothing, and one that
    another run overtook raises ``Conflict``.
    """
    key = ["project_id", "relative_path"]
    target = StateTarget(spark, path, key, STATE, dependencies="dependencies")
    signature = feature_signature(features)
    states = materialize(current_states(files, kind), "states")
    before = target.current()
    if before is not None:
        # facts of another schema, kind or signature are as good as none
        same = (F.col("schema_version") == SCHEMA_VERSION) & (F.col("kind") == kind) & (F.col("signature") == signature)
        held = unheld(states, target.held(states, before).where(same), key, STATE)
    stale = materialize(states if before is None else held, "stale")
    todo = files.join(stale.select("project_id", "relative_path"), ["project_id", "relative_path"], "left_semi")
    full = X.classes_with_methods(todo)
    blocks = full.groupBy("project_id", "relative_path").agg(
        F.array_sort(F.collect_list(F.struct("class_pos", "namespace", F.map_entries("imports").alias("imports"), "class_name", "fqcn", "class_text", "methods"))).alias("classes")
    )
    # Which class lives in which file is asked of all files: a new file may be what an old one imports.
    edges = dependencies(files, X.controller_methods(full, features), X.models(full, features), X.route_bindings(todo))
    edges = edges.join(stale.select("project_id", "relative_path"), ["project_id", "relative_path"], "left_semi")
    at = states.select("project_id", F.col("relative_path").alias("dep_path"), *STATE)
    deps = edges.join(at, ["project_id", "dep_path"]).groupBy("project_id", "relative_path").agg(
        F.array_sort(F.collect_list(F.struct(F.col("dep_path").alias("relative_path"), *STATE))).alias("dependencies")
    )
    none = F.array().cast(f"array<{DEPENDENCY}>")
    made = stale.join(blocks, ["project_id", "relative_path"], "left").join(deps, ["project_id", "relative_path"], "left")
    made = made.select(
        "project_id", "relative_path", *STATE, F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(kind).alias("kind"), F.lit(signature).alias("signature"),
        F.coalesce("dependencies", none).alias("dependencies"), "classes",
    )
    total, misses = states.count(), stale.count()
    keys = stale.select(*key)
    if before is not None:
        keys = keys.unionByName(target.read(before).select(*key).join(states, key, "left_anti"))
    keys = materialize(keys.distinct(), "spoken")
    version = before
    if before is None or not keys.isEmpty():
        version = target.publish(made, before, keys)
        target.vacuum()
    return Refresh(version, target.read(version), total - misses, misses)


def stored_classes(facts: DataFrame) -> DataFrame:
    """The store's classes in the shape of ``classes_with_methods``."""
    rows = facts.select("project_id", "relative_path", F.explode("classes").alias("c")).select("project_id", "relative_path", "c.*")
    return rows.withColumn("imports", F.map_from_entries("imports"))
