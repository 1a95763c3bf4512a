"""Relational operators with defined order: first seen, first non-null, unique owner, match status and the like.

Order is data here: wherever "first" or "last" counts, an explicit ordinal says
so, and ties of the ordinal are broken by the value itself. Null keys group
together; empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.operators.hierarchy import FRAGMENT_ROWS, ancestor_paths, numbered


def _at(order: Sequence[str]) -> Column:
    return F.struct(*order)


def first_seen_list(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: str, name: str) -> DataFrame:
    """(keys, name): the members of the array column ``values``, each once, in the order in which they were first seen.

    Members are reduced to their first place before anything is collected, so a
    hot key collects its distinct members only. Null members are dropped.
    """
    rows = df.select(*keys, *order, F.posexplode(values).alias("__pos", "__v")).where(F.col("__v").isNotNull())
    firsts = rows.groupBy(*keys, "__v").agg(F.min(F.struct(*order, "__pos")).alias("__o"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]).alias(name))


def sorted_set(df: DataFrame, keys: Sequence[str], value: str | Column, name: str) -> DataFrame:
    """(keys, name): distinct non-null values, sorted."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name))


def first_ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str = "ordinal") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(order).alias(name))


def unique_owner(df: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """(keys, owner, owners): the owner where exactly one is known, else null, with their number. Null owners don't count."""
    n = F.count_distinct(owner)
    return df.groupBy(*keys).agg(F.when(n == 1, F.min(owner)).alias(owner), n.alias("owners"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows that agree in ``keys`` the first; an aggregate, so that repeats go before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _at(order)).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col("__r")[c].alias(c) for c in df.columns])


def drop_consecutive(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Rows whose ``same`` columns differ from the row before them; equal rows further apart stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__n", F.row_number().over(w)).withColumn("__b", F.lag(F.struct(*same)).over(w))
    return marked.where((F.col("__n") == 1) | ~F.struct(*same).eqNullSafe(F.col("__b"))).drop("__n", "__b")


def last_wins(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value): the last value of every key."""
    return df.groupBy(*keys).agg(F.max_by(value, _at(order)).alias(value))


def merge_first_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], unions: Sequence[str] = ()) -> DataFrame:
    """(keys, columns, unions): each column's first non-null value in order; array columns of ``unions`` as sorted sets."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), _at(order))).alias(c) for c in columns]
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions]
    return df.groupBy(*keys).agg(*firsts, *sets)


def merged_kind(kind: str, order: Sequence[str]) -> Column:
    """The first kind, but ``collection`` where ``array`` came first and a later row says collection."""
    first = F.min_by(kind, F.when(F.col(kind).isNotNull(), _at(order)))
    return F.when((first == "array") & F.bool_or(F.coalesce(F.col(kind) == "collection", F.lit(False))), "collection").otherwise(first)


# Fixed values of the match of runtime routes with static actions.
KINDS = ("controller_method", "invokable_controller")


def match_status(kind: Column, matched: Column) -> Column:
    return F.when(kind == "closure", "runtime_only").when(~kind.isin(*KINDS), "unsupported").when(matched, "matched").otherwise("missing_static")


def match_reason(status: Column) -> Column:
    return F.when(status == "runtime_only", "closure_action").when(status == "unsupported", "unknown_action").when(status == "missing_static", "missing_static_action")


def match_routes(routes: DataFrame, actions: DataFrame, kind: str = "action_kind", key: str = "action_key") -> DataFrame:
    """``routes`` with match_status and reason_code: a left join on the action's key, nothing lost and nothing multiplied."""
    known = actions.select(F.col(key).alias("__k")).distinct()
    joined = routes.join(known, F.col(key) == F.col("__k"), "left")
    status = match_status(F.coalesce(F.col(kind), F.lit("")), F.col("__k").isNotNull())
    return joined.withColumn("match_status", status).withColumn("reason_code", match_reason(status)).drop("__k")


def dependency_edges(uses: Sequence[DataFrame], owners: DataFrame) -> DataFrame:
    """(project_id, relative_path, dep_path): what files use, resolved to the files that declare it, without themselves.

    Every member of ``uses`` is (project_id, relative_path, fqcn); ``owners`` is
    the same for declarations.
    """
    used = uses[0].select("project_id", "relative_path", "fqcn")
    for more in uses[1:]:
        used = used.unionByName(more.select("project_id", "relative_path", "fqcn"))
    files = owners.select("project_id", "fqcn", F.col("relative_path").alias("dep_path")).distinct()
    return used.distinct().join(files, ["project_id", "fqcn"]).where(F.col("dep_path") != F.col("relative_path")).select("project_id", "relative_path", "dep_path").distinct()


def ancestry(classes: DataFrame) -> DataFrame:
    """(project_id, fqcn, base): every class with itself's and all its ancestors' ``extends``, loops ending where they close.

    ``classes`` is (project_id, fqcn, extends), one row per class. A class is a
    subclass of whatever base it is listed with, known or not. Sides with a row per
    class are merged, as in ``resolve_forest``.
    """
    ids = numbered(classes.select("project_id", "fqcn", "extends"))
    up = ids.select(F.col("project_id").alias("__p"), F.col("fqcn").alias("__f"), F.col("id").alias("parent")).hint("merge")
    linked = ids.join(up, (F.col("project_id") == F.col("__p")) & (F.col("extends") == F.col("__f")), "left")
    # On loops, and below them, every class of the loop is an ancestor.
    tree = ancestor_paths(linked.select("id", "parent", F.xxhash64("project_id").alias("local")), FRAGMENT_ROWS)
    at = ids.select(F.col("id").alias("__i"), F.col("extends").alias("base")).where(F.col("base").isNotNull()).hint("merge")
    bases = tree.select("id", F.explode("path").alias("__i")).join(at, "__i").select("id", "base").hint("merge")
    return ids.select("project_id", "fqcn", "id").join(bases, "id").select("project_id", "fqcn", "base").distinct()


def descending(bases: DataFrame, base: str) -> DataFrame:
    """(project_id, fqcn) of the classes that an ``ancestry`` lists with ``base``."""
    return bases.where(F.col("base") == base).select("project_id", "fqcn")


def subclasses(classes: DataFrame, base: str) -> DataFrame:
    """(project_id, fqcn) of classes that descend from ``base``; terminates on loops of any length."""
    return descending(ancestry(classes), base)
