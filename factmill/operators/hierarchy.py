"""Parent-child links to full hierarchies by fragment contraction.

Rows are put into fragments of bounded size. Each fragment follows its own
parent chains to where they end (a root, a loop) or leave it (an exit). The
nodes other fragments exit to form a smaller forest with weighted links, which
is solved the same way, with fragments of the same size; its answers are then
joined back to extend every fragment-local answer. Fragments follow chains
upward, so every level leaves about half of the nodes of even one long chain.
Sides with a row per node are merged, never broadcast: ids are written in a
small part of the memory they take, and Spark plans by what is written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.names import php_name
from factmill.io import materialize, table

FRAGMENT_ROWS = 50_000  # rows of a fragment at most, where there are enough for every task
LEAST_ROWS = 64  # and at least
CENTRES = 3  # one node in so many is a centre

_SHAPE = "id bigint, local bigint, exit bigint, dist bigint, low bigint, root bigint, depth bigint, seg array<bigint>"


def _contract(pdf: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    """Follow the chains inside one fragment; of each node its end, or its exit."""
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    ids = pdf["id"].to_numpy(np.int64)
    n = len(ids)
    has = pdf["has"].to_numpy(bool)
    parent = pdf["parent"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, parent), n - 1)
    inside = has & (ids[at] == parent)
    step = np.where(inside, at, np.arange(n))
    first = step.copy()
    dist = np.where(inside, pdf["dist"].to_numpy(np.int64), 0)
    low = pdf["low"].to_numpy(np.int64)
    for _ in range(max(1, int(n).bit_length())):  # after 2^k >= n links every chain has ended or loops
        dist, low, step = dist + dist[step], np.minimum(low, low[step]), step[step]
    ends, loops = ~inside[step], inside[step]
    leaves = ends & has[step]
    own_root = pdf["root"].to_numpy(np.int64)
    own_depth = pdf["depth"].to_numpy(np.int64)
    root = np.where(loops, low[step], own_root[step])
    depth = np.where(loops | (own_depth[step] < 0), -1, own_depth[step] + dist)
    seg = None
    if with_path:
        seg = [None] * n
        own = pdf["seg"].tolist()
        for i in np.argsort(dist, kind="stable"):
            # a link of a contracted level carries the nodes between its ends; what leads to a loop has no path
            above = [] if not inside[i] else seg[first[i]]
            if not loops[i] and own[i] is not None and above is not None:
                seg[i] = above + list(own[i])
    return pd.DataFrame(
        {
            "id": ids,
            "local": pdf["local"],
            "exit": pd.array([int(p) if x else None for p, x in zip(parent[step], leaves)], "Int64"),
            "dist": dist + np.where(leaves, pdf["dist"].to_numpy(np.int64)[step], 0),
            "low": low,
            "root": pd.array([None if x else int(r) for r, x in zip(root, leaves)], "Int64"),
            "depth": pd.array([None if x else int(d) for d, x in zip(depth, leaves)], "Int64"),
            "seg": seg,
        }
    )


def _is_centre(node: str, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(CENTRES)) == 0


def _clusters(links: DataFrame, level: int) -> DataFrame:
    """(id, centre): the nearest node up the chain, at most four links away, that this level's hash makes a centre; else the node itself.

    The window of links that a node knows is doubled by a join with itself. About
    half of the nodes of any chain lie under the same centre as the node below
    them, and contract; the next level's hash makes other centres.
    """
    near = links.select("id", F.when(_is_centre("id", level), F.col("id")).when(_is_centre("parent", level), F.col("parent")).alias("centre"), F.col("parent").alias("up"))
    for _ in range(2):
        above = near.select(F.col("id").alias("__a"), F.col("centre").alias("__c"), F.col("up").alias("__u")).hint("merge")
        near = near.join(above, F.col("up") == F.col("__a"), "left").select("id", F.coalesce("centre", "__c").alias("centre"), F.col("__u").alias("up"))
    return near.select("id", F.coalesce("centre", "id").alias("centre"))


def _fragments(links: DataFrame, size: int | None, level: int) -> tuple[DataFrame, int]:
    """``links`` with a fragment number, and the fragments' size, which all levels share.

    Localities of at most ``size`` rows stay whole. Larger ones are cut into the
    clusters of this level's centres, and clusters over ``size`` by hash of the node.
    """
    counts = links.groupBy("local").count()
    n, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if size is None:
        tasks = links.sparkSession.sparkContext.defaultParallelism
        size = max(LEAST_ROWS, min(FRAGMENT_ROWS, -(-n // (4 * tasks))))
    number = F.lit(2 * n // size + 1)
    whole = F.pmod(F.xxhash64("local"), number)
    if most <= size:
        return links.withColumn("frag", whole), size
    # At most n / size localities are large, and as many clusters; that bounds what is broadcast.
    large = F.broadcast(counts.where(F.col("count") > size).select("local"))
    cut = links.join(large, "local", "left_semi")
    near = materialize(_clusters(cut, level), f"clusters{level}")
    bushy = F.broadcast(near.groupBy("centre").count().where(F.col("count") > size))
    salt = F.coalesce(F.pmod(F.xxhash64("id", F.lit(-1)), F.ceil(F.col("count") / size)), F.lit(0))
    near = near.join(bushy, "centre", "left").select(F.col("id").alias("__i"), F.pmod(F.xxhash64("centre", salt), number).alias("frag"))
    cut = cut.join(near.hint("merge"), F.col("id") == F.col("__i")).drop("__i")
    return links.join(large, "local", "left_anti").withColumn("frag", whole).unionByName(cut), size


def _solve(links: DataFrame, size: int | None, with_path: bool, level: int) -> DataFrame:
    cut, size = _fragments(links, size, level)
    # pandas would turn a bigint column with nulls into floats
    none = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("parent", "root", "depth")}
    cut = cut.withColumn("has", F.col("parent").isNotNull()).withColumns(none)
    parts = cut.groupBy("frag").applyInPandas(lambda pdf: _contract(pdf, with_path), _SHAPE)
    local = materialize(parts, f"fragments{level}")
    done = local.where(F.col("exit").isNull()).select("id", "root", "depth", "seg")
    exits = local.where(F.col("exit").isNotNull())
    if exits.isEmpty():
        return done
    heads = exits.select(F.col("exit").alias("id")).distinct().hint("merge")
    # Solved heads are ends of the smaller forest, the others keep their weighted link.
    smaller = local.join(heads, "id", "left_semi").select(F.col("id"), "local", F.col("exit").alias("parent"), "dist", "low", "root", "depth", "seg")
    above = _solve(materialize(smaller, f"quotient{level}"), size, with_path, level + 1)
    above = above.select(F.col("id").alias("exit"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("seg").alias("s")).hint("merge")
    joined = exits.join(above, "exit").select(
        "id", F.col("r").alias("root"), F.when(F.col("d") < 0, F.lit(-1).cast("bigint")).otherwise(F.col("d") + F.col("dist")).alias("depth"), F.concat("s", "seg").alias("seg")
    )
    return done.unionByName(joined)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a unique bigint ``id``, which stays the same as the rows are written once."""
    return materialize(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")


def resolve_forest(links: DataFrame, fragment_rows: int | None = None, with_path: bool = False) -> DataFrame:
    """(id, root, depth[, path]) of every node of ``links`` (id, parent, local).

    ``id`` is a unique bigint, ``parent`` an id or null, ``local`` any bigint
    whose equality hints at nearness (nodes of one tree mostly share it). Where
    climbing never ends, depth is -1, root the smallest id on the loop reached
    and path null; otherwise path runs from the root down to the node. A parent
    that is no node ends the chain as if it were null. An empty table gives an
    empty one. ``fragment_rows`` is the size of the fragments on all levels;
    by default there are four for every task, of ``FRAGMENT_ROWS`` at most.
    """
    known = links.select(F.col("id").alias("__i")).hint("merge")
    rows = links.select("id", F.coalesce(F.col("local").cast("bigint"), F.lit(0)).alias("local"), "parent").join(known, F.col("parent") == F.col("__i"), "left").select(
        "id",
        "local",
        F.col("__i").alias("parent"),
        F.lit(1).cast("bigint").alias("dist"),
        F.col("id").alias("low"),
        F.when(F.col("__i").isNull(), F.col("id")).alias("root"),
        F.when(F.col("__i").isNull(), F.lit(0)).cast("bigint").alias("depth"),
        F.array("id").alias("seg") if with_path else F.lit(None).cast("array<bigint>").alias("seg"),
    )
    solved = _solve(materialize(rows, "forest_links"), fragment_rows, with_path, 0)
    return solved.withColumnRenamed("seg", "path") if with_path else solved.drop("seg")


def loop_paths(links: DataFrame, tree: DataFrame, fragment_rows: int | None = None) -> DataFrame:
    """(id, root, depth, path) of the nodes that ``tree``, a ``resolve_forest`` of ``links``, gives depth -1.

    Root and depth are those of ``tree``. The path holds all distinct ancestors,
    the farthest first, and ends with the node: the loop once round, with the
    member that is reached last, then the chain down from it. Of a loop's member
    it is the loop, of a node that names itself only that node.
    """
    bound = tree.where(F.col("depth") < 0).select(F.col("id").alias("__i"), F.col("root").alias("loop")).hint("merge")
    rows = materialize(links.join(bound, F.col("id") == F.col("__i")).select("id", "parent", "local", "loop"), "loop_links")
    if rows.isEmpty():
        return tree.where(F.col("depth") < 0)
    # Without the link up from its smallest member each loop is the tree of what hangs on it.
    heads = F.col("id") == F.col("loop")
    cut = rows.withColumn("parent", F.when(~heads, F.col("parent")))
    down = materialize(resolve_forest(cut, fragment_rows, with_path=True), "loop_trees")
    # The smallest member's parent is the loop's last one; its path is the whole loop.
    last = rows.where(heads).select(F.col("parent").alias("id"))
    loops = down.join(last, "id", "left_semi").select("root", F.col("path").alias("loop"))
    # A path runs along the loop and leaves it for good: what they have in common is where.
    shared = F.size(F.array_intersect("path", "loop"))
    whole = F.concat(F.slice("loop", shared + 1, F.size("loop")), "path")
    return down.join(loops, "root").select("id", "root", F.lit(-1).cast("bigint").alias("depth"), whole.alias("path"))


def ancestor_paths(links: DataFrame, fragment_rows: int | None = None) -> DataFrame:
    """``resolve_forest`` with paths for all nodes, those of ``loop_paths`` on and below loops."""
    tree = materialize(resolve_forest(links, fragment_rows, with_path=True), "forest")
    return tree.where(F.col("depth") >= 0).unionByName(loop_paths(links, tree, fragment_rows))


def class_links(classes: DataFrame) -> DataFrame:
    """(class_id, parent_id, project_id, fqcn): each class's latest scan with its parent class of the same project.

    Names compare as PHP does. Of equal scan times the greater class_id, then
    the greater spelling holds. Rows without project or fqcn are no class.
    """
    key = php_name("fqcn")
    rows = classes.where(F.col("project_id").isNotNull() & F.col("fqcn").isNotNull() & F.col("class_id").isNotNull())
    last = rows.groupBy("project_id", key.alias("name")).agg(
        F.max_by(F.struct("class_id", "fqcn", "extends"), F.struct("scanned_at", "class_id", "extends")).alias("c")
    )
    last = last.select("project_id", "name", "c.class_id", F.col("c.fqcn").alias("fqcn"), php_name("c.extends").alias("up"))
    up = last.select(F.col("project_id").alias("__p"), F.col("name").alias("__n"), F.col("class_id").alias("parent_id"))
    linked = last.join(up, (F.col("project_id") == F.col("__p")) & (F.col("up") == F.col("__n")), "left")
    return linked.select("class_id", "parent_id", "project_id", "fqcn")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(class_links(table(spark, sf_dir, "classes")), "class_links")


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("class_id").alias("id"), F.col("parent_id").alias("parent"), F.xxhash64("project_id").alias("local"))


def _forest(links: DataFrame, **how) -> DataFrame:
    return resolve_forest(_nodes(links), **how)


def p2_found(spark: SparkSession, sf_dir: str, fragment_rows: int | None = None) -> DataFrame:
    links = _links(spark, sf_dir)
    child = links.where(F.col("parent_id").isNotNull()).select(F.col("class_id").alias("id"))
    found = _forest(links, fragment_rows=fragment_rows).join(child, "id", "left_semi")
    return found.select(F.col("id").alias("class_id"), F.col("root").alias("root_id"), "depth")


def _paths(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("id").alias("class_id"), F.col("root").alias("root_id"), "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p2_paths(spark: SparkSession, sf_dir: str, fragment_rows: int | None = None) -> DataFrame:
    """(class_id, root_id, depth, path): every class whose climbing ends with its path of ids from the root, joined by ``/``.

    Classes on and below loops have no row here; ``p2_all_paths`` has them too.
    """
    return _paths(_forest(_links(spark, sf_dir), fragment_rows=fragment_rows, with_path=True).where(F.col("depth") >= 0))


def p2_all_paths(spark: SparkSession, sf_dir: str, fragment_rows: int | None = None) -> DataFrame:
    """``p2_paths`` of all classes: on and below loops with root_id and depth of ``p2_found`` and the path of ``loop_paths``."""
    return _paths(ancestor_paths(_nodes(_links(spark, sf_dir)), fragment_rows))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all nodes of ``tree`` that have a path: one row per pair, the node itself left out.

    Of ``resolve_forest(..., with_path=True)`` these are the nodes whose
    climbing ends, of ``ancestor_paths`` all.
    """
    length = F.size("path") - 1
    up = tree.where(length > 0).select("id", length.cast("bigint").alias("n"), F.posexplode("path").alias("pos", "ancestor")).where(F.col("pos") < F.col("n"))
    return up.select("ancestor", F.col("id").alias("descendant"), (F.col("n") - F.col("pos")).alias("distance"))


def _descendants(tree: DataFrame) -> DataFrame:
    return descendants(tree).select(F.col("ancestor").alias("class_id"), F.col("descendant").alias("descendant_id"), "distance")


def p2_descendants(spark: SparkSession, sf_dir: str, fragment_rows: int | None = None) -> DataFrame:
    """(class_id, descendant_id, distance): the pairs of classes whose climbing ends.

    Pairs on and below loops have no row here; ``p2_all_descendants`` has them too.
    """
    return _descendants(_forest(_links(spark, sf_dir), fragment_rows=fragment_rows, with_path=True))


def p2_all_descendants(spark: SparkSession, sf_dir: str, fragment_rows: int | None = None) -> DataFrame:
    """(class_id, descendant_id, distance): all descendants of every class, also on and below loops.

    On a loop every other member is a descendant; distance is the least number of links.
    """
    return _descendants(ancestor_paths(_nodes(_links(spark, sf_dir)), fragment_rows))


_CLASS_SQL = r"""
WITH RECURSIVE c AS (
  SELECT project_id, lower(regexp_replace(trim(fqcn, ' ' || chr(9) || chr(10) || chr(13)), '^\\', '')) AS name, arg_max(class_id, scanned_at) AS class_id,
         arg_max(coalesce(lower(regexp_replace(trim(extends, ' ' || chr(9) || chr(10) || chr(13)), '^\\', '')), ''), scanned_at) AS up
  FROM classes GROUP BY 1, 2),
l AS (SELECT c.class_id, p.class_id AS parent_id FROM c LEFT JOIN c p ON p.project_id = c.project_id AND p.name = c.up),
t AS (SELECT class_id, class_id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(class_id AS VARCHAR) AS path FROM l WHERE parent_id IS NULL
      UNION ALL SELECT l.class_id, t.root_id, t.depth + 1, t.path || '/' || l.class_id FROM l JOIN t ON l.parent_id = t.class_id)
"""

P2_FOUND_SQL = (
    _CLASS_SQL
    + """,
cyc AS (SELECT class_id FROM l WHERE class_id NOT IN (SELECT class_id FROM t)),
climb AS (SELECT class_id, class_id AS cur FROM cyc UNION SELECT climb.class_id, l.parent_id FROM climb JOIN l ON l.class_id = climb.cur),
onloop AS (SELECT DISTINCT a.class_id FROM climb a JOIN l ON l.class_id = a.cur AND l.parent_id = a.class_id)
SELECT class_id, root_id, depth FROM t WHERE depth > 0
UNION ALL
SELECT class_id, min(cur) AS root_id, CAST(-1 AS BIGINT) AS depth FROM climb WHERE cur IN (SELECT class_id FROM onloop) GROUP BY class_id
"""
)
P2_PATHS_SQL = _CLASS_SQL + "SELECT class_id, root_id, depth, path FROM t"
P2_DESCENDANTS_SQL = (
    _CLASS_SQL
    + """, a AS (SELECT class_id AS descendant_id, parent_id AS class_id, CAST(1 AS BIGINT) AS distance FROM l WHERE parent_id IS NOT NULL AND class_id IN (SELECT class_id FROM t)
      UNION ALL SELECT a.descendant_id, l.parent_id, a.distance + 1 FROM a JOIN l ON l.class_id = a.class_id WHERE l.parent_id IS NOT NULL)
SELECT class_id, descendant_id, distance FROM a
"""
)
# Climbing that stops before a class comes again; of each class the longest climb is its path.
_CLIMB_SQL = (
    _CLASS_SQL
    + """, u AS (SELECT class_id, class_id AS cur, [class_id] AS path FROM l
      UNION ALL SELECT u.class_id, l.parent_id, list_prepend(l.parent_id, u.path) FROM u JOIN l ON l.class_id = u.cur
      WHERE l.parent_id IS NOT NULL AND NOT list_contains(u.path, l.parent_id)),
w AS (SELECT class_id, arg_max(path, len(path)) AS path FROM u GROUP BY class_id)
"""
)
P2_ALL_PATHS_SQL = (
    _CLIMB_SQL
    + """,
onloop AS (SELECT DISTINCT u.class_id FROM u JOIN l ON l.class_id = u.cur AND l.parent_id = u.class_id)
SELECT class_id, root_id, depth, path FROM t
UNION ALL
SELECT w.class_id, o.root_id, CAST(-1 AS BIGINT), array_to_string(w.path, '/')
FROM w JOIN (SELECT class_id, min(cur) AS root_id FROM u WHERE cur IN (SELECT class_id FROM onloop) GROUP BY class_id) o USING (class_id)
"""
)
P2_ALL_DESCENDANTS_SQL = _CLIMB_SQL + "SELECT cur AS class_id, class_id AS descendant_id, CAST(len(path) - 1 AS BIGINT) AS distance FROM u WHERE cur <> class_id"
