"""Deeply nested records to related flat tables.

Each record is read into path-value-ordinal triples. A path is grouped by its
repeated ancestors (the arrays, or objects keyed by name, it passes through);
every group becomes one table whose rows carry the ancestor's path and the
ordinals of all repeated ancestors, which link them to their parents' rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.jsonstream import Empty, tree
from factmill.io import materialize, table

TRIPLES = "record_id bigint, version bigint, path string, ordinals array<bigint>, value string, is_text boolean"
LINK = ["record_id", "version", "path", "ordinals"]
_SPECIAL = re.compile(r"[\\.\[\]{}@]")


def _step(key: str) -> str:
    """A key as a step of a path, its special characters behind a backslash."""
    return _SPECIAL.sub(r"\\\g<0>", key) if _SPECIAL.search(key) else key


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return v.kind if isinstance(v, Empty) else repr(v) if isinstance(v, float) else str(v)


def record_triples(text: str | None, keyed: dict[str, tuple[str, frozenset[str]]] | None = None) -> list[tuple[str, tuple, object]]:
    """(path, ordinals, value) of every leaf of a record.

    A path is its keys joined by dots, ``[]`` for the members of an array; their
    places are the ordinals. ``keyed`` maps keys to the key that names a member
    and those that tell one. An object under such a key that holds none of these
    is keyed by name: its members are ``{}``, places count as in an array. Each
    member, of an array or alone too, has its name as the leaf ``@key``, null if
    it has none.
    """
    out: list[tuple[str, tuple, object]] = []
    found, root = tree(text) if text is not None else (False, None)
    if not found:
        return out
    # A node is [node above, step, ordinal, path, ordinals]; the latter two are filled in where a leaf hangs on it.
    if type(root) is not dict and type(root) is not list:
        return [("", (), root)]
    todo: list[tuple[list, object, tuple | None]] = [([None, "", None, "", ()], root, None)]
    while todo:
        node, v, marks = todo.pop()
        if not v:
            out.append((*_place_of(node), Empty("{}" if type(v) is dict else "[]")))
        elif type(v) is list:
            lead = None
            for i, x in enumerate(v):
                if type(x) is dict or type(x) is list:
                    below = [node, "[]", i, None, None]
                    todo.append((below, x, None))
                    if marks is not None and type(x) is dict:
                        out.append(_named(below, x.get(marks[0])))
                else:
                    if lead is None:
                        path, at = _place_of(node)
                        lead = path + ".[]" if path else "[]"
                    out.append((lead, (*at, i), x))
        elif marks is not None and not any(k in marks[1] for k in v):
            path, at = _place_of(node)
            lead = path + ".{}" if path else "{}"
            for i, (k, x) in enumerate(v.items()):
                out.append((lead + ".@key", (*at, i), k))
                if type(x) is dict or type(x) is list:
                    todo.append(([node, "{}", i, None, None], x, None))
                else:
                    out.append((lead, (*at, i), x))
        else:
            if marks is not None:
                out.append(_named(node, v.get(marks[0])))
            lead = None
            for k, x in v.items():
                if type(x) is dict or type(x) is list:
                    todo.append(([node, _step(k), None, None, None], x, keyed.get(k) if keyed else None))
                else:
                    if lead is None:
                        path, at = _place_of(node)
                        lead = path + "." if path else ""
                    out.append((lead + _step(k), at, x))
    return out


def _named(node: list, name: object) -> tuple[str, tuple, object]:
    path, at = _place_of(node)
    return path + ".@key", at, name if type(name) is str else None


def _place_of(node: list) -> tuple[str, tuple]:
    """(path, ordinals) of a node, put together from the nodes above it only now."""
    if node[3] is None:
        chain, up = [node], node[0]
        while up[3] is None:
            chain.append(up)
            up = up[0]
        chain.reverse()
        node[3] = ".".join([up[3], *[n[1] for n in chain]] if up[3] else [n[1] for n in chain])
        node[4] = (*up[4], *[n[2] for n in chain if n[2] is not None])
    return node[3], node[4]


def triples(records: DataFrame, id_column: str, text_column: str, keyed: dict[str, tuple[str, Iterable[str]]] | None = None) -> DataFrame:
    """(record_id, version, path, ordinals, value, is_text) of every leaf of every record, see ``record_triples``.

    Values are JSON texts without quotes; ``is_text`` tells strings from others.
    A string that itself holds an object or array is read in its place. The
    version is a hash of the text: texts that share an id stay apart; rows that
    repeat count once. Null texts, texts that aren't whole JSON and records
    without id give no triples.
    """
    marks = {k: (name, frozenset(v)) for k, (name, v) in (keyed or {}).items()}

    def run(batches):
        for batch in batches:
            ids, versions, texts = (batch.column(i).to_pylist() for i in range(3))
            many: list[int] = []
            paths: list[str] = []
            flat: list[int] = []
            ends = [0]
            values: list[str | None] = []
            strings: list[bool] = []
            for t in texts:
                rows = record_triples(t, marks)
                many.append(len(rows))
                for p, o, v in rows:
                    paths.append(p)
                    flat += o
                    ends.append(len(flat))
                    values.append(v if type(v) is str else _text(v))
                    strings.append(type(v) is str)
            each = pa.array([i for i, n in enumerate(many) for _ in range(n)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), batch.column(1).take(each), pa.array(paths, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), pa.array(values, pa.string()), pa.array(strings)],
                names=[c.split()[0] for c in TRIPLES.split(", ")],
            )

    # Repeats fall together by a hash of the text; the text itself is not a sort key.
    rows = records.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    once = rows.groupBy("id", F.xxhash64("text").alias("version"), F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"))
    return once.select("id", "version", "text").mapInArrow(run, TRIPLES)


def places(path: Column) -> Column:
    """Number of ordinals that belong to a path."""
    return F.size(F.split(path, r"\[\]|\{\}")) - 1


def path_table(found: DataFrame) -> DataFrame:
    """(path): the distinct paths, written once. Patterns run over these; Spark broadcasts them where they are few."""
    return materialize(found.select("path").distinct(), "paths")


def pivot_group(found: DataFrame, ancestor: str, columns: dict[str, str | Sequence[str]], above: dict[str, str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """One flat table: the leaves below a repeated ancestor, one row per record, ancestor and place.

    ``ancestor`` is a regular expression of the ancestors' paths, ``columns`` maps
    column names to the member's path below them or to several ones, the first
    that is there holding; of an empty path the value is the ancestor itself.
    ``LINK`` names a row; for every name in ``above``, a pattern of the paths of a
    table above, ``<name>_path`` and ``<name>_ordinals`` name the row there.
    ``paths`` is the ``path_table``, if it is at hand.
    """
    names = {c: [p] if isinstance(p, str) else list(p) for c, p in columns.items()}
    members = sorted({re.escape(p) for ps in names.values() for p in ps if p}, key=len, reverse=True)
    bare = any(p == "" for ps in names.values() for p in ps)
    tail = (r"(?:\.(" + "|".join(members) + "))" if members else "()") + ("?" if bare else "")
    whole = rf"^({ancestor}){tail}$"
    above = above or {}
    shapes = (path_table(found) if paths is None else paths).where(F.col("path").rlike(whole))
    shapes = shapes.select("path", F.regexp_extract("path", whole, 1).alias("__a"), F.regexp_extract("path", whole, re.compile(whole).groups).alias("__m"))
    up = {n: F.regexp_extract("__a", rf"^({p})(?:\.|$)", 1) for n, p in above.items()}
    shapes = shapes.withColumns({f"{n}_path": c for n, c in up.items()}).withColumns({"__n": places(F.col("__a"))} | {f"__n_{n}": places(F.col(f"{n}_path")) for n in above})
    rows = found.join(shapes, "path")
    link = {"path": F.col("__a"), "ordinals": F.slice("ordinals", 1, F.col("__n"))}
    up_links = [c for n in above for c in (F.col(f"{n}_path"), F.slice("ordinals", 1, F.col(f"__n_{n}")).alias(f"{n}_ordinals"))]
    rows = rows.select("record_id", "version", *[c.alias(n) for n, c in link.items()], *up_links, "__m", "value")
    if [len(ps) for ps in names.values()] == [1]:  # every leaf is a row already
        return rows.drop("__m").withColumnRenamed("value", next(iter(names)))
    value = [F.coalesce(*[F.max(F.when(F.col("__m") == p, F.col("value"))) for p in ps]).alias(c) for c, ps in names.items()]
    return rows.groupBy(*[c for c in rows.columns if c not in ("__m", "value")]).agg(*value)


# Keys of the usage lists of a method, by kind.
REQUEST, SCOPE, RESOURCE = ("requestUsage", "request_usage"), ("scopesUsed", "scopes_used"), ("resourceUsage", "resource_usage")
KEYED = {"methods": ("name", frozenset((*REQUEST, *SCOPE, *RESOURCE, "name")))}
_ONE = "|".join
# The last `controllers` above a method is its controller's; lists may stand alone as one member.
CONTROLLER = r"(?:.*\.)?controllers(?:\.\[\])?"
METHOD = CONTROLLER + r"\.methods(?:\.\[\]|\.\{\})?"
USAGE = METHOD + rf"\.(?:{_ONE((*REQUEST, *SCOPE, *RESOURCE))})(?:\.\[\])?"
ITEM = METHOD + rf"\.(?:(?:{_ONE(REQUEST)})(?:\.\[\])?\.rules(?:\.\[\])?|(?:{_ONE(SCOPE)})(?:\.\[\])?(?:\.name)?|(?:{_ONE(RESOURCE)})(?:\.\[\])?\.class)"


def _kind(path: str) -> Column:
    """By the list's key, which ends a usage's path."""
    key = F.regexp_replace(path, r"\.\[\]$", "")
    ends = lambda names: F.substring_index(key, ".", -1).isin(*names)
    return F.when(ends(REQUEST), "rule").when(ends(SCOPE), "scope").otherwise("resource")


def _last(down: str, up: str) -> Column:
    """The last ordinal of a place that has one more than the place above it, else 0."""
    return F.when(F.size(down) > F.size(up), F.element_at(down, -1)).otherwise(0).cast("bigint")


def usage_triples(deltas: DataFrame, id_column: str = "delta_id", text_column: str = "payload") -> DataFrame:
    """The texts, and members' names, among the triples that speak of controllers; written once."""
    found = triples(deltas, id_column, text_column, KEYED).where(F.contains("path", F.lit("controllers")))
    return materialize(found.where(F.col("is_text") | F.endswith("path", F.lit(".@key"))), "usage_triples")


def controller_rows(found: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(LINK, class, file)."""
    return pivot_group(found, CONTROLLER, {"class": "class", "file": "file"}, paths=paths)


def method_rows(found: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(LINK, controller_path, controller_ordinals, name): every method, named by its key or its name."""
    return pivot_group(found, METHOD, {"name": "@key"}, {"controller": CONTROLLER}, paths)


def usage_rows(found: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(LINK, method_path, method_ordinals, kind, usage_pos, method, class, name, location, on): usages that have any text of these."""
    rows = pivot_group(found, USAGE, {"method": "method", "class": "class", "name": ("name", ""), "location": "location", "on": "on"}, {"method": METHOD}, paths)
    return rows.withColumn("kind", _kind("path")).withColumn("usage_pos", _last("ordinals", "method_ordinals"))


def item_rows(found: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(LINK, usage link, method link, kind, usage_pos, item_pos, item): rules, scope names and resource classes."""
    rows = pivot_group(found, ITEM, {"item": ""}, {"usage": USAGE, "method": METHOD}, paths).withColumn("kind", _kind("usage_path"))
    return rows.withColumn("usage_pos", _last("usage_ordinals", "method_ordinals")).withColumn("item_pos", _last("ordinals", "usage_ordinals"))


def _linked(rows: DataFrame, above: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the rows above; the reference stays where there is none."""
    up = above.select(*[F.col(c).alias(f"__{c}") for c in LINK], *[F.col(c).alias(n) for c, n in columns.items()])
    on = (F.col("record_id") == F.col("__record_id")) & (F.col("version") == F.col("__version")) & (F.col(f"{name}_path") == F.col("__path")) & (F.col(f"{name}_ordinals") == F.col("__ordinals"))
    return rows.join(up, on, "left").drop(*[f"__{c}" for c in LINK])


def usages(deltas: DataFrame, id_column: str = "delta_id", text_column: str = "payload") -> DataFrame:
    """(delta_id, controller, method_name, kind, usage_pos, item_pos, item), the items linked to their methods and controllers.

    One row per non-null string among the rules of a requestUsage, the names of
    a scopesUsed and the classes of a resourceUsage of a controller's method.
    Repeated input rows count once; null, empty and broken payloads give nothing;
    a controller without class or a method without name gives a null there.
    """
    found = usage_triples(deltas, id_column, text_column)
    paths = path_table(found)
    classes = pivot_group(found, CONTROLLER, {"class": "class"}, paths=paths)
    methods = _linked(method_rows(found, paths), classes, "controller", {"class": "controller"})
    items = _linked(item_rows(found, paths), methods, "method", {"name": "method_name", "controller": "controller"})
    return items.select(F.col("record_id").alias("delta_id"), "controller", "method_name", "kind", "usage_pos", "item_pos", "item")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usages(table(spark, sf_dir, "analysis_deltas"))


def p4_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, leaves, records): how often each leaf path occurs, over all payloads that are whole JSON."""
    found = triples(table(spark, sf_dir, "analysis_deltas"), "delta_id", "payload")
    return found.groupBy("path").agg(F.count("*").alias("leaves"), F.count_distinct("record_id").alias("records"))


def _place(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ".").alias(c)


def p4_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(delta_id, path, ordinals, class, file)."""
    rows = controller_rows(usage_triples(table(spark, sf_dir, "analysis_deltas")))
    return rows.select(F.col("record_id").alias("delta_id"), "path", _place("ordinals"), "class", "file")


def p4_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(delta_id, path, ordinals, controller_path, controller_ordinals, name)."""
    rows = method_rows(usage_triples(table(spark, sf_dir, "analysis_deltas")))
    return rows.select(F.col("record_id").alias("delta_id"), "path", _place("ordinals"), "controller_path", _place("controller_ordinals"), "name")


def p4_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(delta_id, path, ordinals, method_path, method_ordinals, kind, usage_pos, method, class, name, location, on)."""
    rows = usage_rows(usage_triples(table(spark, sf_dir, "analysis_deltas")))
    return rows.select(F.col("record_id").alias("delta_id"), "path", _place("ordinals"), "method_path", _place("method_ordinals"), "kind", "usage_pos", "method", "class", "name", "location", "on")


# Every node of every payload by recursion, with the path and ordinals that triples have.
_NODES_SQL = r"""
WITH RECURSIVE src AS (SELECT DISTINCT delta_id, payload FROM analysis_deltas WHERE delta_id IS NOT NULL AND json_valid(payload)),
n AS (
  SELECT delta_id, payload, CAST(payload AS JSON) AS v, '' AS path, CAST([] AS BIGINT[]) AS ords, CAST(NULL AS VARCHAR) AS name FROM src
  UNION ALL
  SELECT n.delta_id, n.payload, x.v, CASE WHEN x.step = '' THEN n.path WHEN n.path = '' THEN x.step ELSE n.path || '.' || x.step END,
    CASE WHEN x.ord IS NULL THEN n.ords ELSE list_append(n.ords, x.ord) END, x.name FROM n, LATERAL (
    SELECT CASE WHEN o.keyed THEN '{}' WHEN o.list THEN '[]' ELSE e.key END AS step, CASE WHEN o.keyed THEN list_position(json_keys(n.v), e.key) - 1 WHEN o.list THEN CAST(e.key AS BIGINT) END AS ord,
      CASE WHEN o.keyed THEN e.key END AS name, e.value AS v
    FROM json_each(n.v) e, (SELECT json_type(n.v) = 'ARRAY' AS list, json_type(n.v) = 'OBJECT' AND regexp_matches(n.path, '(^|\.)methods$') AND NOT
      list_has_any(json_keys(n.v), ['requestUsage', 'request_usage', 'scopesUsed', 'scopes_used', 'resourceUsage', 'resource_usage', 'name']) AS keyed) o WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
    UNION ALL
    SELECT '', NULL, n.name, CAST(n.v ->> '$' AS JSON) WHERE json_type(n.v) = 'VARCHAR' AND json_type(CASE WHEN json_valid(n.v ->> '$') THEN n.v ->> '$' END) IN ('OBJECT', 'ARRAY', 'VARCHAR')) x),
t AS (SELECT delta_id, payload, path, ords, v ->> '$' AS s FROM n WHERE json_type(v) = 'VARCHAR' AND path LIKE '%controllers%'),
c AS (SELECT delta_id, payload, regexp_extract(path, '^(.*)\.(class|file)$', 1) AS path, ords, max(s) FILTER (path LIKE '%.class') AS class, max(s) FILTER (path LIKE '%.file') AS file
      FROM t WHERE regexp_matches(path, '(^|\.)controllers(\.\[\])?\.(class|file)$') GROUP BY 1, 2, 3, 4),
m AS (SELECT delta_id, payload, path, ords, max(name) AS name FROM (
        SELECT delta_id, payload, path, ords, name FROM n WHERE name IS NOT NULL
        UNION ALL SELECT delta_id, payload, regexp_extract(path, '^(.*)\.name$', 1), ords, s FROM t WHERE regexp_matches(path, '\.methods(\.\[\])?\.name$'))
      WHERE regexp_matches(path, '(^|\.)controllers(\.\[\])?\.methods(\.\[\]|\.\{\})?$') GROUP BY 1, 2, 3, 4),
i AS (SELECT *, regexp_extract(path, '^((?:.*\.)?controllers(?:\.\[\])?)\.', 1) AS c_path, regexp_extract(path, '^((?:.*\.)?controllers(?:\.\[\])?\.methods(?:\.\[\]|\.\{\})?)\.', 1) AS m_path,
        regexp_extract(path, '^((?:.*\.)?controllers(?:\.\[\])?\.methods(?:\.\[\]|\.\{\})?\.(?:requestUsage|request_usage|scopesUsed|scopes_used|resourceUsage|resource_usage)(?:\.\[\])?)', 1) AS u_path
      FROM t),
k AS (SELECT *, ords[:len(regexp_extract_all(c_path, '\[\]|\{\}'))] AS c_ords, ords[:len(regexp_extract_all(m_path, '\[\]|\{\}'))] AS m_ords, ords[:len(regexp_extract_all(u_path, '\[\]|\{\}'))] AS u_ords,
        CASE WHEN regexp_matches(u_path, '\.request_?[uU]sage(\.\[\])?$') THEN 'rule' WHEN regexp_matches(u_path, '\.scopes_?[uU]sed(\.\[\])?$') THEN 'scope' ELSE 'resource' END AS kind, path[len(u_path) + 1:] AS rest
      FROM i WHERE u_path <> '')
"""
P4_FOUND_SQL = (
    _NODES_SQL
    + r"""SELECT k.delta_id, c.class AS controller, m.name AS method_name, k.kind, CASE WHEN len(u_ords) > len(m_ords) THEN u_ords[-1] ELSE 0 END AS usage_pos, CASE WHEN len(k.ords) > len(u_ords) THEN k.ords[-1] ELSE 0 END AS item_pos, s AS item
FROM k LEFT JOIN c ON c.delta_id = k.delta_id AND c.payload = k.payload AND c.path = k.c_path AND c.ords = k.c_ords
LEFT JOIN m ON m.delta_id = k.delta_id AND m.payload = k.payload AND m.path = k.m_path AND m.ords = k.m_ords
WHERE (kind = 'rule' AND rest IN ('.rules', '.rules.[]')) OR (kind = 'scope' AND rest IN ('', '.name')) OR (kind = 'resource' AND rest = '.class')
"""
)
P4_CONTROLLERS_SQL = _NODES_SQL + "SELECT delta_id, path, array_to_string(ords, '.') AS ordinals, class, file FROM c"
P4_METHODS_SQL = (
    _NODES_SQL
    + r"""SELECT delta_id, path, array_to_string(ords, '.') AS ordinals, c_path AS controller_path, array_to_string(ords[:len(regexp_extract_all(c_path, '\[\]|\{\}'))], '.') AS controller_ordinals, name
FROM (SELECT *, regexp_extract(path, '^((?:.*\.)?controllers(?:\.\[\])?)\.', 1) AS c_path FROM m)"""
)
P4_USAGES_SQL = (
    _NODES_SQL
    + r"""SELECT delta_id, u_path AS path, array_to_string(u_ords, '.') AS ordinals, m_path AS method_path, array_to_string(m_ords, '.') AS method_ordinals, kind,
  CASE WHEN len(u_ords) > len(m_ords) THEN u_ords[-1] ELSE 0 END AS usage_pos, max(s) FILTER (rest = '.method') AS method, max(s) FILTER (rest = '.class') AS class,
  coalesce(max(s) FILTER (rest = '.name'), max(s) FILTER (rest = '')) AS name, max(s) FILTER (rest = '.location') AS location, max(s) FILTER (rest = '.on') AS "on"
FROM k WHERE rest IN ('.method', '.class', '.name', '', '.location', '.on') GROUP BY payload, delta_id, u_path, u_ords, m_path, m_ords, kind"""
)
P4_TRIPLES_SQL = r"""
WITH RECURSIVE n AS (
  SELECT delta_id, CAST(payload AS JSON) AS v, '' AS path FROM (SELECT DISTINCT delta_id, payload FROM analysis_deltas) WHERE json_valid(payload)
  UNION ALL
  SELECT n.delta_id, x.v, CASE WHEN x.step = '' THEN n.path WHEN n.path = '' THEN x.step ELSE n.path || '.' || x.step END FROM n, LATERAL (
    SELECT CASE WHEN json_type(n.v) = 'ARRAY' THEN '[]' ELSE e.key END AS step, e.value AS v FROM json_each(n.v) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
    UNION ALL SELECT '', CAST(n.v ->> '$' AS JSON) WHERE json_type(n.v) = 'VARCHAR' AND json_type(CASE WHEN json_valid(n.v ->> '$') THEN n.v ->> '$' END) IN ('OBJECT', 'ARRAY')) x)
SELECT path, count(*) AS leaves, count(DISTINCT delta_id) AS records FROM n
WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'VARCHAR') OR CAST(v AS VARCHAR) IN ('{}', '[]')
   OR (json_type(v) = 'VARCHAR' AND coalesce(json_type(CASE WHEN json_valid(v ->> '$') THEN v ->> '$' END), '') NOT IN ('OBJECT', 'ARRAY')) GROUP BY path
"""
