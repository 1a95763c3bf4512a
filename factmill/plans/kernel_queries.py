"""Queries that run one operator each over whole tables, with the SQL they are compared with.

Names carry the operator's number in the inventory. Where a table holds PHP text
the extractors run on it; otherwise the text is put together from columns, the
same way in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import php_text as P
from factmill.functions.names import action_key, basename, php_name, qualify
from factmill.io import table
from factmill.operators import extraction as X
from factmill.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _joined(c: Column) -> Column:
    return F.array_join(c, ",")


# -- extractors over the bodies of controller methods


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "controller_methods").select("method_id", "body_text").distinct()


_BODIES = "(SELECT DISTINCT method_id, body_text AS b FROM controller_methods)"


@query(
    rf"""SELECT method_id, coalesce(
  try_cast(nullif(regexp_extract(b, '(?s)response\(\)->json\(.*?,\s*(\d{{3}})\s*\)', 1), '') AS INT), try_cast(nullif(regexp_extract(b, '(?s)response\(.*?,\s*(\d{{3}})\s*\)', 1), '') AS INT),
  try_cast(nullif(regexp_extract(b, 'abort\((\d{{3}})', 1), '') AS INT), try_cast(nullif(regexp_extract(b, 'setStatusCode\((\d{{3}})\)', 1), '') AS INT),
  CASE WHEN contains(b, 'noContent()') THEN 204 END) AS http_status FROM {_BODIES}"""
)
def x5_http_status(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select("method_id", P.http_status(F.col("body_text")).alias("http_status"))


_KEYS = r"""regexp_extract_all(x, '[''"]([^''"]+)[''"]\s*=>', 1)"""
_FIRSTS = "list_filter({0}, lambda y, i: list_position({0}, y) = i)"


@query(
    rf"""WITH c AS (SELECT method_id, unnest(regexp_extract_all(b, 'validate\(\s*\[([^\]]*)\]', 1)) AS x, generate_subscripts(regexp_extract_all(b, 'validate\(\s*\[([^\]]*)\]', 1), 1) AS n FROM {_BODIES}),
k AS (SELECT method_id, n, list_filter({_KEYS}, lambda y: NOT contains(y, '.')) AS l FROM c)
SELECT method_id, n - 1 AS usage_pos, array_to_string({_FIRSTS.format("l")}, ',') AS rules FROM k"""
)
def x6_validate_rules(spark: SparkSession, d: str) -> DataFrame:
    usage = P.request_usage(F.col("body_text"), F.lit(""), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = _bodies(spark, d).select("method_id", F.posexplode(F.filter(usage, lambda u: u["method"] == "validate")).alias("usage_pos", "u"))
    return rows.select("method_id", "usage_pos", _joined(F.col("u.rules")).alias("rules"))


@query(
    rf"""SELECT method_id, coalesce(contains(b, '$request->all()') OR contains(b, '$request->json()'), false) AS whole_body,
  coalesce(array_to_string(list_distinct(regexp_extract_all(b, 'file\(\s*[''"]([^''"]+)[''"]\s*\)', 1)), ','), '') AS files FROM {_BODIES}"""
)
def x6_body_and_files(spark: SparkSession, d: str) -> DataFrame:
    usage = P.request_usage(F.col("body_text"), F.lit(""), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = _bodies(spark, d).select("method_id", usage.alias("u"))
    files = F.flatten(F.transform(F.filter("u", lambda u: u["method"] == "file"), lambda u: u["fields"]))
    return rows.select("method_id", F.exists("u", lambda u: u["method"] == "body").alias("whole_body"), _joined(files).alias("files"))


@query(
    rf"""WITH m AS (SELECT method_id, regexp_extract_all(b, '(?s)new\s+([A-Z][A-Za-z0-9_\\]*(?:Resource|Collection))\(.*?\)\s*->response\(', 1) AS r,
  regexp_extract_all(b, '([A-Z][A-Za-z0-9_\\]*(?:Resource|Collection))::collection\(', 1) AS c, regexp_extract_all(b, '([A-Z][A-Za-z0-9_\\]*(?:Resource|Collection))::make\(', 1) AS k,
  regexp_extract_all(b, 'new\s+([A-Z][A-Za-z0-9_\\]*(?:Resource|Collection))\(', 1) AS n FROM {_BODIES}),
u AS (SELECT method_id, unnest(r) AS class_name, 'response' AS method FROM m UNION SELECT method_id, unnest(c), 'collection' FROM m UNION SELECT method_id, unnest(k), 'make' FROM m
  UNION SELECT method_id, unnest(list_filter(n, lambda x: NOT list_contains(r, x) AND NOT list_contains(c, x))) AS class_name, 'new' FROM m)
SELECT method_id, class_name, CASE WHEN method = 'new' AND class_name LIKE '%Collection' THEN 'collection' ELSE method END AS method FROM u"""
)
def x7_resource_usage(spark: SparkSession, d: str) -> DataFrame:
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = _bodies(spark, d).select("method_id", F.explode(P.resource_usage(F.col("body_text"), F.lit(""), none)).alias("u"))
    return rows.select("method_id", "u.class_name", "u.method")


@query(
    rf"""SELECT DISTINCT method_id, name FROM (SELECT method_id, unnest(regexp_extract_all(b, '(?:->|::)([A-Z]?[a-z][A-Za-z0-9_]*)\(', 1)) AS name FROM {_BODIES})
WHERE name NOT IN ({", ".join(f"'{x}'" for x in P.NO_SCOPES)})"""
)
def x9_scope_calls(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).select("method_id", F.explode(P.scope_calls(F.col("body_text"))).alias("name"))


# -- extractors over source files


def _php(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").where(F.lower("relative_path").endswith(".php") & F.col("source_text").isNotNull())
    return files.select("file_id", "project_id", "relative_path", "source_text").distinct()


_PHP = "(SELECT DISTINCT file_id, project_id, relative_path, source_text AS t FROM source_files WHERE lower(relative_path) LIKE '%.php' AND source_text IS NOT NULL)"


@query(rf"SELECT file_id, trim(regexp_extract(t, '(?m)^\s*namespace\s+([^;]+);', 1)) AS namespace FROM {_PHP}")
def x1_namespace(spark: SparkSession, d: str) -> DataFrame:
    return _php(spark, d).select("file_id", P.namespace(F.col("source_text")).alias("namespace"))


@query(
    rf"""WITH l AS (SELECT file_id, unnest(regexp_extract_all(t, '(?m)^\s*use\s+([^;]+);', 1)) AS u, generate_subscripts(regexp_extract_all(t, '(?m)^\s*use\s+([^;]+);', 1), 1) AS n FROM {_PHP}),
e AS (SELECT file_id, n, CASE WHEN regexp_matches(trim(u), '(?is)^(.*?)\s+as\s+([A-Za-z_][A-Za-z0-9_]*)$') THEN regexp_extract(trim(u), '(?is)^(.*?)\s+as\s+([A-Za-z_][A-Za-z0-9_]*)$', 2)
  ELSE trim(regexp_extract(trim(u), '([^\\]*)$', 1)) END AS alias, ltrim(CASE WHEN regexp_matches(trim(u), '(?is)^(.*?)\s+as\s+([A-Za-z_][A-Za-z0-9_]*)$') THEN trim(regexp_extract(trim(u), '(?is)^(.*?)\s+as\s+([A-Za-z_][A-Za-z0-9_]*)$', 1))
  ELSE trim(u) END, '\') AS fqcn FROM l WHERE NOT contains(u, '{{'))
SELECT file_id, alias, arg_max(fqcn, n) AS fqcn FROM e GROUP BY file_id, alias"""
)
def x2_imports(spark: SparkSession, d: str) -> DataFrame:
    return _php(spark, d).select("file_id", F.explode(P.imports(F.col("source_text"))).alias("alias", "fqcn"))


@query(rf"SELECT file_id, unnest(list_sort(list_distinct(list_transform(regexp_extract_all(t, 'function\s+scope([A-Z][A-Za-z0-9_]*)\(', 1), lambda x: lower(x[1]) || x[2:])))) AS scope FROM {_PHP}")
def x10_model_scopes(spark: SparkSession, d: str) -> DataFrame:
    return _php(spark, d).select("file_id", F.explode(P.model_scopes(F.col("source_text"))).alias("scope"))


@query(
    rf"""SELECT file_id, nullif(regexp_extract(t, '(?m)^\s*(?:final\s+|abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS class_name,
  nullif(regexp_extract(t, '(?m)^\s*(?:final\s+|abstract\s+)?class\s+[A-Za-z_][A-Za-z0-9_]*\s+extends\s+([A-Za-z_\\][A-Za-z0-9_\\]*)', 1), '') AS parent FROM {_PHP}"""
)
def x23_class_header(spark: SparkSession, d: str) -> DataFrame:
    name, parent = P.class_header(F.col("source_text"))
    return _php(spark, d).select("file_id", name.alias("class_name"), parent.alias("parent"))


@query(
    rf"""SELECT file_id, contains(t, 'extends Controller') OR starts_with(relative_path, 'app/Http/Controllers/') OR suffix(trim(regexp_extract(t, '(?m)^\s*namespace\s+([^;]+);', 1)), '\Http\Controllers') AS controller,
  contains(t, 'extends Model') OR starts_with(relative_path, 'app/Models/') OR suffix(trim(regexp_extract(t, '(?m)^\s*namespace\s+([^;]+);', 1)), '\Models') AS model, contains(t, 'abstract class ') AS abstract FROM {_PHP}"""
)
def f1_class_roles(spark: SparkSession, d: str) -> DataFrame:
    t, path = F.col("source_text"), F.col("relative_path")
    rows = _php(spark, d).withColumn("ns", P.namespace(t))
    return rows.select("file_id", P.is_controller(t, path, F.col("ns")).alias("controller"), P.is_model(t, path, F.col("ns")).alias("model"), P.is_abstract(t).alias("abstract"))


@query()
def x4_controller_methods(spark: SparkSession, d: str) -> DataFrame:
    """Actions of all controllers with their facts, from the class splitter."""
    found = X.controller_methods(X.classes_with_methods(X.php_files(table(spark, d, "source_files"))))
    return found.select("project_id", "relative_path", "fqcn", "method_name", "http_status", "request_usage", "resource_usage", "scopes_used")


@query()
def x12_relationships(spark: SparkSession, d: str) -> DataFrame:
    found = X.models(X.classes_with_methods(X.php_files(table(spark, d, "source_files"))))
    return found.select("project_id", "fqcn", F.posexplode("relationships").alias("pos", "r")).select("project_id", "fqcn", "pos", "r.*")


@query()
def s11_class_index(spark: SparkSession, d: str) -> DataFrame:
    return X.class_index(X.php_files(table(spark, d, "source_files"))).drop("source_text", "imports")


# -- routes, put together from nations and suppliers


def _route_text(kind: Column, name: Column, k: Column, aliased: str = "") -> Column:
    return F.concat(F.lit("<?php\nuse App\\Http\\Controllers\\C"), k, F.lit("Controller;\nRoute::"), kind, F.lit("('"), name, F.lit("', C"), k, F.lit("Controller::class);\n"))


@query(
    """SELECT n_nationkey, 'App\\Http\\Controllers\\C' || n_nationkey || 'Controller' AS controller_fqcn, m AS method_name, v AS verb
FROM nation, (VALUES ('index','GET',1),('store','POST',1),('show','GET',1),('update','PUT',1),('update','PATCH',1),('destroy','DELETE',1),('create','GET',0),('edit','GET',0)) AS a(m, v, api)
WHERE n_nationkey % 2 = 1 OR api = 1"""
)
def x18_resource_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    text = _route_text(F.when(F.col("n_nationkey") % 2 == 0, "apiResource").otherwise("resource"), F.lower("n_name"), k)
    rows = table(spark, d, "nation").select("n_nationkey", text.alias("t"))
    rows = rows.select("n_nationkey", F.explode(P.route_bindings(F.col("t"), P.imports(F.col("t"), aliases=False))).alias("b"))
    return rows.select("n_nationkey", "b.controller_fqcn", "b.method_name", F.explode("b.http_methods").alias("verb"))


@query(
    """WITH s AS (SELECT s_suppkey, 'C' || s_suppkey || 'Controller' AS c, (['get','post','any','delete'])[s_suppkey % 4 + 1] AS v FROM supplier),
r AS (SELECT s_suppkey, c, v, CASE WHEN s_suppkey % 3 = 0 THEN '__invoke' ELSE 'run' END AS m FROM s)
SELECT s_suppkey, 'App\\Http\\Controllers\\' || c AS controller_fqcn, m AS method_name, CASE WHEN v = 'any' THEN 'GET,POST,PUT,PATCH,DELETE,OPTIONS' ELSE upper(v) END AS verbs FROM r"""
)
def x19_x20_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    verb = F.element_at(F.array(*map(F.lit, ["get", "post", "any", "delete"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    # a class with a direct route keeps its invokable one out
    c = F.concat(F.lit("C"), k, F.lit("Controller"))
    head = F.concat(F.lit("<?php\nuse App\\Http\\Controllers\\"), c, F.lit(";\n"))
    direct = F.concat(F.lit("Route::"), verb, F.lit("('/a', ["), c, F.lit("::class, 'run']);\n"))
    lone = F.concat(F.lit("Route::"), verb, F.lit("('/b', "), c, F.lit("::class);\n"))
    text = F.concat(head, F.when(F.col("s_suppkey") % 3 != 0, direct).otherwise(""), lone)
    rows = table(spark, d, "supplier").select("s_suppkey", text.alias("t"))
    rows = rows.select("s_suppkey", F.explode(P.route_bindings(F.col("t"), P.imports(F.col("t"), aliases=False))).alias("b"))
    return rows.select("s_suppkey", "b.controller_fqcn", "b.method_name", _joined(F.col("b.http_methods")).alias("verbs"))


@query("""SELECT o_orderkey, n AS name, CASE WHEN n = 'id' THEN 'int' ELSE 'string' END AS parameter_type FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN ['id'] ELSE ['id', 'user' || o_orderstatus] END) AS n FROM orders)""")
def x15_channel_params(spark: SparkSession, d: str) -> DataFrame:
    channel = F.concat(F.lit("orders.{id}."), F.when(F.col("o_orderstatus") == "F", "{id}").otherwise(F.concat(F.lit("{user"), F.col("o_orderstatus"), F.lit("}"))))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(P.channel_parameters(channel)).alias("p"))
    return rows.select("o_orderkey", "p.name", "p.parameter_type")


# -- joins


def _methods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "controller_methods").select("project_id", php_name("fqcn").alias("fqcn"), php_name("method_name").alias("method_name")).distinct()


def _bindings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "route_bindings").distinct()
    method = F.coalesce(F.nullif(php_name("method_name"), F.lit("")), F.lit("__invoke"))
    verbs = F.transform(F.coalesce("http_methods", F.array().cast("array<string>")), lambda v: F.upper(v))
    return rows.select("binding_id", "project_id", "route_file", "ordinal", php_name("controller_fqcn").alias("fqcn"), method.alias("method_name"), verbs.alias("verbs"))


_N = "lower(regexp_replace(trim({}, ' ' || chr(9) || chr(10) || chr(13)), '^\\\\', ''))"
_M = f"(SELECT DISTINCT project_id, {_N.format('fqcn')} AS fqcn, {_N.format('method_name')} AS method_name FROM controller_methods)"
_B = f"""(SELECT binding_id, project_id, route_file, ordinal, {_N.format('controller_fqcn')} AS fqcn, coalesce(nullif({_N.format('method_name')}, ''), '__invoke') AS method_name,
  list_transform(coalesce(http_methods, []), lambda v: upper(v)) AS verbs FROM (SELECT DISTINCT * FROM route_bindings))"""


@query(f"SELECT b.binding_id, m.fqcn, m.method_name FROM {_B} b JOIN {_M} m USING (project_id, fqcn, method_name)")
def j1_routed_methods(spark: SparkSession, d: str) -> DataFrame:
    return _bindings(spark, d).join(_methods(spark, d), ["project_id", "fqcn", "method_name"]).select("binding_id", "fqcn", "method_name")


@query(
    f"""WITH b AS (SELECT binding_id, project_id, fqcn, method_name, CASE WHEN fqcn IS NULL THEN 'closure' WHEN binding_id % 97 = 0 THEN 'view' WHEN method_name = '__invoke' THEN 'invokable_controller' ELSE 'controller_method' END AS k FROM {_B}),
j AS (SELECT b.*, CASE WHEN k = 'closure' THEN 'runtime_only' WHEN k = 'view' THEN 'unsupported' WHEN m.fqcn IS NOT NULL THEN 'matched' ELSE 'missing_static' END AS s FROM b LEFT JOIN {_M} m ON m.project_id = b.project_id AND m.fqcn = b.fqcn AND m.method_name = b.method_name)
SELECT binding_id, s AS match_status, CASE s WHEN 'runtime_only' THEN 'closure_action' WHEN 'unsupported' THEN 'unknown_action' WHEN 'missing_static' THEN 'missing_static_action' END AS reason_code FROM j"""
)
def j3_match_status(spark: SparkSession, d: str) -> DataFrame:
    b = _bindings(spark, d)
    kind = F.when(F.col("fqcn").isNull(), "closure").when(F.col("binding_id") % 97 == 0, "view").when(F.col("method_name") == "__invoke", "invokable_controller").otherwise("controller_method")
    key = lambda k: F.concat("project_id", F.lit("|"), action_key(k, F.col("fqcn"), F.col("method_name")))
    b = b.withColumn("action_kind", kind).withColumn("action_key", key(F.col("action_kind")))
    m = _methods(spark, d).select(key(F.lit("controller_method")).alias("action_key"))
    return R.match_routes(b, m).select("binding_id", "match_status", "reason_code")


@query(f"SELECT DISTINCT project_id, fqcn FROM {_M} m WHERE EXISTS (SELECT 1 FROM {_B} b WHERE b.project_id = m.project_id AND b.fqcn = m.fqcn AND b.method_name = m.method_name)")
def j4_matched_controllers(spark: SparkSession, d: str) -> DataFrame:
    return _methods(spark, d).join(_bindings(spark, d), ["project_id", "fqcn", "method_name"], "left_semi").select("project_id", "fqcn").distinct()


@query(
    """WITH m AS (SELECT method_id, any_value(project_id) AS project_id, any_value(scopes_used) AS u FROM controller_methods GROUP BY method_id),
u AS (SELECT method_id, project_id, unnest(u) AS s, generate_subscripts(u, 1) AS n FROM m), o AS (SELECT project_id, s.name AS name, count(DISTINCT s."on") AS c, min(s."on") AS owner FROM u WHERE s."on" IS NOT NULL GROUP BY ALL)
SELECT m.method_id, coalesce(string_agg(u.s.name || coalesce('@' || CASE WHEN o.c = 1 THEN o.owner END, ''), ',' ORDER BY n) FILTER (WHERE o.name IS NOT NULL), '') AS scopes
FROM m LEFT JOIN u USING (method_id) LEFT JOIN o ON o.project_id = u.project_id AND o.name = u.s.name GROUP BY m.method_id"""
)
def j5_known_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Of each method the scopes that some model of its project declares, with the model where it is one; here whoever is named beside a scope declares it."""
    from factmill.plans.summary import known_scopes

    m = table(spark, d, "controller_methods").groupBy("method_id").agg(F.first("project_id").alias("project_id"), F.first("scopes_used").alias("scopes_used"))
    place = {"relative_path": F.col("method_id").cast("string"), "fqcn": F.lit("C"), "class_pos": F.lit(0), "method_pos": F.lit(0)}
    declared = m.select("project_id", F.explode("scopes_used").alias("s")).where("s.on IS NOT NULL").groupBy("project_id", F.col("s.on").alias("fqcn")).agg(F.collect_set("s.name").alias("scopes"))
    rows = known_scopes(m.withColumns(place), declared)
    return rows.select("method_id", _joined(F.transform("scopes_used", lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit("@"), s["on"]), F.lit(""))))).alias("scopes"))


@query(
    """WITH u AS (SELECT project_id, unnest(scopes_used) AS s FROM controller_methods)
SELECT project_id, s.name AS name, CASE WHEN count(DISTINCT s."on") = 1 THEN min(s."on") END AS owner, count(DISTINCT s."on") AS owners FROM u WHERE s.name IS NOT NULL GROUP BY ALL"""
)
def j6_unique_owner(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "controller_methods").select("project_id", F.explode("scopes_used").alias("s")).select("project_id", "s.name", F.col("s.on").alias("owner"))
    return R.unique_owner(used.where(F.col("name").isNotNull()), ["project_id", "name"], "owner")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "classes")
    last = rows.groupBy("class_id").agg(F.max_by(F.struct("project_id", "fqcn", "class_name", "namespace", "relative_path", "imports", "extends"), F.struct("scanned_at", "ingested_at")).alias("c"))
    return last.select("class_id", "c.*")


_C = "(SELECT class_id, unnest(c) FROM (SELECT class_id, arg_max({'project_id': project_id, 'fqcn': fqcn, 'class_name': class_name, 'namespace': namespace, 'relative_path': relative_path, 'imports': imports, 'extends': extends}, (scanned_at, ingested_at)) AS c FROM classes GROUP BY class_id))"


@query(
    rf"""SELECT class_id, CASE WHEN n IS NULL THEN NULL WHEN contains(n, '\') THEN n ELSE coalesce(imports[n], concat_ws('\', nullif(namespace, ''), n)) END AS parent FROM
(SELECT class_id, namespace, imports, ltrim(trim(regexp_extract(extends, '([^\\]*)$', 1)), '\') AS n FROM {_C})"""
)
def j7_resolved_parent(spark: SparkSession, d: str) -> DataFrame:
    rows = _classes(spark, d)
    return rows.select("class_id", P.resolve_class(basename("extends"), F.col("namespace"), F.col("imports")).alias("parent"))


@query(
    rf"""WITH RECURSIVE c AS (SELECT project_id, fqcn, any_value(extends) AS extends FROM (SELECT project_id, fqcn, ltrim(trim(extends), '\') AS extends FROM {_C}) GROUP BY 1, 2),
a(project_id, fqcn, base) AS (SELECT project_id, fqcn, extends FROM c WHERE extends IS NOT NULL UNION SELECT a.project_id, a.fqcn, c.extends FROM a JOIN c ON c.project_id = a.project_id AND c.fqcn = a.base WHERE c.extends IS NOT NULL)
SELECT DISTINCT project_id, fqcn FROM a WHERE base = 'Illuminate\Database\Eloquent\Model'"""
)
def j9_model_subclasses(spark: SparkSession, d: str) -> DataFrame:
    rows = _classes(spark, d).select("project_id", "fqcn", F.ltrim(F.trim("extends"), F.lit("\\")).alias("extends"))
    return R.subclasses(rows, "Illuminate\\Database\\Eloquent\\Model")


@query(rf"SELECT project_id, regexp_extract(fqcn, '([^\\]*)$', 1) AS name, min(fqcn) AS fqcn FROM {_C} WHERE starts_with(fqcn, 'App\Models\') GROUP BY ALL")
def j12_model_by_basename(spark: SparkSession, d: str) -> DataFrame:
    models = _classes(spark, d).where(F.startswith("fqcn", F.lit("App\\Models\\")))
    return models.groupBy("project_id", basename("fqcn").alias("name")).agg(F.min("fqcn").alias("fqcn"))


@query(
    rf"""WITH c AS (SELECT project_id, fqcn, regexp_extract(fqcn, '([^\\]*)$', 1) AS n FROM {_C})
SELECT a.project_id, a.fqcn, min(b.fqcn) AS resource FROM c a JOIN c b ON a.project_id = b.project_id AND suffix(b.fqcn, '\' || regexp_replace(a.n, 'Controller$', '') || 'Resource') WHERE suffix(a.n, 'Controller') GROUP BY ALL"""
)
def j13_item_resource(spark: SparkSession, d: str) -> DataFrame:
    rows = _classes(spark, d).select("project_id", "fqcn", basename("fqcn").alias("n"))
    # the suffix join becomes an equality of last parts
    left = rows.where(F.endswith("n", F.lit("Controller"))).select("project_id", "fqcn", F.concat(F.regexp_replace("n", r"Controller\z", ""), F.lit("Resource")).alias("n"))
    right = rows.where(F.contains("fqcn", F.lit("\\"))).groupBy("project_id", "n").agg(F.min("fqcn").alias("resource"))
    return left.join(right, ["project_id", "n"]).select("project_id", "fqcn", "resource")


@query(rf"SELECT class_id FROM {_C} c WHERE NOT EXISTS (SELECT 1 FROM controller_methods m WHERE m.project_id = c.project_id AND m.fqcn = c.fqcn)")
def j16_classes_without_methods(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).join(table(spark, d, "controller_methods").select("project_id", "fqcn"), ["project_id", "fqcn"], "left_anti").select("class_id")


@query(
    rf"""WITH c AS (SELECT * FROM {_C}), u AS (SELECT project_id, relative_path, unnest(map_values(imports)) AS fqcn FROM c UNION SELECT project_id, relative_path, ltrim(trim(extends), '\') FROM c)
SELECT DISTINCT u.project_id, u.relative_path, c.relative_path AS dep_path FROM u JOIN c ON c.project_id = u.project_id AND c.fqcn = u.fqcn WHERE c.relative_path <> u.relative_path"""
)
def j17_dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    c = _classes(spark, d)
    imported = c.select("project_id", "relative_path", F.explode(F.map_values("imports")).alias("fqcn"))
    parents = c.select("project_id", "relative_path", F.ltrim(F.trim("extends"), F.lit("\\")).alias("fqcn"))
    return R.dependency_edges([imported, parents], c)


# -- aggregates


@query(
    f"""WITH v AS (SELECT project_id, fqcn, method_name, route_file, ordinal, binding_id, unnest(verbs) AS v, generate_subscripts(verbs, 1) AS n FROM {_B} WHERE fqcn IS NOT NULL),
f AS (SELECT project_id, fqcn, method_name, v, min((route_file, ordinal, binding_id, n)) AS o FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT project_id, fqcn, method_name, string_agg(v, ',' ORDER BY o) AS verbs FROM f GROUP BY ALL"""
)
def a1_first_seen_verbs(spark: SparkSession, d: str) -> DataFrame:
    rows = _bindings(spark, d).where(F.col("fqcn").isNotNull())
    seen = R.first_seen_list(rows, ["project_id", "fqcn", "method_name"], ["route_file", "ordinal", "binding_id"], "verbs", "verbs")
    return seen.withColumn("verbs", _joined(F.col("verbs")))


@query(f"SELECT project_id, fqcn, method_name, string_agg(DISTINCT v, ',' ORDER BY v) AS verbs FROM (SELECT project_id, fqcn, method_name, unnest(verbs) AS v FROM {_B} WHERE fqcn IS NOT NULL) WHERE v IS NOT NULL GROUP BY ALL")
def a2_sorted_verbs(spark: SparkSession, d: str) -> DataFrame:
    rows = _bindings(spark, d).where(F.col("fqcn").isNotNull()).select("project_id", "fqcn", "method_name", F.explode("verbs").alias("v")).where(F.col("v").isNotNull())
    return R.sorted_set(rows, ["project_id", "fqcn", "method_name"], "v", "verbs").withColumn("verbs", _joined(F.col("verbs")))


@query(f"SELECT project_id, fqcn, method_name, min(ordinal) AS ordinal FROM {_B} GROUP BY ALL")
def a3_first_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return R.first_ordinal(_bindings(spark, d), ["project_id", "fqcn", "method_name"], "ordinal")


@query(rf"SELECT project_id, regexp_extract(fqcn, '([^\\]*)$', 1) AS name, max(fqcn) AS fqcn FROM {_C} GROUP BY ALL")
def a6_map_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = _classes(spark, d).select("project_id", basename("fqcn").alias("name"), "fqcn")
    return R.last_wins(rows, ["project_id", "name"], "fqcn", ["fqcn"])


@query(f"SELECT project_id, fqcn, string_agg(method_name, ',' ORDER BY method_name) AS methods FROM {_M} GROUP BY ALL")
def a9_methods_by_controller(spark: SparkSession, d: str) -> DataFrame:
    return R.sorted_set(_methods(spark, d), ["project_id", "fqcn"], "method_name", "methods").withColumn("methods", _joined(F.col("methods")))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v, CASE WHEN event_type <> 'view' THEN event_type END AS t FROM events)
SELECT user_id, arg_min(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL) AS v, arg_min(t, (ts, event_id)) FILTER (WHERE t IS NOT NULL) AS t, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM e GROUP BY user_id"""
)
def a12_first_non_null(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(kind == "purchase", F.col("value")).alias("v"), F.when(kind != "view", kind).alias("t"))
    e = e.withColumn("types", F.array_compact(F.array("t")))
    merged = R.merge_first_non_null(e, ["user_id"], ["ts", "event_id"], ["v", "t"], ["types"])
    return merged.withColumn("types", F.nullif(_joined(F.col("types")), F.lit("")))


@query(
    """WITH f AS (SELECT DISTINCT file_id, project_id, relative_path, modified_ms, size_bytes FROM source_files), e AS (SELECT DISTINCT project_id, relative_path, modified_ms, size_bytes FROM cache_entries)
SELECT f.project_id, count(*) FILTER (WHERE e.project_id IS NOT NULL) AS hits, count(*) FILTER (WHERE e.project_id IS NULL) AS misses FROM f LEFT JOIN e USING (project_id, relative_path, modified_ms, size_bytes) GROUP BY ALL"""
)
def a15_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    keys = ["project_id", "relative_path", "modified_ms", "size_bytes"]
    f = table(spark, d, "source_files").select("file_id", *keys).distinct()
    e = table(spark, d, "cache_entries").select(*keys).distinct().withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False))
    return f.join(e, keys, "left").groupBy("project_id").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


# -- order, repeats, set operations


@query("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def d1_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.keep_first(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def d2_consecutive_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.drop_consecutive(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query(
    """WITH f AS (SELECT DISTINCT project_id, relative_path FROM source_files), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path) AS n, count(*) OVER (PARTITION BY project_id) AS c FROM f)
SELECT project_id, relative_path, c >= 20 AS partial FROM r WHERE n <= 20"""
)
def s4_max_files(spark: SparkSession, d: str) -> DataFrame:
    from factmill.sources.scan import limit_files

    return limit_files(table(spark, d, "source_files").select("project_id", "relative_path").distinct(), 20).select("project_id", "relative_path", "partial")


@query("SELECT s_nationkey AS nation, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, c_name FROM customer")
def u1_union_all(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")))


@query("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def u2_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u3_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti").distinct()


@query("SELECT sha256(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def t19_text_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").isNotNull())
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def k4_rfc3339(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query(
    rf"""SELECT class_id, regexp_extract(fqcn, '([^\\]*)$', 1) AS name, regexp_replace(regexp_extract(fqcn, '([^\\]*)$', 1), '(?:Controller|Resource|Collection)+$', '') AS bare,
  regexp_replace(regexp_extract(fqcn, '([^\\]*)$', 1), 's$', '') AS one, concat_ws('\', nullif(namespace, ''), class_name) AS qualified FROM {_C}"""
)
def t12_class_names(spark: SparkSession, d: str) -> DataFrame:
    name = basename("fqcn")
    return _classes(spark, d).select(
        "class_id", name.alias("name"), P.trim_suffix(name, "Controller", "Resource", "Collection").alias("bare"), P.singular(name).alias("one"), qualify(F.col("namespace"), F.col("class_name")).alias("qualified")
    )


@query()
def c9_project_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The JSON summary of every project of source_files, with its digest."""
    from factmill.plans.summary import summary

    return summary(X.php_files(table(spark, d, "source_files")))


def _runtime_routes(spark: SparkSession, d: str) -> DataFrame:
    """The bindings of the table as the routes of a running application."""
    b = table(spark, d, "route_bindings").dropDuplicates(["binding_id"])
    method = F.coalesce(F.nullif(F.trim("method_name"), F.lit("")), F.lit("__invoke"))
    kind = F.when(F.col("controller_fqcn").isNull(), "closure").when(method == "__invoke", "invokable_controller").otherwise("controller_method")
    fqcn = F.ltrim(F.trim("controller_fqcn"), F.lit("\\"))
    verbs = F.array_compact(F.coalesce("http_methods", F.array().cast("array<string>")))
    return b.select(
        "project_id", F.col("binding_id").cast("string").alias("route_id"), F.col("binding_id").alias("pos"), verbs.alias("methods"), F.array().cast("array<string>").alias("middleware"),
        kind.alias("action_kind"), action_key(kind, fqcn, method).alias("action_key"),
    )


@query()
def c3_route_contract(spark: SparkSession, d: str) -> DataFrame:
    """The response document of every project: its bindings as runtime routes, joined with the analysis of its files."""
    from factmill.plans.contract import answer

    return answer(X.php_files(table(spark, d, "source_files")), _runtime_routes(spark, d), F.lit("request"), F.lit("fingerprint"))


@query(
    rf"""WITH b AS (SELECT method_id, b FROM {_BODIES} WHERE b IS NOT NULL), r AS (SELECT method_id, unnest(list_concat(regexp_extract_all(b, '\babort\(\s*([^,\)]+)', 1), regexp_extract_all(b, '(?s)\babort_(?:unless|if)\(.*?,\s*([^,\)]+)', 1))) AS s FROM b)
SELECT DISTINCT method_id, try_cast(trim(s) AS INT) AS status FROM r WHERE try_cast(trim(s) AS INT) IS NOT NULL"""
)
def b7_abort_statuses(spark: SparkSession, d: str) -> DataFrame:
    from factmill.plans.contract import error_statuses

    return _bodies(spark, d).select("method_id", F.explode(error_statuses(F.col("body_text"))).alias("status"))


# -- operators of the contract on text put together from columns


def _lit_concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    """WITH p AS (SELECT p_partkey, p_size % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'policy' WHEN 1 THEN 'policy' ELSE 'allows' END AS kind, CASE k WHEN 0 THEN 'see' WHEN 1 THEN 'edit' ELSE 'drop' END AS ability, '$p' || p_partkey AS target,
  CASE k WHEN 0 THEN '$this->authorize' WHEN 1 THEN 'Gate::authorize' ELSE 'Gate::allows' END AS source, k < 2 AS enforces FROM p"""
)
def z1_gate_calls(spark: SparkSession, d: str) -> DataFrame:
    from factmill.plans.contract import explicit_authorization

    k = F.col("p_size") % 3
    call = F.when(k == 0, "$this->authorize('see'").when(k == 1, "Gate::authorize('edit'").otherwise("Gate::allows('drop'")
    body = _lit_concat("public function x() { ", call, ", $p", F.col("p_partkey"), "); ", call, ", $p", F.col("p_partkey"), "); }")
    rows = table(spark, d, "part").select("p_partkey", body.alias("body_text"), F.array().cast("array<string>").alias("form_classes"))
    rows = rows.select("p_partkey", F.explode(explicit_authorization()).alias("a"))
    return rows.select("p_partkey", "a.kind", "a.ability", "a.target", "a.source", F.col("a.enforcesFailureResponse").alias("enforces"))


@query(
    """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'policy' ELSE 'middleware' END AS kind, CASE c_nationkey % 4 WHEN 0 THEN 'can:edit,n' || c_nationkey WHEN 1 THEN 'auth:api' WHEN 2 THEN 'verified' END AS source,
  CASE c_nationkey % 4 WHEN 0 THEN 'n' || c_nationkey END AS parameter FROM customer WHERE c_nationkey % 4 < 3"""
)
def z5_middleware(spark: SparkSession, d: str) -> DataFrame:
    from factmill.plans.contract import middleware_authorization

    k = F.col("c_nationkey") % 4
    name = F.when(k == 0, _lit_concat("can:edit,n", F.col("c_nationkey"))).when(k == 1, "auth:api").when(k == 2, "verified").otherwise("throttle:60")
    rows = table(spark, d, "customer").select("c_custkey", F.array(F.struct(F.array(name).alias("middleware"))).alias("routes"))
    rows = rows.select("c_custkey", F.explode(middleware_authorization(F.lit(False))).alias("a"))
    return rows.select("c_custkey", "a.kind", "a.source", "a.parameter")


@query("SELECT s_suppkey, s_nationkey % 2 = 0 AS applies FROM supplier")
def f18_only_option(spark: SparkSession, d: str) -> DataFrame:
    from factmill.plans.contract import applies

    k = F.col("s_nationkey").cast("string")
    options = F.when(F.col("s_nationkey") % 2 == 0, _lit_concat("['only' => ['a', 'm", k, "']]")).otherwise(_lit_concat("['except' => ['m", k, "']]"))
    return table(spark, d, "supplier").select("s_suppkey", applies(options, _lit_concat("m", k)).alias("applies"))


@query(
    """WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN 'redirect' WHEN 2 THEN 'download' ELSE 'stream' END AS kind, CASE k WHEN 1 THEN 302 ELSE 200 END AS status, CASE k WHEN 1 THEN 'r' || o_orderkey END AS target, CASE k WHEN 2 THEN 'f' || o_orderkey || '.csv' END AS filename FROM o"""
)
def b4_redirects_and_files(spark: SparkSession, d: str) -> DataFrame:
    from factmill.plans.contract import with_responses

    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    call = F.when(state == "F", _lit_concat("redirect()->route('r", key, "')")).when(state == "O", _lit_concat("response()->download($p, 'f", key, ".csv')")).otherwise("response()->streamDownload($f)")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", _lit_concat("{ return ", call, "; }").alias("body_text"), F.lit(None).cast("int").alias("http_status"), F.lit("").alias("namespace"), none.alias("imports"),
        F.array().cast("array<struct<methods:array<string>>>").alias("routes"), F.lit(False).alias("bound"), F.array().cast(f"array<{P.USAGE}>").alias("request_usage"), F.lit(False).alias("has_rules"),
        F.array().cast("array<struct<kind:string,source:string,enforcesFailureResponse:boolean>>").alias("authorization"),
        F.array().cast("array<struct<fqcn:string,source:string,links:array<struct<name:string,kind:string,related:string>>>>").alias("models"),
    )
    rows = with_responses(rows).select("o_orderkey", F.explode("responses").alias("r"))
    return rows.select("o_orderkey", "r.kind", "r.status", "r.redirect.target", "r.download.filename")


@query(
    """SELECT p_partkey, 'r' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'hasMany' WHEN 1 THEN 'belongsToMany' ELSE 'morphMany' END AS relation_type, 'App\\Models\\M' || p_size AS related,
  CASE p_size % 3 WHEN 1 THEN 'a,b' ELSE '' END AS pivot, CASE p_size % 3 WHEN 2 THEN 'able' || p_size END AS morph_name FROM part"""
)
def x12_relation_methods(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_size") % 3, F.col("p_size")
    call = F.when(k == 0, _lit_concat("hasMany(M", size, "::class)")).when(k == 1, _lit_concat("belongsToMany(M", size, "::class)->withPivot('a', 'b')")).otherwise(_lit_concat("morphMany(M", size, "::class, 'able", size, "')"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    r = P.relationship(_lit_concat("r", F.col("p_partkey")), _lit_concat("public function f() { return $this->", call, "; }"), F.lit("App\\Models"), none)
    rows = table(spark, d, "part").select("p_partkey", r.alias("r"))
    return rows.select("p_partkey", "r.name", "r.relation_type", "r.related", _joined(F.col("r.pivot_columns")).alias("pivot"), "r.morph_name")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'presence' WHEN n_nationkey % 3 = 1 THEN 'public' ELSE 'private' END AS visibility, CASE n_nationkey % 3 WHEN 2 THEN 'news.' || n_nationkey ELSE 'news.' || n_nationkey END AS channel FROM nation")
def x14_broadcast_channels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    params = F.when(k == 0, "").when(k == 1, "$user").otherwise("$user, $id")
    text = _lit_concat("<?php\nBroadcast::channel('news.", F.col("n_nationkey"), "', function (", params, ") { return ['}']; });\n")
    files = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.lit("routes/channels.php").alias("relative_path"), text.alias("source_text"))
    return X.broadcast_channels(files).select(F.col("project_id").alias("n_nationkey"), F.col("channel_type").alias("visibility"), "channel")


@query(
    """SELECT p_partkey, 'f' || p_size AS path, CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' ELSE 'array' END AS type, true AS required, CASE p_size % 3 WHEN 0 THEN 'max' WHEN 1 THEN 'in' ELSE '' END AS wrappers, CASE p_size % 3 WHEN 1 THEN 'a,b' ELSE '' END AS allowed FROM part"""
)
def r4_rule_fields(spark: SparkSession, d: str) -> DataFrame:
    from factmill.plans.contract import request_fields

    k = F.col("p_size") % 3
    rules = F.when(k == 0, "'required|integer|max:9'").when(k == 1, "['required', 'string', Rule::in(['b', 'a'])]").otherwise("'required|array'")
    body = _lit_concat("{ $request->validate(['f", F.col("p_size"), "' => ", rules, "]); }")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("project_id"), F.lit("a").alias("action_key"), body.alias("body_text"), F.lit("").alias("class_source"), F.array().cast(f"array<{P.USAGE}>").alias("request_usage"), F.array().cast("array<struct<fqcn:string,source:string>>").alias("forms"),
        F.lit("").alias("namespace"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("imports"),
    )
    rows = request_fields(rows)
    return rows.select(F.col("project_id").alias("p_partkey"), "path", "type", "required", _joined(F.col("wrappers")).alias("wrappers"), _joined(F.col("allowedValues")).alias("allowed"))


@query("SELECT DISTINCT file_id, relative_path FROM source_files WHERE lower(relative_path) LIKE '%.php' AND (NOT (starts_with(relative_path, 'app/Support/') OR starts_with(relative_path, 'app/Jobs/')) OR starts_with(relative_path, 'app/Jobs/Sync'))")
def s3_scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """The vendor rule with two folders in the part of vendor/ and one whitelisted prefix."""
    from factmill.sources.scan import is_php, kept_vendor

    as_vendor = F.regexp_replace("relative_path", "^app/(Support|Jobs)/", "vendor/$1/")
    rows = table(spark, d, "source_files").select("file_id", "relative_path", as_vendor.alias("v")).where(is_php(F.col("relative_path")))
    return rows.where(kept_vendor(F.col("v"), ["vendor/Jobs/Sync"])).select("file_id", "relative_path").distinct()
