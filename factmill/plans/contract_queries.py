"""Queries that run the contract's operators on an application put together from the parts, with the SQL they are compared with.

Every part is a model with its controller, request and resource; the parts of
one size are a project. What the operators must find in the texts follows from
the columns, so SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import php_text as P
from factmill.functions.names import action_key
from factmill.io import materialize, table
from factmill.operators import extraction as X
from factmill.operators import relational as R
from factmill.plans import contract as C
from factmill.plans.kernel_queries import _joined, _lit_concat, query
from factmill.plans.summary import known_scopes, project_facts

_MODEL = r"""<?php
namespace App\Models;
use Illuminate\Database\Eloquent\Model;
class M# extends Model
{
    protected $fillable = ['title', 'f%'];
    protected $casts = ['price' => 'decimal:2'];
    public function owner() { return $this->belongsTo(User::class); }
    public function notes() { return $this->morphMany(Note::class, 'able%'); }
    public function tags() { return $this->belongsToMany(Tag::class)->withPivot('a', 'b'); }
    public function scopeRecent($q) { return $q; }
    public function scopeOf%($q) { return $q; }
    protected function label() { return Attribute::make(get: fn () => 1); }
}
"""
_CONTROLLER = r"""<?php
namespace App\Http\Controllers;
use App\Http\Requests\R#Request;
use App\Http\Resources\M#Resource;
use App\Models\M#;
class C#Controller extends Controller
{
    public function __construct() { $this->authorizeResource(M#::class, 'm', ['only' => ['show']]); }
    public function show(M# $m) { return new M#Resource($m); }
    public function store(R#Request $request) { $data = $request->validated(); return response()->json(['id' => 1, 'ok' => true, 'n' => 1.5], 201); }
    public function index() { return M#Resource::collection(M#::recent()->get()); }
    public function destroy() { abort_unless($this->may, 404); return redirect()->route('r%'); }
    public function search(Request $request) { $x = $request->only(['q', 'k%']); $f = $request->file('scan'); return QueryBuilder::for(M#::class)->allowedFilters(['f%', AllowedFilter::exact('t')])->allowedSorts('-s')->get(); }
    public function extra(M# $m) { return (new M#Resource($m))->additional(['meta' => ['v' => %]]); }
    public function plain() { }
}
"""
_REQUEST = r"""<?php
namespace App\Http\Requests;
class R#Request extends FormRequest
{
    public function authorize() { return $this->user()->can('make%', M#::class); }
    public function rules(): array { return ['title' => 'required|string', 'n%' => 'integer|nullable', 'when' => 'date']; }
}
"""
_RESOURCE = r"""<?php
namespace App\Http\Resources;
class M#Resource extends JsonResource
{
    public function toArray($request) { return ['id' => $this->id, 'title' => $this->title, 'price' => $this->price, 'at' => $this->made_at]; }
}
"""


def _filled(text: str) -> Column:
    filled = F.replace(F.lit(text), F.lit("#"), F.col("p_partkey").cast("string"))
    return F.replace(filled, F.lit("%"), F.col("p_size").cast("string"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The application's files. The keys of all parts fit into one task, their texts don't: rows are spread before the texts are made."""
    each = {"app/Models/M#.php": _MODEL, "app/Http/Controllers/C#Controller.php": _CONTROLLER, "app/Http/Requests/R#Request.php": _REQUEST, "app/Http/Resources/M#Resource.php": _RESOURCE}
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey", "p_size").distinct()
    both = F.array(*[F.struct(_filled(p).alias("relative_path"), _filled(t).alias("source_text")) for p, t in each.items()])
    return parts.select(F.col("p_size").cast("string").alias("project_id"), F.explode(both).alias("f")).select("project_id", "f.*")


def _application(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The files and the index of their classes, each written once: planned from ``part`` their texts would seem small enough to be broadcast."""
    files = materialize(_files(spark, d), "files")
    return files, materialize(X.class_index(files), "index")


def _classes_of(files: DataFrame, kind: Callable[..., Column]) -> DataFrame:
    """The classes of those files that may hold one of ``kind``: what a class's text tells, its file's tells too."""
    text = F.col("source_text")
    return X.classes_with_methods(files.where(kind(text, F.col("relative_path"), P.namespace(text))))


def _models(files: DataFrame) -> DataFrame:
    """The models, written once; only files that may hold one are split into classes."""
    return materialize(X.models(_classes_of(files, P.is_model)), "models")


def _actions(files: DataFrame, index: DataFrame, with_models: bool = True) -> tuple[DataFrame, DataFrame]:
    """The actions with one route each, of odd sizes behind ``auth``, and the models.

    Only files that may hold a controller are split for them. The models are
    written, unless ``with_models`` is false: for queries whose columns need none, which leave them out of the plan.
    """
    middleware = F.when(F.col("project_id").cast("int") % 2 == 1, F.array(F.lit("auth:api"))).otherwise(F.array().cast("array<string>"))
    route = F.array(F.struct(F.lit(0).alias("pos"), F.array(F.lit("GET")).alias("methods"), middleware.alias("middleware")))
    models = _models(files) if with_models else X.models(_classes_of(files, P.is_model))
    facts = {"methods": X.controller_methods(_classes_of(files, P.is_controller)), "models": models}
    return C.actions(facts, index).withColumn("routes", route).withColumn("bound", F.lit(False)), models


_P = "(SELECT DISTINCT p_partkey AS k, p_size AS z, CAST(p_size AS VARCHAR) AS project_id FROM part)"


@query(rf"SELECT project_id, 'App\Models\M' || k AS fqcn, 'label' AS attributes, 'of' || z || ',recent' AS scopes FROM {_P}")
def x11_model_facts(spark: SparkSession, d: str) -> DataFrame:
    found = X.models(X.classes_with_methods(_files(spark, d)))
    return found.select("project_id", "fqcn", _joined(F.col("attributes")).alias("attributes"), _joined(F.array_sort("scopes")).alias("scopes"))


@query(
    rf"""SELECT project_id, 'App\Models\M' || k AS fqcn, n AS pos, name, kind AS relation_type, 'App\Models\' || related AS related, CASE WHEN morph THEN 'able' || z END AS morph_name, pivots
FROM {_P}, (VALUES (0, 'owner', 'belongsTo', 'User', false, ''), (1, 'notes', 'morphMany', 'Note', true, ''), (2, 'tags', 'belongsToMany', 'Tag', false, 'a,b')) AS r(n, name, kind, related, morph, pivots)"""
)
def x22_relations_in_order(spark: SparkSession, d: str) -> DataFrame:
    found = X.models(X.classes_with_methods(_files(spark, d))).select("project_id", "fqcn", F.posexplode("relationships").alias("pos", "r"))
    return found.select("project_id", "fqcn", "pos", "r.name", "r.relation_type", "r.related", "r.morph_name", _joined(F.col("r.pivot_columns")).alias("pivots"))


@query(rf"SELECT project_id, 'app/Models/M' || k || '.php' AS relative_path, 'able' || z AS name, 'able' || z || '_type' AS discriminator, 'App\Models\M' || k AS model, 'notes' AS relation FROM {_P}")
def x13_polymorphic_facts(spark: SparkSession, d: str) -> DataFrame:
    return X.polymorphic_facts(X.models(X.classes_with_methods(_files(spark, d))))


@query(
    rf"""SELECT project_id, 'App\Http\Controllers\C' || k || 'Controller' AS fqcn, m AS method_name, CASE m WHEN 'store' THEN 201 END AS http_status,
  CASE m WHEN 'index' THEN 'recent' ELSE '' END AS scopes FROM {_P}, (VALUES ('__construct'), ('show'), ('store'), ('index'), ('destroy'), ('search'), ('extra'), ('plain')) AS v(m)"""
)
def x4_actions_of_controllers(spark: SparkSession, d: str) -> DataFrame:
    facts = project_facts(_files(spark, d))
    rows = known_scopes(facts["methods"], facts["models"])
    return rows.select("project_id", "fqcn", "method_name", "http_status", _joined(F.transform("scopes_used", lambda s: s["name"])).alias("scopes"))


@query(
    rf"""SELECT project_id, 'App\Http\Controllers\C' || k || 'Controller::' || m AS action_key, kind, CASE m WHEN 'store' THEN 'make' || z END AS ability, CASE m WHEN 'show' THEN 'App\Models\M' || k WHEN 'store' THEN 'M' || k || '::class' END AS target,
  CASE m WHEN 'show' THEN 'm' END AS parameter, source, resolution, true AS enforces
FROM {_P}, (VALUES ('show', 'policy', '$this->authorizeResource', 'explicit'), ('store', 'form_request', 'FormRequest::authorize', 'form_request'), ('__construct', 'middleware', 'auth:api', 'runtime'), ('index', 'middleware', 'auth:api', 'runtime'),
  ('destroy', 'middleware', 'auth:api', 'runtime'), ('search', 'middleware', 'auth:api', 'runtime'), ('extra', 'middleware', 'auth:api', 'runtime'), ('plain', 'middleware', 'auth:api', 'runtime')) AS a(m, kind, source, resolution)
WHERE kind <> 'middleware' OR z % 2 = 1"""
)
def z1_authorization(spark: SparkSession, d: str) -> DataFrame:
    """Every action's authorization: resource policies where they apply, form requests, and guards where nothing else authorizes."""
    rows = C.with_authorization(_actions(*_application(spark, d), with_models=False)[0])
    # an inner explode has Spark ask for the list's size first: all texts would be parsed twice
    rows = rows.select("project_id", "action_key", F.explode_outer("authorization").alias("a")).where(F.col("a").isNotNull())
    return rows.select("project_id", "action_key", "a.kind", "a.ability", "a.target", "a.parameter", "a.source", "a.resolution", F.col("a.enforcesFailureResponse").alias("enforces"))


_SCHEMA = """'{"properties":{"at":{"format":"date-time","type":"string"},"id":{"type":"integer"},' || CASE m WHEN 'extra' THEN '"meta":{"properties":{"v":{"type":"integer"}},"type":"object"},' ELSE '' END || '"price":{"type":"number"},"title":{"type":"string"}},"type":"object"}'"""


@query(
    rf"""SELECT project_id, 'App\Http\Controllers\C' || k || 'Controller::' || m AS action_key, kind, status, explicit, source, CASE kind WHEN 'redirect' THEN 'r' || z END AS target, CASE WHEN s = 'extra' THEN {_SCHEMA}
  WHEN s = 'ref' THEN '{{"ref":"App\\Http\\Resources\\M' || k || 'Resource"}}' WHEN s = 'many' THEN '{{"properties":{{"data":{{"items":{{"ref":"App\\Http\\Resources\\M' || k || 'Resource"}},"type":"array"}}}},"required":["data"],"type":"object"}}' ELSE s END AS schema
FROM {_P}, (VALUES ('__construct', 'json_object', 200, false, NULL, '{{"type":"object"}}'), ('plain', 'json_object', 200, false, NULL, '{{"type":"object"}}'), ('search', 'json_object', 200, false, NULL, '{{"type":"object"}}'),
  ('destroy', 'json_object', 404, false, 'abort()', '{{"type":"object"}}'), ('destroy', 'redirect', 200, false, 'redirect()->route', NULL), ('extra', 'json_object', 200, false, 'JsonResource', 'extra'),
  ('index', 'json_object', 200, false, 'JsonResource::collection', 'many'), ('show', 'json_object', 200, false, 'JsonResource', 'ref'), ('show', 'json_object', 403, false, '$this->authorizeResource', '{{"type":"object"}}'),
  ('store', 'json_object', 201, true, 'response()->json', '{{"properties":{{"id":{{"type":"integer"}},"n":{{"type":"number"}},"ok":{{"type":"boolean"}}}},"type":"object"}}'),
  ('store', 'json_object', 403, false, 'FormRequest::authorize', '{{"type":"object"}}'), ('store', 'json_object', 422, false, 'FormRequest', '{{"type":"object"}}')) AS r(m, kind, status, explicit, source, s)"""
)
def b0_responses(spark: SparkSession, d: str) -> DataFrame:
    """Every action's responses: payloads, redirects, aborts, resources with and without an envelope, the status alone, failures of authorization and validation."""
    files, index = _application(spark, d)
    rows, models = _actions(files, index)
    schemas = C.contract_resources(index, models)
    rows = C.with_responses(C.with_authorization(rows), schemas).select("project_id", "action_key", F.explode("responses").alias("r"))
    return rows.select("project_id", "action_key", "r.kind", "r.status", "r.explicit", "r.source", "r.redirect.target", F.col("r.bodySchema").alias("schema"))


@query(
    rf"""SELECT project_id, 'App\Http\Controllers\C' || k || 'Controller::' || m AS action_key, location, replace(path, '%', CAST(z AS VARCHAR)) AS path, kind, type, format, replace(allowed, '%', CAST(z AS VARCHAR)) AS allowed, required, nullable, replace(source, '#', 'App\Http\Requests\R' || k || 'Request::rules') AS source, via
FROM {_P}, (VALUES ('search', 'query', 'q', 'field', NULL, NULL, '', NULL, NULL, 'request extraction', 'only'), ('search', 'query', 'k%', 'field', NULL, NULL, '', NULL, NULL, 'request extraction', 'only'), ('search', 'files', 'scan', 'file', 'string', NULL, '', NULL, NULL, 'request upload', 'file'),
  ('search', 'query', 'filter', 'object', 'object', NULL, 'f%,t', NULL, NULL, 'spatie/laravel-query-builder', 'filter'), ('search', 'query', 'filter.f%', 'csv', 'string', NULL, 'f%', NULL, NULL, 'spatie/laravel-query-builder', 'filter'),
  ('search', 'query', 'filter.t', 'csv', 'string', NULL, 't', NULL, NULL, 'spatie/laravel-query-builder', 'filter'), ('search', 'query', 'sort', 'csv', 'string', NULL, 's', NULL, NULL, 'spatie/laravel-query-builder', 'sort'),
  ('search', 'query', 'sort.s', 'csv', 'string', NULL, 's', NULL, NULL, 'spatie/laravel-query-builder', 'sort'), ('store', 'body', 'title', 'scalar', 'string', NULL, '', true, NULL, '#', 'FormRequest'),
  ('store', 'body', 'n%', 'scalar', 'integer', NULL, '', NULL, true, '#', 'FormRequest'), ('store', 'body', 'when', 'scalar', 'string', 'date', '', NULL, NULL, '#', 'FormRequest')) AS f(m, location, path, kind, type, format, allowed, required, nullable, source, via)"""
)
def r0_request_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every action's request, as registered: form requests, extraction, uploads, query builders."""
    files, index = _application(spark, d)
    rows = _actions(files, index)[0]
    fields = C.request_fields(rows, index, R.ancestry(index.select("project_id", "fqcn", "extends")))
    return fields.select("project_id", "action_key", "location", "path", "kind", "type", "format", _joined(F.col("allowedValues")).alias("allowed"), "required", "nullable", "source", "via")


@query(rf"SELECT project_id, 'App\Http\Resources\M' || k || 'Resource' AS fqcn, {_SCHEMA} AS schema FROM {_P}, (VALUES ('')) AS v(m)")
def c5_resources(spark: SparkSession, d: str) -> DataFrame:
    """The schema of every resource class, its properties read from the model's casts, lists and names."""
    files, index = _application(spark, d)
    return C.contract_resources(index, _models(files)).select("project_id", "fqcn", "schema")


@query(
    rf"""SELECT project_id, 'App\Models\M' || k AS fqcn, 'f' || z || ' $fillable,label Attribute::make,price $casts:decimal:2,title $fillable' AS attributes, 'tags a b' AS pivots, 'notes morphMany able' || z || '_type App\Models\Note' AS polymorphic FROM {_P}"""
)
def c4_models(spark: SparkSession, d: str) -> DataFrame:
    """The contract's models: where attributes come from, pivots, polymorphic relations with their discriminator."""
    files, index = _application(spark, d)
    rows = C.contract_models(_models(files), index, R.ancestry(index.select("project_id", "fqcn", "extends")))
    words = lambda *c: F.concat_ws(" ", *c)
    return rows.select(
        "project_id", "fqcn", _joined(F.transform("attributes", lambda a: words(a["name"], a["via"]))).alias("attributes"), _joined(F.transform("withPivot", lambda p: words(p["relation"], F.array_join(p["columns"], " ")))).alias("pivots"),
        _joined(F.transform("polymorphic", lambda p: words(p["relation"], p["type"], p["discriminator"]["propertyName"], p["discriminator"]["mapping"]["Note"]))).alias("polymorphic"),
    )


@query(
    """WITH r AS (SELECT n_nationkey AS pos, n_nationkey % 4 AS k, CAST(n_regionkey AS VARCHAR) AS project_id FROM nation)
SELECT project_id, pos, CASE k WHEN 0 THEN 'route.runtime_only.closure' WHEN 1 THEN 'route.action.missing_static' ELSE 'route.action.unsupported' END AS code, CASE k WHEN 0 THEN 'info' ELSE 'warn' END AS severity,
  CASE k WHEN 1 THEN 'action' ELSE 'route' END AS scope, CASE k WHEN 0 THEN 'runtime route uses a closure action and is runtime-only in contract v2' WHEN 1 THEN 'runtime route action has no matching static controller analysis'
    ELSE 'runtime route action kind is unsupported in contract v2' END AS message, CASE k WHEN 1 THEN 'N::m' || pos END AS action_key FROM r WHERE k < 3"""
)
def c8_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What keeps routes from matching: closures, actions that no file has, unknown kinds."""
    k = F.col("n_nationkey") % 4
    kind = F.when(k == 0, "closure").when(k == 2, "view").otherwise("controller_method")
    key = action_key(kind, F.when(k.isin(1, 3), F.lit("N")), F.when(k.isin(1, 3), _lit_concat("m", F.col("n_nationkey"))))
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("project_id"), F.col("n_nationkey").alias("pos"), _lit_concat("r", F.col("n_nationkey")).alias("route_id"), kind.alias("action_kind"), key.alias("action_key"), k.alias("k"))
    found = R.match_routes(rows, rows.where("k = 3").select("action_key"))
    return C.diagnostics(found).select("project_id", "pos", "code", "severity", "scope", "message", F.col("actionKey").alias("action_key"))


@query(
    """WITH r AS (SELECT CAST(n_regionkey AS VARCHAR) AS project_id, n_nationkey % 4 AS k FROM nation)
SELECT project_id, count(*) FILTER (WHERE k = 0) AS info, count(*) FILTER (WHERE k IN (1, 2)) AS warn FROM r WHERE k < 3 GROUP BY ALL"""
)
def a8_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics per project and severity."""
    return C.severity_counts(c8_diagnostics(spark, d))
