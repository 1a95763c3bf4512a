import json

import pytest
from pyspark.sql import functions as F

import project
from factmill.functions.names import action_key
from factmill.operators import extraction as X
from factmill.plans.contract import answer, request_fields
from factmill.plans.summary import order_by_controllers, order_by_morphs, summary
from factmill.sources import manifest as M
from factmill.sources.factstore import refresh, stored_classes
from factmill.sources.scan import scan_project

C = "App\\Http\\Controllers\\"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("app")
    project.write(at)
    return at


@pytest.fixture(scope="module")
def files(spark, root):
    return scan_project(spark, str(root), project_id="p").cache()


def test_scan(spark, root, files):
    assert {r.relative_path for r in files.collect()} == {p for p in project.FILES if p.endswith(".php") and not p.startswith("vendor")}
    all_of_it = scan_project(spark, str(root), targets=["app", "vendor", "nowhere", "app"], whitelist=["vendor/acme"])
    assert "vendor/acme/Thing.php" in {r.relative_path for r in all_of_it.collect()} and all_of_it.count() == 15
    few = scan_project(spark, str(root), max_files=3).collect()
    assert [r.relative_path for r in sorted(few, key=lambda r: r.relative_path)] == sorted(p for p in project.FILES if p.endswith(".php"))[:3] and few[0].partial
    assert {r.relative_path.count("/") for r in scan_project(spark, str(root), max_depth=1).collect()} == {1}
    assert scan_project(spark, str(root), targets=["none"]).collect() == []


def test_summary(spark, files):
    row = summary(files).first()
    d = json.loads(row.document)
    assert d["meta"] == {"partial": False, "stats": {"filesParsed": 16, "skipped": 0, "durationMs": 0}}
    book, export = d["controllers"]
    assert [m["name"] for m in book["methods"]] == ["index", "store", "show", "update", "destroy"]
    assert [m["name"] for m in export["methods"]] == ["go"]  # the invokable route gives way to the direct one
    index, store, show, update, destroy = book["methods"]
    assert index["httpStatus"] == [200] and index["scopesUsed"] == [{"name": "available", "on": "App\\Models\\Book"}, {"name": "recent"}]
    assert store["httpStatus"] == [201] and store["requestUsage"] == [{"method": "validated", "class": "App\\Http\\Requests\\SaveBookRequest"}]
    assert store["resourceUsage"] == [{"class": "App\\Http\\Resources\\BookResource", "method": "response"}]
    assert update["httpMethods"] == ["PUT", "PATCH"] and update["httpStatus"] == [202]
    # the list of rules ends at the first closing bracket; keys with a dot are left out
    assert update["requestUsage"] == [{"method": "validate", "rules": ["title", "tags"]}, {"method": "only", "fields": ["page", "sort"], "location": "query"}]
    assert destroy["httpStatus"] == [204]
    assert [m["class"] for m in d["models"]] == ["App\\Models\\Note", "App\\Models\\Author", "App\\Models\\Book", "App\\Models\\Shelf"]
    assert d["models"][2]["relationships"][1]["withPivot"] == [{"relation": "shelves", "columns": ["row", "place"]}]
    assert d["polymorphic"] == [{"name": "notable", "discriminator": "notable_type", "relations": [{"model": "App\\Models\\Author", "type": "notes"}, {"model": "App\\Models\\Book", "type": "notes"}]}]
    assert [(b["channel"], b["type"], len(b["parameters"])) for b in d["broadcast"]] == [("books.{id}.{kind}", "private", 2), ("news", "public", 0), ("lobby", "presence", 0)]
    assert summary(files.repartition(7)).first().sha256 == row.sha256  # whatever the partitions
    assert summary(files, stamp=F.lit("2024-01-01T00:00:00Z")).first().sha256 == row.sha256


def test_features_and_projects_without_routes(spark, files):
    off = dict.fromkeys(M.FEATURES, False)
    d = json.loads(summary(files.where("relative_path not like 'routes/api%'"), off).first().document)
    methods = [m["name"] for c in d["controllers"] for m in c["methods"]]
    assert "__construct" in methods and "destroy" in methods and "helper" not in methods  # nothing is left out without routes
    assert d["broadcast"] == [] and d["polymorphic"] == []
    assert all("httpStatus" not in m and "resourceUsage" not in m and m["requestUsage"] == [] for c in d["controllers"] for m in c["methods"])


def test_model_orders():
    m = lambda c, *rel: {"class": c, "relationships": [{"name": n, "type": t, "related": r} for n, t, r in rel]}
    models = [m("App\\Models\\A"), m("App\\Models\\B", ("c", "hasMany", "App\\Models\\C")), m("App\\Models\\C", ("b", "x", "App\\Models\\B"))]
    assert [x["class"][-1] for x in order_by_controllers(models, ["X\\BController", "Y\\Controller", "Z"])] == ["B", "C", "A"]
    two = [m("P"), m("Q", ("m", "morphTo", None)), m("R", ("m", "morphTo", None), ("p", "hasMany", "P"))]
    assert [x["class"] for x in order_by_morphs(two, {"m": ["P"]})] == ["R", "P", "Q"]


def _routes(spark):
    rows = [
        ("r1", 0, ["GET"], "books", ["auth:api", "verified"], "controller_method", C + "BookController", "index"),
        ("r2", 1, ["POST"], "books", [], "controller_method", C + "BookController", "store"),
        ("r3", 2, ["PUT"], "books", ["can:update,book"], "controller_method", C + "BookController", "update"),
        ("r4", 3, ["DELETE"], "books", ["auth"], "controller_method", C + "BookController", "destroy"),
        ("r5", 4, ["GET"], "x", [], "closure", None, None),
        ("r6", 5, ["GET"], "x", [], "controller_method", C + "BookController", "nope"),
        ("r7", 6, ["GET"], "x", [], "view", None, None),
        ("r8", 7, ["POST"], "x", [], "invokable_controller", C + "ExportController", "__invoke"),
        ("r9", 8, ["GET"], "x", [], "controller_method", C + "BookController", None),
        ("r11", 10, ["POST"], "orders", [], "controller_method", C + "OrderController", "place"),
        ("r10", 9, ["GET"], "books", [], "controller_method", C + "BookController", "show"),
    ]
    df = spark.createDataFrame(rows, "route_id string, pos int, methods array<string>, uri string, middleware array<string>, action_kind string, action_fqcn string, action_method string")
    return df.select(F.lit("p").alias("project_id"), "*", action_key(F.col("action_kind"), F.col("action_fqcn"), F.col("action_method")).alias("action_key"))


def test_contract(spark, files):
    d = json.loads(answer(files, _routes(spark), F.lit("q\"1"), F.lit("f")).first().document)
    assert d["requestId"] == 'q"1' and d["status"] == "partial"
    assert [m["matchStatus"] for m in d["routeMatches"]] == ["matched"] * 4 + ["runtime_only", "missing_static", "unsupported", "matched", "unsupported", "matched", "matched"]
    assert d["meta"]["diagnosticCounts"] == {"info": 1, "warn": 3, "error": 0}
    assert [x["routeId"] for x in d["diagnostics"]] == ["r5", "r6", "r7", "r9"]
    by = {(c["fqcn"].rsplit("\\", 1)[1], c["method"]): c for c in d["delta"]["controllers"]}
    assert list(by) == sorted(by)
    update = by["BookController", "update"]
    assert update["http"] == {"status": 202, "explicit": True}
    fields = {(f["location"], f["path"]): f for f in update["request"]["fields"]}
    assert fields["body", "title"]["required"] and fields["body", "title"]["type"] == "string" and fields["body", "title"]["wrappers"] == ["max"]
    assert fields["body", "tags"]["allowedValues"] == ["a", "b"] and fields["body", "tags"]["collection"]
    assert fields["files", "cover"]["scalarType"] == "binary" and ("query", "page") in fields
    assert update["request"]["body"]["tags"] == {"_item": {}} and update["request"]["body"]["meta"] == {"year": {}} and update["request"]["query"] == {"page": {}, "sort": {}}
    assert update["request"]["contentTypes"] == ["application/json", "application/x-www-form-urlencoded", "multipart/form-data"]
    ok = update["responses"][0]
    assert ok["status"] == 202 and ok["bodySchema"]["properties"] == {"count": {"type": "integer"}, "link": {"format": "uri", "type": "string"}, "ok": {"type": "boolean"}}
    assert {(a["kind"], a["source"], a.get("ability")) for a in update["authorization"]} == {("policy", "$this->authorizeResource", None), ("policy", "can:update,book", "update")}
    assert {r["status"] for r in update["responses"]} == {202, 403, 422}
    store = by["BookController", "store"]
    assert [f["path"] for f in store["request"]["fields"]] == ["authors", "isbn", "price", "state", "title"]
    assert store["authorization"] == [{"kind": "form_request", "ability": "create", "targetKind": "expression", "target": "Book::class", "source": "FormRequest::authorize", "resolution": "form_request", "enforcesFailureResponse": True}]
    index = by["BookController", "index"]
    assert [a["source"] for a in index["authorization"]] == ["auth:api", "verified"] and {r["status"] for r in index["responses"]} == {200}
    assert index["responses"][0]["bodySchema"]["properties"]["data"]["items"] == {"ref": "App\\Http\\Resources\\BookResource"}
    assert index["resources"] == [{"class": "BookResource", "fqcn": "App\\Http\\Resources\\BookResource", "collection": True}]
    assert index["scopesUsed"] == [{"on": "App\\Models\\Book", "name": "available"}]
    destroy = by["BookController", "destroy"]
    assert destroy["authorization"][0]["enforcesFailureResponse"] is False and [r["kind"] for r in destroy["responses"]] == ["no_content"]
    show = by["BookController", "show"]
    assert {r["status"] for r in show["responses"]} >= {404}
    invoke = by["ExportController", "__invoke"]
    assert {(r["kind"], r["status"]) for r in invoke["responses"]} == {("download", 200), ("json_object", 410)} and invoke["http"] == {"status": 200, "explicit": False}
    place = by["OrderController", "place"]["request"]
    fields = {f["path"]: f for f in place["fields"]}
    assert sorted(fields) == sorted(["id", "note", "label", "buyer", "buyer.id", "buyer.note", "buyer.vip", "lines", "lines[].price", "lines[].total", "tags", "self"])
    assert fields["id"]["required"] and fields["id"]["type"] == "integer" and fields["note"]["nullable"] and not fields["note"]["required"]
    assert fields["label"]["wrappers"] == ["Optional"] and fields["buyer"]["kind"] == "object" and fields["buyer"]["type"] == "App\\Data\\BuyerData"
    assert fields["lines"]["kind"] == "collection" and fields["lines"]["itemType"] == "App\\Data\\LineData" and fields["tags"]["kind"] == "array"
    assert place["body"]["lines"]["_item"] == {"price": {}, "total": {}} and place["body"]["buyer"] == {"id": {}, "note": {}, "vip": {}}
    models = {m["fqcn"]: m for m in d["delta"]["models"]}
    book = models["App\\Models\\Book"]
    assert book["withPivot"] == [{"relation": "shelves", "columns": ["row", "place"], "alias": "spot", "timestamps": True}]
    assert {"name": "blurb", "via": "spatie/laravel-translatable"} in book["attributes"] and {"name": "price", "via": "$casts:decimal:2"} in book["attributes"]
    assert {"name": "blurb", "via": "spatie/laravel-translatable"} in models["App\\Models\\Shelf"]["attributes"]  # inherited
    assert book["polymorphic"][0]["discriminator"] == {"propertyName": "notable_type", "mapping": {"Note": "App\\Models\\Note"}}
    res = {r["class"]: r["schema"] for r in d["delta"]["resources"]}["BookResource"]["properties"]
    assert res["id"] == {"type": "integer"} and res["price"] == {"type": "number"} and res["printed_at"]["format"] == "date-time" and res["copies"] == {"type": "integer"}
    assert res["notes"] == {"items": {"ref": "App\\Http\\Resources\\NoteResource"}, "nullable": True, "type": "array"}
    assert [(b["channel"], b["visibility"], b["params"]) for b in d["delta"]["broadcast"]] == [("books.{id}.{kind}", "private", ["id", "kind"]), ("lobby", "presence", []), ("news", "public", [])]


def test_fact_store(spark, files, tmp_path):
    on = dict.fromkeys(M.FEATURES, True)
    f = files.drop("partial")
    at = f"file://{tmp_path}/store"
    cold = refresh(spark, at, f, on)
    assert (cold.hits, cold.misses) == (0, 16)
    warm = refresh(spark, at, f, on)
    assert (warm.hits, warm.misses) == (16, 0)
    assert X.models(stored_classes(warm.facts)).count() == X.models(X.classes_with_methods(f)).count() == 4
    touched = f.withColumn("modified_ms", F.col("modified_ms") + F.when(F.col("relative_path") == "app/Models/Book.php", 1).otherwise(0))
    again = refresh(spark, at, touched, on)
    assert 1 < again.misses < 16  # the file and those that depend on it
    assert refresh(spark, at, touched.where("relative_path <> 'app/Models/Note.php'"), on).facts.count() == 15
    assert refresh(spark, at, touched, on | {"polymorphic": False}).hits == 0


def test_manifest_rules(root):
    ok = M.load_manifest(json.dumps({"project": {"root": str(root)}, "cache": {"kind": "mtime"}, "features": {"polymorphic": False}, "unknown": 1}))
    assert ok.targets == ["app", "routes"] and ok.cache_kind == "mtime" and not ok.features["polymorphic"] and ok.features["http_status"]
    for bad in ("{", "{}", '{"project": {"root": ""}}', '{"project": {"root": "/no/such"}}', json.dumps({"project": {"root": str(root / "routes/api.php")}})):
        with pytest.raises(M.InvalidInput):
            M.load_manifest(bad)


def test_request_rules(spark, root):
    route = {"routeId": "a", "methods": ["GET"], "uri": "u", "middleware": [], "where": {}, "defaults": {}, "bindings": [], "action": {"kind": "invokable_controller", "fqcn": "X"}}
    good = {"contractVersion": "v2", "requestId": "i", "runtimeFingerprint": "f", "manifest": {"project": {"root": str(root)}}, "runtime": {"app": {"basePath": str(root), "laravelVersion": "1", "phpVersion": "8", "appEnv": "t"}, "routes": [route]}}
    r = M.load_request(json.dumps(good))
    assert M.routes_table(spark, r, "p").first().action_key == "X::__invoke"
    for change in ({"contractVersion": "v1"}, {"extra": 1}, {"runtime": good["runtime"] | {"routes": [route, route]}}, {"runtime": good["runtime"] | {"app": good["runtime"]["app"] | {"basePath": "rel"}}}, {"runtime": good["runtime"] | {"app": good["runtime"]["app"] | {"basePath": "/other"}}}, {"runtime": good["runtime"] | {"routes": [route | {"x": 1}]}}):
        with pytest.raises(M.InvalidInput):
            M.load_request(json.dumps(good | change))


def test_allow_lists_of_other_classes(spark, rows):
    other = "array<struct<method:string,rules:array<string>,fields:array<string>,location:string,class_name:string>>"
    body = "return QueryBuilder::for(Book::class)->allowedFilters(Lists::NAMES)->allowedSorts(Lists::sorts())->get();"
    action = spark.createDataFrame([("p", "C::index", body, "class C {}", "App\\Http", {"Lists": "App\\Lists"})], "project_id string, action_key string, body_text string, class_source string, namespace string, imports map<string,string>")
    action = action.withColumn("request_usage", F.array().cast(other)).withColumn("forms", F.array().cast("array<struct<fqcn:string,source:string>>"))
    lists = "class Lists { const NAMES = ['title', More::NAMES]; static function sorts() { return ['-year']; } }"
    index = spark.createDataFrame(
        [("p", "App\\Lists", lists, "App", {"More": "App\\Deep\\More"}), ("p", "App\\Deep\\More", "class More { const NAMES = ['isbn']; }", "App\\Deep", {}), ("q", "App\\Lists", "class Lists { const NAMES = 'no'; }", "App", {})],
        "project_id string, fqcn string, source_text string, namespace string, imports map<string,string>",
    )
    got = {r[0] for r in rows(request_fields(action, index), "path")}
    assert got == {"filter", "filter.title", "filter.isbn", "sort", "sort.year"}


def test_second_run_reads_stored_facts(spark, root, tmp_path, monkeypatch):
    from factmill import __main__ as cli

    m = M.load_manifest(json.dumps({"project": {"root": str(root)}, "cache": {"enabled": True}}), None)
    assert m.cache_enabled
    plain = cli.run(m, spark, f"file://{tmp_path}/store")
    fresh, asked = X.classes_with_methods, []

    def extract(files):
        asked.append(files.count())
        return fresh(files)

    monkeypatch.setattr(X, "classes_with_methods", extract)
    assert cli.run(m, spark, f"file://{tmp_path}/store") == plain and asked == [0]


def test_additional_is_merged_into_the_resource(spark):
    texts = {
        "app/Http/Controllers/ReportController.php": "<?php\nnamespace App\\Http\\Controllers;\nuse App\\Http\\Resources\\ReportResource;\nclass ReportController\n{\n    public function show()\n    {\n        return (new ReportResource($this->find()))->additional(['meta' => ['version' => 2], 'links' => ['self' => 'https://x.test']]);\n    }\n}\n",
        "app/Http/Resources/ReportResource.php": "<?php\nnamespace App\\Http\\Resources;\nclass ReportResource extends JsonResource\n{\n    public function toArray($request) { return ['id' => $this->id, 'meta' => true]; }\n}\n",
    }
    files = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project_id string, relative_path string, source_text string")
    files = files.withColumns({"path": F.col("relative_path"), "modified_ms": F.lit(1).cast("bigint"), "size_bytes": F.lit(1).cast("bigint"), "sha256": F.sha2("source_text", 256)})
    route = [("r", 0, ["GET"], "controller_method", "App\\Http\\Controllers\\ReportController", "show")]
    routes = spark.createDataFrame(route, "route_id string, pos int, methods array<string>, action_kind string, action_fqcn string, action_method string")
    routes = routes.select(F.lit("p").alias("project_id"), "*", F.array().cast("array<string>").alias("middleware"), action_key(F.col("action_kind"), F.col("action_fqcn"), F.col("action_method")).alias("action_key"))
    d = json.loads(answer(files, routes, F.lit("i"), F.lit("f"), version="x.v2").first().document)
    schema = d["delta"]["controllers"][0]["responses"][0]["bodySchema"]
    assert d["contractVersion"] == "x.v2" and schema["type"] == "object" and set(schema["properties"]) == {"id", "meta", "links"}
    assert schema["properties"]["meta"]["properties"]["version"] == {"type": "integer"} and schema["properties"]["links"]["properties"]["self"]["format"] == "uri"


def test_files_that_begin_with_dot_or_underscore(spark, rows, tmp_path):
    names = ["app/a.php", "app/_b.php", "app/.c.PHP", "app/_d/e.php", "app/.f/_g.php", "app/_h.txt", "_i/j.php"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(f"<?php // {n}")
    got = scan_project(spark, str(tmp_path), ["app", "_i"], project_id="p")
    assert rows(got, "relative_path") == sorted([(n,) for n in names if n != "app/_h.txt"], key=str)
    assert all(r.source_text == f"<?php // {r.relative_path}" and r.size_bytes == len(r.source_text) and len(r.sha256) == 64 for r in got.collect())


def test_empty_project_and_request_without_routes(spark, tmp_path):
    from factmill import __main__ as cli

    manifest = {"project": {"root": str(tmp_path)}}
    d = json.loads(cli.run(M.load_manifest(json.dumps(manifest)), spark)[0])
    assert d["meta"]["stats"]["filesParsed"] == 0 and d["controllers"] == d["models"] == []
    app = {"basePath": str(tmp_path), "laravelVersion": "1", "phpVersion": "8", "appEnv": "t"}
    request = {"contractVersion": "v2", "requestId": "i", "runtimeFingerprint": "f", "manifest": manifest, "runtime": {"app": app, "packages": [{"name": "n", "version": None}], "routes": []}}
    d = json.loads(cli.respond(M.load_request(json.dumps(request)), spark)[0])
    assert d["status"] == "ok" and d["routeMatches"] == [] and d["meta"]["stats"]["filesParsed"] == 0
    request["runtime"]["packages"] = [{"name": "n", "other": 1}]
    with pytest.raises(M.InvalidInput):
        M.load_request(json.dumps(request))
