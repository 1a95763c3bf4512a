"""Facts of PHP text as column expressions: regular expressions that stay in the JVM.

Patterns that must find what a PHP project's author wrote are fixed values; they
are named at the top of each function. Java's ``(?s).*?`` stands for "anything",
``(?d)`` makes only ``\\n`` end lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factmill.functions.names import qualify

USAGE = "struct<method:string,rules:array<string>,fields:array<string>,location:string,class_name:string>"
NAME = r"[A-Z][A-Za-z0-9_\\]*"


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of every match in order; empty without one, null of null."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def namespace(text: Column) -> Column:
    """The first ``namespace ...;`` line; empty without one."""
    return F.coalesce(F.trim(first(text, r"(?md)^\s*namespace\s+([^;]+);")), F.when(text.isNotNull(), F.lit("")))


def imports(text: Column, aliases: bool = True) -> Column:
    """alias -> class of the ``use ...;`` lines. Grouped imports are left out, a later line of an alias holds.

    Without ``aliases`` (route files) the key is all that follows the last backslash.
    """
    lines = F.filter(F.transform(every(text, r"(?md)^\s*use\s+([^;]+);"), lambda x: F.trim(x)), lambda x: ~F.contains(x, F.lit("{")))
    alias = r"(?is)^(.*?)\s+as\s+([A-Za-z_][A-Za-z0-9_]*)\z"

    def entry(x: Column) -> Column:
        plain = F.struct(F.trim(F.substring_index(x, "\\", -1)).alias("key"), F.ltrim(x, F.lit("\\")).alias("value"))
        if not aliases:
            return plain
        named = F.struct(F.regexp_extract(x, alias, 2).alias("key"), F.ltrim(F.trim(F.regexp_extract(x, alias, 1)), F.lit("\\")).alias("value"))
        return F.when(F.regexp_like(x, F.lit(alias)), named).otherwise(plain)

    entries = F.transform(lines, entry)
    # Maps don't take a key twice: of equal aliases the last entry stays.
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def resolve_class(name: Column, space: Column, known: Column) -> Column:
    """Qualified name of a class as written: qualified names stay, others go by import, then by namespace. Null stays null."""
    bare = F.ltrim(F.trim(name), F.lit("\\"))
    return F.when(bare.isNull() | F.contains(bare, F.lit("\\")), bare).otherwise(F.coalesce(F.try_element_at(known, bare), qualify(space, bare)))


def resolve_route_class(name: Column, known: Column) -> Column:
    """The same in a route file: no namespace to fall back to."""
    bare = F.ltrim(F.trim(name), F.lit("\\"))
    return F.when(F.contains(bare, F.lit("\\")), bare).otherwise(F.coalesce(F.try_element_at(known, bare), bare))


def class_header(text: Column) -> tuple[Column, Column]:
    """(name, name extended as written) of the first class line; nulls without one."""
    head = r"(?md)^\s*(?:final\s+|abstract\s+)?class\s+"
    word = r"([A-Za-z_][A-Za-z0-9_]*)"
    return first(text, head + word), first(text, head + word + r"\s+extends\s+([A-Za-z_\\][A-Za-z0-9_\\]*)", 2)


def strings(text: Column) -> Column:
    """Inside of all quoted strings."""
    return every(text, r"""['"]([^'"]+)['"]""")


def array_keys(text: Column) -> Column:
    """Quoted strings before ``=>``."""
    return every(text, r"""['"]([^'"]+)['"]\s*=>""")


def http_status(body: Column) -> Column:
    """The status a method answers with: json call, response call, abort, setStatusCode, noContent - the first that is there."""
    found = [
        first(body, r"(?s)response\(\)->json\(.*?,\s*(\d{3})\s*\)"),
        first(body, r"(?s)response\(.*?,\s*(\d{3})\s*\)"),
        first(body, r"abort\((\d{3})"),
        first(body, r"setStatusCode\((\d{3})\)"),
    ]
    return F.coalesce(*[x.try_cast("int") for x in found], F.when(F.contains(body, F.lit("noContent()")), F.lit(204)))


def _usage(method: str, rules: Column | None = None, fields: Column | None = None, location: str | None = None, class_name: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(method).alias("method"),
        (none if rules is None else rules).alias("rules"),
        (none if fields is None else fields).alias("fields"),
        F.lit(location).cast("string").alias("location"),
        (F.lit(None).cast("string") if class_name is None else class_name).alias("class_name"),
    )


def request_usage(body: Column, space: Column, known: Column) -> Column:
    """What a method takes from its request, in order: validated, validate, only, file, body."""
    form = first(body, r"([A-Z][A-Za-z0-9_\\]*Request)\s+\$request")
    validated = F.when(form.isNotNull() & F.contains(body, F.lit("$request->validated()")), F.array(_usage("validated", class_name=resolve_class(form, space, known))))
    validate = F.transform(
        every(body, r"validate\(\s*\[([^\]]*)\]"), lambda x: _usage("validate", rules=F.array_distinct(F.filter(array_keys(x), lambda k: ~F.contains(k, F.lit(".")))))
    )
    only = F.transform(every(body, r"only\(\s*\[([^\]]*)\]"), lambda x: _usage("only", fields=F.array_distinct(strings(x)), location="query"))
    names = F.array_distinct(every(body, r"""file\(\s*['"]([^'"]+)['"]\s*\)"""))
    files = F.when(F.size(names) > 0, F.array(_usage("file", fields=names, location="files")))
    whole = F.when(F.contains(body, F.lit("$request->all()")) | F.contains(body, F.lit("$request->json()")), F.array(_usage("body", rules=F.array(F.lit("*")))))
    none = F.array().cast(f"array<{USAGE}>")
    return F.concat(*[F.coalesce(x.cast(f"array<{USAGE}>"), none) for x in (validated, validate, only, files, whole)])


def _resources(body: Column, space: Column, known: Column) -> tuple[Column, ...]:
    name = r"([A-Z][A-Za-z0-9_\\]*(?:Resource|Collection))"
    patterns = (rf"(?s)new\s+{name}\(.*?\)\s*->response\(", rf"{name}::collection\(", rf"{name}::make\(", rf"new\s+{name}\(")
    return tuple(F.array_distinct(F.transform(every(body, p), lambda x: resolve_class(x, space, known))) for p in patterns)


def _pairs(names: Column, method) -> Column:
    return F.transform(names, lambda x: F.struct(x.alias("class_name"), (method(x) if callable(method) else F.lit(method)).alias("method")))


def resource_usage(body: Column, space: Column, known: Column, add_new: bool = False) -> Column:
    """Resources a method answers with, in order response, collection, make, new.

    A class that is newed counts as ``new`` (``collection`` where its name says so)
    only if it isn't among the first two already; with ``add_new`` beside a
    response it counts too.
    """
    responses, collections, makes, news = _resources(body, space, known)
    fresh = F.filter(news, lambda x: ~F.array_contains(collections, x) & (F.lit(True) if add_new else ~F.array_contains(responses, x)))
    kind = lambda x: F.when(F.endswith(x, F.lit("Collection")), "collection").otherwise("new")
    return F.array_distinct(F.concat(_pairs(responses, "response"), _pairs(collections, "collection"), _pairs(makes, "make"), _pairs(fresh, kind)))


# Chained calls that are no scopes.
NO_SCOPES = (
    "json validate file only all input query create collection make setStatusCode with where whereHas orWhere paginate limit get load fresh delete update attach sync response user authorize has count latest"
).split()


def scope_calls(body: Column) -> Column:
    """Names of chained calls that may be model scopes, each once in order."""
    return F.array_except(every(body, r"(?:->|::)([A-Z]?[a-z][A-Za-z0-9_]*)\("), F.array(*map(F.lit, NO_SCOPES)))


def model_scopes(class_text: Column) -> Column:
    """Scopes a model declares, first letter lowered, sorted."""
    raw = every(class_text, r"function\s+scope([A-Z][A-Za-z0-9_]*)\(")
    return F.array_sort(F.array_distinct(F.transform(raw, lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 2**30)))))


RELATIONS = "belongsTo|hasMany|hasOne|belongsToMany|morphTo|morphOne|morphMany|morphToMany|morphedByMany"


def relationship(name: Column, method: Column, space: Column, known: Column) -> Column:
    """The relation a model's method declares; null if it declares none."""
    kind = first(method, rf"\$this->({RELATIONS})\(")
    related = F.when(kind != "morphTo", resolve_class(first(method, r"\(\s*([A-Z][A-Za-z0-9_\\]*)::class"), space, known))
    morph = F.when(kind == "morphTo", name).when(
        kind.isin("morphOne", "morphMany", "morphToMany", "morphedByMany"), first(method, r"""\(\s*[A-Z][A-Za-z0-9_\\]*::class\s*,\s*['"]([^'"]+)['"]""")
    )
    columns = F.array_distinct(F.flatten(F.transform(every(method, r"withPivot\(([^)]*)\)"), strings)))
    return F.when(
        kind.isNotNull(),
        F.struct(
            name.alias("name"),
            kind.alias("relation_type"),
            related.alias("related"),
            columns.alias("pivot_columns"),
            first(method, r"""->as\(\s*['"]([^'"]+)['"]\s*\)""").alias("pivot_alias"),
            F.contains(method, F.lit("withTimestamps(")).alias("pivot_timestamps"),
            morph.alias("morph_name"),
        ),
    )


def channel_parameters(channel: Column) -> Column:
    """(name, parameter_type) of the ``{x}`` of a channel, each once: int for ``id``, else string."""
    names = F.array_distinct(every(channel, r"\{([^}]+)\}"))
    return F.transform(names, lambda x: F.struct(x.alias("name"), F.when(x == "id", "int").otherwise("string").alias("parameter_type")))


def channel_visibility(parameters: Column) -> Column:
    """presence without callback parameters, public with ``user`` alone, else private."""
    return F.when(F.size(parameters) == 0, "presence").when(F.forall(parameters, lambda x: x == "user"), "public").otherwise("private")


# Verbs of a resource's actions, and those of match and any.
RESOURCE_ACTIONS = [("index", ["GET"]), ("store", ["POST"]), ("show", ["GET"]), ("update", ["PUT", "PATCH"]), ("destroy", ["DELETE"]), ("create", ["GET"]), ("edit", ["GET"])]
ALL_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS"]
API_ACTIONS = 5

BINDING = "struct<controller_fqcn:string,method_name:string,http_methods:array<string>>"


def _binding(fqcn: Column, method: Column, verbs: Column) -> Column:
    return F.struct(fqcn.alias("controller_fqcn"), method.alias("method_name"), verbs.alias("http_methods"))


def _verbs(verb: Column) -> Column:
    return F.when(verb.isin("match", "any"), F.array(*map(F.lit, ALL_VERBS))).otherwise(F.array(F.upper(verb)))


def route_bindings(text: Column, known: Column) -> Column:
    """Bindings of a route file in order: resources, then direct routes, then invokable ones.

    An invokable route is left out where its class has a binding of the direct or
    invokable kind already. Routes behind another chained call aren't seen.
    """
    resource = r"""Route::(apiResource|resource)\(\s*['"][^'"]+['"]\s*,\s*([A-Za-z_\\][A-Za-z0-9_\\]*)::class"""
    direct = r"""Route::(get|post|put|patch|delete|options|any|match)\([^;]*?\[\s*([A-Za-z_\\][A-Za-z0-9_\\]*)::class\s*,\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]\s*\]"""
    invokable = r"Route::(get|post|put|patch|delete|options|any|match)\([^;]*?([A-Za-z_\\][A-Za-z0-9_\\]*)::class"
    actions = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*map(F.lit, v)).alias("v")) for m, v in RESOURCE_ACTIONS])
    kinds, classes = every(text, resource, 1), F.transform(every(text, resource, 2), lambda x: resolve_route_class(x, known))
    resources = F.flatten(
        F.transform(
            F.arrays_zip(kinds.alias("k"), classes.alias("c")),
            lambda r: F.transform(F.slice(actions, 1, F.when(r["k"] == "apiResource", API_ACTIONS).otherwise(len(RESOURCE_ACTIONS))), lambda a: _binding(r["c"], a["m"], a["v"])),
        )
    )
    named = F.transform(every(text, direct, 2), lambda x: resolve_route_class(x, known))
    directs = F.transform(
        F.arrays_zip(every(text, direct, 1).alias("k"), named.alias("c"), every(text, direct, 3).alias("m")), lambda r: _binding(r["c"], r["m"], _verbs(r["k"]))
    )
    invoked = F.transform(every(text, invokable, 2), lambda x: resolve_route_class(x, known))
    zipped = F.arrays_zip(every(text, invokable, 1).alias("k"), invoked.alias("c"))
    lone = F.filter(zipped, lambda r, i: ~F.array_contains(named, r["c"]) & (F.array_position(invoked, r["c"]) == i + 1))
    invokables = F.transform(lone, lambda r: _binding(r["c"], F.lit("__invoke"), _verbs(r["k"])))
    none = F.array().cast(f"array<{BINDING}>")
    return F.concat(*[F.coalesce(x.cast(f"array<{BINDING}>"), none) for x in (resources, directs, invokables)])


def is_controller(class_text: Column, path: Column, space: Column) -> Column:
    return F.contains(class_text, F.lit("extends Controller")) | F.startswith(path, F.lit("app/Http/Controllers/")) | F.endswith(space, F.lit("\\Http\\Controllers"))


def is_model(class_text: Column, path: Column, space: Column) -> Column:
    return F.contains(class_text, F.lit("extends Model")) | F.startswith(path, F.lit("app/Models/")) | F.endswith(space, F.lit("\\Models"))


def is_action(name: Column, method_text: Column) -> Column:
    """Whether a controller's method is an action."""
    return F.contains(method_text, F.lit("public function")) | (name == "__invoke")


def is_resource_class(fqcn: Column, extends: Column) -> Column:
    name = F.substring_index(fqcn, "\\", -1)
    by_parent = F.coalesce(F.endswith(extends, F.lit("JsonResource")) | F.endswith(extends, F.lit("ResourceCollection")), F.lit(False))
    return F.contains(fqcn, F.lit("\\Http\\Resources\\")) | by_parent | F.endswith(name, F.lit("Resource")) | F.endswith(name, F.lit("Collection"))


def is_abstract(class_text: Column) -> Column:
    return F.contains(class_text, F.lit("abstract class "))


def is_collection_resource(class_name: Column, method: Column) -> Column:
    return F.coalesce(method == "collection", F.lit(False)) | F.endswith(class_name, F.lit("Collection"))


def is_polymorphic(kind: Column) -> Column:
    return kind.isin("morphTo", "morphOne", "morphMany", "morphToMany", "morphByMany", "morphedByMany")


def is_to_many(kind: Column) -> Column:
    """Relations to lists; ``morphedByMany`` isn't among them."""
    return kind.isin("hasMany", "belongsToMany", "morphMany", "morphToMany", "morphByMany")


def singular(name: Column) -> Column:
    return F.regexp_replace(name, r"s\z", "")


def trim_suffix(name: Column, *suffixes: str) -> Column:
    """``name`` without any of the suffixes, however often repeated."""
    return F.regexp_replace(name, rf"(?:{'|'.join(suffixes)})+\z", "")


def relative_path(path: Column, root: str) -> Column:
    """``path`` with forward slashes and without its root."""
    slashed = F.translate(path, "\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(base)), F.substring(slashed, len(base) + 1, 2**30)).otherwise(slashed)
