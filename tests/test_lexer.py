from factmill.functions import lexer as L
from factmill.functions import request_shape as Q
from factmill.functions import schemas as S


def test_balanced_regions():
    assert L.balanced_region("f(')' , [(1)]) x", "(", ")")[0] == "')' , [(1)]"
    for bad in (")(", "(", "no", "('", ""):
        assert L.balanced_region(bad, "(", ")") is None
    assert L.find_matching("{'\\'}' {}}", 0, "{", "}") == 9


def test_splits():
    assert L.split_top_level("'a,b', [1,2], f(1,2), , \"x\\\",\"", ",") == ["'a,b'", "[1,2]", "f(1,2)", '"x\\","']
    assert L.split_key_value("'a=>b' => fn($x) => 1") == ("'a=>b'", "fn($x) => 1")
    assert L.split_key_value("[1 => 2]") is None and L.split_top_level("", ",") == []


def test_strings_and_bodies():
    assert [L.strip_php_string(x) for x in ("'a'", '"b"', "'a\"", "a", "''", "'")] == ["a", "b", None, None, "", None]
    assert L.string_literal("  'it\\'s' x", 0) == ("it's", 9) and L.string_literal("x", 0) is None
    assert L.method_body("function a() { b(); } function b ( $x ) : int { return '}'; }", "b").strip() == "return '}';"
    assert L.method_body("function a()", "a") is None
    assert L.return_array("x; return  ['a' => [1]]; return [2]") == "'a' => [1]" and L.return_array("return 1;") is None
    assert L.array_property("protected $casts = ['a' => 'b'];", "casts") == "'a' => 'b'"
    assert L.array_property("protected array $casts = [];", "casts") is None
    assert L.statement_expression(" f(';', [1;]) ; x") == "f(';', [1;])"
    assert L.invocation_arguments("f(1, g(2, 3))") == ["1", "g(2, 3)"]
    assert L.function_call(" A::b ( 1, [2] ) ") == ("A::b", ["1", "[2]"]) and L.function_call("f(1) + 2") is None


def test_comments_and_calls():
    assert L.strip_comments("a // x\nb /* ' */ '#' # y") == "a \nb  '#' "
    text = "// render(1)\n'render(2)'; xrender(3); $render(4); render(5)"
    start, end = L.find_call(text, "render")
    assert text[start:end] == "5" and L.find_call("render", "render") is None


def test_class_blocks():
    src = """<?php
    // class Not {
    final class A extends B { use T; const X = self::class; private $f = ['}']; public function __construct(private int $x = 1) {} abstract public function c();
      public static function d() { return new class { function inner() {} }; } }
    interface I { function i(); } trait T { function t() {} } enum E { case A; function e() {} }
    if (true) { class N { function n() { $x = <<<EOT
    } class Nope {
    EOT; } } }
    class Open { public function o() { """
    found = {b.name: [n for n, _ in b.methods] for b in L.class_blocks(src)}
    assert found == {"A": ["__construct", "c", "d"], "N": ["n"], "Open": ["o"]}
    a = L.class_blocks(src)[0]
    assert a.text.startswith("final class A") and a.text.endswith("}") and dict(a.methods)["c"] == "abstract public function c();"
    assert L.class_blocks("") == [] and L.class_blocks("no php") == []


def test_broadcast_calls():
    src = "Broadcast::channel($x, function ($a) {}); Broadcast::channel(\"b\", function ($user, $c) { return '}'; }); Broadcast::channel('open', function ("
    assert L.broadcast_calls(src) == [("b", ["user", "c"])]


def test_rules():
    f = Q.field("body", "x")
    for r in ("nullable", "string", "integer", "int", "mimes:pdf", "max:3", "confirmed", "regex:/a/", "Rule::unique('t')", "in:b,a", " "):
        Q.apply_rule(f, r)
    assert f["location"] == "files" and f["nullable"] and f["optional"] is None and f["wrappers"] == ["max", "confirmed", "regex", "unique", "in"] and f["allowedValues"] == ["a", "b"]
    assert Q.rule_tokens("'a|b| '") == ["a", "b"] and Q.rule_tokens("[X::class, 'b']") == ["X::class", "b"] and Q.rule_tokens("$x") == ["$x"]


def test_constants_end_even_in_circles():
    src = "class C { const A = self::B; const B = self::A; static function m() { return [...['x'], self::D]; } const D = ['y', 'k' => 'z']; }"
    assert Q.constant_strings("self::A", src) == []
    assert Q.constant_strings("array_merge(self::m(), ['w'])", src) == ["y", "z", "w"]


def test_constants_of_other_classes_and_long_chains():
    sources = {"A": "class A { const X = ['a', B::Y, self::Z]; const Z = 'z'; }", "B": "class B { const Y = ['b', A::X]; static function m() { return ['m']; } }"}
    others = lambda name, at: (name, sources[name]) if name in sources else None
    assert Q.constant_strings("[A::X, B::m(), Gone::X, AllowedFilter::trashed()]", None, others) == ["a", "b", "z", "m", "trashed"]
    chain = "class C { " + "".join(f"const C{i} = [self::C{i + 1}];" for i in range(40)) + " const C40 = 'end'; }"
    assert Q.constant_strings("self::C0", chain) == ["end"] and Q.constant_strings("[" * 30 + "'x'" + "]" * 30, None) == ["x"]


def test_media_and_shapes():
    got = {f["path"]: f["kind"] for f in Q.media_fields("$n = ['a[]', 'b'];\n$x->addMultipleMediaFromRequest($n); addMediaFromRequest('c'); addMediaFromRequest($unknown);")}
    assert got == {"a": "collection", "b": "file", "c": "file"}
    assert Q.shape_tree(["a.b", "t[]", "a.*", "", "t[].x"]) == {"a": {"b": {}}, "t": {"_item": {"x": {}}}}


def test_schemas():
    at = S.Scope("N", {"R": "X\\RResource"})
    v = lambda e: S.of_value(e, at)
    assert v("'http://a'") == {"type": "string", "format": "uri"} and v("1.5") == {"type": "number"} and v("-3") == {"type": "integer"} and v("null") == {"nullable": True}
    assert v("[]") == {"type": "array", "items": {"type": "object"}} and v("[1, 'a']")["items"] == {"type": "integer"}
    assert v("new ARResource($this->whenLoaded('x'))") == {"$ref": "N\\ARResource", "nullable": True}
    assert v("$q->count()") == {"type": "integer"} and v("$this->when($a, fn () => 'x')") == {"type": "string"} or v("fn () => 'x'") == {"type": "string"}
    book = S.Model(["title"], relations={"notes": ("hasMany", "M\\Note"), "author": ("belongsTo", "M\\Author")})
    of = S.Scope("M", {}, models={"M\\Book": book, "M\\Note": S.Model(["text"])}, types={"b": "Book"})
    got = S.of_value("Book::with(['notes:id', 'author'])->get()", of)
    assert got["items"]["properties"] == {"author": {"type": "object"}, "notes": {"type": "array", "items": {"type": "object", "properties": {"text": {"type": "string"}}}}, "title": {"type": "string"}}
    assert S.of_value("$b->fresh()", of)["properties"] == {"title": {"type": "string"}} and S.of_value("Book::paginate(3)", of)["properties"]["data"]["type"] == "array"
    base = {"type": "object", "properties": {"a": {"type": "string"}, "c": {"type": "object"}}}
    assert S.with_properties(base, {"type": "object", "properties": {"b": {"type": "integer"}, "a": {"type": "number"}}})["properties"] == {"a": {"type": "number"}, "b": {"type": "integer"}, "c": {"type": "object"}}
    assert S.of_cast("datetime:Y") == {"type": "string", "format": "date-time"} and S.of_cast("json")["type"] == "array"
    assert v("[" * 100 + "]" * 100)["type"] == "array"
    assert S.inertia_call("/* Inertia::render('No') */ return Inertia::render('Yes', ['a' => 1]);", at) == ("Yes", {"type": "object", "properties": {"a": {"type": "integer"}}})
