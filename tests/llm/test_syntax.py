import pytest

from factmill.llm import lexer_maps as M
from factmill.llm.syntax import _MAPS, checked_files, parses, piece_parses

VALID = {
    "php": [
        "<?php\nnamespace A\\B;\nuse C\\{D, E as F, function g};\nuse function h\\i; use const J\\K;\nabstract class X extends Y implements Z, \\W { use T, U { T::a insteadof U; b as protected c; } const string A = 'a', B = 2; public readonly ?int $x; private static array|null $y = [1, 'k' => [2]]; abstract protected function f(int &$a, string ...$b): static; final public function &list(): void {} }",
        "<html><?php if ($a): ?>x<?php elseif ($b): ?>y<?php else: ?>z<?php endif ?></html><?= $x, 1 ?>\n",
        "<?php enum S: string implements I { case A = 'a'; case B = 'b'; public static function f(): self { return self::A; } }",
        "<?php $f = fn(int $x): int => $x ** 2 <=> 3; $g = static function() use (&$a, $b): ?array { yield $k => $v; yield from h(); return; };",
        "<?php echo match(true) { $a > 1, $b => 'x', default => throw new \\Exception(\"a {$b['c']} $d[0] $e->f ${g} {$h->i()['j']}\"), };",
        "<?php $x = <<<EOT\n  a $b {$c[\"d\"]}\n  EOT . <<<'N'\n{\nN;\n",
        "<?php #[Attr(1), Other]\nfunction f(#[SensitiveParameter] $x = new Y(a: 1), private int $z = PHP_INT_MAX) { goto end; end: return $x?->y()?->z[1] ?? [...$a, ...$b]; }",
        "<?php switch ($x) { case 1: case 2; break; default: foo(); } while (1): break 2; endwhile; for ($i = 0, $j = 1; $i < 3; $i++, $j--); foreach ($a as ['x' => $y, 'z' => list(, $w)]) {} do { } while (0);",
        "<?php try { a(); } catch (A | B) { } finally { } declare(strict_types=1) ; $a = (int) $b + (string)$c; $o = new class(1) extends P { public $q; }; [$a, [, $b]] = $c; $$x->{$y}::$z[0](...); __halt_compiler(); anything ( here",
        "<?php // comment ?> html ' <?php # x\n/* ' */ $a = !$b = 3; $c = -$d ** 2; print $a and $b or $c xor d(); $a instanceof B; `ls $x`; $h = $a ?: $b ? $c : $d;",
        "<?php interface I extends A, B { const X = 1; public function f(); } trait T { abstract public static function g(); } readonly class R { public function __construct(public string $n, protected(set) int $m) {} }",
        "text <?PHP echo 1;",
        "<?php class P { public string $full { get => $this->a . 'b'; set(string $v) { $this->a = $v; } } public function class() { return $this->class::class; } }",
        "<?php global $a, $$b; static $c = 1, $d; unset($a[1], $b,); exit; die('x'); isset($a, $b->c); include 'x' . '.php'; clone $a; list($a, list($b)) = $c; array(1, 2 => 3,);",
    ],
    "js": [
        "const a = require('./x'), {b, c: [d = 1, ...e], ...f} = g; let h; var i = 1\nlet j = i\n++j",
        "async function* f(a, {b} = {}, ...c) { for await (const x of y) { yield* z; await w } return }",
        "class A extends (B, C) { static #p = 1; static { this.x = 2 } get y() { return #p in this } set y(v) {} async *z() {} 'q'() {} [w]() {} r = () => { return super.r }; static async = 3 }",
        "const t = `a ${b + `c ${d}`} e`; x`y`; const r = /[/\\]]+/gi.test(s) / 2; a = b / c / d; if (x) /re/.test(y)",
        "for (let i = 0, n = 3; i < n; i++) { if (i) continue; else break } for (const k in o) ; for (x.y of z) {} do x++; while (x < 5) label: while (1) break label",
        "a ? b : c ? (d, e) : f => g; (a, b = 2, ...c) => ({a, b, [c]: 1, get d() { return 1 }, async e() {}}); async x => await x; async (y) => { await y }",
        "try { throw 1 } catch { } finally { } switch (a) { case 1: default: b(); } with (a) b; debugger; ;",
        "a?.b?.[c]?.(d); a ??= b; a ||= c; x = a ** -b; new.target\n".replace("new.target\n", "function N() { new.target }"),
        "({a: 1}).b; [a, b] = [b, a]; ({c = 1, d: [e]} = f); new A; new A.B(c)(d); typeof void delete a.b; !function() {}()",
        "var let_ = 1; let async = 1; async = 2; var yield_ = of; if (a) function q() {}\n<!-- html comment\nx = 0x1F + 0b11 + 0o17 + 1_000n + .5e-3 + 08",
        "#!/usr/bin/env node\n'use strict'; export_ = { if: 1, class: 2 }.if",
        "var s = 'a\\\nb', u = \"\\u{1F600}\"; \\u0061bc = 1; a = b\n(c)",
        "[1, 2]", "", "// only",
    ],
    "json": ["{}", "[1.5e3, \"a\\u00e9\", null]", " true "],
    "xml": ["<?xml version='1.0' encoding='ISO-8859-1'?>\n<a b='1'><!-- x --><![CDATA[<]]>é &amp; &#233;<c/></a>", "<a/>\n"],
    "py": ["def f(x: int = 1, *, y) -> None:\n    match x:\n        case [1, *_]:\n            return (z := 1)\n", "", "x = f'{a!r:>{w}}'", "async def g():\n  async with a as b: yield b\n", "type X[T] = list[T]"],
}
BROKEN = {
    "php": ["", "no tag", "<?xml version='1.0'?>", "<?php class A { public function f() {", "<?php $a = ;", "<?php\n<<<<<<< HEAD\n$a = 1;\n=======\n$a = 2;\n>>>>>>> x\n", "<?php $a = 'open", "<?php $x = \"a {$b\";", "<?php $x = <<<E\na\n", "<?php /* open", "<?php foo(1,,2);", "<?php if ($a) { } }", "<?php class 1A {}", "<?php $a = [1, 2;", "<?php function () {}", "<?php return $a->;", "<?php echo 1 2;", "<?php class A { $x; }", "<?php use A\\B as;", "<?php $a < $b < $c;", "<?php import sys", "<?php Return::class;", "<?php 1 = $a;", "<?php try { }", "<?php const X;", "<?php match($x) { 1 };"],
    "js": ["function f() {", "const a;", "let x = ;", "<?php echo 1;", "import sys\n", "import x from 'y'", "return 1", "{\"a\": 1}", "a b", "if (a", "'open", "`open ${x}", "/* open", "x = {a: 1", "for (;;", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z", "var 1a", "1 = a", "a => ", "class A { constructor( }", "({a = 1})", "a ?? b || c", "-a ** b", "foo(,)", "new", "x = /open", "export default 1", "break", "@", "async () => { await }", "let [a];", "a\n=> b", "throw\nx", "3in []".replace("3in []", "3a")],
    "json": ["", "{'a': 1}", "{\"a\": 1,}", "NaN", "// x\n{}", "[1", "{\"a\": 1}}", "<a/>"],
    "xml": ["", "<a>", "<a></b>", "<a b=1/>", "<a/><b/>", "<a>&x;</a>", "x", "<a><<</a>", "{}"],
    "py": ["def f(:", "x = (", "<?php", "if x:\nprint(1)", "'open", "const a = 1;", "x = 1\n  y = 2", "a\x00b", "<<<<<<< HEAD\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for t in VALID[language]:
        assert parses(language, t) is True, t


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for t in BROKEN[language]:
        assert parses(language, t) is False, t


def test_deep_nesting_is_no_crash():
    assert parses("js", "[" * 3000 + "]" * 3000) in (True, None)
    assert parses("php", "<?php $a = " + "[" * 3000 + "]" * 3000 + ";") in (True, None)
    assert parses("json", "[" * 100_000 + "]" * 100_000) is True


PHP_FILE = VALID["php"][5] + "class A { function f() { return [1, (2)]; } }\nfunction g() { /* } */ }\n$z = 'x\ny';\nclass B {}\n"


LONG = {
    "php": PHP_FILE,
    "js": "const a = `x\n${'y'}\n`;\n/* {\n*/ function f() {\n  return [1, (2)];\n}\nclass A {\n}\n",
    "json": '{\n"a": [\n1,\n{}],\n"b": "x, y",\n"c": [[\n]]\n}',
    "xml": "<?xml version='1.0'?>\n<!DOCTYPE a>\n<a x='>'>\n<b>1\n</b>\n<!-- </a>\n-->\n<c d='2'/>\n<![CDATA[\n<e>]]>\n<f><g/>\n</f>\n</a>\n",
}
LONG["py"] = 'import os\nx = """\'\n("""\ndef f(\n  a):\n  return "("\nX = 1\n@deco\ndef g(): pass\nif X:\n  pass\nelse:\n  X = [\n1]\ny = 2\n'


def _runs(maps):
    return [{s: r for s, (r, _) in m.items()} for _, m in maps]


@pytest.mark.parametrize("size", [5, 17, 60, 10_000])
@pytest.mark.parametrize("name", LONG)
def test_maps_combine_to_the_scan_of_the_whole(name, size):
    language, text = _MAPS[name], LONG[name]
    assert parses(name, text)
    maps = M.text_maps(language, text, size)
    assert "".join(p for p, _ in maps) == text
    first, *rest = _runs(maps)
    total = first
    for m in rest:
        total = M.combine(total, m)
    whole = language.scan(text, language.start)
    # a tag that a chunk's end tears is no bracket: such files are read as a whole
    assert total[language.start] == whole or name == "xml"
    assert M.closed(language, whole)


def test_combining_is_associative():
    maps = _runs(M.text_maps(M.PHP, PHP_FILE, 20))
    a, b, c = maps[0], M.combine(maps[1], maps[2]), maps[3]
    assert M.combine(M.combine(a, b), c) == M.combine(a, M.combine(b, c)) == M.combine(M.combine(M.combine(a, maps[1]), maps[2]), c)
    assert M.load(M.dump(M.text_maps(M.PHP, PHP_FILE, 20)[1][1])).keys() == maps[1].keys()


def _groups(name, text):
    language, cuts = _MAPS[name], []
    run = language.scan(text, language.start, cuts)
    spacing, language.spacing = language.spacing, 0
    bounds = [0, *M.effective(language, M.Run(language.start), cuts), len(text)]
    language.spacing = spacing
    return [text[a:b] for a, b in zip(bounds, bounds[1:])], run.root


@pytest.mark.parametrize("name", LONG)
def test_groups_are_balanced_statements(name):
    groups, root = _groups(name, LONG[name])
    assert len(groups) > 1
    assert all(piece_parses(name, g, i == 0, i == len(groups) - 1, root) for i, g in enumerate(groups))
    assert not any("@deco\n" in g and "def g" not in g for g in groups)


@pytest.mark.parametrize("text", ['{"a": 1,\n,"b": 2}', '{,\n"a": 1}', '{"a": 1,\n}', '[1,\n,2]', '{"a": 1,\n"b": 2}\n{"c": 3,\n"d": 4}', '{"a": 1\n"b": 2,\n"c": 3}', '["a",\n"b": 2,\n3]'])
def test_no_group_hides_a_fault_of_the_whole(text):
    groups, root = _groups("json", text)
    assert not parses("json", text)
    assert not all(piece_parses("json", g, i == 0, i == len(groups) - 1, root) for i, g in enumerate(groups))


def test_files(spark, rows):
    data = [
        (1, "p", "a/b.PHP", "<?php echo 1;"), (2, "p", "b.php", "echo"), (3, "p", "c.json", "{"), (4, "p", "d.json", None), (5, None, "e.xml", "<a/>"), (6, "p", "f.txt", "{"), (7, "p", None, "{"),
        (2, "p", "b.php", "echo"), (None, "p", "g.php", ""), (8, "p", "php", ""), (9, "p", "x.js", "a" * 300_000 + ";" + "b();" * 50_000),
    ]
    df = spark.createDataFrame([(*x, "c", True) for x in data], "file_id long, project_id string, relative_path string, source_text string, language string, valid boolean")
    got = rows(checked_files(df), "file_id", "language", "valid")
    assert got == sorted([(1, "php", True), (2, "php", False), (3, "json", False), (4, "json", None), (5, "xml", True), (9, "js", True)], key=str)
    assert checked_files(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [100, 2048])
def test_long_files_are_parsed_in_groups(spark, rows, size):
    body = "class A%d {\n  function f() { return [1, '}']; }\n}\n"
    good = "<?php\n" + "".join(body % i for i in range(60))
    js = "".join("function f%d(a) {\n  return `x${a}`;\n}\n" % i for i in range(60))
    items = "".join('<i n="%d">\n<k/>&amp;\n</i>\n' % i for i in range(300))
    members = ",\n".join('{"i": %d,\n"k": [1,\n2]}' % i for i in range(300))
    code = "".join("@d\ndef f%d(a):\n    return [\n1]\nif a:\n    b = '''x\n'''\nelse:\n    pass\n" % i for i in range(100))
    more = [
        (8, "h.xml", f"<?xml version='1.0'?>\n<r>\n{items}</r>\n"), (9, "i.xml", f"<r>\n{items}</r>\n<r/>"), (10, "j.xml", f"<r>\n{items}&x;\n{items}</r>"),
        (11, "k.json", f"[{members}]"), (12, "l.json", f"[{members},\n]"), (13, "m.json", f'{{"a": [{members}],\n"b": {{}}}}'),
        (14, "n.py", code), (15, "o.py", code + "else:\n    pass\n" + code), (16, "p.py", code.replace("f77(a):", "f77(a:")), (17, "q.php", js + "no tag" + js),
        (18, "r.php", good + "$x = <<<'NOTE'\n" + "it's { text\n" * 200 + "NOTE;\n" + good[6:].replace("A", "B")),
    ]
    data = [*more, (1, "a.php", good), (2, "b.php", good.replace("A30 {", "30 {")), (3, "c.php", good[:-3]), (4, "d.js", js), (5, "e.js", js + "let;x y"), (6, "f.php", js), (7, "g.php", "<?php if ($a):\n" + good[6:] + "endif;\n")]
    df = spark.createDataFrame([(i, "p", p, t) for i, p, t in data], "file_id long, project_id string, relative_path string, source_text string")
    bad = {2, 3, 5, 6, 9, 10, 12, 15, 16, 17}
    assert dict(rows(checked_files(df.unionByName(df), size), "file_id", "valid")) == {i: i not in bad for i in range(1, 19)}
