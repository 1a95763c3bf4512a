import json

from factmill.functions.jsonstream import NotJson, events, is_json, leaves
from factmill.operators.flatten import KEYED, controller_rows, item_rows, method_rows, pivot_group, record_triples, triples, usage_rows, usage_triples, usages

CAMEL = {
    "delta": {
        "meta": {"rules": ["no"]},
        "modules": [
            {
                "controllers": [
                    {
                        "class": "A",
                        "methods": [
                            {"name": "index", "requestUsage": [{"method": "only", "rules": ["x", None, "y"]}, {"rules": "z"}], "scopesUsed": ["s", {"name": "t"}, {"name": None}], "resourceUsage": {"class": "R"}},
                            {"name": "show", "request_usage": json.dumps([{"rules": ["j"]}]), "scopes_used": None, "resource_usage": [None, {"class": "Q"}]},
                        ],
                    }
                ]
            }
        ],
        "controllers": [{"methods": {"destroy": {"requestUsage": {"rules": ["k", 5, "l"]}}}, "class": "B"}],
        "models": [{"scopesUsed": [{"name": "no"}], "rules": ["no"]}],
    }
}
EXPECTED = [
    ("A", "index", "resource", 0, 0, "R"),
    ("A", "index", "rule", 0, 0, "x"),
    ("A", "index", "rule", 0, 2, "y"),
    ("A", "index", "rule", 1, 0, "z"),
    ("A", "index", "scope", 0, 0, "s"),
    ("A", "index", "scope", 1, 0, "t"),
    ("A", "show", "resource", 1, 0, "Q"),
    ("A", "show", "rule", 0, 0, "j"),
    ("B", "destroy", "rule", 0, 0, "k"),
    ("B", "destroy", "rule", 0, 2, "l"),
]


def test_usages(spark, rows):
    text = json.dumps(CAMEL)
    data = [(1, text, "t"), (1, text, "t"), (2, json.dumps(text), "t"), (3, text[:-1], "t"), (4, None, "t"), (5, "", "t"), (6, "[]", "t"), (None, text, "t"), (7, "not json", "t"), (8, '{"controllers": NaN}', "t")]
    got = rows(usages(spark.createDataFrame(data, "delta_id long, payload string, text string")))
    assert got == sorted([(d, *x) for d in (1, 2) for x in EXPECTED], key=str)


def test_usages_of_nothing(spark):
    assert usages(spark.createDataFrame([], "delta_id long, payload string")).collect() == []


def _walk(v, at=()):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from _walk(x, (*at, k))
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from _walk(x, (*at, i))
    else:
        yield at, v


def test_leaves_are_those_of_the_tree():
    value = {"a": [1, [2.5, {"b": None}], "x\né"], "c": {"d": True}, "e": -0.1e3}
    assert leaves(json.dumps(value), embedded=False) == list(_walk(value))


def test_only_whole_json_counts():
    for bad in ('{"a":1', "{'a':1}", "[1,]", "[1 2]", "01", "1.", "NaN", "nul", '"\t"', '"a', "{} {}", "", '{"a" 1}', '{"a":}', "{1:2}", "]", "[1}", "﻿{}"):
        assert not is_json(bad), bad
        assert leaves(bad) == []
    for good in ("1", " -0.5e+3 ", '"a\\u00e9\\n"', "[]", "{}", '{"a":[{}]}', "null"):
        assert is_json(good), good


def test_any_depth():
    deep = "[" * 200_000 + "]" * 200_000
    assert is_json(deep) and not is_json(deep[:-1])
    assert len(list(events('{"a":' * 50_000 + "1" + "}" * 50_000))) == 1


def test_a_string_in_quotes_stays_a_string():
    assert leaves('{"a": "\\"x\\"", "b": "[1", "c": "[1]"}') == [(("a",), '"x"'), (("b",), "[1"), (("c", 0), 1)]


def test_triples_and_pivot(spark, rows):
    df = spark.createDataFrame([(1, '{"o": [{"id": "a", "n": [1, 2]}, {"id": "b"}]}'), (1, '{"o": [{"id": "a", "n": [1, 2]}, {"id": "b"}]}'), (2, None), (3, "{")], "k long, t string")
    found = triples(df, "k", "t")
    top = pivot_group(found, r"o\.\[\]", {"id": "id"})
    assert rows(top, "record_id", "ordinals", "id") == [(1, [0], "a"), (1, [1], "b")]
    inner = pivot_group(found, r"o\.\[\]\.n\.\[\]", {"n": ""}, {"o": r"o\.\[\]"})
    assert rows(inner, "ordinals", "o_path", "o_ordinals", "n") == [([0, 0], "o.[]", [0], "1"), ([0, 1], "o.[]", [0], "2")]


def test_record_triples():
    got = record_triples('{"methods": {"a.b": {"x": [true, {}]}, "@key": 3}, "[]": null, "n": "{\\"methods\\": {\\"name\\": \\"m\\"}}", "d": 1, "d": 2}', KEYED)
    want = [
        ("methods.{}.@key", (0,), "a.b"), ("methods.{}.@key", (1,), "@key"), ("methods.{}.x.[]", (0, 0), True), ("methods.{}.x.[]", (0, 1), "{}"), ("methods.{}", (1,), 3),
        ("\\[\\]", (), None), ("n.methods.name", (), "m"), ("n.methods.@key", (), "m"), ("d", (), 2),
    ]
    assert sorted(((p, o, getattr(v, "kind", v)) for p, o, v in got), key=str) == sorted(want, key=str)
    assert record_triples("3") == [("", (), 3)] and record_triples(None) == [] and record_triples("{") == []


def test_deep_records_give_triples():
    n = 30_000
    text = '{"a":' + "[" * n + '"x",1' + "]" * n + "}"
    (path, at, v), (_, last, w) = sorted(record_triples(text), key=lambda r: r[1])
    assert path == "a" + ".[]" * n and at == (0,) * n and v == "x" and last == (0,) * (n - 1) + (1,) and w == 1
    assert record_triples(text[:-1]) == []


def test_tables(spark, rows):
    found = usage_triples(spark.createDataFrame([(1, json.dumps(CAMEL)), (1, json.dumps(CAMEL))], "delta_id long, payload string"))
    assert rows(controller_rows(found), "ordinals", "class") == sorted([([0, 0], "A"), ([0], "B")], key=str)
    assert rows(method_rows(found), "controller_ordinals", "name") == sorted([([0, 0], "index"), ([0, 0], "show"), ([0], "destroy")], key=str)
    assert rows(usage_rows(found), "kind", "usage_pos", "method", "class", "name") == sorted(
        [("rule", 0, "only", None, None), ("scope", 0, None, None, "s"), ("scope", 1, None, None, "t"), ("resource", 0, None, "R", None), ("resource", 1, None, "Q", None)], key=str
    )
    assert item_rows(found).count() == len(EXPECTED)


def test_half_surrogates_do_not_break_tables(spark, rows):
    df = spark.createDataFrame([(1, '{"a": "x\\ud800y", "\\udc00": "\\ud83d\\ude00"}')], "k long, t string")
    assert rows(triples(df, "k", "t"), "path", "value") == [("a", "x\ufffdy"), ("\ufffd", "\U0001f600")]


def test_events_raise():
    try:
        list(events("[1"))
    except NotJson:
        return
    raise AssertionError
