"""A streaming JSON reader: one pass over the text, no tree, no recursion.

``leaves`` turns a record into (path, value) pairs, a path being a tuple of keys
and array ordinals. It accepts exactly the JSON of RFC 8259 (no NaN, no comments,
no trailing comma), at any nesting depth. Of repeated keys the last one holds.
Half a surrogate pair becomes U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*+")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*+)(\.[0-9]++)?([eE][+-]?[0-9]++)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


class NotJson(ValueError):
    pass


class Empty:
    """Value of an empty container: ``kind`` is ``{}`` or ``[]``."""

    __slots__ = ("kind",)

    def __init__(self, kind: str):
        self.kind = kind


EMPTY_OBJECT, EMPTY_ARRAY = Empty("{}"), Empty("[]")


def events(text: str) -> Iterator[tuple[tuple, object]]:
    """(path, scalar or Empty) of every leaf in text order; raises NotJson, possibly after some leaves."""
    space, scalar = _SPACE.match, _SCALAR.match
    n, i = len(text), space(text, 0).end()
    path: list = []  # the open containers' current key or ordinal
    kinds: list[bool] = []  # True: object
    value_next = True
    while True:
        if value_next:
            if i >= n:
                raise NotJson("ends before a value")
            c = text[i]
            if c == '"':
                v, i = _string(text, i)
                yield tuple(path), v
            elif c == "{" or c == "[":
                i = space(text, i + 1).end()
                if i < n and text[i] == ("}" if c == "{" else "]"):
                    i += 1
                    yield tuple(path), EMPTY_OBJECT if c == "{" else EMPTY_ARRAY
                elif c == "[":
                    path.append(0)
                    kinds.append(False)
                    continue
                else:
                    path.append(None)
                    kinds.append(True)
                    i = _key(text, i, n, path)
                    continue
            else:
                m = scalar(text, i)
                if m is None:
                    raise NotJson(f"no value at {i}")
                i = m.end()
                if m.group(1) is None:
                    v = _WORDS[m.group()]
                elif m.group(2) or m.group(3):
                    v = float(m.group())
                else:
                    v = m.group() if m.end() - m.start() > 4000 else int(m.group())
                yield tuple(path), v
        i = space(text, i).end()
        if not path:
            if i < n:
                raise NotJson(f"text after the value at {i}")
            return
        if i >= n:
            raise NotJson("ends inside a container")
        c = text[i]
        if c == ",":
            i = space(text, i + 1).end()
            if kinds[-1]:
                i = _key(text, i, n, path)
            else:
                path[-1] += 1
            value_next = True
        elif c == ("}" if kinds[-1] else "]"):
            path.pop()
            kinds.pop()
            i += 1
            value_next = False
        else:
            raise NotJson(f"unexpected {c!r} at {i}")


def _string(text: str, i: int) -> tuple[str, int]:
    try:
        v, i = scanstring(text, i + 1, True)
    except ValueError as e:
        raise NotJson(str(e)) from None
    if not v.isascii():
        try:
            v.encode()
        except UnicodeEncodeError:  # half a surrogate pair, which no table can hold
            v = v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return v, i


def _key(text: str, i: int, n: int, path: list) -> int:
    if i >= n or text[i] != '"':
        raise NotJson(f"no key at {i}")
    path[-1], i = _string(text, i)
    i = _SPACE.match(text, i).end()
    if i >= n or text[i] != ":":
        raise NotJson(f"no colon at {i}")
    return _SPACE.match(text, i + 1).end()


def is_json(text: str) -> bool:
    try:
        for _ in events(text):
            pass
    except NotJson:
        return False
    return True


def _looks_nested(v: object) -> bool:
    return isinstance(v, str) and v.lstrip(" \t\n\r")[:1] in ("{", "[", '"')


def _constant(word: str) -> None:
    raise NotJson(word)


# A number too long for int() stays a text; the scanner leaves NaN and the like to parse_constant.
_DECODER = json.JSONDecoder(parse_constant=_constant, parse_int=lambda t: t if len(t) > 4000 else int(t))


def _sound(v: str) -> str:
    """Half a surrogate pair, which no table can hold, becomes U+FFFD."""
    try:
        v.encode()
        return v
    except UnicodeEncodeError:
        return v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parsed(text: str) -> tuple[bool, object]:
    """(whether the text is whole JSON, its value)."""
    try:
        if text.startswith("\ufeff"):
            return False, None
        return True, _DECODER.decode(text)
    except ValueError:
        return False, None
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> tuple[bool, object]:
    """The tree of a record nested too deep for the C scanner, put together from the streaming reader's leaves."""
    box: dict = {}
    try:
        for path, v in events(text):
            at, key = box, ""
            for step in path:
                if type(at.get(key)) is not dict:
                    at[key] = {}
                at, key = at[key], step
            at[key] = {} if v is EMPTY_OBJECT else [] if v is EMPTY_ARRAY else v
    except NotJson:
        return False, None
    # Ordinals are numbers, keys are texts: what is numbered becomes a list, the deepest first.
    nodes: list[tuple[dict, object]] = [(box, "")]
    for at, key in nodes:
        if type(at[key]) is dict:
            nodes.extend((at[key], k) for k in at[key])
    for at, key in reversed(nodes):
        v = at[key]
        if type(v) is dict and v and type(next(iter(v))) is int:
            at[key] = list(v.values())
    return True, box[""]


def tree(text: str) -> tuple[bool, object]:
    """(whether the text is whole JSON, its value), strings that hold an object or array being read in their place."""
    found, root = parsed(text)
    if not found:
        return False, None
    box = [root]
    todo: list = [box]
    while todo:
        v = todo.pop()
        pairs = enumerate(v) if type(v) is list else list(v.items())
        for k, x in pairs:
            if type(x) is str:
                if x[:1] in _OPENERS and (x.lstrip(" \t\n\r")[:1] in ("{", "[", '"')):
                    x = v[k] = _inner(x)
                if type(x) is str:
                    if not x.isascii():
                        v[k] = _sound(x)
                    continue
            if type(x) is dict or type(x) is list:
                todo.append(x)
        if type(v) is dict and not all(map(str.isascii, v)):
            fixed = {_sound(k): x for k, x in v.items()}
            v.clear()
            v.update(fixed)
    return True, box[0]


_OPENERS = ("{", "[", '"', " ", "\t", "\n", "\r")


def _inner(text: str) -> object:
    """The object or array that a string leads to, at any number of wrappings; else the string."""
    v: object = text
    while type(v) is str and v.lstrip(" \t\n\r")[:1] in ("{", "[", '"'):
        found, v = parsed(v)
        if not found:
            return text
    return v if type(v) is dict or type(v) is list else text


def leaves(text: str | None, embedded: bool = True) -> list[tuple[tuple, object]]:
    """(path, value) of every leaf; nothing where the text is null or isn't whole JSON.

    With ``embedded`` a string that itself holds a JSON object, array or string
    is read on in its place, at any number of wrappings.
    """
    if text is None:
        return []
    try:
        found = list(events(text))
    except NotJson:
        return []
    if not embedded:
        return found
    out: list[tuple[tuple, object]] = []
    todo = found[::-1]
    while todo:
        path, v = todo.pop()
        if _looks_nested(v):
            try:
                inner = list(events(v))
            except NotJson:
                inner = []
            # a JSON string inside a string counts only if it leads to a container
            if inner and (len(inner) > 1 or inner[0][0] or not isinstance(inner[0][1], str) or _looks_nested(inner[0][1])):
                todo.extend((path + p, x) for p, x in reversed(inner))
                continue
        out.append((path, v))
    return out
