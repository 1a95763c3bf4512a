"""The lexer kernel: quote-aware scanning of PHP text in plain Python.

Everything rests on one scan that tells, for a stretch of text, which characters
are structure and which are inside string literals. The functions are pure and
take any text; UDFs in ``factmill.operators.extraction`` wrap them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = set(_OPEN.values())
# A string literal with escapes, running to the end of the text if it is never closed.
_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*+(?:'|\Z)|\"(?:[^\"\\]|\\.)*+(?:\"|\Z)", re.S)
_INTERESTING = re.compile(r"['\"()\[\]{},;=]")


def structure(text: str, start: int = 0) -> Iterator[tuple[int, str]]:
    """(place, character) of brackets, commas, semicolons and equals signs outside literals."""
    at = start
    while (m := _INTERESTING.search(text, at)) is not None:
        c = m.group()
        if c in "'\"":
            at = _LITERAL.match(text, m.start()).end()
        else:
            yield m.start(), c
            at = m.end()


def find_matching(text: str, open_at: int, opener: str, closer: str) -> int | None:
    """Place of the delimiter that closes the one at ``open_at``; None if it stays open."""
    depth = 0
    for at, c in structure(text, open_at):
        if c == opener:
            depth += 1
        elif c == closer:
            depth -= 1
            if depth <= 0:
                return at if not depth else None
    return None


def balanced_region(text: str, opener: str, closer: str) -> tuple[str, int, int] | None:
    """(inside, start, end) of the first balanced region; None if unbalanced or a closer leads."""
    for at, c in structure(text):
        if c == closer:
            return None
        if c == opener:
            end = find_matching(text, at, opener, closer)
            return None if end is None else (text[at + 1 : end], at, end)
    return None


def _top_level(text: str) -> Iterator[tuple[int, str]]:
    """Structure characters at bracket depth 0; brackets themselves are left out."""
    depth = 0
    for at, c in structure(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
        elif depth == 0:
            yield at, c


def split_top_level(text: str, delimiter: str) -> list[str]:
    """Parts between top-level delimiters, trimmed, empty ones dropped."""
    cuts = [at for at, c in _top_level(text) if c == delimiter]
    parts = [text[a:b].strip() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]
    return [p for p in parts if p]


def split_key_value(text: str) -> tuple[str, str] | None:
    """Key and value around the first top-level ``=>``."""
    for at, c in _top_level(text):
        if c == "=" and text.startswith("=>", at):
            return text[:at].strip(), text[at + 2 :].strip()
    return None


def strip_php_string(text: str) -> str | None:
    """The inside of a text in matching outer quotes."""
    t = text.strip()
    return t[1:-1] if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"" else None


def string_literal(text: str, start: int) -> tuple[str, int] | None:
    """(value, end) of the literal that begins at ``start`` after blanks; escapes lose their backslash."""
    at = start + len(text[start:]) - len(text[start:].lstrip(" \t\r\n\f"))
    m = _LITERAL.match(text, at)
    if m is None or len(m.group()) < 2 or m.group()[-1] != m.group()[0]:
        return None
    return re.sub(r"\\(.)", r"\1", m.group()[1:-1], flags=re.S), m.end()


def method_body(source: str, name: str) -> str | None:
    """Inside of the braces of the first textual ``function name(``."""
    m = re.search(rf"function\s+{re.escape(name)}\s*\(", source)
    brace = source.find("{", m.end()) if m else -1
    found = balanced_region(source[brace:], "{", "}") if brace >= 0 else None
    return found[0] if found else None


def return_array(body: str) -> str | None:
    """Inside of the first ``return [ ... ]``."""
    m = re.search(r"return\s+\[", body)
    found = balanced_region(body[m.end() - 1 :], "[", "]") if m else None
    return found[0] if found else None


def array_property(source: str, name: str) -> str | None:
    """Inside of ``public|protected|private $name = [ ... ]`` (untyped)."""
    m = re.search(rf"(?:public|protected|private)\s+\${re.escape(name)}\s*=\s*\[", source)
    found = balanced_region(source[m.end() - 1 :], "[", "]") if m else None
    return found[0] if found else None


_COMMENT = re.compile(r"('(?:[^'\\]|\\.)*+(?:'|\Z)|\"(?:[^\"\\]|\\.)*+(?:\"|\Z))|//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


def strip_comments(text: str) -> str:
    """Text without ``//``, ``#`` and ``/* */`` comments; string literals stay."""
    return _COMMENT.sub(lambda m: m.group(1) or "", text)


def statement_expression(text: str) -> str | None:
    """Text up to the first top-level semicolon."""
    return next((text[:at].strip() for at, c in _top_level(text) if c == ";"), None)


def invocation_arguments(expression: str) -> list[str] | None:
    """Top-level arguments of the first call in an expression."""
    found = balanced_region(expression, "(", ")")
    return split_top_level(found[0], ",") if found else None


def function_call(expression: str) -> tuple[str, list[str]] | None:
    """(name, arguments) where the whole expression is one call."""
    m = re.match(r"\s*([A-Za-z_\\][A-Za-z0-9_:\\]*)\s*\(", expression)
    end = find_matching(expression, m.end() - 1, "(", ")") if m else None
    if end is None or expression[end + 1 :].strip():
        return None
    return m.group(1), split_top_level(expression[m.end() : end], ",")


def find_call(text: str, name: str) -> tuple[int, int] | None:
    """(start of the arguments, their end) of the first real call of ``name``: not in a comment, a string or a longer name."""
    for m in re.finditer(rf"{_COMMENT.pattern}|(?<![A-Za-z0-9_\\$>:]){re.escape(name)}\s*\(", text, re.S):
        if m.group().startswith(name):
            end = find_matching(text, m.end() - 1, "(", ")")
            return None if end is None else (m.end(), end)
    return None


@dataclass
class ClassBlock:
    name: str
    text: str
    methods: list[tuple[str, str]] = field(default_factory=list)


# Words of code outside comments, strings and heredocs.
_WORDS = re.compile(
    r"(?P<skip>//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|<<<[ \t]*(?P<q>['\"]?)(?P<label>\w+)(?P=q)\r?\n.*?^[ \t]*(?P=label)\b|'(?:[^'\\]|\\.)*+(?:'|\Z)|\"(?:[^\"\\]|\\.)*+(?:\"|\Z)|`(?:[^`\\]|\\.)*+(?:`|\Z))"
    r"|(?P<var>\$[A-Za-z_]\w*|(?:->|::)\s*[A-Za-z_]\w*)|(?P<word>\\?[A-Za-z_][\w\\]*)|(?P<mark>[{}();,\[\]])",
    re.S | re.M,
)
_MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "readonly", "var"}


def class_blocks(source: str) -> list[ClassBlock]:
    """Every named class of a file, at any depth, with its direct methods and their whole text.

    Traits, interfaces, enums and anonymous classes are none. A method's text runs
    from its first modifier to its closing brace or semicolon, without what is
    said before it in comments. What stays open at the end of a text ends there.
    """
    tokens = [(m.lastgroup if m.lastgroup not in ("q", "label") else "skip", m.group(), m.start(), m.end()) for m in _WORDS.finditer(source)]
    tokens = [t for t in tokens if t[0] != "skip"]
    done: list[tuple[int, ClassBlock]] = []
    # open scopes: (kind, name, start, class it belongs to)
    scopes: list[tuple[str, ClassBlock | None, str, int]] = []
    pending: tuple[str, str, int] | None = None
    first: int | None = None  # where the modifiers of a member begin
    round_depth = 0
    for k, (kind, word, start, end) in enumerate(tokens):
        owner = scopes[-1][1] if scopes and scopes[-1][0] == "class" else None
        if kind == "word":
            low = word.lower()
            previous = tokens[k - 1][1].lower() if k else ""
            following = tokens[k + 1] if k + 1 < len(tokens) else ("", "", 0, 0)
            if low in _MODIFIERS:
                if first is None:
                    first = start
                continue
            if low == "class" and previous != "new" and following[0] == "word" and not round_depth:
                begins = first if first is not None else start
                pending = ("class", following[1], begins)
            elif low == "function" and owner is not None and not round_depth and pending is None:
                name = following if following[0] == "word" else tokens[min(k + 2, len(tokens) - 1)]
                pending = ("method", name[1], first if first is not None else start)
            elif pending is None:
                if low not in ("const", "function", "class"):
                    first = None if owner is None else first
        elif kind == "mark":
            if word == "(":
                round_depth += 1
            elif word == ")":
                round_depth = max(0, round_depth - 1)
            elif word == "{":
                if pending and pending[0] == "class":
                    block = ClassBlock(pending[1], "")
                    done.append((pending[2], block))
                    scopes.append(("class", block, pending[1], pending[2]))
                elif pending:
                    scopes.append(("method", owner, pending[1], pending[2]))
                else:
                    scopes.append(("block", None, "", start))
                pending, first, round_depth = None, None, 0
            elif word == "}":
                if scopes:
                    what, of, name, begins = scopes.pop()
                    if what == "class":
                        of.text = source[begins:end]
                    elif what == "method" and of is not None:
                        of.methods.append((name, source[begins:end]))
                pending, first, round_depth = None, None, 0
            elif word == ";" and not round_depth:
                if pending and pending[0] == "method" and owner is not None:
                    owner.methods.append((pending[1], source[pending[2] : end]))
                pending, first = None, None
    for what, of, name, begins in reversed(scopes):
        if what == "class":
            of.text = source[begins:]
        elif what == "method" and of is not None:
            of.methods.append((name, source[begins:]))
    return [b for _, b in sorted(done, key=lambda x: x[0])]


_PARAMETER = re.compile(r"\$([A-Za-z_][A-Za-z0-9_]*)")


def broadcast_calls(source: str) -> list[tuple[str, list[str]]]:
    """(channel, callback parameters) of every ``Broadcast::channel('...', function (...) {...})``.

    The callback is the next ``function`` of the text; calls whose channel is no
    literal or whose callback stays open are left out.
    """
    out, at, marker = [], 0, "Broadcast::channel("
    while (call := source.find(marker, at)) >= 0:
        at = call + len(marker)
        name = string_literal(source, at)
        if name is None:
            continue
        at = name[1]
        word = source.find("function", at)
        opens = source.find("(", word) if word >= 0 else -1
        if opens < 0:
            continue
        closes = find_matching(source, opens, "(", ")")
        brace = source.find("{", closes) if closes is not None else -1
        ends = find_matching(source, brace, "{", "}") if brace >= 0 else None
        if ends is None:
            at = opens + 1
            continue
        out.append((name[0], _PARAMETER.findall(source[opens + 1 : closes])))
        at = ends + 1
    return out
