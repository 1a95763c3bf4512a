"""Chunks of a source file as lexer-state maps with bracket summaries.

A chunk maps every state a lexer may be in at its start to the state at its end,
with the brackets it leaves open and those it closes from before. Two chunks
combine to one map; combining is associative, so chunks are reduced in any
grouping. From the reduced prefixes each chunk's true start state and depth
follow, and the file falls into groups of balanced statements.

Chunks end at line ends, where no token but a string, comment, template or
heredoc can be cut. The maps are coarse where a language nests code in strings:
they place cuts and never decide by themselves that a file is bad. The first
chunk of a file can start in one state only, so its map has that one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

CHUNK_CHARS = 2_048
_PAIR = {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Run:
    """What a chunk does from one start state: end state, brackets closed from before and left open, broken if they mismatch.

    ``root`` is the first bracket that it opens.
    """

    end: str
    closes: tuple = ()
    opens: tuple = ()
    broken: bool = False
    root: str | None = None

    def then(self, other: Run) -> Run:
        opens, closes = list(self.opens), list(self.closes)
        broken = self.broken or other.broken
        for k, c in enumerate(other.closes):
            if not opens:
                closes.extend(other.closes[k:])
                break
            broken = opens.pop() != _PAIR.get(c, c) or broken
        return Run(other.end, tuple(closes), (*opens, *other.opens), broken, other.root if self.root is None else self.root)

    @staticmethod
    def read(v: list) -> Run:
        return Run(v[0], tuple(v[1]), tuple(v[2]), v[3], v[4])

    def plain(self) -> list:
        return [self.end, self.closes, self.opens, self.broken, self.root]


class Language:
    """A flat lexer: of each state the regex of what matters in it.

    ``cut`` tells in code where a group of statements may end, at bracket depth
    ``level``; ``veto`` takes back cuts by the text before them. Groups are not
    made shorter than ``spacing`` on purpose.
    """

    def __init__(self, start: str, finals: set[str], states: dict[str, str], cut: str, level: int = 0, spacing: int = 0, veto: Callable[[str, int], bool] | None = None):
        self.start, self.finals, self.level, self.spacing, self.veto = start, finals, level, spacing, veto
        self.heredocs = "?P<here>" in "".join(states.values())
        self.states = {s: re.compile(r, re.S | re.I | re.M) for s, r in states.items()}
        self.cut = re.compile(cut)

    def scan(self, text: str, state: str, cuts: list[tuple[int, int]] | None = None) -> Run:
        """Run over a chunk; places and depths, relative to the start, where code may be cut are added to ``cuts``."""
        opens: list[str] = []
        closes: list[str] = []
        broken, pos, n, depth, root = False, 0, len(text), 0, None
        while True:
            if state.startswith("here:"):
                m = re.compile(rf"^[ \t]*{re.escape(state[5:])}(?![A-Za-z0-9_\x80-\U0010ffff])", re.M).search(text, pos)
                if m is None:
                    break
                state, pos = "code", m.end()
                continue
            m = self.states[state].search(text, pos)
            if cuts is not None and state == "code":
                for c in self.cut.finditer(text, pos, m.start() if m else n):
                    if c.end() < n and not (self.veto and self.veto(text, c.start())):
                        cuts.append((c.end(), depth))
            if m is None:
                break
            kind, pos = m.lastgroup, m.end()
            if kind == "open":
                opens.append(m.group("open"))
                root = opens[-1] if root is None else root
                depth += 1
            elif kind == "close":
                depth -= 1
                c = m.group("close")
                if opens:
                    broken = opens.pop() != _PAIR.get(c, c) or broken
                else:
                    closes.append(c)
            elif kind == "here":
                state = "here:" + m.group("here").strip("\"'")
            elif kind is not None:
                state = kind[3:]
        return Run(state, tuple(closes), tuple(opens), broken, root)


_STRINGS = r"'(?:[^'\\\r\n]|\\.)*+'|\"(?:[^\"\\\r\n]|\\.)*+\""


def _behind(declares: str) -> str:
    return rf"(?m)(?<=[;}}])[ \t]*(?:\r\n|\n|\r)\s*(?=(?:{declares})\b)"


PHP = Language(
    "html",
    {"html", "code"},
    {
        "html": r"(?P<to_code><\?(?:php(?=\s|\Z)|=))",
        "code": r"(?://|\#(?!\[))(?:(?!\?>)[^\r\n])*+|(?P<to_bc>/\*)|(?P<to_html>\?>)|<<<[ \t]*(?P<here>\"\w+\"|'\w+'|[^\W\d]\w*)(?=[\r\n])|'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\{]|\\.|\{\$[^{}]*+\}|\{)*+\"|(?P<to_sq>')|(?P<to_dq>\")|(?P<open>[(\[{])|(?P<close>[)\]}])",
        "bc": r"(?P<to_code>\*/)",
        "sq": r"\\.|(?P<to_code>')",
        "dq": r"\\.|\{\$[^{}]*+\}|(?P<to_code>\")",
    },
    _behind("abstract|final|class|interface|trait|enum|function|use"),
    spacing=512,
)
JS = Language(
    "code",
    {"code"},
    {
        "code": rf"//[^\r\n]*+|(?P<to_bc>/\*)|{_STRINGS}|`(?:[^`\\]|\\.)*+`|(?P<to_tpl>`)|(?<=[(,=:\[!&|?{{}};+\-*%~^<>\n])[ \t]*/(?![*/])(?:[^\r\n\\/\[]|\\.|\[(?:[^\r\n\\\]]|\\.)*+\])++/|(?P<open>[(\[{{])|(?P<close>[)\]}}])",
        "bc": r"(?P<to_code>\*/)",
        "tpl": r"\\.|(?P<to_code>`)",
    },
    _behind("class|function|async function|const|let|var"),
    spacing=512,
)
JSON = Language("code", {"code"}, {"code": r'"(?:[^"\\\r\n]|\\.)*+"|(?P<open>[\[{])|(?P<close>[\]}])'}, r",\s*", level=1, spacing=512)
_NAME = r"[^\s<>/!?=\"'&;]++"
_ATTRIBUTES = r"(?:[^<>\"'/]|\"[^\"]*+\"|'[^']*+'|/(?!>))*+"
XML = Language(
    "code",
    {"code"},
    {
        # what is torn at a chunk's end is no final state: such files are read as a whole
        "code": rf"(?P<to_comment><!--)|(?P<to_cdata><!\[CDATA\[)|(?P<to_pi><\?)|<!DOCTYPE[^\[>]*+>|(?P<to_doctype><!DOCTYPE)|</(?P<close>{_NAME})\s*+>|<{_NAME}(?:\s{_ATTRIBUTES})?/>|<(?P<open>{_NAME})(?:\s{_ATTRIBUTES})?>|(?P<to_torn><)",
        "comment": r"(?P<to_code>-->)",
        "cdata": r"(?P<to_code>\]\]>)",
        "pi": r"(?P<to_code>\?>)",
        "doctype": r"(?P<to_code>\]\s*>)",
        "torn": r"(?!)",
    },
    r"(?<=>)\s*[\r\n]\s*",
    level=1,
    spacing=512,
)


def _decorated(text: str, at: int) -> bool:
    """Whether the line that ends here is a decorator, which belongs to what follows."""
    return text[max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1 :][:1] == "@"


PYTHON = Language(
    "code",
    {"code"},
    {
        "code": r"\#[^\r\n]*+|(?P<to_tdq>\"\"\")|(?P<to_tsq>''')|'(?:[^'\\\r\n]|\\.)*+'|\"(?:[^\"\\\r\n]|\\.)*+\"|(?P<to_torn>['\"])|(?P<open>[(\[{])|(?P<close>[)\]}])",
        "tdq": r"\\.|(?P<to_code>\"\"\")",
        "tsq": r"\\.|(?P<to_code>''')",
        "torn": r"(?!)",
    },
    r"(?<!\\)(?:\r\n|\n|\r)(?=(?!(?:else|elif|except|finally)\b)[A-Za-z_@])",
    spacing=512,
    veto=_decorated,
)
_LABEL = re.compile(r"<<<[ \t]*[\"']?(\w+)")


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """The text cut behind line ends that no backslash precedes, every ``size`` characters or later."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        end = at + size
        while True:
            end = text.find("\n", end) + 1
            if not end or not text[max(at, end - 3) : end].rstrip("\r\n").endswith("\\"):
                break
        if not end or end >= n:
            break
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def states_of(language: Language, text: str) -> list[str]:
    """All states of a text, heredocs being one per label that it may open."""
    return [*language.states, *(["here:" + x for x in sorted(set(_LABEL.findall(text)))] if language.heredocs else [])]


def state_map(language: Language, chunk: str, states: list[str]) -> dict[str, tuple[Run, list[tuple[int, int]]]]:
    """The chunk's map: for every state it may start in a run, and where it may be cut."""
    out = {}
    for s in states:
        cuts: list[tuple[int, int]] = []
        out[s] = language.scan(chunk, s, cuts), cuts
    return out


def text_maps(language: Language, text: str, size: int = CHUNK_CHARS) -> list[tuple[str, dict]]:
    """(chunk, map) of all chunks of a text."""
    parts = chunks(text, size)
    states = states_of(language, text) if len(parts) > 1 else []
    return [(p, state_map(language, p, states if i else [language.start])) for i, p in enumerate(parts)]


def combine(a: dict[str, Run], b: dict[str, Run]) -> dict[str, Run]:
    """The map of two adjacent chunks; associative."""
    return {s: r.then(b[r.end]) for s, r in a.items()}


def closed(language: Language, run: Run) -> bool:
    return run.end in language.finals and not run.broken and not run.opens and not run.closes


def effective(language: Language, before: Run, cuts: list[tuple[int, int]]) -> list[int]:
    """Those of a chunk's cuts that lie at the language's level, ``spacing`` apart."""
    out: list[int] = []
    for at, depth in cuts:
        if depth + len(before.opens) == language.level and at and (not out or at - out[-1] >= language.spacing):
            out.append(at)
    return out


def dump(m: dict) -> str:
    return json.dumps({s: [r.plain(), c] for s, (r, c) in m.items()}, separators=(",", ":"))


def load(text: str) -> dict[str, tuple[Run, list]]:
    return {s: (Run.read(r), c) for s, (r, c) in json.loads(text).items()}
