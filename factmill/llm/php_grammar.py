"""PHP 8: does a source text parse? A lexer and a recursive-descent grammar, syntax only."""

from __future__ import annotations

import re


class BadSyntax(Exception):
    pass


_W = r"A-Za-z0-9_\x80-\U0010ffff"
_I = r"A-Za-z_\x80-\U0010ffff"
_TOKEN = re.compile(
    rf"""[ \t\r\n]*+(?:(?P<ws>\Z)
|(?P<lc>(?://|\#(?!\[))(?:(?!\?>)[^\r\n])*+)
|(?P<bc>/\*(?:[^*]|\*(?!/))*+\*/)
|(?P<var>\$[{_I}][{_W}]*+)
|(?P<here><<<[ \t]*(?:"[{_I}][{_W}]*"|'[{_I}][{_W}]*'|[{_I}][{_W}]*)(?:\r\n|\r|\n))
|(?P<bs>[bB]?'(?:[^'\\]|\\.)*+')
|(?P<dq>[bB]?"(?:[^"\\${{]|\\.|\$(?![{_I}{{])|\{{(?!\$))*+")
|(?P<dqi>[bB]?")
|(?P<id>\\?[{_I}][{_W}]*+(?:\\[{_I}][{_W}]*+)*+(?:\\(?=[ \t\r\n]*+\{{))?)
|(?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*+|0[bB][01]+(?:_[01]+)*+|0[oO][0-7]+(?:_[0-7]+)*+|(?:[0-9]+(?:_[0-9]+)*+(?:\.(?:[0-9]+(?:_[0-9]+)*+)?)?|\.[0-9]+(?:_[0-9]+)*+)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*+)?)
|(?P<close>\?>(?:\r\n|\n|\r)?)
|(?P<cast>\([ \t]*(?:int|integer|float|double|real|string|binary|bool|boolean|array|object|unset)[ \t]*\))
|(?P<op><<=|>>=|\*\*=|\.\.\.|<=>|===|!==|\?\?=|\?->|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\#\[|[-+*/%=<>!.&|^~?:;,@(){{}}\[\]$`]))""",
    re.X | re.S | re.I,
)
_OPEN = re.compile(r"<\?(?:php(?=[ \t\r\n]|\Z)|=)", re.I)
_SIMPLE = re.compile(rf"\$[{_I}][{_W}]*+(?:\[(?:[{_I}][{_W}]*+|-?[0-9]+(?:x[0-9a-f]+)?|\$[{_I}][{_W}]*+)\]|(\[)|\??->[{_I}][{_W}]*+)?", re.I)
_PLAIN = {d: re.compile(rf"(?:[^\\${{{d}]|\\.|\$(?![{_I}{{])|\{{(?!\$))*+", re.S) for d in ('"', "`")}
_BODY = re.compile(rf"(?:[^\\${{]|\\.|\$(?![{_I}{{])|\{{(?!\$))*+", re.S)

# Reserved words, which name no function, class or constant.
RESERVED = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit die extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield".split()
)


class Lexer:
    """Tokens of a text as parallel lists: kind, text, lower-case word."""

    def __init__(self, text: str):
        self.text = text
        self.kinds: list[str] = []
        self.words: list[str] = []
        self.brace = 0

    def run(self, pos: int = 0, code: bool = False) -> None:
        text, n = self.text, len(self.text)
        while pos < n:
            if not code:
                m = _OPEN.search(text, pos)
                if m is None:
                    if pos < n:
                        self._add("html", "")
                    return
                if m.start() > pos:
                    self._add("html", "")
                if m.group() == "<?=":
                    self._add("id", "echo")
                pos, code = m.end(), True
                continue
            pos, ended = self._code(pos, False)
            if ended == "halt":
                return
            code = ended != "close"

    def _add(self, kind: str, word: str) -> None:
        self.kinds.append(kind)
        self.words.append(word)

    def _code(self, pos: int, inner: bool) -> tuple[int, str]:
        """Code up to a close tag, the end, or (``inner``) the brace that closes an interpolation."""
        text, n, match, kinds, words = self.text, len(self.text), _TOKEN.match, self.kinds, self.words
        depth = 0
        while pos < n:
            m = match(text, pos)
            if m is None:
                raise BadSyntax(f"character at {pos}")
            kind = m.lastgroup
            pos = m.end()
            if kind == "ws" or kind == "lc" or kind == "bc":
                continue
            if kind == "op":
                w = m["op"]
                if inner:
                    if w == "{":
                        depth += 1
                    elif w == "}":
                        if not depth:
                            return pos, "brace"
                        depth -= 1
                if w == "`":
                    pos = self._template(pos, "`")
                    kinds.append("str")
                    words.append("")
                    continue
                kinds.append("op")
                words.append(w)
            elif kind == "id":
                w = m["id"]
                # after an arrow any word is a member's name
                if kinds and kinds[-1] == "op" and words[-1] in ("->", "?->"):
                    kinds.append("name")
                    words.append(w)
                    continue
                low = w.lower()
                if low == "__halt_compiler" and not inner:
                    kinds.append("halt")
                    words.append(low)
                    return n, "halt"
                kinds.append("id")
                words.append(low if low in RESERVED or "\\" not in w else w)
            elif kind == "var":
                kinds.append("var")
                words.append(m["var"])
            elif kind == "num":
                kinds.append("num")
                words.append("")
            elif kind == "bs" or kind == "dq":
                kinds.append("str")
                words.append("")
            elif kind == "dqi":
                pos = self._template(pos, '"')
                kinds.append("str")
                words.append("")
            elif kind == "here":
                pos = self._heredoc(m["here"], pos)
                kinds.append("str")
                words.append("")
            elif kind == "cast":
                kinds.append("cast")
                words.append("")
            else:
                kinds.append("close")
                words.append(";")
                if inner:
                    raise BadSyntax("close tag in an interpolation")
                return pos, "close"
        if inner:
            raise BadSyntax("open interpolation")
        return pos, "end"

    def _interpolation(self, pos: int) -> int:
        """``{$ ... }`` or ``${ ... }`` from behind its brace; its tokens are parsed at once."""
        sub = Lexer(self.text)
        pos, _ = sub._code(pos, True)
        p = Parser(sub.kinds, sub.words)
        p.expr()
        if p.i < len(p.kinds) - 1:
            raise BadSyntax("interpolation")
        return pos

    def _template(self, pos: int, quote: str) -> int:
        text, plain = self.text, _PLAIN[quote]
        while True:
            pos = plain.match(text, pos).end()
            if pos >= len(text) or text[pos] == "\\":
                raise BadSyntax("open string")
            if text[pos] == quote:
                return pos + 1
            pos = self._variable(pos)

    def _variable(self, pos: int) -> int:
        text = self.text
        if text.startswith("{$", pos):
            return self._interpolation(pos + 1)
        if text.startswith("${", pos):
            return self._interpolation(pos + 2)
        m = _SIMPLE.match(text, pos)
        if m is None or m.group(1):
            raise BadSyntax("variable in a string")
        return m.end()

    def _heredoc(self, opener: str, pos: int) -> int:
        label = opener[3:].strip().strip("\"'")
        raw = "'" in opener
        end = re.compile(rf"(?:(?<=[\r\n])|\A)([ \t]*){re.escape(label)}(?![{_W}])").search(self.text, pos)
        if end is None:
            raise BadSyntax("open heredoc")
        body, indent = self.text[pos : end.start()], end.group(1)
        if indent and any(line.strip(" \t\r\n") and not line.startswith(indent) for line in body.split("\n")):
            raise BadSyntax("heredoc indent")
        if not raw and ("$" in body):
            sub = Lexer(body)
            at = 0
            while True:
                at = _BODY.match(body, at).end()
                if at >= len(body):
                    break
                at = at + 1 if body[at] == "\\" else sub._variable(at)
        return end.end()


_BINARY = {
    "or": (1, 2), "xor": (3, 4), "and": (5, 6), "??": (15, 14), "||": (16, 17), "&&": (18, 19), "|": (20, 21), "^": (22, 23), "&": (24, 25),
    "==": (26, 27), "!=": (26, 27), "===": (26, 27), "!==": (26, 27), "<>": (26, 27), "<=>": (26, 27),
    "<": (28, 29), "<=": (28, 29), ">": (28, 29), ">=": (28, 29),
    ".": (30, 31), "<<": (32, 33), ">>": (32, 33), "+": (34, 35), "-": (34, 35), "*": (36, 37), "/": (36, 37), "%": (36, 37), "instanceof": (40, 41), "**": (45, 44),
}
_ONCE = {26, 28}  # levels that don't associate
_ASSIGN = frozenset("= += -= *= /= .= %= &= |= ^= <<= >>= **= ??=".split())
_TERNARY, _UNARY, _NOT = 12, 42, 38
_MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
_MAGIC_CALLS = frozenset(["isset", "empty", "exit", "die"])


class Parser:
    def __init__(self, kinds: list[str], words: list[str]):
        self.kinds, self.words = [*kinds, "end"], [*words, ""]
        self.i = 0

    # -- small steps
    def fail(self) -> None:
        raise BadSyntax(f"token {self.i}: {self.kinds[self.i]} {self.words[self.i]!r}")

    def at(self, word: str) -> bool:
        return self.words[self.i] == word and self.kinds[self.i] in ("op", "id")

    def op(self, word: str) -> bool:
        if self.words[self.i] == word and self.kinds[self.i] == "op":
            self.i += 1
            return True
        return False

    def key(self, word: str) -> bool:
        if self.words[self.i].lower() == word and self.kinds[self.i] == "id":
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.op(word):
            self.fail()

    def need_key(self, word: str) -> None:
        if not self.key(word):
            self.fail()

    def peek(self, k: int = 1) -> tuple[str, str]:
        j = min(self.i + k, len(self.kinds) - 1)
        return self.kinds[j], self.words[j]

    def name(self) -> None:
        """A name that isn't reserved, qualified or not."""
        if self.kinds[self.i] != "id" or self.words[self.i] in RESERVED:
            self.fail()
        self.i += 1

    def plain_name(self) -> None:
        if "\\" in self.words[self.i]:
            self.fail()
        self.name()

    def any_name(self) -> None:
        if self.kinds[self.i] not in ("id", "name") or "\\" in self.words[self.i]:
            self.fail()
        self.i += 1

    def var(self) -> None:
        if self.kinds[self.i] != "var":
            self.fail()
        self.i += 1

    def end_statement(self) -> None:
        if self.kinds[self.i] == "close":
            self.i += 1
        elif not self.op(";"):
            self.fail()

    # -- statements
    def file(self) -> None:
        while self.kinds[self.i] != "end":
            if self.kinds[self.i] == "halt":
                return
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement()

    def until(self, *ends: str) -> str:
        """Statements of the alternative syntax up to one of its words."""
        while True:
            if self.kinds[self.i] == "end":
                self.fail()
            if self.kinds[self.i] == "id" and self.words[self.i] in ends:
                self.i += 1
                return self.words[self.i - 1]
            self.statement()

    def body(self, end: str) -> None:
        if self.op(":"):
            self.until(end)
            self.end_statement()
        else:
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def statement(self, top: bool = False) -> None:
        kind, w = self.kinds[self.i], self.words[self.i]
        if kind == "html" or kind == "close":
            self.i += 1
            return
        if kind == "end" or kind == "halt":
            self.fail()
        if kind == "op":
            if w == "{":
                return self.block()
            if w == ";":
                self.i += 1
                return
            if w == "#[":
                self.attributes()
                return self.statement(top)
        if kind == "id":
            f = _STATEMENTS.get(w)
            if f is not None:
                nk, nw = self.peek()
                if not (w == "static" and nk != "var") and not (w == "function" and not self._declares_function()) and not (w == "enum" and not self._declares_enum()) and not (
                    w == "readonly" and not self._declares_class()
                ):
                    self.i += 1
                    return f(self)
            elif self.peek() == ("op", ":") and w not in RESERVED and "\\" not in w:
                self.i += 2  # a label
                return
        self.expr()
        self.end_statement()

    def _declares_function(self) -> bool:
        k, w = self.peek()
        if (k, w) == ("op", "&"):
            k, w = self.peek(2)
        return k == "id" and w not in RESERVED

    def _declares_enum(self) -> bool:
        k, w = self.peek()
        return k == "id" and w.lower() not in ("extends", "implements") and w not in RESERVED

    def _declares_class(self) -> bool:
        k, w = self.peek()
        return k == "id" and w in ("class", "final", "abstract", "readonly")

    def s_if(self) -> None:
        self.paren()
        if self.op(":"):
            end = self.until("elseif", "else", "endif")
            while end != "endif":
                if end == "elseif":
                    self.paren()
                    self.need(":")
                    end = self.until("elseif", "else", "endif")
                else:
                    if self.key("if"):
                        self.fail()
                    self.need(":")
                    self.until("endif")
                    break
            return self.end_statement()
        self.statement()
        while self.key("elseif"):
            self.paren()
            self.statement()
        if self.key("else"):
            self.statement()

    def s_while(self) -> None:
        self.paren()
        self.body("endwhile")

    def s_do(self) -> None:
        self.statement()
        self.need_key("while")
        self.paren()
        self.end_statement()

    def s_for(self) -> None:
        self.need("(")
        for end in (";", ";", ")"):
            if not self.op(end):
                self.expr()
                while self.op(","):
                    self.expr()
                self.need(end)
        self.body("endfor")

    def s_foreach(self) -> None:
        self.need("(")
        self.expr()
        self.need_key("as")
        self._target()
        if self.op("=>"):
            self._target()
        self.need(")")
        self.body("endforeach")

    def _target(self) -> None:
        self.op("&")
        if not self.unary_target():
            self.fail()

    def unary_target(self) -> bool:
        return self.primary()

    def s_switch(self) -> None:
        self.paren()
        alt = not self.at("{")
        self.need(":" if alt else "{")
        self.op(";")
        while True:
            if alt and self.key("endswitch"):
                return self.end_statement()
            if not alt and self.op("}"):
                return
            if self.kinds[self.i] == "html" and not self.words[self.i]:
                self.i += 1
                continue
            if self.key("case"):
                self.expr()
            else:
                self.need_key("default")
            if not self.op(":"):
                self.end_statement()
            while not (self.at("case") or self.at("default") or self.at("}") or self.at("endswitch")):
                self.statement()

    def s_try(self) -> None:
        self.block()
        n = 0
        while self.key("catch"):
            n += 1
            self.need("(")
            self.name()
            while self.op("|"):
                self.name()
            if self.kinds[self.i] == "var":
                self.i += 1
            self.need(")")
            self.block()
        if self.key("finally"):
            n += 1
            self.block()
        if not n:
            self.fail()

    def s_jump(self) -> None:
        if self.kinds[self.i] == "num":
            self.i += 1
        self.end_statement()

    def s_return(self) -> None:
        if self.kinds[self.i] != "close" and not self.at(";"):
            self.expr()
        self.end_statement()

    def s_echo(self) -> None:
        self.expr()
        while self.op(","):
            self.expr()
        self.end_statement()

    def s_global(self) -> None:
        while True:
            self._simple_variable()
            if not self.op(","):
                break
        self.end_statement()

    def _simple_variable(self) -> None:
        while self.op("$"):
            if self.op("{"):
                self.expr()
                self.need("}")
                return
        self.var()

    def s_static(self) -> None:
        while True:
            self.var()
            if self.op("="):
                self.expr()
            if not self.op(","):
                break
        self.end_statement()

    def s_unset(self) -> None:
        self.need("(")
        self.expr()
        while self.op(","):
            if self.at(")"):
                break
            self.expr()
        self.need(")")
        self.end_statement()

    def s_goto(self) -> None:
        self.plain_name()
        self.end_statement()

    def s_declare(self) -> None:
        self.need("(")
        while True:
            self.plain_name()
            self.need("=")
            self.expr()
            if not self.op(","):
                break
        self.need(")")
        if self.op(":"):
            self.until("enddeclare")
            self.end_statement()
        elif self.kinds[self.i] == "close":
            self.i += 1
        elif not self.op(";"):
            self.statement()

    def s_namespace(self) -> None:
        if not self.at("{"):
            if self.words[self.i].startswith("\\"):
                self.fail()
            self.name()
        if self.at("{"):
            self.block()
        else:
            self.end_statement()

    def s_use(self) -> None:
        if not self.key("function"):
            self.key("const")
        while True:
            self._group_or_name()
            if not self.op(","):
                break
        self.end_statement()

    def _group_or_name(self) -> None:
        # a group's prefix ends in a backslash, which the lexer leaves to `{`
        self.name()
        if self.op("{"):
            while not self.op("}"):
                if not (self.kinds[self.i] == "id" and self.words[self.i] in ("function", "const") and self.peek()[0] != "id"):
                    if self.words[self.i] in ("function", "const"):
                        self.i += 1
                self.name()
                if self.key("as"):
                    self.plain_name()
                if not self.op(","):
                    self.need("}")
                    break
        elif self.key("as"):
            self.plain_name()

    def s_const(self) -> None:
        while True:
            self.plain_name()
            self.need("=")
            self.expr()
            if not self.op(","):
                break
        self.end_statement()

    def s_function(self) -> None:
        self.op("&")
        self.plain_name()
        self._signature()
        self.block()

    def s_class(self) -> None:
        self.plain_name()
        if self.key("extends"):
            self.name()
        if self.key("implements"):
            self._names()
        self._members()

    def s_class_modifier(self) -> None:
        while self.kinds[self.i] == "id" and self.words[self.i] in ("final", "abstract", "readonly"):
            self.i += 1
        self.need_key("class")
        self.s_class()

    def s_interface(self) -> None:
        self.plain_name()
        if self.key("extends"):
            self._names()
        self._members()

    def s_trait(self) -> None:
        self.plain_name()
        self._members()

    def s_enum(self) -> None:
        self.plain_name()
        if self.op(":"):
            self.type()
        if self.key("implements"):
            self._names()
        self._members()

    def _names(self) -> None:
        self.name()
        while self.op(","):
            self.name()

    # -- classes and functions
    def attributes(self) -> None:
        while self.op("#["):
            while True:
                self.name()
                if self.at("("):
                    self.arguments()
                if not self.op(",") or self.at("]"):
                    break
            self.need("]")

    def type(self) -> None:
        if self.op("?"):
            return self._type_atom()
        while True:
            if self.op("("):
                self._type_atom()
                while self.op("&"):
                    self._type_atom()
                self.need(")")
            else:
                self._type_atom()
            if self.op("|"):
                continue
            if self.at("&") and self.peek()[0] == "id":
                self.i += 1
                continue
            return

    def _type_atom(self) -> None:
        if self.kinds[self.i] == "id" and self.words[self.i] in ("static", "array", "callable"):
            self.i += 1
        else:
            self.name()

    def _signature(self) -> None:
        self.parameters()
        if self.op(":"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.op(")"):
            self.attributes()
            while self.kinds[self.i] == "id" and self.words[self.i] in ("public", "protected", "private", "readonly", "final"):
                self.i += 1
                self._set_visibility()
            if not (self.kinds[self.i] == "var" or self.at("&") or self.at("...")):
                self.type()
            self.op("&")
            self.op("...")
            self.var()
            if self.op("="):
                self.expr()
            if self.at("{"):
                self._hooks()
            if not self.op(","):
                self.need(")")
                return

    def _set_visibility(self) -> None:
        if self.at("(") and self.peek() == ("id", "set"):
            self.i += 2
            self.need(")")

    def _hooks(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.attributes()
            self.key("final")
            self.op("&")
            if self.words[self.i].lower() not in ("get", "set"):
                self.fail()
            self.i += 1
            if self.at("("):
                self.parameters()
            if self.op("=>"):
                self.expr()
                self.end_statement()
            elif not self.op(";"):
                self.block()

    def _members(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.attributes()
            if self.key("use"):
                self._names()
                if self.op("{"):
                    while not self.op("}"):
                        self._adaptation()
                else:
                    self.end_statement()
                continue
            if self.at("case"):
                self.i += 1
                self.any_name()
                if self.op("="):
                    self.expr()
                self.end_statement()
                continue
            marked = 0
            while self.kinds[self.i] == "id" and self.words[self.i] in _MODIFIERS:
                self.i += 1
                marked += 1
                self._set_visibility()
            if self.key("const"):
                if not (self.peek() == ("op", "=")):
                    self.type()
                while True:
                    self.any_name()
                    self.need("=")
                    self.expr()
                    if not self.op(","):
                        break
                self.end_statement()
            elif self.key("function"):
                self.op("&")
                self.any_name()
                self._signature()
                if not self.op(";"):
                    self.block()
            else:
                if not marked:
                    self.fail()
                if self.kinds[self.i] != "var":
                    self.type()
                while True:
                    self.var()
                    if self.op("="):
                        self.expr()
                    if self.at("{"):
                        self._hooks()
                        break
                    if not self.op(","):
                        self.end_statement()
                        break

    def _adaptation(self) -> None:
        self.kinds[self.i] == "id" or self.fail()
        self.i += 1
        if self.op("::"):
            self.any_name()
        if self.key("insteadof"):
            self._names()
        else:
            self.need_key("as")
            if self.kinds[self.i] == "id" and self.words[self.i] in ("public", "protected", "private", "final"):
                self.i += 1
                if self.kinds[self.i] == "id":
                    self.i += 1
            else:
                self.any_name()
        self.end_statement()

    # -- expressions
    def expr(self, least: int = 0) -> None:
        lvalue = self.unary(least)
        self.binary(least, lvalue)

    def binary(self, least: int, lvalue: bool) -> None:
        last = 0
        while True:
            kind, w = self.kinds[self.i], self.words[self.i]
            if kind == "op":
                if w in _ASSIGN and lvalue:
                    self.i += 1
                    if w == "=":
                        self.op("&")
                    self.expr(_TERNARY - 1)
                    lvalue = False
                    continue
                if w == "?":
                    if least > _TERNARY:
                        return
                    self.i += 1
                    if not self.op(":"):
                        self.expr(_TERNARY - 2)
                        self.need(":")
                    self.expr(_TERNARY + 1)
                    lvalue = False
                    continue
            elif kind != "id":
                return
            level = _BINARY.get(w)
            if level is None or level[0] < least:
                return
            if level[0] in _ONCE and level[0] == last:
                self.fail()
            last = level[0]
            self.i += 1
            if w == "instanceof":
                self._class_reference()
            else:
                self.expr(level[1])
            lvalue = False

    def unary(self, least: int) -> bool:
        kind, w = self.kinds[self.i], self.words[self.i]
        if kind == "op":
            if w == "!":
                self.i += 1
                self.expr(_NOT)
                return False
            if w in ("+", "-", "~", "@"):
                self.i += 1
                self.expr(_UNARY)
                return False
            if w in ("++", "--"):
                self.i += 1
                if not self.primary():
                    self.fail()
                return False
            if w == "&":
                self.fail()
        elif kind == "cast":
            self.i += 1
            self.expr(_UNARY)
            return False
        elif kind == "id":
            if w in ("include", "include_once", "require", "require_once", "print", "throw"):
                self.i += 1
                self.expr(_TERNARY - 1 if w != "throw" else 0)
                return False
            if w == "yield":
                self.i += 1
                if self.key("from"):
                    self.expr(_TERNARY - 1)
                elif not (self.kinds[self.i] == "close" or (self.kinds[self.i] == "op" and self.words[self.i] in (";", ")", ",", "]"))):
                    self.expr(_TERNARY - 1)
                    if self.op("=>"):
                        self.expr(_TERNARY - 1)
                return False
            if w == "clone":
                self.i += 1
                self.expr(_UNARY)
                return False
        return self.primary()

    def primary(self) -> bool:
        """A term with its postfixes; True if it can be assigned to."""
        kind, w = self.kinds[self.i], self.words[self.i]
        lvalue = constant = False
        if kind == "var":
            self.i += 1
            lvalue = True
        elif kind == "str":
            self.i += 1
        elif kind == "num":
            self.i += 1
            constant = True
        elif kind == "op":
            if w == "(":
                self.i += 1
                self.expr()
                self.need(")")
            elif w == "[":
                self.i += 1
                self.items("]")
                lvalue = True
            elif w == "$":
                self._simple_variable()
                lvalue = True
            elif w == "#[":
                self.attributes()
                return self.primary()
            else:
                self.fail()
        elif kind == "id":
            self.i += 1
            if w == "new":
                self._new()
            elif w == "array" and self.at("("):
                self.i += 1
                self.items(")")
            elif w == "list":
                self.need("(")
                self.items(")")
                lvalue = True
            elif w in _MAGIC_CALLS:
                if self.op("("):
                    if not self.op(")"):
                        self.expr()
                        while self.op(","):
                            if self.at(")"):
                                break
                            self.expr()
                        self.need(")")
                elif w in ("isset", "empty"):
                    self.fail()
                return False
            elif w == "function":
                self._closure()
                return False
            elif w == "fn":
                self._arrow()
                return False
            elif w == "match":
                self._match()
            elif w == "static":
                if self.key("function"):
                    self._closure()
                    return False
                if self.key("fn"):
                    self._arrow()
                    return False
                if not self.at("::"):
                    self.fail()
            elif w in RESERVED and not (w in ("enum", "readonly") or (w == "namespace")):
                self.fail()
            elif w == "readonly" and not self.at("("):
                self.fail()
            elif w == "namespace":
                self.fail()
        else:
            self.fail()
        return self.postfix(lvalue, constant)

    def postfix(self, lvalue: bool, constant: bool = False) -> bool:
        while self.kinds[self.i] == "op":
            w = self.words[self.i]
            if w == "[":
                self.i += 1
                if not self.op("]"):
                    self.expr()
                    self.need("]")
                lvalue = True
            elif w == "->" or w == "?->":
                self.i += 1
                kind = self.kinds[self.i]
                if kind in ("name", "id", "var"):
                    if kind != "var" and "\\" in self.words[self.i]:
                        self.fail()
                    self.i += 1
                elif self.op("{"):
                    self.expr()
                    self.need("}")
                elif self.at("$"):
                    self._simple_variable()
                else:
                    self.fail()
                lvalue = True
            elif w == "::":
                self.i += 1
                kind = self.kinds[self.i]
                if kind == "var" or self.at("$"):
                    self._simple_variable()
                    lvalue = True
                elif kind == "id" and "\\" not in self.words[self.i]:
                    self.i += 1
                    lvalue = False
                elif self.op("{"):
                    self.expr()
                    self.need("}")
                else:
                    self.fail()
            elif w == "(":
                if constant:
                    self.fail()
                self.arguments()
                lvalue = True
            elif w == "++" or w == "--":
                if not lvalue:
                    self.fail()
                self.i += 1
                return False
            else:
                return lvalue
            constant = False
        return lvalue

    def items(self, end: str) -> None:
        while not self.op(end):
            if self.op(","):
                continue
            if self.op("..."):
                self.expr()
            elif self.op("&"):
                self.primary()
            else:
                self.expr()
                if self.op("=>"):
                    if self.op("&"):
                        self.primary()
                    else:
                        self.expr()
            if not self.op(","):
                self.need(end)
                return

    def arguments(self) -> None:
        self.need("(")
        if self.at("...") and self.peek() == ("op", ")"):
            self.i += 2
            return
        while not self.op(")"):
            if self.kinds[self.i] == "id" and "\\" not in self.words[self.i] and self.peek() == ("op", ":"):
                self.i += 2
            else:
                self.op("...")
            self.expr()
            if not self.op(","):
                self.need(")")
                return

    def _closure(self) -> None:
        self.op("&")
        self.parameters()
        if self.key("use"):
            self.need("(")
            while not self.op(")"):
                self.op("&")
                self.var()
                if not self.op(","):
                    self.need(")")
                    break
        if self.op(":"):
            self.type()
        self.block()

    def _arrow(self) -> None:
        self.op("&")
        self._signature()
        self.need("=>")
        self.expr(_TERNARY - 1)

    def _match(self) -> None:
        self.paren()
        self.need("{")
        while not self.op("}"):
            if self.key("default"):
                self.op(",")
            else:
                self.expr()
                while self.op(","):
                    if self.at("=>"):
                        break
                    self.expr()
            self.need("=>")
            self.expr()
            if not self.op(","):
                self.need("}")
                return

    def _new(self) -> None:
        self.attributes()
        self.key("readonly")
        if self.key("class"):
            if self.at("("):
                self.arguments()
            if self.key("extends"):
                self.name()
            if self.key("implements"):
                self._names()
            return self._members()
        self._class_reference()
        if self.at("("):
            self.arguments()

    def _class_reference(self) -> None:
        """What follows new and instanceof: a name or a variable with its members, without calls."""
        kind, w = self.kinds[self.i], self.words[self.i]
        if kind == "id":
            if w == "static":
                self.i += 1
            else:
                self.name()
            return
        if self.op("("):
            self.expr()
            self.need(")")
            return
        if kind == "var" or w == "$":
            self._simple_variable()
            while self.kinds[self.i] == "op" and self.words[self.i] in ("->", "?->", "::", "["):
                if self.op("["):
                    self.expr()
                    self.need("]")
                    continue
                self.i += 1
                if self.op("{"):
                    self.expr()
                    self.need("}")
                elif self.kinds[self.i] in ("id", "name", "var"):
                    self.i += 1
                else:
                    self._simple_variable()
            return
        if kind == "str":
            self.i += 1
            return
        self.fail()


_P = Parser
_STATEMENTS = {
    "if": _P.s_if, "while": _P.s_while, "do": _P.s_do, "for": _P.s_for, "foreach": _P.s_foreach, "switch": _P.s_switch, "try": _P.s_try,
    "break": _P.s_jump, "continue": _P.s_jump, "return": _P.s_return, "echo": _P.s_echo, "global": _P.s_global, "static": _P.s_static,
    "unset": _P.s_unset, "goto": _P.s_goto, "declare": _P.s_declare, "namespace": _P.s_namespace, "use": _P.s_use, "const": _P.s_const,
    "function": _P.s_function, "class": _P.s_class, "abstract": _P.s_class_modifier, "final": _P.s_class_modifier, "readonly": _P.s_class_modifier,
    "interface": _P.s_interface, "trait": _P.s_trait, "enum": _P.s_enum,
}


def check(text: str, code: bool = False) -> None:
    """Raise BadSyntax (or RecursionError, at very deep nesting) unless the text parses.

    With ``code`` the text starts behind an open tag.
    """
    lexer = Lexer(text)
    lexer.run(0, code)
    Parser(lexer.kinds, lexer.words).file()


def has_tag(text: str) -> bool:
    return _OPEN.search(text) is not None
