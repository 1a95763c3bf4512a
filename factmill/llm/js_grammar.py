"""ECMAScript: is a source text a script? A goal-driven lexer and a recursive-descent grammar, syntax only."""

from __future__ import annotations

import re


class BadSyntax(Exception):
    pass


_START = r"A-Za-z_$\x80-\U0010ffff"
_PART = r"A-Za-z0-9_$\x80-\U0010ffff"
_ESC = r"\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
_SKIP = re.compile(r"(?:[ \t\v\f\xa0\ufeff\u2000-\u200a\u202f\u205f\u3000\u1680\r\n\u2028\u2029]|//[^\r\n\u2028\u2029]*+|/\*(?:[^*]|\*(?!/))*+\*/|<!--[^\r\n\u2028\u2029]*+)*+")
_NEWLINE = re.compile(r"[\r\n\u2028\u2029]")
_TOKEN = re.compile(
    rf"""(?P<id>\#?(?:[{_START}]|{_ESC})(?:[{_PART}]|{_ESC})*+)
|(?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*+n?|0[bB][01]+(?:_[01]+)*+n?|0[oO][0-7]+(?:_[0-7]+)*+n?|0[0-9]+|(?:[1-9][0-9]*+(?:_[0-9]+)*+|0)n|(?:(?:[0-9]+(?:_[0-9]+)*+)(?:\.(?:[0-9]+(?:_[0-9]+)*+)?)?|\.[0-9]+(?:_[0-9]+)*+)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*+)?)(?![{_PART}]))
|(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|.))*+"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+')
|(?P<tpl>`)
|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){{}}\[\]@])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\r\n\u2028\u2029\\/\[]|\\[^\r\n\u2028\u2029]|\[(?:[^\r\n\u2028\u2029\\\]]|\\[^\r\n\u2028\u2029])*+\])++/([A-Za-z]*+)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{)", re.S)

# Words that are no identifiers.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}

# What an expression turned out to be: OTHER can't be assigned to, PATTERN is an array or
# object literal, COVER one that holds `a = b` shorthand and must become a pattern.
OTHER, SIMPLE, PATTERN, COVER = range(4)


class Parser:
    def __init__(self, text: str, pos: int = 0, end: int | None = None):
        self.text, self.end = text, len(text) if end is None else end
        self.p = pos
        self.yields = self.awaits = self.returns = False
        self.breaks = self.loops = 0
        if pos == 0 and text.startswith("#!"):
            self.p = _NEWLINE.search(text).start() if _NEWLINE.search(text) else self.end
        self.advance()

    # -- tokens
    def advance(self) -> None:
        text = self.text
        m = _SKIP.match(text, self.p, self.end)
        self.newline = _NEWLINE.search(text, self.p, m.end()) is not None
        self.start = p = m.end()
        if p >= self.end:
            self.kind, self.word, self.p = "end", "", p
            return
        m = _TOKEN.match(text, p, self.end)
        if m is None:
            raise BadSyntax(f"character at {p}")
        self.kind, self.word, self.p = m.lastgroup, m.group(), m.end()
        if self.kind == "id" and self.word[0] == "#":
            self.kind = "private"

    def save(self) -> tuple:
        return self.p, self.start, self.kind, self.word, self.newline

    def load(self, at: tuple) -> None:
        self.p, self.start, self.kind, self.word, self.newline = at

    def fail(self) -> None:
        raise BadSyntax(f"{self.kind} {self.word!r} at {self.start}")

    def at(self, w: str) -> bool:
        return self.word == w and (self.kind == "op" or self.kind == "id")

    def take(self, w: str) -> bool:
        if self.word == w and (self.kind == "op" or self.kind == "id"):
            self.advance()
            return True
        return False

    def need(self, w: str) -> None:
        if not self.take(w):
            self.fail()

    def semicolon(self) -> None:
        if self.kind == "op" and self.word == ";":
            self.advance()
        elif not (self.newline or self.kind == "end" or (self.kind == "op" and self.word == "}")):
            self.fail()

    def next_is(self, *words: str, same_line: bool = False) -> bool:
        at = self.save()
        self.advance()
        ok = (self.kind in ("op", "id") and self.word in words) and not (same_line and self.newline)
        self.load(at)
        return ok

    def is_binding(self) -> bool:
        if self.kind != "id" or self.word in RESERVED:
            return False
        return not (self.word == "yield" and self.yields) and not (self.word == "await" and self.awaits)

    def binding_name(self) -> None:
        if not self.is_binding():
            self.fail()
        self.advance()

    # -- statements
    def script(self) -> None:
        while self.kind != "end":
            self.item()

    def item(self) -> None:
        """A statement or declaration."""
        if self.kind == "id":
            w = self.word
            if w == "function":
                self.advance()
                return self.function(True)
            if w == "class":
                self.advance()
                return self.klass(True)
            if w == "const" or (w == "let" and self._let_declares()):
                self.advance()
                self.declarations(False, w == "const")
                return self.semicolon()
            if w == "async" and self.next_is("function", same_line=True):
                self.advance()
                self.advance()
                return self.function(True, True)
            if w == "import" and not self.next_is("(", "."):
                self.fail()
        elif self.kind == "op" and self.word == "@":
            self.decorators()
            if not self.at("class"):
                self.fail()
            return self.item()
        self.statement()

    def _let_declares(self) -> bool:
        at = self.save()
        self.advance()
        ok = self.is_binding() or self.at("[") or self.at("{")
        if self.kind == "id" and self.word in ("in", "instanceof", "of"):
            ok = self.word == "of"
        self.load(at)
        return ok

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.item()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        w, kind = self.word, self.kind
        if kind == "op":
            if w == "{":
                return self.block()
            if w == ";":
                return self.advance()
        elif kind == "id":
            f = _STATEMENTS.get(w)
            if f is not None:
                self.advance()
                return f(self)
            if w in ("class", "function", "export", "enum", "else", "case", "default", "catch", "finally"):
                self.fail()
            if w == "async" and self.next_is("function", same_line=True):
                self.fail()
            if w == "let" and self.next_is("["):
                self.fail()
            if w not in RESERVED and self.next_is(":"):
                self.advance()
                self.advance()
                if self.at("function"):
                    self.advance()
                    return self.function(True)
                return self._labelled()
        elif kind == "end":
            self.fail()
        self.expression()
        self.semicolon()

    def _labelled(self) -> None:
        self.breaks += 1
        self.statement()
        self.breaks -= 1

    def s_var(self) -> None:
        self.declarations(False, False)
        self.semicolon()

    def declarations(self, loop: bool, constant: bool) -> bool:
        """Declarators; in a loop's head True if it may go on with of or in."""
        n = 0
        bare = True
        while True:
            n += 1
            pattern = self.at("[") or self.at("{")
            self.binding()
            if self.take("="):
                bare = False
                self.assignment(not loop)
            elif (pattern or constant) and not (loop and n == 1 and (self.at("of") or self.at("in"))):
                self.fail()
            if not self.take(","):
                return n == 1 and bare

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assignment()
                if rest or not self.take(","):
                    self.need("]")
                    return
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding_name()
                    self.need("}")
                    return
                short = self.is_binding()
                self.property_name()
                if self.take(":"):
                    self.binding()
                elif not short:
                    self.fail()
                if self.take("="):
                    self.assignment()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.binding_name()

    def s_if(self) -> None:
        self.paren()
        self._branch()
        if self.take("else"):
            self._branch()

    def _branch(self) -> None:
        if self.at("function"):
            self.advance()
            return self.function(True)
        self.statement()

    def _loop_body(self) -> None:
        self.loops += 1
        self.breaks += 1
        self.statement()
        self.loops -= 1
        self.breaks -= 1

    def s_for(self) -> None:
        if self.kind == "id" and self.word == "await":
            if not self.awaits:
                self.fail()
            self.advance()
        self.need("(")
        if not self.at(";"):
            each = False
            if self.at("var") or self.at("const") or (self.at("let") and self._let_declares()):
                constant = self.at("const")
                self.advance()
                each = self.declarations(True, constant)
            else:
                what = self.expression(False)
                each = what in (SIMPLE, PATTERN, COVER)
                if what == COVER and not (self.at("of") or self.at("in")):
                    self.fail()
            if self.at("of") or self.at("in"):
                if not each:
                    self.fail()
                of = self.at("of")
                self.advance()
                if of:
                    self.assignment()
                else:
                    self.expression()
                self.need(")")
                return self._loop_body()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self._loop_body()

    def s_while(self) -> None:
        self.paren()
        self._loop_body()

    def s_do(self) -> None:
        self._loop_body()
        self.need("while")
        self.paren()
        self.take(";")

    def s_continue(self) -> None:
        if not self.loops:
            self.fail()
        if not self.newline and self.kind == "id":
            self.binding_name()
        self.semicolon()

    def s_break(self) -> None:
        if not self.breaks:
            self.fail()
        if not self.newline and self.kind == "id":
            self.binding_name()
        self.semicolon()

    def s_return(self) -> None:
        if not self.returns:
            self.fail()
        if not (self.newline or self.kind == "end" or self.at(";") or self.at("}")):
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        if self.newline:
            self.fail()
        self.expression()
        self.semicolon()

    def s_with(self) -> None:
        self.paren()
        self.statement()

    def s_switch(self) -> None:
        self.paren()
        self.need("{")
        self.breaks += 1
        defaults = 0
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
                defaults += 1
            self.need(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                self.item()
        self.breaks -= 1
        if defaults > 1:
            self.fail()

    def s_try(self) -> None:
        self.block()
        n = 0
        if self.take("catch"):
            n = 1
            if self.take("("):
                self.binding()
                self.need(")")
            self.block()
        if self.take("finally"):
            n = 1
            self.block()
        if not n:
            self.fail()

    def s_debugger(self) -> None:
        self.semicolon()

    # -- functions and classes
    def function(self, declares: bool, is_async: bool = False) -> None:
        """From behind the word ``function``."""
        generator = self.take("*")
        if declares:
            self.binding_name()
        elif self.kind == "id" and not self.at("("):
            self.binding_name()
        self.rest_of_function(generator, is_async)

    def rest_of_function(self, generator: bool, is_async: bool) -> None:
        state = self.yields, self.awaits, self.returns, self.breaks, self.loops
        self.yields, self.awaits, self.returns, self.breaks, self.loops = generator, is_async, True, 0, 0
        self.need("(")
        while not self.take(")"):
            rest = self.take("...")
            self.binding()
            if not rest and self.take("="):
                self.assignment()
            if rest or not self.take(","):
                self.need(")")
                break
        self.need("{")
        while not self.at("}"):
            self.item()
        # what follows is read in the outer state
        self.yields, self.awaits, self.returns, self.breaks, self.loops = state
        self.need("}")

    def decorators(self) -> None:
        while self.take("@"):
            self.left_side()

    def klass(self, declares: bool) -> None:
        if declares or (self.kind == "id" and not (self.at("extends"))):
            self.binding_name()
        if self.take("extends"):
            self.left_side()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.decorators()
            self.member()

    def member(self) -> None:
        if self.at("static"):
            if self.next_is("{"):
                self.advance()
                state = self.returns, self.awaits, self.breaks, self.loops
                self.returns, self.awaits, self.breaks, self.loops = False, False, 0, 0
                self.block()
                self.returns, self.awaits, self.breaks, self.loops = state
                return
            if not self.next_is("(", "=", ";", "}"):
                self.advance()
        self.accessor_or_name(True)

    def accessor_or_name(self, in_class: bool) -> str:
        """A property or member; what it is: method, name, short, field."""
        is_async = generator = False
        if self.kind == "id" and self.word in ("get", "set") and not self.next_is("(", "=", ";", "}", ",", ":") and not (in_class and self._field_ends()):
            self.advance()
            self.property_name(in_class)
            self.rest_of_function(False, False)
            return "method"
        if self.at("async") and not self.next_is("(", "=", ";", "}", ",", ":") and not self._field_ends():
            self.advance()
            is_async = True
        if self.take("*"):
            generator = True
        short = self.is_binding()
        self.property_name(in_class)
        if self.at("("):
            self.rest_of_function(generator, is_async)
            return "method"
        if generator or is_async:
            self.fail()
        if in_class:
            if self.take("="):
                state = self.returns, self.yields, self.awaits
                self.returns = self.yields = self.awaits = False
                self.assignment()
                self.returns, self.yields, self.awaits = state
            self.semicolon()
            return "field"
        return "short" if short else "name"

    def _field_ends(self) -> bool:
        at = self.save()
        self.advance()
        ends = self.newline
        self.load(at)
        return ends

    def property_name(self, in_class: bool = False) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.kind in ("id", "str", "num") or (in_class and self.kind == "private"):
            self.advance()
        else:
            self.fail()

    # -- expressions
    def expression(self, allow_in: bool = True) -> int:
        what = self.assignment(allow_in, True)
        if self.at(","):
            if what == COVER:
                self.fail()
            while self.take(","):
                self.assignment(allow_in)
            return OTHER
        if what == COVER and not (self.at("of") or self.at("in")):
            self.fail()
        return what

    def assignment(self, allow_in: bool = True, cover: bool = False) -> int:
        if self.kind == "id":
            w = self.word
            if w == "yield" and self.yields:
                self.advance()
                if not self.newline:
                    if self.take("*"):
                        self.assignment(allow_in)
                    elif self.kind != "end" and not (self.kind == "op" and self.word in (")", "]", "}", ",", ";", ":")) and not self.at("in"):
                        self.assignment(allow_in)
                return OTHER
            if w == "async" and self._async_arrow(allow_in):
                return OTHER
            if w not in RESERVED and self.next_is("=>", same_line=True) and self.is_binding():
                self.advance()
                self.arrow_body(allow_in, False)
                return OTHER
        elif self.kind == "op" and self.word == "(" and self._arrow_parameters():
            self.arrow(allow_in, False)
            return OTHER
        what = self.conditional(allow_in)
        if self.kind == "op" and self.word in _ASSIGN:
            if what == OTHER or (what in (PATTERN, COVER) and self.word != "="):
                self.fail()
            self.advance()
            self.assignment(allow_in)
            return OTHER
        if what == COVER and not cover:
            self.fail()
        return what

    def _async_arrow(self, allow_in: bool) -> bool:
        at = self.save()
        self.advance()
        if not self.newline:
            if self.kind == "id" and self.word not in RESERVED and self.next_is("=>", same_line=True):
                self.advance()
                self.arrow_body(allow_in, True)
                return True
            if self.at("(") and self._arrow_parameters():
                self.arrow(allow_in, True)
                return True
        self.load(at)
        return False

    def _arrow_parameters(self) -> bool:
        """Whether the parenthesis here is followed by an arrow: tokens are skipped to its end."""
        at, depth = self.save(), 0
        try:
            last = ("op", "(")
            while True:
                if self.kind == "end":
                    return False
                if self.kind == "op":
                    w = self.word
                    if w in ("(", "[", "{"):
                        depth += 1
                    elif w in (")", "]", "}"):
                        depth -= 1
                        if not depth:
                            self.advance()
                            return self.at("=>") and not self.newline
                    elif w in ("/", "/=") and (last[0] == "op" and last[1] not in (")", "]", "}") or last[1] in ("return", "typeof")):
                        m = _REGEX.match(self.text, self.start, self.end)
                        if m is None:
                            return False
                        self.p = m.end()
                elif self.kind == "tpl":
                    self.template_skip()
                    last = ("tpl", "")
                    continue
                last = (self.kind, self.word)
                self.advance()
        except BadSyntax:
            return False
        finally:
            self.load(at)

    def arrow(self, allow_in: bool, is_async: bool) -> None:
        awaits = self.awaits
        self.awaits = is_async or awaits
        self.need("(")
        while not self.take(")"):
            rest = self.take("...")
            self.binding()
            if not rest and self.take("="):
                self.assignment()
            if rest or not self.take(","):
                self.need(")")
                break
        self.awaits = awaits
        self.arrow_body(allow_in, is_async)

    def arrow_body(self, allow_in: bool, is_async: bool) -> None:
        if self.newline:
            self.fail()
        state = self.yields, self.awaits, self.returns, self.breaks, self.loops
        self.yields, self.awaits, self.returns, self.breaks, self.loops = False, is_async, True, 0, 0
        self.need("=>")
        if self.at("{"):
            self.advance()
            while not self.at("}"):
                self.item()
            self.yields, self.awaits, self.returns, self.breaks, self.loops = state
            self.need("}")
        else:
            self.returns = state[2]
            self.assignment(allow_in)
            self.yields, self.awaits, self.returns, self.breaks, self.loops = state

    def conditional(self, allow_in: bool) -> int:
        what = self.binary(0, allow_in)
        if self.at("?") and self.kind == "op":
            if what == COVER:
                self.fail()
            self.advance()
            self.assignment()
            self.need(":")
            self.assignment(allow_in)
            return OTHER
        return what

    def binary(self, least: int, allow_in: bool) -> int:
        if self.kind == "private":
            self.advance()
            if not self.at("in"):
                self.fail()
            what = OTHER
        else:
            what = self.unary()
        logic = None
        unary_power = self.signed
        while self.kind == "op" or self.kind == "id":
            w = self.word
            level = _BINARY.get(w)
            if level is None or level < least or (w == "in" and not allow_in):
                break
            if what == COVER:
                self.fail()
            if w == "**" and unary_power:
                self.fail()
            self.advance()
            self.binary(level if w == "**" else level + 1, allow_in)
            if level <= 3:
                # ?? doesn't mix with || and && outside parentheses
                kinds = {"??" if w == "??" else "||", logic, self.logic} - {None}
                if len(kinds) > 1:
                    self.fail()
                logic = kinds.pop()
            else:
                logic = None
            what, unary_power = OTHER, False
        self.signed, self.logic = False, logic
        return what

    logic = None  # the kind of logical operator that the binary expression read last ends in
    signed = False  # whether the unary expression read last began with an operator

    def unary(self) -> int:
        self.signed = False
        w = self.word
        if self.kind == "op":
            if w in ("+", "-", "!", "~"):
                self.advance()
                if self.unary() == COVER:
                    self.fail()
                self.signed = True
                return OTHER
            if w in ("++", "--"):
                self.advance()
                if self.unary() != SIMPLE:
                    self.fail()
                self.signed = False
                return OTHER
        elif self.kind == "id":
            if w in ("typeof", "void", "delete") or (w == "await" and self.awaits):
                self.advance()
                if self.unary() == COVER:
                    self.fail()
                self.signed = w != "await"
                return OTHER
        what = self.left_side()
        if self.kind == "op" and self.word in ("++", "--") and not self.newline:
            if what != SIMPLE:
                self.fail()
            self.advance()
            what = OTHER
        self.signed = False
        return what

    def left_side(self) -> int:
        """Member accesses and calls."""
        what = self.primary()
        optional = False
        while True:
            kind, w = self.kind, self.word
            if kind == "tpl":
                if optional or what == COVER:
                    self.fail()
                self.template()
                what = OTHER
                continue
            if kind != "op" or w not in (".", "?.", "[", "("):
                return what
            if what == COVER:
                self.fail()
            if w == ".":
                self.advance()
                if self.kind not in ("id", "private"):
                    self.fail()
                self.advance()
                what = OTHER if optional else SIMPLE
            elif w == "?.":
                optional = True
                self.advance()
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.kind in ("id", "private"):
                    self.advance()
                elif self.kind == "tpl":
                    self.fail()
                else:
                    self.fail()
                what = OTHER
            elif w == "[":
                self.advance()
                self.expression()
                self.need("]")
                what = OTHER if optional else SIMPLE
            else:
                self.arguments()
                what = OTHER

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if not self.take(","):
                self.need(")")
                return

    def template(self) -> None:
        """From the opening backtick, whose token is the current one."""
        p = self.p
        while True:
            m = _TEMPLATE.match(self.text, p, self.end)
            if m is None:
                raise BadSyntax("open template")
            self.p = m.end()
            if m.group(1) == "`":
                return self.advance()
            self.advance()
            self.expression()
            if not (self.kind == "op" and self.word == "}"):
                self.fail()
            p = self.p

    def template_skip(self) -> None:
        self.template()

    def primary(self) -> int:
        kind, w = self.kind, self.word
        if kind == "id":
            if w == "function":
                self.advance()
                self.function(False)
                return OTHER
            if w == "class":
                self.advance()
                self.klass(False)
                return OTHER
            if w == "async" and self.next_is("function", same_line=True):
                self.advance()
                self.advance()
                self.function(False, True)
                return OTHER
            if w == "new":
                return self.new()
            if w == "super":
                self.advance()
                if not (self.at(".") or self.at("[") or self.at("(")):
                    self.fail()
                return OTHER
            if w == "import":
                self.advance()
                if self.take("."):
                    if not self.take("meta"):
                        self.fail()
                    self.fail()  # import.meta is for modules
                if not self.at("("):
                    self.fail()
                return OTHER
            if w in ("this", "null", "true", "false"):
                self.advance()
                return OTHER
            if not self.is_binding():
                self.fail()
            self.advance()
            return SIMPLE
        if kind == "num" or kind == "str":
            self.advance()
            return OTHER
        if kind == "tpl":
            self.template()
            return OTHER
        if kind == "op":
            if w == "(":
                self.advance()
                what = self.expression()
                self.need(")")
                return SIMPLE if what == SIMPLE else OTHER
            if w == "[":
                return self.array()
            if w == "{":
                return self.object()
            if w in ("/", "/="):
                m = _REGEX.match(self.text, self.start, self.end)
                if m is None or len(set(m.group(1))) < len(m.group(1)) or set(m.group(1)) - set("dgimsuvy"):
                    self.fail()
                self.p = m.end()
                self.advance()
                return OTHER
            if w == "@":
                self.decorators()
                self.need("class")
                self.klass(False)
                return OTHER
        self.fail()

    def new(self) -> int:
        self.advance()
        if self.take("."):
            if not self.take("target"):
                self.fail()
            return OTHER
        if self.at("new"):
            self.new()
        elif self.at("import"):
            self.fail()
        else:
            self.primary()
        while self.kind == "tpl" or (self.kind == "op" and self.word in (".", "[")):
            if self.kind == "tpl":
                self.template()
            elif self.take("."):
                if self.kind not in ("id", "private"):
                    self.fail()
                self.advance()
            else:
                self.advance()
                self.expression()
                self.need("]")
        if self.at("("):
            self.arguments()
        elif self.at("?."):
            self.fail()
        return OTHER

    def array(self) -> int:
        self.advance()
        what = PATTERN
        while not self.take("]"):
            if self.take(","):
                continue
            self.take("...")
            if self.assignment(True, True) == COVER:
                what = COVER
            if not self.take(","):
                self.need("]")
                break
        return what

    def object(self) -> int:
        self.advance()
        what = PATTERN
        while not self.take("}"):
            if self.take("..."):
                self.assignment()
            else:
                kind = self.accessor_or_name(False)
                if kind != "method":
                    if self.take(":"):
                        if self.assignment(True, True) == COVER:
                            what = COVER
                    elif kind != "short":
                        self.fail()
                    elif self.take("="):
                        self.assignment()
                        what = COVER
            if not self.take(","):
                self.need("}")
                break
        return what


_P = Parser
_STATEMENTS = {
    "var": _P.s_var, "if": _P.s_if, "for": _P.s_for, "while": _P.s_while, "do": _P.s_do, "continue": _P.s_continue, "break": _P.s_break, "return": _P.s_return,
    "throw": _P.s_throw, "with": _P.s_with, "switch": _P.s_switch, "try": _P.s_try, "debugger": _P.s_debugger,
}


def check(text: str, pos: int = 0, end: int | None = None) -> None:
    """Raise BadSyntax (or RecursionError, at very deep nesting) unless the text, or its part, is a script."""
    Parser(text, pos, end).script()
