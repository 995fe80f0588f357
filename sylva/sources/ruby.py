"""Ruby front end."""

from __future__ import annotations

import re

from sylva.sources.syntax import N, Parser, Unread

_OPS = r"\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|&\.|=>|->|::|==|!=|=~|!~|<=|>=|&&|\|\||\*\*|<<|>>|\.\.|[-+*/%&|^]=|[-+*/%&|^<>=!~?:()\[\]{},;.]"
_KEYWORDS = {"alias", "and", "begin", "break", "case", "class", "def", "do", "else", "elsif", "end", "ensure", "false", "for", "if", "in", "module", "next", "nil", "not", "or", "redo", "rescue", "retry", "return", "self", "super", "then", "true", "undef", "unless", "until", "when", "while", "yield"}
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


class Ruby(Parser):
    LEX = re.compile(rf"(?P<ws>[ \t\f\r]+|\\\n)|(?P<nl>\n)|(?P<comment>#[^\n]*|^=begin[\s\S]*?^=end[^\n]*)|(?P<str>'(?:\\[\s\S]|[^\\'])*'?)|(?P<dq>\"|`)|(?P<pct>%[qQwWiIrx]?[({{\[<|!/])|(?P<sym>:(?:[A-Za-z_\x80-\xff][\w\x80-\xff]*[?!=]?(?![>=])|\"(?:\\[\s\S]|[^\\\"])*\"|[-+*/<>=]{{1,3}}|\[\]=?)(?<!:))|(?P<label>[A-Za-z_][\w]*[?!]?:(?!:))|(?P<var>@@?[A-Za-z_]\w*|\$[A-Za-z_0-9!@&`'+~=/\\,;.<>*$?:\"]\w*)|(?P<num>0[xXoObB][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9]+)?r?i?)|(?P<id>[A-Za-z_\x80-\xff][\w\x80-\xff]*[?!]?(?!=[^=~>])|[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<slash>/)|(?P<op>{_OPS})", re.M)
    BINARY = {"..": 2, "...": 2, "||": 3, "&&": 4, "<=>": 6, "==": 6, "===": 6, "!=": 6, "=~": 6, "!~": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "|": 8, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 14}
    RIGHT = frozenset(["**"])
    BINARY_KIND = "binary"
    spaced = False

    def ready(self) -> bool:
        """Whether a value may begin here, by the token before."""
        if not self.toks:
            return True
        kind, s, e, _ = self.toks[-1]
        t = self.src[s:e]
        return kind == "op" and t not in (")", "]", "}") or kind == "label" or kind == "id" and t in _KEYWORDS - {"end", "self", "true", "false", "nil"}

    def token(self, kind: str, start: int, end: int, broke: bool) -> int:
        gap = start > 0 and self.src[start - 1] in " \t"
        command = bool(self.toks) and self.toks[-1][0] == "id" and gap and self.src[end : end + 1] not in (" ", "\n", "=")
        if kind == "label" and self.toks and self.src[self.toks[-1][1] : self.toks[-1][2]] == "?" and False:
            kind = "id"
        if kind == "dq":
            kind, end = "dstr", self.quoted(end, self.src[start], self.src[start])
            if self.src[end : end + 1] == ":" and self.src[end + 1 : end + 2] != ":" and self.src[start] == '"' and (not self.toks or self.src[self.toks[-1][1] : self.toks[-1][2]] in ("{", ",", "(")):
                kind, end = "slabel", end + 1
        elif kind == "pct":
            if not (broke or self.ready() or command):
                kind, end = "op", start + 1
            else:
                a = self.src[end - 1]
                kind, end = "pct", self.quoted(end, a, _PAIRS.get(a, a))
        elif kind == "slash":
            kind = "op"
            if broke or self.ready() or command:
                stop = self.quoted(end, "/", "/", line=True)
                if stop > end:
                    m = re.compile("[a-z]*").match(self.src, stop)
                    kind, end = "regex", m.end()
            if kind == "op" and self.src[start : start + 2] == "/=":
                end = start + 2
        elif kind == "op" and self.src[start:end] == "<<":
            m = re.compile(r"<<([~-]?)([\"'`]?)([A-Z_][A-Za-z_0-9]*)\2").match(self.src, start)
            if m and (broke or self.ready() or command):
                close = re.compile(rf"^{'[ \t]*' if m[1] else ''}{m[3]}[ \t\r]*$", re.M).search(self.src, self.src.find("\n", m.end()) if "\n" in self.src[m.end() :] else self.stop)
                kind, end = "heredoc", m.end()
                if close:
                    self.heredocs = (*getattr(self, "heredocs", ()), (self.src.find("\n", m.end()) + 1, close.end()))
        self.toks.append((kind, start, end, broke))
        return end

    def lex(self) -> None:
        self.heredocs: tuple = ()
        if self.start == 0:
            end = re.compile(r"^__END__\r?$", re.M).search(self.src)
            if end:
                self.stop = end.start()
        at, broke = self.start, True
        while at < self.stop:
            for a, z in self.heredocs:
                if at == a:
                    at = min(z, self.stop)
                    broke = True
            m = self.LEX.match(self.src, at, self.stop)
            if not m or m.end() == at:
                at += 1
                continue
            kind = m.lastgroup
            if kind == "nl":
                broke = True
            elif kind == "comment":
                self.comments.append(N("comment", at, m.end()))
                broke = broke or "\n" in m.group()
            elif kind != "ws" or m.group() == "\\\n":
                if kind != "ws":
                    at = self.token(kind, at, m.end(), broke)
                    broke = False
                    continue
            at = m.end()

    def quoted(self, at: int, opening: str, close: str, line: bool = False) -> int:
        deep = 1
        while at < self.stop:
            c = self.src[at]
            if c == "\\":
                at += 2
                continue
            if c == "\n" and line:
                return -1
            if c == "#" and self.src[at + 1 : at + 2] == "{" and opening != "'":
                n = 1
                at += 2
                while at < self.stop and n:
                    if self.src[at] == '"':
                        at = self.quoted(at + 1, '"', '"')
                        continue
                    n += (self.src[at] == "{") - (self.src[at] == "}")
                    at += 1
                continue
            if c == close:
                deep -= 1
                if not deep:
                    return at + 1
            elif c == opening:
                deep += 1
            at += 1
        return -1 if line else self.stop

    # expressions
    def expression(self) -> N:
        start = self.here()
        n = self.not_()
        while self.at("and", "or") and self.type() == "id":
            o = self.operator()
            n = self.make("binary", start, self.tag(n, "left"), o, self.tag(self.not_(), "right"))
        return n

    def not_(self) -> N:
        start = self.here()
        if self.at("not"):
            o = self.operator()
            return self.make("unary", start, o, self.tag(self.not_(), "operand"))
        return self.argument()

    def argument(self) -> N:
        start = self.here()
        if self.at("*") and self.type() == "op":
            self.take()
            left = self.make("splat_argument", start, self.ternary())
        else:
            left = self.ternary()
        if self.at(",") and self.lhs and left.kind in ("identifier", "instance_variable", "call", "element_reference", "constant", "splat_argument", "global_variable") and self.multiple():
            kids = [left]
            while self.skip(","):
                kids.append(self.ternary() if not self.at("*") else self.splat())
            left = self.make("left_assignment_list", start, *kids)
        if self.at("="):
            self.take()
            s = self.here()
            right = self.argument_plain()
            if self.at(",") and self.lhs:
                kids = [right]
                while self.skip(","):
                    kids.append(self.argument_plain())
                right = self.make("right_assignment_list", s, *kids)
            if self.at("rescue") and not self.broke():
                self.take()
                right = self.make("rescue_modifier", s, self.tag(right, "body"), self.tag(self.argument_plain(), "handler"))
            return self.make("assignment", start, self.tag(left, "left"), self.tag(right, "right"))
        if self.type() == "op" and self.text()[-1:] == "=" and len(self.text()) > 1 and self.text() not in ("==", "!=", "<=", ">=", "==="):
            o = self.operator()
            return self.make("operator_assignment", start, self.tag(left, "left"), o, self.tag(self.argument_plain(), "right"))
        return left

    #: Whether a comma may go on with the left side of an assignment.
    lhs = True

    def argument_plain(self) -> N:
        was, self.lhs = self.lhs, False
        try:
            return self.splat() if self.at("*") and self.type() == "op" else self.argument()
        finally:
            self.lhs = was

    def splat(self) -> N:
        s = self.here()
        self.take()
        return self.make("splat_argument", s, self.ternary())

    def multiple(self) -> bool:
        j = self.i
        while j < len(self.toks) - 1 and not (self.toks[j][3] and j > self.i):
            t = self.src[self.toks[j][1] : self.toks[j][2]] if self.toks[j][0] == "op" else ""
            if t == "=":
                return True
            if t in ("(", "{", ")", "}", ";"):
                return False
            j += 1
        return False

    def ternary(self) -> N:
        start = self.here()
        n = self.binary(0)
        if self.at("?") and self.type() == "op" and not self.broke():
            self.take()
            if self.type() == "label":
                k, s, e, b = self.toks[self.i]
                self.toks[self.i : self.i + 1] = [("id", s, e - 1, b), ("op", e - 1, e, False)]
            yes = self.tag(self.ternary(), "consequence")
            self.take(":")
            return self.make("conditional", start, self.tag(n, "condition"), yes, self.tag(self.ternary(), "alternative"))
        return n

    def infix(self) -> str:
        return "" if self.broke() or self.type() != "op" else self.text()

    def joined(self, left: N, o: N, right: N) -> N:
        n = super().joined(left, o, right)
        if o.kind in ("..", "..."):
            n.kind = "range"
        return n

    def unary(self) -> N:
        start = self.here()
        if self.at("!", "-", "~", "+", "&") and self.type() == "op":
            o = self.operator()
            return self.make("unary", start, o, self.tag(self.unary(), "operand"))
        if self.at("defined?"):
            self.take()
            return self.make("unary", start, self.unary())
        return self.postfix(self.primary(), start)

    def postfix(self, n: N, start: int) -> N:
        while True:
            if self.at(".", "&.") and self.type() == "op":
                self.take()
                if self.at("("):
                    n = self.make("call", start, self.tag(n, "receiver"), self.tag(self.arguments(), "arguments"))
                    continue
                if self.type() == "label":
                    k, s, e, b = self.toks[self.i]
                    self.toks[self.i : self.i + 1] = [("id", s, e - 1, b), ("op", e - 1, e, False)]
                if self.type() not in ("id", "op"):
                    raise Unread("method")
                name = self.leaf("constant" if self.text()[0].isupper() else "identifier", "method")
                n = self.call(start, self.tag(n, "receiver"), name)
            elif self.at("::") and self.type() == "op":
                self.take()
                name = self.leaf("constant" if self.text()[0].isupper() else "identifier", "name")
                if self.at("(") and self.touching() or name.kind == "identifier":
                    n = self.call(start, self.tag(n, "receiver"), self.tag(name, "method"))
                else:
                    n = self.make("scope_resolution", start, self.tag(n, "scope"), name)
            elif self.at("[") and self.touching() and not self.broke():
                self.take()
                n = self.make("element_reference", start, self.tag(n, "object"), *self.listed("]", self.item))
            elif n.kind in ("call", "identifier", "super", "yield", "lambda_") and not self.broke() and (self.at("{") and n.kind != "yield" or self.at("do") and self.blocks):
                if n.kind == "call" and n.kids[-1].field == "block":
                    return n
                b = self.tag(self.block(), "block")
                if n.kind == "call":
                    n.kids.append(b)
                    n.end = self.last()
                else:
                    n = self.make("call", start, self.tag(n, "method"), b)
            else:
                return n

    #: Whether `do` opens a block: not in the header of a loop.
    blocks = True

    def touching(self) -> bool:
        return self.i > 0 and self.toks[self.i - 1][2] == self.here()

    def call(self, start: int, receiver: N | None, name: N) -> N:
        args = self.called()
        return self.make("call", start, receiver, name, self.tag(args, "arguments") if args else None)

    def called(self) -> N | None:
        """Arguments in parentheses, or of a command."""
        if self.at("(") and self.touching():
            return self.arguments()
        if self.broke() or self.eof() or self.touching():
            return None
        kind, t = self.type(), self.text()
        near = self.src[self.toks[self.i][2] : self.toks[self.i][2] + 1]
        starts = kind in ("str", "dstr", "sym", "num", "var", "label", "slabel", "regex", "heredoc", "pct") or kind == "id" and t not in _KEYWORDS - {"nil", "true", "false", "self", "not", "lambda", "proc", "super", "yield", "defined?", "case", "if"} - {"if"} or kind == "id" and t in ("nil", "true", "false", "self", "not", "super", "yield")
        starts = starts or kind == "op" and (t in ("->", "!") or t in ("[", "*", "&", "-", "::", ":", "**") and near not in (" ", "\n", "="))
        if not starts:
            return None
        s = self.here()
        was, self.lhs = self.lhs, False
        try:
            kids = [self.item()]
            while self.at(","):
                self.take()
                kids.append(self.item())
        finally:
            self.lhs = was
        return self.make("argument_list", s, *kids)

    def arguments(self) -> N:
        s = self.here()
        self.take("(")
        was, self.lhs, wasb, self.blocks = self.lhs, False, self.blocks, True
        kids = self.listed(")", self.item)
        self.lhs, self.blocks = was, wasb
        return self.make("argument_list", s, *kids)

    def item(self) -> N:
        """An argument, a pair or an element."""
        s = self.here()
        if self.type() == "label":
            _, a, z, _ = self.take()
            key = N("hash_key_symbol", a, z - 1, field="key")
            value = None if self.at(",", ")", "}") else self.tag(self.argument_plain(), "value")
            return self.make("pair", s, key, value)
        if self.type() == "slabel":
            _, a, z, _ = self.take()
            return self.make("pair", s, N("string", a, z - 1, field="key"), self.tag(self.argument_plain(), "value"))
        if self.at("*", "**", "&") and self.type() == "op":
            kind = {"*": "splat_argument", "**": "hash_splat_argument", "&": "block_argument"}[self.text()]
            self.take()
            return self.make(kind, s, self.ternary())
        was, self.lhs = self.lhs, False
        n = self.argument()
        self.lhs = was
        if self.skip("=>"):
            return self.make("pair", s, self.tag(n, "key"), self.tag(self.argument_plain(), "value"))
        return n

    def block(self) -> N:
        s = self.here()
        brace = self.at("{")
        self.take()
        was, self.lhs, wasb, self.blocks = self.lhs, True, self.blocks, True
        params = None
        if self.at("|"):
            p = self.here()
            self.take()
            kids = []
            while not self.at("|"):
                if self.type() == "id":
                    kids.append(self.leaf("identifier"))
                else:
                    self.take()
            self.take("|")
            params = self.make("block_parameters", p, *kids, field="parameters")
        elif self.skip("||"):
            pass
        b = self.here()
        kids = self.rescued("}" if brace else "end")
        self.take("}" if brace else "end")
        self.lhs, self.blocks = was, wasb
        body = N("block_body" if brace else "body_statement", b, kids[-1].end if kids else b, kids, "body")
        return self.make("block" if brace else "do_block", s, params, body if kids else None)

    def rescued(self, *close: str) -> list[N]:
        kids = self.statements(*close, "rescue", "ensure", "else")
        while self.at("rescue", "ensure", "else"):
            s, t = self.here(), self.text()
            self.take()
            if t == "rescue":
                parts: list[N | None] = []
                while not self.broke() and not self.at("then", ";"):
                    if self.skip("=>"):
                        parts.append(self.make("exception_variable", self.last(), self.primary(), field="variable"))
                    elif not self.skip(","):
                        parts.append(self.ternary())
                self.skip("then")
                parts += self.statements(*close, "rescue", "ensure", "else")
                kids.append(self.make("rescue", s, *parts))
            else:
                kids.append(self.make(t, s, *self.statements(*close, "rescue", "ensure", "else")))
        return kids

    def primary(self) -> N:
        start, kind, t = self.here(), self.type(), self.text()
        if kind in ("str", "dstr"):
            n = self.string()
            if self.type() in ("str", "dstr") and not self.broke():
                kids = [n]
                while self.type() in ("str", "dstr") and not self.broke():
                    kids.append(self.string())
                return self.make("chained_string", start, *kids)
            return n
        if kind == "heredoc":
            return self.leaf("heredoc_beginning")
        if kind == "pct":
            c = t[1]
            return self.leaf("string_array" if c in "wW" else "symbol_array" if c in "iI" else "regex" if c == "r" else "string")
        if kind == "regex":
            return self.leaf("regex")
        if kind == "sym":
            return self.leaf("delimited_symbol" if t[1] == '"' else "simple_symbol")
        if kind == "num":
            return self.leaf("float" if "." in t else "integer")
        if kind == "var":
            return self.leaf("global_variable" if t[0] == "$" else "class_variable" if t[:2] == "@@" else "instance_variable")
        if kind == "label":
            k, s, e, b = self.toks[self.i]
            self.toks[self.i : self.i + 1] = [("id", s, e - 1, b), ("op", e - 1, e, False)]
            return self.primary()
        if kind == "id":
            if t in ("true", "false", "nil", "self"):
                return self.leaf(t)
            f = getattr(self, "e_" + t, None)
            if f:
                return f(start)
            if t in ("super", "yield", "return", "break", "next"):
                self.take()
                n = N(t, start, self.last())
                if t in ("return", "break", "next") and (self.broke() or self.at("if", "unless", "}", "end", ";") or self.eof()):
                    return n
                args = self.called() if t in ("super", "yield") else self.make("argument_list", self.here(), self.argument())
                return self.make("call" if t == "super" else t, start, self.tag(n, "method") if t == "super" else None, self.tag(args, "arguments") if args and t == "super" else args)
            if t in _KEYWORDS:
                raise Unread(t)
            const = t[0].isupper()
            name = self.leaf("constant" if const else "identifier")
            if const and not (self.at("(") and self.touching()) and not self.type() in ("str", "dstr"):
                return name
            args = self.called()
            if args:
                return self.make("call", start, self.tag(name, "method"), self.tag(args, "arguments"))
            return name
        if t == "(":
            self.take()
            was, self.lhs, wasb, self.blocks = self.lhs, True, self.blocks, True
            kids = self.statements(")")
            self.lhs, self.blocks = was, wasb
            self.take(")")
            return self.make("parenthesized_statements", start, *kids)
        if t == "[":
            self.take()
            return self.make("array", start, *self.listed("]", self.item))
        if t == "{":
            self.take()
            return self.make("hash", start, *self.listed("}", self.item))
        if t == "->":
            self.take()
            params = None
            if self.at("("):
                params = self.tag(self.parameters(), "parameters")
            while self.type() == "id" and not self.at("do"):
                self.take()
            return self.make("lambda", start, params, self.tag(self.block(), "body"))
        if t == "::":
            self.take()
            return self.make("scope_resolution", start, self.leaf("constant", "name"))
        if t in ("..", "..."):
            self.take()
            return self.make("range", start, self.binary(3))
        raise Unread(t)

    def string(self) -> N:
        kind, s, e, _ = self.take()
        z = e - 1 if e - s > 1 and self.src[e - 1] == self.src[s] else e
        if kind == "str":
            return N("string", s, e, [N("string_content", s + 1, z)] if z > s + 1 else [])
        kids, at = [], s + 1
        low = at
        while at < z:
            if self.src[at] == "\\":
                at += 2
            elif self.src[at] == "#" and self.src[at + 1 : at + 2] == "{":
                if at > low:
                    kids.append(N("string_content", low, at))
                n, q = 1, at + 2
                while q < z and n:
                    n += (self.src[q] == "{") - (self.src[q] == "}")
                    q += 1
                kids.append(N("interpolation", at, q, self.inner(at + 2, q - 1)[:1]))
                at = low = q
            else:
                at += 1
        if low < z:
            kids.append(N("string_content", low, z))
        return N("subshell" if self.src[s] == "`" else "string", s, e, kids)

    # compound expressions
    def header(self) -> N:
        was, self.blocks = self.blocks, False
        try:
            return self.expression()
        finally:
            self.blocks = was

    def branch(self, *close: str) -> N:
        self.skip("then", ";")
        s = self.here()
        kids = self.statements(*close)
        return N("then", s, kids[-1].end if kids else s, kids, "consequence")

    def e_if(self, start: int) -> N:
        kind = self.text()
        self.take()
        kids = [self.tag(self.header(), "condition"), self.branch("elsif", "else", "end")]
        if self.at("elsif"):
            kids.append(self.tag(self.e_if(self.here()), "alternative"))
            return self.make(kind, start, *kids)
        if self.at("else"):
            s = self.here()
            self.take()
            kids.append(self.make("else", s, *self.statements("end"), field="alternative"))
        self.take("end")
        return self.make(kind, start, *kids)

    e_unless = e_if

    def e_while(self, start: int) -> N:
        kind = self.text()
        self.take()
        c = self.tag(self.header(), "condition")
        self.skip("do")
        s = self.here()
        kids = self.statements("end")
        self.take("end")
        return self.make(kind, start, c, N("do", s, self.last(), kids, "body"))

    e_until = e_while

    def e_for(self, start: int) -> N:
        self.take()
        names = [self.primary()]
        while self.skip(","):
            names.append(self.primary())
        self.take("in")
        value = self.tag(self.header(), "value")
        self.skip("do")
        s = self.here()
        kids = self.statements("end")
        self.take("end")
        return self.make("for", start, *names, value, N("do", s, self.last(), kids, "body"))

    def e_case(self, start: int) -> N:
        self.take()
        value = None if self.at("when") else self.tag(self.expression(), "value")
        kids = []
        while self.at("when", "in"):
            s = self.here()
            self.take()
            values = [self.item()]
            while self.skip(","):
                values.append(self.item())
            kids.append(self.make("when", s, *values, self.branch("when", "in", "else", "end")))
        if self.at("else"):
            s = self.here()
            self.take()
            kids.append(self.make("else", s, *self.statements("end")))
        self.take("end")
        return self.make("case", start, value, *kids)

    def e_begin(self, start: int) -> N:
        self.take()
        kids = self.rescued("end")
        self.take("end")
        return self.make("begin", start, *kids)

    def body(self) -> N | None:
        s = self.here()
        kids = self.rescued("end")
        self.take("end")
        return N("body_statement", s, kids[-1].end, kids, "body") if kids else None

    def path(self) -> N:
        s = self.here()
        n = self.leaf("constant")
        while self.skip("::"):
            n = self.make("scope_resolution", s, self.tag(n, "scope"), self.leaf("constant", "name"))
        return self.tag(n, "name")

    def e_class(self, start: int) -> N:
        self.take()
        if self.skip("<<"):
            value = self.tag(self.expression(), "value")
            return self.make("singleton_class", start, value, self.body())
        name, above = self.path(), None
        if self.at("<"):
            s = self.here()
            self.take()
            above = self.make("superclass", s, self.expression(), field="superclass")
        return self.make("class", start, name, above, self.body())

    def e_module(self, start: int) -> N:
        self.take()
        return self.make("module", start, self.path(), self.body())

    def parameters(self) -> N:
        s = self.here()
        paren = self.skip("(")
        kids = []
        while not (self.at(")") if paren else self.broke() or self.at(";", "=")):
            if self.eof():
                raise Unread(")")
            p = self.here()
            if self.skip(","):
                continue
            if self.type() == "label":
                _, a, z, _ = self.take()
                value = None if self.at(",", ")") or self.broke() else self.tag(self.ternary(), "value")
                kids.append(self.make("keyword_parameter", p, N("identifier", a, z - 1, field="name"), value))
                continue
            if self.at("*", "**", "&", "..."):
                kind = {"*": "splat_parameter", "**": "hash_splat_parameter", "&": "block_parameter"}.get(self.text(), "forward_parameter")
                self.take()
                kids.append(self.make(kind, p, self.leaf("identifier", "name") if self.type() == "id" else None))
                continue
            if self.type() != "id":
                raise Unread("parameter")
            name = self.leaf("identifier")
            if self.skip("="):
                kids.append(self.make("optional_parameter", p, self.tag(name, "name"), self.tag(self.ternary(), "value")))
            else:
                kids.append(name)
        if paren:
            self.take(")")
        return self.make("method_parameters", s, *kids)

    def e_def(self, start: int) -> N:
        self.take()
        kind, owner = "method", None
        if self.text(1) == "." and self.type(1) == "op":
            owner = self.tag(self.primary(), "object")
            self.take(".")
            kind = "singleton_method"
        if self.type() not in ("id", "op", "label"):
            raise Unread("name")
        name = self.leaf("identifier", "name")
        if self.at("=") and self.touching() and self.text(1) == "(":
            self.take()
            name = N("setter", name.start, self.last(), [name], "name")
        params = None
        if self.at("(") or not self.broke() and not self.at(";", "="):
            params = self.tag(self.parameters(), "parameters")
        if self.at("=") and not self.broke():
            self.take()
            return self.make(kind, start, owner, name, params, self.tag(self.expression(), "body"))
        return self.make(kind, start, owner, name, params, self.body())

    def e_alias(self, start: int) -> N:
        self.take()
        return self.make("alias", start, self.leaf("identifier"), self.leaf("identifier"))

    def statement(self) -> N | None:
        start = self.here()
        if self.skip(";"):
            return None
        self.blocks = True
        n = self.expression()
        while self.at("if", "unless", "while", "until", "rescue") and self.type() == "id" and not self.broke():
            t = self.text()
            self.take()
            n = self.make(f"{t}_modifier", start, self.tag(n, "body"), self.tag(self.expression(), "handler" if t == "rescue" else "condition"))
        if not (self.broke() or self.eof() or self.at(";", "}", ")", "end", "else", "elsif", "when", "rescue", "ensure", "then")):
            raise Unread("rest of line")
        return n
