"""Python front end."""

from __future__ import annotations

import re

from sylva.sources.syntax import N, Parser, Unread

_OPS = r"\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%@&|^!=<>:]=|->|\*\*|//|<<|>>|<>|[-+*/%@&|^~<>()\[\]{},:;.=`!]"
_STRING = r"[rRbBuUfF]{0,2}(?:'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'(?:\\[\s\S]|[^\\'\n])*'?|\"(?:\\[\s\S]|[^\\\"\n])*\"?)"
_KEYWORDS = {"if", "elif", "else", "for", "while", "in", "not", "and", "or", "is", "lambda", "return", "import", "from", "class", "def", "with", "as", "try", "except", "finally", "raise", "pass", "break", "continue", "global", "nonlocal", "assert", "del", "yield", "await", "async"}
_COMPARE = {"<", ">", "==", "!=", "<=", ">=", "<>", "in", "is", "not"}


class Python(Parser):
    ROOT = "module"
    LEX = re.compile(rf"(?P<ws>[ \t\f\r]+|\\\r?\n)|(?P<nl>\n)|(?P<comment>#[^\n]*)|(?P<str>{_STRING})|(?P<num>0[xXoObB][0-9a-fA-F_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*(?:\.(?![.\w]))?(?:[eE][+-]?[0-9]+)?[jJlL]?)|(?P<id>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<op>{_OPS})")
    BINARY = {"|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10, "**": 12}
    RIGHT = frozenset(["**"])
    BINARY_KIND = "binary_operator"

    def lex(self) -> None:
        super().lex()
        if self.start == 0 and self.stop == len(self.src):
            self.toks = self._indented(self.toks)

    def _indented(self, toks: list) -> list:
        """Adds tokens newline, indent and dedent."""
        out, deep, levels = [], 0, [0]
        for t in toks:
            kind, start, end, broke = t
            text = self.src[start:end] if kind == "op" else ""
            if broke and deep == 0:
                line = self.src.rfind("\n", 0, start) + 1
                width = len(self.src[line:start].expandtabs(8)) if self.src[line:start].strip(" \t\f\r") == "" else levels[-1]
                if out:
                    out.append(("newline", out[-1][2], out[-1][2], False))
                if width > levels[-1]:
                    levels.append(width)
                    out.append(("indent", start, start, False))
                while width < levels[-1]:
                    levels.pop()
                    out.append(("dedent", out[-1][2], out[-1][2], False))
            out.append((kind, start, end, broke))
            deep = max(0, deep + (text in ("(", "[", "{")) - (text in (")", "]", "}")))
        end = out[-1][2] if out else self.start
        out.append(("newline", end, end, False))
        out += [("dedent", end, end, False)] * (len(levels) - 1)
        return out

    def recover(self, start: int) -> N:
        while not self.eof() and self.type() not in ("newline", "dedent"):
            self.i += 1
        if self.type() == "newline":
            self.i += 1
        if self.type() == "indent":
            self.i += 1
            self.statements()
            if self.type() == "dedent":
                self.i += 1
        return N("ERROR", start, max(start, self.last()))

    def statements(self, *close: str) -> list[N]:
        out = []
        while not self.eof() and self.type() != "dedent":
            if self.type() in ("newline", "indent") or self.at(";"):
                self.i += 1
                continue
            i, start = self.i, self.here()
            self.depth = 0
            try:
                out.append(self.statement())
                if not (self.type() in ("newline", "dedent", "eof") or self.at(";") or self.toks[self.i - 1][0] in ("newline", "dedent")):
                    raise Unread("rest of line")
            except (Unread, RecursionError):
                if out and self.i > i and out[-1].start == start:
                    out.pop()
                self.i = i
                out.append(self.recover(start))
            if self.i == i:
                self.i += 1
        return out

    def block(self) -> N:
        self.take(":")
        if self.type() != "newline":
            kids = []
            start = self.here()
            while True:
                kids.append(self.simple())
                if not self.skip(";") or self.type() in ("newline", "eof"):
                    break
            return N("block", start, self.last(), kids, "body")
        self.take()
        if self.type() != "indent":
            raise Unread("indent")
        self.take()
        start = self.here()
        kids = self.statements()
        end = kids[-1].end if kids else self.last()
        if self.type() == "dedent":
            self.take()
        return N("block", start, end, kids, "body")

    def statement(self) -> N:
        start, t = self.here(), self.text()
        if self.type() == "id":
            if t == "async" and self.text(1) in ("def", "for", "with"):
                self.take()
                n = self.statement()
                n.start = start
                return n
            f = {"if": self.if_, "while": self.while_, "for": self.for_, "try": self.try_, "with": self.with_, "def": self.def_, "class": self.class_}.get(t)
            if f:
                return f(start)
            if t == "match" and self.type(1) in ("id", "str") and not self.text(1) in _KEYWORDS:
                n = self.tried(lambda: self.match_(start))
                if n:
                    return n
        if t == "@" and self.type() == "op":
            kids = []
            while self.at("@"):
                s = self.here()
                self.take()
                kids.append(self.make("decorator", s, self.expression()))
                if self.type() == "newline":
                    self.take()
            kids.append(self.tag(self.statement(), "definition"))
            return N("decorated_definition", start, kids[-1].end, kids)
        return self.simple()

    def ended(self, kind: str, start: int, *kids: N | None) -> N:
        held = [k for k in kids if k is not None]
        return N(kind, start, held[-1].end if held else self.last(), held)

    def if_(self, start: int) -> N:
        self.take()
        kids = [self.tag(self.named(), "condition"), self.tag(self.block(), "consequence")]
        while self.at("elif", "else"):
            s = self.here()
            if self.take() and self.src[s : s + 4] == "elif":
                kids.append(self.tag(self.ended("elif_clause", s, self.tag(self.named(), "condition"), self.tag(self.block(), "consequence")), "alternative"))
            else:
                kids.append(self.tag(self.ended("else_clause", s, self.block()), "alternative"))
        return self.ended("if_statement", start, *kids)

    def orelse(self) -> N | None:
        if self.at("else"):
            s = self.here()
            self.take()
            return self.tag(self.ended("else_clause", s, self.block()), "alternative")
        return None

    def while_(self, start: int) -> N:
        self.take()
        return self.ended("while_statement", start, self.tag(self.named(), "condition"), self.block(), self.orelse())

    def for_(self, start: int) -> N:
        self.take()
        left = self.tag(self.targets(), "left")
        self.take("in")
        right = self.tag(self.listing("expression_list"), "right")
        return self.ended("for_statement", start, left, right, self.block(), self.orelse())

    def try_(self, start: int) -> N:
        self.take()
        kids = [self.block()]
        while self.at("except", "finally", "else"):
            s, t = self.here(), self.text()
            self.take()
            if t == "except":
                self.skip("*")
                value = None if self.at(":") else self.as_(self.listing("tuple"))
                body = self.block()
                body.field = None
                kids.append(self.ended("except_clause", s, value, body))
            else:
                body = self.block()
                kids.append(self.ended(t + "_clause", s, body))
        return self.ended("try_statement", start, *kids)

    def as_(self, n: N) -> N:
        if self.at("as"):
            self.take()
            alias = self.unary()
            return N("as_pattern", n.start, alias.end, [n, N("as_pattern_target", alias.start, alias.end, [alias], "alias")])
        return n

    def with_(self, start: int) -> N:
        self.take()

        def item() -> N:
            s = self.here()
            v = self.as_(self.expression())
            return self.make("with_item", s, self.tag(v, "value"))

        s = self.here()
        wrapped = None
        if self.at("("):
            def grouped() -> list[N]:
                self.take("(")
                items = self.listed(")", item)
                if not self.at(":"):
                    raise Unread(":")
                return items

            wrapped = self.tried(grouped)
        items = wrapped if wrapped is not None else [item()]
        while wrapped is None and self.skip(","):
            items.append(item())
        clause = N("with_clause", s, self.last(), items)
        return self.ended("with_statement", start, clause, self.block())

    def match_(self, start: int) -> N:
        self.take()
        subject = self.tag(self.listing("tuple"), "subject")
        self.take(":")
        if self.type() != "newline":
            raise Unread("match")
        self.take()
        if self.type() != "indent":
            raise Unread("match")
        self.take()
        kids = []
        while self.at("case"):
            s = self.here()
            self.take()
            pattern = self.listing("case_pattern")
            guard = None
            if self.at("if"):
                g = self.here()
                self.take()
                guard = self.tag(self.make("if_clause", g, self.expression()), "guard")
            kids.append(self.ended("case_clause", s, N("case_pattern", pattern.start, pattern.end, [pattern]), guard, self.tag(self.block(), "consequence")))
        if self.type() == "dedent":
            self.take()
        return self.ended("match_statement", start, subject, *kids)

    def parameters(self, close: str, kind: str) -> N:
        start = self.here() - (0 if kind == "lambda_parameters" else 1)

        def one() -> N | None:
            s = self.here()
            if self.at("/", "*") and (self.text(1) in (",", close)):
                return self.leaf("keyword_separator" if self.text() == "*" else "positional_separator")
            if self.at("*", "**"):
                what = "list_splat_pattern" if self.text() == "*" else "dictionary_splat_pattern"
                self.take()
                n = self.make(what, s, self.leaf("identifier"))
            elif self.at("("):
                n = self.atom()
            else:
                if self.type() != "id":
                    raise Unread("parameter")
                n = self.leaf("identifier")
            kind_of = None
            if kind == "parameters" and self.at(":"):
                self.take()
                a = self.here()
                kind_of = N("type", a, 0, [self.expression()], "type")
                kind_of.end = self.last()
            if self.skip("="):
                value = self.tag(self.expression(), "value")
                name = self.tag(n, "name")
                return self.make("typed_default_parameter", s, name, kind_of, value) if kind_of else self.make("default_parameter", s, name, value)
            return self.make("typed_parameter", s, n, kind_of) if kind_of else n

        kids = []
        while not self.at(close):
            if self.skip(","):
                continue
            kids.append(one())
            if not self.at(close, ","):
                raise Unread(close)
        if kind == "parameters":
            self.take(close)
        return N(kind, start, self.last() if kind == "parameters" or kids else start, [k for k in kids if k], "parameters")

    def def_(self, start: int) -> N:
        self.take()
        name = self.leaf("identifier", "name")
        if self.at("["):
            self.type_parameters()
        self.take("(")
        params = self.parameters(")", "parameters")
        result = None
        if self.skip("->"):
            s = self.here()
            result = N("type", s, 0, [self.expression()], "return_type")
            result.end = self.last()
        return self.ended("function_definition", start, name, params, result, self.block())

    def type_parameters(self) -> None:
        self.take("[")
        self.listed("]", self.expression)

    def class_(self, start: int) -> N:
        self.take()
        name = self.leaf("identifier", "name")
        if self.at("["):
            self.type_parameters()
        supers = None
        if self.at("("):
            supers = self.tag(self.arguments(), "superclasses")
        return self.ended("class_definition", start, name, supers, self.block())

    def dotted(self) -> N:
        start = self.here()
        kids = [self.leaf("identifier")]
        while self.at("."):
            self.take()
            kids.append(self.leaf("identifier"))
        return self.make("dotted_name", start, *kids)

    def aliased(self) -> N:
        n = self.dotted()
        if self.at("as"):
            self.take()
            return self.make("aliased_import", n.start, self.tag(n, "name"), self.leaf("identifier", "alias"), field="name")
        return self.tag(n, "name")

    def simple(self) -> N:
        start, t = self.here(), self.text()
        done = lambda: self.type() in ("newline", "eof", "dedent") or self.at(";")
        if self.type() == "id":
            if t in ("pass", "break", "continue"):
                self.take()
                return self.make(t + "_statement", start)
            if t == "return":
                self.take()
                return self.make("return_statement", start, None if done() else self.listing("expression_list"))
            if t == "import":
                self.take()
                kids = [self.aliased()]
                while self.skip(","):
                    kids.append(self.aliased())
                return self.make("import_statement", start, *kids)
            if t == "from":
                self.take()
                s = self.here()
                dots = 0
                while self.at(".", "..."):
                    self.take()
                    dots += 1
                name = None if self.at("import") else self.dotted()
                if dots:
                    name = N("relative_import", s, self.last(), [N("import_prefix", s, name.start if name else self.last()), *([name] if name else [])])
                self.take("import")
                if self.at("*"):
                    return self.make("import_from_statement", start, self.tag(name, "module_name"), self.leaf("wildcard_import"))
                if self.skip("("):
                    kids = self.listed(")", self.aliased)
                else:
                    kids = [self.aliased()]
                    while self.skip(","):
                        kids.append(self.aliased())
                return self.make("future_import_statement" if name.kind == "dotted_name" and self.src[name.start : name.end] == "__future__" else "import_from_statement", start, self.tag(name, "module_name"), *kids)
            if t == "assert":
                self.take()
                kids = [self.expression()]
                while self.skip(","):
                    kids.append(self.expression())
                return self.make("assert_statement", start, *kids)
            if t == "raise":
                self.take()
                value = None if done() else self.listing("expression_list")
                cause = None
                if self.at("from"):
                    self.take()
                    cause = self.tag(self.expression(), "cause")
                return self.make("raise_statement", start, value, cause)
            if t in ("global", "nonlocal"):
                self.take()
                kids = [self.leaf("identifier")]
                while self.skip(","):
                    kids.append(self.leaf("identifier"))
                return self.make(t + "_statement", start, *kids)
            if t == "del":
                self.take()
                return self.make("delete_statement", start, self.listing("expression_list"))
            if t in ("print", "exec") and (self.type(1) in ("str", "num") or self.type(1) == "id" and self.text(1) not in _KEYWORDS):
                self.take()
                kids = [self.tag(self.expression(), "argument")]
                while self.skip(","):
                    if not done():
                        kids.append(self.tag(self.expression(), "argument"))
                return self.make(t + "_statement", start, *kids)
        n = self.assignment()
        return N("expression_statement", start, n.end, [n])

    def assignment(self) -> N:
        left = self.listing("expression_list")
        if self.at("="):
            if left.kind in ("expression_list", "tuple"):
                left.kind = {"expression_list": "pattern_list", "tuple": "tuple_pattern"}[left.kind]
            self.take()
            right = self.tag(self.assignment(), "right")
            return N("assignment", left.start, right.end, [self.tag(left, "left"), right])
        if self.at(":"):
            self.take()
            s = self.here()
            of = N("type", s, 0, [self.expression()], "type")
            of.end = self.last()
            right = None
            if self.skip("="):
                right = self.tag(self.listing("expression_list"), "right")
            return self.make("assignment", left.start, self.tag(left, "left"), of, right)
        if self.type() == "op" and self.text()[-1:] == "=" and self.text() not in ("==", "!=", "<=", ">=", "=") and len(self.text()) > 1:
            o = self.operator()
            right = self.tag(self.listing("expression_list"), "right")
            return N("augmented_assignment", left.start, right.end, [self.tag(left, "left"), o, right])
        return left

    def targets(self) -> N:
        """Names before `in`."""
        start = self.here()
        kids = [self.starred(self.binary(5) if not self.at("*") else None)]
        comma = False
        while self.skip(","):
            comma = True
            if self.at("in"):
                break
            kids.append(self.starred(self.binary(5) if not self.at("*") else None))
        return kids[0] if not comma else self.make("pattern_list", start, *kids)

    def starred(self, n: N | None) -> N:
        if n is not None:
            return n
        s = self.here()
        self.take()
        return self.make("list_splat_pattern", s, self.binary(5))

    def listing(self, kind: str) -> N:
        """An expression, or several with commas between them."""
        start = self.here()
        kids = [self.named()]
        comma = False
        while self.at(","):
            self.take()
            comma = True
            if self.type() in ("newline", "eof", "dedent") or self.at("=", ":", ")", "]", "}", ";"):
                break
            kids.append(self.named())
        return self.make(kind, start, *kids) if comma else kids[0]

    def named(self) -> N:
        s = self.here()
        if self.at("*", "**"):
            kind = "list_splat" if self.text() == "*" else "dictionary_splat"
            self.take()
            return self.make(kind, s, self.binary(5))
        if self.type() == "id" and self.text(1) == ":=" and self.type(1) == "op":
            name = self.leaf("identifier", "name")
            self.take()
            return self.make("named_expression", s, name, self.tag(self.expression(), "value"))
        return self.expression()

    def expression(self) -> N:
        start = self.here()
        if self.at("lambda"):
            self.take()
            params = None if self.at(":") else self.parameters(":", "lambda_parameters")
            self.take(":")
            return self.make("lambda", start, params, self.tag(self.expression(), "body"))
        if self.at("yield"):
            self.take()
            self.skip("from")
            rest = None if self.type() in ("newline", "eof") or self.at(")", "]", "}", "=", ",") else self.listing("expression_list")
            return self.make("yield", start, rest)
        n = self.boolean("or")
        if self.at("if"):
            self.take()
            middle = self.boolean("or")
            self.take("else")
            return self.make("conditional_expression", start, n, middle, self.expression())
        return n

    def boolean(self, op: str) -> N:
        deeper = (lambda: self.boolean("and")) if op == "or" else self.inverted
        left = deeper()
        while self.at(op):
            o = self.operator()
            right = deeper()
            left = N("boolean_operator", left.start, right.end, [self.tag(left, "left"), o, self.tag(right, "right")])
        return left

    def inverted(self) -> N:
        start = self.here()
        if self.at("not"):
            self.take()
            return self.make("not_operator", start, self.tag(self.inverted(), "argument"))
        return self.comparison()

    def comparison(self) -> N:
        left = self.binary(5)
        kids = [left]
        while self.at(*_COMPARE) and not (self.at("not") and self.text(1) != "in"):
            s = self.here()
            t = self.text()
            self.take()
            if t == "not" or t == "is" and self.at("not"):
                self.take()
            kids.append(N(re.sub(r"\s+", " ", self.src[s : self.last()]), s, self.last(), field="operators", named=False))
            kids.append(self.binary(5))
        return left if len(kids) == 1 else N("comparison_operator", left.start, kids[-1].end, kids)

    def infix(self) -> str:
        return self.text() if self.type() == "op" else ""

    def unary(self) -> N:
        start = self.here()
        if self.at("-", "+", "~"):
            o = self.operator()
            return self.make("unary_operator", start, o, self.tag(self.binary(11), "argument"))
        if self.at("await"):
            self.take()
            return self.make("await", start, self.unary())
        n = self.atom()
        while True:
            if self.at("."):
                self.take()
                if self.type() != "id":
                    raise Unread("attribute")
                n = self.make("attribute", start, self.tag(n, "object"), self.leaf("identifier", "attribute"))
            elif self.at("("):
                n = self.make("call", start, self.tag(n, "function"), self.tag(self.arguments(), "arguments"))
            elif self.at("["):
                self.take()
                kids = self.listed("]", lambda: self.tag(self.subscript(), "subscript"))
                n = self.make("subscript", start, self.tag(n, "value"), *kids)
            else:
                return n

    def subscript(self) -> N:
        start = self.here()
        first = None if self.at(":") else self.named()
        if not self.at(":"):
            return first
        kids = [first]
        while self.skip(":"):
            if not self.at(":", "]", ","):
                kids.append(self.expression())
        return self.make("slice", start, *kids)

    def arguments(self) -> N:
        start = self.here()
        self.take("(")
        kids = []
        while not self.at(")"):
            if self.skip(","):
                continue
            s = self.here()
            if self.type() == "id" and self.text(1) == "=" and self.type(1) == "op":
                name = self.leaf("identifier", "name")
                self.take()
                kids.append(self.make("keyword_argument", s, name, self.tag(self.expression(), "value")))
            else:
                n = self.named()
                if self.at("for", "async"):
                    clauses = self.clauses()
                    self.take(")")
                    return N("generator_expression", start, self.last(), [self.tag(n, "body"), *clauses])
                kids.append(n)
            if not self.at(")", ","):
                raise Unread(")")
        self.take(")")
        return self.make("argument_list", start, *kids)

    def clauses(self) -> list[N]:
        out = []
        while self.at("for", "async", "if"):
            s = self.here()
            if self.at("if"):
                self.take()
                out.append(self.make("if_clause", s, self.boolean("or")))
                continue
            self.skip("async")
            self.take("for")
            left = self.tag(self.targets(), "left")
            self.take("in")
            out.append(self.make("for_in_clause", s, left, self.tag(self.boolean("or"), "right")))
        return out

    def atom(self) -> N:
        start, kind, t = self.here(), self.type(), self.text()
        if kind == "str":
            parts = []
            while self.type() == "str":
                parts.append(self.string())
            return parts[0] if len(parts) == 1 else self.make("concatenated_string", start, *parts)
        if kind == "num":
            return self.leaf("float" if re.search(r"[.jJ]|^[0-9_]+[eE]", t) and not t[:2].lower() == "0x" else "integer")
        if kind == "id":
            if t in ("True", "False", "None"):
                return self.leaf(t.lower())
            if t in _KEYWORDS:
                raise Unread(t)
            return self.leaf("identifier")
        if t == "...":
            return self.leaf("ellipsis")
        if t == "(":
            self.take()
            if self.skip(")"):
                return self.make("tuple", start)
            kids, comma = [self.named()], False
            if self.at("for", "async"):
                clauses = self.clauses()
                self.take(")")
                return self.make("generator_expression", start, self.tag(kids[0], "body"), *clauses)
            while self.skip(","):
                comma = True
                if not self.at(")"):
                    kids.append(self.named())
            self.take(")")
            return self.make("tuple" if comma else "parenthesized_expression", start, *kids)
        if t == "[":
            self.take()
            if self.skip("]"):
                return self.make("list", start)
            first = self.named()
            if self.at("for", "async"):
                clauses = self.clauses()
                self.take("]")
                return self.make("list_comprehension", start, self.tag(first, "body"), *clauses)
            if not self.at("]"):
                self.take(",")
            return self.make("list", start, first, *self.listed("]", self.named))
        if t == "{":
            self.take()
            kids, pairs = [], True
            while not self.at("}"):
                if self.skip(","):
                    continue
                s = self.here()
                n = self.named()
                if self.skip(":"):
                    n = self.make("pair", s, self.tag(n, "key"), self.tag(self.expression(), "value"))
                elif n.kind != "dictionary_splat":
                    pairs = False
                if self.at("for", "async"):
                    clauses = self.clauses()
                    self.take("}")
                    return self.make("dictionary_comprehension" if n.kind == "pair" else "set_comprehension", start, self.tag(n, "body"), *clauses)
                kids.append(n)
                if not self.at("}", ","):
                    raise Unread("}")
            self.take("}")
            return self.make("dictionary" if pairs else "set", start, *kids)
        raise Unread(t)

    def string(self) -> N:
        _, start, end, _ = self.take()
        prefix = re.match(r"[rRbBuUfF]{0,2}('''|\"\"\"|'|\")", self.src[start:end])
        a = start + prefix.end()
        z = end - len(prefix[1]) if self.src[start:end].endswith(prefix[1]) and end - len(prefix[1]) >= a else end
        kids = [N("string_start", start, a)]
        if "f" in prefix[0].lower():
            at = low = a
            while at < z:
                c = self.src[at]
                if c == "{" and self.src[at + 1 : at + 2] != "{":
                    if at > low:
                        kids.append(N("string_content", low, at))
                    deep, e, quote, spec = 1, at + 1, "", -1
                    while e < z and deep:
                        x = self.src[e]
                        if quote:
                            quote = "" if x == quote else quote
                        elif x in "'\"":
                            quote = x
                        elif x in "([{":
                            deep += 1
                        elif x in ")]}":
                            deep -= 1
                        elif deep == 1 and spec < 0 and (x == ":" or x == "!" and self.src[e + 1 : e + 2] != "="):
                            spec = e
                        e += 1
                    stop = spec if spec >= 0 else e - 1
                    inside = [self.tag(n, "expression") for n in self.inner(at + 1, stop)[:1]]
                    kids.append(N("interpolation", at, e, inside))
                    at = low = e
                elif c in "{}" and self.src[at + 1 : at + 2] == c:
                    at += 2
                else:
                    at += 1
            if low < z:
                kids.append(N("string_content", low, z))
        elif z > a:
            kids.append(N("string_content", a, z))
        if z < end:
            kids.append(N("string_end", z, end))
        return N("string", start, end, kids)
