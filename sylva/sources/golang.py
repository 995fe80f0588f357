"""Go front end."""

from __future__ import annotations

import re

from sylva.sources.syntax import N, Parser, Unread

_OPS = r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|:=|[-+*/%&|^=!<>]=|<<|>>|&\^|[-+*/%&|^<>=!~()\[\]{},;.:]"
_ENDS = {"id", "num", "str", "rune"}
_KEYWORDS = {"break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"}


class Go(Parser):
    ROOT = "source_file"
    LEX = re.compile(rf"(?P<ws>[ \t\f\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>`[^`]*`?|\"(?:\\[^\n]|[^\\\"\n])*\"?)|(?P<rune>'(?:\\[^\n]|[^\\'\n])+'?)|(?P<num>0[xXoObB][0-9a-fA-F_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?i?)|(?P<id>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<op>{_OPS})")
    BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
    #: Whether a brace after a type opens a literal: not in the header of a statement.
    literal = True

    def infix(self) -> str:
        return "" if self.broke() else super().infix()

    def ended(self) -> bool:
        return self.eof() or self.broke() or self.at(";", "}", ")")

    def end(self) -> None:
        if not self.skip(";") and not self.ended() and not self.at("case", "default"):
            raise Unread(";")

    def held(self, literal: bool, f):
        was, self.literal = self.literal, literal
        try:
            return f()
        finally:
            self.literal = was

    # types
    def type_(self) -> N:
        start = self.here()
        t = self.text()
        if self.skip("*"):
            return self.make("pointer_type", start, self.type_())
        if self.skip("("):
            n = self.type_()
            self.take(")")
            return self.make("parenthesized_type", start, n)
        if t == "[":
            self.take()
            if self.skip("]"):
                return self.make("slice_type", start, self.tag(self.type_(), "element"))
            size = None
            if not self.skip("..."):
                size = self.tag(self.held(True, self.expression), "length")
            self.take("]")
            return self.make("array_type", start, size, self.tag(self.type_(), "element"))
        if t == "map" and self.text(1) == "[":
            self.take()
            self.take("[")
            key = self.tag(self.type_(), "key")
            self.take("]")
            return self.make("map_type", start, key, self.tag(self.type_(), "value"))
        if t in ("chan", "<-"):
            self.take()
            self.skip("chan")
            self.skip("<-")
            return self.make("channel_type", start, self.tag(self.type_(), "value"))
        if t == "func":
            self.take()
            return self.make("function_type", start, self.parameters("parameters"), self.result())
        if t in ("struct", "interface"):
            self.take()
            s = self.here()
            self.take("{")
            kids = []
            while not self.at("}"):
                if self.eof():
                    raise Unread("}")
                if self.skip(";"):
                    continue
                kids.append(self.member(t))
            self.take("}")
            if t == "struct":
                return self.make("struct_type", start, N("field_declaration_list", s, self.last(), kids))
            return self.make("interface_type", start, *kids)
        if self.type() != "id" or t in _KEYWORDS:
            raise Unread("type")
        if self.text(1) == "." and self.type(2) == "id":
            package = self.leaf("package_identifier", "package")
            self.take()
            n = self.make("qualified_type", start, package, self.leaf("type_identifier", "name"))
        else:
            n = self.leaf("type_identifier")
        if self.at("[") and not self.broke() and self.toks[self.i][1] == n.end:
            def generic() -> N:
                self.take("[")
                s = self.last() - 1
                kids = self.listed("]", self.type_)
                return self.make("generic_type", start, self.tag(n, "type"), N("type_arguments", s, self.last(), kids, "type_arguments"))

            return self.tried(generic) or n
        return n

    def member(self, of: str) -> N:
        start = self.here()
        if of == "interface":
            if self.type() == "id" and self.text(1) == "(":
                name = self.leaf("field_identifier", "name")
                return self.make("method_elem", start, name, self.parameters("parameters"), self.result())
            kids = []
            while True:
                self.skip("~")
                kids.append(self.type_())
                if not self.skip("|"):
                    return self.make("type_elem", start, *kids)
        if self.at("*") or self.type() == "id" and (self.text(1) == "." or self.toks[self.i + 1][3] or self.type(1) == "str"):
            n = self.make("field_declaration", start, self.tag(self.type_(), "type"))
        else:
            names = [self.leaf("field_identifier", "name")]
            while self.skip(","):
                names.append(self.leaf("field_identifier", "name"))
            n = self.make("field_declaration", start, *names, self.tag(self.type_(), "type"))
        if self.type() == "str" and not self.broke():
            n.kids.append(self.tag(self.string(), "tag"))
            n.end = self.last()
        return n

    def parameters(self, field: str) -> N:
        start = self.here()
        self.take("(")
        parts = []
        while not self.at(")"):
            if self.eof():
                raise Unread(")")
            if self.skip(","):
                continue
            s = self.here()
            name = None
            many = False
            if self.type() == "id" and self.text() not in _KEYWORDS and not (self.text(1) in (",", ")", ".") and self.type(1) == "op"):
                if not (self.text(1) == "[" and self.text(2) != "]" and self.type(2) == "id" and self.text(3) == "]" and self.text(4) in (",", ")")):
                    name = self.leaf("identifier", "name")
            if self.skip("..."):
                many = True
            parts.append((s, name, self.type_(), many, self.last()))
        self.take(")")
        kids, waiting = [], []
        if any(p[1] for p in parts):
            for s, name, kind, many, e in parts:
                if name is None and kind.kind == "type_identifier":
                    waiting.append(N("identifier", kind.start, kind.end, field="name"))
                    continue
                names = [*waiting, *([name] if name else [])]
                kids.append(N("variadic_parameter_declaration" if many else "parameter_declaration", names[0].start if names else s, e, [*names, self.tag(kind, "type")]))
                waiting = []
        else:
            kids = [N("variadic_parameter_declaration" if many else "parameter_declaration", s, e, [self.tag(kind, "type")]) for s, _, kind, many, e in parts]
        return N("parameter_list", start, self.last(), kids, field)

    def result(self) -> N | None:
        if self.broke() or self.at("{", ")", ",", "=", ";", "}", "]", ":=") or self.type() == "str" or self.eof():
            return None
        if self.at("("):
            return self.parameters("result")
        return self.tag(self.type_(), "result")

    # expressions
    def expression(self) -> N:
        return self.binary(0)

    def unary(self) -> N:
        start = self.here()
        if self.at("-", "+", "!", "^", "*", "&", "<-"):
            o = self.operator()
            return self.make("unary_expression", start, o, self.tag(self.unary(), "operand"))
        n = self.primary()
        while not self.broke() or self.at("."):
            if self.at("."):
                self.take()
                if self.at("("):
                    self.take()
                    if self.at("type"):
                        self.take()
                        self.take(")")
                        n = self.make("type_switch_guard", start, self.tag(n, "operand"))
                        continue
                    kind = self.tag(self.type_(), "type")
                    self.take(")")
                    n = self.make("type_assertion_expression", start, self.tag(n, "operand"), kind)
                else:
                    if self.type() != "id":
                        raise Unread("field")
                    n = self.make("selector_expression", start, self.tag(n, "operand"), self.leaf("field_identifier", "field"))
            elif self.at("("):
                n = self.make("call_expression", start, self.tag(n, "function"), self.tag(self.arguments(), "arguments"))
            elif self.at("["):
                self.take()
                n = self.held(True, lambda n=n: self.index(n, start))
            elif self.at("{") and self.literal and n.kind in ("identifier", "selector_expression", "index_expression"):
                n = self.literal_of(self.typed(n), start)
            else:
                return n
        return n

    def typed(self, n: N) -> N:
        if n.kind == "identifier":
            return N("type_identifier", n.start, n.end)
        if n.kind == "selector_expression" and n.kids[0].kind == "identifier":
            a, b = n.kids
            return N("qualified_type", n.start, n.end, [N("package_identifier", a.start, a.end, field="package"), N("type_identifier", b.start, b.end, field="name")])
        if n.kind == "index_expression":
            return N("generic_type", n.start, n.end, [self.tag(self.typed(n.kids[0]), "type"), *n.kids[1:]])
        raise Unread("type")

    def index(self, n: N, start: int) -> N:
        first = None if self.at(":") else self.expression()
        if not self.at(":"):
            while self.skip(","):
                if not self.at("]"):
                    self.type_()
            self.take("]")
            return self.make("index_expression", start, self.tag(n, "operand"), self.tag(first, "index"))
        kids = [self.tag(n, "operand"), self.tag(first, "start") if first else None]
        for name in ("end", "capacity"):
            if self.skip(":") and not self.at("]", ":"):
                kids.append(self.tag(self.expression(), name))
        self.take("]")
        return self.make("slice_expression", start, *kids)

    def arguments(self) -> N:
        start = self.here()
        self.take("(")

        def one() -> N:
            s = self.here()
            if self.at("[", "map", "chan", "struct", "interface") or self.at("*") and self.text(1) == "[":
                n = self.tried(self.value_or_type)
            else:
                n = self.expression()
            if n is None:
                raise Unread("argument")
            if self.skip("..."):
                return self.make("variadic_argument", s, n)
            return n

        kids = self.held(True, lambda: self.listed(")", one))
        return self.make("argument_list", start, *kids)

    def value_or_type(self) -> N:
        i = self.i
        n = self.tried(self.expression)
        if n is None:
            self.i = i
            n = self.type_()
        return n

    def primary(self) -> N:
        start, kind, t = self.here(), self.type(), self.text()
        if kind == "str":
            return self.string()
        if kind == "rune":
            return self.leaf("rune_literal")
        if kind == "num":
            return self.leaf("imaginary_literal" if t[-1] == "i" else "float_literal" if re.search(r"\.|^[0-9_]+[eE]", t) else "int_literal")
        if t == "(":
            self.take()
            n = self.held(True, self.value_or_type)
            self.take(")")
            return self.make("parenthesized_expression", start, n)
        if t == "func":
            self.take()
            params, result = self.parameters("parameters"), None
            result = self.result()
            return self.make("func_literal", start, params, result, self.held(True, lambda: self.tag(self.block(), "body")))
        if t in ("[", "map", "struct", "chan", "interface"):
            of = self.type_()
            if self.at("{"):
                return self.literal_of(of, start)
            if self.at("("):
                self.take()
                n = self.tag(self.held(True, self.expression), "operand")
                self.take(")")
                return self.make("type_conversion_expression", start, self.tag(of, "type"), n)
            return of
        if kind == "id" and t not in _KEYWORDS:
            return self.leaf(t if t in ("true", "false", "nil", "iota") else "identifier")
        raise Unread(t)

    def literal_of(self, of: N, start: int) -> N:
        return self.make("composite_literal", start, self.tag(of, "type"), self.tag(self.held(True, self.literal_value), "body"))

    def literal_value(self) -> N:
        start = self.here()
        self.take("{")

        def element() -> N:
            s = self.here()
            n = self.literal_value() if self.at("{") else self.expression()
            return N("literal_element", s, self.last(), [n])

        kids = []
        while not self.at("}"):
            if self.eof():
                raise Unread("}")
            if self.skip(","):
                continue
            s = self.here()
            n = element()
            if self.skip(":"):
                n = self.make("keyed_element", s, n, element())
            kids.append(n)
        self.take("}")
        return self.make("literal_value", start, *kids)

    def string(self) -> N:
        _, s, e, _ = self.take()
        raw = self.src[s] == "`"
        z = e - 1 if e - s > 1 and self.src[e - 1] == self.src[s] else e
        inside = N("raw_string_literal_content" if raw else "interpreted_string_literal_content", s + 1, z)
        return N("raw_string_literal" if raw else "interpreted_string_literal", s, e, [inside] if z > s + 1 else [])

    # statements
    def block(self) -> N:
        start = self.here()
        self.take("{")
        kids = self.held(True, lambda: self.statements("}"))
        self.take("}")
        return self.make("block", start, *kids)

    def expressions(self) -> N:
        start = self.here()
        kids = [self.value_or_type()]
        while self.skip(","):
            kids.append(self.value_or_type())
        return self.make("expression_list", start, *kids)

    def simple(self) -> N:
        start = self.here()
        if self.at("range"):
            self.take()
            return self.make("range_clause", start, self.tag(self.expression(), "right"))
        left = self.expressions()
        if self.at(":=", "="):
            o = self.text()
            self.take()
            if self.at("range"):
                self.take()
                return self.make("range_clause", start, self.tag(left, "left"), self.tag(self.expression(), "right"))
            right = self.tag(self.expressions(), "right")
            return self.make("short_var_declaration" if o == ":=" else "assignment_statement", start, self.tag(left, "left"), right)
        if self.type() == "op" and self.text()[-1:] == "=" and self.text() not in ("==", "!=", "<=", ">="):
            o = self.operator()
            return self.make("assignment_statement", start, self.tag(left, "left"), o, self.tag(self.expressions(), "right"))
        if self.at("++", "--"):
            kind = "inc_statement" if self.text() == "++" else "dec_statement"
            self.take()
            return self.make(kind, start, left.kids[0])
        if self.at("<-"):
            self.take()
            return self.make("send_statement", start, self.tag(left.kids[0], "channel"), self.tag(self.expression(), "value"))
        if len(left.kids) != 1:
            raise Unread("=")
        return self.make("expression_statement", start, left.kids[0])

    def grouped(self, start: int, kind: str, one, group: str | None = None) -> N:
        self.take()
        if self.at("("):
            s = self.here()
            self.take()
            kids = []
            while not self.at(")"):
                if self.eof():
                    raise Unread(")")
                if self.skip(";"):
                    continue
                kids.append(one())
            self.take(")")
            return self.make(kind, start, *([N(group, s, self.last(), kids)] if group else kids))
        return self.make(kind, start, one())

    def spec(self, kind: str):
        def one() -> N:
            s = self.here()
            if kind == "import_spec":
                name = None
                if self.type() == "id" or self.at("."):
                    name = self.leaf("blank_identifier" if self.text() == "_" else "dot" if self.text() == "." else "package_identifier", "name")
                if self.type() != "str":
                    raise Unread("import")
                return self.make(kind, s, name, self.tag(self.string(), "path"))
            if kind == "type_spec":
                name = self.leaf("type_identifier", "name")
                if self.at("[") and self.type(1) == "id" and self.text(2) != "]":
                    self.take("[")
                    while not self.skip("]"):
                        self.take()
                alias = self.skip("=")
                return self.make("type_alias" if alias else kind, s, name, self.tag(self.type_(), "type"))
            names = [self.leaf("identifier", "name")]
            while self.skip(","):
                names.append(self.leaf("identifier", "name"))
            of = None if self.ended() or self.at("=") else self.tag(self.type_(), "type")
            value = self.tag(self.expressions(), "value") if self.skip("=") else None
            return self.make(kind, s, *names, of, value)

        return one

    def statement(self) -> N | None:
        start, t = self.here(), self.text()
        if self.type() == "op":
            if t == ";":
                self.take()
                return None
            if t == "{":
                return self.block()
        if self.type() == "id":
            f = getattr(self, "s_" + t, None) if t in _KEYWORDS else None
            if f:
                n = f(start)
                self.end()
                return n
            if self.text(1) == ":" and self.type(1) == "op" and t not in _KEYWORDS:
                label = self.leaf("label_name", "label")
                self.take()
                return self.make("labeled_statement", start, label, None if self.at("}") else self.statement())
        n = self.simple()
        self.end()
        return n

    def s_package(self, start: int) -> N:
        self.take()
        return self.make("package_clause", start, self.leaf("package_identifier"))

    def s_import(self, start: int) -> N:
        return self.grouped(start, "import_declaration", self.spec("import_spec"), "import_spec_list")

    def s_var(self, start: int) -> N:
        return self.grouped(start, "var_declaration", self.spec("var_spec"))

    def s_const(self, start: int) -> N:
        return self.grouped(start, "const_declaration", self.spec("const_spec"))

    def s_type(self, start: int) -> N:
        return self.grouped(start, "type_declaration", self.spec("type_spec"))

    def s_func(self, start: int) -> N:
        if self.text(1) == "(" and not (self.type(2) == "op" and self.text(2) == ")"):
            def method() -> N:
                self.take()
                receiver = self.parameters("receiver")
                name = self.leaf("field_identifier", "name")
                params = self.parameters("parameters")
                result = self.result()
                return self.make("method_declaration", start, receiver, name, params, result, self.tag(self.block(), "body") if self.at("{") else None)

            n = self.tried(method)
            if n:
                return n
        if self.type(1) != "id":
            return self.simple()
        self.take()
        name = self.leaf("identifier", "name")
        if self.at("["):
            self.take()
            while not self.skip("]"):
                self.take()
        params = self.parameters("parameters")
        result = self.result()
        return self.make("function_declaration", start, name, params, result, self.tag(self.block(), "body") if self.at("{") and not self.broke() else None)

    def s_return(self, start: int) -> N:
        self.take()
        return self.make("return_statement", start, None if self.ended() else self.expressions())

    def s_defer(self, start: int) -> N:
        kind = self.text() + "_statement"
        self.take()
        return self.make(kind, start, self.expression())

    s_go = s_defer

    def s_break(self, start: int) -> N:
        kind = self.text() + "_statement"
        self.take()
        return self.make(kind, start, None if self.ended() else self.leaf("label_name"))

    s_continue = s_goto = s_fallthrough = s_break

    def s_if(self, start: int) -> N:
        self.take()

        def header() -> list[N]:
            first = None if self.at(";") else self.simple()
            if self.skip(";"):
                return [*([self.tag(first, "initializer")] if first else []), self.tag(self.expression(), "condition")]
            if first.kind != "expression_statement":
                raise Unread("condition")
            return [self.tag(first.kids[0], "condition")]

        kids = self.held(False, header)
        kids.append(self.tag(self.block(), "consequence"))
        if self.at("else"):
            self.take()
            kids.append(self.tag(self.s_if(self.here()) if self.at("if") else self.block(), "alternative"))
        return self.make("if_statement", start, *kids)

    def s_for(self, start: int) -> N:
        self.take()

        def header() -> N | None:
            s = self.here()
            if self.at("{"):
                return None
            first = None if self.at(";") else self.simple()
            if not self.at(";"):
                return first.kids[0] if first.kind == "expression_statement" else first
            self.take()
            kids = [self.tag(first, "initializer") if first else None, None if self.at(";", "{") else self.tag(self.expression(), "condition")]
            if self.skip(";") and not self.at("{"):
                kids.append(self.tag(self.simple(), "update"))
            return self.make("for_clause", s, *kids)

        head = self.held(False, header)
        return self.make("for_statement", start, head, self.tag(self.block(), "body"))

    def s_switch(self, start: int) -> N:
        self.take()

        def header() -> list[N]:
            out = []
            while not self.at("{"):
                if self.eof():
                    raise Unread("{")
                if self.skip(";"):
                    continue
                out.append(self.simple())
            return out

        head = self.held(False, header)
        self.take("{")
        kids, typed = [], any("type_switch_guard" in repr(h) for h in head)
        while not self.at("}"):
            s = self.here()
            if self.skip("default"):
                self.take(":")
                kids.append(self.make("default_case", s, *self.held(True, lambda: self.statements("case", "default", "}"))))
                continue
            self.take("case")
            values = [self.value_or_type()]
            while self.skip(","):
                values.append(self.value_or_type())
            if not self.skip(":"):
                self.recover(self.here())
            kids.append(self.make("type_case" if typed else "expression_case", s, *values, *self.held(True, lambda: self.statements("case", "default", "}"))))
        self.take("}")
        return self.make("type_switch_statement" if typed else "expression_switch_statement", start, *head, *kids)

    def s_select(self, start: int) -> N:
        self.take()
        self.take("{")
        kids = []
        while not self.at("}"):
            s = self.here()
            if self.skip("default"):
                self.take(":")
                kids.append(self.make("default_case", s, *self.statements("case", "default", "}")))
                continue
            self.take("case")
            n = self.simple()
            self.take(":")
            kids.append(self.make("communication_case", s, n, *self.statements("case", "default", "}")))
        self.take("}")
        return self.make("select_statement", start, *kids)
