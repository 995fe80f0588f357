"""Java front end."""

from __future__ import annotations

import re

from sylva.sources.syntax import N, Parser, Unread

_OPS = r">>>=|<<=|>>=|->|::|\.\.\.|&&|\|\||\+\+|--|[-+*/%&|^=!<>]=|<<|[-+*/%&|^<>=!~?:()\[\]{},;.@]"
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed"}
_PRIMITIVE = {"int": "integral_type", "long": "integral_type", "short": "integral_type", "byte": "integral_type", "char": "integral_type", "float": "floating_point_type", "double": "floating_point_type", "boolean": "boolean_type", "void": "void_type"}
_RESERVED = {"if", "else", "for", "while", "do", "return", "break", "continue", "switch", "case", "throw", "try", "catch", "finally", "new", "class", "interface", "enum", "import", "package", "instanceof", "extends", "implements", "throws", "assert"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}


class Java(Parser):
    COMMENT = "comment"
    LEX = re.compile(rf"(?P<ws>[ \t\f\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:\\[^\n]|[^\\\"\n])*\"?)|(?P<chr>'(?:\\[^\n]|[^\\'\n])+'?)|(?P<num>0[xXbB][0-9a-fA-F_]+[lL]?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[lLfFdD]?)|(?P<id>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<op>{_OPS})")
    BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}

    def lex(self) -> None:
        super().lex()
        for c in self.comments:
            c.kind = "line_comment" if self.src[c.start : c.start + 2] == "//" else "block_comment"

    # types
    def type_(self) -> N:
        start = self.here()
        while self.at("@"):
            self.annotation()
        t = self.text()
        if t == "?" and self.type() == "op":
            self.take()
            if self.skip("extends", "super"):
                return self.make("wildcard", start, self.type_())
            return self.make("wildcard", start)
        if self.type() != "id" or t in _RESERVED:
            raise Unread("type")
        n = self.leaf(_PRIMITIVE.get(t, "type_identifier"))
        while True:
            if self.at("<"):
                n = self.make("generic_type", start, n, self.type_arguments())
            elif self.at(".") and self.type(1) == "id" and n.kind not in _PRIMITIVE.values():
                self.take()
                n = self.make("scoped_type_identifier", start, n, self.leaf("type_identifier"))
            else:
                break
        if self.at("[") and self.text(1) == "]":
            s = self.here()
            while self.at("[") and self.text(1) == "]":
                self.take()
                self.take()
            n = self.make("array_type", start, self.tag(n, "element"), N("dimensions", s, self.last(), field="dimensions"))
        return n

    def type_arguments(self) -> N:
        start = self.here()
        self.take("<")
        kids = []
        while not self.at(">"):
            if self.skip(",", "&", "extends"):
                continue
            kids.append(self.type_())
        self.take(">")
        return self.make("type_arguments", start, *kids)

    def annotation(self) -> N:
        start = self.here()
        self.take("@")
        name = self.scoped()
        if self.at("("):
            return self.make("annotation", start, self.tag(name, "name"), self.tag(self.arguments("annotation_argument_list"), "arguments"))
        return self.make("marker_annotation", start, self.tag(name, "name"))

    def scoped(self) -> N:
        start = self.here()
        n = self.leaf("identifier")
        while self.at(".") and self.type(1) == "id":
            self.take()
            n = self.make("scoped_identifier", start, self.tag(n, "scope"), self.leaf("identifier", "name"))
        return n

    def modifiers(self) -> N | None:
        start, kids, some = self.here(), [], False
        while True:
            if self.at("@") and self.text(1) != "interface":
                kids.append(self.annotation())
            elif self.type() == "id" and self.text() in _MODIFIERS and not (self.text() == "default" and self.text(1) in (":", "->")) and not (self.text() == "synchronized" and self.text(1) == "("):
                t = self.take()
                kids.append(N(self.src[t[1] : t[2]], t[1], t[2], named=False))
            else:
                break
            some = True
        return self.make("modifiers", start, *kids) if some else None

    # expressions
    def expression(self) -> N:
        start = self.here()
        n = self.lambda_()
        if n:
            return n
        n = self.binary(0)
        if self.at("?"):
            self.take()
            yes = self.tag(self.expression(), "consequence")
            self.take(":")
            return self.make("ternary_expression", start, self.tag(n, "condition"), yes, self.tag(self.expression(), "alternative"))
        if self.type() == "op" and self.text() in _ASSIGN:
            o = self.operator()
            return self.make("assignment_expression", start, self.tag(n, "left"), o, self.tag(self.expression(), "right"))
        return n

    def lambda_(self) -> N | None:
        start = self.here()
        if self.type() == "id" and self.text(1) == "->":
            name = self.leaf("identifier", "parameters")
        elif self.at("("):
            deep, j = 0, self.i
            while j < len(self.toks) - 1:
                x = self.src[self.toks[j][1] : self.toks[j][2]] if self.toks[j][0] == "op" else ""
                deep += (x == "(") - (x == ")")
                j += 1
                if deep == 0:
                    break
            if self.src[self.toks[j][1] : self.toks[j][2]] != "->":
                return None
            name = self.tried(self.parameters)
            if name is None:
                self.take("(")
                name = self.make("inferred_parameters", start, *self.listed(")", lambda: self.leaf("identifier")), field="parameters")
        else:
            return None
        self.take("->")
        return self.make("lambda_expression", start, name, self.tag(self.block() if self.at("{") else self.expression(), "body"))

    def binary(self, least: int) -> N:
        left = super().binary(least)
        while self.at("instanceof") and least <= 7:
            self.take()
            self.skip("final")
            right = self.tag(self.type_(), "right")
            name = self.leaf("identifier", "name") if self.type() == "id" and self.text() not in _RESERVED else None
            left = self.make("instanceof_expression", left.start, self.tag(left, "left"), right, name)
        return left

    def unary(self) -> N:
        start = self.here()
        if self.at("-", "+", "!", "~"):
            o = self.operator()
            return self.make("unary_expression", start, o, self.tag(self.unary(), "operand"))
        if self.at("++", "--"):
            self.take()
            return self.make("update_expression", start, self.unary())
        if self.at("("):
            n = self.tried(self.cast)
            if n:
                return n
        n = self.postfix(self.primary(), start)
        if self.at("++", "--"):
            self.take()
            n = self.make("update_expression", start, n)
        return n

    def cast(self) -> N:
        start = self.here()
        self.take("(")
        of = self.type_()
        while self.skip("&"):
            self.type_()
        self.take(")")
        if of.kind in ("integral_type", "floating_point_type", "boolean_type"):
            pass
        elif self.type() == "op" and not self.at("(", "!", "~", "@") or self.type() == "id" and self.text() in ("instanceof",) or self.eof():
            raise Unread("cast")
        value = self.lambda_() or self.unary()
        return self.make("cast_expression", start, self.tag(of, "type"), self.tag(value, "value"))

    def postfix(self, n: N, start: int) -> N:
        while True:
            if self.at("."):
                self.take()
                if self.at("<"):
                    self.type_arguments()
                if self.at("new"):
                    n = self.creation(self.here())
                elif self.at("class"):
                    self.take()
                    n = self.make("class_literal", start, n)
                elif self.type() == "id":
                    name = self.leaf("this" if self.text() == "this" else "identifier")
                    if self.at("("):
                        n = self.make("method_invocation", start, self.tag(n, "object"), self.tag(name, "name"), self.tag(self.arguments(), "arguments"))
                    else:
                        n = self.make("field_access", start, self.tag(n, "object"), self.tag(name, "field"))
                else:
                    raise Unread("member")
            elif self.at("["):
                self.take()
                i = self.tag(self.expression(), "index")
                self.take("]")
                n = self.make("array_access", start, self.tag(n, "array"), i)
            elif self.at("::"):
                self.take()
                n = self.make("method_reference", start, n, self.leaf("new" if self.at("new") else "identifier"))
            else:
                return n

    def arguments(self, kind: str = "argument_list") -> N:
        start = self.here()
        self.take("(")

        def one() -> N:
            if kind != "argument_list" and self.at("{", "@"):
                return self.initial() if self.at("{") else self.annotation()
            if kind != "argument_list" and self.type() == "id" and self.text(1) == "=":
                s = self.here()
                key = self.leaf("identifier", "key")
                self.take()
                return self.make("element_value_pair", s, key, self.tag(self.initial(), "value"))
            return self.expression()

        return self.make(kind, start, *self.listed(")", one))

    def initial(self) -> N:
        start = self.here()
        if self.at("{"):
            self.take()
            return self.make("array_initializer", start, *self.listed("}", self.initial))
        return self.annotation() if self.at("@") else self.expression()

    def creation(self, start: int) -> N:
        self.take("new")
        if self.at("{"):
            raise Unread("new")
        s = self.here()
        while self.at("@"):
            self.annotation()
        of = self.leaf(_PRIMITIVE.get(self.text(), "type_identifier"))
        while True:
            if self.at("<"):
                of = self.make("generic_type", s, of, self.type_arguments())
            elif self.at("."):
                self.take()
                of = self.make("scoped_type_identifier", s, of, self.leaf("type_identifier"))
            else:
                break
        if self.at("["):
            kids = []
            while self.at("["):
                d = self.here()
                self.take()
                if self.skip("]"):
                    kids.append(self.make("dimensions", d, field="dimensions"))
                else:
                    e = self.expression()
                    self.take("]")
                    kids.append(self.make("dimensions_expr", d, e, field="dimensions"))
            return self.make("array_creation_expression", start, self.tag(of, "type"), *kids, self.tag(self.initial(), "value") if self.at("{") else None)
        args = self.tag(self.arguments(), "arguments")
        return self.make("object_creation_expression", start, self.tag(of, "type"), args, self.body("class_body") if self.at("{") else None)

    def primary(self) -> N:
        start, kind, t = self.here(), self.type(), self.text()
        if kind == "str":
            _, s, e, _ = self.take()
            q = 3 if self.src[s : s + 3] == '"""' and e - s >= 6 else 1
            z = e - q if e - s > q and self.src[e - 1] == '"' else e
            return N("string_literal", s, e, [N("string_fragment" if q == 1 else "multiline_string_fragment", s + q, z)] if z > s + q else [])
        if kind == "chr":
            return self.leaf("character_literal")
        if kind == "num":
            return self.leaf("hex_integer_literal" if t[:2].lower() == "0x" else "decimal_floating_point_literal" if re.search(r"[.eEfFdD]", t) else "decimal_integer_literal")
        if t == "(" and kind == "op":
            self.take()
            n = self.expression()
            self.take(")")
            return self.make("parenthesized_expression", start, n)
        if kind == "id":
            if t == "new":
                return self.creation(start)
            if t == "switch":
                return self.s_switch(start)
            if t in ("true", "false", "this", "super"):
                n = self.leaf(t)
                if self.at("("):
                    return self.make("explicit_constructor_invocation", start, self.tag(n, "constructor"), self.tag(self.arguments(), "arguments"))
                return n
            if t == "null":
                return self.leaf("null_literal")
            if t in _PRIMITIVE:
                return self.type_()
            if t in _RESERVED:
                raise Unread(t)
            n = self.leaf("identifier")
            if self.at("("):
                return self.make("method_invocation", start, self.tag(n, "name"), self.tag(self.arguments(), "arguments"))
            if self.at("<", "["):
                def reference() -> N:
                    self.i -= 1
                    of = self.type_()
                    if not self.at("::", "."):
                        raise Unread("::")
                    if self.at("."):
                        self.take()
                        self.take("class")
                        return self.make("class_literal", start, of)
                    return of

                return self.tried(reference) or n
            return n
        raise Unread(t)

    # statements and declarations
    def block(self) -> N:
        start = self.here()
        self.take("{")
        kids = self.statements("}")
        self.take("}")
        return self.make("block", start, *kids)

    def body(self, kind: str) -> N:
        start = self.here()
        self.take("{")
        kids = []
        if kind == "enum_body":
            while self.type() == "id" or self.at("@"):
                s = self.here()
                self.modifiers()
                name = self.leaf("identifier", "name")
                args = self.tag(self.arguments(), "arguments") if self.at("(") else None
                kids.append(self.make("enum_constant", s, name, args, self.body("class_body") if self.at("{") else None))
                if not self.skip(","):
                    break
            self.skip(";")
        kids += self.statements("}")
        self.take("}")
        return N(kind, start, self.last(), kids, "body")

    def parameters(self) -> N:
        start = self.here()
        self.take("(")

        def one() -> N:
            s = self.here()
            mods = self.modifiers()
            of = self.tag(self.type_(), "type")
            many = self.skip("...")
            name = self.leaf("this" if self.text() == "this" else "identifier", "name")
            while self.skip("["):
                self.take("]")
            return self.make("spread_parameter" if many else "formal_parameter", s, mods, of, name)

        return self.make("formal_parameters", start, *self.listed(")", one), field="parameters")

    def declarators(self) -> list[N]:
        kids = []
        while True:
            s = self.here()
            name = self.leaf("identifier", "name")
            while self.skip("["):
                self.take("]")
            value = self.tag(self.initial(), "value") if self.skip("=") else None
            kids.append(self.make("variable_declarator", s, name, value, field="declarator"))
            if not self.skip(","):
                return kids

    def statement(self) -> N | None:
        start, t = self.here(), self.text()
        if self.type() == "op":
            if t == ";":
                self.take()
                return None
            if t == "{":
                return self.block()
        if self.type() == "id":
            if t in ("package", "import"):
                self.take()
                self.skip("static")
                n = self.scoped()
                star = None
                if self.skip("."):
                    star = self.leaf("asterisk")
                self.take(";")
                return self.make(t + "_declaration", start, n, star)
            f = getattr(self, "s_" + t, None)
            if f:
                return f(start)
            if self.text(1) == ":" and self.type(1) == "op" and t not in ("default", "case"):
                label = self.leaf("identifier")
                self.take()
                return self.make("labeled_statement", start, label, self.statement())
            if t == "static" and self.text(1) == "{":
                self.take()
                return self.make("static_initializer", start, self.block())
        n = self.tried(self.declaration)
        if n:
            return n
        n = self.expression()
        self.take(";")
        return self.make("expression_statement", start, n)

    def declaration(self) -> N:
        start = self.here()
        mods = self.modifiers()
        t = self.text()
        if t in ("class", "interface", "enum", "record") and self.type(1) == "id" or t == "@":
            self.skip("@")
            kind = self.text()
            self.take()
            name = self.leaf("identifier", "name")
            kids: list[N | None] = [mods, name]
            if self.at("<"):
                kids.append(self.tag(self.type_arguments(), "type_parameters"))
            if kind == "record":
                kids.append(self.parameters())
            while self.at("extends", "implements", "permits"):
                s, how = self.here(), self.text()
                self.take()
                of = [self.type_()]
                while self.skip(","):
                    of.append(self.type_())
                if how == "extends" and kind == "class":
                    kids.append(self.make("superclass", s, *of, field="superclass"))
                else:
                    kids.append(self.make("extends_interfaces" if how == "extends" else "super_interfaces", s, N("type_list", of[0].start, of[-1].end, of), field="interfaces"))
            kids.append(self.body({"class": "class_body", "interface": "interface_body", "enum": "enum_body"}.get(kind, "class_body")))
            return self.make(f"{kind}_declaration", start, *kids)
        if self.at("<"):
            self.type_arguments()
        if self.type() == "id" and self.text(1) == "(" and mods is not None or self.type() == "id" and self.text(1) == "(" and self.text()[:1].isupper() and self.closes_before("{", "throws"):
            name = self.leaf("identifier", "name")
            params = self.parameters()
            throws = self.throws()
            body = self.tag(self.block(), "body")
            body.kind = "constructor_body"
            return self.make("constructor_declaration", start, mods, name, params, throws, body)
        of = self.tag(self.type_(), "type")
        if self.type() != "id" or self.text() in _RESERVED:
            raise Unread("name")
        if self.text(1) == "(":
            name = self.leaf("identifier", "name")
            params = self.parameters()
            while self.skip("["):
                self.take("]")
            throws = self.throws()
            if self.skip("default"):
                self.initial()
            body = None if self.skip(";") else self.tag(self.block(), "body")
            return self.make("method_declaration", start, mods, of, name, params, throws, body)
        kids = self.declarators()
        self.take(";")
        return self.make("local_variable_declaration", start, mods, of, *kids)

    def closes_before(self, *texts: str) -> bool:
        deep, j = 0, self.i + 1
        while j < len(self.toks) - 1:
            x = self.src[self.toks[j][1] : self.toks[j][2]] if self.toks[j][0] == "op" else ""
            deep += (x == "(") - (x == ")")
            j += 1
            if deep == 0:
                break
        return self.src[self.toks[j][1] : self.toks[j][2]] in texts

    def throws(self) -> N | None:
        if not self.at("throws"):
            return None
        s = self.here()
        self.take()
        kids = [self.type_()]
        while self.skip(","):
            kids.append(self.type_())
        return self.make("throws", s, *kids)

    def condition(self) -> N:
        s = self.here()
        self.take("(")
        n = self.expression()
        self.take(")")
        return self.make("parenthesized_expression", s, n, field="condition")

    def s_if(self, start: int) -> N:
        self.take()
        kids = [self.condition(), self.tag(self.statement() or N("empty", start, start), "consequence")]
        if self.skip("else"):
            kids.append(self.tag(self.statement() or N("empty", start, start), "alternative"))
        return self.make("if_statement", start, *kids)

    def s_while(self, start: int) -> N:
        self.take()
        c = self.condition()
        b = self.statement()
        return self.make("while_statement", start, c, self.tag(b, "body") if b else None)

    def s_do(self, start: int) -> N:
        self.take()
        b = self.tag(self.statement(), "body")
        self.take("while")
        n = self.make("do_statement", start, b, self.condition())
        self.skip(";")
        return n

    def s_for(self, start: int) -> N:
        self.take()
        self.take("(")

        def each() -> N:
            mods = self.modifiers()
            of = self.tag(self.type_(), "type")
            name = self.leaf("identifier", "name")
            self.take(":")
            value = self.tag(self.expression(), "value")
            self.take(")")
            return self.make("enhanced_for_statement", start, mods, of, name, value)

        n = self.tried(each)
        if n is None:
            kids = []
            if not self.skip(";"):
                d = self.tried(self.declaration)
                if d is None:
                    d = self.expression()
                    while self.skip(","):
                        self.expression()
                    self.take(";")
                kids.append(self.tag(d, "init"))
            if not self.at(";"):
                kids.append(self.tag(self.expression(), "condition"))
            self.take(";")
            if not self.at(")"):
                kids += [self.tag(k, "update") for k in self.listed(")", self.expression)]
            else:
                self.take()
            n = self.make("for_statement", start, *kids)
        b = self.statement()
        if b:
            n.kids.append(self.tag(b, "body"))
        n.end = self.last()
        return n

    def jump(self, start: int) -> N:
        kind = self.text() + "_statement"
        self.take()
        value = None if self.at(";") else self.expression()
        self.take(";")
        return self.make(kind, start, value)

    s_return = s_throw = s_break = s_continue = s_yield_ = jump

    def s_assert(self, start: int) -> N:
        self.take()
        kids = [self.expression()]
        if self.skip(":"):
            kids.append(self.expression())
        self.take(";")
        return self.make("assert_statement", start, *kids)

    def s_synchronized(self, start: int) -> N:
        if self.text(1) != "(":
            return self.declaration()
        self.take()
        return self.make("synchronized_statement", start, self.tag(self.condition(), "lock"), self.tag(self.block(), "body"))

    def s_try(self, start: int) -> N:
        self.take()
        kids: list[N] = []
        kind = "try_statement"
        if self.at("("):
            kind, s = "try_with_resources_statement", self.here()
            self.take()

            def one() -> N:
                r = self.here()

                def declared() -> N:
                    mods = self.modifiers()
                    of = self.tag(self.type_(), "type")
                    name = self.leaf("identifier", "name")
                    self.take("=")
                    return self.make("resource", r, mods, of, name, self.tag(self.expression(), "value"))

                return self.tried(declared) or self.make("resource", r, self.expression())

            kids.append(self.make("resource_specification", s, *self.listed(")", one, ";"), field="resources"))
        kids.append(self.tag(self.block(), "body"))
        while self.at("catch"):
            s = self.here()
            self.take()
            self.take("(")
            p = self.here()
            mods = self.modifiers()
            types = [self.type_()]
            while self.skip("|"):
                types.append(self.type_())
            name = self.leaf("identifier", "name")
            param = self.make("catch_formal_parameter", p, mods, N("catch_type", types[0].start, types[-1].end, types), name)
            self.take(")")
            kids.append(self.make("catch_clause", s, param, self.tag(self.block(), "body")))
        if self.at("finally"):
            s = self.here()
            self.take()
            kids.append(self.make("finally_clause", s, self.block()))
        return self.make(kind, start, *kids)

    def s_switch(self, start: int) -> N:
        self.take()
        c = self.condition()
        s = self.here()
        self.take("{")
        kids = []
        while not self.at("}"):
            g = self.here()
            if self.at("default"):
                self.take()
                label = self.make("switch_label", g)
            else:
                self.take("case")
                values = [self.binary(0)]
                while self.skip(","):
                    values.append(self.binary(0))
                label = self.make("switch_label", g, *values)
            if self.skip("->"):
                kids.append(self.make("switch_rule", g, label, self.statement()))
            else:
                self.take(":")
                kids.append(self.make("switch_block_statement_group", g, label, *self.statements("case", "default", "}")))
        self.take("}")
        return self.make("switch_expression", start, c, N("switch_block", s, self.last(), kids, "body"))

    def parse(self) -> N:
        root = super().parse()
        for n in root.walk():  # fields are local variables but for where they stand
            if n.kind in ("class_body", "interface_body", "enum_body"):
                for k in n.kids:
                    if k.kind == "local_variable_declaration":
                        k.kind = "field_declaration"
        return root
