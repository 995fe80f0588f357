"""Front ends of PHP, Rust and Dockerfiles."""

from __future__ import annotations

import re

from sylva.sources.syntax import N, Parser, Unread, place_comments


class Php(Parser):
    LEX = re.compile(r"(?P<ws>[ \t\f\r]+)|(?P<nl>\n)|(?P<text>\?>(?:(?!<\?)[\s\S])*)|(?P<tag><\?(?:php|=)?)|(?P<comment>//(?:(?!\?>)[^\n])*|#(?!\[)(?:(?!\?>)[^\n])*|/\*[\s\S]*?(?:\*/|\Z))|(?P<here><<<[ \t]*[\"']?(?P<word>\w+)[\"']?\r?\n[\s\S]*?\n[ \t]*(?P=word)\b)|(?P<str>'(?:\\[\s\S]|[^\\'])*'?|\"(?:\\[\s\S]|[^\\\"])*\"?)|(?P<var>\$\$?[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<num>0[xXbB][0-9a-fA-F_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<id>\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[A-Za-z_\x80-\xff][\w\x80-\xff]*)*)|(?P<op><=>|\*\*=|\.\.\.|\?\?=|<<=|>>=|===|!==|\?->|->|::|=>|&&|\|\||\?\?|\+\+|--|<<|>>|\*\*|[-+*/%&|^.=!<>]=|<>|[-+*/%&|^<>=!~?:()\[\]{},;.@$#\\])")
    BINARY = {"or": 1, "xor": 2, "and": 3, "??": 6, "||": 7, "&&": 8, "|": 9, "^": 10, "&": 11, "==": 12, "!=": 12, "===": 12, "!==": 12, "<>": 12, "<=>": 12, "<": 13, ">": 13, "<=": 13, ">=": 13, "<<": 14, ">>": 14, "+": 15, "-": 15, ".": 15, "*": 16, "/": 16, "%": 16, "instanceof": 18, "**": 19}
    RIGHT = frozenset(["**", "??"])

    def token(self, kind: str, start: int, end: int, broke: bool) -> int:
        self.toks.append(("str" if kind == "word" else "here" if kind == "here" else kind, start, end, broke))
        return end

    def expression(self) -> N:
        start = self.here()
        if self.at("include", "include_once", "require", "require_once", "print", "throw", "yield", "clone"):
            kind = {"print": "print_intrinsic", "throw": "throw_expression", "yield": "yield_expression", "clone": "clone_expression"}.get(self.text(), self.text() + "_expression")
            self.take()
            self.skip("from")
            return self.make(kind, start, self.expression())
        n = self.binary(0)
        if self.at("?") and self.type() == "op":
            self.take()
            yes = None if self.at(":") else self.tag(self.expression(), "body")
            self.take(":")
            return self.make("conditional_expression", start, self.tag(n, "condition"), yes, self.tag(self.expression(), "alternative"))
        if self.at("="):
            self.take()
            self.skip("&")
            return self.make("assignment_expression", start, self.tag(n, "left"), self.tag(self.expression(), "right"))
        if self.type() == "op" and self.text()[-1:] == "=" and len(self.text()) > 1 and self.text() not in ("==", "===", "!=", "!==", "<=", ">="):
            o = self.operator()
            return self.make("augmented_assignment_expression", start, self.tag(n, "left"), o, self.tag(self.expression(), "right"))
        return n

    def unary(self) -> N:
        start = self.here()
        if self.at("-", "+", "!", "~", "@", "&", "..."):
            kind = "error_suppression_expression" if self.text() == "@" else "variadic_unpacking" if self.text() == "..." else "unary_op_expression"
            o = self.operator()
            return self.make(kind, start, o, self.unary())
        if self.at("++", "--"):
            self.take()
            return self.make("update_expression", start, self.unary())
        if self.at("(") and self.text(1).lower() in ("int", "string", "bool", "array", "float", "object", "integer", "boolean") and self.text(2) == ")":
            self.take()
            of = self.leaf("cast_type", "type")
            self.take(")")
            return self.make("cast_expression", start, of, self.tag(self.unary(), "value"))
        n = self.primary()
        while True:
            if self.at("->", "?->"):
                self.take()
                name = self.member()
                n = self.make("member_call_expression", start, self.tag(n, "object"), self.tag(name, "name"), self.tag(self.arguments(), "arguments")) if self.at("(") else self.make("member_access_expression", start, self.tag(n, "object"), self.tag(name, "name"))
            elif self.at("::"):
                self.take()
                name = self.member()
                if self.at("("):
                    n = self.make("scoped_call_expression", start, self.tag(n, "scope"), self.tag(name, "name"), self.tag(self.arguments(), "arguments"))
                else:
                    n = self.make("scoped_property_access_expression" if name.kind == "variable_name" else "class_constant_access_expression", start, n, name)
            elif self.at("("):
                n = self.make("function_call_expression", start, self.tag(n, "function"), self.tag(self.arguments(), "arguments"))
            elif self.at("[", "{") and self.text() == "[":
                self.take()
                i = None if self.at("]") else self.expression()
                self.take("]")
                n = self.make("subscript_expression", start, n, i)
            elif self.at("++", "--"):
                self.take()
                n = self.make("update_expression", start, n)
            else:
                return n

    def member(self) -> N:
        if self.type() == "var":
            return self.variable()
        if self.skip("{"):
            n = self.expression()
            self.take("}")
            return n
        return self.leaf("name")

    def variable(self) -> N:
        _, s, e, _ = self.take()
        return N("variable_name", s, e, [N("name", s + 1, e)])

    def arguments(self) -> N:
        start = self.here()
        self.take("(")

        def one() -> N:
            s = self.here()
            name = None
            if self.type() == "id" and self.text(1) == ":" and self.text(2) != ":":
                name = self.leaf("name", "name")
                self.take()
            return self.make("argument", s, name, self.expression())

        return self.make("arguments", start, *self.listed(")", one))

    def entry(self) -> N:
        s = self.here()
        n = self.expression()
        if self.skip("=>"):
            return self.make("array_element_initializer", s, n, self.expression())
        return self.make("array_element_initializer", s, n)

    def primary(self) -> N:
        start, kind, t = self.here(), self.type(), self.text()
        if kind == "str":
            return self.string()
        if kind == "here":
            return self.leaf("heredoc")
        if kind == "num":
            return self.leaf("float" if "." in t else "integer")
        if kind == "var":
            return self.variable()
        if kind == "id":
            low = t.lower()
            if low in ("true", "false"):
                return self.leaf("boolean")
            if low == "null":
                return self.leaf("null")
            if low == "new":
                self.take()
                if self.at("class"):
                    self.take()
                    args = self.arguments() if self.at("(") else None
                    while not self.at("{"):
                        self.take()
                    return self.make("object_creation_expression", start, args, self.block("declaration_list"))
                of = self.leaf("name") if self.type() == "id" else self.variable() if self.type() == "var" else self.primary()
                return self.make("object_creation_expression", start, of, self.arguments() if self.at("(") else None)
            if low in ("function", "fn") or low == "static" and self.text(1).lower() in ("function", "fn"):
                self.skip("static")
                arrow = self.text().lower() == "fn"
                self.take()
                self.skip("&")
                params = self.parameters()
                if self.skip("use"):
                    self.arguments()
                if self.skip(":"):
                    self.type_()
                if arrow:
                    self.take("=>")
                    return self.make("arrow_function", start, params, self.tag(self.expression(), "body"))
                return self.make("anonymous_function", start, params, self.tag(self.block(), "body"))
            if low in ("array", "list") and self.text(1) == "(":
                self.take()
                self.take("(")
                return self.make("array_creation_expression" if low == "array" else "list_literal", start, *self.listed(")", self.entry))
            if low == "match" and self.text(1) == "(":
                self.take()
                self.arguments()
                self.recover_braces()
                return self.make("match_expression", start)
            if low in ("if", "for", "while", "foreach", "else", "return", "class", "case", "break"):
                raise Unread(t)
            return self.leaf("qualified_name" if "\\" in t else "name")
        if t == "(":
            self.take()
            n = self.expression()
            self.take(")")
            return self.make("parenthesized_expression", start, n)
        if t == "[":
            self.take()
            return self.make("array_creation_expression", start, *self.listed("]", self.entry))
        raise Unread(t)

    def recover_braces(self) -> None:
        deep = 0
        while not self.eof():
            deep += self.at("{") - self.at("}")
            self.take()
            if deep <= 0:
                return

    def string(self) -> N:
        _, s, e, _ = self.take()
        z = e - 1 if e - s > 1 and self.src[e - 1] == self.src[s] else e
        if self.src[s] == "'":
            return N("string", s, e, [N("string_content", s + 1, z)] if z > s + 1 else [])
        kids, low = [], s + 1
        for m in re.compile(r"\\[\s\S]|\{?\$([A-Za-z_]\w*)((?:->\w+|\[[^\]]*\])*)\}?").finditer(self.src, s + 1, z):
            if m[1] is None:
                continue
            if m.start() > low:
                kids.append(N("string_content", low, m.start()))
            a = m.start(1) - 1
            n = N("variable_name", a, m.end(1), [N("name", a + 1, m.end(1))])
            if m[2]:
                n = N("member_access_expression" if m[2][0] == "-" else "subscript_expression", a, m.end(2), [n])
            kids.append(n)
            low = m.end()
        if low < z:
            kids.append(N("string_content", low, z))
        return N("encapsed_string", s, e, kids)

    def type_(self) -> None:
        self.skip("?")
        while self.type() == "id" or self.at("|", "&", "("):
            self.take()

    def parameters(self) -> N:
        start = self.here()
        self.take("(")

        def one() -> N:
            s = self.here()
            while not self.type() == "var" and not self.eof() and not self.at(")"):
                self.take()
            name = self.tag(self.variable(), "name")
            value = self.tag(self.expression(), "default_value") if self.skip("=") else None
            return self.make("simple_parameter", s, name, value)

        return self.make("formal_parameters", start, *self.listed(")", one), field="parameters")

    def block(self, kind: str = "compound_statement") -> N:
        start = self.here()
        self.take("{")
        kids = self.statements("}")
        self.take("}")
        return self.make(kind, start, *kids)

    def end(self) -> None:
        if not self.skip(";") and self.type() not in ("text", "eof") and not self.at("}"):
            raise Unread(";")

    def condition(self, field: str = "condition") -> N:
        s = self.here()
        self.take("(")
        n = self.expression()
        self.take(")")
        return self.make("parenthesized_expression", s, n, field=field)

    def body(self, *close: str) -> N:
        if self.at(":"):
            s = self.here()
            self.take()
            kids = self.statements(*close)
            return self.make("colon_block", s, *kids, field="body")
        n = self.statement()
        return self.tag(n or N("empty_statement", self.last(), self.last()), "body")

    def statement(self) -> N | None:
        start, kind, t = self.here(), self.type(), self.text()
        if kind == "tag":
            n = self.leaf("php_tag")
            if t == "<?=":
                return self.make("echo_statement", start, self.expression())
            return n
        if kind == "text":
            return self.leaf("text_interpolation")
        if t == ";":
            self.take()
            return None
        if t == "{":
            return self.block()
        if t == "#":
            while not self.at("]"):
                self.take()
            self.take("]")
            return None
        low = t.lower() if kind == "id" else ""
        if low in ("namespace", "use", "const", "global", "echo", "return", "break", "continue", "unset", "declare", "goto"):
            self.take()
            if low in ("use", "namespace"):
                kids = []
                while not self.at(";", "{") and not self.eof():
                    kids.append(self.leaf("name" if self.type() == "id" else self.text()))
                if self.at("{"):
                    self.recover_braces()
                self.skip(";")
                return self.make("namespace_use_declaration" if low == "use" else "namespace_definition", start, *[k for k in kids if k.kind == "name"])
            kids = []
            while not self.at(";", "}") and self.type() not in ("text", "eof"):
                if not self.skip(","):
                    kids.append(self.expression())
            self.end()
            return self.make({"const": "const_declaration", "global": "global_declaration"}.get(low, low + "_statement"), start, *kids)
        if low == "if":
            self.take()
            kids = [self.condition(), self.body("elseif", "else", "endif")]
            while self.at("elseif", "else"):
                s = self.here()
                e = self.text()
                self.take()
                if e == "elseif" or self.at("if") and kids[1].kind != "colon_block":
                    self.skip("if")
                    kids.append(self.make("else_if_clause", s, self.condition(), self.body("elseif", "else", "endif"), field="alternative"))
                else:
                    kids.append(self.make("else_clause", s, self.body("endif"), field="alternative"))
            if self.skip("endif"):
                self.end()
            return self.make("if_statement", start, *kids)
        if low in ("while", "switch"):
            self.take()
            c = self.condition()
            if low == "switch":
                s = self.here()
                self.take("{")
                kids = []
                while not self.at("}"):
                    g = self.here()
                    v = None
                    if not self.skip("default"):
                        self.take("case")
                        v = self.tag(self.expression(), "value")
                    if not self.skip(":"):
                        self.take(";")
                    kids.append(self.make("case_statement" if v else "default_statement", g, v, *self.statements("case", "default", "}")))
                self.take("}")
                return self.make("switch_statement", start, c, N("switch_block", s, self.last(), kids, "body"))
            n = self.make("while_statement", start, c, self.body("endwhile"))
            if self.skip("endwhile"):
                self.end()
            return n
        if low == "do":
            self.take()
            b = self.body()
            self.take("while")
            n = self.make("do_statement", start, b, self.condition())
            self.end()
            return n
        if low in ("for", "foreach"):
            self.take()
            self.take("(")
            kids = []
            while not self.at(")"):
                if not self.skip(";", ",", "as", "=>"):
                    kids.append(self.expression())
            self.take(")")
            n = self.make(low + "_statement", start, *kids, self.body("end" + low))
            if self.skip("end" + low):
                self.end()
            return n
        if low == "try":
            self.take()
            kids = [self.tag(self.block(), "body")]
            while self.at("catch", "finally"):
                s, what = self.here(), self.text()
                self.take()
                if what == "catch":
                    while not self.skip(")"):
                        self.take()
                kids.append(self.make(what + "_clause", s, self.tag(self.block(), "body")))
            return self.make("try_statement", start, *kids)
        if low == "function" and (self.type(1) == "id" or self.text(1) == "&" and self.type(2) == "id"):
            return self.function(start, "function_definition")
        if low in ("abstract", "final", "readonly", "class", "interface", "trait", "enum") and not self.text(1) in ("(", "::", "->") and self.type(1) == "id":
            while self.text().lower() not in ("class", "interface", "trait", "enum"):
                self.take()
            what = self.text().lower()
            self.take()
            name = self.leaf("name", "name")
            while not self.at("{"):
                self.take()
            return self.make(f"{what}_declaration", start, name, self.tag(self.block("declaration_list"), "body"))
        if low in ("public", "private", "protected", "static", "var", "final", "abstract", "case", "readonly") and not self.text(1) in ("::", "(") or low == "static" and self.type(1) == "var":
            while self.type() == "id" and self.text().lower() in ("public", "private", "protected", "static", "var", "final", "abstract", "readonly"):
                self.take()
            if self.at("function"):
                return self.function(start, "method_declaration")
            while self.type() == "id" and self.type(1) in ("var", "id") or self.at("?", "|"):
                self.take()
            kids = []
            while not self.at(";"):
                if not self.skip(","):
                    kids.append(self.expression())
            self.end()
            return self.make("property_declaration", start, *kids)
        n = self.expression()
        self.end()
        return self.make("expression_statement", start, n)

    def function(self, start: int, kind: str) -> N:
        self.take()
        self.skip("&")
        name = self.leaf("name", "name")
        params = self.parameters()
        if self.skip(":"):
            self.type_()
        if self.skip(";"):
            return self.make(kind, start, name, params)
        return self.make(kind, start, name, params, self.tag(self.block(), "body"))


class Rust(Parser):
    ROOT = "source_file"
    LEX = re.compile(r"(?P<ws>[ \t\f\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>b?r(?P<hash>#*)\"[\s\S]*?\"(?P=hash)|b?\"(?:\\[\s\S]|[^\\\"])*\"?|b?'(?:\\[^\n][^'\n]*|[^\\'\n])')|(?P<life>'[A-Za-z_]\w*)|(?P<num>0[xob][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.[0-9][0-9_]*|\.(?![.\w]))?(?:[eE][+-]?[0-9_]+)?(?:[iuf]\w+)?)|(?P<id>(?:r#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<op><<=|>>=|\.\.\.|\.\.=|->|=>|::|&&|\|\||\.\.|[-+*/%&|^=!<>]=|<<|[-+*/%&|^<>=!~?:()\[\]{},;.@#$])")
    BINARY = {"||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
    #: Whether a brace after a path opens a literal.
    literal = True

    def lex(self) -> None:
        super().lex()
        for c in self.comments:
            c.kind = "line_comment" if self.src[c.start : c.start + 2] == "//" else "block_comment"

    def token(self, kind: str, start: int, end: int, broke: bool) -> int:
        self.toks.append(("str" if kind == "hash" else kind, start, end, broke))
        return end

    def expression(self) -> N:
        start = self.here()
        if self.at("return", "break"):
            kind = self.text() + "_expression"
            self.take()
            if self.type() == "life":
                self.take()
            return self.make(kind, start, None if self.at(";", "}", ",", ")") else self.expression())
        if self.at("|", "||", "move"):
            self.skip("move")
            if not self.skip("||"):
                self.take("|")
                while not self.skip("|"):
                    self.take()
            if self.skip("->"):
                self.type_()
            return self.make("closure_expression", start, self.tag(self.expression(), "body"))
        n = self.binary(0) if not self.at("..", "..=") else N("range_expression", start, start)
        if self.at("..", "..="):
            self.take()
            right = None if self.at(")", "]", "}", ";", ",", "{", "=>") else self.binary(0)
            n = self.make("range_expression", start, n if n.kind != "range_expression" else None, right)
        if self.at("="):
            self.take()
            return self.make("assignment_expression", start, self.tag(n, "left"), self.tag(self.expression(), "right"))
        if self.type() == "op" and self.text()[-1:] == "=" and len(self.text()) > 1 and self.text() not in ("==", "!=", "<=", ">=", "..="):
            o = self.operator()
            return self.make("compound_assignment_expr", start, self.tag(n, "left"), o, self.tag(self.expression(), "right"))
        return n

    def unary(self) -> N:
        start = self.here()
        if self.at("-", "!", "*"):
            o = self.operator()
            return self.make("unary_expression", start, o, self.unary())
        if self.at("&", "&&"):
            self.take()
            self.skip("mut")
            return self.make("reference_expression", start, self.tag(self.unary(), "value"))
        n = self.primary()
        while True:
            if self.at("."):
                self.take()
                if self.at("await"):
                    self.take()
                    n = self.make("await_expression", start, n)
                else:
                    n = self.make("field_expression", start, self.tag(n, "value"), self.leaf("integer_literal" if self.type() == "num" else "field_identifier", "field"))
                    if self.at("::"):
                        self.take()
                        self.generics()
            elif self.at("?"):
                self.take()
                n = self.make("try_expression", start, n)
            elif self.at("("):
                s = self.here()
                self.take()
                kids = self.free(lambda: self.listed(")", self.expression))
                n = self.make("call_expression", start, self.tag(n, "function"), N("arguments", s, self.last(), kids, "arguments"))
            elif self.at("["):
                self.take()
                i = self.free(self.expression)
                self.take("]")
                n = self.make("index_expression", start, n, i)
            elif self.at("as"):
                self.take()
                self.type_()
                n = self.make("type_cast_expression", start, self.tag(n, "value"))
            elif self.at("{") and self.literal and n.kind in ("identifier", "scoped_identifier") and self.src[n.start : n.end].rsplit("::", 1)[-1][:1].isupper():
                s = self.here()
                self.take()

                def one() -> N:
                    f = self.here()
                    if self.at(".."):
                        self.take()
                        return self.make("base_field_initializer", f, None if self.at("}") else self.expression())
                    name = self.leaf("field_identifier", "field")
                    if self.skip(":"):
                        return self.make("field_initializer", f, name, self.tag(self.expression(), "value"))
                    return self.make("shorthand_field_initializer", f, name)

                kids = self.listed("}", one)
                n = self.make("struct_expression", start, self.tag(n, "name"), N("field_initializer_list", s, self.last(), kids, "body"))
            else:
                return n

    def free(self, f):
        was, self.literal = self.literal, True
        try:
            return f()
        finally:
            self.literal = was

    def header(self) -> N:
        was, self.literal = self.literal, False
        try:
            s = self.here()
            if self.skip("let"):
                self.pattern("=")
                self.take("=")
                return self.make("let_condition", s, self.tag(self.binary(0), "value"))
            n = self.expression()
            return n
        finally:
            self.literal = was

    def pattern(self, *close: str) -> None:
        deep = 0
        while not self.eof() and not (deep == 0 and self.at(*close)):
            deep += (self.text() in ("(", "[", "{")) - (self.text() in (")", "]", "}"))
            self.take()

    def generics(self) -> None:
        deep = 0
        while not self.eof():
            t = self.text()
            deep += (t == "<") - (t == ">") + 2 * (t == "<<") - (t == "->" and False)
            self.take()
            if deep <= 0:
                return

    def type_(self) -> None:
        while True:
            if self.at("&", "&&", "*", "mut", "const", "dyn", "impl") or self.type() == "life":
                self.take()
            elif self.at("(", "["):
                self.balanced()
                break
            elif self.type() == "id":
                self.take()
                while True:
                    if self.at("<"):
                        self.generics()
                    elif self.at("::"):
                        self.take()
                        if self.type() == "id":
                            self.take()
                    elif self.at("(") and self.src[self.toks[self.i - 1][1] : self.toks[self.i - 1][2]] in ("Fn", "FnMut", "FnOnce", "fn"):
                        self.balanced()
                    elif self.at("->"):
                        self.take()
                        self.type_()
                    else:
                        break
                break
            elif self.at("<"):
                self.generics()
            elif self.at("::", "!"):
                self.take()
            else:
                raise Unread("type")
        while self.skip("+"):
            self.type_()

    def balanced(self) -> N:
        start, deep = self.here(), 0
        while not self.eof():
            t = self.text() if self.type() == "op" else ""
            deep += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            self.take()
            if deep <= 0:
                break
        return N("token_tree", start, self.last())

    def primary(self) -> N:
        start, kind, t = self.here(), self.type(), self.text()
        if kind == "str":
            return self.leaf("char_literal" if t.lstrip("b")[:1] == "'" else "raw_string_literal" if t.lstrip("b")[:1] == "r" else "string_literal")
        if kind == "num":
            return self.leaf("float_literal" if "." in t else "integer_literal")
        if kind == "life":
            self.take()
            self.skip(":")
            return self.primary()
        if kind == "id":
            f = getattr(self, "e_" + t, None)
            if f:
                return f(start)
            if t in ("true", "false"):
                return self.leaf("boolean_literal")
            if t in ("async", "unsafe", "const") and self.text(1) in ("{", "move"):
                self.take()
                self.skip("move")
                return self.make(t + "_block", start, self.block())
            if t in ("let", "fn", "else", "in", "as", "where", "struct", "enum", "impl", "trait", "use", "mod", "pub", "static", "type"):
                raise Unread(t)
            n = self.leaf("self" if t == "self" else "identifier")
            while self.at("::"):
                self.take()
                if self.at("<"):
                    self.generics()
                    n = self.make("generic_function", start, self.tag(n, "function"))
                    continue
                n = self.make("scoped_identifier", start, self.tag(n, "path"), self.leaf("identifier", "name"))
            if self.at("!") and self.text(1) in ("(", "[", "{"):
                self.take()
                return self.make("macro_invocation", start, self.tag(n, "macro"), self.tokens())
            return n
        if t == "(":
            self.take()
            kids, comma = [], False

            def inside() -> None:
                nonlocal comma
                while not self.at(")"):
                    kids.append(self.expression())
                    if not self.at(")"):
                        self.take(",")
                        comma = True

            self.free(inside)
            self.take(")")
            return self.make("unit_expression" if not kids else "tuple_expression" if comma else "parenthesized_expression", start, *kids)
        if t == "[":
            self.take()
            kids = []

            def elements() -> None:
                while not self.at("]"):
                    if not self.skip(",", ";"):
                        kids.append(self.expression())
                    if self.eof():
                        raise Unread("]")

            self.free(elements)
            self.take("]")
            return self.make("array_expression", start, *kids)
        if t == "{":
            return self.block()
        if t == "<":
            self.generics()
            self.take("::")
            return self.make("scoped_identifier", start, self.leaf("identifier", "name"))
        raise Unread(t)

    def tokens(self) -> N:
        """A macro's tokens: leaves, and trees for what is in brackets."""
        start = self.here()
        self.take()
        kids = []
        while not self.at(")", "]", "}"):
            if self.eof():
                raise Unread(")")
            if self.at("(", "[", "{"):
                kids.append(self.tokens())
            elif self.type() == "op":
                self.take()
            else:
                kids.append(self.leaf({"str": "string_literal", "num": "integer_literal", "id": "identifier"}.get(self.type(), "lifetime")))
        self.take()
        return self.make("token_tree", start, *kids)

    def e_if(self, start: int) -> N:
        self.take()
        kids = [self.tag(self.header(), "condition"), self.tag(self.block(), "consequence")]
        if self.at("else"):
            s = self.here()
            self.take()
            kids.append(self.make("else_clause", s, self.e_if(self.here()) if self.at("if") else self.block(), field="alternative"))
        return self.make("if_expression", start, *kids)

    def e_while(self, start: int) -> N:
        self.take()
        return self.make("while_expression", start, self.tag(self.header(), "condition"), self.tag(self.block(), "body"))

    def e_loop(self, start: int) -> N:
        self.take()
        return self.make("loop_expression", start, self.tag(self.block(), "body"))

    def e_for(self, start: int) -> N:
        self.take()
        self.pattern("in")
        self.take("in")
        return self.make("for_expression", start, self.tag(self.header(), "value"), self.tag(self.block(), "body"))

    def e_match(self, start: int) -> N:
        self.take()
        value = self.tag(self.header(), "value")
        s = self.here()
        self.take("{")
        kids = []
        while not self.at("}"):
            if self.skip(","):
                continue
            a = self.here()
            self.pattern("=>")
            p = N("match_pattern", a, self.last(), field="pattern")
            self.take("=>")
            kids.append(self.make("match_arm", a, p, self.tag(self.free(self.expression), "value")))
        self.take("}")
        return self.make("match_expression", start, value, N("match_block", s, self.last(), kids, "body"))

    def block(self) -> N:
        start = self.here()
        self.take("{")
        kids = self.free(lambda: self.statements("}"))
        self.take("}")
        return self.make("block", start, *kids)

    def statement(self) -> N | None:
        start, t = self.here(), self.text()
        if self.skip(";"):
            return None
        if self.at("#"):
            self.take()
            self.skip("!")
            inner = self.balanced()
            return self.make("attribute_item", start, inner)
        if self.at("pub"):
            self.take()
            if self.at("("):
                self.balanced()
            t = self.text()
        while self.at("async", "unsafe", "const", "extern", "default") and (self.text(1) in ("fn", "unsafe", "async", "extern", "impl", "trait") or self.type(1) == "str"):
            self.take()
            if self.type() == "str":
                self.take()
            t = self.text()
        if self.type() == "id":
            if t == "let":
                self.take()
                self.pattern("=", ";", ":")
                if self.skip(":"):
                    self.type_()
                value = self.tag(self.expression(), "value") if self.skip("=") else None
                other = None
                if self.skip("else"):
                    other = self.block()
                self.take(";")
                return self.make("let_declaration", start, value, other)
            if t == "fn":
                self.take()
                name = self.leaf("identifier", "name")
                if self.at("<"):
                    self.generics()
                params = self.tag(self.balanced(), "parameters")
                params.kind = "parameters"
                while not self.at("{", ";") and not self.eof():
                    self.take()
                body = None if self.skip(";") else self.tag(self.block(), "body")
                return self.make("function_item" if body else "function_signature_item", start, name, params, body)
            if t in ("impl", "trait", "mod", "extern") and not self.text(1) == "!":
                self.take()
                s = self.here()
                while not self.at("{", ";") and not self.eof():
                    self.take()
                head = N("type_identifier", s, self.last())
                if self.skip(";"):
                    return self.make(t + "_item", start, head)
                body = self.tag(self.block(), "body")
                body.kind = "declaration_list"
                return self.make(t + "_item", start, head, body)
            if t in ("use", "static", "const", "type", "struct", "enum", "union", "macro_rules") and self.type(1) in ("id", "op") and not (t in ("union", "type") and self.text(1) in (".", "=", "(")):
                self.take()
                while not self.at("{", ";", "(") and not self.eof() and not self.at("="):
                    self.take()
                if self.at("="):
                    self.take()
                    value = self.tag(self.expression(), "value") if t in ("static", "const") else self.type_()
                    self.skip(";")
                    return self.make(t + "_item", start, value)
                while self.at("{", "("):
                    self.balanced()
                    while t == "struct" and not self.at(";", "{") and self.at("where"):
                        self.take()
                self.skip(";")
                return self.make("use_declaration" if t == "use" else "macro_definition" if t == "macro_rules" else t + "_item", start)
        n = self.expression()
        if self.skip(";"):
            return self.make("expression_statement", start, n)
        if self.at("}") or self.eof():
            return n
        if n.kind in ("if_expression", "match_expression", "while_expression", "loop_expression", "for_expression", "block", "unsafe_block", "macro_invocation", "async_block"):
            return self.make("expression_statement", start, n)
        raise Unread(";")


class Dockerfile:
    """Instructions by line; a line goes on after a backslash."""

    def __init__(self, src: str):
        self.src = src

    def parse(self) -> N:
        root, comments, at = N("source_file", 0, len(self.src)), [], 0
        line = re.compile(r"[ \t]*(?:(#[^\n]*)|([A-Za-z]+)\b((?:\\[ \t]*\r?\n(?:[ \t]*#[^\n]*\n)*|[^\n])*))?\r?(?:\n|\Z)")
        while at < len(self.src):
            m = line.match(self.src, at)
            if not m or m.end() == at:
                end = self.src.find("\n", at)
                at = len(self.src) if end < 0 else end + 1
                continue
            if m[1]:
                comments.append(N("comment", m.start(1), m.end(1)))
            elif m[2]:
                end = m.end(3) - (len(m[3]) - len(m[3].rstrip()))
                root.kids.append(N(m[2].lower() + "_instruction", m.start(2), end, self.parts(m[2].lower(), m.start(3), end)))
            at = m.end()
        place_comments(root, comments)
        return root

    def parts(self, name: str, start: int, end: int) -> list[N]:
        text = self.src
        words = [(m.start(), m.end()) for m in re.compile(r"(?:\"[^\"]*\"|\\\r?\n|[^\s\\]|\\.)+").finditer(text, start, end) if text[m.start() : m.end()].strip("\\\r\n")]
        out = []
        while words and text[words[0][0] : words[0][0] + 2] == "--":
            a, z = words.pop(0)
            out.append(N("param", a, z))
        if not words:
            return out
        if name == "from":
            a, z = words[0]
            m = re.compile(r"([^:@\s]+(?::\d+/[^:@\s]+)?)(:[^@\s]+)?(@\S+)?").match(text, a, z)
            parts = [N(k, *m.span(g), field=f) for g, k, f in ((1, "image_name", "name"), (2, "image_tag", "tag"), (3, "image_digest", "digest")) if m and m[g]]
            out.append(N("image_spec", a, z, parts))
            if len(words) > 2 and text[words[1][0] : words[1][1]].lower() == "as":
                out.append(N("image_alias", *words[2], field="as"))
        elif name in ("run", "cmd", "entrypoint", "shell", "healthcheck"):
            a, z = words[0][0], words[-1][1]
            if text[a] == "[":
                items = [N("json_string", m.start(), m.end()) for m in re.compile(r'"(?:\\.|[^"\\])*"').finditer(text, a, z)]
                out.append(N("json_string_array", a, z, items))
            else:
                pieces = [N("shell_fragment", m.start(), m.end()) for m in re.compile(r"[^\s\\](?:[^\\\n]|\\(?![ \t]*\r?\n))*").finditer(text, a, z)]
                out.append(N("shell_command", a, z, [p for p in pieces if text[p.start : p.start + 1] != "#" or p is pieces[0]]))
        elif name in ("env", "arg", "label"):
            for a, z in words:
                eq = text.find("=", a, z)
                out.append(N(f"{name}_pair", a, z, [N("unquoted_string", a, eq if eq > 0 else z, field="name"), *([N("unquoted_string", eq + 1, z, field="value")] if eq > 0 else [])]))
        else:
            out += [N("path", a, z) for a, z in words]
        return out
