"""JavaScript front end; types of TypeScript are read and left out of the tree, JSX is an expression without parts."""

from __future__ import annotations

import re

from sylva.sources.syntax import N, Parser, Unread

_OPS = r">>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|>>>|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|\*\*|<<|>>|[-+*/%&|^!~<>=?:;,.(){}\[\]@#]"
_NO_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_RESERVED = {"if", "else", "for", "while", "do", "return", "break", "continue", "switch", "case", "default", "throw", "try", "catch", "finally", "var", "const", "import", "export", "extends", "in", "instanceof", "with", "debugger"}
#: What ends an expression, begins one besides operators, follows an object.
_AFTER, _PREFIXES, _MEMBERS = {")", "]", "}", ",", ";"}, {"typeof", "void", "delete", "await"}, {".", "?.", "[", "(", "!"}


class JavaScript(Parser):
    LEX = re.compile(rf"(?P<ws>[ \t\f\r\xa0]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\A#![^\n]*)|(?P<str>'(?:\\[\s\S]|[^\\'\n])*'?|\"(?:\\[\s\S]|[^\\\"\n])*\"?)|(?P<tick>`)|(?P<num>0[xXoObB][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?n?)|(?P<id>#?[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<slash>/)|(?P<op>{_OPS})")
    BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
    RIGHT = frozenset(["**"])
    WHOLE = frozenset(["str", "num", "id", "op"])
    no_in = False

    def token(self, kind: str, start: int, end: int, broke: bool) -> int:
        if kind == "slash":
            before = self.toks[-1] if self.toks else ("op", 0, 0, True)
            text = self.src[before[1] : before[2]]
            value = before[0] in ("str", "num", "tmpl", "regex") or before[0] == "id" and text not in _NO_VALUE or before[0] == "op" and text in (")", "]", "}")
            m = None if value else re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\n\\])*\]|[^/\\\[\n])+/[a-z]*").match(self.src, start, self.stop)
            if m:
                kind, end = "regex", m.end()
            else:
                kind = "op"
                if self.src[start : start + 2] == "/=":
                    end = start + 2
        elif kind == "tick":
            kind, end = "tmpl", self.template_end(start)
        self.toks.append((kind, start, end, broke))
        return end

    def template_end(self, start: int) -> int:
        at = start + 1
        while at < self.stop:
            c = self.src[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif c == "$" and self.src[at + 1 : at + 2] == "{":
                at = self.hole_end(at + 2)
            else:
                at += 1
        return self.stop

    def hole_end(self, at: int) -> int:
        deep = 1
        while at < self.stop and deep:
            c = self.src[at]
            if c == "`":
                at = self.template_end(at)
                continue
            if c in "'\"":
                m = re.compile(r"'(?:\\[\s\S]|[^\\'\n])*'?|\"(?:\\[\s\S]|[^\\\"\n])*\"?").match(self.src, at, self.stop)
                at = m.end()
                continue
            deep += (c == "{") - (c == "}")
            at += 1
        return at

    # expressions
    def expression(self) -> N:
        start = self.here()
        n = self.assign()
        if self.at(","):
            kids = [n]
            while self.skip(","):
                kids.append(self.assign())
            return self.make("sequence_expression", start, *kids)
        return n

    def infix(self) -> str:
        t = super().infix()
        return "" if t == "in" and self.no_in else t

    def assign(self) -> N:
        start = self.here()
        n = self.arrow()
        if n:
            return n
        if self.at("yield"):
            self.take()
            self.skip("*")
            return self.make("yield_expression", start, None if self.broke() or self.at(")", "]", "}", ",", ";") else self.assign())
        n = self.binary(0)
        if self.text() in _AFTER or self.type() not in ("op", "id"):
            return n
        if self.at("?"):
            self.take()
            held, self.no_in = self.no_in, False
            yes = self.tag(self.assign(), "consequence")
            self.no_in = held
            self.take(":")
            return self.make("ternary_expression", start, self.tag(n, "condition"), yes, self.tag(self.assign(), "alternative"))
        if self.at("as", "satisfies") and not self.broke():
            self.take()
            self.type_()
        if self.at("="):
            self.take()
            return self.make("assignment_expression", start, self.tag(self.pattern(n), "left"), self.tag(self.assign(), "right"))
        if self.type() == "op" and self.text()[-1:] == "=" and len(self.text()) > 1 and self.text() not in ("==", "===", "!=", "!==", "<=", ">="):
            o = self.operator()
            return self.make("augmented_assignment_expression", start, self.tag(n, "left"), o, self.tag(self.assign(), "right"))
        return n

    def pattern(self, n: N) -> N:
        """An object or array that turns out to be a pattern."""
        if n.kind in ("object", "array"):
            n.kind += "_pattern"
            for k in n.kids:
                if k.kind == "pair":
                    k.kind = "pair_pattern"
                    k.kids[-1] = self.tag(self.pattern(k.kids[-1]), "value")
                elif k.kind == "shorthand_property_identifier":
                    k.kind = "shorthand_property_identifier_pattern"
                elif k.kind == "spread_element":
                    k.kind = "rest_pattern"
                elif k.kind == "assignment_expression":
                    k.kind = "assignment_pattern"
                else:
                    self.pattern(k)
        elif n.kind == "assignment_expression":
            n.kind = "assignment_pattern"
        return n

    def arrow(self) -> N | None:
        start = self.here()
        plain = self.type() == "id" and self.text() not in _RESERVED
        if plain and self.text() == "async" and not self.toks[self.i][2] == 0 and (self.type(1) == "id" or self.text(1) == "(") and self.text(1) not in ("function",):
            i = self.i
            self.take()
            n = self.arrow()
            if n:
                n.start = start
                return n
            self.i = i
            return None
        if plain and self.text(1) == "=>" and self.type(1) == "op":
            name = self.leaf("identifier", "parameter")
            self.take()
            return self.make("arrow_function", start, name, self.body())
        if self.at("(") and self.closes():
            def whole() -> N:
                params = self.parameters()
                if self.at(":"):
                    self.take()
                    self.type_()
                self.take("=>")
                return self.make("arrow_function", start, params, self.body())

            return self.tried(whole)
        return None

    def closes(self) -> bool:
        """Whether an arrow, or a type, follows the closing parenthesis."""
        deep, j = 0, self.i
        while j < len(self.toks) - 1:
            t = self.toks[j]
            x = self.src[t[1] : t[2]] if t[0] == "op" else ""
            deep += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
            j += 1
            if deep == 0:
                t = self.toks[j]
                return self.src[t[1] : t[2]] in ("=>", ":")
        return False

    def body(self) -> N:
        if self.at("{"):
            return self.tag(self.block(), "body")
        return self.tag(self.assign(), "body")

    def type_(self) -> None:
        """A type, passed over."""
        self.skip("|", "&")
        while True:
            if self.at("(", "[", "{", "<"):
                self.balanced()
                if self.skip("=>"):
                    self.type_()
            elif self.at("keyof", "typeof", "readonly", "infer", "unique"):
                self.take()
                continue
            elif self.type() in ("id", "str", "num", "tmpl"):
                self.take()
            else:
                raise Unread("type")
            while self.at(".", "[", "<") and not self.broke():
                if self.at("."):
                    self.take()
                    self.take()
                else:
                    self.balanced()
            if self.at("is", "extends") and not self.broke():
                self.take()
                continue
            if not self.skip("|", "&"):
                return

    def balanced(self) -> None:
        deep = 0
        while True:
            t = self.text() if self.type() == "op" else ""
            deep += (t in ("(", "[", "{", "<")) - (t in (")", "]", "}", ">")) - 2 * (t == ">>")
            self.take()
            if deep <= 0:
                return

    def unary(self) -> N:
        start = self.here()
        if self.type() != "op" and self.text() not in _PREFIXES:
            n = self.postfix(start)
            return self.make("update_expression", start, self.tag(n, "argument"), self.operator()) if self.at("++", "--") and not self.broke() else n
        if self.at("!", "~", "-", "+", "typeof", "void", "delete"):
            o = self.operator()
            return self.make("unary_expression", start, o, self.tag(self.unary(), "argument"))
        if self.at("++", "--"):
            o = self.operator()
            return self.make("update_expression", start, o, self.tag(self.unary(), "argument"))
        if self.at("await") and self.type() == "id":
            self.take()
            return self.make("await_expression", start, self.unary())
        n = self.postfix(start)
        if self.at("++", "--") and not self.broke():
            o = self.operator()
            return self.make("update_expression", start, self.tag(n, "argument"), o)
        return n

    def postfix(self, start: int) -> N:
        if self.at("new") and self.type() == "id":
            self.take()
            if self.skip("."):
                self.take()
                n = self.make("meta_property", start)
            else:
                s = self.here()
                made = self.postfix(s) if self.at("new") else self.primary()
                made = self.members(made, s, calls=False)
                args = self.arguments() if self.at("(") else None
                n = self.make("new_expression", start, self.tag(made, "constructor"), self.tag(args, "arguments") if args else None)
        else:
            n = self.primary()
        return self.members(n, start)

    def members(self, n: N, start: int, calls: bool = True) -> N:
        while True:
            kind = self.type()
            if kind != "tmpl" and (kind != "op" or self.text() not in _MEMBERS):
                return n
            if self.at(".", "?.") and self.type() == "op":
                optional = self.text() == "?."
                self.take()
                if optional and self.at("(") and calls:
                    n = self.make("call_expression", start, self.tag(n, "function"), self.tag(self.arguments(), "arguments"))
                elif optional and self.at("["):
                    self.take()
                    i = self.tag(self.expression(), "index")
                    self.take("]")
                    n = self.make("subscript_expression", start, self.tag(n, "object"), i)
                else:
                    if self.type() != "id":
                        raise Unread("property")
                    n = self.make("member_expression", start, self.tag(n, "object"), self.leaf("private_property_identifier" if self.text()[0] == "#" else "property_identifier", "property"))
            elif self.at("["):
                self.take()
                held, self.no_in = self.no_in, False
                i = self.tag(self.expression(), "index")
                self.no_in = held
                self.take("]")
                n = self.make("subscript_expression", start, self.tag(n, "object"), i)
            elif self.at("(") and calls:
                n = self.make("call_expression", start, self.tag(n, "function"), self.tag(self.arguments(), "arguments"))
            elif self.type() == "tmpl" and calls:
                n = self.make("call_expression", start, self.tag(n, "function"), self.tag(self.template(), "arguments"))
            elif self.at("!") and not self.broke() and self.text(1) in (".", ")", ";", ",", "["):
                self.take()
            else:
                return n

    def arguments(self) -> N:
        start = self.here()
        self.take("(")
        held, self.no_in = self.no_in, False
        kids = self.listed(")", self.element)
        self.no_in = held
        return self.make("arguments", start, *kids)

    def element(self) -> N:
        start = self.here()
        if self.skip("..."):
            return self.make("spread_element", start, self.assign())
        return self.assign()

    def primary(self) -> N:
        start, kind, t = self.here(), self.type(), self.text()
        if kind == "str":
            return self.string()
        if kind == "num":
            return self.leaf("number")
        if kind == "regex":
            s, e = self.toks[self.i][1:3]
            cut = self.src.rindex("/", s, e)
            self.take()
            flags = [N("regex_flags", cut + 1, e, field="flags")] if cut + 1 < e else []
            return N("regex", s, e, [N("regex_pattern", s + 1, cut, field="pattern"), *flags])
        if kind == "tmpl":
            return self.template()
        if kind == "id":
            if t in ("true", "false", "null", "undefined", "this", "super"):
                return self.leaf(t)
            if t == "function" or t == "async" and self.text(1) == "function":
                return self.function("function_expression", start)
            if t == "class":
                return self.class_("class", start)
            if t == "import" and self.text(1) in ("(", "."):
                return self.leaf("import")
            if t in _RESERVED:
                raise Unread(t)
            return self.leaf("identifier")
        if t == "(":
            self.take()
            held, self.no_in = self.no_in, False
            n = self.expression()
            if self.at(":"):
                self.take()
                self.type_()
            self.no_in = held
            self.take(")")
            return self.make("parenthesized_expression", start, n)
        if t == "[":
            self.take()
            return self.make("array", start, *self.listed("]", self.element))
        if t == "{":
            self.take()
            return self.make("object", start, *self.listed("}", self.member))
        if t == "<" and self.type(1) in ("id", "op"):
            return self.jsx(start)
        raise Unread(t)

    def jsx(self, start: int) -> N:
        deep, at = 0, start
        for m in re.compile(r"<(/?)([A-Za-z][\w.:-]*)?(?:[^<>\"'{}]|\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{[^{}]*\})*\})*?(/?)>").finditer(self.src, start, self.stop):
            deep += -1 if m[1] else 0 if m[3] else 1
            at = m.end()
            if deep <= 0:
                break
        if at == start:
            raise Unread("<")
        while not self.eof() and self.toks[self.i][1] < at:
            self.i += 1
        return N("jsx_element", start, at)

    def string(self) -> N:
        _, s, e, _ = self.take()
        z = e - 1 if e - s > 1 and self.src[e - 1] == self.src[s] else e
        return N("string", s, e, [N("string_fragment", s + 1, z)] if z > s + 1 else [])

    def template(self) -> N:
        _, s, e, _ = self.take()
        kids, at = [], s + 1
        low = at
        while at < e - 1:
            if self.src[at] == "\\":
                at += 2
            elif self.src[at] == "$" and self.src[at + 1 : at + 2] == "{":
                if at > low:
                    kids.append(N("string_fragment", low, at))
                z = self.hole_end(at + 2)
                kids.append(N("template_substitution", at, z, self.inner(at + 2, z - 1)[:1]))
                at = low = z
            else:
                at += 1
        if low < e - 1:
            kids.append(N("string_fragment", low, e - 1))
        return N("template_string", s, e, kids)

    def key(self) -> N:
        start = self.here()
        if self.type() == "str":
            return self.string()
        if self.type() == "num":
            return self.leaf("number")
        if self.at("["):
            self.take()
            n = self.assign()
            self.take("]")
            return self.make("computed_property_name", start, n)
        if self.type() != "id":
            raise Unread("key")
        return self.leaf("private_property_identifier" if self.text()[0] == "#" else "property_identifier")

    def member(self) -> N:
        start = self.here()
        if self.skip("..."):
            return self.make("spread_element", start, self.assign())
        while self.at("async", "get", "set", "*") and self.text(1) not in (",", ":", "(", "}", "="):
            self.take()
        key = self.key()
        if self.at("("):
            return self.make("method_definition", start, self.tag(key, "name"), self.parameters(), self.tag(self.block(), "body"))
        if self.skip(":"):
            return self.make("pair", start, self.tag(key, "key"), self.tag(self.assign(), "value"))
        if key.kind != "property_identifier":
            raise Unread("member")
        key.kind = "shorthand_property_identifier"
        if self.skip("="):
            key.kind = "shorthand_property_identifier_pattern"
            return self.make("object_assignment_pattern", start, self.tag(key, "left"), self.tag(self.assign(), "right"))
        return key

    def binding(self) -> N:
        """A declared name or pattern."""
        start = self.here()
        if self.at("["):
            self.take()
            return self.make("array_pattern", start, *self.listed("]", self.defaulted))
        if self.at("{"):
            self.take()

            def one() -> N:
                s = self.here()
                if self.skip("..."):
                    return self.make("rest_pattern", s, self.binding())
                key = self.key()
                if self.skip(":"):
                    return self.make("pair_pattern", s, self.tag(key, "key"), self.tag(self.defaulted(), "value"))
                key.kind = "shorthand_property_identifier_pattern"
                if self.skip("="):
                    return self.make("object_assignment_pattern", s, self.tag(key, "left"), self.tag(self.assign(), "right"))
                return key

            return self.make("object_pattern", start, *self.listed("}", one))
        if self.type() != "id" or self.text() in _RESERVED:
            raise Unread("name")
        return self.leaf("this" if self.text() == "this" else "identifier")

    def defaulted(self) -> N:
        start = self.here()
        if self.skip("..."):
            n = self.make("rest_pattern", start, self.binding())
        else:
            while self.at("public", "private", "protected", "readonly") and self.type(1) == "id":
                self.take()
            n = self.binding()
        self.skip("?")
        if self.skip(":"):
            self.type_()
        if self.skip("="):
            return self.make("assignment_pattern", start, self.tag(n, "left"), self.tag(self.assign(), "right"))
        return n

    def parameters(self) -> N:
        start = self.here()
        self.take("(")
        return self.tag(self.make("formal_parameters", start, *self.listed(")", self.defaulted)), "parameters")

    def function(self, kind: str, start: int) -> N:
        self.skip("async")
        self.take("function")
        star = self.skip("*")
        name = self.leaf("identifier", "name") if self.type() == "id" else None
        if self.at("<"):
            self.balanced()
        params = self.parameters()
        if self.skip(":"):
            self.type_()
        if star:
            kind = {"function_expression": "generator_function", "function_declaration": "generator_function_declaration"}[kind]
        return self.make(kind, start, name, params, self.tag(self.block(), "body"))

    def class_(self, kind: str, start: int) -> N:
        self.take("class")
        name = self.leaf("identifier", "name") if self.type() == "id" and not self.at("extends", "implements") else None
        if self.at("<"):
            self.balanced()
        heritage = None
        if self.at("extends"):
            s = self.here()
            self.take()
            heritage = self.make("class_heritage", s, self.postfix(self.here()))
            if self.at("<"):
                self.balanced()
        if self.skip("implements"):
            self.type_()
            while self.skip(","):
                self.type_()
        s = self.here()
        self.take("{")
        kids = []
        while not self.at("}"):
            if self.eof():
                raise Unread("}")
            if self.skip(";"):
                continue
            m = self.here()
            while self.at("static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override", "declare", "abstract") and self.text(1) not in ("(", "=", ";", "}", ":"):
                self.take()
            key = self.key()
            self.skip("?", "!")
            if self.at("<"):
                self.balanced()
            if self.at("("):
                params = self.parameters()
                if self.skip(":"):
                    self.type_()
                kids.append(self.make("method_definition", m, self.tag(key, "name"), params, self.tag(self.block(), "body") if self.at("{") else None))
            else:
                if self.skip(":"):
                    self.type_()
                value = None
                if self.skip("="):
                    value = self.tag(self.assign(), "value")
                kids.append(self.make("field_definition", m, self.tag(key, "property"), value))
        self.take("}")
        return self.make(kind, start, name, heritage, N("class_body", s, self.last(), kids, "body"))

    # statements
    def block(self) -> N:
        start = self.here()
        self.take("{")
        held, self.no_in = self.no_in, False
        kids = self.statements("}")
        self.no_in = held
        self.take("}")
        return self.make("statement_block", start, *kids)

    def end(self) -> None:
        if not self.skip(";") and not (self.broke() or self.at("}") or self.eof()):
            raise Unread(";")

    def declared(self, kind: str, start: int) -> N:
        self.take()
        kids = []
        while True:
            s = self.here()
            name = self.tag(self.binding(), "name")
            self.skip("!")
            if self.skip(":"):
                self.type_()
            value = None
            if self.skip("="):
                value = self.tag(self.assign(), "value")
            kids.append(self.make("variable_declarator", s, name, value))
            if not self.skip(","):
                break
        return self.make(kind, start, *kids)

    def parenthesized(self, field: str) -> N:
        s = self.here()
        self.take("(")
        n = self.expression()
        self.take(")")
        return self.make("parenthesized_expression", s, n, field=field)

    def statement(self) -> N | None:
        start, t, word = self.here(), self.text(), self.type() == "id"
        if self.type() == "op":
            if t == ";":
                self.take()
                return self.make("empty_statement", start)
            if t == "{":
                return self.block()
            if t == "@":
                self.take()
                self.postfix(self.here())
                return None
        if word:
            f = getattr(self, "s_" + t, None)
            if f and not (t in ("import",) and self.text(1) in ("(", ".")):
                return f(start)
            if t in ("var", "const") or t == "let" and (self.type(1) == "id" or self.text(1) in ("{", "[")):
                n = self.declared("variable_declaration" if t == "var" else "lexical_declaration", start)
                self.end()
                n.end = self.last()
                return n
            if t == "function" or t == "async" and self.text(1) == "function" and not self.toks[self.i + 1][3]:
                return self.function("function_declaration", start)
            if t == "class":
                return self.class_("class_declaration", start)
            if t in ("interface", "namespace", "declare", "enum", "abstract", "type") and self.type(1) == "id" and not self.toks[self.i + 1][3]:
                if t == "abstract":
                    self.take()
                    return self.class_("class_declaration", start)
                return self.passed(start)
            if self.text(1) == ":" and self.type(1) == "op" and t not in _RESERVED:
                label = self.leaf("statement_identifier", "label")
                self.take()
                return self.make("labeled_statement", start, label, self.tag(self.statement(), "body"))
        n = self.expression()
        self.end()
        return self.make("expression_statement", start, n)

    def passed(self, start: int) -> N:
        """A declaration of types."""
        kind = self.text() + "_declaration"
        while not self.eof() and not self.at("{", ";", "="):
            self.take()
        if self.at("{"):
            self.balanced()
        elif self.skip("="):
            self.type_()
            self.skip(";")
        return self.make(kind, start)

    def s_debugger(self, start: int) -> N:
        self.take()
        self.end()
        return self.make("debugger_statement", start)

    def s_return(self, start: int, kind: str = "return_statement") -> N:
        self.take()
        value = None if self.broke() or self.at(";", "}") or self.eof() else self.expression()
        self.end()
        return self.make(kind, start, value)

    def s_throw(self, start: int) -> N:
        return self.s_return(start, "throw_statement")

    def s_break(self, start: int) -> N:
        kind = self.text() + "_statement"
        self.take()
        label = self.leaf("statement_identifier", "label") if self.type() == "id" and not self.broke() else None
        self.end()
        return self.make(kind, start, label)

    s_continue = s_break

    def s_if(self, start: int) -> N:
        self.take()
        kids = [self.parenthesized("condition"), self.tag(self.statement(), "consequence")]
        if self.at("else"):
            s = self.here()
            self.take()
            kids.append(self.make("else_clause", s, self.statement(), field="alternative"))
        return self.make("if_statement", start, *kids)

    def s_while(self, start: int) -> N:
        self.take()
        return self.make("while_statement", start, self.parenthesized("condition"), self.tag(self.statement(), "body"))

    def s_do(self, start: int) -> N:
        self.take()
        body = self.tag(self.statement(), "body")
        self.take("while")
        n = self.make("do_statement", start, body, self.parenthesized("condition"))
        self.skip(";")
        return n

    def s_for(self, start: int) -> N:
        self.take()
        self.skip("await")
        self.take("(")
        self.no_in = True
        try:
            s, first = self.here(), None
            if self.at("var", "let", "const"):
                if self.type(1) == "op" or self.text(2) in ("of", "in"):
                    i = self.i
                    self.take()
                    left = self.tried(self.binding)
                    if left is None or not self.at("of", "in"):
                        self.i = i
                        first = self.declared("variable_declaration" if self.text() == "var" else "lexical_declaration", s)
                    else:
                        first = left
                else:
                    first = self.declared("variable_declaration" if self.text() == "var" else "lexical_declaration", s)
            elif not self.at(";"):
                first = self.expression()
        finally:
            self.no_in = False
        if self.at("of", "in"):
            o = self.operator()
            right = self.tag(self.expression(), "right")
            self.take(")")
            return self.make("for_in_statement", start, self.tag(self.pattern(first), "left"), o, right, self.tag(self.statement(), "body"))
        self.take(";")
        condition = None if self.at(";") else self.tag(self.expression(), "condition")
        self.take(";")
        step = None if self.at(")") else self.tag(self.expression(), "increment")
        self.take(")")
        return self.make("for_statement", start, self.tag(first, "initializer") if first else None, condition, step, self.tag(self.statement(), "body"))

    def s_try(self, start: int) -> N:
        self.take()
        kids = [self.tag(self.block(), "body")]
        if self.at("catch"):
            s = self.here()
            self.take()
            name = None
            if self.skip("("):
                name = self.tag(self.defaulted(), "parameter")
                self.take(")")
            kids.append(self.make("catch_clause", s, name, self.tag(self.block(), "body"), field="handler"))
        if self.at("finally"):
            s = self.here()
            self.take()
            kids.append(self.make("finally_clause", s, self.tag(self.block(), "body"), field="finalizer"))
        return self.make("try_statement", start, *kids)

    def s_switch(self, start: int) -> N:
        self.take()
        value = self.parenthesized("value")
        s = self.here()
        self.take("{")
        kids = []
        while not self.at("}"):
            c = self.here()
            if self.at("default"):
                self.take()
                self.take(":")
                kids.append(self.make("switch_default", c, *self.statements("case", "default", "}")))
            else:
                self.take("case")
                v = self.tag(self.expression(), "value")
                self.take(":")
                kids.append(self.make("switch_case", c, v, *self.statements("case", "default", "}")))
        self.take("}")
        return self.make("switch_statement", start, value, N("switch_body", s, self.last(), kids, "body"))

    def s_import(self, start: int) -> N:
        self.take()
        if self.at("type") and self.text(1) != "from" and self.text(1) != ",":
            self.take()
        kids = []
        if self.type() != "str":
            s = self.here()
            parts = []
            while True:
                if self.at("*"):
                    a = self.here()
                    self.take()
                    self.take("as")
                    parts.append(self.make("namespace_import", a, self.leaf("identifier")))
                elif self.at("{"):
                    a = self.here()
                    self.take()
                    parts.append(self.make("named_imports", a, *self.listed("}", lambda: self.specifier("import_specifier"))))
                else:
                    parts.append(self.leaf("identifier"))
                if not self.skip(","):
                    break
            kids.append(N("import_clause", s, self.last(), parts))
            self.take("from")
        kids.append(self.tag(self.string(), "source"))
        if self.at("with", "assert"):
            self.take()
            self.balanced()
        self.end()
        return self.make("import_statement", start, *kids)

    def specifier(self, kind: str) -> N:
        s = self.here()
        if self.at("type") and self.type(1) == "id" and self.text(1) != "as":
            self.take()
        name = self.string() if self.type() == "str" else self.leaf("identifier")
        alias = None
        if self.skip("as"):
            alias = self.string() if self.type() == "str" else self.leaf("identifier")
        return self.make(kind, s, self.tag(name, "name"), self.tag(alias, "alias") if alias else None)

    def s_export(self, start: int) -> N:
        self.take()
        kids: list[N | None] = []
        if self.skip("default"):
            if self.at("function", "class") or self.at("async") and self.text(1) == "function":
                n = self.tried(lambda: self.function("function_declaration" if self.text(1) not in ("(", "*") else "function_expression", self.here())) if self.at("function", "async") else self.class_("class_declaration" if self.type(1) == "id" and self.text(1) != "extends" else "class", self.here())
                if n is None:
                    raise Unread("export")
                kids.append(self.tag(n, "declaration" if n.kind.endswith("_declaration") else "value"))
            else:
                kids.append(self.tag(self.assign(), "value"))
                self.end()
        elif self.at("*"):
            s = self.here()
            self.take()
            if self.skip("as"):
                kids.append(self.make("namespace_export", s, self.leaf("identifier")))
            self.take("from")
            kids.append(self.tag(self.string(), "source"))
            self.end()
        elif self.at("{"):
            s = self.here()
            self.take()
            kids.append(self.make("export_clause", s, *self.listed("}", lambda: self.specifier("export_specifier"))))
            if self.skip("from"):
                kids.append(self.tag(self.string(), "source"))
            self.end()
        else:
            n = self.statement()
            kids.append(self.tag(n, "declaration") if n else None)
        return self.make("export_statement", start, *kids)
