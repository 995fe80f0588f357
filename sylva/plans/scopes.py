"""Scopes, references and data flow of JavaScript files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from sylva.plans.pattern import File, all_by_field, by_field, first_of_kind, named, of_kind
from sylva.sources.syntax import N

IMPORT, FUNCTION, VARIABLE, PARAMETER, CLASS = "import", "function", "variable", "parameter", "class"


@dataclass(eq=False)
class Variable:
    kind: str
    name: str
    decl: N
    refs: list[N] = field(default_factory=list)
    exported: bool = False


@dataclass(eq=False)
class Scope:
    upper: Scope | None = None
    node: N | None = None
    variables: dict[str, Variable] = field(default_factory=dict)
    children: list[Scope] = field(default_factory=list)

    def lookup(self, name: str) -> Variable | None:
        s: Scope | None = self
        while s is not None:
            if name in s.variables:
                return s.variables[name]
            s = s.upper
        return None


class Scopes:
    """The scope tree of a file: names are resolved as they are met, and what was unknown then at the end. For another
    language, a subclass says which kinds make scopes (SCOPES), what a node declares and which identifiers refer."""

    SCOPES = frozenset(["statement_block", "function_declaration", "function_expression", "for_statement", "for_in_statement", "for_of_statement", "program", "arrow_function", "class_body", "method_definition"])
    #: The kind at whose end what is unresolved is looked up again.
    WHOLE = "program"

    def __init__(self, f: File):
        self.f, self.root, self.of_pre, self.open = f, Scope(node=f.nodes[0]), {}, []
        stack: list[tuple[N, Scope, bool]] = [(f.nodes[0], self.root, False)]
        while stack:
            n, scope, done = stack.pop()
            if done:
                self.leave(n, scope)
                continue
            self.enter(n, scope)
            for v in self.declared(n):
                scope.variables[v.name] = v
            inner = scope
            if n.kind in self.SCOPES:
                inner = self.of_pre[n.pre] = Scope(scope, n)
                scope.children.append(inner)
            if n.kids:
                stack.append((n, scope, True))
                stack.extend([(k, inner, False) for k in reversed(n.kids) if k.named])
            else:
                self.leave(n, scope)

    def scope(self, n: N | None) -> Scope:
        while n is not None:
            if n.pre in self.of_pre:
                return self.of_pre[n.pre]
            n = n.up
        return self.root

    def bound(self, n: N | None, decl: N) -> Iterator[Variable]:
        """The names that a pattern binds."""
        if n is None:
            return
        if n.kind == "identifier":
            yield Variable(VARIABLE, self.f.text(n), decl)
        elif n.kind == "object_pattern":
            for k in of_kind(n, "shorthand_property_identifier_pattern"):
                yield Variable(VARIABLE, self.f.text(k), decl)
            for k in of_kind(n, "pair_pattern"):
                yield from self.bound(by_field(k, "value"), decl)
        elif n.kind == "array_pattern":
            for k in of_kind(n, "identifier", "object_pattern", "array_pattern"):
                yield from self.bound(k, decl)

    #: Kinds that declare something.
    DECLARING = frozenset(["variable_declarator", "assignment_expression", "function_declaration", "formal_parameters", "import_specifier", "import_clause", "class_declaration", "method_definition", "field_definition"])

    def declared(self, n: N) -> Iterator[Variable]:
        if n.kind not in self.DECLARING:
            return
        name, text = by_field(n, "name"), self.f.text
        if n.kind == "variable_declarator":
            yield from self.bound(name, n)
        elif n.kind == "assignment_expression":
            yield from self.bound(by_field(n, "left"), n)
        elif n.kind == "function_declaration" and name:
            yield Variable(FUNCTION, text(name), n)
        elif n.kind == "formal_parameters":
            for p in named(n):
                own = by_field(p, "left") if p.kind == "assignment_pattern" else p
                if own is not None and own.kind == "identifier":
                    yield Variable(PARAMETER, text(own), p)
        elif n.kind == "import_specifier" and name:
            yield Variable(IMPORT, text(by_field(n, "alias") or name), n)
        elif n.kind == "import_clause":
            own = first_of_kind(n, "identifier")
            if own:
                yield Variable(IMPORT, text(own), own)
        elif n.kind == "class_declaration" and name:
            yield Variable(CLASS, text(name), name)
        elif n.kind == "method_definition" and name:
            yield Variable(FUNCTION, text(name), name)
        elif n.kind == "field_definition" and by_field(n, "property"):
            own = by_field(n, "property")
            yield Variable(VARIABLE, text(own), own)

    def refers(self, n: N) -> bool:
        up = n.up
        if n.kind != "identifier" or up is None or up.kind in ("formal_parameters", "array_pattern", "import_clause", "import_specifier"):
            return False
        field_of = {"variable_declarator": "name", "assignment_pattern": "left", "pair_pattern": "key"}.get(up.kind)
        return field_of is None or n.field != field_of

    def enter(self, n: N, scope: Scope) -> None:
        if self.refers(n):
            v = scope.lookup(self.f.text(n))
            if v is None:
                self.open.append((n, scope))
            else:
                v.refs.append(n)

    def leave(self, n: N, scope: Scope) -> None:
        if n.kind == self.WHOLE:
            for ref, at in self.open:
                v = at.lookup(self.f.text(ref))
                if v is not None:
                    v.refs.append(ref)
        elif n.kind == "export_statement":
            names = [by_field(s, "name") for c in of_kind(n, "export_clause") for s in of_kind(c, "export_specifier")]
            d, value = by_field(n, "declaration"), by_field(n, "value")
            if d is not None and d.kind == "lexical_declaration":
                names += [x for x in (by_field(k, "name") for k in of_kind(d, "variable_declarator")) if x and x.kind == "identifier"]
            elif d is not None and d.kind in ("function_declaration", "class_declaration"):
                names.append(by_field(d, "name"))
            if value is not None and value.kind == "identifier":
                names.append(value)
            for x in names:
                v = scope.lookup(self.f.text(x)) if x is not None else None
                if v is not None:
                    v.exported = True

    def all(self) -> Iterator[tuple[Scope, Variable]]:
        """Every scope's variables, outer scopes first."""
        for pre in sorted(self.of_pre):
            for v in self.of_pre[pre].variables.values():
                yield self.of_pre[pre], v


@dataclass(eq=False)
class Function:
    node: N
    body: N | None
    parameters: list[Variable]
    scope: Scope


@dataclass(eq=False)
class Flow:
    node: N
    variable: Variable
    scope: Scope
    sources: list[Flow] = field(default_factory=list)
    function: Function | None = None


class DataFlow:
    """What values of variables are made of: identifiers, arguments of calls, terms of sums, parts of templates."""

    def __init__(self, f: File, scopes: Scopes | None = None):
        self.f, self.scopes = f, scopes or f.ask(Scopes)
        self.graph: dict[Variable, Flow] = {}
        self.functions: dict[str, Function] = {}
        self.classes: dict[Variable, tuple[list[Function], list[Variable]]] = {}
        for n in f.nodes:
            scope = self.scopes.scope(n)
            if n.kind in ("variable_declarator", "assignment_expression"):
                left, right = (by_field(n, x) for x in (("name", "value") if n.kind == "variable_declarator" else ("left", "right")))
                v = scope.lookup(f.text(left)) if left is not None and left.kind == "identifier" else None
                if v is not None and right is not None:
                    flow = Flow(left, v, scope)
                    for name in self.made_of(right):
                        source = self.graph.get(scope.lookup(f.text(name)))
                        if source is not None:
                            flow.sources.append(source)
                    if right.kind in ("function_expression", "arrow_function"):
                        flow.function = self.functions[v.name] = self.function(right)
                    self.graph[v] = flow
            elif n.kind == "function_declaration" and by_field(n, "name"):
                name = by_field(n, "name")
                v = scope.lookup(f.text(name))
                if v is not None:
                    fn = self.functions[v.name] = self.function(n)
                    self.graph[v] = Flow(name, v, scope, function=fn)
            elif n.kind == "class_declaration" and by_field(n, "name"):
                v = scope.lookup(f.text(by_field(n, "name")))
                body = by_field(n, "body")
                if v is not None and body is not None:
                    self.graph[v] = Flow(v.decl, v, scope)
                    inner = self.scopes.scope(body)
                    methods = [self.function(k) for k in of_kind(body, "method_definition")]
                    fields = [inner.variables[f.text(p)] for k in of_kind(body, "field_definition") for p in all_by_field(k, "property") if f.text(p) in inner.variables]
                    self.classes[v] = (methods, fields)

    def function(self, n: N) -> Function:
        scope = self.scopes.scope(n)
        return Function(n, by_field(n, "body"), [v for v in scope.variables.values() if v.kind == PARAMETER], scope)

    def made_of(self, n: N) -> Iterator[N]:
        if n.kind == "identifier":
            yield n
        elif n.kind == "call_expression":
            args = by_field(n, "arguments")
            yield from of_kind(args, "identifier") if args is not None else ()
        elif n.kind == "binary_expression":
            o = by_field(n, "operator")
            if o is not None and self.f.text(o) == "+":
                for side in (by_field(n, "left"), by_field(n, "right")):
                    if side is not None and side.kind in ("identifier", "binary_expression"):
                        yield from self.made_of(side)
        elif n.kind == "template_string":
            for k in of_kind(n, "template_substitution"):
                yield from (x for x in named(k)[:1] if x.kind == "identifier")
