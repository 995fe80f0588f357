"""Tree patterns: their grammar, and their matches within one file.

A pattern is an S-expression: (kind field: (child) @capture), alternations in brackets,
groups of siblings, wildcards, anchors, quantifiers and predicates (#eq? @a "x"). Files are
matched one by one where they were parsed, so no join and no shuffle is needed: roots come from an
index of the file's nodes by kind, and only what hangs below them is looked at.
"""

from __future__ import annotations

import dataclasses
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from sylva.sources.frontends import text_of
from sylva.sources.syntax import N, link

_LEX = re.compile(r';[^\n]*|"(?:\\.|[^"\\])*"|[()\[\]]|#[\w.-]+[?!]|@[\w.-]+|[\w.-]+:|[*?+]|\.(?=[\s()\["])|[\w-]+|\S')


class PatternSyntaxError(ValueError):
    pass


@dataclass
class Node:
    """kind: None for the wildcard, a list of Nodes for an alternation, "" for a group of siblings. test: what
    the node's text must match, unless: what it mustn't."""

    kind: str | None | list[Node] = None
    named: bool = True
    field: str | None = None
    captures: list[str] = dataclasses.field(default_factory=list)
    children: list[Node] = dataclasses.field(default_factory=list)
    anchored: bool = False
    last: bool = False
    quantifier: str = ""
    test: re.Pattern | None = None
    unless: re.Pattern | None = None

    def bound(self) -> bool:
        """Whether it or what is below captures or tests anything."""
        below = [*self.children, *(self.kind if isinstance(self.kind, list) else [])]
        return bool(self.captures or self.test or self.unless or any(c.bound() for c in below))


@dataclass
class Pattern:
    root: Node
    predicates: list[tuple[str, list[str]]]


def parse(text: str) -> list[Pattern]:
    """The top-level patterns of a text."""
    tokens = [t for t in _LEX.findall(text) if not t.startswith(";")]
    at, out = 0, []

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or want and tokens[at] != want:
            raise PatternSyntaxError(f"expected {want or 'more'} at token {at} of {text!r}")
        at += 1
        return tokens[at - 1]

    def suffixes(n: Node) -> Node:
        while peek()[:1] == "@" or peek() in ("*", "?", "+"):
            t = take()
            if t[0] == "@":
                n.captures.append(t[1:])
            else:
                n.quantifier = t
        return n

    def predicate(predicates: list) -> bool:
        if not (peek() == "(" and tokens[at + 1 : at + 2] and tokens[at + 1][:1] == "#"):
            return False
        take()
        name, args = take(), []
        while peek() != ")":
            args.append(take())
        take(")")
        if not args:
            raise PatternSyntaxError(f"{name} lacks arguments in {text!r}")
        if name in ("#match?", "#not-match?"):
            try:
                re.compile(_string(args[1]))
            except (re.error, IndexError) as e:
                raise PatternSyntaxError(f"{name}: {e}") from e
        predicates.append((name, args))
        return True

    def members(n: Node, close: str, predicates: list) -> None:
        pending = False
        while peek() != close:
            if predicate(predicates):
                continue
            if peek() == ".":
                take()
                pending = True
                continue
            label = take()[:-1] if peek().endswith(":") and peek()[0] != '"' else None
            child = node(predicates)
            child.field, child.anchored, pending = label, pending, False
            n.children.append(child)
        if pending and n.children:
            n.children[-1].last = True
        take(close)

    def node(predicates: list) -> Node:
        t = take()
        if t == "[":
            n = Node([])
            while peek() != "]":
                if not predicate(predicates):
                    label = take()[:-1] if peek().endswith(":") and peek()[0] != '"' else None
                    n.kind.append(node(predicates))
                    n.kind[-1].field = label
            take("]")
        elif t == "(":
            n = Node(take() if peek()[:1] not in ("(", "[", ")", '"', "#") and not peek().endswith(":") else "")
            if n.kind == "_":
                n.kind = None
            members(n, ")", predicates)
            if n.kind == "":
                if not n.children:
                    raise PatternSyntaxError(f"an empty group in {text!r}")
                if len(n.children) == 1:
                    inner = n.children[0]
                    n = suffixes(n)
                    inner.captures += n.captures
                    inner.quantifier = inner.quantifier or n.quantifier
                    return inner
        elif t[0] == '"':
            n = Node(_string(t), named=False)
        elif t == "_":
            n = Node(None, named=False)
        else:
            raise PatternSyntaxError(f"unexpected {t!r} in {text!r}")
        return suffixes(n)

    while at < len(tokens):
        predicates: list = []
        root = node(predicates)
        while predicate(predicates):
            pass
        out.append(Pattern(root, predicates))
    if not out:
        raise PatternSyntaxError("an empty pattern")
    return out


def _string(x: str) -> str:
    if x[:1] != '"':
        return x
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), x[1:-1])


Binding = list[tuple[str, N]]


class File:
    """A parsed file, indexed by kind."""

    def __init__(self, root: N, src: str):
        self.src, self.nodes = src, link(root)
        self.by_kind: dict[str, list[N]] = defaultdict(list)
        for n in self.nodes:
            self.by_kind[n.kind].append(n)
        self._asked: dict = {}

    def ask(self, make):
        """make(file), made once for all checkers that ask for it."""
        if make not in self._asked:
            self._asked[make] = make(self)
        return self._asked[make]

    def text(self, n: N) -> str:
        return text_of(self.src, n.start, n.end)

    def fits(self, p: Node, n: N) -> bool:
        if p.kind is None:
            ok = n.named or not p.named
        else:
            ok = n.kind == p.kind and n.named == p.named
        return ok and (p.test is None or p.test.search(self.text(n)) is not None) and (p.unless is None or p.unless.search(self.text(n)) is None)

    def match(self, p: Node, n: N) -> Iterator[Binding]:
        """The ways in which a pattern's node fits this one."""
        mine = [(c, n) for c in p.captures]
        if isinstance(p.kind, list):
            for alternative in p.kind:
                if alternative.field is None or alternative.field == n.field:
                    for b in self.match(alternative, n):
                        yield b + mine
            return
        if p.kind == "":
            for b in self.siblings(p, n):
                yield b
            return
        if not self.fits(p, n):
            return
        for b in self.series(p.children, 0, n.kids, 0, None):
            yield mine + b

    def series(self, pats: list[Node], k: int, kids: list[N], start: int, before: N | None) -> Iterator[Binding]:
        """The ways in which the patterns from the k-th on fit children from `start` on, in order."""
        if k == len(pats):
            yield []
            return
        p = pats[k]
        some = False
        if p.quantifier in ("*", "?") and not p.bound() and not p.last:
            yield from self.series(pats, k + 1, kids, start, before if not p.anchored else None)
            return
        if p.quantifier in ("*", "+") and p.bound() and not p.children and not isinstance(p.kind, list):
            run = [i for i in range(start, len(kids)) if (p.field is None or kids[i].field == p.field) and self.fits(p, kids[i])]
            if run:
                some = True
                held = [(c, kids[i]) for i in run for c in p.captures]
                for b in self.series(pats, k + 1, kids, run[-1] + 1, kids[run[-1]]):
                    yield held + b
        else:
            for i in range(start, len(kids)):
                n = kids[i]
                if p.field is not None and n.field != p.field:
                    continue
                if p.anchored and n.nth != (0 if before is None and k == 0 else before.nth + 1 if before is not None else n.nth):
                    continue
                if p.last and any(x.named for x in kids[i + 1 :]):
                    continue
                if p.kind == "":
                    for b in self.series(p.children, 0, kids, i, None):
                        some = True
                        for rest in self.series(pats, k + 1, kids, i + 1, n):
                            yield b + rest
                    continue
                rest_of: list[Binding] | None = None
                for b in self.match(p, n):
                    if rest_of is None:
                        rest_of = list(self.series(pats, k + 1, kids, i + 1, n))
                    for rest in rest_of:
                        some = True
                        yield b + rest
        if not some and p.quantifier in ("*", "?"):
            yield from self.series(pats, k + 1, kids, start, before)

    def roots(self, p: Node) -> Iterator[N]:
        if isinstance(p.kind, list):
            seen = set()
            for alternative in p.kind:
                for n in self.roots(alternative):
                    if n.pre not in seen:
                        seen.add(n.pre)
                        yield n
        elif p.kind is None:
            yield from self.nodes
        elif p.kind == "":
            yield from self.roots(p.children[0])
        else:
            yield from self.by_kind.get(p.kind, ())

    def matches(self, pattern: Pattern) -> Iterator[Binding]:
        """Matches in order of their first node; those of equal captures count once."""
        root = pattern.root
        for n in self.roots(root):
            seen = set()
            for b in self.match(root, n):
                key = tuple((c, x.pre) for c, x in b)
                if key not in seen:
                    seen.add(key)
                    if all(self.holds(name, args, b) for name, args in pattern.predicates):
                        yield b

    def siblings(self, group: Node, n: N) -> Iterator[Binding]:
        """A group that begins at n; its captures go to its first node."""
        kids = n.up.kids if n.up is not None else [n]
        first, rest = group.children[0], group.children[1:]
        for b in self.match(first, n):
            for more in self.series(rest, 0, kids, n.place + 1, n):
                yield [(c, n) for c in group.captures] + b + more

    def holds(self, name: str, args: list[str], b: Binding) -> bool:
        """A predicate on what isn't bound holds; unknown predicates hold."""
        texts = [self.text(n) for c, n in b if c == args[0][1:]] if args[0][:1] == "@" else [_string(args[0])]
        negated = name.startswith("#not-")
        if name in ("#eq?", "#not-eq?"):
            if args[1][:1] == "@":
                other = [self.text(n) for c, n in b if c == args[1][1:]]
                return not texts or not other or (texts[-1] == other[-1]) != negated
            want = _string(args[1])
            return all((t == want) != negated for t in texts)
        if name in ("#match?", "#not-match?"):
            regex = re.compile(_string(args[1]))
            return all((regex.search(t) is not None) != negated for t in texts)
        if name in ("#any-of?", "#not-any-of?"):
            some = {_string(a) for a in args[1:]}
            return all((t in some) != negated for t in texts)
        return True


# navigation
def ancestors(n: N) -> Iterator[N]:
    while n.up is not None:
        n = n.up
        yield n


def descendants(n: N, kind: str) -> Iterator[N]:
    return (x for x in n.walk() if x.kind == kind and x is not n)


def of_kind(n: N, *kinds: str) -> list[N]:
    return [k for k in n.kids if k.kind in kinds]


def first_of_kind(n: N, *kinds: str) -> N | None:
    return next((k for k in n.kids if k.kind in kinds), None)


def first_where(n: N, test) -> N | None:
    return next((k for k in n.kids if test(k)), None)


def by_field(n: N, name: str) -> N | None:
    for k in n.kids:
        if k.field == name:
            return k
    return None


def all_by_field(n: N, name: str) -> list[N]:
    return [k for k in n.kids if k.field == name]


def named(n: N) -> list[N]:
    return [k for k in n.kids if k.named]


def nth_named(n: N, i: int) -> N | None:
    kids = named(n)
    return kids[i] if 0 <= i < len(kids) else None


def previous(n: N) -> N | None:
    return n.up.kids[n.place - 1] if n.up is not None and n.place else None


def visit(root: N, enter, leave=None) -> None:
    """Named nodes in order; enter may return False to leave out what is below."""
    stack = [(root, False)]
    while stack:
        n, done = stack.pop()
        if done:
            if leave:
                leave(n)
            continue
        below = enter(n) is not False
        stack.append((n, True))
        if below:
            stack.extend((k, False) for k in reversed(n.kids) if k.named)
