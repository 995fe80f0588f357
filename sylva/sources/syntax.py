"""What the front ends share: tree nodes, tokens, operator-precedence parsing and rows.

Sources are read as bytes, one character each, so that all offsets are byte offsets. A parser never
fails: what it can't read becomes an ERROR node, and it goes on after it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator


class N:
    """A node of a syntax tree; offsets are bytes."""

    __slots__ = ("kind", "start", "end", "kids", "field", "named", "up", "pre", "stop", "nth", "place")

    def __init__(self, kind: str, start: int, end: int, kids: list[N] | None = None, field: str | None = None, named: bool = True):
        self.kind, self.start, self.end, self.kids, self.field, self.named = kind, start, end, kids or [], field, named
        self.up: N | None = None

    def __repr__(self) -> str:
        return f"({self.kind}{''.join(f' {k.field}: {k!r}' if k.field else f' {k!r}' for k in self.kids if k.named)})"

    def walk(self) -> Iterator[N]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))


class Unread(Exception):
    pass


class Parser:
    """Tokens are (type, start, end, whether a line break is before); a subclass says how they are read."""

    LEX: re.Pattern
    COMMENT = "comment"
    ROOT = "program"
    #: operator -> precedence; RIGHT: those that group to the right.
    BINARY: dict[str, int] = {}
    RIGHT: frozenset[str] = frozenset()
    BINARY_KIND = "binary_expression"
    #: Types of tokens that token() would only append; a subclass with a token() of its own may name them.
    WHOLE: frozenset[str] = frozenset()

    def __init__(self, src: str, start: int = 0, end: int | None = None):
        self.src, self.stop = src, len(src) if end is None else end
        self.start = start
        self.comments: list[N] = []
        self.toks: list[tuple[str, int, int, bool]] = []
        self.lex()
        self.toks.append(("eof", self.stop, self.stop, True))
        self.i = 0
        self.depth = 0

    def lex(self) -> None:
        broke, at, stop = True, self.start, self.stop
        match, src, token, push = self.LEX.match, self.src, self.token, self.toks.append
        plain = type(self).token is Parser.token or self.WHOLE
        while at < stop:
            m = match(src, at, stop)
            if not m or m.end() == at:
                at += 1
                continue
            kind, end = m.lastgroup, m.end()
            if kind == "ws":
                at = end
            elif kind == "nl":
                broke, at = True, end
            elif kind == "comment":
                self.comments.append(N(self.COMMENT, at, end))
                broke = broke or "\n" in m.group()
                at = end
            else:
                if plain is True or plain and kind in plain:
                    push((kind, at, end, broke))
                    at = end
                else:
                    at = token(kind, at, end, broke)
                broke = False

    def token(self, kind: str, start: int, end: int, broke: bool) -> int:
        self.toks.append((kind, start, end, broke))
        return end

    # looking and taking
    def text(self, k: int = 0) -> str:
        i = self.i + k
        t = self.toks[i] if i < len(self.toks) else self.toks[-1]
        return self.src[t[1] : t[2]]

    def type(self, k: int = 0) -> str:
        i = self.i + k
        return (self.toks[i] if i < len(self.toks) else self.toks[-1])[0]

    def at(self, *texts: str) -> bool:
        kind, start, end, _ = self.toks[self.i] if self.i < len(self.toks) else self.toks[-1]
        return kind != "str" and kind != "eof" and self.src[start:end] in texts

    def here(self) -> int:
        return self.toks[self.i][1]

    def last(self) -> int:
        return self.toks[self.i - 1][2] if self.i else self.start

    def broke(self) -> bool:
        return self.toks[self.i][3]

    def eof(self) -> bool:
        return self.i >= len(self.toks) - 1

    def take(self, text: str | None = None) -> tuple[str, int, int, bool]:
        if self.eof() or text is not None and self.text() != text:
            raise Unread(f"{text} at {self.here()}")
        self.i += 1
        return self.toks[self.i - 1]

    def skip(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def leaf(self, kind: str, field: str | None = None) -> N:
        t = self.take()
        return N(kind, t[1], t[2], field=field)

    def operator(self) -> N:
        t = self.take()
        return N(self.src[t[1] : t[2]], t[1], t[2], field="operator", named=False)

    def make(self, kind: str, start: int, *kids: N | None, field: str | None = None) -> N:
        return N(kind, start, self.last(), [k for k in kids if k is not None], field)

    @staticmethod
    def tag(n: N, field: str) -> N:
        n.field = field
        return n

    def tried(self, f: Callable[[], N]) -> N | None:
        i = self.i
        try:
            return f()
        except Unread:
            self.i = i
            return None

    def inner(self, start: int, end: int, f: str = "expression") -> list[N]:
        """An expression within a string."""
        sub = type(self)(self.src, start, end)
        out = []
        while not sub.eof():
            i = sub.i
            n = sub.tried(getattr(sub, f))
            if n:
                out.append(n)
            if sub.i == i or n is None:
                sub.i += 1
        return out

    # expressions
    def expression(self) -> N:
        return self.binary(0)

    def unary(self) -> N:
        raise NotImplementedError

    def infix(self) -> str:
        return self.text() if self.type() in ("op", "id") else ""

    def binary(self, least: int) -> N:
        self.depth += 1
        if self.depth > 150:
            self.depth = 0
            raise Unread("too deep")
        left = self.unary()
        while (op := self.infix()) in self.BINARY and self.BINARY[op] >= least and self.BINARY[op]:
            p = self.BINARY[op]
            o = self.operator()
            right = self.binary(p if op in self.RIGHT else p + 1)
            left = self.joined(left, o, right)
        self.depth -= 1
        return left

    def joined(self, left: N, o: N, right: N) -> N:
        return N(self.BINARY_KIND, left.start, right.end, [self.tag(left, "left"), o, self.tag(right, "right")])

    def listed(self, close: str, item: Callable[[], N | None], sep: str = ",") -> list[N]:
        """Items up to and with the closing token."""
        out = []
        while not self.at(close):
            if self.eof():
                raise Unread(close)
            if self.skip(sep):
                continue
            n = item()
            if n is not None:
                out.append(n)
            if not self.at(close) and not self.skip(sep):
                raise Unread(close)
        self.take(close)
        return out

    # statements
    def statement(self) -> N | None:
        raise NotImplementedError

    def recover(self, start: int) -> N:
        """Skips to the end of the line, over brackets that open in it."""
        depth = 0
        first = True
        while not self.eof():
            if not first and depth <= 0 and (self.broke() or self.at("}", ";")):
                break
            t = self.text() if self.type() != "str" else ""
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            self.i += 1
            first = False
        return N("ERROR", start, self.last())

    def statements(self, *close: str) -> list[N]:
        out = []
        while not self.eof() and not self.at(*close):
            i, start = self.i, self.here()
            self.depth = 0
            try:
                n = self.statement()
            except (Unread, RecursionError):
                self.i = i
                n = self.recover(start)
            if n is not None:
                out.append(n)
            if self.i == i:
                self.i += 1
        return out

    def parse(self) -> N:
        root = N(self.ROOT, 0, len(self.src), [])
        while not self.eof():
            root.kids += self.statements()
            if not self.eof():  # a stray closing bracket
                self.i += 1
        place_comments(root, self.comments)
        return root


def place_comments(root: N, comments: list[N]) -> None:
    """Each into the innermost inner node that spans it, in order."""
    for c in comments:
        n = root
        while True:
            starts = [k.start for k in n.kids]
            i = bisect.bisect_right(starts, c.start) - 1
            if i >= 0 and n.kids[i].end >= c.end and n.kids[i].start < c.start:
                n = n.kids[i]
                continue
            n.kids.insert(i + 1, c)
            break


def link(root: N) -> list[N]:
    """Sets up, pre, stop, nth and place on all nodes; gives them in preorder."""
    out: list[N] = []
    root.place, root.nth, root.up = 0, 0, None
    stack = [root]
    while stack:
        n = stack.pop()
        n.pre = n.stop = len(out)
        out.append(n)
        kids = n.kids
        if kids:
            named = i = 0
            for k in kids:
                k.up, k.place, k.nth = n, i, named
                named += k.named
                i += 1
            stack.extend(reversed(kids))
    for n in reversed(out):
        if n.kids:
            n.stop = n.kids[-1].stop
    return out


class Lines:
    """Rows and byte columns of offsets."""

    def __init__(self, src: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", src))]

    def at(self, offset: int) -> tuple[int, int]:
        row = bisect.bisect_right(self.starts, offset) - 1
        return row, offset - self.starts[row]


def rows(root: N, src: str) -> list[tuple]:
    """Node rows without the file: node_id, parent_id, kind, is_named, field, child_ix, named_ix, n_named, depth, pre, subtree_end, start_byte, end_byte, start_row, start_col, end_row, end_col."""
    nodes, lines, out, depth = link(root), Lines(src), [], {}
    for n in nodes:
        d = depth[n.pre] = depth[n.up.pre] + 1 if n.up else 0
        named = sum(k.named for k in n.kids)
        out.append((n.pre, n.up.pre if n.up else None, n.kind, n.named, n.field, n.place, n.nth, named, d, n.pre, n.stop, n.start, n.end, *lines.at(n.start), *lines.at(n.end)))
    return out
