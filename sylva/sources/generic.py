"""A front end for languages without one of their own: comments, strings, numbers, identifiers and what stands in brackets.

Its kinds are comment, string, number, identifier, parenthesized, block and list, under source_file; operators
are nodes without a name. That is enough for suppression comments, pragmas and patterns over words, no grammar.
"""

from __future__ import annotations

import re

from sylva.sources.syntax import N

_SLASHES, _BLOCK, _HASH, _DASHES = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)", r"#[^\n]*", r"--[^\n]*"
_COMMENTS = {
    "css": [_BLOCK],
    "sql": [_DASHES, _BLOCK],
    "kotlin": [_SLASHES, _BLOCK],
    "ocaml": [r"\(\*[\s\S]*?(?:\*\)|\Z)"],
    "lua": [r"--\[\[[\s\S]*?(?:\]\]|\Z)", _DASHES],
    "bash": [r"(?<![\w$\\{])#[^\n]*"],
    "csharp": [_SLASHES, _BLOCK],
    "elixir": [_HASH],
    "elm": [r"\{-[\s\S]*?(?:-\}|\Z)", _DASHES],
    "groovy": [_SLASHES, _BLOCK],
    "hcl": [_HASH, _SLASHES, _BLOCK],
    "scala": [_SLASHES, _BLOCK],
    "swift": [_SLASHES, _BLOCK],
}
LANGUAGES = tuple(_COMMENTS)
_QUOTED = r'"""[\s\S]*?(?:"""|\Z)|"(?:\\[\s\S]|[^"\\])*"?'
_SINGLE = {"css", "sql", "lua", "bash", "elixir", "groovy"}
_GROUPS = {"(": (")", "parenthesized"), "{": ("}", "block"), "[": ("]", "list")}


class Generic:
    def __init__(self, lang: str, src: str):
        strings = _QUOTED + (r"|'(?:\\[\s\S]|[^'\\])*'?" if lang in _SINGLE else r"|'(?:\\[^\n]|[^'\\\n])'")
        self.src = src
        self.lex = re.compile(rf"(?P<comment>{'|'.join(_COMMENTS[lang])})|(?P<string>{strings})|(?P<number>[0-9][\w.]*)|(?P<identifier>[A-Za-z_$@\x80-\xff][\w\x80-\xff-]*)|(?P<open>[({{\[])|(?P<close>[)}}\]])|(?P<op>[^\s\w])")

    def parse(self) -> N:
        root = N("source_file", 0, len(self.src))
        stack: list[tuple[N, str]] = [(root, "")]
        for m in self.lex.finditer(self.src):
            kind, text, top = m.lastgroup, m[0], stack[-1][0]
            if kind == "open":
                n = N(_GROUPS[text][1], m.start(), m.end())
                top.kids.append(n)
                stack.append((n, _GROUPS[text][0]))
            elif kind == "close":
                if any(c == text for _, c in stack):
                    while stack[-1][1] != text:
                        stack.pop()[0].end = m.start()
                    stack.pop()[0].end = m.end()
                else:
                    top.kids.append(N("ERROR", m.start(), m.end()))
            elif kind == "op":
                top.kids.append(N(text, m.start(), m.end(), named=False))
            else:
                top.kids.append(N(kind, m.start(), m.end()))
        while len(stack) > 1:
            stack.pop()[0].end = len(self.src)
        return root
