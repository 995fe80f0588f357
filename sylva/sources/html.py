"""HTML front end."""

from __future__ import annotations

import re

from sylva.sources.syntax import N

_TOKEN = re.compile(rb"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(rb"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_VOID = {b"area", b"base", b"br", b"col", b"embed", b"hr", b"img", b"input", b"link", b"meta", b"source", b"track", b"wbr"}
_CLOSES = {b"p": {b"p"}, b"li": {b"li"}, b"td": {b"td", b"th"}, b"th": {b"td", b"th"}, b"tr": {b"tr", b"td", b"th"}, b"option": {b"option"}}


class Html:
    """Bytes that don't form markup are text; what isn't closed ends with its parent."""

    def __init__(self, src: str):
        self.data = src.encode("latin-1")

    def parse(self) -> N:
        data = self.data
        root = N("document", 0, len(data))
        open_: list[tuple[N, bytes]] = [(root, b"")]

        def add(parent: N, kind: str, start: int, end: int) -> N:
            n = N(kind, start, end)
            parent.kids.append(n)
            return n

        def close(end: int) -> None:
            open_.pop()[0].end = end

        at = 0
        while at < len(data):
            m = _TOKEN.match(data, at)
            lo, hi = m.span()
            raw, top = m.group(), open_[-1][0]
            if raw.startswith(b"<!--"):
                add(top, "comment", lo, hi)
            elif raw.startswith(b"<!"):
                add(top, "doctype", lo, hi)
            elif m.group(2) is None:
                if raw.strip():
                    add(top, "text", lo, hi)
            elif m.group(1):
                name = m.group(2).lower()
                if any(n == name for _, n in open_[1:]):
                    while open_[-1][1] != name:
                        close(lo)
                    tag = add(open_[-1][0], "end_tag", lo, hi)
                    add(tag, "tag_name", m.start(2), m.end(2))
                    close(hi)
                else:
                    add(top, "erroneous_end_tag", lo, hi)
            else:
                name = m.group(2).lower()
                while len(open_) > 1 and open_[-1][1] in _CLOSES.get(name, ()):
                    close(lo)
                kind = {b"script": "script_element", b"style": "style_element"}.get(name, "element")
                me = add(open_[-1][0], kind, lo, hi)
                alone = raw.endswith(b"/>")
                tag = add(me, "self_closing_tag" if alone else "start_tag", lo, hi)
                add(tag, "tag_name", m.start(2), m.end(2))
                for a in _ATTRIBUTE.finditer(m.group(3)):
                    base = m.start(3)
                    attribute = add(tag, "attribute", base + a.start(), base + a.end())
                    add(attribute, "attribute_name", base + a.start(1), base + a.end(1))
                    if a.group(2) is not None:
                        quoted = a.group(2)[:1] in b"\"'"
                        value = add(attribute, "quoted_attribute_value", base + a.start(2), base + a.end(2)) if quoted else attribute
                        add(value, "attribute_value", base + a.start(2) + quoted, base + a.end(2) - quoted)
                if not alone and name not in _VOID:
                    open_.append((me, name))
                    if kind != "element":
                        stop = re.compile(rb"</" + name, re.I).search(data, hi)
                        end = stop.start() if stop else len(data)
                        if end > hi:
                            add(me, "raw_text", hi, end)
                        hi = end
            at = hi
        while len(open_) > 1:
            close(len(data))
        return root
