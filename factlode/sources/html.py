"""HTML documents: title, headings, paragraphs, list items, tables and code; scripts, styles and hidden parts dropped."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

from . import blocks

_SKIPPED = {"script", "style", "noscript", "template"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_KINDS = {"title": "title", "p": "paragraph", "li": "list-item", "pre": "code", "tr": "table-row", "blockquote": "quote", "caption": "paragraph", "dt": "list-item", "dd": "list-item"}
_ENDS = {"div", "section", "article", "nav", "header", "footer", "main", "aside", "ul", "ol", "table", "body", "html", "br", "form"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Collects blocks; text outside any block element is a paragraph of its own."""

    def __init__(self, out: blocks.Builder) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.kind, self.level, self.parts, self.line = out, "", 0, [], 1
        self.hidden: list[str] = []
        self.dropped = 0

    def flush(self) -> None:
        raw = "".join(self.parts)
        body = raw.strip("\n") if self.kind == "code" else " ".join(raw.split())
        if body.strip():
            self.out.add(self.kind or "paragraph", body, self.line, self.getpos()[0], self.level)
        self.kind, self.level, self.parts = "", 0, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self.hidden:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if tag in _SKIPPED or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", ""):
            self.dropped += 1
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if tag in ("td", "th"):
            if self.parts:
                self.parts.append(" | ")
            return
        if tag in _KINDS or tag in _HEADINGS or tag in _ENDS:
            self.flush()
            self.kind, self.level, self.line = ("heading" if tag in _HEADINGS else _KINDS.get(tag, "")), _HEADINGS.get(tag, 0), self.getpos()[0]

    def handle_endtag(self, tag):
        if self.hidden:
            # an end tag closes up to its own start, so an unclosed child can't hide the rest
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag in _KINDS or tag in _HEADINGS or tag in _ENDS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def read(text: str, out: blocks.Builder) -> None:
    """Blocks of one page."""
    reader = _Reader(out)
    reader.feed(text)
    reader.close()
    reader.flush()
    if reader.dropped:
        out.warn(f"dropped {reader.dropped} hidden or script elements")


def parse(files: DataFrame) -> DataFrame:
    """Blocks of pages (path, text)."""
    return blocks.run(files, read, "html")
