"""Text of PDF files: plain and deflated page streams; what can't be read is said, not guessed."""

from __future__ import annotations

import re
import zlib

from . import blocks

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|T\*|Td|TD|Tj|TJ|'|\"|ET", re.S)
#: Bytes that one stream may unpack to.
MAX_STREAM = 50 << 20
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return data.decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")

    def escaped(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _ESCAPES.get(c, b"" if c == b"\n" else c)

    return re.sub(rb"\\([0-7]{1,3}|.)", escaped, token[1:-1], flags=re.S).decode("latin-1")


def page_text(stream: bytes) -> str:
    """What the text operators of a content stream show, a line for each move."""
    lines, shown, held = [], "", []
    for m in _SHOWN.finditer(stream):
        token = m[0]
        if token[:1] in b"(<":
            held.append(_literal(token))
        elif token in (b"Tj", b"TJ"):
            shown, held = shown + "".join(held), []
        else:
            lines.append(shown)
            shown, held = ("".join(held), []) if token in (b"'", b'"') else ("", [])
    return "\n".join(x for x in [*lines, shown] if x.strip())


def read(data: bytes, out: blocks.Builder) -> None:
    """A block for each content stream with text; encrypted files and files without text have a status of their own."""
    if b"/Encrypt" in data:
        out.status = "encrypted"
        out.warn("encrypted")
        return
    page = 0
    for head, body in _STREAM.findall(data):
        if b"/Image" in head or b"/XRef" in head or b"/ObjStm" in head or b"/FontFile" in head:
            continue
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body, MAX_STREAM)
            except zlib.error:
                out.warn("a stream can't be unpacked", partial=True)
                continue
        if b"BT" in body and (text := page_text(body)):
            page += 1
            out.add("page", text, locator=f"page:{page}")
    if not page and out.status == "parsed":
        out.status = "needs-ocr"
        out.warn("no text on any page")
