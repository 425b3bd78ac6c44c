"""Documents: media types, parsers for text formats and office archives, and their dispatch."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, html, pdf

# Parsers by priority (the least wins) with the media types that they claim.
PRIORITIES = {"pdf": 10, "docx": 11, "xlsx": 12, "openapi": 20, "json-schema": 21, "sql": 30, "csv": 40, "html": 50, "markdown": 60, "text": 90}
MEDIA = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".rst": "text/x-rst", ".adoc": "text/asciidoc", ".asciidoc": "text/asciidoc",
    ".txt": "text/plain", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".html": "text/html", ".htm": "text/html",
    ".json": "application/json", ".yaml": "application/yaml", ".yml": "application/yaml", ".sql": "application/sql",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
#: Archive limits: members, bytes of one member unpacked, and unpacked over packed.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_RATIO = 2000, 50 << 20, 200
MAX_ROWS = 50_000


def media_type(content: Column, path: Column) -> Column:
    """Media type by the first bytes, for text by the extension."""
    head = F.substring(content, 1, 8)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    start = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    by_ext = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv]), ext), F.lit("text/plain"))
    return (
        F.when(F.hex(head).startswith("25504446"), "application/pdf")
        .when(F.hex(head).startswith("504B0304"), F.when(ext.isin(".docx", ".xlsx"), by_ext).otherwise("application/zip"))
        .when(F.hex(head).startswith("D0CF11E0A1B11AE1"), "application/x-ole-storage")
        .when(F.locate("\x00", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0, "application/octet-stream")
        .when(start.rlike(r"(?is)^\s*(<!doctype html|<html)"), "text/html")
        .when(start.rlike(r"(?s)^\s*[\[{]") & ~ext.isin(".md", ".txt", ".csv", ".sql"), "application/json")
        .otherwise(by_ext)
    )


def read_markdown(text: str, out: blocks.Builder) -> None:
    """Headings, paragraphs, list items, fenced code, tables and quotes."""
    lines, held, kind, start, fence = text.split("\n"), [], "", 0, ""

    def flush(end: int) -> None:
        nonlocal held, kind
        if held and "\n".join(held).strip():
            out.add(kind or "paragraph", "\n".join(held).strip("\n"), start, end)
        held, kind = [], ""

    for n, line in enumerate([x.rstrip("\r") for x in lines], 1):
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                flush(n)
                fence = ""
            else:
                held.append(line)
            continue
        opened = re.match(r"^ {0,3}(```+|~~~+)", line)
        heading = re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        underline = re.match(r"^ {0,3}(=+|-+)\s*$", line)
        if opened:
            flush(n - 1)
            fence, kind, start = opened[1], "code", n
        elif heading:
            flush(n - 1)
            out.add("heading", heading[2], n, n, len(heading[1]))
        elif underline and kind == "paragraph" and len(held) == 1:
            title, held, kind = held[0].strip(), [], ""
            out.add("heading", title, n - 1, n, 1 if underline[1][0] == "=" else 2)
        elif not line.strip():
            flush(n - 1)
        else:
            now = "quote" if line.lstrip().startswith(">") else "table" if line.lstrip().startswith("|") else "list-item" if re.match(r"^\s*([-*+]|\d+[.)])\s+", line) else "paragraph"
            if now == "paragraph" and kind in ("list-item", "quote"):
                now = kind
            elif now != kind or now == "list-item":
                flush(n - 1)
                start = n
            kind = now
            held.append(re.sub(r"^\s*>\s?", "", line) if now == "quote" else re.sub(r"^\s*([-*+]|\d+[.)])\s+", "", line) if now == "list-item" else line)
    if fence:
        out.warn("a code fence isn't closed")
    flush(len(lines))


def read_text(text: str, out: blocks.Builder) -> None:
    """Underlined and '='-marked headings, list items, indented blocks and paragraphs."""
    lines, held, kind, start = text.split("\n"), [], "", 0

    def flush(end: int) -> None:
        nonlocal held, kind
        if "".join(held).strip():
            out.add(kind, "\n".join(held).strip("\n"), start, end)
        held, kind = [], ""

    skip = False
    marks: dict[str, int] = {}
    for n, line in enumerate([x.rstrip("\r") for x in lines], 1):
        following = lines[n].rstrip("\r") if n < len(lines) else ""
        marked = re.match(r"^(=+)\s+(\S.*)$", line)
        if skip:
            skip = False
        elif marked:
            flush(n - 1)
            out.add("heading", marked[2].strip(), n, n, min(6, len(marked[1])))
        elif line.strip() and re.fullmatch(r"([=\-~^\"'*+#])\1{2,}", following.strip()) and len(following.strip()) >= len(line.strip()) - 1 and not line.startswith(" "):
            flush(n - 1)
            level = marks.setdefault(following.strip()[0], min(6, len(marks) + 1))
            out.add("heading", line.strip(), n, n + 1, level)
            skip = True
        elif not line.strip():
            flush(n - 1)
        else:
            now = "list-item" if re.match(r"^\s*([-*+]|\d+[.)])\s+", line) else "code" if line.startswith(("    ", "\t")) and kind in ("", "code") else "paragraph"
            if now == "paragraph" and kind == "list-item":
                now = kind
            elif now != kind or now == "list-item":
                flush(n - 1)
                start = n
            kind = now
            held.append(re.sub(r"^\s*([-*+]|\d+[.)])\s+", "", line) if now == "list-item" else line)
    flush(len(lines))


def _numeric(value: str) -> bool:
    try:
        float(value.strip().replace(",", "").replace("%", ""))
    except ValueError:
        return False
    return True


def read_csv(text: str, out: blocks.Builder, fallback: str = ",") -> None:
    """A table block with the headers, and a block for each row, 'header: value; ...'."""
    try:
        delimiter = csv.Sniffer().sniff(text[:65536], delimiters=",;\t|").delimiter if text.strip() else fallback
    except csv.Error:
        delimiter = fallback
        out.warn("the dialect could not be detected")
    rows = []
    try:
        for n, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
            if len(rows) >= MAX_ROWS:
                out.warn(f"more than {MAX_ROWS} rows", partial=True)
                break
            if any(c.strip() for c in cells):
                rows.append((n, cells))
    except csv.Error as e:
        out.warn(f"malformed: {e}", partial=True)
    if not rows:
        return
    first = rows[0][1]
    named = all(c.strip() for c in first) and not any(_numeric(c) for c in first)
    heads = [c.strip() for c in first] if named else [f"col{i + 1}" for i in range(len(first))]
    out.add("table", " | ".join(heads), locator="A1")
    for n, cells in rows[1:] if named else rows:
        pairs = [f"{heads[i] if i < len(heads) else f'col{i + 1}'}: {c}" for i, c in enumerate(cells) if c.strip()]
        if pairs:
            out.add("table-row", "; ".join(pairs), locator=f"row:{n}")
    if any(len(c) != len(heads) for _, c in rows):
        out.warn("some rows don't have the header's fields")


def _pointer(*parts: str) -> str:
    return "#" + "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def read_json_schema(text: str, out: blocks.Builder) -> None:
    """A block for each schema and property with its constraints; only local references are followed, none fetched."""
    doc = json.loads(text)
    remote = 0

    def schema(node, path: tuple, name: str, level: int) -> None:
        nonlocal remote
        if not isinstance(node, dict):
            return
        if level:
            out.add("heading", name, level=min(level, 6), locator=_pointer(*path))
        facts = [f"{k}: {json.dumps(node[k], sort_keys=True)}" for k in ("type", "description", "enum", "const", "format", "pattern", "minimum", "maximum", "minLength", "maxLength", "required", "default") if k in node]
        if "$ref" in node:
            facts.append(f"$ref: {node['$ref']}")
            remote += not str(node["$ref"]).startswith("#")
        if facts:
            out.add("schema", "; ".join(facts), locator=_pointer(*path))
        for key in ("properties", "$defs", "definitions"):
            for k, v in (node.get(key) or {}).items():
                schema(v, (*path, key, k), k, level + 1)
        if isinstance(node.get("items"), dict):
            schema(node["items"], (*path, "items"), f"{name}[]", level + 1)

    schema(doc, (), str(doc.get("title", "schema")), 1)
    if remote:
        out.warn(f"{remote} remote references were not fetched")


# Methods of an API description.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def read_openapi(text: str, out: blocks.Builder) -> None:
    """Information, operations (method and path) and component schemas, by JSON pointer."""
    doc = json.loads(text) if text.lstrip().startswith("{") else read_yaml(text)
    info = doc.get("info") or {}
    out.add("heading", str(info.get("title", "API")), level=1, locator=_pointer("info"))
    if info.get("description"):
        out.add("paragraph", str(info["description"]), locator=_pointer("info", "description"))
    for path, item in (doc.get("paths") or {}).items():
        for method in METHODS:
            op = (item or {}).get(method)
            if isinstance(op, dict):
                names = ", ".join(str(p.get("name")) for p in op.get("parameters") or [] if isinstance(p, dict))
                codes = ", ".join(str(c) for c in op.get("responses") or {})
                lines = [f"{method.upper()} {path}", str(op.get("summary") or op.get("operationId") or ""), f"parameters: {names}" if names else "", f"responses: {codes}" if codes else ""]
                out.add("operation", "\n".join(filter(None, lines)), locator=_pointer("paths", path, method))
    for name, node in ((doc.get("components") or {}).get("schemas") or {}).items():
        fields = ", ".join((node or {}).get("properties") or {})
        out.add("schema", f"{name}: {fields}" if fields else name, locator=_pointer("components", "schemas", name))


def read_yaml(text: str) -> dict:
    """The YAML of plain API descriptions: nested maps, lists, scalars, quoted and block strings. Anything else is an error."""
    rows = []
    for raw in text.split("\n"):
        body = raw.rstrip()
        if body.strip() and not body.lstrip().startswith("#") and body.strip() not in ("---", "..."):
            rows.append((len(body) - len(body.lstrip()), body.strip()))

    def scalar(s: str):
        s = re.sub(r"\s+#.*$", "", s).strip() if not s.startswith(("'", '"')) else s.strip()
        if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith(("[", "{")):
            if s in ("[]", "{}"):
                return [] if s == "[]" else {}
            if s.startswith("["):
                return [scalar(p.strip()) for p in s.strip("[]").split(",") if p.strip()]
            pairs = [p.split(":", 1) for p in s.strip("{}").split(",") if ":" in p]
            return {k.strip().strip("'\""): scalar(v.strip()) for k, v in pairs}
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s, int(s) if re.fullmatch(r"-?\d+", s) else s)

    def entry(i: int, indent: int, s: str, into: dict) -> int:
        m = re.match(r"""^("[^"]*"|'[^']*'|[^:]+?|\S+?):(?:\s+(.*))?$""", s)
        if not m:
            raise ValueError(f"unsupported YAML: {s[:60]}")
        key, value = m[1].strip("'\""), (m[2] or "").strip()
        if re.fullmatch(r"[|>][+-]?", value):
            held = []
            while i < len(rows) and rows[i][0] > indent:
                held.append(rows[i][1])
                i += 1
            into[key] = ("\n" if value[0] == "|" else " ").join(held)
        elif value and not value.startswith("#"):
            into[key] = scalar(value)
        elif i < len(rows) and (rows[i][0] > indent or (rows[i][0] == indent and rows[i][1].startswith("- "))):
            into[key], i = block(i, rows[i][0])
        else:
            into[key] = None
        return i

    def block(i: int, indent: int):
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            items = []
            while i < len(rows) and rows[i][0] == indent and (rows[i][1].startswith("- ") or rows[i][1] == "-"):
                body = rows[i][1][1:].strip()
                i += 1
                if not body:
                    value, i = block(i, rows[i][0])
                elif re.match(r"^[^'\"\[{][^:]*:(\s|$)", body):
                    value = {}
                    inner = indent + 2
                    i = entry(i, inner, body, value)
                    while i < len(rows) and rows[i][0] == inner and not rows[i][1].startswith("- "):
                        i = entry(i + 1, inner, rows[i][1], value)
                else:
                    value = scalar(body)
                items.append(value)
            return items, i
        found: dict = {}
        while i < len(rows) and rows[i][0] == indent:
            i = entry(i + 1, indent, rows[i][1], found)
        return found, i

    if not rows:
        return {}
    doc, end = block(0, rows[0][0])
    if end < len(rows):
        raise ValueError(f"unsupported YAML: {rows[end][1][:60]}")
    return doc


def read_sql(text: str, out: blocks.Builder) -> None:
    """Tables with columns and constraints, indexes and views; any other statement verbatim with its lines."""
    at, start = 1, None
    held: list[str] = []
    statements = []
    for n, line in enumerate(text.split("\n"), 1):
        plain = re.sub(r"--.*$", "", line)
        if start is None and plain.strip():
            start = n
        held.append(plain)
        if plain.rstrip().endswith(";"):
            statements.append((start or at, n, "\n".join(held).strip()))
            held, start, at = [], None, n + 1
    if "".join(held).strip():
        statements.append((start or at, text.count("\n") + 1, "\n".join(held).strip()))
    name = r'[`"\[]?([A-Za-z_][\w.$]*)[`"\]]?'
    for first, last, body in statements:
        table = re.match(rf"(?is)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?{name}\s*\((.*)\)[^)]*;?$", body)
        index = re.match(rf"(?is)create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?{name}\s+on\s+{name}\s*\((.*?)\)", body)
        view = re.match(rf"(?is)create\s+(?:or\s+replace\s+)?view\s+{name}\s+as\s+(.*)$", body)
        if table:
            out.add("heading", f"table {table[1]}", first, last, 1)
            depth, part, parts = 0, "", []
            for c in table[2] + ",":
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    parts.append(" ".join(part.split()))
                    part = ""
                else:
                    part += c
            for p in filter(None, parts):
                kind = "constraint" if re.match(r"(?i)(primary|foreign|unique|check|constraint)\b", p) else "column"
                out.add(kind, p, first, last)
        elif index:
            out.add("index", f"{index[1]} on {index[2]} ({' '.join(index[3].split())})", first, last)
        elif view:
            out.add("view", f"{view[1]}: {' '.join(view[2].rstrip(';').split())}", first, last)
        else:
            out.add("statement", body, first, last)
            if not re.match(r"(?i)(insert|alter|drop|comment|grant|set|use|update|delete|begin|commit|select)\b", body):
                out.warn(f"lines {first}-{last} were kept as they are", partial=True)


def _archive(data: bytes, out: blocks.Builder) -> zipfile.ZipFile | None:
    """An archive within the limits, or none with a reason."""
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    packed = max(1, sum(i.compress_size for i in infos))
    bad = (
        "too many members" if len(infos) > MAX_MEMBERS
        else "a member is too large" if any(i.file_size > MAX_MEMBER_BYTES for i in infos)
        else "compressed too tightly" if sum(i.file_size for i in infos) / packed > MAX_RATIO
        else "a member leaves the archive" if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos)
        else ""
    )
    if bad:
        out.status = "failed"
        out.warn(f"archive refused: {bad}")
        return None
    return z


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("XML with declarations is refused")
    return ElementTree.fromstring(data)


def read_docx(data: bytes, out: blocks.Builder) -> None:
    """Paragraphs by style, headings, tables; images are counted."""
    z = _archive(data, out)
    if z is None:
        return
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    for n, e in enumerate(_xml(z.read("word/document.xml")).find(f"{w}body"), 1):
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            name = (style.get(f"{w}val") or "") if style is not None else ""
            level = re.fullmatch(r"(?i)heading\s*(\d)", name)
            if words(e).strip():
                listed = e.find(f"{w}pPr/{w}numPr") is not None
                out.add("heading" if level else "list-item" if listed else "paragraph", words(e).strip(), level=int(level[1]) if level else 0, locator=f"paragraph:{n}")
        elif e.tag == f"{w}tbl":
            for r, row in enumerate(e.iter(f"{w}tr"), 1):
                out.add("table-row", " | ".join(words(c).strip() for c in row.iter(f"{w}tc")), locator=f"table:{n}/row:{r}")
    images = sum(i.startswith("word/media/") for i in z.namelist())
    if images:
        out.warn(f"{images} embedded images")


def read_xlsx(data: bytes, out: blocks.Builder) -> None:
    """Sheets with their rows, formulas as text; hidden sheets are noted."""
    z = _archive(data, out)
    if z is None:
        return
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in _xml(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
    for i, sheet in enumerate(_xml(z.read("xl/workbook.xml")).iter(f"{m}sheet"), 1):
        if sheet.get("state") in ("hidden", "veryHidden"):
            out.warn(f"sheet {sheet.get('name')} is hidden")
        out.add("heading", sheet.get("name") or f"sheet {i}", level=1, locator=f"sheet:{i}")
        part = f"xl/worksheets/sheet{i}.xml"
        if part not in z.namelist():
            continue
        for row in _xml(z.read(part)).iter(f"{m}row"):
            cells = []
            for c in row.iter(f"{m}c"):
                formula, value, inline = c.find(f"{m}f"), c.find(f"{m}v"), c.find(f"{m}is")
                text = f"={formula.text}" if formula is not None and formula.text else "".join(t.text or "" for t in inline.iter(f"{m}t")) if inline is not None else (value.text or "") if value is not None else ""
                if c.get("t") == "s" and value is not None and formula is None:
                    text = shared[int(value.text)]
                if text:
                    cells.append(f"{c.get('r')}: {text}")
            if cells:
                out.add("table-row", "; ".join(cells), locator=f"sheet:{i}/row:{row.get('r')}")


READERS = {"markdown": read_markdown, "text": read_text, "csv": read_csv, "json-schema": read_json_schema, "openapi": read_openapi, "sql": read_sql, "html": html.read}
BINARY = {"pdf": pdf.read, "docx": read_docx, "xlsx": read_xlsx}


def parser_for(media: str, head: str) -> str | None:
    """The parser of least priority that claims a document; none for what no parser reads."""
    claims = {
        "pdf": media == "application/pdf", "docx": media == MEDIA[".docx"], "xlsx": media == MEDIA[".xlsx"],
        "openapi": media in ("application/json", "application/yaml") and re.search(r"(?m)^\s*[\"']?(openapi|swagger)[\"']?\s*:", head) is not None,
        "json-schema": media == "application/json" and re.search(r'"(\$schema|\$defs|definitions|properties)"\s*:', head) is not None,
        "sql": media == "application/sql", "csv": media in ("text/csv", "text/tab-separated-values"), "html": media == "text/html",
        "markdown": media == "text/markdown", "text": media.startswith("text/") and media not in ("text/csv", "text/tab-separated-values", "text/html", "text/markdown"),
    }
    found = [p for p, ok in claims.items() if ok]
    return min(found, key=PRIORITIES.__getitem__, default=None)


def read_document(path: str, media: str, content: bytes) -> list[dict]:
    """Rows of one document through its parser, with the parser's name."""
    head = content[:65536].decode("utf-8", "replace")
    name = parser_for(media, head)
    if name is None:
        rows = [r | {"status": "unsupported", "warning": f"no parser reads {media}"} for r in blocks.document(path, "", lambda t, o: None)]
    elif name in BINARY:
        rows = blocks.document(path, "", lambda _, o: BINARY[name](content, o))
    else:
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError:
            text = content.decode("latin-1")
        rows = blocks.document(path, text, READERS[name])
    return [r | {"parser": name or "none"} for r in rows]


def parse(files: DataFrame) -> DataFrame:
    """Blocks of files (path, content) of any supported format."""
    names = [c.split()[0] for c in blocks.SCHEMA.split(", ")] + ["parser"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 32):
                part = batch.iloc[first : first + 32]
                rows = [r for p, m, c in zip(part["path"], part["media"], part["content"], strict=True) for r in read_document(p, m, bytes(c or b""))]
                frame = pd.DataFrame(rows, columns=names)
                for c in ("ordinal", "level", "start_line", "end_line"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    probed = files.select("path", media_type(F.col("content"), F.col("path")).alias("media"), "content")
    return probed.mapInPandas(run, blocks.SCHEMA + ", parser string")
