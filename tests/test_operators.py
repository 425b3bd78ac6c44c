"""Operators on small literal tables: structure, glossary, sources, graph, conflicts, overlays."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factlode.functions import facts
from factlode.operators import conflicts, filters, glossary, graph, ledger, overlay, retrieval, semantic, structure, windows
from factlode.sources import blocks, documents, manifests, tree, versions

JAVA = """package com.acme.orders;
import com.acme.pay.PayClient;
import java.util.List;
/* class Hidden
   class AlsoHidden */
public class OrderService { // class Comment
  void place() { payNow(1); if (x) { helper(); } }
  public static void main(String[] a) { }
}
"""
PAY = "package com.acme.pay;\npublic class PayClient {\n  void ok() { OrderService(); }\n}\n"
PY = "from . import util\nfrom .core.db import open_db as o\nimport os, sys\n\ndef run():\n    open_db()\n"
FILES = [("src/orders/OrderService.java", JAVA), ("src/pay/PayClient.java", PAY), ("app/main.py", PY), ("app/util.py", "def helper(): pass\n"), ("app/core/db.py", "def open_db(): pass\ndef payNow(x): pass\n"), ("web/a.ts", "import {b} from './b'\nb()\n"), ("web/b.ts", "export function b() {}\nexport const payNow = (x) => x\n"), ("notes.txt", "hello\n")]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(FILES, "path string, text string")
    return structure.scan(df).cache()


def test_definitions_skip_comments(rows):
    got = {(r.symbol, r.kind) for r in structure.definitions(rows).collect()}
    assert ("OrderService", "class") in got and ("payNow", "function") in got
    assert not {s for s, _ in got} & {"Hidden", "AlsoHidden", "Comment"}


def test_imports_and_calls(rows):
    resolved = {(r.path, r.target): (r.to_path, r.internal) for r in structure.imports(rows).collect()}
    assert resolved["src/orders/OrderService.java", "com.acme.pay.PayClient"] == ("src/pay/PayClient.java", True)
    assert resolved["src/orders/OrderService.java", "java.util.List"] == (None, False)
    assert resolved["app/main.py", "app.util"] == ("app/util.py", True)
    assert resolved["app/main.py", "app.core.db"] == ("app/core/db.py", True)
    assert resolved["web/a.ts", "./b"] == ("web/b.ts", True)
    calls = {(r.from_path, r.to_path, r.symbol, r.ambiguous) for r in structure.call_edges(rows).collect()}
    assert ("src/orders/OrderService.java", "app/core/db.py", "payNow", True) in calls
    assert ("src/orders/OrderService.java", "app/util.py", "helper", False) in calls
    assert [r.kind for r in structure.entry_points(rows).collect()] == ["main"]
    assert {(r.from_module, r.to_module) for r in structure.module_graph(rows).collect()} >= {("app", "app/core"), ("src/orders", "src/pay")}


def test_unchanged_files_are_not_scanned_again(spark, rows):
    hashed = spark.createDataFrame([(p, t, str(len(t))) for p, t in FILES], "path string, text string, content_hash string")
    before = rows.join(hashed.select("path", "content_hash"), "path")
    changed = hashed.withColumn("content_hash", F.when(F.col("path") == "web/b.ts", "new").otherwise(F.col("content_hash")))
    again = structure.scan_changed(changed, before)
    assert sorted(map(tuple, again.select(*rows.columns).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_glossary(spark):
    files = [
        ("docs/glossary.md", "| Term | Meaning |\n|---|---|\n| ISR | in-sync replicas of a log |\n\nBroker: a server of the cluster\n", "1"),
        ("src/A.java", "/* The In Sync Replicas (ISR) are kept */\nclass A {} // Dead Letter Queue (DLQ)\nString s = \"Time To Live\"; int x = (TTL);\n", "2"),
        ("README.md", "ISR (in-sync replica set)\nNote: not a term\nThe value (XY) is odd.\n", "3"),
    ]
    df = spark.createDataFrame(files, "path string, text string, content_hash string")
    built = {r.term: r for r in glossary.build(df).collect()}
    assert built["ISR"].definition == "in-sync replicas of a log" and built["ISR"].source_kind == "table"
    assert built["DLQ"].definition == "Dead Letter Queue" and built["DLQ"].line_number == 2
    assert built["Broker"].definition == "a server of the cluster"
    assert not {"TTL", "XY", "Note", "Term"} & set(built)
    asked = spark.createDataFrame([(1, "isrs"), (2, "DLQ"), (3, "nothing")], "question_id int, term string")
    assert {r.question_id: (r.hit, r.found) for r in glossary.lookup(glossary.build(df), asked).collect()} == {1: ("ISR", True), 2: ("DLQ", True), 3: (None, False)}


def test_ignore_rules_and_repositories(spark):
    rules = tree.ignore_rules("# c\n*.log\n!keep.log\n/gen/\ntmp\n")
    paths = ["a.log", "keep.log", "src/gen/x.py", "gen/x.py", "a/tmp/x.py", "a/b.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.filter(~tree.pruned(F.col("path"), rules)).collect()] == ["keep.log", "src/gen/x.py", "a/b.py"]
    files = spark.createDataFrame([(p, 10) for p in ("a/pom.xml", "a/m/pom.xml", "a/m/A.java", "b/c/d.py", "e.py", "node_modules/x.js")], "path string, length long")
    assert {r.path: r.repository for r in tree.repositories(files).collect()} == {"a/pom.xml": "a", "a/m/pom.xml": "a", "a/m/A.java": "a", "b/c/d.py": "b", "e.py": ".", "node_modules/x.js": "node_modules"}
    assert [r.path for r in tree.keep(files, tree.SOURCE_EXTENSIONS, 100, exclude=["b"]).orderBy("path").collect()] == ["a/m/A.java", "a/m/pom.xml", "a/pom.xml", "e.py"]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"caf\xe9 = 1\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"\0")
    got = tree.scan(spark, str(tmp_path)).select("path", "text").collect()
    assert [(r.path, r.text) for r in got] == [("src/a.py", "café = 1\n")]


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_documents(spark):
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * (1 << 22))
    files = [
        ("a.md", b"# One\n\ntext\nmore\n\n## Two\n- x\n- y\n\n```py\n# no heading\n```\n| a | b |\n"), ("b.csv", b"name;age\nbo;3\n;\nal;4\n"), ("c.csv", b"1,2\n3,4\n"),
        ("d.json", b'{"$schema": "x", "title": "T", "properties": {"a": {"type": "string"}, "b": {"$ref": "http://x/y"}}}'),
        ("e.yaml", b"openapi: 3.0.0\ninfo:\n  title: Api\npaths:\n  /x/{id}:\n    get:\n      summary: Read\n      responses:\n        '200':\n          description: ok\n"),
        ("f.sql", b"CREATE TABLE t (\n id int primary key, -- c\n price numeric(10,2)\n);\nCREATE INDEX i ON t (id);\nCREATE PACKAGE p;\n"),
        ("g.docx", docx()), ("h.docx", bomb.getvalue()), ("i.pdf", b"%PDF-1.4 /Encrypt"), ("j.txt", b"Head\n====\n\npara\n"), ("k.json", b"{broken \"$defs\": "), ("l.bin", b"a\0b"), ("m.md", b""),
    ]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {}
    for r in documents.parse(df).orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append(r)
    kinds = lambda p: [(r.block_type, r.content) for r in got[p]]
    assert kinds("a.md") == [("heading", "One"), ("paragraph", "text\nmore"), ("heading", "Two"), ("list-item", "x"), ("list-item", "y"), ("code", "# no heading"), ("table", "| a | b |")]
    assert got["a.md"][3].heading_path == ["One", "Two"] and got["a.md"][1].locator == "lines:3-4"
    assert kinds("b.csv") == [("table", "name | age"), ("table-row", "name: bo; age: 3"), ("table-row", "name: al; age: 4")]
    assert kinds("c.csv")[0] == ("table", "col1 | col2") and len(got["c.csv"]) == 3
    assert ("operation", "GET /x/{id}\nRead\nresponses: 200") in kinds("e.yaml") and got["e.yaml"][0].parser == "openapi"
    assert ("column", "price numeric(10,2)") in kinds("f.sql") and ("index", "i on t (id)") in kinds("f.sql") and got["f.sql"][0].status == "partial"
    assert kinds("g.docx") == [("heading", "Title"), ("paragraph", "Some text"), ("table-row", "a | b")]
    assert [got[p][0].status for p in ("h.docx", "i.pdf", "k.json", "l.bin", "m.md")] == ["failed", "encrypted", "failed", "unsupported", "parsed"]
    assert "remote" in got["d.json"][0].warning
    assert kinds("j.txt") == [("heading", "Head"), ("paragraph", "para")]
    parsed = documents.parse(df)
    assert blocks.structure_hash(parsed).count() == len(files)
    again = blocks.structure_hash(documents.parse(df.orderBy(F.desc("path"))))
    assert sorted(map(tuple, blocks.structure_hash(parsed).collect())) == sorted(map(tuple, again.collect()))


def test_pdf(spark):
    import zlib

    page = b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ ET"
    packed = zlib.compress(page)
    head = b"%PDF-1.4\n"
    files = [
        ("a.pdf", head + b"1 0 obj <</Length 1>> stream\n" + page + b"\nendstream\n2 0 obj <</Filter /FlateDecode>> stream\n" + packed + b"\nendstream"),
        ("b.pdf", head + b"1 0 obj <</Subtype /Image>> stream\nxx\nendstream"),
    ]
    got = documents.parse(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).orderBy("path", "ordinal").collect()
    assert [(r.path, r.status, r.content) for r in got] == [("a.pdf", "parsed", "Hello (PDF)\nworld"), ("a.pdf", "parsed", "Hello (PDF)\nworld"), ("b.pdf", "needs-ocr", None)]


def test_manifests(spark):
    files = [
        ("requirements.txt", "fastapi>=0.1\n# c\n-r other\nredis[x]==2\n"), ("p/package.json", '{"dependencies": {"react": "1"}, "scripts": {"start": "x"}}'), ("pyproject.toml", '[project]\ndependencies = ["flask>1"]\n'),
        ("go.mod", "module m\nrequire (\n  github.com/gin-gonic/gin v1.2.0\n)\n"), ("pom.xml", "<dependency><artifactId>spring-webmvc</artifactId></dependency>"), ("Cargo.toml", "[dependencies]\naxum = \"1\"\n"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    deps = {(r.path, r.dependency) for r in manifests.dependencies(df).collect()}
    assert deps == {("requirements.txt", "fastapi"), ("requirements.txt", "redis"), ("p/package.json", "react"), ("pyproject.toml", "flask"), ("go.mod", "github.com/gin-gonic/gin"), ("pom.xml", "spring-webmvc"), ("Cargo.toml", "axum")}
    assert {(r.dependency, r.cue) for r in manifests.cues(manifests.dependencies(df)).collect()} >= {("fastapi", "web"), ("redis", "cache"), ("react", "frontend"), ("axum", "web")}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", None)], "id int, k string, t string")
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert ids(filters.where({"k": {"$ne": "a"}})) == [2, 3]
    assert ids(filters.where({"k": {"$nin": ["a", None]}})) == [3]
    assert ids(filters.where({"k": {"$in": ["a", None]}})) == [1, 2]
    assert ids(filters.where({"$or": [{"k": "b"}, {"t": "y"}], "id": {"$gte": 99}})) == [2, 3]
    assert ids(filters.where_document(F.col("t"), {"$not_contains": "x"})) == [2, 3]
    assert ids(filters.matches_glob(F.col("t"), "[!y]")) == [1]


def test_ranges_and_budget(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 7, 9), ("a", 8, 8), ("b", 1, 1)], "f string, s int, e int")
    assert sorted((r.f, r.s, r.e, r.merged) for r in windows.merge_ranges(df, ["f"], "s", "e").collect()) == [("a", 1, 5, 2), ("a", 7, 9, 2), ("b", 1, 1, 1)]
    spent = spark.createDataFrame([(1, 5, None), (2, 5, 1.0), (3, 1, 0.0), (4, 0, 0.0)], "n int, t int, c double")
    assert [r.n for r in windows.running_budget(spent, ["n"], {"t": 10, "c": 1.0}).orderBy("n").collect()] == [1, 2]
    headings = spark.createDataFrame([("d", 1, 1, "A"), ("d", 2, None, "t"), ("d", 3, 2, "B"), ("d", 4, 3, "C"), ("d", 5, 2, "D"), ("d", 6, None, "u"), ("d", 7, 1, "E"), ("d", 8, None, "v")], "d string, n int, l int, t string")
    paths = windows.heading_paths(headings, ["d"], "n", "l", "t").orderBy("n").collect()
    assert [r.heading_path for r in paths] == [[], ["A"], ["A"], ["A", "B"], ["A"], ["A", "D"], [], ["E"]]


def test_graph(spark):
    rel = spark.createDataFrame([(f"r{i}", a, b, "t", "active") for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")])], "id string, source string, target string, type string, lifecycle string")
    found = graph.shortest_paths(rel, "a", "e").collect()
    assert [(r.path, r.hops) for r in found] == [(["a", "b", "c", "e"], 3), (["a", "d", "c", "e"], 3)]
    assert graph.shortest_paths(rel, "a", "z").first().status == "no-path"
    assert graph.shortest_paths(rel, "a", "e", depth=2).first().status == "truncated"
    nodes, edges = graph.expand(spark.createDataFrame([("a",)], "id string"), rel, 2, max_nodes=3)
    assert [(r.id, r.depth, r.truncated) for r in nodes.orderBy("depth", "id").collect()] == [("a", 0, True), ("b", 1, True), ("d", 1, True)]
    assert edges.count() == 2
    mapping = spark.createDataFrame([("d", "b")], "old_id string, new_id string")
    assert sorted((r.id, r.source, r.target) for r in graph.merge_entities(rel, mapping).collect()) == [("r0", "a", "b"), ("r1", "b", "c"), ("r4", "c", "e")]
    with pytest.raises(ValueError):
        graph.split_entity(rel, "a", "a2", spark.createDataFrame([("r4",)], "relation_id string"))
    moved = graph.split_entity(rel, "a", "a2", spark.createDataFrame([("r2",)], "relation_id string"))
    assert {(r.id, r.source) for r in moved.collect()} >= {("r2", "a2"), ("r0", "a")}


def test_versions_and_overlay(spark):
    patch = "--- a\n+++ b\n@@ -1,2 +1,3 @@ x\n@@ -9,0 +11 @@\n"
    got = overlay.hunk_ranges(spark.createDataFrame([("f", patch), ("g", "@@ nonsense @@\n")], "file string, patch string")).collect()
    assert sorted((r.file, r.side, r.start, r["count"]) for r in got) == [("f", "after", 1, 3), ("f", "after", 11, 1), ("f", "before", 1, 2), ("g", "error", 0, 0)]
    diff = versions.line_ranges(spark.createDataFrame([("f", "a\nb\nc\n", "a\nB\nc\nd\n")], "path string, before string, after string")).collect()
    assert sorted((r.side, r.start, r["count"]) for r in diff) == [("after", 2, 1), ("after", 4, 1), ("before", 2, 1)]
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    a = spark.createDataFrame([("a", "1"), ("x", "2"), ("c", "4"), ("n", "9")], "path string, digest string")
    changes = overlay.file_changes(b, a)
    assert {(r.path_before, r.path_after, r.change) for r in changes.collect()} == {("a", "a", "unchanged"), ("b", "x", "renamed"), ("c", "c", "modified"), (None, "n", "added")}
    assert {r.path for r in overlay.masked_paths(changes).collect()} == {"b", "c"}


def test_conflicts(spark):
    s = [("c1", "e", "authoritative", "document", "timeout 2 s"), ("c2", "e", "unknown", "code", "timeout 2000 ms"), ("c3", "e", "unknown", "code", "timeout 5 s"), ("c4", "e", "unknown", "code", "timeout 9999")]
    f = conflicts.extract(spark.createDataFrame(s, "claim_id string, entity_id string, authority string, source_kind string, statement string"))
    assert [(r.a, r.b) for r in conflicts.statement_pairs(f).collect()] == [("c1#0", "c3#0")]
    assert facts.compare("a", "b") is not None
    moved = conflicts.transition(spark.createDataFrame([("k", "open"), ("m", "resolved")], "conflict_id string, status string"), spark.createDataFrame([("k", "dismissed"), ("m", "dismissed")], "conflict_id string, to string"))
    assert {(r.conflict_id, r.status, r.accepted) for r in moved.collect()} == {("k", "dismissed", True), ("m", "resolved", False)}


def test_semantic(spark):
    claims = spark.createDataFrame([("a", 1, "Two  Words"), ("a", 2, "x"), ("b", 1, "two words"), ("c", 3, "q")], "claim_id string, evidence_id int, quote string")
    evidence = spark.createDataFrame([(1, "here are two\nwords."), (2, "none")], "evidence_id int, text string")
    assert {r.claim_id: r.status for r in semantic.verify_quotes(claims, evidence).collect()} == {"a": "partial", "b": "verified", "c": "failed"}
    budget = semantic.merge_budgets(*[spark.createDataFrame(x, "name string, value long") for x in ([("r", 200), ("t", 9)], [("r", 100)], [("r", 150), ("t", 5)])])
    assert {(r.name, r.value, r.refused) for r in budget.collect()} == {("r", 100, True), ("t", 5, False)}


def test_incremental_ledger_is_idempotent(spark):
    seen = spark.createDataFrame([("x", 1, "A"), ("x", 2, "A"), ("x", 3, "B"), ("x", 4, "A"), ("y", 1, None)], "asset string, n int, h string")
    got = [(r.asset, r.n, r.sequence, r.supersedes) for r in ledger.revision_sequence(seen, "asset", ["n"], "h").orderBy("asset", "n").collect()]
    assert got == [("x", 1, 1, None), ("x", 3, 2, "x@1"), ("x", 4, 3, "x@2"), ("y", 1, 1, None)]
    snap = seen.groupBy("asset").agg(F.max_by("h", "n").alias("h"))
    assert {r.change for r in ledger.change_detection(snap.filter("h is not null"), snap.filter("h is not null"), ["asset"], "h").collect()} == {"unchanged"}


def test_routes(spark):
    df = spark.createDataFrame([("OrderService",), ("what is an ISR?",), ("who calls x y",), ("late orders",)], "q string")
    assert [r.r for r in df.select(retrieval.route(F.col("q")).alias("r")).collect()] == ["glossary", "glossary", "structure", "search"]
