"""Operators whose inputs the driver's tables don't have, over literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance, graph, ledger, overlay, projection, semantic, structure, trace, windows
from ..operators import glossary as terms
from ..sources import documents, manifests, tree, versions

CODE = [
    ("src/orders/OrderService.java", "package com.acme.orders;\nimport com.acme.pay.PayClient;\nimport java.util.List;\n/* class Hidden */\npublic class OrderService {\n  void place() { payNow(1); if (x) { helper(); } }\n  public static void main(String[] a) { }\n}\n"),
    ("src/pay/PayClient.java", "package com.acme.pay;\npublic class PayClient {\n  void ok() { OrderService(); }\n}\n"),
    ("app/main.py", "from . import util\nfrom .core.db import open_db\nimport os\n\ndef run():\n    open_db()\n"),
    ("app/util.py", "def helper(): pass\n"),
    ("app/core/db.py", "def open_db(): pass\ndef payNow(x): pass\n"),
    ("web/a.ts", "import {b} from './b'\nb()\n"),
    ("web/b.ts", "export function b() {}\nexport const payNow = (x) => x\n"),
]
PROSE = [
    ("docs/glossary.md", "| Term | Meaning |\n|---|---|\n| ISR | in-sync replicas of a log |\n\nBroker: a server of the cluster\n"),
    ("src/A.java", "/* The In Sync Replicas (ISR) are kept */\nclass A {} // Dead Letter Queue (DLQ)\nint x = (TTL);\n"),
    ("README.md", "ISR (in-sync replica set)\nNote: not a term\nThe value (XY) is odd.\n"),
]


def _rows(spark):
    return structure.scan(spark.createDataFrame(CODE, "path string, text string"))


def structure_definitions(spark, sf_dir):
    """Definitions in literal source files."""
    return structure.definitions(_rows(spark))


def structure_imports(spark, sf_dir):
    """Imports of literal source files, resolved."""
    return structure.imports(_rows(spark))


def structure_calls(spark, sf_dir):
    """Calls between literal source files."""
    return structure.call_edges(_rows(spark))


def structure_modules(spark, sf_dir):
    """Edges between the directories of literal source files."""
    return structure.module_graph(_rows(spark))


def structure_entries(spark, sf_dir):
    """Entry points of literal source files."""
    return structure.entry_points(_rows(spark))


def graph_projection(spark, sf_dir):
    """Relations that the structure of literal files speaks for."""
    return projection.graph_of(_rows(spark))[1].select("source", "target", "type", "state", "confidence")


def glossary_build(spark, sf_dir):
    """The glossary of literal files."""
    files = spark.createDataFrame([(p, t, str(i)) for i, (p, t) in enumerate(PROSE)], "path string, text string, content_hash string")
    return terms.build(files).select("term", "definition", "source_file", "line_number", "source_kind")


def glossary_lookup(spark, sf_dir):
    """Terms looked up exactly, without case, without a plural s."""
    files = spark.createDataFrame([(p, t, str(i)) for i, (p, t) in enumerate(PROSE)], "path string, text string, content_hash string")
    asked = spark.createDataFrame([(1, "ISR"), (2, "dlq"), (3, "Brokers"), (4, "unknown")], "question_id int, term string")
    return terms.lookup(terms.build(files), asked).select("question_id", "hit", "found")


def _documents(spark):
    files = [("a.md", "# One\n\ntext\nmore\n\n## Two\n- x\n- y\n\n```py\n# no heading\n```\n"), ("b.csv", "name;age\nbo;3\nal;4\n"), ("c.sql", "CREATE TABLE t (\n id int primary key,\n price numeric(10,2)\n);\n"), ("d.txt", "Head\n====\n\npara\n")]
    return documents.parse(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary"))


def document_blocks(spark, sf_dir):
    """Blocks of literal Markdown, CSV, SQL and text documents."""
    return _documents(spark).select("path", "parser", "ordinal", "block_type", "level", "start_line", "content", F.array_join("heading_path", " > ").alias("heading_path"))


def ignore_rules(spark, sf_dir):
    """Literal paths under literal ignore rules."""
    rules = tree.ignore_rules("*.log\n!keep.log\n/gen/\ntmp\n")
    paths = ["a.log", "keep.log", "src/gen/x.py", "gen/x.py", "a/tmp/x.py", "a/b.py"]
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", tree.pruned(F.col("path"), rules).alias("ignored"))


def repository_roots(spark, sf_dir):
    """Repositories of literal paths."""
    paths = ["a/pom.xml", "a/m/pom.xml", "a/m/A.java", "b/c/d.py", "e.py"]
    return tree.repositories(spark.createDataFrame([(p,) for p in paths], "path string"))


def manifest_cues(spark, sf_dir):
    """Dependencies of literal manifests and what they speak for."""
    files = [("requirements.txt", "fastapi>=0.1\nredis[x]==2\n"), ("package.json", '{"dependencies": {"react": "1"}}'), ("go.mod", "module m\nrequire (\n  github.com/gin-gonic/gin v1.2.0\n)\n")]
    return manifests.cues(manifests.dependencies(spark.createDataFrame(files, "path string, text string")))


def mention_scan(spark, sf_dir):
    """Mentions in a literal segment."""
    seg = spark.createDataFrame([(1, "See OrderService in src/OrderService.java, REQ-NC-017 and JIRA-12; GET /x/{id}")], "segment_id int, content string")
    return projection.mentions(seg).filter("kind in ('file', 'requirement', 'code-id', 'endpoint')")


def hunk_ranges(spark, sf_dir):
    """Ranges of a literal unified diff; sides without lines are left out."""
    patches = [("f", "--- a\n+++ b\n@@ -1,2 +1,3 @@ x\n@@ -9,0 +11 @@\n"), ("g", "@@ nonsense @@\n")]
    return overlay.hunk_ranges(spark.createDataFrame(patches, "file string, patch string"))


def file_changes(spark, sf_dir):
    """Changes between two literal snapshots, equal contents paired as renames."""
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "5")], "path string, digest string")
    a = spark.createDataFrame([("a", "1"), ("x", "2"), ("c", "4"), ("n", "9")], "path string, digest string")
    return overlay.file_changes(b, a)


def line_ranges(spark, sf_dir):
    """Ranges of lines that differ between two literal versions."""
    return versions.line_ranges(spark.createDataFrame([("f", "a\nb\nc\n", "a\nB\nc\nd\n")], "path string, before string, after string"))


def raw_changes(spark, sf_dir):
    """File changes of literal raw diff lines."""
    lines = [":100644 100644 aa bb M\tsrc/a.py", ":000000 100644 00 cc A\tnew.py", ":100644 000000 dd 00 D\told.py", ":100644 100644 ee ee R100\tx.py\ty.py", "noise"]
    return versions.raw_changes(spark.createDataFrame([(x,) for x in lines], "line string")).select("change", "similarity", "path_before", "path_after")


def overlay_merge(spark, sf_dir):
    """A base with literal deltas on top."""
    base = spark.createDataFrame([("k1", "one"), ("k2", "two"), ("k3", "three")], "key string, name string")
    deltas = spark.createDataFrame([("k2", "zwei", "modified"), ("k3", "three", "removed"), ("k4", "four", "added")], "key string, name string, delta string")
    return overlay.merge_overlay(base, deltas, "key")


def import_decisions(spark, sf_dir):
    """What becomes of literal incoming files."""
    incoming = spark.createDataFrame([("same.md", "h1", None, "same.md"), ("next.md", "h9", "doc-a", "next.md"), ("own.md", "h8", "doc-z", "own.md"), ("doc-b", "h7", None, "doc-b"), ("new.md", "h6", None, "new.md")], "name string, digest string, key string, default_key string")
    assets = spark.createDataFrame([("doc-a", "h1"), ("doc-b", "h2")], "asset_key string, digest string")
    return ledger.import_decision(incoming, assets).select("name", "decision", "asset_key")


def promotion_gate(spark, sf_dir):
    """Every reason that blocks literal candidates."""
    rows = [(1, "confirmed", "active", "verified", "requirement", True, ["e1"]), (2, "unreviewed", "stale", "rejected", "poem", False, []), (3, "confirmed", "active", "verified", "design", True, ["e1", "zz"]), (4, "confirmed", "active", "verified", "design", True, ["e1"])]
    c = spark.createDataFrame(rows, "candidate_id int, review string, lifecycle string, verification string, kind string, revision_current boolean, evidence_ids array<string>")
    out = semantic.promotion_blocks(c, spark.createDataFrame([("e1",)], "evidence_id string"), spark.createDataFrame([(4,)], "candidate_id int"), ["requirement", "design"])
    return out.select("candidate_id", F.array_join("blocked", ",").alias("blocked"))


def budget_merge(spark, sf_dir):
    """Limits after a policy and overrides that may only tighten."""
    frames = [spark.createDataFrame(x, "name string, value long") for x in ([("requests", 200), ("tokens", 9)], [("requests", 100)], [("requests", 150), ("tokens", 5)])]
    return semantic.merge_budgets(*frames)


def gap_reconcile(spark, sf_dir):
    """The next state of literal gaps."""
    d = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "detection_fingerprint string")
    s = spark.createDataFrame([("b", "open", None), ("c", "accepted", "2020"), ("d", "dismissed", None), ("e", "open", None), ("f", "dismissed", None), ("g", "accepted", "2999")], "detection_fingerprint string, status string, expires_at string")
    return trace.reconcile_gaps(d, s, F.lit("2024"))


def decisions(spark, sf_dir):
    """The ledger of literal decisions."""
    objects = spark.createDataFrame([("a", "active"), ("b", "withdrawn"), ("c", "active")], "id string, lifecycle string")
    asked = spark.createDataFrame([("a", "withdraw", "me", ""), ("a", "supersede", "me", ""), ("b", "withdraw", "me", ""), ("z", "withdraw", "me", "")], "id string, decision string, actor string, note string")
    return governance.decide(objects, asked, 7)[1].select("id", "decision", "before", "after", "accepted")


def heading_paths(spark, sf_dir):
    """Headings above literal blocks."""
    rows = [("d", 1, 1, "A"), ("d", 2, None, "t"), ("d", 3, 2, "B"), ("d", 4, 3, "C"), ("d", 5, 2, "D"), ("d", 6, None, "u"), ("d", 7, 1, "E"), ("d", 8, None, "v")]
    df = spark.createDataFrame(rows, "doc string, n int, level int, title string")
    return windows.heading_paths(df, ["doc"], "n", "level", "title").select("n", F.array_join("heading_path", "/").alias("path"))


def mermaid_diagram(spark, sf_dir):
    """A flowchart of literal nodes."""
    nodes = spark.createDataFrame([("b.py",), ("a.py",)], "id string")
    return graph.mermaid(nodes, spark.createDataFrame([("a.py", "b.py")], "source string, target string"))


def case_staleness(spark, sf_dir):
    """Literal cases whose files changed or are gone."""
    cases = spark.createDataFrame([(1, [("a", "1"), ("b", "2")]), (2, [("a", "1")]), (3, [("z", "1")])], "case_id int, refs array<struct<path:string,hash:string>>")
    out = projection.stale_cases(cases, spark.createDataFrame([("a", "1"), ("b", "9")], "path string, content_hash string"))
    return out.select("case_id", "stale", F.array_join("changed", ",").alias("changed"))


QUERIES = {f.__name__: f for f in (
    structure_definitions, structure_imports, structure_calls, structure_modules, structure_entries, graph_projection, glossary_build, glossary_lookup,
    document_blocks, ignore_rules, repository_roots, manifest_cues, mention_scan, hunk_ranges, file_changes, line_ranges, raw_changes, overlay_merge,
    import_decisions, promotion_gate, budget_merge, gap_reconcile, decisions, heading_paths, mermaid_diagram, case_staleness,
)}

ORACLES = {
    "structure_definitions": """SELECT * FROM (VALUES ('OrderService', 'src/orders/OrderService.java', 'class', 5), ('PayClient', 'src/pay/PayClient.java', 'class', 2), ('run', 'app/main.py', 'function', 5),
        ('helper', 'app/util.py', 'function', 1), ('open_db', 'app/core/db.py', 'function', 1), ('payNow', 'app/core/db.py', 'function', 2), ('b', 'web/b.ts', 'function', 1), ('payNow', 'web/b.ts', 'function', 2)) v(symbol, path, kind, line)""",
    "structure_imports": """SELECT * FROM (VALUES ('src/orders/OrderService.java', 'com.acme.pay.PayClient', 'src/pay/PayClient.java', true), ('src/orders/OrderService.java', 'java.util.List', NULL, false),
        ('app/main.py', 'app.util', 'app/util.py', true), ('app/main.py', 'app.core.db', 'app/core/db.py', true), ('app/main.py', 'os', NULL, false), ('web/a.ts', './b', 'web/b.ts', true)) v(path, target, to_path, internal)""",
    "structure_calls": """SELECT * FROM (VALUES ('src/orders/OrderService.java', 'app/core/db.py', 'payNow', true), ('src/orders/OrderService.java', 'web/b.ts', 'payNow', true), ('src/orders/OrderService.java', 'app/util.py', 'helper', false),
        ('src/pay/PayClient.java', 'src/orders/OrderService.java', 'OrderService', false), ('app/main.py', 'app/core/db.py', 'open_db', false), ('web/a.ts', 'web/b.ts', 'b', false)) v(from_path, to_path, symbol, ambiguous)""",
    "structure_modules": """SELECT * FROM (VALUES ('src/orders', 'src/pay', 1::BIGINT), ('src/orders', 'app/core', 1), ('src/orders', 'web', 1), ('src/orders', 'app', 1), ('src/pay', 'src/orders', 1), ('app', 'app/core', 2)) v(from_module, to_module, weight)""",
    "structure_entries": "SELECT 'src/orders/OrderService.java' AS path, 'main' AS kind, 7 AS line",
    "graph_projection": """SELECT 'component:' || a AS source, CASE WHEN t = 'contains' THEN 'symbol:' ELSE 'component:' END || b AS target, t AS type, CASE WHEN t = 'calls' THEN 'inferred' ELSE 'explicit' END AS state, c AS confidence FROM (VALUES
        ('src/orders/OrderService.java', 'src/orders/OrderService.java#OrderService', 'contains', 'high'), ('src/pay/PayClient.java', 'src/pay/PayClient.java#PayClient', 'contains', 'high'), ('app/main.py', 'app/main.py#run', 'contains', 'high'),
        ('app/util.py', 'app/util.py#helper', 'contains', 'high'), ('app/core/db.py', 'app/core/db.py#open_db', 'contains', 'high'), ('app/core/db.py', 'app/core/db.py#payNow', 'contains', 'high'), ('web/b.ts', 'web/b.ts#b', 'contains', 'high'), ('web/b.ts', 'web/b.ts#payNow', 'contains', 'high'),
        ('src/orders/OrderService.java', 'src/pay/PayClient.java', 'imports', 'high'), ('app/main.py', 'app/util.py', 'imports', 'high'), ('app/main.py', 'app/core/db.py', 'imports', 'high'), ('web/a.ts', 'web/b.ts', 'imports', 'high'),
        ('src/orders/OrderService.java', 'app/core/db.py', 'calls', 'low'), ('src/orders/OrderService.java', 'web/b.ts', 'calls', 'low'), ('src/orders/OrderService.java', 'app/util.py', 'calls', 'medium'),
        ('src/pay/PayClient.java', 'src/orders/OrderService.java', 'calls', 'medium'), ('app/main.py', 'app/core/db.py', 'calls', 'medium'), ('web/a.ts', 'web/b.ts', 'calls', 'medium')) v(a, b, t, c)""",
    "glossary_build": """SELECT * FROM (VALUES ('ISR', 'in-sync replicas of a log', 'docs/glossary.md', 3, 'table'), ('Broker', 'a server of the cluster', 'docs/glossary.md', 5, 'defline'), ('DLQ', 'Dead Letter Queue', 'src/A.java', 2, 'acronym')) v(term, definition, source_file, line_number, source_kind)""",
    "glossary_lookup": "SELECT * FROM (VALUES (1, 'ISR', true), (2, 'DLQ', true), (3, 'Broker', true), (4, NULL, false)) v(question_id, hit, found)",
    "document_blocks": """SELECT * FROM (VALUES ('a.md', 'markdown', 0, 'heading', 1, 1, 'One', ''), ('a.md', 'markdown', 1, 'paragraph', 0, 3, 'text' || chr(10) || 'more', 'One'), ('a.md', 'markdown', 2, 'heading', 2, 6, 'Two', 'One'),
        ('a.md', 'markdown', 3, 'list-item', 0, 7, 'x', 'One > Two'), ('a.md', 'markdown', 4, 'list-item', 0, 8, 'y', 'One > Two'), ('a.md', 'markdown', 5, 'code', 0, 10, '# no heading', 'One > Two'),
        ('b.csv', 'csv', 0, 'table', 0, 0, 'name | age', ''), ('b.csv', 'csv', 1, 'table-row', 0, 0, 'name: bo; age: 3', ''), ('b.csv', 'csv', 2, 'table-row', 0, 0, 'name: al; age: 4', ''),
        ('c.sql', 'sql', 0, 'heading', 1, 1, 'table t', ''), ('c.sql', 'sql', 1, 'column', 0, 1, 'id int primary key', 'table t'), ('c.sql', 'sql', 2, 'column', 0, 1, 'price numeric(10,2)', 'table t'),
        ('d.txt', 'text', 0, 'heading', 1, 1, 'Head', ''), ('d.txt', 'text', 1, 'paragraph', 0, 4, 'para', 'Head')) v(path, parser, ordinal, block_type, level, start_line, content, heading_path)""",
    "ignore_rules": "SELECT * FROM (VALUES ('a.log', true), ('keep.log', false), ('src/gen/x.py', false), ('gen/x.py', true), ('a/tmp/x.py', true), ('a/b.py', false)) v(path, ignored)",
    "repository_roots": "SELECT * FROM (VALUES ('a/pom.xml', 'a'), ('a/m/pom.xml', 'a'), ('a/m/A.java', 'a'), ('b/c/d.py', 'b'), ('e.py', '.')) v(path, repository)",
    "manifest_cues": "SELECT * FROM (VALUES ('requirements.txt', 'fastapi', 'web'), ('requirements.txt', 'redis', 'cache'), ('package.json', 'react', 'frontend'), ('go.mod', 'github.com/gin-gonic/gin', 'web')) v(path, dependency, cue)",
    "mention_scan": "SELECT 1 AS segment_id, * FROM (VALUES ('file', 'src/OrderService.java'), ('requirement', 'REQ-NC-017'), ('code-id', 'JIRA-12'), ('code-id', 'NC-017'), ('endpoint', 'GET /x/{id}')) v(kind, mention)",
    "hunk_ranges": "SELECT * FROM (VALUES ('f', 'before', 1, 2), ('f', 'after', 1, 3), ('f', 'after', 11, 1), ('g', 'error', 0, 0)) v(file, side, start, count)",
    "file_changes": "SELECT * FROM (VALUES ('a', 'a', 'unchanged'), ('b', 'x', 'renamed'), ('c', 'c', 'modified'), ('d', NULL, 'deleted'), (NULL, 'n', 'added')) v(path_before, path_after, change)",
    "line_ranges": "SELECT * FROM (VALUES ('f', 'before', 2, 1), ('f', 'after', 2, 1), ('f', 'after', 4, 1)) v(path, side, start, count)",
    "raw_changes": "SELECT * FROM (VALUES ('modified', NULL, 'src/a.py', 'src/a.py'), ('added', NULL, NULL, 'new.py'), ('deleted', NULL, 'old.py', NULL), ('renamed', 100, 'x.py', 'y.py')) v(change, similarity, path_before, path_after)",
    "overlay_merge": "SELECT * FROM (VALUES ('k1', 'one'), ('k2', 'zwei'), ('k4', 'four')) v(key, name)",
    "import_decisions": "SELECT * FROM (VALUES ('same.md', 'duplicate', 'doc-a'), ('next.md', 'new_revision', 'doc-a'), ('own.md', 'new_asset', 'doc-z'), ('doc-b', 'possible_revision', 'doc-b'), ('new.md', 'new_asset', 'new.md')) v(name, decision, asset_key)",
    "promotion_gate": "SELECT * FROM (VALUES (1, ''), (2, 'not-confirmed,not-active,not-verified,unsupported-kind,stale-source,no-evidence'), (3, 'missing-evidence'), (4, 'already-promoted')) v(candidate_id, blocked)",
    "budget_merge": "SELECT * FROM (VALUES ('requests', 100::BIGINT, true), ('tokens', 5, false)) v(name, value, refused)",
    "gap_reconcile": "SELECT * FROM (VALUES ('a', NULL, 'open'), ('b', 'open', 'open'), ('c', 'accepted', 'open'), ('d', 'dismissed', 'dismissed'), ('e', 'open', 'resolved'), ('f', 'dismissed', 'stale'), ('g', 'accepted', 'resolved')) v(detection_fingerprint, before, after)",
    "decisions": "SELECT * FROM (VALUES ('a', 'supersede', 'active', 'superseded', true), ('a', 'withdraw', 'active', NULL, false), ('b', 'withdraw', 'withdrawn', NULL, false), ('z', 'withdraw', NULL, NULL, false)) v(id, decision, before, after, accepted)",
    "heading_paths": "SELECT * FROM (VALUES (1, ''), (2, 'A'), (3, 'A'), (4, 'A/B'), (5, 'A'), (6, 'A/D'), (7, ''), (8, 'E')) v(n, path)",
    "mermaid_diagram": """SELECT 'flowchart LR' || chr(10) || '  a_py["a.py"]' || chr(10) || '  b_py["b.py"]' || chr(10) || '  a_py --> b_py' AS diagram""",
    "case_staleness": "SELECT * FROM (VALUES (1, true, 'b'), (2, false, ''), (3, true, 'z')) v(case_id, stale, changed)",
}
