"""Policies, traces of a small graph, governance, evidence and artifacts."""

import pytest
from pyspark.sql import functions as F

from factlode.operators import artifacts, evidence, governance, policies, structure, trace

E = "id string, entity_type string, lifecycle string, authority string, evidence_status string"
R = "id string, source string, target string, type string, state string, lifecycle string, evidence_status string"


def world(spark):
    entities = [
        ("R1", "requirement", "active", "authoritative", "current"), ("R2", "requirement", "active", "unknown", "current"), ("R3", "requirement", "active", "informational", "current"),
        ("D1", "design", "active", "unknown", "current"), ("C1", "code-component", "active", "unknown", "current"), ("C2", "code-component", "active", "unknown", "current"), ("C3", "code-component", "active", "unknown", "current"),
        ("T1", "test-case", "active", "unknown", "current"), ("T2", "test-case", "stale", "unknown", "current"), ("X1", "test-result", "active", "unknown", "missing"),
    ]
    relations = [
        ("1", "D1", "R1", "refines", "explicit"), ("2", "C1", "D1", "implements", "explicit"), ("3", "T1", "C1", "verifies", "explicit"), ("4", "X1", "T1", "evidenced-by", "explicit"),
        ("5", "C1", "R2", "implements", "inferred"), ("6", "C2", "R2", "implements", "inferred"), ("7", "C2", "R3", "partially-implements", "explicit"), ("8", "T2", "C2", "verifies", "explicit"), ("9", "R3", "T1", "calls", "explicit"),
    ]
    return spark.createDataFrame(entities, E), spark.createDataFrame([(*r, "active", "current") for r in relations], R)


def test_trace_of_a_small_graph(spark):
    policy = policies.builtin("generic-engineering", require_authoritative_roots=True)
    entities, relations = world(spark)
    hops, rejected = trace.stage_edges(entities, relations, policy)
    roots = trace.staged(entities, policy).filter("stage = 'requirement'")
    found = trace.paths(trace.chains(roots, hops, policy), policy).cache()
    got = {(r.root_id, r.target_id): (r.path_kind, r.status, r.completeness, r.confidence) for r in found.collect()}
    assert got["R1", "D1"] == ("requirement-to-design", "verified", 0.3333, "low")
    assert got["R1", "T1"] == ("requirement-to-test", "verified", 1.0, "high")
    assert got["R1", "X1"] == ("requirement-to-evidence", "partial", 1.0, "low")
    assert got["R2", "C1"][1] == "ambiguous" and got["R2", "T1"][1] == "ambiguous"
    assert got["R3", "T2"][1] == "stale"
    assert {(r.relation_id, r.reason) for r in rejected.collect()} == {("9", "relation-type")}
    coverage = trace.stage_coverage(roots, found, policy).cache()
    classes = {r.root_id: r["class"] for r in trace.root_classes(coverage).collect()}
    assert classes == {"R1": "fully", "R2": "fully", "R3": "partially"}
    gaps = {(r.root_id, r.gap_type, r.stage) for r in trace.gaps(coverage, found, rejected, hops, policy).collect()}
    assert gaps == {
        ("R1", "missing-evidence", "evidence"), ("R2", "missing-evidence", "evidence"), ("R2", "ambiguous-target", "implementation"), ("R2", "authority-gap", "requirement"), ("R2", "stale-path", "verification"),
        ("R3", "authority-gap", "requirement"), ("R3", "partial-implementation-only", "implementation"), ("R3", "stale-path", "verification"), ("R3", "unsupported-relation", "verification"),
    }
    assert trace.coverage_status(trace.root_classes(coverage), 0, policy).first().status == "warning"
    assert {r.id for r in trace.orphans(entities, hops, policy, ("implementation",)).collect()} == {"C3"}
    assert {(r.start_id, r.node_id) for r in trace.upstream(spark.createDataFrame([("T1",)], "id string"), hops, policy).collect()} == {("T1", "C1"), ("T1", "D1"), ("T1", "R1"), ("T1", "R2")}


def test_policies(spark):
    for name in policies.BUILTIN:
        assert policies.builtin(name).required()[0] == "requirement"
    assert policies.builtin("api-service").checksum != policies.builtin("api-service", max_depth=3).checksum
    stage = lambda name, *types, required=False: {"stage": name, "entity_types": list(types), "required": required}
    hop = lambda a, b: {"from": a, "to": b, "relations": ["x"]}
    first, design = stage("requirement", "a", required=True), stage("design", "b")
    assert policies.read({"stages": [first, design], "transitions": [hop("requirement", "design")]}).required() == ["requirement"]
    for stages, transitions in (([design], []), ([first, stage("verification", "b", required=True)], []), ([first, design], [hop("requirement", "nowhere")]), ([first, design], [hop("design", "requirement")]), ([stage("requirement", required=True)], []), ([], [])):
        with pytest.raises(ValueError):
            policies.read({"stages": stages, "transitions": transitions})


def test_gap_reconcile(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "detection_fingerprint string")
    s = spark.createDataFrame([("b", "open", None), ("c", "accepted", "2020"), ("d", "dismissed", None), ("e", "open", None), ("f", "dismissed", None), ("g", "accepted", "2999")], "detection_fingerprint string, status string, expires_at string")
    got = {r.detection_fingerprint: (r.before, r.after) for r in trace.reconcile_gaps(d, s, F.lit("2024")).collect()}
    assert got == {"a": (None, "open"), "b": ("open", "open"), "c": ("accepted", "open"), "d": ("dismissed", "dismissed"), "e": ("open", "resolved"), "f": ("dismissed", "stale"), "g": ("accepted", "resolved")}


def test_governance(spark):
    objects = spark.createDataFrame([("a", "active"), ("b", "withdrawn"), ("c", "active")], "id string, lifecycle string")
    asked = spark.createDataFrame([("a", "withdraw", "me", ""), ("a", "supersede", "me", ""), ("b", "withdraw", "me", ""), ("z", "withdraw", "me", "")], "id string, decision string, actor string, note string")
    out, ledger = governance.decide(objects, asked, 7)
    assert {(r.id, r.lifecycle) for r in out.collect()} == {("a", "superseded"), ("b", "withdrawn"), ("c", "active")}
    assert sorted((r.id, r.decision, r.accepted) for r in ledger.collect()) == [("a", "supersede", True), ("a", "withdraw", False), ("b", "withdraw", False), ("z", "withdraw", False)]
    entities, relations = world(spark)
    wanted = spark.createDataFrame([("C1", "R1", "implements", ["e"]), ("C1", "C1", "x", []), ("D1", "R1", "refines", ["e"]), ("Q", "T2", "calls", ["e"])], "source string, target string, type string, evidence_ids array<string>")
    got = {(r.source, r.target): set(r.reasons) for r in governance.validate_relations(wanted, entities, relations).collect()}
    assert got == {("C1", "R1"): set(), ("C1", "C1"): {"self-relation", "unknown-type", "no-evidence"}, ("D1", "R1"): {"already-there"}, ("Q", "T2"): {"unknown-source", "unknown-target"}}
    c = spark.createDataFrame([(1, "requirement", "REQ-1", "It  must."), (2, "requirement", "REQ-1", "it must."), (3, "design", "Big Plan", "so")], "candidate_id int, kind string, title string, statement string")
    known = spark.createDataFrame([("design:big-plan", "e0")], "canonical_key string, entity_id string")
    new, claims = governance.promote(c, known, 1)
    assert [(r.canonical_key, r.display_name) for r in new.collect()] == [("requirement:REQ-1", "REQ-1")]
    assert sorted((r.entity_id == "e0", r.promoted_from) for r in claims.collect()) == [(False, 1), (True, 3)]
    assert governance.alias_collisions(spark.createDataFrame([("a", "X y"), ("b", "x  Y"), ("a", "z")], "entity_id string, alias string")).first().entities == ["a", "b"]


def test_evidence(spark):
    ev = spark.createDataFrame([("e1", "r1", 2, 3, None), ("e2", "r2", 1, 1, "x"), ("e3", "zz", 1, 1, "x")], "evidence_id string, revision_id string, start_line int, end_line int, content_hash string")
    import hashlib

    ev = ev.withColumn("content_hash", F.coalesce("content_hash", F.lit(hashlib.sha256(b"b\nc").hexdigest())))
    revs = spark.createDataFrame([("r1", "h1", True), ("r2", "h1", False)], "revision_id string, blob_hash string, current boolean")
    blobs = spark.createDataFrame([("h1", "a\nb\nc\nd")], "blob_hash string, text string")
    got = {r.evidence_id: (r.excerpt, r.intact, r.source_status) for r in evidence.recover(ev, revs, blobs).collect()}
    assert got == {"e1": ("b\nc", True, "current"), "e2": ("a", False, "superseded"), "e3": (None, False, "missing")}
    ids = spark.createDataFrame([("x",), ("y",), ("q",)], "id string")
    nodes = {"asset": spark.createDataFrame([("x",)], "id string"), "entity": spark.createDataFrame([("x",)], "id string"), "segment": spark.createDataFrame([("y",)], "id string")}
    assert {(r.id, r.kind) for r in evidence.resolve(ids, nodes).collect()} == {("x", "entity"), ("y", "segment"), ("q", None)}
    seg = spark.createDataFrame([("t", 1, "s1", "ISR here"), ("t", 2, "s2", "long " * 50), ("t", 3, "s3", "x")], "target_id string, ordinal int, segment_id string, content string")
    terms = spark.createDataFrame([("ISR", "in sync"), ("I", "no")], "term string, definition string")
    r = evidence.context(spark.createDataFrame([("t",)], "target_id string"), seg, terms, 100).first()
    assert (r.text, r.segments, r.terms, r.truncated) == ("ISR here", ["s1"], ["ISR: in sync"], True)


def test_artifacts(spark):
    files = [("src/app/main.py", "from .core import run\n\nif __name__ == '__main__':\n    run()\n"), ("src/app/core.py", "def run():\n    pass\n\ndef walk():\n    helper()\n"), ("src/lib/util.py", "def helper():\n    pass\n")]
    df = spark.createDataFrame(files, "path string, text string")
    rows = structure.scan(df).cache()
    roles = structure.assign_roles(df, [("entry", "annotation", "__main__"), ("library", "path", "(^|/)lib/")])
    arch = {r.module: (r.responsibilities, r.files, r.roles) for r in artifacts.architecture(rows, roles).collect()}
    assert arch == {"src/app": (["run", "walk"], 2, "entry=1"), "src/lib": (["helper"], 1, "library=1")}
    assert sorted((r.path, r.depth) for r in artifacts.flows(rows).collect()) == [("src/app/core.py", 1), ("src/app/main.py", 0), ("src/lib/util.py", 2)]
    assert artifacts.auto_focus(rows) == "src"
    nodes, edges = artifacts.directory_graph(rows, "src")
    assert {(r.node, r.files, r.definitions) for r in nodes.collect()} == {("src/app", 2, 2), ("src/lib", 1, 1)} and [(r.source, r.target, r.weight) for r in edges.collect()] == [("src/app", "src/lib", 1)]
    page = artifacts.callees(structure.call_edges(rows), "src/app/main.py").first()
    assert (page.path, page.fan_out, page.total, page.has_more) == ("src/app/core.py", 1, 1, False)
    assert "flowchart LR" in artifacts.diagram(rows).first().diagram
    facts = structure.facets(df, [("calls", r"\w+\(\)")], cap=2)
    assert facts.count() == 2 and facts.first().truncated
