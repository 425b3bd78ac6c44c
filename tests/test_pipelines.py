"""Bundles, projection, mentions, templates and continuous ingest."""

import json

from factlode.operators import projection, structure
from factlode.sources import bundle
from factlode.streaming import ingest


def test_bundle_round_trip_and_damage(spark, tmp_path):
    e = spark.createDataFrame([("b", "B", None), ("a", "A", "é")], "id string, name string, note string")
    r = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "zz")], "id string, source string, target string")
    folder = str(tmp_path / "bundle")
    first = bundle.write({"entities": (e, "id"), "relations": (r, "id")}, folder).collect()
    assert bundle.write({"entities": (e.orderBy("name"), "id"), "relations": (r, "id")}, folder).collect() == first
    assert [json.loads(x.line)["id"] for x in bundle.read(spark, folder, "entities").collect()] == ["a", "b"]
    found = {(f.kind, f.check): f.findings for f in bundle.verify(spark, folder, [("relations", "source", "entities"), ("relations", "target", "entities")]).collect()}
    assert found == {("relations", "reference:target"): 1}
    bad = spark.createDataFrame([('{"id":"a","name":"/home/x/y","note":null}',), ('{"id":"a"}',)], "line string")
    bad.write.mode("overwrite").text(f"{folder}/entities.jsonl")
    found = {(f.kind, f.check) for f in bundle.verify(spark, folder).collect()}
    assert found == {("entities", "manifest"), ("entities", "unique-id"), ("entities", "absolute-path")}


def test_pages_and_merge(spark):
    s = spark.createDataFrame([("P", 2, "Two", None), ("P", 1, "One", "body")], "page string, ordinal int, title string, body string")
    assert bundle.page(s, "mine").first().markdown == "# P\n\n## One\n\nbody\n\n## Two\n\n\n\n## Notes\n\nmine\n"
    rows = spark.createDataFrame([("t", 2, "later"), ("t", 1, "first"), ("u", 3, "only")], "term string, project_order int, definition string")
    assert {(r.term, r.definition) for r in bundle.merge_projects(rows, "term").collect()} == {("t", "first"), ("u", "only")}


def test_projection(spark):
    files = spark.createDataFrame([("a/x.py", "from a.y import go\n\ngo()\n"), ("a/y.py", "def go(): pass\n")], "path string, text string")
    entities, relations = projection.graph_of(structure.scan(files))
    assert {r.canonical_key for r in entities.collect()} == {"component:a/x.py", "component:a/y.py", "symbol:a/y.py#go"}
    assert {(r.source, r.type, r.state, r.confidence) for r in relations.collect()} == {("component:a/y.py", "contains", "explicit", "high"), ("component:a/x.py", "imports", "explicit", "high"), ("component:a/x.py", "calls", "inferred", "medium")}
    todo, gone = projection.refresh_projection(spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string"), spark.createDataFrame([(1, "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), (3, "h")], "id int, text_hash string"))
    assert [r.id for r in todo.collect()] == [2] and [r.id for r in gone.collect()] == [3]


def test_mentions(spark):
    seg = spark.createDataFrame([(1, "See OrderService in src/OrderService.java, REQ-NC-017, GET /x/{id} and retry.max-attempts; JIRA-12")], "segment_id int, content string")
    found = projection.mentions(seg)
    got = {(r.kind, r.mention) for r in found.collect()}
    assert {("symbol", "OrderService"), ("file", "src/OrderService.java"), ("requirement", "REQ-NC-017"), ("endpoint", "GET /x/{id}"), ("config", "retry.max-attempts"), ("code-id", "JIRA-12")} <= got
    index = spark.createDataFrame([("file", "lib/orderservice.java", "f1"), ("symbol", "OrderService", "s1")], "kind string, name string, target string")
    assert {(r.target, r.confidence) for r in projection.candidates(found, index).collect()} == {("f1", "medium"), ("s1", "high")}


def test_templates_cases_and_plans(spark):
    files = spark.createDataFrame([("manage.py", "Python"), ("a/b.py", "Python"), ("w.js", "JavaScript")], "path string, language string")
    deps = spark.createDataFrame([("requirements.txt", "Django")], "path string, dependency string")
    templates = [{"name": "django", "dependencies": ["django"], "languages": ["Python"], "markers": ["manage.py"]}, {"name": "node", "languages": ["JavaScript"], "markers": ["package.json"]}]
    assert [(r.template, r.score) for r in projection.score_templates(templates, deps, files).collect()] == [("django", 7)]
    cases = spark.createDataFrame([(1, [("a", "1"), ("b", "2")]), (2, [("a", "1")]), (3, [])], "case_id int, refs array<struct<path:string,hash:string>>")
    now = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, content_hash string")
    assert {(r.case_id, r.stale, tuple(r.changed)) for r in projection.stale_cases(cases, now).collect()} == {(1, True, ("b",)), (2, False, ()), (3, False, ())}
    runs = spark.createDataFrame([(1, "p", "e", 1), (2, "p", "e", 2)], "revision int, policy string, engine string, finished_at int")
    assert [projection.refresh_plan(runs, *x).first().plan for x in ((2, "p", "e"), (3, "p", "e"), (2, "q", "e"))] == ["noop", "incremental", "full"]
    assert projection.refresh_plan(runs.limit(0), 1, "p", "e").first().plan == "full"
    assert [projection.safe_pattern(p) for p in ("a+", "", "(?<=a)b", "(", r"(a)\1")] == [None, "empty", "look-behind, back-reference, condition or recursion", "doesn't compile", "look-behind, back-reference, condition or recursion"]


def test_continuous_ingest(spark, tmp_path):
    inbox, ledger, marks = (str(tmp_path / d) for d in ("in", "ledger", "marks"))
    (tmp_path / "in").mkdir()

    def arrive(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"path": p, "text": t, "observed": f"2024-01-01T00:00:{s:02d}"}) for p, t, s in rows))
        ingest.run(spark, inbox, ledger, marks).awaitTermination()

    arrive("1.json", ("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "z", 1))
    arrive("2.json", ("a", "y", 5), ("b", "w", 5))
    arrive("3.json", ("a", "x", 9))
    got = sorted((r.path, r.sequence, r.text) for r in ingest.read_ledger(spark, ledger).collect())
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "z"), ("b", 2, "w")]
    ingest.commit_batch(ledger)(ingest.read_ledger(spark, ledger).filter("batch = 2").drop("batch"), 2)
    assert ingest.read_ledger(spark, ledger).count() == 5
