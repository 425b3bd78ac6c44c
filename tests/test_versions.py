"""Java segments, repository heads, ancestry, broken and affected traces."""

from factlode.operators import overlay, policies, trace
from factlode.sources import java, versions
from tests.test_knowledge import world

SOURCE = '''package a.b;
/** class Not { } */
@Service("x")
public class Outer {
  private String s = "{ not a brace";
  public Outer(int x) { init(x); }
  @Override
  public List<String> go(Map<String, Integer> m) throws Ex {
    if (m.isEmpty()) { run(() -> { call(); }); }
    return null;
  }
  void go() { }
  static class Inner { int f() { return g(1); } }
}
'''


def test_java(spark):
    df = spark.createDataFrame([("A.java", SOURCE), ("b.java", "// nothing\n")], "path string, text string")
    got = {r.segment_key: r for r in java.parse(df).collect()}
    assert set(got) == {"Outer", "Outer.Outer", "Outer.go", "Outer.go@12", "Outer.Inner", "Outer.Inner.f", "lines:1"}
    assert (got["Outer"].annotations, got["Outer"].start_line, got["Outer"].end_line, got["Outer"].package) == (["Service"], 3, 14, "a.b")
    assert (got["Outer.Outer"].segment_type, got["Outer.Outer"].invokes) == ("constructor", ["init"])
    assert (got["Outer.go"].start_line, got["Outer.go"].end_line, got["Outer.go"].annotations) == (7, 11, ["Override"])
    assert {"run", "call", "isEmpty"} <= set(got["Outer.go"].invokes) and got["Outer.Inner.f"].invokes == ["g"]


def test_head(spark):
    sha, other = "a" * 40, "b" * 40
    rows = lambda *r: spark.createDataFrame(list(r), "path string, text string")
    assert tuple(versions.head(rows(("HEAD", "ref: refs/heads/main\n"), ("refs/heads/main", sha + "\n"), ("packed-refs", f"# pack\n{other} refs/heads/main\n"))).first()) == ("main", sha)
    assert tuple(versions.head(rows(("HEAD", "ref: refs/heads/x/y\n"), ("packed-refs", f"{other} refs/heads/x/y\n"))).first()) == ("x/y", other)
    assert tuple(versions.head(rows(("HEAD", sha))).first()) == (None, sha)


def test_overlay_reconcile(spark):
    commits = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)] + [("c39", "s1"), ("s1", "c3"), ("z1", "c5")], "commit string, parent string")
    overlays = spark.createDataFrame([("a", "s1", "c39", True), ("b", "z1", "c39", True), ("c", "c2", "c39", False), ("d", "c39", "c39", True), ("e", "c9", "s1", True)], "overlay_id string, head string, target string, clean boolean")
    assert {r.overlay_id: r.state for r in overlay.reconcile(overlays, commits).collect()} == {"a": "merged", "b": "ready", "c": "ready", "d": "merged", "e": "ready"}


def test_broken_and_affected(spark):
    policy = policies.builtin("generic-engineering")
    entities, relations = world(spark)
    hops, _ = trace.stage_edges(entities, relations, policy)
    roots = lambda *ids: {r.id for r in trace.affected_roots(spark.createDataFrame([(i,) for i in ids], "id string"), hops, policy).collect()}
    assert roots("T1") == {"R1", "R2"} and roots("C2") == {"R2", "R3"} and roots("R1") == {"R1"} and roots("C3") == set()
    steps = spark.createDataFrame([("p1", "D1", "1"), ("p1", "C1", "2"), ("p2", "T2", "8"), ("p3", "gone", "1"), ("p3", "T2", "8"), ("p4", "C1", "zz")], "path_id string, node_id string, relation_id string")
    assert {(r.path_id, r.status) for r in trace.broken_steps(steps, entities, relations).collect()} == {("p2", "stale"), ("p3", "broken"), ("p4", "broken")}
