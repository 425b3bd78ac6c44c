"""Column functions on small literal rows."""

from pyspark.sql import functions as F

from factlode.functions import facts, text, tokens, vectors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def test_tokens_are_whole(spark):
    body = "call getUserName in orders.created.v2, not getUserNames; ISR ISO ISR user_name"
    assert one(spark, tokens.count_token(F.col("v"), "ISR"), body) == 2
    assert one(spark, tokens.count_token(F.col("v"), "getUserName"), body) == 1
    assert one(spark, tokens.count_token(F.col("v"), "isr", False), body) == 2
    assert one(spark, tokens.count_token(F.col("v"), "orders.created"), body) == 0
    assert one(spark, tokens.match_kind(F.col("v"), "orders.created.v2"), body) == "token"
    assert one(spark, tokens.match_kind(F.col("v"), "User", subword=True), body) == "subword"
    assert one(spark, tokens.match_kind(F.col("v"), "User"), body) is None
    assert one(spark, tokens.count_token(F.col("v"), "x"), None) == 0


def test_subwords(spark):
    assert one(spark, tokens.subword_components(F.col("v")), "getHTTPServer_v10") == sorted(["getHTTPServer", "get", "HTTP", "Server", "v10", "v", "10"])


def test_paths_and_terms(spark):
    assert one(spark, tokens.matches_term(F.col("v"), "/name-check"), "GET /name-check/{id}")
    assert not one(spark, tokens.matches_term(F.col("v"), "/name-check"), "GET /name-checker")
    assert one(spark, tokens.extract_terms(F.col("v")), "what is the review timeout for REQ-NC-017?") == ["REQ-NC-017", "review", "timeout"]
    assert one(spark, tokens.is_exact_token_query(F.col("v")), " 'REQ-1' ")
    assert not one(spark, tokens.is_exact_token_query(F.col("v")), "two words")


def test_line_windows(spark):
    body = "\n".join(str(i) for i in range(1, 11))
    got = one(spark, text.line_windows(F.col("v"), 4, 1), body)
    assert [(w.start_line, w.end_line) for w in got] == [(1, 4), (4, 7), (7, 10)]
    assert got[1].content == "4\n5\n6\n7"
    assert [(w.start_line, w.end_line) for w in one(spark, text.line_windows(F.col("v")), body)] == [(1, 10)]
    assert one(spark, text.line_windows(F.col("v")), None)[0].content == ""


def test_slices_and_excerpts(spark):
    assert one(spark, text.slice_lines(F.col("v"), F.lit(0), F.lit(2)), "a\nb\nc") == "a\nb"
    assert one(spark, text.slice_lines(F.col("v"), F.lit(5), F.lit(9)), "a\nb") == ""
    assert one(spark, text.excerpt(F.col("v")), "// file: a\n// class: b\n  body ") == "body"
    assert one(spark, text.relative(F.col("v"), "/r/x"), "/r/x/src\\a.py") == "src/a.py"
    assert one(spark, text.decode(F.col("v")), bytearray(b"caf\xe9"), "binary") == "café"
    assert one(spark, text.decode(F.col("v")), bytearray("café".encode()), "binary") == "café"


def test_facts(spark):
    got = one(spark, facts.facts(F.col("v")), "timeout 2 s; retry count: 4; column total type int4; a.b = off")
    assert [(f.property, f.value_num, f.value_str, f.value_bool, f.unit) for f in got] == [
        ("timeout", 2000.0, None, None, "ms"), ("retries", 4.0, None, None, ""), ("configuration-value", None, None, False, ""), ("data-type", None, "integer", None, ""),
    ]
    assert one(spark, facts.facts(F.col("v")), None) == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([-1.0, 0.0],)], "v array<float>")
    assert [r.d for r in df.select(vectors.cosine_distance(F.col("v"), [2.0, 0.0]).alias("d")).collect()] == [0.0, 1.0, 2.0]
    a, b = (vectors.hash_vector(t) for t in ("def run(x)", "def run(x)"))
    assert (a == b).all() and abs(float((a * a).sum()) - 1) < 1e-5
