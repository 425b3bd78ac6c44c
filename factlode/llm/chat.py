"""Chat formatting into budgeted, turn-aligned windows with a loss mask.

Prefix sums of turn tokens deal the turns of a conversation into spans. A window is the conversation's system
turn, a limited history before the span, and the span. Only assistant turns of the span itself are under the
loss mask, so a text that is repeated as context is never a target twice.

A turn is written <turn>role<body>text</turn>. In roles and texts a backslash becomes \\b and "<" becomes \\l,
so no control string can stand inside a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import prefix_sums

OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>"
#: Tokens in a window, and those and the turns of repeated history in it.
BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 2
#: A turn's tokens are estimated as its characters / 4 and so many for its markers.
MARKER_TOKENS = 8


def escape(text: Column) -> Column:
    """Text without "<"; undone by unescape."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The text that was escaped: after escaping, a backslash always begins \\b or \\l."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def token_estimate(text: Column) -> Column:
    """Tokens of a turn."""
    return (F.floor(F.char_length(text) / 4) + MARKER_TOKENS).cast("long")


def format_windows(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, tokens=token_estimate) -> DataFrame:
    """Windows of conversations: conv_id, window, n_context, formatted, loss.

    turns: (conv_id, turn, role, text). Turns are ordered by turn (null first), role, text; null roles and
    texts are empty; a null conv_id is a conversation of its own; repeated rows stay. window ascends within a
    conversation; the first n_context turns of formatted are repeated context; loss has (start, end) code points
    of formatted, end exclusive. A window has at most budget tokens: the span takes what the system turn and the history
    leave, and history gives way first where that would be less than budget / 4. A system turn that leaves less even so isn't
    repeated. Only a span of a single turn may exceed the budget: turns stay whole, and it crosses a border of the prefix sums.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"n": F.row_number().over(order), "until": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.first(F.when((F.col("n") == 1) & (F.col("role") == "system"), F.struct("role", "text", "tokens")))
    t = t.withColumn("system", lead.over(whole))
    least = budget // 4
    t = t.withColumn("repeated", F.when(F.col("system.tokens") <= budget - least, F.col("system")))
    fixed = F.coalesce("repeated.tokens", F.lit(0))
    t = t.withColumn("history_room", F.least(F.lit(history_tokens), F.lit(budget - least) - fixed).cast("long"))
    room = (F.lit(budget) - F.col("history_room") - fixed).cast("long")
    first_cell, last_cell = F.floor((F.col("until") - F.col("tokens")) / room), F.floor((F.col("until") - 1) / room)
    t = t.withColumn("span", (first_cell * 2 + (first_cell != last_cell).cast("long")).cast("long"))
    before, spent = [], F.lit(0)
    t = t.withColumn("opens", F.coalesce(F.lag("span").over(order) != F.col("span"), F.lit(True)))
    lags = {f"lag{i}": F.lag(F.struct("n", "role", "text", "tokens"), i).over(order) for i in range(1, history_turns + 1)}
    t = t.withColumns(lags)
    for i in range(1, history_turns + 1):
        spent = spent + F.col(f"lag{i}.tokens")
        usable = F.col("opens") & F.col(f"lag{i}").isNotNull() & (spent <= F.col("history_room")) & ~((F.col(f"lag{i}.n") == 1) & F.col("system").isNotNull())
        before.append(F.when(usable, F.struct(F.col(f"lag{i}.role").alias("role"), F.col(f"lag{i}.text").alias("text"))))
    history = F.filter(F.array(*reversed(before)), lambda x: x.isNotNull()) if before else F.lit([]).cast("array<struct<role:string,text:string>>")
    t = t.select("conv_id", "span", "n", "role", "text", F.col("repeated").alias("system"), F.when(F.col("opens"), history).alias("history"))
    w = t.groupBy("conv_id", "span").agg(
        F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("own"),
        F.first("history", ignorenulls=True).alias("history"),
        F.first("system").alias("system"),
    )
    repeats = F.col("system").isNotNull() & (F.element_at("own", 1)["n"] > 1)
    none = F.lit([]).cast("array<struct<role:string,text:string>>")
    w = w.withColumn("context", F.concat(F.when(repeats, F.array(F.struct("system.role", "system.text"))).otherwise(none), F.coalesce("history", none)))
    escaped = lambda role, text: F.struct(escape(role).alias("role"), escape(text).alias("text"))
    w = w.withColumn("all", F.concat(F.transform("context", lambda c: escaped(c["role"], c["text"])), F.transform("own", lambda c: escaped(c["role"], c["text"]))))
    w = w.withColumns({"n_context": F.size("context"), "written": F.transform("all", lambda c: F.concat(F.lit(OPEN), c["role"], F.lit(BODY), c["text"], F.lit(CLOSE)))})
    w = w.withColumn("ends", prefix_sums(F.transform("written", lambda x: F.char_length(x))))

    def target(c: Column, i: Column) -> Column:
        end = F.get("ends", i) - len(CLOSE)
        span = F.struct((end - F.char_length(c["text"])).alias("start"), end.alias("end"))
        return F.when((i >= F.col("n_context")) & (c["role"] == "assistant"), span)

    loss = F.filter(F.transform("all", target), lambda s: s.isNotNull())
    return w.select("conv_id", F.col("span").alias("window"), "n_context", F.array_join("written", "").alias("formatted"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets parsed from formatted windows alone: conv_id, turns (role, text) without repeats, targets."""
    parts = F.split("formatted", CLOSE, -1)
    pieces = F.transform(F.array(parts), lambda p: F.slice(p, F.col("n_context") + 1, F.size(p) - 1 - F.col("n_context")))[0]

    def parsed(p: Column) -> Column:
        at = F.instr(p, BODY)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, at + len(BODY), F.char_length(p))).alias("text"))

    target = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    read = windows.select("conv_id", "window", F.transform(pieces, parsed).alias("turns"), target.alias("targets"), F.char_length("formatted").cast("long").alias("chars"))
    together = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    return together.select("conv_id", F.flatten(F.transform("all", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("all", lambda w: w["targets"])).alias("targets"), "formatted_chars")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings in its texts, and read the output back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    read = read_back(format_windows(turns.unionByName(extra)))
    loss = F.array_join("targets", "")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
a AS (
  SELECT *, length(text) // 4 + 8 AS tokens, row_number() OVER o AS n,
         19 + length(replace(replace(role, '\', '\b'), '<', '\l')) + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (
  SELECT *, sum(tokens) OVER o AS until, max(CASE WHEN n = 1 AND role = 'system' THEN tokens END) OVER p AS sys_tokens,
         max(CASE WHEN n = 1 AND role = 'system' THEN chars END) OVER p AS sys_chars
  FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY n), p AS (PARTITION BY conv_id)),
r AS (SELECT *, CASE WHEN sys_tokens <= 768 THEN sys_tokens ELSE 0 END AS fixed, CASE WHEN sys_tokens <= 768 THEN sys_chars END AS again FROM b),
s AS (SELECT *, least(256, 768 - fixed) AS history FROM (SELECT * REPLACE (coalesce(fixed, 0) AS fixed) FROM r)),
c AS (SELECT *, CAST(1024 - history - fixed AS BIGINT) AS room FROM s),
d AS (SELECT *, CAST(until - tokens AS BIGINT) // room AS c0, CAST(until - 1 AS BIGINT) // room AS c1 FROM c),
e AS (SELECT *, c0 * 2 + CASE WHEN c0 <> c1 THEN 1 ELSE 0 END AS span FROM d),
f AS (
  SELECT *, coalesce(lag(span) OVER o <> span, true) AS opens, lag(tokens, 1) OVER o AS t1, lag(tokens, 2) OVER o AS t2,
         lag(chars, 1) OVER o AS ch1, lag(chars, 2) OVER o AS ch2
  FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY n)),
g AS (
  SELECT *, chars
    + CASE WHEN opens AND n > 1 THEN coalesce(again, 0) ELSE 0 END
    + CASE WHEN opens AND t1 <= history AND NOT (n = 2 AND sys_tokens IS NOT NULL) THEN ch1 ELSE 0 END
    + CASE WHEN opens AND t1 + t2 <= history AND NOT (n = 3 AND sys_tokens IS NOT NULL) THEN ch2 ELSE 0 END AS out_chars
  FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(out_chars) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""
