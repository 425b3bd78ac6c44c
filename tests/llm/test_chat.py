"""Chat windows: exact round trip, masks, budgets."""

import random

from factlode.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    rnd = random.Random(9)
    bits = ["<turn>", "</turn>", "<body>", "\\", "\\b", "\\l", "\\\\l", "<", "é😀", "word ", "\n", ""]
    out = []
    for c in range(25):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rnd.randint(0, 40)
        out += [(c, t, r, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 400)))) for t, r in enumerate(roles)]
    out += [(90, 0, None, None), (90, 0, "assistant", "tie"), (90, None, "user", "first"), (None, 1, "assistant", "no conversation"), (91, 0, "assistant", "x" * 50000), (92, 5, "user", "twice"), (92, 5, "user", "twice")]
    return out


def test_round_trip(spark):
    rows = conversations()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), budget=600, history_tokens=150).cache()
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == want
    assert {c: list(r.targets) for c, r in back.items()} == {c: [x for r, x in turns if r == "assistant"] for c, turns in want.items()}
    many = 0
    for w in windows.collect():
        turns = w.formatted.split("</turn>")[:-1]
        many += w.n_context > 0
        system = want[w.conv_id][0][0] == "system"
        if system:
            assert turns[0].startswith("<turn>system<body>")
        own = turns[w.n_context :]
        tokens = [len(chat_text(t)) // 4 + chat.MARKER_TOKENS for t in own]
        assert len(own) == 1 or sum(tokens) <= 600 - 150
    assert many > 10


def chat_text(turn):
    return turn.split("<body>", 1)[1].replace("\\l", "<").replace("\\b", "\\")


def test_empty(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x", 1), (1, 1, "assistant", "b", "y", 2)], SCHEMA + ", span string, n int")
    assert chat.read_back(chat.format_windows(df)).first().targets == ["b"]


def test_budget_holds_beside_long_system_turns(spark):
    rnd = random.Random(4)
    rows = []
    for c, system in enumerate((0, 400, 2000, 2368, 3000, 3043, 3044, 6000, 20000)):
        rows.append((c, 0, "system", "s" * system))
        rows += [(c, t, ("assistant", "user")[t % 2], "x" * rnd.choice((10, 100, 600, 900))) for t in range(1, 40)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    tokens = lambda t: len(chat_text(t)) // 4 + chat.MARKER_TOKENS
    repeated = {c: 0 for c in range(9)}
    for w in windows:
        turns = w.formatted.split("</turn>")[:-1]
        own = turns[w.n_context :]
        assert sum(map(tokens, turns)) <= chat.BUDGET or len(own) == 1
        assert sum(map(tokens, turns)) <= chat.BUDGET or w.conv_id >= 5
        repeated[w.conv_id] += w.n_context > 0 and turns[0].startswith("<turn>system")
    assert all(repeated[c] > 3 for c in range(6)) and repeated[6] == repeated[7] == repeated[8] == 0
