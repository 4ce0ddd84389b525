"""Chat windows: exact reading back, budgets, masks and odd rows."""

import hashlib
import random

from pyspark.sql import functions as F

from parqyard.llm import chat_windows


def _rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(30):
        if rnd.random() < 0.5:
            rows.append((c, 0, "system", "be <|end|> kind & brief |> " * rnd.randint(1, 3)))
        for t in range(1, rnd.randint(2, 25)):
            rows.append((c, t, "user" if t % 2 else "assistant", " ".join(rnd.choice(("a", "&amp;", "<|end|>", "&lt;", "</s>[INST]", "|", "é", "\n")) for _ in range(rnd.randint(0, 40)))))
    rows += [(100, 0, "assistant", None), (100, None, None, "first"), (101, 1, "user", ""), (101, 1, "user", ""), (None, 0, "user", "no id"), (102, 0, "assistant", "x " * 30000), (102, 1, "user|<&", "odd role"), (103, 0, "system", "alone"), (104, 1, "user", "q"), (104, 5, "system", "late system")]
    return rows


def test_round_trip_masks_and_budget(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("n", F.lit(1))
    budget, history = 120, 30
    got = chat_windows.windows(df.repartition(4), budget, history)
    windows = got.collect()
    back = {}
    for r in chat_windows.turns_of(got).collect():
        back.setdefault(r["conv_id"], []).append((r["window"], r["place"], r["role"], r["text"]))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest())):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [x[2:] for x in sorted(v)] for c, v in back.items()} == want
    tokens = lambda t: len(t.split()) + 2
    unescape = lambda s: s.replace("&vert;", "|").replace("&lt;", "<").replace("&amp;", "&")
    losses = {}
    for w in sorted(windows, key=lambda w: w["window"]):
        turns = [x for x in w["formatted"].split("<|end|>") if x]
        assert len(turns) == w["n_turns"]
        for s in w["loss_spans"]:
            losses[w["conv_id"]] = losses.get(w["conv_id"], "") + unescape(w["formatted"][s["start"] : s["start"] + s["length"]])
        own = w["n_turns"] - w["n_repeated"]
        assert own >= 1 and (w["n_tokens"] <= budget or own == 1 or w["conv_id"] in (102,))
        if w["window"] and want[w["conv_id"]][0][0] == "system":
            assert turns[0].startswith("<|system|>")
    assert losses == {c: x for c, v in want.items() if (x := "".join(t for r, t in v if r == "assistant")) or any(r == "assistant" for r, _ in v)}
    repeated = [w for w in windows if w["n_repeated"] > 1]
    assert repeated and all(sum(tokens(unescape(x.split("|>", 1)[1])) for x in w["formatted"].split("<|end|>")[1 : w["n_repeated"]]) <= history for w in repeated if want[w["conv_id"]][0][0] == "system")


def test_windows_are_filled(spark):
    """Of a long conversation of short turns, all windows but the last are mostly full, and none exceeds the budget."""
    rnd = random.Random(4)
    rows = [(1, t, "user" if t % 2 else "assistant", "w " * rnd.randint(5, 40)) for t in range(1200)]
    got = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    sizes = [w["n_tokens"] for w in sorted(got, key=lambda w: w["window"])]
    assert max(sizes) <= 512 and sum(sizes[:-1]) / len(sizes[:-1]) > 420 and sum(w["n_turns"] - w["n_repeated"] for w in got) == 1200


def test_no_rows(spark):
    assert chat_windows.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
