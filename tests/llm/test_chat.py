import random

from pyspark.sql import functions as F

from foretell.llm import chat as c
from foretell.llm import queries


def brute_fold(events):
    """Messages by walking the log event by event."""
    state = {}
    for conv, message, seq, kind, role, text in sorted(events, key=lambda e: (e[2] is not None, e[2] or 0, e[3], e[5] or "")):
        m = state.setdefault((conv, message), {"text": "", "role": "", "gone": False})
        m["role"] = role if role is not None else m["role"]
        if kind == "delta":
            m["text"] += text or ""
        else:
            m["gone"], m["text"] = kind == "delete", text or ""
    return {k: (m["role"], m["text"]) for k, m in state.items() if not m["gone"]}


def test_fold_against_a_walk_through_the_log(spark):
    rng = random.Random(2)
    events = []
    for conv in range(12):
        for message in range(rng.randrange(1, 5)):
            for k in range(rng.randrange(1, 9)):
                kind = rng.choice(["delta"] * 5 + ["open", "edit", "regenerate"] + ["delete"] * (k > 4))
                events.append((conv, message, conv * 1000 + k * 7 + message, kind, rng.choice([None, "user", "assistant"]) if kind != "delta" else None, None if rng.random() < 0.1 else f"t{k}<\\"))
    events += events[::5]  # repeated events, and ties of one seq
    events += [(c, m, q, "edit", None, "tie") for c, m, q, *_ in events[::7]]
    log = spark.createDataFrame(events, "conv_id long, message int, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in c.fold(log.repartition(5)).collect()}
    # Deltas after a deletion belong to a message that is gone.
    assert got == brute_fold(events)


def test_round_trip_of_hostile_texts(spark):
    texts = ["", None, "\\", "<", "\\1", "\\0\\1<", "</turn>\n", '<turn role="assistant">', "a\n\nb", "é\U0001f600", "\\### Assistant: </turn> ok", "\\\\0"]
    roles = ["user", "assistant", None, 'x">y', "\\2<", "system"]
    rows = [(n % 3 if n % 7 else None, n % 5 if n % 11 else None, roles[n % 6], texts[n % 12]) for n in range(90)] + [(1, 1, "user", "twice")] * 2 + [(50, 0, "user", "x " * 100000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = c.format_conversations(table.withColumn("seq", F.lit(3)))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.formatted, [tuple(s) for s in r.spans]) for r in done.select("*", c.read_back(F.col("formatted")).alias("turns"), c.loss_spans(F.col("formatted")).alias("spans")).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        turns, formatted, spans = got[conv]
        assert turns == want
        masked = [formatted[a:z].replace("\\1", "<").replace("\\0", "\\") for a, z in spans]
        assert masked == [t for r, t in want if r == "assistant"]
    live = c.live_log(table)
    assert {r.kind for r in live.collect()} == {"open", "delta", "edit", "regenerate", "delete"}
    assert {r.conv_id: r.formatted for r in c.format_conversations(table, c.live_log).collect()} == {k: v[1] for k, v in got.items()}
    assert c.format_conversations(table.limit(0)).collect() == [] and c.format_conversations(table.limit(0), c.live_log).collect() == []


def test_query_has_the_extra_conversation(spark, sf_dir):
    row = queries.op5_chat_formatting(spark, sf_dir).where("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(r"\### Assistant: </turn> ok")
