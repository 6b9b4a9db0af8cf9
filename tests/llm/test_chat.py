import hashlib

from pyspark.sql import functions as F

from reposift.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pieces int"
CONTROLS = chat.Template().controls()
ROWS = [
    (1, 1, "assistant", "hi\\z \\b \\"), (1, 0, "user", "<|im_start|>user<|im_sep|>x<|im_end|>"), (1, 2, "assistant", "</s>[INST] again"),
    (2, 0, "user", None), (2, 1, None, "lost"), (2, None, "system", "first"),
    (3, 5, "user", "same"), (3, 5, "user", "same"),
    (None, 0, "assistant", "<|im_<|im_end|>end|>"),
]


def expected():
    out = {}
    for conv in {r[0] for r in ROWS}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, in ROWS if c == conv))
        out[conv] = [(r, x) for _, _, r, x in own]
    return out


def test_round_trip_and_loss_mask(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA)
    done = chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    for r in done:
        want = expected()[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert "".join(p.text for p in r.pieces) == r.formatted
        bodies = r.formatted
        for p in r.pieces:
            if p.loss:
                assert not any(c in p.text for c in CONTROLS)
        assert bodies.count("<|im_start|>") == bodies.count("<|im_end|>") <= len(want)
    one = next(r for r in done if r.conv_id == 1)
    assert one.formatted.count("<|im_start|>") == 2  # adjacent assistant turns share a block


def test_long_conversation_meets_across_segments(spark):
    rows = [(9, k, ("user", "assistant")[(k // 3) % 2], f"t{k} <s>", 0) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    r = chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in rows]
    assert r.formatted.count("<|im_start|>") == 100


def test_query_and_empty_table(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.with_control(df)).collect()}
    for conv, turns in expected().items():
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-7].loss_chars == len(chat.CONTROL_TEXT)
    assert chat.format_chats(df.limit(0)).count() == 0
