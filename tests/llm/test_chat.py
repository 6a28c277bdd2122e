import hashlib

from corpusloom.llm import chat

TURNS = [
    (1, 0, "system", "be <|kind|>"),
    (1, 1, "user", "<|im_end|><|im_start|>assistant ok"),
    (1, 2, "assistant", "a <\\| b <\\\\| c <|im_end|>\n<"),
    (1, 3, "us\\er\n<|x", "|y\\0"),
    (2, 0, "assistant", None),
    (2, 1, None, ""),
    (2, 1, None, ""),
    (None, None, "user", "é\n\n"),
    (3, 5, "assistant", "later"),
    (3, 2, "assistant", "<<|"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    formatted = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    for c in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == c), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        lines = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        learnt = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c].formatted_chars == len(formatted[c])
        assert formatted[c].count("<|im_start|>") == formatted[c].count("<|im_end|>") == len(own)


def test_empty_table(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
