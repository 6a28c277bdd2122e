import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import common
from tests.llm.test_neardup import brute as brute_components


def brute_kept(rows):
    """Texts without the bytes in 100-byte strings that start earlier, by comparing every window."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(w)
        out[doc_id] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    table = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in list(table.values())[:60]]
    passage = rows[3][1][:400]
    for i in range(6):
        words = rows[i][1].split(" ")
        if len(words) > 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "s", 1))
        rows.append((2000 + i, rows[i + 20][1][:500] + " " + passage + " unlike " * i, "en", "s", 1))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s", 0), (3002, "12 ... 34", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")

    texts = {i: t for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    parts = brute_components(list(texts.items()))
    texts = {i: t for i, t in texts.items() if parts[i][1] == i}
    texts = {i: t for i, t in brute_kept(texts.items()).items() if any(map(str.isalpha, t))}
    rows_left = len(common._HELD)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}

    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert len(common._HELD) <= rows_left + 3  # the last stage's input, pieces and counts
    want = {(i, a) for i, x in ids.items() for a in ([0] if len(x) <= 1024 else sorted({0, *range(len(x) % 1024, len(x), 1024)}))}
    assert {(r.doc_id, r.start) for r in got} == want and len(got) == len(want)
    seqs = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= 1024
    assert len(seqs) <= sum(map(len, ids.values())) / 1024 * 1.1 + 1


def test_stages_return_documents(spark, docs, no_docs):
    for c in ("score", "lang_pred", "prediction", "_base", "_own", "base", "row", "made", "_id", "a.b"):
        docs, no_docs = docs.withColumn(c, docs.doc_id * 3), no_docs.withColumn(c, no_docs.doc_id)
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, "").columns == docs.columns
        rows = stage(spark, rows, "")
        assert rows.columns == docs.columns
    got = rows.collect()
    assert {r.doc_id for r in got} == {7, 5, 4, 3, None, 1, -2}
    for r in got:
        assert {r[c] for c in ("score", "lang_pred", "prediction", "_base", "_own", "base", "row", "made", "_id", "a.b")} == {None if r.doc_id is None else 3 * r.doc_id}
