"""Language identification by cross-parsing against suffix automata of labelled text.

A suffix automaton of each language's training text tells how far a text can be read before it leaves every
substring of that text. Reading greedily cuts a text into phrases; a language costs its phrases times the bits that name
a place in its training text, and the language of least cost wins. Texts are read whole, as lower-cased letters with
one space between runs of them. Blocks of BLOCK characters are read at once, each as if a phrase began there, and are
read again from the state in which the block before ends until no state changes, so that phrases run on over
the cuts and their number is that of reading the text from its first to its last character.

The training texts are a bounded sample: of each language the documents with the smallest hashes of doc_id, at most
TRAIN_DOCS, as many as fit in TRAIN_CHARS characters (the first is taken in any case, cut to that size), or in an
equal share of TRAIN_TOTAL where there are so many languages that theirs come to more. Only these texts reach the
driver. More text would only make the automata larger; everything is then predicted with them. Every letter of the
training texts has a code of its own; where a table of all moves would take more than DENSE_BYTES, they are looked up in
a sorted list.

Null texts and texts without a letter are `und` with score 0, as is everything where nothing could be learnt. Ties go to
the first language in order. Rows are predicted each. The prediction is one new column, so extra columns of any name are
kept. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget_others, free, packed

TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL = 200, 30_000, 1_200_000
#: Characters of a block, blocks read at once, and how often blocks are read again before the rest is read one by one.
BLOCK, LANES, AGAIN = 512, 4096, 3
#: Rows predicted at once.
ROWS = 500
#: Up to so many bytes the moves are one table.
DENSE_BYTES = 96 << 20
_FLAG = np.uint32(1 << 31)
#: Codes of the alphabet: padding, letters never seen in training, the space; seen letters follow.
PAD, UNSEEN, SPACE = 0, 1, 2

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "u4")


def transitions(text: list[int]) -> list[dict[int, int]]:
    """{code: next} by state of the suffix automaton of a sequence; state 0 is dead, state 1 the start."""
    step: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in text:
        cur = len(step)
        step.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def automaton(text: list[int], alphabet: int) -> np.ndarray:
    """next[state, code] of the suffix automaton of a sequence."""
    step = transitions(text)
    out = np.zeros((len(step), alphabet), "u4")
    for s, to in enumerate(step):
        for c, t in to.items():
            out[s, c] = t
    return out


@dataclass
class Model:
    """Languages, the code of every code point, one table of all automata, their starts, and the bits of a phrase.

    Beyond DENSE_BYTES the table has the moves that end no phrase, at the sorted state * width + code in keys, and
    restarts those that do, by language and code.
    """

    langs: list[str]
    codes: dict[int, int]
    table: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    keys: np.ndarray | None = None
    restarts: np.ndarray | None = None

    @property
    def width(self) -> int:
        return len(self.codes) + 3

    def code_table(self) -> np.ndarray:
        out = np.where(_letters(), UNSEEN, SPACE).astype(np.min_scalar_type(self.width))
        for point, code in self.codes.items():
            out[point] = code
        return out


def build(texts: dict[str, str]) -> Model:
    """A model of {language: training text}."""
    langs = sorted(texts)
    read = {lang: points(texts[lang]) for lang in langs}
    seen = np.unique(np.concatenate([*read.values(), np.empty(0, "u4")])).astype("u4")
    seen = [int(x) for x in seen if _letters()[x]]
    codes = {x: i + 3 for i, x in enumerate(seen)}
    model = Model(langs, codes, np.empty(0, "u4"), np.empty(0, "u4"), np.empty(0))
    table = model.code_table()
    if 8 * model.width * sum(map(len, read.values())) > DENSE_BYTES:  # an automaton has up to two states a character
        return _sparse(model, {lang: squeezed(table[read[lang]]).tolist() for lang in langs})
    tables, starts, bits, base = [], [], [], 0
    for lang in langs:
        seq = squeezed(table[read[lang]])
        own = automaton([c if c != UNSEEN else PAD for c in seq.tolist()], model.width)
        # where reading stops a phrase ends and the next starts with the same character
        restart = np.where(own[1] == 0, 1, own[1])
        moves = np.where(own == 0, restart[None, :] + np.uint32(base) | _FLAG, own + np.uint32(base))
        moves[:, UNSEEN] = np.uint32(1 + base) | _FLAG
        moves[:, PAD] = np.arange(len(own)) + base
        tables.append(moves.astype("u4"))
        starts.append(base + 1)
        bits.append(np.log2(len(seq) + 2))
        base += len(own)
    model.table = np.concatenate(tables).ravel() if tables else model.table
    model.starts, model.bits = np.array(starts, "u4"), np.array(bits)
    return model


def _sparse(model: Model, read: dict[str, list[int]]) -> Model:
    keys, moves, starts, bits, base = [], [], [], [], 0
    model.restarts = np.empty((len(read), model.width), "u4")
    for k, seq in enumerate(read.values()):
        own = transitions(seq)
        edges = [(base + s, c, base + t) for s, to in enumerate(own) for c, t in sorted(to.items())]
        state, code, to = np.array(edges, "u8").reshape(-1, 3).T
        keys.append(state * np.uint64(model.width) + code)
        moves.append(to.astype("u4"))
        # where reading stops a phrase ends and the next starts with the same character
        model.restarts[k] = np.uint32(base + 1) | _FLAG
        for c, t in own[1].items():
            model.restarts[k, c] = np.uint32(base + t) | _FLAG
        starts.append(base + 1)
        bits.append(np.log2(len(seq) + 2))
        base += len(own)
    model.keys, model.table = np.concatenate(keys), np.concatenate(moves)
    model.starts, model.bits = np.array(starts, "u4"), np.array(bits)
    return model


def squeezed(codes: np.ndarray) -> np.ndarray:
    """Without repeated, first and last spaces."""
    space = codes == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(codes):
        keep[0] = not space[0]
    out = codes[keep]
    return out[:-1] if len(out) and out[-1] == SPACE else out


def phrases(model: Model, lanes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase ends and last states by language and lane. lanes: one block a row, padded; state: the first states."""
    ends = np.zeros(state.shape, "u4")
    width, table, low = np.uint32(model.width), model.table, ~_FLAG
    for column in np.ascontiguousarray(lanes.T):
        move = table.take(state * width + column) if model.keys is None else _looked_up(model, state, column)
        ends += move >> np.uint32(31)
        state = move & low
    return ends, state


def _looked_up(model: Model, state: np.ndarray, column: np.ndarray) -> np.ndarray:
    key = state.astype("u8") * np.uint64(model.width) + column
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    move = np.where(model.keys[at] == key, model.table[at], model.restarts[:, column])
    return np.where(column == PAD, state, move)


def read_on(model: Model, lanes: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Phrase ends by language and lane, where every lane but those that are new goes on in the state that the lane before ends in."""
    first = np.repeat(model.starts[:, None], len(lanes), 1)
    ends, last = np.empty(first.shape, "u4"), np.empty(first.shape, "u4")

    def read(own: np.ndarray) -> None:
        for i in range(0, len(own), LANES):
            part = own[i : i + LANES]
            ends[:, part], last[:, part] = phrases(model, lanes[part], first[:, part])

    def stale() -> np.ndarray:
        after = np.where(new[None, 1:], first[:, 1:], last[:, :-1])
        return 1 + np.flatnonzero((after != first[:, 1:]).any(0))

    todo = np.arange(len(lanes))
    for _ in range(AGAIN + 1):
        read(todo)
        todo = stale()
        if not len(todo):
            return ends
        first[:, todo] = last[:, todo - 1]
    # such texts hardly ever come back into step: the rest is read in order
    waiting = set(todo.tolist())
    while waiting:
        k = min(waiting)
        waiting.discard(k)
        for lang in range(len(model.starts)):
            ends[lang, k], last[lang, k] = _read_one(model, lanes[k].tolist(), lang, int(first[lang, k]))
        if k + 1 < len(lanes) and not new[k + 1] and (first[:, k + 1] != last[:, k]).any():
            first[:, k + 1] = last[:, k]
            waiting.add(k + 1)
    return ends


def _read_one(model: Model, codes: list[int], lang: int, state: int) -> tuple[int, int]:
    """Phrase ends and last state of one block in one language."""
    table, width, n = memoryview(model.table), model.width, 0
    keys = None if model.keys is None else memoryview(model.keys)
    for c in codes:
        if c == PAD:
            continue
        if keys is None:
            move = table[state * width + c]
        else:
            at = bisect.bisect_left(keys, state * width + c)
            move = table[at] if at < len(keys) and keys[at] == state * width + c else int(model.restarts[lang, c])
        n += move >> 31
        state = move & 0x7FFFFFFF
    return n, state


def costs(model: Model, texts: list[str | None]) -> np.ndarray:
    """Bits of each text in each language, and as the last column its characters."""
    table = model.code_table()
    out = np.zeros((len(texts), len(model.langs) + 1))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    n = 0

    def flush() -> None:
        nonlocal held, owner, n
        if n:
            lanes, own = np.concatenate(held), np.concatenate(owner)
            new = np.concatenate(([True], own[1:] != own[:-1]))
            ends = read_on(model, lanes, new) + new  # the last phrase of a text ends with it
            np.add.at(out, own, np.concatenate([ends.T * model.bits, np.zeros((len(own), 1))], 1))
        held, owner, n = [], [], 0

    for i, text in enumerate(texts):
        seq = squeezed(table[points(text or "")])
        out[i, -1] = len(seq)
        if len(seq):
            rows = -(-len(seq) // BLOCK)
            lanes = np.zeros(rows * BLOCK, table.dtype)
            lanes[: len(seq)] = seq
            held.append(lanes.reshape(rows, BLOCK))
            owner.append(np.full(rows, i))
            n += rows
            if n >= LANES:
                flush()
    flush()
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, train_total: int = TRAIN_TOTAL) -> Model:
    """A model of the labelled documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = rows.select("lang").distinct().count()
    room = max(1, min(train_chars, train_total // max(1, langs)))
    # pre-cut by hash before the sizes are summed up, so that a hot language costs train_docs rows a task
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "tie")
    first = rows.select("doc_id", "lang", F.char_length("text").alias("size"), F.xxhash64("text").alias("tie")).withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= train_docs)
    used = F.sum("size").over(Window.partitionBy("lang").orderBy("nth"))
    chosen = first.withColumn("used", used).where((F.col("nth") == 1) | (F.col("used") <= room)).select("lang", "doc_id", "tie", "nth")
    texts: dict[str, str] = {}
    keyed = rows.select("doc_id", "lang", F.xxhash64("text").alias("tie"), F.substring("text", 1, room).alias("text"))
    own = keyed.join(F.broadcast(chosen), ["lang", "doc_id", "tie"]).groupBy("lang", "nth").agg(F.first("text").alias("text"))
    for r in sorted(own.collect(), key=lambda r: (r["lang"], r["nth"])):
        texts[r["lang"]] = texts.get(r["lang"], "") + "\n" + r["text"]
    return build({lang: t[: room + 1] for lang, t in texts.items() if any(c.isalpha() for c in t)})


#: What a prediction holds.
PREDICTION = "lang_pred string, score double, bits_per_char double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a struct `prediction`: lang_pred, score (0.5 to 1: the share of the second cost in the two least) and bits_per_char.

    Where docs has a column of that name the new one is the last, with underscores after its name.
    """
    langs = np.array([*model.langs, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, predicted(part.column(1).to_pylist())], ["row", "text", "made"])

    def predicted(texts: list[str | None]) -> pa.Array:
        found = costs(model, texts)
        chars, bits = found[:, -1], found[:, :-1]
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & bool(model.langs)
        if model.langs:
            best = np.where(known, bits.argmin(1), len(model.langs))
            two = np.sort(np.concatenate([bits, np.full((len(bits), 1), np.inf)], 1), 1)[:, :2]
            one = np.isinf(two[:, 1])
            share = np.where(one, 1.0, np.where(one, 1.0, two[:, 1]) / np.where(one, 1.0, np.maximum(two.sum(1), 1e-9)))
            per = np.where(known, two[:, 0] / np.maximum(chars, 1), 0.0)
        else:
            best, share, per = np.full(len(texts), 0), np.zeros(len(texts)), np.zeros(len(texts))
        return pa.StructArray.from_arrays([pa.array(langs[best].tolist(), pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(per)], ["lang_pred", "score", "bits_per_char"])

    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(packed(docs, kept).alias("row"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(run, T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("made", T.StructType.fromDDL(PREDICTION))]))
    return got.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], F.col("made").alias(free("prediction", docs.columns)))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model of the same table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(rows, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "prediction.lang_pred", "prediction.score", "prediction.bits_per_char")
