"""Columnar, cached encoding of texts by their space-delimited chunks, for executors.

Pre-tokenizers cut at white space, so a text's ids are those of its chunks in order. The chunks of a slice of texts
are split and numbered by Arrow, each distinct chunk is encoded once per worker while the cache holds it, and the ids of
the texts are gathered from those of the distinct chunks. A mark after a letter or digit, as a comma, is a word of its
own for every pre-tokenizer here, so the chunk before it is looked up without it.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept per worker, and bytes of text split at once: both bound a worker's memory.
CACHE_CHUNKS = 600_000
SLICE_BYTES = 5_000_000
#: Distinct chunks that a tokenizer encodes in one call.
JOINED = 4000

#: White space other than the space and the line end, and characters that some regular expressions count as such.
_OTHER = "\\t\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
_ODD = f"  |\n\n| \n|\n |[{_OTHER}]"
_BREAK = re.compile("(?<=[^\\s᠎​﻿])([ \n])(?=[^\\s᠎​﻿])")
#: Words of plain letters, which are one word for every pre-tokenizer here, after a space or not.
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive texts of at most so many bytes together, or one longer text; null texts are empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="i8")
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, before + most, "right")) - at)
        part = texts.slice(at, n)
        yield part.cast(pa.large_string()) if int(ends[at + n - 1]) - before > 1 << 28 else part
        at += n


def _mark(texts: pa.Array) -> str:
    """A character that no text holds."""
    return next(c for c in map(chr, range(1, 0xD800)) if not pc.any(pc.match_substring(texts, c)).as_py())


def words(texts: pa.Array) -> pa.Array:
    """Chunks of each text for a pre-tokenizer that drops white space: cut at spaces and line ends."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def spaced(texts: pa.Array) -> pa.Array:
    """Chunks of each text for a byte-level pre-tokenizer, in which a word takes the space before it.

    Such a pre-tokenizer always cuts before a single space and around a single line end between other characters.
    """
    mark = _mark(texts)
    marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{mark} "), "\n", f"{mark}\n{mark}")
    odd = pc.match_substring_regex(texts, _ODD)
    if pc.any(odd).as_py():
        cut = [_BREAK.sub(lambda m: f"{mark} " if m[1] == " " else f"{mark}\n{mark}", t) for t in texts.filter(odd).to_pylist()]
        marked = pc.replace_with_mask(marked, odd, pa.array(cut, texts.type))
    return pc.split_pattern(marked, mark)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + size] one after the other, and where each ends."""
    ends = np.cumsum(sizes, dtype="i8")
    kind = "i4" if max(int(ends[-1]) if len(ends) else 0, len(flat)) < 1 << 31 else "i8"
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return flat[at], ends


class Chunks:
    """The distinct chunks of a slice of texts, the number of every chunk in order, and where each text's chunks end."""

    def __init__(self, texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> None:
        cut = split(texts)
        coded = cut.flatten().dictionary_encode()
        self.distinct = coded.dictionary
        self.codes = coded.indices.to_numpy()
        self.ends = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()

    def gather(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and where each text's ids end, from the ids of the distinct chunks and their numbers."""
        ids, ends = gathered(flat, (np.cumsum(sizes) - sizes)[self.codes], sizes[self.codes])
        return ids, np.concatenate(([0], ends))[self.ends]


def _marked(chunks: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks end in a known mark after a letter or digit, and the last byte of each."""
    size = np.dtype("i8" if pa.types.is_large_string(chunks.type) else "i4")
    ends = np.frombuffer(chunks.buffers()[1], size)[chunks.offset : chunks.offset + len(chunks) + 1]
    if not len(chunks) or ends[-1] < 3:
        return np.zeros(len(chunks), bool), np.zeros(len(chunks), "u1")
    raw = np.frombuffer(chunks.buffers()[2], "u1")
    n, at = np.diff(ends), ends[1:].astype("i8")
    last, before, third = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
    # of the letters of more than one byte those from À to ÿ count
    latin = (n > 2) & (third == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    return (n > 1) & known[last] & (_ALNUM[before] | latin), last


class CachedEncoder:
    """Ids of texts. many: the ids of each of some chunks; special: strings whose texts are encoded whole by `many`."""

    def __init__(self, many: Callable[[list[str]], Iterable[bytes]], split: Callable[[pa.Array], pa.Array], special: Iterable[str] = (), lower: bool = False, keep: int = CACHE_CHUNKS) -> None:
        self.many, self.split, self.special, self.lower, self.keep = many, split, list(special), lower, keep
        marks = {ord(c): np.frombuffer(x, "<u4") for c, x in zip(string.punctuation, many(list(string.punctuation)), strict=True)}
        self.mark_ids = np.zeros(256, "u4")
        self.marks = np.zeros(256, bool)
        for c, ids in marks.items():
            if len(ids) == 1:
                self.marks[c], self.mark_ids[c] = True, ids[0]
        self.known = pa.array([], pa.large_string())
        self.flat, self.starts, self.sizes, self.uses = (np.empty(0, k) for k in ("u4", "i8", "i4", "i4"))

    def columns(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, where each text's ids end) of consecutive slices of the texts."""
        for part in slices(texts):
            whole = np.zeros(len(part), bool)
            for s in self.special:
                whole |= pc.match_substring(part, s).to_numpy(zero_copy_only=False)
            if not whole.any():
                yield self._slice(part)
                continue
            own = [x for t in part.filter(pa.array(whole)).to_pylist() for x in self.many([t])]
            ids, ends = self._slice(pc.if_else(pa.array(whole), "", part))
            pieces = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            for i, x in zip(np.flatnonzero(whole).tolist(), own, strict=True):
                pieces[i] = np.frombuffer(x, "<u4")
            yield np.concatenate(pieces), np.cumsum([len(p) for p in pieces])

    def ids(self, texts: Iterable[str | None] | pa.Array) -> Iterator[bytes]:
        """The little-endian unsigned 32-bit ids of each text."""
        for ids, ends in self.columns(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            raw, at = ids.astype("<u4", copy=False).tobytes(), 0
            for end in ends.tolist():
                yield raw[4 * at : 4 * end]
                at = end

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = Chunks(texts, self.split)
        keys = chunks.distinct
        if self.lower:
            lowered, use = pc.ascii_lower(keys), pc.string_is_ascii(keys)
            for s in self.special:  # which only count as they are written
                use = pc.and_not(use, pc.match_substring(lowered, s))
            keys = pc.if_else(use, lowered, keys)
        marked, last = _marked(keys, self.marks)
        keys = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(keys, 0, -1), keys).cast(pa.large_string())
        at = self._places(keys)
        sizes = self.sizes[at] + marked
        flat, ends = gathered(self.flat, self.starts[at], sizes)  # a marked one takes one id too many, which its mark's replaces
        flat[ends[marked] - 1] = self.mark_ids[last[marked]]
        out = chunks.gather(flat, sizes)
        self._forget()
        return out

    def _places(self, keys: pa.Array) -> np.ndarray:
        """The places of chunks in the cache, into which they are put."""
        at = pc.index_in(keys, value_set=self.known)
        if at.null_count:
            lost = np.asarray(at.is_null())
            coded = keys.filter(pa.array(lost)).dictionary_encode()
            made = list(self.many(coded.dictionary.to_pylist()))
            sizes = np.fromiter(map(len, made), "i8", len(made)) >> 2
            new = np.frombuffer(b"".join([*made, bytes(4)]), "<u4")  # one more, so that runs may be read past the last
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat = np.concatenate([self.flat, new])
            self.sizes = np.concatenate([self.sizes, sizes.astype("i4")])
            self.uses = np.concatenate([self.uses, np.zeros(len(made), "i4")])
            out = at.fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
            out[lost] = len(self.known) + coded.indices.to_numpy()
            self.known = pa.concat_arrays([self.known, coded.dictionary])
        else:
            out = at.to_numpy(zero_copy_only=False).astype("i8")
        self.uses[out] += 1
        return out

    def _forget(self) -> None:
        """Of too many chunks keep those that most slices used, the latest first among equals."""
        if len(self.known) > self.keep:
            kept = np.sort(np.argsort(-self.uses[::-1], kind="stable")[: self.keep // 2])
            kept = np.sort(len(self.known) - 1 - kept)
            self.flat, ends = gathered(self.flat, self.starts[kept], self.sizes[kept])
            self.flat = np.concatenate([self.flat, np.zeros(1, "u4")])
            self.sizes, self.uses = self.sizes[kept], self.uses[kept] >> 1
            self.starts = ends - self.sizes
            self.known = self.known.take(pa.array(kept))


def ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and ends with the end id after every text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabularies of byte-level tokenizers: itself if it can be seen, or the next beyond 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ENCODERS: dict[tuple[str, str], CachedEncoder] = {}


def tokenizer_encoder(path: str, kind: str, keep: int = CACHE_CHUNKS) -> CachedEncoder:
    """The encoder of a tokenizers file as the library applies it, one per worker process; kind: "words" or "spaced".

    Strings of special tokens in a text become these tokens, which is the library's default.
    """
    if (path, kind) not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        one, alphabet = tok.model.tokenize, byte_letters()

        def many(chunks: list[str]) -> list[bytes]:
            """Plain words go to the model itself, as the letters that stand for their bytes; the rest through all steps."""
            plain = list(map(_PLAIN.fullmatch, chunks))
            other = [c for c, p in zip(chunks, plain, strict=True) if not p]
            rest = (e.ids for i in range(0, len(other), JOINED) for e in tok.encode_batch_fast(other[i : i + JOINED], add_special_tokens=False))
            found = ([t.id for t in one(c.encode().decode("latin-1").translate(alphabet))] if p else next(rest) for c, p in zip(map(str.lower, chunks) if kind == "words" else chunks, plain, strict=True))
            return [array("I", ids).tobytes() for ids in found]

        _ENCODERS[path, kind] = CachedEncoder(many, words if kind == "words" else spaced, special, kind == "words", keep)
    return _ENCODERS[path, kind]
