"""Token ids and counts of whole texts with a public word-level BPE file.

Two exact ways meet here. Texts up to ``chunk`` characters are split at ASCII blanks, where this
tokenizer's state starts anew; each distinct word of an Arrow batch is encoded once and remembered
by the worker. Longer texts are never handed to the library whole: overlapping chunks are encoded
with offsets and spliced where both encodings have the same token on either side of a boundary.

Why such a boundary is stable: a token that ends a word says that the split pattern ended a match
there, and what it matches next depends on the text after it alone. Inside a word, byte pair ids
are right exactly if every two neighbours are what their own characters give; left of the boundary
the first chunk shows this, right of it the second, and across it both do. The boundary must also be
one that composition (NFC) never crosses. Where an overlap holds no such boundary it is widened, at
last to both chunks, whose length then doubles: a text without any boundary costs a few encodings.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back

CHUNK, OVERLAP = 32_768, 1_024
#: Letters whose lower case is one letter, unaffected by composition: ASCII and Latin-1.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation without ' and <.
_SIGNS = r"[!-&(-/:;=-@\[-`{-~]"
#: A run of letters, then a run of signs: one token run each.
_PLAIN = f"^[{_LETTERS}]+{_SIGNS}*$"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Chunk:
    """The encoding of a stretch of a text, and which of its ids count."""

    begin: int
    end: int
    ids: np.ndarray
    at: np.ndarray  # where each token begins in the text
    stop: np.ndarray
    first: int = 0
    last: int | None = None
    cut: int = 0  # where the ids that count begin in the text


class WordTokenizer:
    """Ids of texts by distinct words; ``limit`` bounds the words remembered (all are forgotten beyond it)."""

    def __init__(self, path: str, limit: int = 600_000, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.limit, self.chunk, self.overlap = limit, chunk, overlap
        self.full = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Words of lower-case letters need neither normalisation nor the split pattern.
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.full.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)  # of each known word's ids in ``flat``

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each word where its own begin among them and how many they are."""
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        is_plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        plain, other = np.flatnonzero(is_plain), np.flatnonzero(~is_plain & (pc.binary_length(words).to_numpy() > 0))
        flat = np.empty(0, np.uint32)
        if len(plain):  # five hundred at a time, a blank between a word's two runs too
            names = pc.utf8_lower(words.take(pa.array(plain)))
            runs = 1 + pc.match_substring_regex(names, f"{_SIGNS}$").to_numpy(zero_copy_only=False)
            names = pc.replace_substring_regex(names, f"({_SIGNS}+)$", r" \1")
            joined = pc.binary_join(pa.ListArray.from_arrays(np.append(np.arange(0, len(plain), 500), len(plain)).astype(np.int32), names), " ")
            flat = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.bare.encode_batch_fast(joined.to_pylist(), add_special_tokens=False)])
            ends = (np.flatnonzero(self.ends[flat]) + 1)[np.cumsum(runs) - 1]
            sizes[plain] = np.diff(ends, prepend=0)
            starts[plain] = ends - sizes[plain]
        if len(other):
            coded = [np.array(e.ids, dtype=np.uint32) for e in self.full.encode_batch_fast(words.take(pa.array(other)).to_pylist(), add_special_tokens=False)]
            sizes[other] = [len(x) for x in coded]
            starts[other] = len(flat) + np.cumsum(sizes[other]) - sizes[other]
            flat = np.concatenate([flat, *coded])
        return flat, starts, sizes

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Number of each distinct word among those known; new ones are encoded first."""
        names = words.to_pylist()
        codes = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        at = np.flatnonzero(codes < 0)
        if len(at):
            base, end = len(self.known), len(self.known) + len(at)
            flat, starts, sizes = self._encode_words(words.take(pa.array(at)))
            codes[at] = np.arange(base, end)
            self.known.update(zip((names[i] for i in at.tolist()), range(base, end)))
            self.flat, self.starts, self.sizes = _room(self.flat, self.used + len(flat)), _room(self.starts, end), _room(self.sizes, end)
            self.flat[self.used : self.used + len(flat)] = flat
            self.starts[base:end], self.sizes[base:end] = self.used + starts, sizes
            self.used += len(flat)
        return codes

    def _short(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        codes = self._codes(words.dictionary)[words.indices.to_numpy()]
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        sizes = self.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])
        ids, offsets = self.flat[at], ends[bounds]
        if len(self.known) > self.limit:
            self._forget()
        return ids, offsets

    def _piece(self, text: str, begin: int, end: int) -> "Chunk":
        e = self.full.encode(text[begin:end], add_special_tokens=False)
        at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + begin
        return Chunk(begin, end, np.array(e.ids, dtype=np.uint32), at[:, 0], at[:, 1])

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of a huge text from overlapping chunks."""
        held = [self._piece(text, 0, min(self.chunk, len(text)))]
        while (end := held[-1].end) < len(text):
            begin, stop = max(0, end - self.overlap), min(len(text), end + self.chunk - self.overlap)
            while True:
                right = self._piece(text, begin, stop)
                cut = self._stable(text, held[-1], right) if held else (0, 0, 0)
                if cut is not None:
                    if held:
                        held[-1].last, right.first, right.cut = cut
                    held.append(right)
                    break
                begin = max(0, 2 * begin - held[-1].end)
                while held and begin <= held[-1].begin:  # no boundary in a whole chunk: one of twice its length takes its place
                    gone = held.pop()
                    begin, stop = gone.begin, min(len(text), max(stop, gone.end + gone.end - gone.begin))
        return np.concatenate([c.ids[c.first : c.last] for c in held])

    def _stable(self, text: str, left: "Chunk", right: "Chunk") -> tuple[int, int, int] | None:
        """The middle one of the stable boundaries strictly inside the overlap: its place in both chunks' ids and in the text."""
        low, high = max(right.begin, left.cut), left.end
        clean = []
        for c in (left, right):
            i = np.arange(1, len(c.ids))
            i = i[(c.at[1:] >= c.stop[:-1]) & (c.at[1:] > low) & (c.at[1:] < high)]  # no character lies on both sides
            clean.append(i[np.diff(c.at[i], prepend=-1) > 0])
        _, x, y = np.intersect1d(left.at[clean[0]], right.at[clean[1]], assume_unique=True, return_indices=True)
        i, k = clean[0][x], clean[1][y]
        same = (left.ids[i] == right.ids[k]) & (left.ids[i - 1] == right.ids[k - 1])
        both = list(zip(i[same].tolist(), k[same].tolist()))
        while both:
            i, k = both.pop(len(both) // 2)
            cut = int(left.at[i])
            if _starts_anew(text[cut]) and not self._in_special(text, cut):
                return i, k, cut
        return None

    def _in_special(self, text: str, p: int) -> bool:
        """Whether a special string lies on both sides of the boundary: it is cut out before all else."""
        return any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in self.specials)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of an Arrow array of texts (null: empty), and where each text's ids begin and end."""
        texts = texts.fill_null("")
        long = pc.greater(pc.utf8_length(texts), self.chunk).to_numpy(zero_copy_only=False)
        if not long.any():
            return self._short(texts)
        ids, offsets = self._short(pc.if_else(pa.array(long), "", texts))
        parts = np.split(ids, offsets[1:-1])
        for i in np.flatnonzero(long):
            parts[i] = self.encode_long(texts[int(i)].as_py())
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy of at least twice its length that holds ``n``."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def _starts_anew(c: str) -> bool:
    """Whether composition never joins this character to one before it."""
    return c < "\u0300" or (c < "\U00010000" and not "\u1100" <= c <= "\u11ff" and unicodedata.category(c)[0] in "LNPSZ" and not unicodedata.combining(c))


_held: dict[tuple, WordTokenizer] = {}


def worker_tokenizer(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> WordTokenizer:
    """One tokenizer for a Python worker, kept between its tasks."""
    key = (path, chunk, overlap)
    if key not in _held:
        pa.set_cpu_count(1)
        _held[key] = WordTokenizer(path, chunk=chunk, overlap=overlap)
    return _held[key]


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` text bytes (a longer row is alone)."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null text is empty: no bytes, no tokens. Every row is counted by itself, repeated ones and those
    of a null doc_id too; an empty table gives an empty result, and other columns are not read. No
    begin, end or added tokens; special strings inside a text count as the library counts them.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path, chunk, overlap)
        for whole in batches:
            for b in slices(whole, "text"):
                _, offsets = tok.encode(b.column("text"))
                n_bytes = pc.binary_length(b.column("text")).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, pa.array(np.diff(offsets), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(run), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
