"""Merge-type SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding keeps an agenda of candidate merges, best score first, then leftmost. A candidate is a span
(start, middle, end) of a word; before it is merged, a keyed hash of (seed, document, place of the word
in the text, span) decides whether it is skipped. So the same seed always gives the same segmentation
and another seed another one, and each occurrence of a word is cut by draws of its own.

No piece crosses from a word to the next space, so words are encoded alone, each occurrence anew, in
lockstep (``Pieces._lockstep``). Only what is free of draws, the symbols of a distinct word and its first
candidates, is shared by its occurrences. Text without spaces makes words of any length: one of over ``LONG``
characters is cut between two characters that no piece holds side by side, where no merge can ever cross, and each
part is a word with draws of its own. What stays long (one letter repeated) goes through a heap.
Characters without a piece become byte pieces; a literal U+2581 does too, so decoding is lossless.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import slices, tokenizer_path

SPACE = "▁"
LONG = 48  # characters from which a word is cut, or else gets an agenda of its own
_WRAP = (1 << 64) - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 (wrapping)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def _mixed_int(x: int) -> int:
    """``_mixed`` of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WRAP
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WRAP
    return x ^ (x >> 31)


def _span(start, middle, end):
    """One number for a candidate, whichever of the two ways segments its word."""
    return (start << 12) + (middle << 6) + end if isinstance(end, np.ndarray) or end < 64 else (start << 40) + (middle << 20) + end


def occurrence(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The key of each word by that of its document and its place in it."""
    with np.errstate(over="ignore"):
        return _mixed(key + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


class Pieces:
    """A model's pieces and merges, and the keyed choice of skipped ones."""

    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size, self.seed = n, seed
        self.bar = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        ids = {names[i]: i for i in normal}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        left, right, whole = [], [], []
        for i in normal:
            p = names[i]
            if len(p) == 1:
                self.char[ord(p)] = i
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i)
        self.start = self.char[ord(SPACE)]
        self.char[ord(SPACE)] = -1  # a literal one is spelled in bytes
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.whole = key[order], np.array(whole, np.int32)[order]
        self.pairs: dict[int, int] = {}
        beside = {(ord(a) << 21) + ord(b) for i in normal for a, b in zip(names[i], names[i][1:])}
        self.beside = np.array(sorted(beside) or [-1], np.int64)
        score = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.unique(score, return_inverse=True)[1].astype(np.int32) + 1  # 0: no merge
        self.text = [b""] * n
        for i in normal:
            self.text[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.text_size = np.array([len(t) for t in self.text], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_flat = np.frombuffer(b"".join(self.text), np.uint8)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece of each pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.whole[at], -1)

    def _skipped(self, base: np.ndarray, span: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed(base + (span.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) < self.bar

    def keys(self, docs: list[int | None], texts: pa.Array) -> np.ndarray:
        """A key of (seed, document) for each text; a text of no id is keyed by itself."""
        from xxhash import xxh64_intdigest

        seed = self.seed & (2**64 - 1)
        return np.array([xxh64_intdigest(f"id {d}" if d is not None else f"text {texts[i].as_py()}", seed) for i, d in enumerate(docs)], np.uint64)

    def _symbols(self, word: str) -> list[int]:
        """Piece of each character of a word as written (spaces are word starts); -1 - code point where there is none."""
        return [int(self.start) if c == " " else (int(x) if (x := self.char[ord(c)]) >= 0 else -1 - ord(c)) for c in word]

    def parts(self, word: str) -> list[str]:
        """A long word cut between characters that stand side by side in no piece."""
        if len(word) <= LONG:
            return [word]
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = np.where(points == 32, ord(SPACE), points)
        pair = (points[:-1] << 21) + points[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        cuts = [0, *(np.flatnonzero(self.beside[at] != pair) + 1).tolist(), len(word)]
        return [word[x:y] for x, y in zip(cuts, cuts[1:])]

    def segment(self, word: str, key: int = 0) -> list[int]:
        """Ids of one word, with the draws of ``key``: by a heap of candidates, a long word part by part."""
        parts = self.parts(word)
        if len(parts) == 1:
            return self._heap(word, int(key))
        keys = occurrence(np.full(len(parts), key, np.uint64), np.arange(len(parts)))
        return [i for part, k in zip(parts, keys.tolist()) for i in self._heap(part, k)]

    def _heap(self, word: str, key: int) -> list[int]:
        if not self.pairs:
            self.pairs = dict(zip(self.key.tolist(), self.whole.tolist()))
        sym, pairs, size, bar, rank = self._symbols(word), self.pairs, self.size, int(self.bar), self.rank
        n = len(sym)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and sym[i] >= 0 and sym[j] >= 0:
                m = pairs.get(sym[i] * size + sym[j])
                if m is not None and not (bar and _mixed_int(key + (_span(i, j, stop[j]) + 1) * 0x9E3779B97F4A7C15 & _WRAP) < bar):
                    heapq.heappush(agenda, (-int(rank[m]), i, j, stop[j], m))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, end, m = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or after[i] != j or stop[j] != end:
                continue  # one of its parts is gone
            sym[i], sym[j], stop[i], after[i] = m, None, end, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return self._spelled([s for s in sym if s is not None])

    def _spelled(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            out += [s] if s >= 0 else self.byte[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist()
        return out

    def segment_many(self, words: list[str], keys: int | np.ndarray = 0) -> list[np.ndarray]:
        """``segment`` of each word, all words a step at a time."""
        ids, sizes = self._segments(words, np.arange(len(words)), np.broadcast_to(np.asarray(keys).astype(np.uint64), len(words)))
        return np.split(ids, np.cumsum(sizes)[:-1])

    def _segments(self, names: list[str], codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many they are, of each occurrence (a code of ``names`` and a key)."""
        length = np.array([len(w) for w in names], np.int64)
        points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        flat = np.where(points == 32, self.start, self.char[points])
        flat = np.where(flat < 0, -1 - points, flat).astype(np.int32)
        first = np.append(self._merged(flat[:-1], flat[1:]), -1).astype(np.int32) if len(flat) else flat  # across words too, masked below
        start = np.cumsum(length) - length
        size = length[codes]
        order = np.argsort(size, kind="stable")
        parts, counts, rows = [], [], []
        short, long = order[np.searchsorted(size[order], 1) : (end := np.searchsorted(size[order], LONG, side="right"))], order[end:]
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            for row, count, symbols in self._lockstep(flat, first, start[codes[part]], size[part], keys[part]):
                rows.append(part[row]), counts.append(count), parts.append(symbols)
        for i, ids in zip(long, self._long([names[c] for c in codes[long]], keys[long])):
            rows.append(np.array([i])), counts.append(np.array([len(ids)])), parts.append(ids)
        if not parts:
            return np.empty(0, np.int32), np.zeros(len(codes), np.int64)
        row, count, symbols = np.concatenate(rows), np.concatenate(counts).astype(np.int64), np.concatenate(parts)
        raw = symbols < 0
        if raw.any():  # spelled in bytes
            distinct, back = np.unique(symbols[raw], return_inverse=True)
            spelled = [np.array(self._spelled([int(x)]), np.int32) for x in distinct]
            width = np.ones(len(symbols), np.int64)
            width[raw] = np.array([len(x) for x in spelled])[back]
            count = np.add.reduceat(width, np.cumsum(count) - count)
            symbols, raw = np.repeat(symbols, width), np.repeat(raw, width)
            symbols[raw] = np.concatenate([spelled[k] for k in back])
        sizes, place = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        sizes[row], place[row] = count, np.cumsum(count) - count
        ends = np.cumsum(sizes)
        return symbols[np.repeat(place - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def _long(self, words: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of long words: the parts of all of them are words, and those that stay long go through a heap."""
        parts = [self.parts(w) for w in words]
        whole = [len(p) == 1 for p in parts]
        out = [np.array(self._heap(w, int(k)), np.int32) if one else None for w, k, one in zip(words, keys, whole)]
        cut = [i for i, one in enumerate(whole) if not one]
        if cut:
            flat = [p for i in cut for p in parts[i]]
            count = np.array([len(parts[i]) for i in cut])
            own = occurrence(np.repeat(keys[cut], count), np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count))
            names = list(dict.fromkeys(flat))
            code = {w: k for k, w in enumerate(names)}
            ids, sizes = self._segments(names, np.array([code[p] for p in flat]), own)
            ends = np.cumsum(np.add.reduceat(sizes, np.cumsum(count) - count))
            for i, a, z in zip(cut, [0, *ends.tolist()], ends.tolist()):
                out[i] = ids[a:z]
        return out

    def _lockstep(self, flat: np.ndarray, first: np.ndarray, start: np.ndarray, size: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, symbols of each, the symbols) of words by ascending size, as they end; a word is a stretch of ``flat``."""
        width = int(size.max())
        columns = np.arange(width + 2, dtype=np.int32)
        cell = np.minimum(start[:, None] + columns[:-1], len(flat) - 1)
        sym = np.where(columns[:-1] < size[:, None], flat[cell], np.iinfo(np.int32).min)
        merged = np.where(columns[:-1] < size[:, None] - 1, first[cell], -1)
        begin = np.broadcast_to(columns, (len(size), width + 2)).copy()  # of each symbol, and where the last one ends
        row, size = np.arange(len(size)), size.copy()
        if self.bar:
            r, c = np.nonzero(merged >= 0)
            skip = self._skipped(base[r], _span(begin[r, c], begin[r, c + 1], begin[r, c + 2]))
            merged[r[skip], c[skip]] = -1
        rank = np.where(merged >= 0, self.rank[merged], 0)
        while len(row):
            every = np.arange(len(row))
            best = rank.argmax(axis=1)
            go = rank[every, best] > 0
            if not go.all():
                ended, count = sym[~go], size[~go]
                yield row[~go], count, ended[np.arange(ended.shape[1]) < count[:, None]]
                if not go.any():
                    return
                w = int(size[go].max()) + 1
                sym, merged, rank, begin = sym[go, :w], merged[go, :w], rank[go, :w], begin[go, : w + 1]
                row, size, base, best, every = row[go], size[go], base[go], best[go], np.arange(int(go.sum()))
            sym[every, best] = merged[every, best]
            after = columns[: begin.shape[1] - 1] > best[:, None]  # close the gap after the merged symbol
            for a in (sym, merged, rank, begin):
                np.copyto(a[:, :-1], a[:, 1:].copy(), where=after[:, : a.shape[1] - 1])
            size -= 1
            merged[every, best], rank[every, best] = -1, 0
            right, left = np.flatnonzero(best + 1 < size), np.flatnonzero(best > 0)
            r, c = np.concatenate([right, left]), np.concatenate([best[right], best[left] - 1])
            m = self._merged(sym[r, c], sym[r, c + 1])
            if self.bar:
                k = np.flatnonzero(m >= 0)
                skip = self._skipped(base[r[k]], _span(begin[r[k], c[k]], begin[r[k], c[k] + 1], begin[r[k], c[k] + 2]))
                m[k[skip]] = -1
            merged[r, c], rank[r, c] = m, np.where(m >= 0, self.rank[m], 0)

    def encode(self, texts: pa.Array, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each text's bounds. A text reads as if a space stood before it (an empty one has no ids)."""
        keys = np.zeros(len(texts), np.uint64) if keys is None else keys
        spaced = pc.match_substring_regex(texts, "^$|^ |  | $").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(spaced), "", texts), " ")
        flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        if spaced.any():  # runs of spaces belong to the word after them; one space is read before every word
            parts, at, size = [], 0, np.diff(bounds)
            for i in np.flatnonzero(spaced):
                own = [w[1:] for w in re.findall(" +[^ ]*", " " + texts[int(i)].as_py())] if len(texts[int(i)].as_py()) else []
                parts += [flat[at : bounds[i]], pa.array(own, pa.string())]
                at, size[i] = bounds[i] + 1, len(own)  # past its one empty word
            flat, bounds = pa.concat_arrays([*parts, flat[at:]]), np.concatenate([[0], np.cumsum(size)])
        words = flat.dictionary_encode()
        codes, names = words.indices.to_numpy(), words.dictionary
        place = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
        base = occurrence(np.repeat(keys, np.diff(bounds)), place)
        ids, sizes = self._segments([" " + w for w in names.to_pylist()], codes, base)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 (of one text's ids, without the space that stood before it)."""
        size = self.text_size[ids]
        end = np.cumsum(size)
        if not len(ids):
            return b""
        return self.text_flat[np.repeat(self.text_start[ids] - end + size, size) + np.arange(end[-1])].tobytes()[1:]


_held: dict[tuple, Pieces] = {}


def worker_pieces(path: str, dropout: float, seed: int) -> Pieces:
    key = (path, dropout, seed)
    if key not in _held:
        _held[key] = Pieces(path, dropout, seed)
    return _held[key]


def encode_pieces(docs: DataFrame, dropout: float = 0.1, seed: int = 1, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_pieces, ids (little-endian signed 32 bit), decoded (the text that the ids give).

    Null text is empty and has no ids. Repeated rows have equal rows; a text of a null id is keyed by itself. An
    empty table gives an empty result; other columns are not read. With ``dropout`` 0 the ids are the
    library's own (but for a literal U+2581).
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_pieces(path, dropout, seed)
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                texts = b.column("text").fill_null("")
                ids, offsets = model.encode(texts, model.keys(b.column("doc_id").to_pylist(), texts))
                rows = [ids[a:z] for a, z in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array([r.astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([model.decode(r).decode() for r in rows], pa.string())],
                    ["doc_id", "n_bytes", "n_pieces", "ids", "decoded"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids binary, decoded string")
