"""Personal data in whole texts: four exact patterns, and spans that a conditional random field adds.

Words are runs without ASCII blanks. Whatever the field may add holds a *marked* word: one with a digit,
@ or a sign between letters, or a spelled-out dot. So lines without one are not decoded; any other is
decoded whole, however long: its emissions are read a block of words at a time, and the scores of the
labels are carried from block to block. Words of equal shape have equal features and are scored once.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back
from .crf import KINDS, LABELS, LEXICON, Crf, train
from .token_counts import slices

#: The base patterns (fixed values).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: IP from the start of a run of digits: where that fails, no later start in the run can match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CELLS = 1_000_000  # words of a batch of lines, padding included (a longer one goes alone)
BLOCK = 250_000  # words whose emissions are held at once
#: Spelled-out signs of an address.
DOTS = ["dot", "punto", "punkt", "point"]
_AT = r"@|\bat\b|\barroba\b"
_DOT = rf"\.\w|\b(?:{'|'.join(DOTS)})\b"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = r"^[^\pL\pN\x00-\x20@+=_/]*\pL*[^\pL\pN\x00-\x20@+=_/(\[]*$"
_DIGIT = re.compile("[0-9]")
Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The matches of ``EMAIL``, found from each @ in one pass: the longest local part before it, then the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        low = max(free, text.rfind("@", 0, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free, "email"
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, by start, then kind as listed."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


class Tagger:
    """Decodes whole texts with a trained field, in numpy batches over distinct words."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.dots, self.lexicon = pa.array(DOTS), pa.array(sorted(LEXICON))
        self.known: dict[str, np.ndarray] = {}  # scores by shape

    def _scores(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(shapes, 3, labels) scores, and the shape of each of the names: runs of letters as one, digits all 0, or the word itself where its letters count."""
        shape = names
        for pattern, to in (("[A-Z]+", "\x01"), (r"[\pL\p{Nl}\p{No}]+", "x"), ("\x01", "X"), ("[0-9]", "0")):
            shape = pc.replace_substring_regex(shape, pattern, to)
        core = pc.ascii_lower(pc.utf8_trim(names, ".,;:!?()[]\"'"))
        own = pc.or_(pc.is_in(core, value_set=self.lexicon), pc.match_substring(names, "\x01"))
        shape = pc.if_else(own, names, shape).dictionary_encode()
        distinct = shape.dictionary.to_pylist()
        if len(self.known) > 100_000:
            self.known.clear()
        for w in distinct:
            if w not in self.known:
                self.known[w] = self.crf.scores(w)
        return np.stack([self.known[w] for w in distinct]), shape.indices.to_numpy()

    def spans(self, texts: pa.Array) -> dict[int, list[tuple[int, int, str]]]:
        """Of each text with any: (first word, last word + 1, kind), words counted through the text."""
        lines = pc.split_pattern(texts, "\n")
        words = pc.ascii_split_whitespace(lines.flatten())
        flat = words.flatten().dictionary_encode()
        of_text = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
        size = np.diff(words.offsets.to_numpy())
        line = np.repeat(np.arange(len(size)), size)
        codes, names = flat.indices.to_numpy(), flat.dictionary
        real = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)[codes]  # a blank at a line's end leaves an empty word
        codes, line = codes[real], line[real]
        plain = pc.match_substring_regex(names, _PLAIN)
        bare = pc.utf8_trim(pc.ascii_lower(names), ".,;:!?()[]\"'")
        special = pc.or_(pc.invert(plain), pc.is_in(bare, value_set=self.dots)).to_numpy(zero_copy_only=False)
        marked = special[codes]
        if not marked.any():
            return {}
        decoded = np.zeros(len(size), bool)
        decoded[line[marked]] = True
        at = np.flatnonzero(decoded[line])
        begin = np.flatnonzero(np.diff(line[at], prepend=-1) > 0)
        run = np.diff(np.append(begin, len(at)))
        used, place = np.unique(codes[at], return_inverse=True)
        scores, shape = self._scores(names.take(pa.array(used)))
        word = shape[place]
        order = np.argsort(run, kind="stable")
        text_of = of_text[line[at]]
        first = np.searchsorted(of_text[line], np.arange(len(texts)))
        out: dict[int, list[tuple[int, int, str]]] = {}
        for part in _batches(order, run):
            starts, sizes = begin[part], run[part]
            labels = self.crf.decode(_emissions(scores, word, starts, sizes), sizes)
            cell = starts[:, None] + np.arange(labels.shape[1])
            for i, j in zip(*np.nonzero(labels)):
                w = at[cell[i, j]]
                text, kind = int(text_of[cell[i, j]]), LABELS[labels[i, j]]
                w -= first[text]
                mine = out.setdefault(text, [])
                if kind[0] == "I" and j and mine and mine[-1][1] == w and mine[-1][2] == kind[2:]:
                    mine[-1] = (mine[-1][0], int(w) + 1, kind[2:])
                else:
                    mine.append((int(w), int(w) + 1, kind[2:]))
        return out


def _batches(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences by ascending size, in batches of at most ``CELLS`` padded words or one sequence."""
    i = 0
    while i < len(order):
        padded = sizes[order[i : i + 2000]] * np.arange(1, len(order[i : i + 2000]) + 1)
        n = max(1, int(np.searchsorted(padded, CELLS, side="right")))
        yield order[i : i + n]
        i += n


def _emissions(scores: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """(n, block, labels) label scores of padded sequences, a block of words at a time."""
    t, step = int(sizes.max()), max(1, BLOCK // len(sizes))
    for at in range(0, t, step):
        i = np.arange(at, min(t, at + step))
        cell = starts[:, None] + i
        inside = i < sizes[:, None]
        e = np.zeros((*cell.shape, len(LABELS)))
        e[inside] = scores[word[cell[inside]], 0]
        for ok, which, d in ((inside & (i > 0), 1, -1), (i + 1 < sizes[:, None], 2, 1)):
            e[ok] += scores[word[cell[ok] + d], which]
        yield e


def plausible(kind: str, text: str) -> bool:
    """Whether the field's span has what its kind needs, in digits or signs."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        return bool(re.search(_AT, text)) and bool(re.search(_DOT, text)) and len(text.split()) <= 9
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and re.sub(r"dot|[0-9.\[\]() ]", "", text) == ""
    if re.sub(r"[0-9()+./ -]", "", text):
        return False
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def all_spans(text: str, base: list[Span], words: list[tuple[int, int, str]]) -> list[Span]:
    """The base spans and those of the field's that overlap none of them, without punctuation at their ends; ``words`` by place."""
    out = list(base)
    if words:
        places = [m.span() for m in _WORD.finditer(text)]
        starts, ends = [], []  # of the stretches that base spans cover
        for a, z, _ in base:
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], z)
            else:
                starts.append(a), ends.append(z)
        for a, z, kind in words:
            start, end = places[a][0], places[z - 1][1]
            while start < end and text[start] in ".,;:!?\"'*&#$%|":
                start += 1
            while end > start and text[end - 1] in ".,;:!?\"'*&#$%|":
                end -= 1
            i = bisect.bisect_left(starts, end)  # stretches that begin before its end
            if (not i or ends[i - 1] <= start) and plausible(kind, text[start:end]):
                out.append((start, end, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"


def find_pii(docs: DataFrame, crf: Crf | None = None, mask: bool = False) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, masked.

    ``spans`` lists kind:start:end in code points, end exclusive, of base spans and those the field
    adds. With ``mask``, ``masked`` is the text with each span (overlapping ones together) replaced by
    ``<kind>``; else it is null. Null text is empty and has no spans. Repeated rows and null ids are
    rows like any other; an empty table gives an empty result. ``crf`` is trained from its labelled
    table where none is given.
    """
    crf = crf or train()
    held: list[Tagger] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Tagger(crf))
        for whole in batches:
            for b in slices(whole, "text", 8_000_000):
                texts = b.column("text").fill_null("")
                added = held[0].spans(texts)
                out: list[list] = [[] for _ in range(7)]
                for i, t in enumerate(texts.to_pylist()):
                    base = base_spans(t)
                    spans = all_spans(t, base, sorted(added.get(i, [])))
                    kinds = [k for _, _, k in base]
                    row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), masked(t, spans) if mask else None]
                    for column, v in zip(out, row):
                        column.append(v)
                columns = [pa.array(c, pa.int64() if n < 4 else pa.string()) for n, c in enumerate(out)]
                yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", *(x.split()[0] for x in _SCHEMA.split(", "))])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    docs = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    schema = docs.select("row").schema
    for x in _SCHEMA.split(", "):
        schema = schema.add(x.split()[0], x.split()[1])
    return docs.mapInArrow(giving_back(run), schema)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, z, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts, and n_chars where it has that column."""
    found = find_pii(docs, mask=True)
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.when(F.col("row.text").isNotNull(), F.col("masked"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("spans") == "", F.col("row.n_chars")).otherwise(F.char_length("masked").cast(docs.schema["n_chars"].dataType))
    return found.select(*(c.alias(n) for n, c in columns.items()))
