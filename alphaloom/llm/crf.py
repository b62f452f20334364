"""A linear-chain conditional random field over word-shape features, in numpy.

Training is maximum likelihood by forward-backward over a small labelled table; decoding is Viterbi
over batches of sequences. A word's features are looked up once per distinct word; its neighbours
contribute by a second and third weight table.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

#: Words that hint at personal data or spell its signs.
LEXICON = frozenset(
    "at dot arroba punto punkt point email e-mail mail correo courriel write schreiben contact "
    "phone tel telephone call ring rufen anrufen llame appelez fax mobile number card karte tarjeta "
    "carte visa credit pay ip server host address ping version page pages isbn order invoice year "
    "chapter section token key id price usd eur total room line code release".split()
)

#: Sentences of the labelled table; {kind} is a value of that kind, lower-case braces are literal values that are none.
SENTENCES = (
    "call me on {phone} after nine", "tel {phone}", "phone: {phone}, ask for the office", "rufen Sie {phone} an", "llame al {phone} hoy",
    "appelez le {phone} demain", "my number is {phone} and hers is {phone}", "fax {phone} or write to {email}", "mobile {phone}.", "reach us at {phone} or {email}",
    "write to {email} for more", "email {email}", "contact {email} or {email}", "correo {email} del autor", "schreiben an {email} bitte",
    "courriel {email}.", "the mail of the author is {email}, he said", "she gave {email} as her address", "ping {ip} from the server", "host {ip} is down",
    "server {ip} and {ip} answered", "ip address {ip}", "from {ip} to {ip}.", "pay with card {card} now", "visa {card}", "karte {card} gesperrt",
    "tarjeta {card} de credito", "carte {card} de la banque", "credit card number {card}, thanks", "the card {card} was charged", "the of and {phone} was in to", "la de que {email} en el",
    "der die und {ip} von mit", "le les des {card} est une", "was in {email} the and of", "to a {phone} be as", "that for {card} with by",
    "version {num} of the file", "page {num} of {num}", "in the year {year} and {year}", "on {date} it was", "order {num} total {money} usd",
    "the price is {money} eur", "chapter {num}, section {dec}", "isbn {isbn}", "token = {hex}", "key {hex} id {num}",
    "release {dec} of {date}", "room {num} line {num}", "License, Version {dec}.", "he has {num} and {num} or {num}", "the {junk} and {junk} of {junk}",
    "{junk} {junk} {junk}", "at the end of the line", "look at this point and call it a day", "write the number of the page", "a dot on the card at home",
    "{num} {num} in {num}", "api_key={hex} and more", "{word}{num} {word}-{word} {word}'s", "it was {money} or {dec} in {year}", "https://www.{word}.com/{word}/{num} is a page",
    "invoice {num}-{num} of {date}", "between {year}-{year} the", "{word}_{word} = {num}", "the code {num}{word} was", "{dec} {dec} {dec}", "{num}% of {num}",
)


def _value(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice(["an", "er", "ti", "on", "mo", "la", "sch", "que"]) for _ in range(r.randint(1, 3)))
    octet = lambda: str(r.randint(1, 254))
    forms = {
        "phone": [f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(3)}/{d(7)}"],
        "email": [f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.com", f"{w()}@{w()}.org", f"{w()} at {w()} dot com", f"{w()} [at] {w()} [dot] com", f"{w()}(at){w()}.com", f"{w()} arroba {w()} punto es", f"{w()}.{w()} at {w()} dot org"],
        "ip": [".".join(octet() for _ in range(4)), " dot ".join(octet() for _ in range(4)), "[.]".join(octet() for _ in range(4))],
        "card": [" ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), d(16), ".".join(d(4) for _ in range(4)), f"{d(4)} {d(6)} {d(5)}"],
        "num": [d(r.randint(1, 6))], "year": [f"{r.choice(['19', '20'])}{d(2)}"], "dec": [f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(2)}.{d(2)}"],
        "date": [f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}"], "money": [f"{d(3)}.{d(2)}", f"${d(2)}", f"{d(1)},{d(3)}.{d(2)}"],
        "isbn": [f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"], "hex": ['"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', "AK" + d(8).replace("0", "Z")],
        "junk": [w() + r.choice(["***", "&&&", "!!", "$$$", "###", ",", "."])], "word": [w()],
        "filler": [w(), w(), w(), w().capitalize(), w() + r.choice([",", "."]), w().upper(), "|"],
    }
    return r.choice(forms[kind])


def labelled_table(copies: int = 5, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the labelled sentences, each with ``copies`` sets of values."""
    r = random.Random(seed)
    out = []
    for sentence in SENTENCES * copies:
        words, labels = [], []
        before, after = (" ".join(_value("filler", r) for _ in range(r.randint(0, 6))) for _ in range(2))
        sentence = f"{before} {sentence} {after}".strip()
        text, marks = "", []
        for part in re.split(r"(\{\w+\})", sentence):
            if part.startswith("{"):
                value = _value(part[1:-1], r)
                if part[1:-1] in KINDS:
                    marks.append((len(text), len(text) + len(value), part[1:-1]))
                text += value
            else:
                text += part
        for m in re.finditer(r"\S+", text):
            kind = next(((k, m.start() <= a) for a, z, k in marks if m.start() < z and m.end() > a), None)
            words.append(m[0])
            labels.append("O" if kind is None else f"{'B' if kind[1] else 'I'}-{kind[0]}")
        if r.random() < 0.3:
            words[0] = words[0].capitalize()
        out.append((words, labels))
    return out


def word_features(word: str) -> list[str]:
    """Shape features of one word."""
    shape = re.sub(r"[^\W\d_]", "x", re.sub(r"[A-Z]", "X", re.sub(r"[0-9]", "d", word)))
    brief = re.sub(r"(.)\1+", r"\1", shape)
    digits = shape.count("d")
    core = word.strip(".,;:!?()[]\"'").lower()
    bucket = "0" if not digits else "1-2" if digits < 3 else str(digits) if digits < 6 else "6-9" if digits < 10 else "10-12" if digits < 13 else "13+"
    out = ["bias", f"digits={bucket}", f"brief={brief if len(brief) < 24 else 'long'}"]
    if digits:
        out.append("shape=" + re.sub(r"([xX])\1+", r"\1", shape)[:24])
        if shape.strip("d.,;:()+-/[]") == "":
            out.append("numeric")
        if shape.strip("d") == "":
            out.append("digits only")
    if core in LEXICON:
        out.append(f"word={core}")
    out += [f"has {c}" for c in "@+([_=/" if c in word]
    if word[-1:] in ".,;:!?":
        out.append("ends a clause")
    return out


@dataclass
class Crf:
    """Weights: ``tables[0]`` of a word's own features, [1] for the word after it, [2] for the word before it."""

    names: dict[str, int] = field(default_factory=dict)
    tables: np.ndarray = field(default_factory=lambda: np.zeros((3, 0, len(LABELS))))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def scores(self, word: str) -> np.ndarray:
        """(3, labels): what the word adds to its own, the next and the previous word's label scores."""
        ids = [self.names[f] for f in word_features(word) if f in self.names]
        return self.tables[:, ids].sum(axis=1)

    def decode(self, blocks: Iterable[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels (n, t) of padded sequences of ascending length, whose emissions come as consecutive blocks (n, block, labels)."""
        n, t = len(lengths), int(lengths.max())
        left = np.searchsorted(lengths, np.arange(t), side="right")  # sequences that have ended before each word
        best, back, i = np.zeros((n, len(LABELS))), np.zeros((t, n, len(LABELS)), np.int8), 0
        for block in blocks:
            for e in block.swapaxes(0, 1):
                k = left[i]
                if i:
                    through = best[k:, :, None] + self.moves
                    back[i, k:] = through.argmax(axis=1)
                    best[k:] = through.max(axis=1) + e[k:]
                else:
                    best[:] = e
                i += 1
        out = np.zeros((n, t), np.int8)
        state, rows = best.argmax(axis=1), np.arange(n)
        for i in range(t - 1, -1, -1):
            k = left[i]
            out[k:, i] = state[k:]
            state[k:] = back[i, rows[k:], state[k:]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]] | None = None, rounds: int = 160, rate: float = 0.2, ridge: float = 1e-4) -> Crf:
    """The field that maximises the table's penalised likelihood (Adam, deterministic)."""
    table = table or labelled_table()
    names: dict[str, int] = {}
    for words, _ in table:
        for w in words:
            for f in word_features(w):
                names.setdefault(f, len(names))
    n, t, k, f = len(table), max(len(w) for w, _ in table), len(LABELS), len(names)
    lengths = np.array([len(w) for w, _ in table])
    inside = np.arange(t)[None, :] < lengths[:, None]
    gold, place = np.zeros((n, t), np.intp), np.zeros((n, t), np.intp)
    distinct: dict[tuple[int, ...], int] = {}  # words of equal features are one
    for i, (words, labels) in enumerate(table):
        gold[i, : len(words)] = [LABELS.index(x) for x in labels]
        place[i, : len(words)] = [distinct.setdefault(tuple(names[x] for x in word_features(w)), len(distinct)) for w in words]
    has = np.zeros((len(distinct), f))
    for ids, i in distinct.items():
        has[i, list(ids)] = 1
    # each of the three tables is read at a word's own cell, the next and the previous one
    shifts = ((slice(None), slice(None)), (slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))
    params = [np.zeros((3, f, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one_hot = np.eye(k)[gold] * inside[:, :, None]
    gold_moves = np.einsum("nti,ntj->ij", one_hot[:, :-1], one_hot[:, 1:])
    for step in range(1, rounds + 1):
        tables, moves = params
        score = has @ tables
        e = np.zeros((n, t, k))
        for which, (to, source) in enumerate(shifts):
            e[:, to] += score[which][place[:, source]] * inside[:, source, None]
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(inside[:, i : i + 1], _log_sum(alpha[:, i - 1][:, :, None] + moves, 1) + e[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(inside[:, i + 1 : i + 2], _log_sum(moves + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), beta[:, i + 1])
        total = _log_sum(alpha[:, -1], 1)
        single = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
        pair = np.zeros((k, k))
        for i in range(1, t):
            x = alpha[:, i - 1][:, :, None] + moves + (e[:, i] + beta[:, i])[:, None, :] - total[:, None, None]
            pair += (np.exp(x) * inside[:, i][:, None, None]).sum(axis=0)
        off = (single - one_hot) / n
        grads = [np.zeros_like(tables), (pair - gold_moves) / n + ridge * moves]
        for which, (to, source) in enumerate(shifts):
            flat, part = place[:, source].ravel(), (off[:, to] * inside[:, source, None]).reshape(-1, k)
            by_word = np.stack([np.bincount(flat, part[:, c], len(distinct)) for c in range(k)], axis=1)
            grads[0][which] = has.T @ by_word
        grads[0] += ridge * tables
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Crf(names, params[0], params[1])
