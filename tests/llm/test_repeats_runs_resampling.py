"""Suffix-array dedup, periodic runs and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import media, periodic_runs, repeats, sentencepiece_dropout, suffix_tree, target_resampling
from alphaloom.llm.queries import QUERIES

#: Extra columns have the names that the operators use inside.
SCHEMA = "doc_id long, text string, id long, body string, h string, d int, size string, row string, part double, ranges string, rank int, score double, runs string, wanted string"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, 1, "b", "h", 2, "s", "r", 0.5, "x", 3, 0.25, "y", "w") for i, t in rows], SCHEMA).repartition(parts)


def odd_rows(sf, spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return real + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "alpha beta gamma delta " * 3000), (9005, real[3][1]), (9006, real[3][1] + "!"), (9006, real[3][1] + "!"), (9007, "é日本 " * 400), (None, real[4][1]), (None, None), (-5, "a\x0bb"), (9008, "x" * 5000), (9009, "<|endoftext|> A1b2 " * 30)]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return odd_rows(sf, spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


# --- repeats


def brute_repeats(texts, least):
    texts, places = [(t or "").encode() for t in texts], {}
    for i, t in enumerate(texts):
        for j in range(len(t) - least + 1):
            places.setdefault(t[j : j + least], []).append((i, j))
    cover = [np.zeros(len(t) + 1, int) for t in texts]
    for held in places.values():
        if len(held) > 1:
            for i, j in held:
                cover[i][j] += 1
                cover[i][j + least] -= 1
    out = []
    for t, c in zip(texts, cover):
        gone = np.cumsum(c[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = [(int(a), int(z - a)) for a, z in zip(edge[::2], edge[1::2])]
        out.append((len(t), spans, bytes(b for b, x in zip(t, gone) if not x)))
    return out


def mosaics(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdef é\0") for _ in range(300)) for _ in range(4)]
    texts = [None, "", "a" * 700, "ab" * 300, "a" * 5000]
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            a = r.randrange(250)
            parts.append(r.choice(base)[a : a + r.randint(1, 120)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 30))))
        texts.append("".join(parts))
    return texts + [texts[20], texts[20], base[0][:60]] * 3


@pytest.mark.parametrize("least, chunk", [(24, 1_000_000), (24, 1500), (41, 700)])
def test_repeats_go_whatever_the_trees(spark, least, chunk):
    """Small chunks deal a group to many trees, whose labels are merged."""
    texts = mosaics(4, 90)
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.remove_repeats(table(spark, list(enumerate(texts))), least, chunk).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, least)


def test_repeats_in_odd_rows(spark, docs, rows):
    key = lambda i, n, spans, kept: (str(i), n, spans, kept)
    want = sorted(key(i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 400)))
    got = sorted(key(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.remove_repeats(docs).collect())
    assert got == want
    assert repeats.remove_repeats(docs.limit(0)).count() == 0 and repeats.repeat_groups(docs.limit(0)).count() == 0


def test_suffix_dedup_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op11_suffix_dedup"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for i, (n, spans, kept) in zip(texts, brute_repeats(texts.values(), 400)):
        assert tuple(got[i]) == (i, n, sum(x for _, x in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_groups_list_all_occurrences(spark):
    """Passages in several texts, longer forms of one in some, runs, and copies of whole texts."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    short, tail = word(43), word(5)
    texts = [word(80) + short + (tail if i % 3 == 0 else "") + word(50) for i in range(9)] + [word(200), "ab" * 60, word(30) + "ab" * 50]
    texts += [texts[9], texts[9], None, ""]
    got = repeats.repeat_groups(table(spark, list(enumerate(texts))), least=40).collect()
    content = {row.label: texts[row.doc_id][row.start : row.start + row.length] for row in got}
    parent = {row.label: row.parent for row in got}

    def around(label):
        while label:
            yield label
            label = parent[label]

    under = {}
    for row in got:
        assert row.length >= 40 and texts[row.doc_id][row.start : row.start + row.length] == content[row.label]
        for label in around(row.label):
            under.setdefault(label, set()).add((row.doc_id, row.start))
    assert any(parent.values())
    for label, places in under.items():
        everywhere = {(i, a) for i, t in enumerate(texts) for a in range(len(t or "")) if t.startswith(content[label], a)}
        assert places == everywhere or "-" in label and places < everywhere  # of a whole stretch, the whole stretches
    covered = {(row.doc_id, x) for row in got for x in range(row.start, row.start + row.length)}
    want = {(i, x) for i, (_, spans, _) in enumerate(brute_repeats(texts, 40)) for a, n in spans for x in range(a, a + n)}
    assert covered == want


def test_interval_tree_finds_all_maximal_repeats():
    r = random.Random(5)
    for _ in range(200):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))] + [b"a" * r.randint(1, 30)]
        least = r.choice([3, 5, 8, 22])
        places = {}
        for i, s in enumerate(strings):
            for a in range(len(s)):
                for z in range(a + least, len(s) + 1):
                    places.setdefault(s[a:z], []).append((i, a))
        want = {}
        for w, held in places.items():
            lefts = {strings[i][a - 1] if a else ("start", i) for i, a in held}
            rights = {strings[i][a + len(w)] if a + len(w) < len(strings[i]) else ("end", i) for i, a in held}
            if len(held) > 1 and len(lefts) > 1 and len(rights) > 1:
                want[w] = sorted(held)
        found = suffix_tree.maximal_repeats(strings, least)
        sa, have = found.array, {}
        for size, first, last, _ in found.nodes:
            places = sorted((int(sa.owner[p]), int(p - sa.begins[sa.owner[p]])) for p in sa.order[first : last + 1])
            have[strings[places[0][0]][places[0][1] :][:size]] = places
        assert have == want


# --- periodic runs


def brute_runs(words, shortest=6, exponent=4):
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(shortest, exponent * q) and all(any(words[x] != words[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("shortest, exponent", [(6, 4), (3, 3), (12, 5)])
def test_runs_equal_all_stretches(shortest, exponent):
    r = random.Random(exponent)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            words = [bytes([97 + r.randrange(r.choice([1, 2, 3, 20]))]) for _ in range(r.randint(0, 80))]
            if len(words) > 10 and r.random() < 0.7:
                a = r.randrange(len(words))
                p = 1 + r.randrange(max(1, (len(words) - a) // 3))
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
            texts.append(words)
        owner, runs = periodic_runs.search(texts, shortest, exponent)
        for i, words in enumerate(texts):
            assert [tuple(map(int, x)) for x in runs[owner == i]] == brute_runs(words, shortest, exponent)


def test_masking_keeps_every_word_of_a_run():
    assert periodic_runs.shortest_overlap(6, 4) == 5 and periodic_runs.shortest_overlap(12, 4) == 9
    codes = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 8, 7, 6, 5])
    kept = periodic_runs.surviving(codes, np.zeros(len(codes), int), 5)
    assert np.flatnonzero(kept).tolist() == list(range(1, 9))


def test_runs_query(spark, sf, docs, rows):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    some = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall("[^\x20\x09-\x0d]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        some += len(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None,) * 3
        gone = {x for s, size, q in runs for x in range(s + q, s + size)}
        lines, left = "".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(x for i, x in enumerate(words) if i not in gone)
        want = (d.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())
        assert tuple(got[d.doc_id]) == want
    assert some > 20
    out = periodic_runs.find_runs(docs)
    assert out.count() == len(rows) and periodic_runs.find_runs(docs.limit(0)).count() == 0
    long = out.filter("doc_id = 9004").first()
    assert [tuple(x) for x in long.runs] == [(0, 12000, 4)] and long.collapsed == "alpha beta gamma delta"
    assert {(r.n_words, r.collapsed) for r in out.filter("doc_id in (9001, 9002, 9003)").collect()} == {(0, "")}


# --- importance resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_draw(rows, target, percent=5, least_words=20):
    held = [(i, *features(t)) for i, t in rows]
    count = lambda all_grams: np.bincount([g % 10_000 for grams in all_grams for g in grams], minlength=10_000) if any(all_grams) else np.zeros(10_000, int)
    s, t = count([x[2] for x in held]), count([features(x)[1] for x in target])
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10_000) / ((int(a) + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, n, grams in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[g % 10_000] for g in grams)
        out.append((i, n, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((k for k, x in enumerate(out) if x[1] >= least_words), key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0, out[k][2]))
    rank = {k: place + 1 for place, k in enumerate(order[: percent * len(order) // 100])}
    return sorted(((x[0], *x[2:], rank.get(k)) for k, x in enumerate(out)), key=repr)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_draws_equal_a_sort(spark, docs, rows, percent):
    target = [r for i, r in rows[:40]] + [None]
    got = target_resampling.resample(docs, table(spark, list(enumerate(target))), percent=percent)
    assert drawn(got) == brute_draw(rows, target, percent)


def test_draws_of_few_and_none(spark, docs):
    few = [(1, "one two"), (2, "w " * 25), (None, "v " * 30)]
    assert drawn(target_resampling.resample(table(spark, few), docs.limit(0), percent=60)) == brute_draw(few, [], 60)
    assert target_resampling.resample(docs.limit(0), docs).count() == 0


def test_ties_share_a_hot_id(spark):
    """A third of all rows repeat one id and text: equal scores are cut into ranges all the same."""
    rows = [(7, "same words " * 12)] * 400 + [(i, f"word{i} " * 21) for i in range(800)]
    got = target_resampling.resample(table(spark, rows, 9), table(spark, [(0, "same words")]), percent=50)
    want = brute_draw(rows, ["same words"], 50)
    assert sorted(x[:4] for x in drawn(got)) == sorted(x[:4] for x in want)
    assert sorted((x[4], x[3]) for x in drawn(got) if x[4]) == sorted((x[4], x[3]) for x in want if x[4])


def test_target_resampling_query(spark, sf):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    assert drawn(QUERIES["op13_target_resampling"](spark, sf)) == brute_draw(read("documents", "doc_id"), [t for _, t in read("benchmark", "item_id")])


def test_checksums_of_grams_are_combined():
    r, hasher = random.Random(2), target_resampling.Hasher(3)
    for _ in range(100):
        texts = [" ,".join(r.choice(["a", "Bé", "日本", "x" * 70, "y" * 1000, "12"]) for _ in range(r.randint(0, 6))) for _ in range(3)]
        sizes, doc, gram = hasher.grams([t.encode() for t in texts])
        for i, t in enumerate(texts):
            assert (sizes[i], sorted(gram[doc == i].tolist())) == (features(t)[0], sorted(features(t)[1]))


def test_tournament_merges_in_order():
    r = random.Random(3)
    for _ in range(50):
        pieces = [sorted((r.randrange(50), k) for k in range(r.randint(1, 9))) for _ in range(r.randint(1, 30))]
        tree, out = target_resampling.Tournament(), []
        for piece in sorted(pieces):
            out += list(tree.take(piece[0]))
            tree.add(iter(piece))
        assert out + list(tree.take(None)) == sorted(x for piece in pieces for x in piece)


# --- media blocks


def test_written_blocks_hold_the_payload(spark, docs, rows):
    written = media.written_blocks(media.read_back(media.store(docs)))
    got = media.assemble(written).collect()
    payloads = sorted(media.payload_of((t or "").encode()) for _, t in rows)
    assert sorted(bytes(r.pcm) for r in got) == payloads
    want = sorted((str(r.doc_id), r.n_bytes, len(r.media), hashlib.sha256(r.media).hexdigest(), r.feature) for r in media.read_back(media.store(docs)).collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.media_bytes, r.media_sha256, r.feature) for r in got) == want
    block = written.filter("doc_id = 9004").first().blocks[3]
    assert bytes(block.pcm) == media.payload_of(rows[[i for i, _ in rows].index(9004)][1].encode())[block.sample_offset : block.sample_offset + block.n_samples]
    with pytest.raises(Exception, match="follow one another"):
        media.assemble(written.withColumn("blocks", F.reverse("blocks")).filter("doc_id = 9004")).collect()
    assert media.assemble(media.written_blocks(media.read_back(media.store(docs.limit(0))))).count() == 0


# --- long words without spaces


def test_long_words_are_cut_where_no_merge_crosses():
    import sentencepiece

    path = sentencepiece_dropout.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    cjk = [chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(300)]
    texts = ["".join(r.choice(cjk) for _ in range(2000)), "".join(r.choice(cjk) + r.choice("abcdefgh") for _ in range(1000)), "a" * 3000, "".join(r.choice("etaoin") for _ in range(2000)), "".join(r.choice("0123456789") for _ in range(500)), "x " + "日本語テキスト" * 40 + " y", "\U0010ffff" * 100]
    plain, dropped = sentencepiece_dropout.Pieces(path, 0.0, 1), sentencepiece_dropout.Pieces(path, 0.1, 1)
    ids, bounds = plain.encode(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:])] == [library.encode(t) for t in texts]
    keys = np.arange(len(texts), dtype=np.uint64) + np.uint64(5)
    ids, bounds = dropped.encode(pa.array(texts), keys)
    for t, k, a, z in zip(texts, keys, bounds, bounds[1:]):
        assert dropped.decode(ids[a:z]).decode() == t
        if " " not in t:
            assert ids[a:z].tolist() == dropped.segment(" " + t, int(sentencepiece_dropout.occurrence(np.array([k]), np.array([0]))[0]))
    assert all("".join(plain.parts(" " + t)) == " " + t for t in texts) and len(plain.parts(" " + texts[0])) > 1500
