"""The ten training-data operators and the pipeline on a small table with every odd case, against plain Python."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from alphaloom.llm import components, crf, exact_dedup, features, flac, hamming_index, line_dedup, media, packing, pii, quality_fm, sentencepiece_dropout, simhash, token_counts, toxicity
from alphaloom.llm.queries import QUERIES

BLANKS = "[\x20\x09-\x0d]"
LONG = "alpha beta gamma delta " * 6000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, row string, gone string, score double, part long, salt int, content string"


@pytest.fixture(scope="module")
def rows(spark, sf):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, LONG), (9005, "Same line of text\nother"), (9006, "same LINE of text \nSame line of text\n"), (9007, real[3][1]), (9008, real[3][1] + " "), (9009, "日本語" * 50 + " <|endoftext|> é́"), (9010, "a b c"), (9010, "a b c"), (None, "a b c"), (-5, "a\x0bb"), (9011, "x" * 5000)]
    return real + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "s", "r", "g", 0.5, 1, 2, "c") for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_line_dedup(docs, rows, empty):
    key = lambda line: re.sub(f"^{BLANKS}+|{BLANKS}+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches in (1, 4):
        assert by_row(line_dedup.dedup_lines(docs, batches=batches), "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)
    assert line_dedup.dedup_lines(empty).count() == 0


#: Ids repeated with other texts, beside copies.
REPEATED = [(7, "hello world aaa one"), (7, "first unique line zz"), (1, "hello world aaa one"), (9, "same text of nine"), (9, "same text of nine"), (9, "sametext of nine"), (None, "lonely"), (None, "lonely"), (3, "hello  world aaa one"), (None, "same text of nine"), (7, None), (7, "")]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(REPEATED)], "doc_id long, text string, row int").repartition(3)


def test_repeated_ids_lose_only_their_copies(repeated):
    lines = by_row(line_dedup.dedup_lines(repeated, batches=2), "doc_id", "n_dropped", "kept_text")
    assert (7, 1, "") in lines and (7, 0, "first unique line zz") in lines and (1, 0, "hello world aaa one") in lines and lines.count((9, 0, "same text of nine")) == 2
    exact = by_row(exact_dedup.keep_exact(repeated), "doc_id", "text")
    assert exact == sorted([(3, "hello  world aaa one"), (7, "first unique line zz"), (9, "same text of nine"), (None, "lonely"), (7, next(t for i, t in exact if i == 7 and not t))], key=repr)
    near = by_row(simhash.keep_first(repeated), "doc_id", "text")
    groups = {}
    for i, t in REPEATED:
        groups.setdefault(brute_fingerprint(t), set()).add((i is None, i or 0, i))
    assert sorted((min(g)[2] for g in groups.values()), key=repr) == sorted((i for i, _ in near), key=repr) and (7, "first unique line zz") in near
    assert exact_dedup.keep_exact(repeated).columns == simhash.keep_first(repeated).columns == repeated.columns


def test_components_with_hubs(spark):
    edges = [(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(2000, 2040)] + [(5000, i) for i in range(4000, 4900)] + [(4500, 2010), (7, 7)]
    got = {r.u: r.v for r in components.component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 900)} | {i: 2000 for i in [*range(2001, 2041), *range(4000, 4900), 5000]}
    assert got == want


def test_line_runs_hold_each_hash_once(spark, docs):
    index = line_dedup.LineRuns(spark, fanout=2)
    lines = line_dedup.line_hashes(docs.select("doc_id", "text"), 10)
    for k in range(5):
        index.add(lines.filter(F.pmod("doc_id", F.lit(5)) == k))
    assert max(len(level) for level in index.levels) < 2
    entries = index.entries()
    assert entries.count() == entries.select("h1", "h2").distinct().count() == lines.select("h1", "h2").distinct().count()


def test_line_runs_are_merged_as_they_lie(spark, sf):
    index = line_dedup.LineRuns(spark, fanout=2)
    lines = line_dedup.line_hashes(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), 10)
    index.add(lines.filter("doc_id < 100"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with line_dedup._sorted_scans(spark):
        add = plan(index.fresh(lines.filter("doc_id >= 100")))
        merged = plan(line_dedup._merged([index.runs()[0].df, index.runs()[0].df]))
    assert add.count("Exchange") == 1 and add.index("SortMergeJoin") < add.index("partial_min") and add.index("Exchange") < add.index("partial_min")
    assert "Exchange" not in merged and "Sort [" not in merged and "SortMergeJoin" in merged


def test_hot_lines_meet_their_owners_by_broadcast(spark):
    texts = [(i, f"a line of every document\nonly of document {i}\nshared by {i // 2:09d}") for i in range(700)]
    hashes = line_dedup.line_hashes(spark.createDataFrame(texts, "doc_id long, text string"), 10)
    assert len(line_dedup.hot_hashes(hashes)) == 1
    index = line_dedup.LineRuns(spark, fanout=2)
    index.add(hashes)
    plan = line_dedup.owned_before(hashes, index)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.pos) for r in plan.collect()) == sorted([(i, 0) for i in range(1, 700)] + [(i, 2) for i in range(1, 700, 2)])


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(token_counts.tokenizer_path())
    want = [(i, len((t or "").encode()), len(full.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    for chunk in (2000, token_counts.CHUNK):
        got = token_counts.count_tokens(docs, chunk=chunk, overlap=64)
        assert by_row(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty).count() == 0


def test_overlap_is_widened():
    tok = token_counts.WordTokenizer(token_counts.tokenizer_path(), chunk=300, overlap=8)
    for text in ("x" * 2000 + " a b " * 100, "a1" * 700, " " * 900 + "word " * 300, "don't " * 400, "'" * 500 + "s" * 500):
        assert tok.encode_long(text).tolist() == tok.full.encode(text, add_special_tokens=False).ids


def test_splices_equal_the_library_on_mixed_scripts():
    r = random.Random(8)
    tok = token_counts.WordTokenizer(token_counts.tokenizer_path())
    pools = ["日本語漢字仮名交じり文", "abcdeeetttaaoin", "0123456789", "'!?.,;-–…", "ΟΔΟΣσςаялюбовьЖ", "éé\u0301\u0308ñ각힣ᄀ\u1161가", "😀🎉𝒳", "   \n\t", "ﬁﬃ½ǅİıß", "'s't're've'm'll'd"]
    for _ in range(400):
        tok.chunk, tok.overlap = r.choice([40, 100, 300]), r.choice([4, 8, 32])
        pool = "".join(r.choice(pools) for _ in range(r.randint(1, 4)))
        text = "".join("<|endoftext|>" if r.random() < 0.01 else r.choice(pool) for _ in range(r.randint(50, 1200)))
        assert tok.encode_long(text).tolist() == tok.full.encode(text, add_special_tokens=False).ids, text


def test_huge_texts_without_blanks_take_linear_time():
    r = random.Random(9)
    tok = token_counts.WordTokenizer(token_counts.tokenizer_path())
    for chars in ("日本語漢字仮名交文章力学大小中国人間", "7", "a", "ABCDEFGHabcdefgh0123456789+/"):
        text = "".join(r.choice(chars) for _ in range(300_000))
        began = time.process_time()
        want = tok.full.encode(text, add_special_tokens=False).ids
        library = time.process_time() - began
        assert tok.encode_long(text).tolist() == want
        assert time.process_time() - began < 6 * library + 5


def test_forgotten_words_are_encoded_again():
    small, large = (token_counts.WordTokenizer(token_counts.tokenizer_path(), limit=n) for n in (3, 1000))
    for text in ("one two three four", "two Five, six!! don't", "one é́ x1 four"):
        (a, i), (b, j) = small.encode(pa.array([text, None])), large.encode(pa.array([text, None]))
        assert a.tolist() == b.tolist() == large.full.encode(text, add_special_tokens=False).ids and i.tolist() == j.tolist()


def test_pieces(docs, rows, empty):
    import sentencepiece

    path = token_counts.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_dropout.encode_pieces(docs, dropout=0.0).collect()
    want = {i: t or "" for i, t in rows}
    for r in got:
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<i4").tolist() == library.encode(want[r.doc_id])
    one, two = (sentencepiece_dropout.encode_pieces(docs, 0.2, seed).collect() for seed in (1, 2))
    assert sorted(repr((r.doc_id, r.decoded)) for r in one) == sorted(repr((i, t or "")) for i, t in rows)
    assert {(r.doc_id, r.ids) for r in one} != {(r.doc_id, r.ids) for r in two}
    again = sentencepiece_dropout.encode_pieces(docs.repartition(2), 0.2, 1).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in again) == sorted(repr((r.doc_id, r.ids)) for r in one)
    assert sentencepiece_dropout.encode_pieces(empty).count() == 0


def test_agenda_in_lockstep_equals_the_heap():
    model = sentencepiece_dropout.Pieces(token_counts.tokenizer_path("piece_bpe_32k.model"), 0.3, 5)
    words = [" internationalisation", " a▁b", "  two", " é́x", " " + "ab" * 40, " straße", "", " unbelievable\nwords"]
    assert [x.tolist() for x in model.segment_many(words, 1)] == [model.segment(w, 1) if w else [] for w in words]


def test_every_occurrence_draws_its_own_skips(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["internationalisation", "unbelievable", "the", "straße", "a▁b", "x" * 60, "line\nbreak", "ab" * 20]
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(5)] + ["", " the  the unbelievable ", " "]
    model = sentencepiece_dropout.Pieces(token_counts.tokenizer_path("piece_bpe_32k.model"), 0.3, 5)
    keys = model.keys([*range(7), None], pa.array(texts))
    for _ in range(2):  # the second time from memory
        ids, bounds = model.encode(pa.array(texts), keys)
        for t, key, a, z in zip(texts, keys, bounds, bounds[1:]):
            chunks = re.findall(" +[^ ]*", " " + t) if t else []
            base = sentencepiece_dropout.occurrence(np.repeat(key, len(chunks)), np.arange(len(chunks)))
            assert ids[a:z].tolist() == [x for w, k in zip(chunks, base) for x in model.segment(w, int(k))]
    docs = spark.createDataFrame([(i, "internationalisation " * 200) for i in range(2)], "doc_id long, text string")
    for r in sentencepiece_dropout.encode_pieces(docs, 0.2, 1).collect():
        forms, form = set(), []
        for i in np.frombuffer(r.ids, "<i4"):
            if model.text[i][:1] == b" ":
                forms.add(tuple(form))
                form = []
            form.append(int(i))
        assert len(forms) > 10


def test_media(docs, rows, empty):
    got = QUERY_MEDIA(docs)
    for r in got:
        text = (r.t or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert r.pcm == payload and r.n_bytes == len(text)
        assert b"".join(b.pcm for b in sorted(r.blocks)) == payload
    by_text = {}
    for r in got:
        by_text.setdefault(r.t or "", set()).add((r.media, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.read_back(media.store(empty)).count() == 0


def QUERY_MEDIA(docs):
    texts = docs.select("doc_id", "text").distinct().withColumnRenamed("text", "t").filter("doc_id is not null")
    read = media.read_back(media.store(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    blocks = media.pcm_blocks(read).groupBy("doc_id").agg(F.collect_list(F.struct("sample_offset", "pcm")).alias("blocks"))
    return read.join(texts, "doc_id").join(blocks, "doc_id").collect()


def test_flac_forms_and_checksums():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), b"ab" * 3200, rng.integers(0, 256, 4096, dtype=np.uint8).tobytes(), bytes(range(256)) * 4, b"\xff\x00" * 640]
    streams = flac.encode_streams(payloads)
    assert [d.pcm for d in flac.decode_streams(streams)] == payloads
    for at in (60, len(streams[1]) - 1, len(streams[1]) // 2):
        broken = bytearray(streams[1])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(broken)])
    assert flac.crc8(b"123456789") == 0xF4
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc16(data, np.array([0]), np.array([9])).tolist() == [0xFEE8]


def test_frames_that_do_not_fit_are_decoded_in_turn(monkeypatch):
    rng = np.random.default_rng(7)
    payloads = [rng.integers(0, 256, 4096, dtype=np.uint8).tobytes(), b"plain text " * 64 * 10, bytes(64)]
    streams = flac.encode_streams(payloads)
    seeks = [d.seek for d in flac.decode_streams(streams)]
    plain, second = flac.read_header, seeks[0][1][1]

    def fooled(data, at):  # a header of frame 1 seems to lie inside frame 0
        return (1, 1024, 6) if at == second - 300 else plain(data, at)

    flat = bytearray(streams[0])
    assert flat[second : second + 2] == b"\xff\xf8"
    monkeypatch.setattr(flac, "_decode_side_by_side", lambda media: [None] * len(media))
    assert [(d.pcm, d.seek) for d in flac.decode_streams(streams)] == list(zip(payloads, seeks))
    monkeypatch.undo()
    sync = np.flatnonzero
    monkeypatch.setattr(flac, "read_header", fooled)
    monkeypatch.setattr(flac.np, "flatnonzero", lambda x: np.sort(np.append(sync(x), second - 300)) if len(x) == sum(map(len, streams)) - 1 else sync(x))
    assert [d.pcm for d in flac.decode_streams(streams)] == payloads


def test_pcm_tables_are_seekable(spark, tmp_path):
    texts = [(1, "abc" * 1500), (2, ""), (3, None), (4, "z" * 5000)]
    stored = media.store(spark.createDataFrame(texts, "doc_id long, text string"))
    media.write_pcm(stored, str(tmp_path / "pcm"), 2)
    for first, last in ((0, 10), (1000, 3100), (4000, 4096), (4990, 5000)):
        got = {}
        for r in sorted(media.seek_samples(spark, str(tmp_path / "pcm"), first, last, 2).collect()):
            got[r.doc_id] = got.get(r.doc_id, b"") + r.pcm
        want = {i: media.payload_of((t or "").encode())[first:last] for i, t in texts}
        assert got == {i: p for i, p in want.items() if p}


def test_exact_dedup(docs, rows, empty):
    norm = lambda t: re.sub(BLANKS, "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(x for x in g)[3]
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert by_row(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_exact(docs).columns == docs.columns


def test_exact_dedup_compares_contents_under_one_digest(docs, rows, monkeypatch):
    want = by_row(exact_dedup.exact_dedup(docs).drop("text_sha256"), "doc_id", "keep_id", "group_size", "kept")
    plain = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(plain(c, n), 1, 1))  # sixteen digests for all
    assert by_row(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept") == want


def check_packed(pieces, ids_of):
    """Every id in one piece, offsets without gaps, little padding."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        assert r.length == len(r.ids) // 4 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, want in ids_of.items():
        mine = sorted(by_doc[doc], key=lambda r: r.start)
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist()
        assert got == want and all(r.doc_tokens == len(want) for r in mine)
        assert [r.start for r in mine] == [0, *itertools.accumulate(r.length for r in mine)][:-1]
    padding = total = 0
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s)][:-1]
        n = sum(r.length for r in s)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
        total += n
    assert padding < 0.01 * total


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(token_counts.tokenizer_path())
    single = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {i: [*full.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows if i is not None}
    for windows in (2, 64):
        check_packed(packing.pack(single, open_windows=windows).collect(), ids)
    assert packing.pack(empty).count() == 0
    all_rows = packing.pack(docs, keep_ids=False)
    assert "ids" not in all_rows.columns and all_rows.agg(F.sum("length")).first()[0] == sum(len(full.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def brute_fingerprint(text):
    words = [w for w in re.split(f"{BLANKS}+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fps = {(i, t): brute_fingerprint(t) for i, t in rows}
    nodes = sorted(set(fps.values()))
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(nodes)), 2):
        if (nodes[a] ^ nodes[b]).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for (i, _), fp in fps.items():
        root = find(nodes.index(fp))
        least[root] = min([x for x in (least.get(root), i) if x is not None], default=None)
    want = sorted(((i, f"{fps[i, t]:016x}", least[find(nodes.index(fps[i, t]))]) for i, t in rows), key=repr)
    out = simhash.near_duplicates(docs).withColumn("hex", simhash.fingerprint_hex())
    assert by_row(out, "doc_id", "hex", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_hot_buckets(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64), axis=1) for b in base]))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    want = hamming_index.join_labels(np.arange(len(fp)), i, j)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for rows in (16, 2048):  # the small size cuts buckets into chunks
        got = np.array([(r.a, r.b) for r in simhash.links(nodes, 4, rows).collect()], np.int64).view(np.uint64)
        label = hamming_index.join_labels(np.arange(len(fp)), np.searchsorted(fp, got[:, 0]), np.searchsorted(fp, got[:, 1]))
        assert np.array_equal(label, want)


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**13])
def test_routing_never_loses_a_pair(n):
    masks = hamming_index.routing_masks(n, 4)
    rng = np.random.default_rng(3)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_pii(docs, rows, empty):
    model = crf.train(rounds=60)
    got = pii.find_pii(docs, model, mask=True).select("row.doc_id", "row.text", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked").collect()
    assert len(got) == len(rows)
    patterns = {"email": (pii.EMAIL, lambda m: True), "ip": (pii.IP, lambda m: all(int(x) <= 255 for x in m.split("."))), "card": (pii.CARD, lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))), "phone": (pii.PHONE, lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15)}
    for r in got:
        found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, (p, ok)) in enumerate(patterns.items()) for m in p.finditer(r.text or "") if ok(m[0])]
        base = [x[2] for x in sorted(found)]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert r.n_email == sum(x.startswith("email") for x in base) and r.n_phone == sum(x.startswith("phone") for x in base)
    assert pii.find_pii(empty, model).count() == 0
    masked = pii.mask_pii(docs.limit(5))
    assert masked.columns == docs.columns


def test_base_patterns_in_one_pass():
    r = random.Random(1)
    patterns = {"email": (pii.EMAIL, lambda m: True), "ip": (pii.IP, lambda m: all(int(x) <= 255 for x in m.split("."))), "card": (pii.CARD, lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))), "phone": (pii.PHONE, lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15)}
    for _ in range(20_000):
        text = "".join(r.choice(["a", "b", "@", "@", ".", ".", "-", "_", "+", "1", "2", "255", " ", "\n", "é", "%", "(", ")"]) for _ in range(r.randint(1, 60)))
        found = [(m.start(), n, m.end(), k) for n, (k, (p, ok)) in enumerate(patterns.items()) for m in p.finditer(text) if ok(m[0])]
        assert pii.base_spans(text) == [(a, z, k) for a, _, z, k in sorted(found)], text
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "#@", "a@" * 300_000, "1." * 500_000, "+1" + "." * 1_000_000, "a@b" * 300_000 + ".c"):
        began = time.process_time()
        pii.base_spans(text)
        assert time.process_time() - began < 10, text[:10]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    model = crf.Crf(moves=rng.normal(size=(len(crf.LABELS), len(crf.LABELS))))
    lengths = np.array([1, 2, 3, 3, 4])
    e = rng.normal(size=(5, 4, len(crf.LABELS)))
    got = model.decode([e[:, :3], e[:, 3:]], lengths)
    for row, n, x in zip(got, lengths, e):
        paths = list(itertools.product(range(len(crf.LABELS)), repeat=int(n)))
        total = [sum(x[i, k] for i, k in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:])) for p in paths]
        assert tuple(row[:n]) == paths[int(np.argmax(total))]


def test_words_of_one_shape_have_one_score():
    tagger = pii.Tagger(crf.train(rounds=20))
    words = ["Hello", "wORLD,", "x1²", "٣a", "A\x01b", "ﬁ½", "e-mail", "(dot)", "Dot.", "12.34", "***", "naïve", "IP", "+49", "a@b.c", "\x01"]
    scores, shape = tagger._scores(pa.array(words))
    assert all(np.allclose(scores[i], tagger.crf.scores(w)) for w, i in zip(words, shape))


def test_pii_decodes_lines_whole():
    model = crf.train(rounds=60)
    tagger, text = pii.Tagger(model), " ".join(["the"] * 40 + ["call", "+1", "(555)", "010-9999"] + ["of"] * 40) + "\nno mark here"
    words = text.split("\n")[0].split()
    own = [model.scores(w) for w in words]
    e = np.array([own[i][0] + (own[i - 1][1] if i else 0) + (own[i + 1][2] if i + 1 < len(words) else 0) for i in range(len(words))])
    labels = model.decode([e[None]], np.array([len(words)]))[0]
    spans = tagger.spans(pa.array([text])).get(0, [])
    assert sorted(i for a, z, _ in spans for i in range(a, z)) == np.flatnonzero(labels).tolist()


def test_pii_field_adds_spans():
    tagger = pii.Tagger(crf.train())
    texts = ["write to mo.la at onti dot com for more", "nothing to see here at all", "pay with card 4111.1111.1111.1111 now"]
    added = tagger.spans(pa.array(texts))
    spans = [pii.all_spans(t, pii.base_spans(t), sorted(added.get(i, []))) for i, t in enumerate(texts)]
    assert [k for _, _, k in spans[0]] == ["email"] and not spans[1] and [k for _, _, k in spans[2]] == ["card"]


def test_pii_field_reads_long_lines_whole(monkeypatch):
    tagger = pii.Tagger(crf.train())
    filler, value = ["the", "of", "and", "was", "in", "12", "la", "que"], "mo.la at onti dot com"
    texts = []
    for at in (3, *range(500, 520), 1023, 1300):  # one line of 1,400 words, marked words throughout
        words = [filler[i % 8] for i in range(1400)]
        words[at] = f"write to {value} and"
        texts.append(" ".join(words))

    def found():
        added = tagger.spans(pa.array(texts))
        return [pii.all_spans(t, [], sorted(added.get(i, []))) for i, t in enumerate(texts)]

    whole = found()
    for t, spans in zip(texts, whole):
        assert (t.index(value), t.index(value) + len(value), "email") in spans
    monkeypatch.setattr(pii, "CELLS", 3000)
    monkeypatch.setattr(pii, "BLOCK", 64)
    assert found() == whole


def held_out_accuracy(rows, labels, column):
    pairs = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([p == y for p, y in pairs])


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert held_out_accuracy(QUERIES["op9_quality"](spark, d).collect(), labels, 0) > 0.95
    assert held_out_accuracy(QUERIES["op10_toxicity"](spark, d).collect(), labels, 1) > 0.9


def test_factorisation_identity():
    rng = np.random.default_rng(4)
    n = 5 + quality_fm.TAIL
    fm = quality_fm.FactorisationMachine(0.1, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(quality_fm.TAIL), np.ones(quality_fm.TAIL))
    x = rng.normal(size=(4, n))
    pairs = [sum(fm.v[i] @ fm.v[j] * r[i] * r[j] for i, j in itertools.combinations(range(n), 2)) for r in x]
    assert np.allclose(fm.logits(x), 0.1 + x @ fm.w + pairs)


def test_counterfactual_pull_flattens_group_terms():
    texts = ["women are scum", "women are worthless scum", "men met", "women met today", "men are here", "trash scum", "women trash"] * 20
    y = np.array([1, 1, 0, 0, 0, 1, 1] * 20, float)
    gap = [abs(float(np.diff(toxicity.fit(toxicity._sets(pa.array(texts)), y, lasso=1e-4, pull=pull).logits(pa.array(["women met", "men met"])))[0])) for pull in (0.0, 50.0)]
    assert gap[1] < 0.2 * gap[0]


def test_every_other_term_is_swapped_in():
    (here, there), (_, none) = toxicity._sets(pa.array(["four women met", "nobody met"]))
    assert not none and len(there) == 3
    for other, got in zip(("men", "girls", "boys"), there):
        assert got.tolist() == toxicity._sets(pa.array([f"four {other} met"]))[0][0].tolist()


def test_toxicity_fit_meets_the_optimality_conditions():
    rng = np.random.default_rng(11)
    words = [f"word{i:03d}x" for i in range(40)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(300)]
    y = np.array([float("word003x" in t or ("word005x" in t and rng.random() < 0.8)) for t in texts])
    sets, lasso = toxicity._sets(pa.array(texts)), 5e-3
    model = toxicity.fit(sets, y, lasso=lasso)
    p = 1 / (1 + np.exp(-np.array([model.bias + model.weights[s].sum() for s, _ in sets])))
    slope = np.bincount(np.concatenate([s for s, _ in sets]), np.repeat(p - y, [len(s) for s, _ in sets]), minlength=toxicity.DIM) / len(y)
    for i in np.unique(np.concatenate([s for s, _ in sets])):  # none of these names a group
        w = model.weights[i]
        assert abs(slope[i] + lasso * np.sign(w)) < 5e-4 if w else abs(slope[i]) < lasso * 1.05
    assert abs((p - y).mean()) < 1e-3


def test_samples_hold_one_row_for_each_id(spark):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = features.labelled_sample(docs, labels, "toxic", 10**9, -1, 10).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in rows) == [(1, "b", 1), (2, None, 0)]


def test_metadata_features():
    got = quality_fm.metadata(pa.array(["abc", "abc", None, ""]), pa.array([3, None, 5, 0], pa.int64()))
    assert got[:, 1].tolist() == [0, 1, 0, 0] and got[:, 2].tolist() == [1, 0, 0, 1]


def test_classifiers_on_odd_tables(docs, empty, spark):
    labels = spark.createDataFrame([(9004, 1, 0), (None, 1, 1), (9005, None, None)], "doc_id long, quality int, toxic int")
    fm, model = quality_fm.train(docs, labels), toxicity.train(docs, labels)
    for out in (quality_fm.score_quality(docs, fm), toxicity.score_toxicity(docs, model)):
        assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_fm.score_quality(empty, fm).count() == toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [x for x, z in zip(rows, model.logits(pa.array([t for _, t in rows]))) if 1 / (1 + np.exp(-z)) < 0.3]
    best = {}
    for i, t in sorted(kept, key=lambda x: (-len(x[1]), x[0])):
        best.setdefault(re.sub(BLANKS, "", t), (i, t))
    kept = sorted(best.values())
    fps, group = [brute_fingerprint(t) for _, t in kept], list(range(len(kept)))
    near = [(a, b) for a, b in itertools.combinations(range(len(kept)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            least = min(group[a], group[b])
            moved |= group[a] != group[b]
            group[a] = group[b] = least
    want = {kept[i][0] for i, g in enumerate(group) if i == g}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == want
    # what is packed: the masked text's tokens and the end, cut into pieces without gaps
    from tokenizers import Tokenizer

    full, texts, crf_model = Tokenizer.from_file(token_counts.tokenizer_path()), dict(rows), pii.train()
    spans = pii.Tagger(crf_model).spans(pa.array([texts[i] for i in sorted(want)]))
    pieces = {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    hidden = 0
    for n, i in enumerate(sorted(want)):
        found = pii.all_spans(texts[i], pii.base_spans(texts[i]), sorted(spans.get(n, [])))
        hidden += len(found)
        ids = [*full.encode(pii.masked(texts[i], found), add_special_tokens=False).ids, 1]
        own = sorted(pieces[i])
        assert [x for _, part, _ in own for x in part] == ids and {t for _, _, t in own} == {len(ids)}
        assert [s for s, _, _ in own] == list(itertools.accumulate([0] + [len(p) for _, p, _ in own]))[:-1]
    assert hidden > 0
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        assert [o for o, _ in sorted(held)] == list(itertools.accumulate([0] + [n for _, n in sorted(held)]))[:-1] and sum(n for _, n in held) <= 2048


def test_each_stage_drops_what_it_says(spark, sf):
    """Stage by stage: toxic rows go, of equal texts one stays, and columns stay those of documents until the last."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, model).filter("predicted = 1").select("row.doc_id").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(docs) - ids(clean) == bad and bad
    single = stages["exact_dedup"](spark, clean, sf)
    squeezed = [re.sub(BLANKS, "", r.text or "") for r in single.collect()]
    assert len(set(squeezed)) == len(squeezed) and set(squeezed) == {re.sub(BLANKS, "", r.text or "") for r in clean.collect()}
    masked = stages["pii"](spark, single, sf)
    assert masked.columns == docs.columns and ids(masked) == ids(single)
    assert not any(pii.base_spans(r.text) for r in masked.collect())
