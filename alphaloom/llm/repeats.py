"""Byte strings that repeat anywhere in a corpus, by interval trees of suffix arrays that never leave a task.

1. Anchors. Every window of ``least`` bytes has a least 32-byte gram (by hash), which depends on the
   window's bytes alone. Neighbouring windows with the same one form a stretch; each window lies in one
   stretch, and equal windows lie in stretches of equal anchor. So two windows can only be equal inside
   a group of stretches with one anchor.
2. Stretches are counted by anchor and content hash (about one row of 40 bytes for 185 bytes of text).
   Those that occur again as a whole repeat as a whole; an anchor met once, at one place of its stretch,
   holds no repeat.
3. Of the other groups each different content is cut from its text once and sent to its group, where an
   enhanced suffix array gives the tree of common-prefix intervals (``suffix_tree``). Its left-diverse
   nodes are the maximal repeats inside the group; the deepest one at each position marks its bytes.
4. A group whose contents exceed ``chunk`` bytes is dealt by content hash to several trees. Nodes of
   different trees with the same first ``least`` bytes are one node: the trees' labels at that depth
   (128-bit digests, in digest ranges) are merged, and what was alone in its tree may meet others.

A text is shuffled twice: to cut contents from it and to lose its repeats. Keys that hold over a
thousandth of the rows of a join are broadcast (fewer than a thousand).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, giving_back, text_of
from .suffix_tree import Repeats, maximal_repeats
from .token_counts import slices

LEAST, GRAM = 400, 32
CHUNK = 1_000_000  # bytes of one tree's strings, about
SLICE = 1_000_000  # text bytes anchored together
LONGEST = 4096  # windows of a stretch; a longer one is cut
HOT = 1000  # a key with over one in so many rows is broadcast


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each position on."""
    x = raw.astype(np.uint64) + np.uint64(1)
    step = 1
    with np.errstate(over="ignore"):
        while step < gram:
            x = (x[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[step:] + (x[:-step] >> np.uint64(31)))
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            step *= 2
        return x ^ (x >> np.uint64(32))


def _least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on, from running minima of blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches_of(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Of each stretch of texts of ``least`` bytes or more: text number, first byte, size, anchor, content hash, and whether its anchor occurs twice in it."""
    gram = 1
    while gram < GRAM and 8 * gram <= least:
        gram *= 2
    long = np.flatnonzero(np.fromiter(map(len, texts), np.int64, len(texts)) >= least)
    if not len(long):
        return (*(np.empty(0, np.int64) for _ in range(5)), np.empty(0, bool))
    joined = b"".join([texts[i] for i in long])
    sizes = np.fromiter((len(texts[i]) for i in long), np.int64, len(long))
    begins = np.cumsum(sizes) - sizes
    grams, width = _gram_hashes(np.frombuffer(joined, np.uint8), gram), least - gram + 1
    anchor = _least_ahead(grams, width)
    windows = sizes - least + 1
    owner = np.repeat(np.arange(len(long)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = anchor[begins[owner] + nth]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(owner)))
    pieces = -(-size // LONGEST)
    if int(pieces.max()) > 1:
        start = np.repeat(start, pieces) + LONGEST * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(np.append(start, len(owner)))
    view, first = memoryview(joined), (begins[owner[start]] + nth[start]).tolist()
    twice = np.fromiter((np.count_nonzero(grams[a : a + n + width - 1] == m) > 1 for a, n, m in zip(first, size.tolist(), anchor[start])), bool, len(start))
    size = size + least - 1
    content = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + n]) for a, n in zip(first, size.tolist())), np.uint64, len(start))
    return long[owner[start]], nth[start], size, anchor[start].view(np.int64), content.view(np.int64), twice


def _rows(docs: DataFrame) -> DataFrame:
    """(id, body, text): id and body (a hash of the text, odd where the id is null) tell rows apart; rows equal in both have the same repeats."""
    text, doc_id = text_of("text"), F.col("doc_id").cast("long")
    body = F.xxhash64(text).bitwiseAND(F.lit(-2)) + doc_id.isNull().cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), body.alias("body"), text.alias("text"), doc_id.alias("doc_id"))


def stretches(rows: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                doc, at, size, h, d, twice = stretches_of(b.column("text").cast(pa.binary()).to_pylist(), least)
                key = [b.column(k).take(pa.array(doc)) for k in ("id", "body")]
                yield pa.RecordBatch.from_arrays([*key, pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(h), pa.array(d), pa.array(twice)], ["id", "body", "at", "size", "h", "d", "twice"])

    return rows.select("id", "body", "text").mapInArrow(giving_back(run), "id long, body long, at int, size int, h long, d long, twice boolean")


def join_counted(left: DataFrame, right: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join with a table that has each key once and its number n of rows in ``left``, of ``total``; hot keys are broadcast."""
    is_hot = F.col("n") * HOT > total
    hot = F.broadcast(right.filter(is_hot))
    rest = left.join(hot.select(*on), on, "left_anti").join(right.filter(~is_hot), on)
    return left.join(hot, on).unionByName(rest)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents out of texts: each text comes with the list of those that are wanted of it."""
    names = ["h", "chunk", "d", "chunks", "alone", "at"]
    for b in batches:
        lists = b.column("wanted")
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        texts = [memoryview(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        begin, size = flat.field("at").to_numpy(), flat.field("size").to_numpy()
        owners = pa.array(owner)
        fixed = [flat.field(k) for k in names]
        a = 0
        while a < len(owner):
            z = a + int(np.searchsorted(np.cumsum(size[a : a + 4096]), 2_000_000)) + 1
            content = [bytes(texts[o][i : i + n]) for o, i, n in zip(owner[a:z].tolist(), begin[a:z].tolist(), size[a:z].tolist())]
            keys = [b.column(k).take(owners[a:z]) for k in ("id", "body")]
            yield pa.RecordBatch.from_arrays([*(c[a:z] for c in fixed), *keys, pa.array(content, pa.binary())], [*names, "id", "body", "content"])
            a = min(z, len(owner))


_CONTENT = "h long, chunk int, d long, chunks int, alone boolean, at int, id long, body long, content binary"
_RANGE = "array<struct<a:int,z:int>>"
_FOUND = f"id long, body long, ranges {_RANGE}, h long, part int, g1 array<long>, g2 array<long>, ids array<long>, bodies array<long>, ats array<int>"
_FOUND_ARROW = pa.schema([("id", pa.int64()), ("body", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))), ("h", pa.int64()), ("part", pa.int32()), *((k, pa.list_(pa.int64())) for k in ("g1", "g2", "ids", "bodies")), ("ats", pa.list_(pa.int32()))])


def _covered(found: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the joined strings' stretches under maximal repeats; none crosses into another string."""
    at = np.flatnonzero(found.reach)
    edge = np.zeros(len(found.reach) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + found.reach[at], -1)
    inside = np.cumsum(edge[:-1]) > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (found.array.owner[1:] != found.array.owner[:-1])
    end = inside.copy()
    end[:-1] &= ~inside[1:] | (found.array.owner[1:] != found.array.owner[:-1])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _labels(found: Repeats, rows: list[dict], least: int) -> Iterator[dict]:
    """Digests of the windows of one chunk, once each; those alone in it carry their place."""
    sa, view = found.array, memoryview(found.array.raw)
    where = np.concatenate([np.flatnonzero(found.alone), found.shared])
    digest = [xxhash.xxh3_128_intdigest(view[p : p + least]) for p in where.tolist()]
    g1 = np.array([x >> 64 for x in digest], np.uint64)
    g2 = np.array([x & (1 << 64) - 1 for x in digest], np.uint64)
    single = np.arange(len(where)) < int(found.alone.sum())
    owner = sa.owner[where]
    single &= np.array([r["alone"] for r in rows], bool)[owner] if len(rows) else single
    column = lambda k: np.array([r[k] for r in rows], np.int64)[owner]
    at = np.where(single, column("at") + where - sa.begins[owner], -1)
    ids, bodies = np.where(single, column("id"), 0), np.where(single, column("body"), 0)
    chunks = rows[0]["chunks"]
    part = ((g1 >> np.uint64(32)) * np.uint64(chunks) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield {"h": rows[0]["h"], "part": int(part[own[0]]), "g1": g1[own].view(np.int64), "g2": g2[own].view(np.int64), "ids": ids[own], "bodies": bodies[own], "ats": at[own]}


def _marked(found: Repeats, rows: list[dict], least: int) -> Iterator[pa.RecordBatch]:
    """Covered ranges of contents that occur once, and labels of a chunk that has others beside it."""
    out = []
    first, end = _covered(found)
    owner = found.array.owner[first]
    cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
    for i in np.unique(owner).tolist():
        if rows[i]["alone"]:
            shift, own = rows[i]["at"] - int(found.array.begins[i]), slice(cuts[i], cuts[i + 1])
            out.append({"id": rows[i]["id"], "body": rows[i]["body"], "ranges": [{"a": a + shift, "z": z + shift} for a, z in zip(first[own].tolist(), end[own].tolist())]})
    if rows[0]["chunks"] > 1:
        out += _labels(found, rows, least)
    for k in range(0, len(out), 1000):
        yield pa.RecordBatch.from_pylist(out[k : k + 1000], schema=_FOUND_ARROW)


_OCCURRENCE = "h long, d long, at int, label string, length int, parent string"


def _listed(found: Repeats, rows: list[dict], least: int) -> Iterator[pa.RecordBatch]:
    """Every position at which a maximal repeat begins, with the innermost one there."""
    sa, view = found.array, memoryview(found.array.raw)
    label = [f"{xxhash.xxh3_128_intdigest(view[p : p + n]):032x}" for n, p in ((n, int(sa.order[k])) for n, k, _, _ in found.nodes)]
    at = np.flatnonzero(found.deepest >= 0)
    node, owner = found.deepest[at], sa.owner[at]
    parent = [label[x[3]] if x[3] >= 0 else None for x in found.nodes]
    columns = [[rows[i]["h"] for i in owner], [rows[i]["d"] for i in owner], (at - sa.begins[owner]).astype(np.int32), [label[k] for k in node], found.reach[at].astype(np.int32), [parent[k] for k in node]]
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()))], ["h", "d", "at", "label", "length", "parent"])


def search(least: int, most: int, report=_marked):
    """mapInArrow function: contents ordered by (h, chunk, d) to what ``report`` says of their trees."""

    def trees(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield from report(maximal_repeats([r["content"] for r in rows], least), rows, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = [], [], 0  # whole groups that share a tree, and the group that comes in
        for b in batches:
            for r in b.to_pylist():
                if group and (group[-1]["h"], group[-1]["chunk"]) != (r["h"], r["chunk"]):
                    if group[0]["chunks"] > 1:  # a chunk's tree holds nothing else
                        yield from trees(group)
                    else:
                        held += group
                        size += sum(len(x["content"]) for x in group)
                    if size >= most:
                        yield from trees(held)
                        held, size = [], 0
                    group = []
                if not group or group[-1]["d"] != r["d"]:  # a row that the table repeats has the same contents
                    group.append(r)
        if group and group[0]["chunks"] > 1:
            yield from trees(group)
            group = []
        yield from trees(held + group)

    return run


def _merge_labels(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Labels of one digest range of one group, from all its chunks: places whose label another chunk has too."""

    def settle(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        g1, g2, ids, bodies, ats = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in ("g1", "g2", "ids", "bodies", "ats"))
        order = np.lexsort((g2, g1))
        same = (g1[order[1:]] == g1[order[:-1]]) & (g2[order[1:]] == g2[order[:-1]])
        again = np.zeros(len(g1), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.flatnonzero(again & (ats >= 0))
        if not len(hit):
            return
        hit = hit[np.lexsort((ats[hit], bodies[hit], ids[hit]))]
        cut = np.flatnonzero((np.diff(ids[hit]) != 0) | (np.diff(bodies[hit]) != 0)) + 1
        rows = [{"id": int(ids[own[0]]), "body": int(bodies[own[0]]), "ranges": [{"a": a, "z": a + least} for a in ats[own].tolist()]} for own in np.split(hit, cut)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_FOUND_ARROW)[:3]))

    parts: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if parts and (parts[-1]["h"], parts[-1]["part"]) != (r["h"], r["part"]):
                yield from settle(parts)
                parts = []
            parts.append(r)
    if parts:
        yield from settle(parts)


class Anchored:
    """Stretches that may hold repeats, and the contents of groups that need a tree."""

    def __init__(self, rows: DataFrame, least: int, chunk: int):
        held = Written(stretches(rows, least), "repeat-stretches").df
        self.total = held.count()
        heads = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.expr("count(1) > 1 and min(d) = max(d)").alias("same"), F.max("twice").alias("again")).filter("n > 1 or again")
        #: id, body, at, size, h, d, same: stretches whose anchor occurs again; ``same``: all of its stretches are equal.
        self.matched = Written(join_counted(held.drop("twice"), Written(heads.drop("again"), "repeat-anchors").df, ["h"], self.total).drop("n"), "repeat-matched").df
        self.mixed = self.matched.filter("not same")
        place = F.struct("id", "body", "at")
        self.each = Written(self.mixed.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max("size").alias("size")), "repeat-contents").df
        groups = self.each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / chunk).cast("int").alias("chunks"))
        dealt = join_counted(self.each.withColumnRenamed("n", "times"), Written(groups, "repeat-groups").df, ["h"], self.each.count())
        one = F.struct(F.col("first.at").alias("at"), "size", "h", "d", (F.col("times") == 1).alias("alone"), F.pmod("d", "chunks").cast("int").alias("chunk"), "chunks")
        wanted = dealt.groupBy("first.id", "first.body").agg(F.collect_list(one).alias("wanted"))
        contents = rows.select("id", "body", "text").join(wanted, ["id", "body"]).mapInArrow(giving_back(_cut), _CONTENT)
        self.tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.contents = contents.repartition(self.tasks, "h", "chunk").sortWithinPartitions("h", "chunk", "d")

    def again(self) -> DataFrame:
        """Stretches of ``mixed`` whose whole content occurs again."""
        return join_counted(self.mixed, self.each.filter("n > 1").select("h", "d", "n"), ["h", "d"], self.total)


def repeated_ranges(rows: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(id, body, ranges) of the rows of ``_rows`` that hold a window of ``least`` bytes which also starts elsewhere; ranges may overlap."""
    held = Anchored(rows, least, chunk)
    found = Written(held.contents.mapInArrow(giving_back(search(least, chunk)), _FOUND), "repeat-found").df
    labels = found.filter("part is not null").drop("id", "body", "ranges").repartition(held.tasks, "h", "part").sortWithinPartitions("h", "part")
    met = labels.mapInArrow(giving_back(lambda batches: _merge_labels(batches, least)), f"id long, body long, ranges {_RANGE}")
    columns = ["id", "body", "ranges"]
    whole = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("z"))).cast(_RANGE).alias("ranges")
    stretched = held.matched.filter("same").select("id", "body", whole).unionByName(held.again().select("id", "body", whole))
    spans = stretched.unionByName(found.filter("part is null").select(*columns)).unionByName(met)
    return spans.groupBy("id", "body").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def repeat_groups(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Maximal repeat groups with all occurrences: (label, length, parent, doc_id, start), one row for each occurrence.

    A repeat is maximal inside its stretches (up to about twice ``least`` bytes), so a longer one comes as
    overlapping groups with the same documents. ``label`` tells groups apart by their bytes, ``parent`` is the
    shorter group around it, and a position is listed under its innermost group: the occurrences of a group
    are those listed under it or under a group that it is an ancestor of. Stretches that occur again whole
    are groups of their own (label of anchor and content). In a group of more than ``chunk`` bytes a
    repeat that no tree holds twice is left to ``remove_repeats``.
    """
    held = Anchored(_rows(docs), least, chunk)
    listed = Written(held.contents.mapInArrow(giving_back(search(least, chunk, _listed)), _OCCURRENCE), "repeat-listed").df
    n = held.each.select("h", "d", "n")
    nodes = listed.withColumnRenamed("at", "inside").join(n, ["h", "d"])
    alone = nodes.filter("n = 1").join(held.each.select("h", "d", "first.*"), ["h", "d"])
    several = nodes.filter("n > 1").join(held.mixed.select("h", "d", "id", "body", "at"), ["h", "d"])
    columns = ["label", "length", "parent", "id", "body"]
    inner = alone.unionByName(several).select(*columns, (F.col("at") + F.col("inside")).alias("start"))
    whole = held.matched.filter("same").select("id", "body", "at", "size", "h", "d").unionByName(held.again().select("id", "body", "at", "size", "h", "d"))
    whole = whole.select(F.concat(F.hex("h"), F.lit("-"), F.hex("d")).alias("label"), F.col("size").alias("length"), F.lit(None).cast("string").alias("parent"), "id", "body", F.col("at").alias("start"))
    out = inner.unionByName(whole)
    return out.select("label", "length", "parent", F.when(F.col("body").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias("doc_id"), "start")


def _lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ranges")
        flat = lists.flatten()
        a, z = (flat.field(k).to_numpy().astype(np.int64) for k in ("a", "z"))
        cuts, given = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        cuts = cuts - cuts[0]
        kept, spans = [], []
        for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            own, out, now = [], [], 0
            if given[i]:
                begin, end = a[cuts[i] : cuts[i + 1]], z[cuts[i] : cuts[i + 1]]
                order = np.argsort(begin)
                begin, end = begin[order], np.maximum.accumulate(end[order])
                fresh = np.ones(len(begin), bool)
                fresh[1:] = begin[1:] > end[:-1]
                last = np.append(np.flatnonzero(fresh)[1:] - 1, len(begin) - 1)
                own = list(zip(begin[fresh].tolist(), end[last].tolist()))
            for x, y in own:
                out.append(text[now:x])
                now = y
            kept.append(b"".join([*out, text[now:]]))
            spans.append([{"start": x, "length": y - x} for x, y in own])
        n_bytes = pa.array([len(t) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.int64())
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans (removed runs: start, length in bytes), kept (binary).

    Texts are UTF-8 bytes; null is empty. A byte goes if a string of ``least`` bytes that covers it also
    starts anywhere else, in the same text or another; all strings are judged on the input, and matches
    never cross texts. ``kept`` may begin or end inside a character. Rows are told apart whatever
    their doc_id: equal texts of ``least`` bytes lose everything, also under one id or a null one. Texts
    under ``least`` bytes stay whole; an empty table gives an empty result; other columns are not read.
    """
    rows = _rows(docs)
    ranges = repeated_ranges(rows, least, chunk)
    both = rows.join(ranges, ["id", "body"], "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(giving_back(_lose), "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")


def removed_bytes() -> Column:
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)")
