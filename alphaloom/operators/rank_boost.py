"""Boosted trees that learn to rank securities within a date, with monotone features.

Gradients are pairwise: of two securities of one date the better one is pushed up, by how much the swap would change
the date's NDCG. All pairs count, but none is spelled out: securities of one score and one grade are met as a class, by
their number and the sum of their discounts. Trees grow level by level from histograms that Spark sums: a task adds up its rows'
gradients by node, feature and bin, and only those sums (nodes by features by bins) reach the driver, which picks
the splits. Rows with their scores are written to the shared folder after each tree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.sources.store import written

PAIR_ROWS = 512  # distinct scores of a date compared with all others at once


def relevance(df: DataFrame, label: str, grades: int = 5) -> DataFrame:
    """``df`` with rel: the grade 0..``grades`` - 1 of the label within its date (null label: null), ties in one grade."""
    known = F.when(F.col(label).isNotNull(), F.col(label))
    below = F.rank().over(W.partitionBy("dt", known.isNull()).orderBy(known)) - 1
    n = F.count(known).over(W.partitionBy("dt"))
    return df.withColumn("rel", F.when(known.isNotNull(), F.floor(below * grades / n).cast("int")))


def ndcg(df: DataFrame, score: str, k: int = 10) -> DataFrame:
    """dt, n, ndcg of the first ``k`` by score (ties by code) against the best order, with gains 2^rel - 1; null if nothing is relevant.

    Rows of unknown score or rel do not count.
    """
    known = df.filter(F.col(score).isNotNull() & F.col("rel").isNotNull())
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    place = F.row_number().over(W.partitionBy("dt").orderBy(F.desc(score), "code"))
    best = F.row_number().over(W.partitionBy("dt").orderBy(F.desc("rel"), "code"))
    discounted = lambda p: F.sum(F.when(F.col(p) <= k, gain / F.log2(F.col(p) + 1)).otherwise(0.0))
    out = known.withColumns({"_p": place, "_b": best}).groupBy("dt").agg(F.count(F.lit(1)).alias("n"), discounted("_p").alias("dcg"), discounted("_b").alias("ideal"))
    return out.select("dt", "n", F.try_divide("dcg", F.nullif("ideal", F.lit(0.0))).alias("ndcg"))


def lambdas(score: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each row of one date, from all pairs of different rel.

    Rows of a lower score all lie behind a row, so their distances in discount sum to their number times its discount
    less the sum of theirs; equal scores are summed up to a row's place and from it. That takes n rows times the grades
    and the distinct scores squared, of which trees make few (8 to the number of trees, at depth 3), not n squared.
    """
    n = len(score)
    order = np.lexsort((np.arange(n), -score))
    discount = 1 / np.log2(np.arange(n) + 2.0)  # by place
    gain = 2.0**rel - 1
    ideal = (np.sort(gain)[::-1] * discount).sum()
    g, h = np.zeros(n), np.zeros(n)
    if ideal <= 0:
        return g, h
    score, grades, grade = score[order], *np.unique(rel[order], return_inverse=True)
    first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    level = np.cumsum(np.r_[False, score[1:] != score[:-1]])
    levels, s = score[first], len(first)
    count, total = (np.bincount(level * len(grades) + grade, w, s * len(grades)).reshape(s, -1) for w in (None, discount))
    worth = np.abs(2.0 ** grades[:, None] - 2.0**grades) / ideal
    way = np.sign(grades[None, :] - grades[:, None])  # [own, other]: -1 where the own grade is better, which lowers g
    g_slope, g_rest, h_slope, h_rest = (np.zeros((s, len(grades))) for _ in range(4))  # sums are linear in a row's discount
    for a in range(0, s, PAIR_ROWS):
        own = slice(a, a + PAIR_ROWS)
        gap = np.clip(levels[own, None] - levels, -50, 50)
        side = np.sign(np.arange(s) - np.arange(s)[own, None])  # 1: the other score is lower
        doubt = 1 / (1 + np.exp(gap))
        bend = side * doubt * (1 - doubt)
        h_slope[own], h_rest[own] = bend @ count @ worth, -(bend @ total @ worth)
        for sign, push in ((-1, side * doubt), (1, side * (1 - doubt))):
            part = np.where(way.T == sign, sign * worth, 0)  # [other, own]
            g_slope[own] += push @ count @ part
            g_rest[own] -= push @ total @ part
    own_g = g_slope[level, grade] * discount + g_rest[level, grade]
    own_h = h_slope[level, grade] * discount + h_rest[level, grade]
    for k in range(len(grades)):  # partners of one score, where the doubt is a half
        seen, passed = np.cumsum(grade == k), np.cumsum(np.where(grade == k, discount, 0))
        seen, passed = (x - (x[first] - y[first])[level] for x, y in ((seen, grade == k), (passed, np.where(grade == k, discount, 0))))
        apart = (2 * seen - count[level, k]) * -discount + 2 * passed - total[level, k]
        own_g += way[grade, k] * worth[grade, k] * apart / 2
        own_h += worth[grade, k] * apart / 4
    g[order], h[order] = own_g, own_h
    return g, h


@dataclass
class Node:
    value: float
    low: float = -np.inf
    high: float = np.inf
    feature: int = -1  # -1: a leaf
    cut: int = 0  # bins up to this go left
    left: int = -1
    right: int = -1


@dataclass
class RankModel:
    features: list[str]
    edges: list[list[float]]
    trees: list[list[Node]] = field(default_factory=list)

    def bins(self) -> Column:
        """Each feature's bin: how many edges lie below it; an unknown value is in bin 0."""
        one = lambda f, edges: F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: F.col(f) > e))
        return F.array(*(one(f, e) for f, e in zip(self.features, self.edges)))

    def left(self, node: Node) -> Column:
        """Whether a row's bin is up to the node's cut: its value is not above that edge (or unknown)."""
        edges = self.edges[node.feature]
        return ~F.coalesce(F.col(self.features[node.feature]) > edges[node.cut], F.lit(False)) if node.cut < len(edges) else F.lit(True)

    def score(self) -> Column:
        """The sum of all trees, from the features' values: their bins need not be found."""
        return reduce(lambda a, tree: a + tree_value(tree, self.left), self.trees, F.lit(0.0))


def binned(node: Node) -> Column:
    return F.col("bins")[node.feature] <= node.cut


def tree_value(tree: list[Node], left: Callable[[Node], Column] = binned, at: int = 0) -> Column:
    node = tree[at]
    if node.feature < 0:
        return F.lit(float(node.value))
    return F.when(left(node), tree_value(tree, left, node.left)).otherwise(tree_value(tree, left, node.right))


def tree_node(tree: list[Node], at: int = 0) -> Column:
    """The number of the leaf that a row falls in."""
    node = tree[at]
    if node.feature < 0:
        return F.lit(at)
    return F.when(binned(node), tree_node(tree, node.left)).otherwise(tree_node(tree, node.right))


def best_split(hist: np.ndarray, node: Node, monotone: list[int], ridge: float, least: int) -> tuple[float, int, int, float, float] | None:
    """(gain, feature, cut, left value, right value) from sums (features, bins, [g, h, n]), within the node's bounds and the monotone directions."""
    value = lambda s: np.clip(-s[..., 0] / (s[..., 1] + ridge), node.low, node.high)
    worth = lambda s, v: -(s[..., 0] * v + 0.5 * (s[..., 1] + ridge) * v * v)
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist[0].sum(axis=0)
    right = whole - left
    a, b = value(left), value(right)
    gain = worth(left, a) + worth(right, b) - worth(whole, value(whole))
    ok = (left[..., 2] >= least) & (right[..., 2] >= least)
    for f, way in enumerate(monotone):
        if way:
            ok[f] &= way * (b[f] - a[f]) >= 0
    gain = np.where(ok, gain, -np.inf)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, cut]), int(f), int(cut), float(a[f, cut]), float(b[f, cut])) if gain[f, cut] > 1e-12 else None


def fit(df: DataFrame, features: list[str], label: str, monotone: dict[str, int] | None = None, trees: int = 10, depth: int = 3, rate: float = 0.3, bins: int = 32, grades: int = 5, ridge: float = 1e-3, least: int = 20) -> RankModel:
    """Learns to rank by ``label`` within dates (code, dt, features, label).

    ``monotone`` maps a feature to 1 (the score never falls with it) or -1. Rows without a label do not count. Quantile
    edges come from sketches with a rank error of one in 10,000. A date's securities are compared in one
    task, as classes of one score and grade (``lambdas``).
    """
    known = relevance(df.filter(F.col(label).isNotNull() & F.col("dt").isNotNull()), label, grades)
    known = written(known.select("code", "dt", "rel", *features), "rank-known")  # read for the edges, then for the bins
    shares = [k / bins for k in range(1, bins)]
    found = known.agg(*(F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"e{i}") for i, f in enumerate(features))).first()
    model = RankModel(features, [sorted(set(e or [])) for e in found])
    ways = [(monotone or {}).get(f, 0) for f in features]
    rows = written(known.select("code", "dt", "rel", model.bins().alias("bins"), F.lit(0.0).alias("score")), "rank-rows")

    def slopes(date: pa.Table) -> pa.Table:
        date = date.sort_by("code")
        g, h = lambdas(date["score"].to_numpy(), date["rel"].to_numpy())
        return date.append_column("g", pa.array(g)).append_column("h", pa.array(h))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", g double, h double"
    for _ in range(trees):
        pushed = written(rows.groupBy("dt").applyInArrow(slopes, schema), "rank-slopes")
        tree = [Node(0.0)]
        frontier = [0]
        for _ in range(depth):
            tall = pushed.select(tree_node(tree).alias("node"), F.posexplode("bins").alias("feature", "bin"), "g", "h").filter(F.col("node").isin(frontier))
            sums = tall.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).collect()  # nodes by features by bins
            hist = {at: np.zeros((len(features), bins, 3)) for at in frontier}
            for r in sums:
                hist[r.node][r.feature, r.bin] = r.g, r.h, r.n
            grown = []
            for at in frontier:
                cut = best_split(hist[at], tree[at], ways, ridge, least)
                if cut is None:
                    continue
                _, f, place, a, b = cut
                node = tree[at]
                low, high = [(node.low, node.high)] * 2
                if ways[f]:  # neither side may pass the middle, so no later split can undo the order
                    middle = (a + b) / 2
                    low, high = ((node.low, middle), (middle, node.high)) if ways[f] > 0 else ((middle, node.high), (node.low, middle))
                node.feature, node.cut, node.left, node.right = f, place, len(tree), len(tree) + 1
                tree += [Node(a, *low), Node(b, *high)]
                grown += [node.left, node.right]
            frontier = grown
            if not frontier:
                break
        if len(tree) == 1:
            break
        for node in tree:
            node.value *= rate
        model.trees.append(tree)
        rows = written(pushed.select("code", "dt", "rel", "bins", (F.col("score") + tree_value(tree)).alias("score")), "rank-rows")
    return model


def predict(model: RankModel, df: DataFrame, name: str = "ranked") -> DataFrame:
    return df.withColumn(name, model.score())


def importance(model: RankModel) -> dict[str, int]:
    """How often each feature splits."""
    return {f: sum(n.feature == i for tree in model.trees for n in tree) for i, f in enumerate(model.features)}
