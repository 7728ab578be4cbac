"""Random forests without a depth limit and with a minimum split, counted in rows.

A forest grows in two phases.  While a node holds more than a block of rows, its split is picked among the
cuts, which are quantiles of each feature; a node whose rows all fall between two cuts gets cuts of its own.
Where the cuts of all features cross in at most ``MOST_CELLS`` cells, the rows are added up by cell once and
a task a node grows all levels from the cells; else one Spark job a level adds up histograms of all such
nodes of all trees (combined before the shuffle) and a task per node picks the split.  Once a node's rows fit a block they are sent to one task, which finishes the subtree with every
distinct value as a candidate.  Subtrees stay a written table, as the number of leaves grows with the rows;
only the nodes above them (``MOST_TOP`` at most) are held by the driver and go to the tasks.

Draws are hashes: a row's weight in a tree (Poisson, mean 1) depends on seed, tree and the row's keys, the
features tried at a node on the seed and the node's path.  A forest therefore doesn't depend on partitions,
nor on the block size where a feature has no more distinct values than cuts (up to the rounding of sums, where
the target isn't a whole number or a class).

Cases: rows with a NULL target are left out; a NULL or NaN feature goes to the right of every split,
and a split may part the numbers from it; equal rows are never parted; ties between splits go to the first feature,
then to the least threshold; a frame without labelled rows is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.functions.schema import qcol
from tabsense.operators.kmeans import matrix
from tabsense.session import scratch_path

#: Rows that one task finishes, cuts of a feature, cuts of a feature where a node needs its own.
BLOCK_ROWS, CUTS, OWN_CUTS = 50_000, 1024, 64
#: Nodes above the blocks, in all trees: blocks hold more rows where these would not suffice.
MOST_TOP = 1 << 20
ACCURACY = 10_000
#: Cells of crossed cuts that one task grows nodes from, and that a task adds up before it hands them on.
MOST_CELLS, HELD_CELLS = 1 << 18, 1 << 19
#: Bytes of the answers for the rows that one task adds up.
ANSWER_BYTES = 1 << 25

_TREE = "feature array<int>, threshold array<double>, left array<int>, value array<double>, rows array<long>, gain array<double>"


def _mix(v: np.ndarray | int) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.asarray(v).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _child(key: np.ndarray, right: int) -> np.ndarray:
    return _mix(key ^ np.uint64(0x51ED + right))


def row_weights(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, by hash."""
    u = _mix(hashes.astype(np.int64).view(np.uint64) ^ _mix(seed * 1_000_003 + tree)) / 2.0 ** 64
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
    return np.searchsorted(steps, u, side="right").astype(float)


def _draw(best: np.ndarray, keys: np.ndarray, tried: int) -> np.ndarray:
    """Scores by (feature, node) with all but ``tried`` features hidden: those with a split, in the node's hashed order."""
    d = len(best)
    if tried >= d:
        return best
    order = _mix(keys[None, :] ^ _mix(np.arange(1, d + 1))[:, None]) >> np.uint64(1)
    order = np.where(best > -np.inf, order, np.uint64(1) << np.uint64(63))
    place = np.argsort(np.argsort(order, axis=0, kind="stable"), axis=0)
    return np.where(place < tried, best, -np.inf)


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Thresholds between neighbours; ``a`` itself where no number lies between."""
    with np.errstate(over="ignore", invalid="ignore"):
        m = a / 2 + b / 2
    return np.where((m >= a) & (m < b), m, a)


@dataclass(frozen=True)
class Plan:
    """What a forest is grown by."""
    classes: int  # 0: regression
    trees: int
    max_depth: int | None
    min_split: int
    min_leaf: int
    tried: int
    bootstrap: bool
    seed: int
    shift: float  # a whole number near the mean of the target, taken off while sums are added up

    @property
    def width(self) -> int:
        return max(self.classes, 1)

    def weights(self, hashes: np.ndarray, tree: int) -> np.ndarray:
        return row_weights(hashes, tree, self.seed) if self.bootstrap else np.ones(len(hashes))

    def root_key(self, tree: int) -> np.uint64:
        return np.uint64(_mix(_mix(self.seed) ^ np.uint64(tree)))

    def deep(self, depth: int) -> bool:
        return self.max_depth is not None and depth >= self.max_depth

    def sums(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Per row what a node adds up: the weight of each class, or the weighted target."""
        if not self.classes:
            return (w * (y - self.shift))[:, None]
        out = np.zeros((len(y), self.classes))
        out[np.arange(len(y)), y.astype(int)] = w
        return out

    def value(self, weight: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Mean target, or the share of each class, by node."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = sums / weight[:, None]
        return out if self.classes else out + self.shift


def _purity(weight: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Sum of squared sums over the weight: what a split makes as great as it can (variance and Gini alike)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return (sums * sums).sum(axis=-1) / weight


def _starts(g: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(g, np.arange(n))


def _best_splits(xs: np.ndarray, g: np.ndarray, n: int, rows: np.ndarray, w: np.ndarray, s: np.ndarray, least: int):
    """Best purity and threshold of each node 0..n-1 for one feature.

    Entries (rows, or bins of rows) come sorted by node and value: value, node, rows, weight, sums.
    """
    first = _starts(g, n)
    last = np.append(first[1:], len(g)) - 1
    cr, cw, cs = np.cumsum(rows), np.cumsum(w), np.cumsum(s, axis=0)
    r0, w0, s0 = cr[first] - rows[first], cw[first] - w[first], cs[first] - s[first]
    nxt = np.append(xs[1:], np.nan)
    nxt[last] = np.nan
    # a value followed by NaN inside its node also ends a side: NaN goes right
    nan_next = np.append(np.isnan(xs[1:]), False) & ~np.isnan(xs)
    nan_next[last] = False
    at = np.flatnonzero((xs < nxt) | nan_next)  # only where a value ends is there anything to score
    lr, tr = cr[at] - r0[g[at]], (cr[last] - r0)[g[at]]
    at = at[(lr >= least) & (tr - lr >= least)]
    out, threshold = np.full(n, -np.inf), np.full(n, np.nan)
    if len(at):
        of = g[at]
        lw, ls = cw[at] - w0[of], cs[at] - s0[of]
        score = _purity(lw, ls) + _purity((cw[last] - w0)[of] - lw, (cs[last] - s0)[of] - ls)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        node = of[starts]
        out[node] = np.maximum.reduceat(score, starts)
        at = np.minimum.reduceat(np.where(score == out[of], at, len(g)), starts)
        node, at = node[at < len(g)], at[at < len(g)]
        threshold[node] = np.where(nan_next[at], np.inf, _middle(xs[at], nxt[at]))
        out[np.isnan(threshold)] = -np.inf
    return out, threshold


def _sorted(g: np.ndarray, rank: np.ndarray, values: int) -> np.ndarray:
    """The order by node and rank of the value; equal ones stay in their order."""
    bits = int(len(g)).bit_length()
    if (int(g[-1]) + 1) * values >= 1 << 62 - bits:
        return np.lexsort((rank, g))
    code = (g * values + rank << bits) + np.arange(len(g))
    code.sort()
    return code & (1 << bits) - 1


def _tried(plan: Plan, keys: np.ndarray, d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Features to look at, each with its nodes, and where their scores go: by a node's hashed order until ``plan.tried`` have a split."""
    found = np.zeros(len(keys), int)
    if plan.tried >= d:
        for f in range(d):
            yield f, np.arange(len(keys)), found
        return
    order = np.argsort(_mix(keys[None, :] ^ _mix(np.arange(1, d + 1))[:, None]) >> np.uint64(1), axis=0, kind="stable")
    for turn in order:
        wanting = found < plan.tried
        for f in range(d):
            nodes = np.flatnonzero(wanting & (turn == f))
            if len(nodes):
                yield f, nodes, found


def grow(plan: Plan, x: np.ndarray, y: np.ndarray, w: np.ndarray, key: int, depth: int) -> dict[str, np.ndarray]:
    """The subtree of the given rows, all nodes of a level at once.

    Node arrays in order of levels: feature (-1 a leaf), threshold (left if not above), left child (the right
    one follows), value (``plan.width`` a node), rows, gain (what the split takes off the impurity).
    """
    s = plan.sums(y, w)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "value", "rows", "gain")}
    at = np.arange(len(y))
    g = np.zeros(len(y), int)
    keys, made, d = np.array([key], np.uint64), 1, x.shape[1]
    values, ranks = zip(*[np.unique(x[:, f], return_inverse=True) for f in range(d)])
    while len(keys):
        n = len(keys)
        first = _starts(g, n)
        count = np.diff(np.append(first, len(g)))
        weight, total = np.add.reduceat(w[at], first), np.add.reduceat(s[at], first, axis=0)
        splits = (count >= plan.min_split) & (np.minimum.reduceat(y[at], first) < np.maximum.reduceat(y[at], first))
        if plan.deep(depth):
            splits[:] = False
        feature, threshold, gain = np.full(n, -1), np.full(n, np.nan), np.zeros(n)
        if splits.any():
            own = splits[g]
            number = np.cumsum(splits) - 1
            at, g, open_keys = at[own], number[g[own]], keys[splits]
            chosen, cuts = np.full((d, len(open_keys)), -np.inf), np.full((d, len(open_keys)), np.nan)
            for f, some, found in _tried(plan, open_keys, d):
                r, h = at, g
                if len(some) < len(open_keys):
                    place = np.full(len(open_keys), -1)
                    place[some] = np.arange(len(some))
                    h = place[g]
                    r, h = at[h >= 0], h[h >= 0]
                order = _sorted(h, ranks[f][r], len(values[f]))
                r = r[order]
                chosen[f, some], cuts[f, some] = _best_splits(x[r, f], h[order], len(some), np.ones(len(r)), w[r], s[r], plan.min_leaf)
                found[some] += chosen[f, some] > -np.inf
            f = chosen.argmax(axis=0)
            top = chosen[f, np.arange(len(f))]
            feature[splits] = np.where(top > -np.inf, f, -1)
            threshold[splits] = cuts[f, np.arange(len(f))]
            gain[splits] = np.where(top > -np.inf, top - _purity(weight, total)[splits], 0.0)
        inner = feature >= 0
        left = np.full(n, -1)
        left[inner] = made + 2 * np.arange(inner.sum())
        made += 2 * int(inner.sum())
        for k, v in (("feature", feature), ("threshold", threshold), ("left", left), ("rows", count), ("gain", gain),
                     ("value", plan.value(weight, total))):
            nodes[k].append(v)
        if not inner.any():
            break
        # rows of inner nodes go to the children, numbered 0, 1, ... in the next level
        node_of = np.flatnonzero(splits)[g]
        keep = inner[node_of]
        at, node_of = at[keep], node_of[keep]
        rank = np.cumsum(inner) - 1
        g = 2 * rank[node_of] + ~(x[at, feature[node_of]] <= threshold[node_of])
        order = np.argsort(g, kind="stable")
        at, g = at[order], g[order]
        keys = np.stack([_child(keys[inner], 0), _child(keys[inner], 1)], axis=1).ravel()
        depth += 1
    return {k: np.concatenate(v) for k, v in nodes.items()}


def walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    pos = np.zeros(len(x), int)
    moving = np.flatnonzero(feature[pos] >= 0) if len(x) else np.zeros(0, int)
    while len(moving):
        p = pos[moving]
        pos[moving] = left[p] + ~(x[moving, feature[p]] <= threshold[p])
        moving = moving[feature[pos[moving]] >= 0]
    return pos


@dataclass
class Top:
    """The nodes of one tree above its blocks.  ``state``: 0 to be split, 1 a block, 2 a leaf, 3 split."""
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [math.nan])
    left: list[int] = field(default_factory=lambda: [-1])
    state: list[int] = field(default_factory=lambda: [1])
    depth: list[int] = field(default_factory=lambda: [0])
    key: list[int] = field(default_factory=lambda: [0])
    cuts: list[int] = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [None])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def add(self, state: int, depth: int, key: int, cuts: int, value, rows: int) -> None:
        for name, v in (("feature", -1), ("threshold", math.nan), ("left", -1), ("state", state), ("depth", depth),
                        ("key", key), ("cuts", cuts), ("value", value), ("gain", 0.0), ("rows", rows)):
            getattr(self, name).append(v)

    def route(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.state)


@dataclass(frozen=True)
class View:
    """A forest within a grown one: its first ``trees``, cut off at a depth and below a minimum split.

    Draws depend on the seed, the tree and the path only, so it is the forest that would grow under these limits.
    """
    trees: int
    max_depth: int | None = None
    min_split: int = 2

    def stops(self, feature: np.ndarray, left: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """Where each node's rows end: the node itself, or the first above it that the limits make a leaf."""
        out = np.arange(len(feature))
        level = np.zeros(1, int)
        while len(level):
            inner = level[feature[level] >= 0]
            closed = (out[inner] != inner) | (rows[inner] < self.min_split)
            if self.max_depth is not None and depth >= self.max_depth:
                closed[:] = True
            for child in (left[inner], left[inner] + 1):
                out[child] = np.where(closed, out[inner], child)
            level, depth = np.concatenate([left[inner], left[inner] + 1]), depth + 1
        return out


def _quantile_cuts(marks: list[float] | None) -> np.ndarray:
    v = np.unique(np.array([m for m in marks or [] if m is not None and not math.isnan(m)]))
    return _middle(v[:-1], v[1:]) if len(v) > 1 else np.zeros(0)


def _probs(n: int) -> list[float]:
    return [i / n for i in range(n + 1)]


def _global_cuts(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Cuts of every feature: all values where there are at most ``bins`` of them, else quantiles."""
    long = rows.select(F.posexplode("x").alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    few = {r["f"]: r["vs"] for r in long.groupBy("f").agg(F.approx_count_distinct("v", 0.02).alias("n")).where(F.col("n") <= bins)
           .join(long.distinct(), "f").groupBy("f").agg(F.collect_set("v").alias("vs")).collect()}  # features x bins
    marks = {r["f"]: r["q"] for r in long.where(~F.col("f").isin(list(few) or [-1])).groupBy("f")
             .agg(F.percentile_approx("v", _probs(bins), ACCURACY).alias("q")).collect()} if len(few) < d else {}
    return [_quantile_cuts(few.get(f) or marks.get(f)) for f in range(d)]


def _histograms(rows: DataFrame, plan: Plan, tops: list[Top], cuts: list[list[np.ndarray]]) -> DataFrame:
    """(tree, node, f, bin, rows, w, s, ylo, yhi, vlo, vhi) of every node still to be split, summed over all rows.

    Values are handed on shifted as sums, so whole numbers stay whole.
    """
    routes = [t.route() for t in tops]
    of_cuts = [np.array(t.cuts) for t in tops]
    width = plan.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, h = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for tree, (feature, threshold, left, state) in enumerate(routes):
                if not len(y) or not (state == 0).any():
                    continue
                w = plan.weights(h, tree)
                node = walk(x, feature, threshold, left)
                own = np.flatnonzero((state[node] == 0) & (w > 0))
                for c in np.unique(of_cuts[tree][node[own]]).tolist():
                    r = own[of_cuts[tree][node[own]] == c]
                    for f in range(x.shape[1]):
                        v = x[r, f]
                        bins = np.searchsorted(cuts[c][f], v, side="left")
                        bins[np.isnan(v)] = len(cuts[c][f]) + 1
                        order = np.lexsort((bins, node[r]))
                        q, b = r[order], bins[order]
                        starts = np.flatnonzero(np.append(True, (np.diff(node[q]) != 0) | (np.diff(b) != 0)))
                        s = np.add.reduceat(plan.sums(y[q], w[q]), starts, axis=0)
                        n = len(starts)
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array(np.full(n, tree), pa.int32()), "node": pa.array(node[q][starts], pa.int32()),
                            "f": pa.array(np.full(n, f), pa.int32()), "bin": pa.array(b[starts], pa.int32()),
                            "rows": pa.array(np.diff(np.append(starts, len(q))), pa.int64()),
                            "w": pa.array(np.add.reduceat(w[q], starts), pa.float64()),
                            **{f"s{k}": pa.array(s[:, k], pa.float64()) for k in range(width)},
                            **{name: pa.array(fn.reduceat(a[q], starts), pa.float64())
                               for name, fn, a in (("ylo", np.minimum, y), ("yhi", np.maximum, y), ("vlo", np.fmin, x[:, f]), ("vhi", np.fmax, x[:, f]))}})

    parts = ", ".join(f"s{k} double" for k in range(width))
    found = rows.select("x", "y", "h").mapInArrow(
        run, f"tree int, node int, f int, bin int, rows long, w double, {parts}, ylo double, yhi double, vlo double, vhi double")
    return found.groupBy("tree", "node", "f", "bin").agg(
        F.sum("rows").alias("rows"), F.sum("w").alias("w"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)],
        *[fn(c).alias(c) for c, fn in (("ylo", F.min), ("yhi", F.max), ("vlo", F.min), ("vhi", F.max))])


def _pick(hist: DataFrame, plan: Plan, tops: list[Top], cuts: list[list[np.ndarray]]) -> list:
    """One row a node: its split (feature -1: none), whether its rows differ at all, and what each side holds."""
    keys, of_cuts = [np.array(t.key, np.uint64) for t in tops], [np.array(t.cuts) for t in tops]
    width = plan.width

    def run(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in group.column_names}
        tree, node = int(col["tree"][0]), int(col["node"][0])
        s = np.stack([col[f"s{k}"] for k in range(width)], axis=1)
        own = cuts[of_cuts[tree][node]]
        best, at = np.full((len(own), 1), -np.inf), {}
        for f in range(len(own)):
            e = np.flatnonzero(col["f"] == f)
            e = e[np.argsort(col["bin"][e])]
            bins = np.where(col["bin"][e] > len(own[f]), np.nan, col["bin"][e])
            b, c = _best_splits(bins, np.zeros(len(e), int), 1, col["rows"][e].astype(float), col["w"][e], s[e], plan.min_leaf)
            best[f], at[f] = b, (e, c)
        differs = bool(any(np.fmin.reduce(col["vlo"][e]) < np.fmax.reduce(col["vhi"][e]) for e, _ in at.values()))
        chosen = _draw(best, keys[tree][[node]], plan.tried)[:, 0]
        f = int(chosen.argmax())
        e = at[f][0]
        total = _purity(np.array([col["w"][e].sum()]), s[e].sum(axis=0)[None])[0]
        out = {"tree": [tree], "node": [node], "feature": [-1], "threshold": [math.nan], "gain": [0.0], "differs": [differs],
               "one": [bool(col["ylo"].min() == col["yhi"].max())]}
        sides = (e, e[:0])
        if chosen[f] > -np.inf:
            cut = at[f][1][0]  # bins up to this one go left; the last holds what lies above all cuts, the one after it NaN
            last = len(own[f]) if math.isinf(cut) else math.floor(cut)
            out.update(feature=[f], threshold=[math.inf if math.isinf(cut) else float(own[f][last])], gain=[float(chosen[f] - total)])
            sides = (e[col["bin"][e] <= last], e[col["bin"][e] > last])
        for name, r in zip("lr", sides):
            out |= {f"{name}_rows": [int(col["rows"][r].sum())], f"{name}_w": [float(col["w"][r].sum())],
                    f"{name}_s": [s[r].sum(axis=0).tolist()],
                    f"{name}_one": [bool(not len(r) or col["ylo"][r].min() == col["yhi"][r].max())]}
        return pa.table({k: pa.array(v, pa.int32() if k in ("tree", "node", "feature") else None) for k, v in out.items()})

    sides = ", ".join(f"{n}_rows long, {n}_w double, {n}_s array<double>, {n}_one boolean" for n in "lr")
    schema = f"tree int, node int, feature int, threshold double, gain double, differs boolean, one boolean, {sides}"
    return hist.groupBy("tree", "node").applyInArrow(run, schema).collect()  # one row a node, MOST_TOP at most


def _own_cuts(rows: DataFrame, plan: Plan, tops: list[Top], stuck: set[tuple[int, int]], d: int) -> dict:
    """Cuts of the rows of single nodes, by (tree, node)."""
    routes = {t: tops[t].route() for t, _ in stuck}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, h = matrix(batch.column(0)), batch.column(2).to_numpy()
            for tree, (feature, threshold, left, _) in routes.items():
                node = walk(x, feature, threshold, left)
                own = np.flatnonzero(np.isin(node, [n for t, n in stuck if t == tree]) & (plan.weights(h, tree) > 0))
                for f in range(d):
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array(np.full(len(own), tree), pa.int32()), "node": pa.array(node[own], pa.int32()),
                        "f": pa.array(np.full(len(own), f), pa.int32()), "v": pa.array(x[own, f], pa.float64())})

    marks = (rows.select("x", "y", "h").mapInArrow(run, "tree int, node int, f int, v double").where(~F.isnan("v"))
             .groupBy("tree", "node", "f").agg(F.percentile_approx("v", _probs(OWN_CUTS), ACCURACY).alias("q")).collect())
    found: dict[tuple[int, int], list[np.ndarray]] = {k: [np.zeros(0)] * d for k in stuck}
    for r in marks:
        found[r["tree"], r["node"]][r["f"]] = _quantile_cuts(r["q"])
    return found


def _sides(cuts: list[np.ndarray]) -> list[int]:
    """Bins of each feature: between the cuts, above them, and NaN."""
    return [len(c) + 2 for c in cuts]


def _combined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Cells with equal (tree, node, code) added up."""
    col = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.lexsort((col["code"], col["node"], col["tree"]))
    col = {c: v[order] for c, v in col.items()}
    starts = np.flatnonzero(np.append(True, np.any([np.diff(col[c]) != 0 for c in ("tree", "node", "code")], axis=0)))
    fold = {"lo": np.fmin, "hi": np.fmax}
    return {c: v[starts] if c in ("tree", "node", "code") else fold.get(c[1:3], np.add).reduceat(v, starts) for c, v in col.items()}


def _cells(rows: DataFrame, plan: Plan, tops: list[Top], cuts: list[list[np.ndarray]]) -> DataFrame:
    """(tree, node, code, rows, w, s, least and greatest target and features) of every cell of crossed cuts of the nodes to be split."""
    routes, of_cuts, width, d = [t.route() for t in tops], [np.array(t.cuts) for t in tops], plan.width, len(cuts[0])
    kinds = {"tree": pa.int32(), "node": pa.int32(), "code": pa.int64(), "rows": pa.int64()}
    ends = ["y", *map(str, range(d))]

    def added_up(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, node: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        of = of_cuts[tree][node]
        order = np.argsort(of, kind="stable")
        for r in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            own, code = cuts[of[r[0]]], np.zeros(len(r), np.int64)
            for f, n in enumerate(_sides(own)):
                v = x[r, f]
                code = code * n + np.where(np.isnan(v), n - 1, np.searchsorted(own[f], v, side="left"))
            s = plan.sums(y[r], w[r])
            yield {"tree": np.full(len(r), tree, np.int32), "node": node[r].astype(np.int32), "code": code, "rows": np.ones(len(r), np.int64), "w": w[r],
                   **{f"s{k}": s[:, k] for k in range(width)},
                   **{f"_{e}_{c}": v for c, v in (("y", y[r]), *((str(f), x[r, f]) for f in range(d))) for e in ("lo", "hi")}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, settled = [], 0, 0
        for batch in batches:
            x, y, h = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for tree, (feature, threshold, left, state) in enumerate(routes):
                if not len(y) or not (state == 0).any():
                    continue
                w = plan.weights(h, tree)
                node = walk(x, feature, threshold, left)
                own = np.flatnonzero((state[node] == 0) & (w > 0))
                if len(own):
                    held.append(_combined(list(added_up(x[own], y[own], w[own], tree, node[own]))))
                    size += len(held[-1]["w"])
                if size > HELD_CELLS and size > 2 * settled:
                    held = [_combined(held)]
                    size = settled = len(held[0]["w"])
                    if size > HELD_CELLS:
                        yield from tables(held[0])
                        held, size, settled = [], 0, 0
        if held:
            yield from tables(_combined(held))

    def tables(col: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(col["w"]), 1 << 16):
            yield pa.RecordBatch.from_pydict({c: pa.array(v[a:a + (1 << 16)], kinds.get(c, pa.float64())) for c, v in col.items()})

    names = ["w", *[f"s{k}" for k in range(width)], *[f"_{e}_{c}" for c in ends for e in ("lo", "hi")]]
    found = rows.select("x", "y", "h").mapInArrow(run, "tree int, node int, code long, rows long, " + ", ".join(f"{c} double" for c in names))
    fold = {"lo": F.min, "hi": F.max}
    return found.groupBy("tree", "node", "code").agg(F.sum("rows").alias("rows"), *[fold.get(c[1:3], F.sum)(c).alias(c) for c in names])


def _grow_cells(plan: Plan, col: dict[str, np.ndarray], cuts: list[np.ndarray], key: int, depth: int, block: int, owned: bool) -> dict[str, np.ndarray]:
    """The levels below one node as far as its cells tell: what ``Top`` holds of each node, the first of them that node.

    ``owned``: the cuts are the node's own; where they don't part it, it is a leaf.  Any other stays to be split.
    """
    d, code = len(cuts), col["code"]
    order = np.argsort(code)
    col, code = {c: v[order] for c, v in col.items()}, code[order]
    bins: list[np.ndarray] = []
    for n in reversed(_sides(cuts)):
        b = (code % n).astype(float)
        bins.insert(0, np.where(b == n - 1, np.nan, b))
        code = code // n
    rows, w = col["rows"].astype(float), col["w"]
    s = np.stack([col[f"s{k}"] for k in range(plan.width)], axis=1)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "state", "depth", "key", "value", "gain", "rows")}
    at, g, keys, made, root = np.arange(len(w)), np.zeros(len(w), int), np.array([key], np.uint64), 1, True
    while len(keys):
        n = len(keys)
        first = _starts(g, n)
        count, weight, total = np.add.reduceat(rows[at], first), np.add.reduceat(w[at], first), np.add.reduceat(s[at], first, axis=0)
        one = np.minimum.reduceat(col["_lo_y"][at], first) == np.maximum.reduceat(col["_hi_y"][at], first)
        differs = np.any([np.fmin.reduceat(col[f"_lo_{f}"][at], first) < np.fmax.reduceat(col[f"_hi_{f}"][at], first) for f in range(d)], axis=0)
        leaf = (count < plan.min_split) | one | plan.deep(depth)
        state = np.where(leaf, 2, np.where((count <= block) & (not root), 1, 0))
        opened = state == 0
        feature, threshold, gain, left, last = np.full(n, -1), np.full(n, np.nan), np.zeros(n), np.full(n, -1), np.zeros(n)
        if opened.any():
            number = np.cumsum(opened) - 1
            at = at[opened[g]]
            g = g[opened[g]]
            scores, marks = [], []
            for f in range(d):
                r = at[np.lexsort((bins[f][at], g))]
                b, t = _best_splits(bins[f][r], number[g], int(opened.sum()), rows[r], w[r], s[r], plan.min_leaf)
                scores.append(b)
                marks.append(t)
            chosen = _draw(np.array(scores), keys[opened], plan.tried)
            f = chosen.argmax(axis=0)
            top = chosen[f, np.arange(len(f))]
            split = top > -np.inf
            state[opened] = np.where(split, 3, np.where(differs[opened] & ~(owned and root), 0, 2))
            feature[opened] = np.where(split, f, -1)
            gain[opened] = np.where(split, top - _purity(weight, total)[opened], 0.0)
            mark = np.array(marks)[f, np.arange(len(f))]
            for k, i, m in zip(np.flatnonzero(opened)[split].tolist(), f[split].tolist(), mark[split].tolist()):
                last[k] = len(cuts[i]) if math.isinf(m) else math.floor(m)  # bins up to this one go left
                threshold[k] = math.inf if math.isinf(m) else cuts[i][int(last[k])]
        inner = feature >= 0
        left[inner] = made + 2 * np.arange(inner.sum())
        made += 2 * int(inner.sum())
        for k, v in (("feature", feature), ("threshold", threshold), ("left", left), ("state", state), ("depth", np.full(n, depth)),
                     ("key", keys.view(np.int64)), ("value", plan.value(weight, total)), ("gain", gain), ("rows", count.astype(np.int64))):
            nodes[k].append(v)
        if not inner.any():
            break
        keep = inner[g]
        at, g = at[keep], g[keep]
        own = np.array(bins)[feature[g], at]
        g = 2 * (np.cumsum(inner) - 1)[g] + ~(own <= last[g])
        order = np.argsort(g, kind="stable")
        at, g = at[order], g[order]
        keys = np.stack([_child(keys[inner], 0), _child(keys[inner], 1)], axis=1).ravel()
        depth, root = depth + 1, False
    return {k: np.concatenate(v) for k, v in nodes.items()}


def _from_cells(rows: DataFrame, plan: Plan, tops: list[Top], cuts: list[list[np.ndarray]], block: int, own: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Grows all nodes to be split from their cells; returns those that need cuts of their own."""
    at = [(np.array(t.key, np.uint64), t.depth, t.cuts) for t in tops]
    kinds = {"feature": pa.int32(), "threshold": pa.float64(), "left": pa.int32(), "state": pa.int32(), "depth": pa.int32(),
             "key": pa.int64(), "value": pa.float64(), "gain": pa.float64(), "rows": pa.int64()}
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}

    def run(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in group.column_names}
        tree, node = int(col["tree"][0]), int(col["node"][0])
        keys, depths, of_cuts = at[tree]
        made = _grow_cells(plan, col, cuts[of_cuts[node]], keys[node], depths[node], block, (tree, node) in own)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{k: pa.array([made[k].ravel()], pa.list_(t)) for k, t in kinds.items()}})

    schema = "tree int, node int, " + ", ".join(f"{k} array<{names[t]}>" for k, t in kinds.items())
    stuck = set()
    for r in _cells(rows, plan, tops, cuts).groupBy("tree", "node").applyInArrow(run, schema).collect():  # MOST_TOP nodes at most
        top, node = tops[r["tree"]], r["node"]
        base, value = len(top.state) - 1, np.array(r["value"]).reshape(-1, plan.width).tolist()
        for k in range(len(r["state"])):
            place = node if not k else base + k
            if k:
                top.add(0, r["depth"][k], r["key"][k] & (1 << 64) - 1, top.cuts[node], None, 0)
            top.feature[place], top.threshold[place], top.state[place] = r["feature"][k], r["threshold"][k], r["state"][k]
            top.left[place] = base + r["left"][k] if r["left"][k] >= 0 else -1
            top.value[place], top.gain[place], top.rows[place] = value[k], r["gain"][k], r["rows"][k]
            if not r["state"][k]:
                stuck.add((r["tree"], place))
    return stuck


def _grow_tops(rows: DataFrame, plan: Plan, n: int, d: int, block: int, bins: int) -> list[Top]:
    tops = [Top(key=[int(plan.root_key(t))]) for t in range(plan.trees)]
    if n <= block:
        return tops
    cuts, own = [_global_cuts(rows, d, bins)], set()  # own: nodes whose cuts are their own
    for t in tops:
        t.state[0] = 0
    while any(0 in t.state for t in tops):
        stuck: set[tuple[int, int]] = set()
        open_cuts = {c for t in tops for c, state in zip(t.cuts, t.state) if state == 0}
        crossed = max(math.prod(_sides(cuts[c])) for c in open_cuts) <= MOST_CELLS
        if crossed:
            stuck = _from_cells(rows, plan, tops, cuts, block, own)
        for r in [] if crossed else _pick(_histograms(rows, plan, tops, cuts), plan, tops, cuts):
            top, node = tops[r["tree"]], r["node"]
            depth, key = top.depth[node], np.uint64(top.key[node])
            top.rows[node] = r["l_rows"] + r["r_rows"]
            top.value[node] = plan.value(np.array([r["l_w"] + r["r_w"]]), (np.array(r["l_s"]) + np.array(r["r_s"]))[None])[0].tolist()
            ends = top.rows[node] < plan.min_split or plan.deep(depth) or r["one"]
            if r["feature"] < 0 or ends:
                if not ends and r["differs"] and (r["tree"], node) not in own:
                    stuck.add((r["tree"], node))
                    continue
                top.state[node] = 2
                continue
            top.feature[node], top.threshold[node], top.gain[node] = r["feature"], r["threshold"], r["gain"]
            top.left[node], top.state[node] = len(top.state), 3
            for right, side in enumerate("lr"):
                count = r[f"{side}_rows"]
                leaf = count < plan.min_split or r[f"{side}_one"] or plan.deep(depth + 1)
                value = plan.value(np.array([r[f"{side}_w"]]), np.array(r[f"{side}_s"])[None])[0].tolist()
                top.add(2 if leaf else 1 if count <= block else 0, depth + 1, int(_child(key, right)), top.cuts[node], value, count)
        if stuck:
            for (tree, node), c in sorted(_own_cuts(rows, plan, tops, stuck, d).items()):
                tops[tree].cuts[node] = len(cuts)
                own.add((tree, node))
                cuts.append(c)
    return tops


def _finish(rows: DataFrame, plan: Plan, tops: list[Top], columns: int, path: str) -> None:
    """Writes (tree, node, nodes of the subtree) of every block; ``columns`` of a row sent there: features, target, weight, hash."""
    routes = [t.route() for t in tops]
    at = [(np.array(t.key, np.uint64), np.array(t.depth)) for t in tops]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, h = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for tree, (feature, threshold, left, state) in enumerate(routes):
                w = plan.weights(h, tree)
                node = walk(x, feature, threshold, left)
                own = np.flatnonzero((state[node] == 1) & (w > 0)) if len(y) else np.zeros(0, int)
                own = own[np.argsort(node[own], kind="stable")]
                parts = np.split(own, np.flatnonzero(np.diff(node[own])) + 1) if len(own) else []
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * len(parts), pa.int32()), "node": pa.array([int(node[p[0]]) for p in parts], pa.int32()),
                    "data": pa.array([np.column_stack([x[p], y[p], w[p], h[p].view(np.float64)]).tobytes() for p in parts], pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        held = [np.frombuffer(b.as_py()) for b in group.column("data")]
        data = np.concatenate([v.reshape(-1, columns) for v in held])
        data = data[np.argsort(data[:, -1].copy().view(np.int64), kind="stable")]  # the same order in every run
        keys, depth = at[tree]
        made = grow(plan, np.ascontiguousarray(data[:, :-3]), data[:, -3].copy(), data[:, -2].copy(), keys[node], int(depth[node]))
        made["value"] = made["value"].ravel()
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{k: pa.array([made[k].tolist()], t) for k, t in _ARROW.items()}})

    (rows.select("x", "y", "h").mapInArrow(deal, "tree int, node int, data binary")
         .groupBy("tree", "node").applyInArrow(finish, f"tree int, node int, {_TREE}").write.parquet(path))


_ARROW = {"feature": pa.list_(pa.int32()), "threshold": pa.list_(pa.float64()), "left": pa.list_(pa.int32()),
          "value": pa.list_(pa.float64()), "rows": pa.list_(pa.int64()), "gain": pa.list_(pa.float64())}


@dataclass
class Forest:
    """A grown forest: the nodes above the blocks, and where the subtrees are written."""
    features: list[str]
    plan: Plan
    tops: list[Top]
    path: str
    block: int

    def subtrees(self, spark) -> DataFrame:
        """(tree, node, feature, threshold, left, value, rows, gain), one row a block."""
        return spark.read.schema(f"tree int, node int, {_TREE}").parquet(self.path)

    def importances(self, spark) -> list[float]:
        """Share of each feature in what the splits of a tree take off the impurity, mean over the trees."""
        d = len(self.features)
        parts = self.subtrees(spark).select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("e")) \
            .where("e.feature >= 0").groupBy("tree", "e.feature").agg(F.sum("e.gain").alias("gain")).collect()  # trees x features
        sums = np.zeros((self.plan.trees, d))
        for r in parts:
            sums[r["tree"], r["feature"]] += r["gain"]
        for t, top in enumerate(self.tops):
            for f, v in zip(top.feature, top.gain):
                if f >= 0:
                    sums[t, f] += v
        total = sums.sum(axis=1, keepdims=True)
        return np.divide(sums, total, out=np.zeros_like(sums), where=total > 0).mean(axis=0).tolist()

    def predict(self, df: DataFrame, views: list[View] | None = None) -> DataFrame:
        """``df`` with ``prediction`` (and, for classes, ``probability`` as an array) from the mean over the trees.

        Given ``views``, each has its own: ``prediction_0``, ``probability_0``, ...  All are scored by one pass.
        """
        spark, plan = df.sparkSession, self.plan
        path = scratch_path(spark, "forest-rows")
        df.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
        rows = _spread(spark.read.parquet(path), "forest-rows")
        asked = views or [View(plan.trees)]
        routes = [t.route() for t in self.tops]
        depths = [np.array(t.depth) for t in self.tops]
        # where a top's rows end, by tree and view; a tree that a view doesn't have answers nothing
        ends = [[v.stops(r[0], r[2], np.array(t.rows), 0) for v in asked] for t, r in zip(self.tops, routes)]
        values = [np.array([v if v is not None else [0.0] * plan.width for v in t.value]) for t in self.tops]
        width, d = plan.width, len(self.features)
        across = len(asked) * (width + 1)
        bits = max(4, int(math.log2(ANSWER_BYTES / (8 * across * (plan.trees + 1)))))  # of a row's number: rows of a part
        out = "tree int, part long, ids binary, v binary"

        def answers(tree: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            """Values and numbers of answers of each row and view, by parts of the rows: a tree that drew no row at all has none."""
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            pieces = np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids >> bits)) + 1) if len(ids) else []
            return pa.RecordBatch.from_pydict({
                "tree": pa.array([tree] * len(pieces), pa.int32()), "part": pa.array([int(ids[p[0]] >> bits) for p in pieces], pa.int64()),
                "ids": pa.array([ids[p].tobytes() for p in pieces], pa.binary()), "v": pa.array([v[p].tobytes() for p in pieces], pa.binary())})

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                total = np.zeros((len(ids), len(asked), width + 1))
                for tree, ((feature, threshold, left, state), value) in enumerate(zip(routes, values)):
                    node = walk(x, feature, threshold, left)
                    for k, view in enumerate(asked):
                        end = ends[tree][k][node]
                        here = ((state[node] == 2) | (end != node)) & (tree < view.trees)
                        total[here, k, :width] += value[end[here]]
                        total[here, k, width] += 1
                yield answers(-1, ids, total.reshape(len(ids), across))

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                for tree, (feature, threshold, left, state) in enumerate(routes):
                    node = walk(x, feature, threshold, left)
                    own = np.flatnonzero(state[node] == 1) if len(ids) else np.zeros(0, int)
                    own = own[np.argsort(node[own], kind="stable")]
                    parts = np.split(own, np.flatnonzero(np.diff(node[own])) + 1) if len(own) else []
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree] * len(parts), pa.int32()), "node": pa.array([int(node[p[0]]) for p in parts], pa.int32()),
                        "n": pa.array([len(p) for p in parts], pa.int64()),
                        "ids": pa.array([ids[p].tobytes() for p in parts], pa.binary()), "x": pa.array([x[p].tobytes() for p in parts], pa.binary())})

        def score(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
            if not len(left_table) or not len(right_table):
                return pa.Table.from_batches([answers(0, np.zeros(0, np.int64), np.zeros((0, across)))])
            one = {k: right_table.column(k)[0].values.to_numpy() for k in ("feature", "threshold", "left", "value", "rows")}
            tree, top = right_table.column("tree")[0].as_py(), right_table.column("node")[0].as_py()
            ids = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in left_table.column("ids")])
            x = np.concatenate([np.frombuffer(b.as_py()).reshape(-1, d) for b in left_table.column("x")])
            node = walk(x, one["feature"], one["threshold"], one["left"])
            value, total = one["value"].reshape(-1, width), np.zeros((len(ids), len(asked), width + 1))
            for k, view in enumerate(asked):
                if tree < view.trees and ends[tree][k][top] == top:
                    total[:, k, :width] = value[view.stops(one["feature"], one["left"], one["rows"], int(depths[tree][top]))[node]]
                    total[:, k, width] = 1
            return pa.Table.from_batches([answers(tree, ids, total.reshape(len(ids), across))])

        def added(group: pa.Table) -> pa.Table:
            """Means of a part's rows; the answers are added in the order of the trees, so that it is the same in every run."""
            first = group.column("part")[0].as_py() << bits
            total, seen = np.zeros((1 << bits, across)), np.zeros(1 << bits, bool)
            for r in np.argsort(group.column("tree").to_numpy(), kind="stable").tolist():
                at = np.frombuffer(group.column("ids")[r].as_py(), np.int64) - first
                total[at] += np.frombuffer(group.column("v")[r].as_py()).reshape(len(at), across)
                seen[at] = True
            at = np.flatnonzero(seen)
            total = total[at].reshape(len(at), len(asked), width + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = total[:, :, :width] / total[:, :, width:]
            best = mean.argmax(axis=2).astype(float) if plan.classes else mean[:, :, 0]
            return pa.table({"_id": pa.array(at + first, pa.int64()), "_best": pa.array(best.tolist(), pa.list_(pa.float64())),
                             "_mean": pa.array(mean.reshape(len(at), -1).tolist(), pa.list_(pa.float64()))})

        xs = rows.select("_id", _vector(self.features).alias("x"))
        schema = "tree int, node int, n long, ids binary, x binary"
        dealt = xs.mapInArrow(below, schema)
        # A node that many of these rows reach is dealt to several tasks, each with a copy of its subtree.
        spread, copies = dealt.withColumn("part", F.lit(0)), self.subtrees(spark).withColumn("part", F.lit(0))
        if rows.count() > self.block:  # else no node is reached by more
            shared = dealt.groupBy("tree", "node").agg(F.ceil(F.sum("n") / self.block).cast("int").alias("parts")).where("parts > 1")
            many = F.coalesce(F.col("parts"), F.lit(1))
            spread = dealt.join(shared, ["tree", "node"], "left").withColumn("part", F.pmod(F.xxhash64("ids"), many).cast("int")).drop("parts")
            copies = self.subtrees(spark).join(shared, ["tree", "node"], "left") \
                .withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
        met = spread.groupBy("tree", "node", "part").cogroup(copies.groupBy("tree", "node", "part")).applyInArrow(score, out)
        means = xs.mapInArrow(above, out).unionByName(met).groupBy("part").applyInArrow(added, "_id long, _best array<double>, _mean array<double>")
        joined = rows.join(means, "_id")
        for k in range(len(asked)):
            end = f"_{k}" if views else ""
            joined = joined.withColumn(f"prediction{end}", F.col("_best")[k])
            if plan.classes:
                joined = joined.withColumn(f"probability{end}", F.slice("_mean", k * width + 1, width))
        return joined.drop("_id", "_best", "_mean")


def _spread(rows: DataFrame, name: str) -> DataFrame:
    """A written table in a partition a core at least: the work on a row is by tree, so a few MB are work for all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    path = scratch_path(rows.sparkSession, name)
    rows.repartition(cores).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _vector(features: list[str]) -> Column:
    return F.array(*[F.coalesce(qcol(c).cast("double"), F.lit(math.nan)) for c in features])


def grow_forest(df: DataFrame, features, label: str, classes: int = 0, trees: int = 100, max_depth: int | None = None,
                min_split: int = 2, min_leaf: int = 1, tried: int | None = None, bootstrap: bool = True, key_cols=None,
                seed: int = 42, block_rows: int = BLOCK_ROWS, bins: int = CUTS) -> Forest:
    """A forest of ``trees`` on numeric ``features``; ``classes`` of a label 0, 1, ..., or 0 for a number.

    ``max_depth=None``: no limit.  A node with fewer than ``min_split`` drawn rows (each counted once) is a leaf,
    a side of a split has ``min_leaf`` at least.  ``tried``: features tried at a node (None: all).  Rows with
    equal ``key_cols`` (features and label by default) are drawn alike.
    """
    features = list(features)
    if not features or trees < 1 or min_split < 2 or min_leaf < 1:
        raise ValueError("a forest needs features, a tree, a split of two rows and a leaf of one")
    spark = df.sparkSession
    keys = list(key_cols) if key_cols else [*features, label]
    path = scratch_path(spark, "forest-train")
    (df.where(qcol(label).isNotNull() & ~F.isnan(qcol(label).cast("double")))
       .select(_vector(features).alias("x"), qcol(label).cast("double").alias("y"),
               F.xxhash64(*[qcol(k) for k in keys]).alias("h")).write.parquet(path))
    rows = _spread(spark.read.schema("x array<double>, y double, h long").parquet(path), "forest-train")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).first()
    if not seen["n"]:
        raise ValueError("no labelled rows")
    shift = 0.0 if classes else float(round(seen["m"]))
    plan = Plan(classes, trees, max_depth, min_split, min_leaf, min(tried or len(features), len(features)), bootstrap, seed, shift)
    block = max(block_rows, math.ceil(4 * seen["n"] * trees / MOST_TOP))
    tops = _grow_tops(rows, plan, seen["n"], len(features), block, bins)
    out = scratch_path(spark, "forest-trees")
    _finish(rows, plan, tops, len(features) + 3, out)
    return Forest(features, plan, tops, out, block)
