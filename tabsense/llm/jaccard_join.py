"""N-gram Jaccard join with Bayesian candidate pruning.

Documents become sets of hashed word shingles.  Documents with equal sets collapse to one node.  Nodes
that share a band of MinHash values are candidates; for each candidate pair MinHash values are compared
a few at a time, and a pair is dropped once the posterior probability that its similarity reaches the
threshold falls below a tolerance (uniform prior; the posterior tail is a binomial tail).  The remaining
pairs are verified on the shingle sets themselves.

Scale: pairs never become rows.  A bucket of nodes is one group if small, and pairs of bounded blocks if
large; a group compares its pairs in arrays and passes on, per node, the number of links and the root
of its local component.  A pair that shares several buckets is compared in the first of them only, and
buckets with the same members are one.  Components are joined up by alternating star contractions.
Shingle sets are made for candidate nodes only, from the text of one document each.

Words are runs without blanks, ASCII letters lower-cased; a document of one to ``n - 1`` words has one
shingle, all its words.

Defined cases: null and empty texts have the empty set and are copies of each other; a null id is an
id; repeated rows are copies; ties (equal similarity) all count; an empty table gives no rows; texts
of any length are shingled whole; columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsense.llm.common import as_bytes, mix64, n_tasks, resident, spill

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: With 20 bands of 4 a pair at 0.8 shares no band with probability 3e-5, one at 0.9 with 8e-10.
BANDS, BAND_VALUES = 20, 4
#: MinHash values that pairs are compared by, and how many at a time.
COMPARED, AT_A_TIME = 128, 16
TOLERANCE = 1e-6
#: Nodes in a block, and bytes of shingle sets in a block.
BLOCK_NODES, BLOCK_BYTES = 1024, 32 << 20
#: Words remembered by a worker; cells of a dense incidence matrix.
WORD_CACHE, DENSE_CELLS = 500_000, 1 << 25
_SEED = 90_017
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@functools.lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 1 << 63, COMPARED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = resident("word hashes", _WordHashes)
    if len(known) > WORD_CACHE:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        rolled = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            rolled = rolled * _BASE + h[k:len(h) - width + 1 + k]
    return np.unique(mix64(rolled))


def min_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, 0xFFFFFFFF, np.uint64)
    a = _multipliers()[:n]
    for k in range(0, len(shingles), 2048):
        with np.errstate(over="ignore"):
            least = np.minimum(least, ((shingles[k:k + 2048, None] * a) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) is the probability of at most m successes
    in n + 1 trials of chance t.
    """
    out = []
    for n in range(COMPARED + 1):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, node, n_shingles, bands)`` of every document (``doc_id, text_hash, text``)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            nodes, sizes, values = [], [], []
            for t in as_bytes(batch.column(2)):
                s = shingle_set(t)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                values.append(min_hashes(s, BANDS * BAND_VALUES))
            v = np.stack(values).astype(np.uint64).reshape(-1, BANDS, BAND_VALUES) if values else np.zeros((0, BANDS, BAND_VALUES), np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2])
                for k in range(BAND_VALUES):
                    key = mix64(key * _BASE + v[:, :, k])
            flat = pa.array(key.ravel().view(np.int64))
            bands = pa.FixedSizeListArray.from_arrays(flat, BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                 pa.array(sizes, pa.int32()), bands], ["doc_id", "text_hash", "node", "n_shingles", "bands"])

    return docs.mapInArrow(sketch, "doc_id long, text_hash long, node long, n_shingles int, bands array<long>")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """``(node, buckets)``: the buckets that a node shares with others, each with its number of blocks.

    Buckets with the same members count once.
    """
    placed = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    full = placed.groupBy("bucket").agg(
        F.count("*").alias("size"), F.sum(F.col("n_shingles").cast("long")).alias("shingles"),
        F.bit_xor(F.xxhash64("node")).alias("print"), F.min("node").alias("least")).where("size > 1")
    single = full.groupBy("size", "print", "least", "shingles").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_NODES), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    kept = single.select("bucket", blocks.alias("blocks"))
    member = placed.select("node", "bucket").join(kept, "bucket")
    return member.groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks")).alias("buckets"))


def _with_sets(rows: DataFrame) -> DataFrame:
    """Replace the text of candidate nodes by their shingle set and MinHash values."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([min_hashes(s, COMPARED).tobytes() for s in sets], pa.binary())],
                ["node", "copies", "buckets", "shingles", "values"])

    return rows.select("node", "copies", "buckets", "text").mapInArrow(
        add, "node long, copies long, buckets array<struct<bucket:long,blocks:int>>, shingles binary, values binary")


def _first_shared(bucket: int, mine: list[np.ndarray], left: np.ndarray, right: np.ndarray, open_: np.ndarray) -> None:
    """Close the pairs that share an earlier bucket; ``mine`` has each node's buckets."""
    owner = np.repeat(np.arange(len(mine)), [len(b) for b in mine])
    every = np.concatenate(mine)
    early = every < bucket
    owner, every = owner[early], every[early]
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    cuts = np.flatnonzero(np.diff(every)) + 1
    row, column = np.full(len(mine), -1), np.full(len(mine), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    for group in np.split(owner, cuts):
        if len(group) > 1:
            a, b = row[group], column[group]
            a, b = a[a >= 0], b[b >= 0]
            if len(a) and len(b):
                open_[np.ix_(a, b)] = False


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs: one product of incidence matrices if pairs are many."""
    used = np.unique(np.concatenate([a, b]))
    total = sum(len(sets[k]) for k in used)
    if len(a) > 4 * len(used):
        _, place = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
        width = int(place.max()) + 1 if total else 0
        if len(used) * width <= DENSE_CELLS:
            dense = np.zeros((len(used), width), np.float32)
            dense[np.repeat(np.arange(len(used)), [len(sets[k]) for k in used]), place] = 1
            both = dense @ dense.T
            return both[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)
    return np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)), np.int64, len(a))


def linked_pairs(bucket: int, buckets: list[np.ndarray], sets: list[np.ndarray], values: np.ndarray,
                 left: np.ndarray, right: np.ndarray, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``left`` and ``right`` (of ``left`` alone if they are the same) that are similar."""
    within = left is right
    open_ = np.triu(np.ones((len(left), len(left)), bool), 1) if within else np.ones((len(left), len(right)), bool)
    _first_shared(bucket, buckets, left, right, open_)
    i, j = np.nonzero(open_)
    i, j = left[i], right[j]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[near], j[near]
    matches = np.zeros(len(i), np.int32)
    order = np.roll(np.arange(COMPARED), -BANDS * BAND_VALUES)  # values outside the bands first
    for n in range(0, COMPARED, AT_A_TIME):
        block = np.ascontiguousarray(values[:, order[n:n + AT_A_TIME]])
        for k in range(0, len(i), 1 << 16):
            part = slice(k, k + (1 << 16))
            matches[part] += (block[i[part]] == block[j[part]]).sum(axis=1, dtype=np.int32)
        stay = matches >= least[n + AT_A_TIME]
        i, j, matches = i[stay], j[stay], matches[stay]
    if not len(i):
        return i, j
    common = _intersections(sets, i, j)
    alike = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[alike], j[alike]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def block_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(node, root, links, texts)`` of every linked node of every group of candidates.

    ``members`` holds ``bucket, a, b, side, node, copies, buckets, shingles, values``, the groups
    (``bucket, a, b``) together and each sorted by side and node.
    """
    least = least_matches(threshold)

    def compare(group: dict[str, list]) -> pa.RecordBatch | None:
        nodes = np.array(group["node"], np.int64)
        side = np.array(group["side"])
        _, first = np.unique(np.stack([side, nodes]), axis=1, return_index=True)  # copies of a row
        nodes, side = nodes[first], side[first]
        sets = [np.frombuffer(group["shingles"][k], np.uint64) for k in first]
        values = np.stack([np.frombuffer(group["values"][k], np.uint32) for k in first])
        buckets = [np.array([x["bucket"] for x in group["buckets"][k]], np.int64) for k in first]
        copies = np.array([group["copies"][k] for k in first], np.int64)
        left = np.flatnonzero(side == 0)
        right = left if group["a"] == group["b"] else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        i, j = linked_pairs(group["bucket"], buckets, sets, values, left, right, threshold, least)
        if not len(i):
            return None
        n = len(nodes)
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        by_node = np.argsort(nodes, kind="stable")
        rank = np.argsort(by_node)
        root = nodes[by_node][_roots(n, rank[i], rank[j])][rank]
        own = np.flatnonzero(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[own]), pa.array(root[own]), pa.array(links[own].astype(np.int64)),
             pa.array(texts[own].astype(np.int64))], ["node", "root", "links", "texts"])

    fields = ("side", "node", "copies", "buckets", "shingles", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if key != tuple(keys[a]):
                    if key and (out := compare(group)):
                        yield out
                    key = tuple(keys[a])
                    group = {"bucket": key[0], "a": key[1], "b": key[2], **{f: [] for f in fields}}
                part = batch.slice(a, b - a)
                for f in fields:
                    group[f] += part.column(f).to_pylist()
        if key and (out := compare(group)):
            yield out

    return members.mapInArrow(run, "node long, root long, links long, texts long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node but the least of each component of ``edges`` (``a``, ``b``).

    Alternating large-star and small-star contractions; each round is a written table.
    """
    e = spill(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = spill(small.union(below.select("a", F.col("m").alias("b"))).distinct(), "star")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.min("b"), F.max("b")).head())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _place() -> Column:
    """A document's place in its class: by id, null ids last, then by hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash"))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_hash, class_id, n_links, n_copies, is_first``.

    ``n_links`` counts the other documents whose similarity reaches ``threshold``, copies included;
    ``class_id`` is the least id of the documents that links connect (null if none has an id); ``is_first`` marks the class's
    first document (by id, then hash of the text).
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chosen = chosen.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketch = spill(sketches(chosen), "sketch")
    nodes = spill(sketch.groupBy("node").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
                                             F.min(_place()).alias("first"),
                                             F.first("bands").alias("bands")), "nodes")
    wanted = nodes.drop("bands", "n_shingles").join(shared_buckets(nodes), "node").select(
        "node", "copies", "buckets", F.col("first.doc_id").alias("of_doc"), F.col("first.text_hash").alias("of_text"))
    candidates = _with_sets(chosen.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_doc"))
                                        & (F.col("text_hash") == F.col("of_text"))))
    placed = candidates.withColumn("own", F.explode("buckets")).select(
        F.col("own.bucket").alias("bucket"), F.col("own.blocks").alias("blocks"),
        F.pmod(F.xxhash64("node"), F.col("own.blocks")).cast("int").alias("block"), "node", "copies", "buckets",
        "shingles", "values")
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "copies", "buckets",
        "shingles", "values")
    members = paired.repartition(n_tasks(spark), "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "side", "node")
    found = spill(block_links(members, threshold), "links")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = (nodes.select("node", "copies", "first").join(joined, "node", "left").join(counts, "node", "left")
           .withColumn("root", F.coalesce("root", "node")))
    classes = own.groupBy("root").agg(F.min("first").alias("class_first"))
    verdict = own.join(classes, "root").select(
        "node", "copies", F.col("class_first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sketch.select("doc_id", "text_hash", "node").join(verdict, "node").select(
        "doc_id", "text_hash", F.col("class_first.doc_id").alias("class_id"), "n_links",
        F.col("copies").alias("n_copies"),
        _place().eqNullSafe(F.col("class_first")).alias("is_first"))
