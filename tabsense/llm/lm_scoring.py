"""Language-model scores by context-tree weighting, beside a unigram base score.

A text is the byte string of its lower-cased words, joined by single spaces, and one end byte.  Each
byte is eight binary decisions; each decision has a context tree over the preceding bytes, with a
Krichevsky-Trofimov estimate at every node from depth 0 to ``DEPTH``.  Weighting mixes the estimates of
all depths: a node's weighted probability is half its own estimate and half the product of its
children's.  A cell, six bytes of context and the next byte, is 56 bits of a long.

All of that depends on counts alone, so training is a distributed count of cells, ``(context, byte)``,
over all training text, and the tree has every context that occurs.  A task sorts the cells of its texts
and hands on their counts as arrays, one row for each of 2,048 buckets; rows of a bucket meet in one
task, which adds them up.  Cells are dealt out by the first ``TOP + 1`` bytes of their context, so that
each task has whole subtrees: it passes their log-weights up
to depth ``TOP``, whose nodes (65,536 at most) are mixed on the driver, and a second pass brings the
mixture down to every cell of any text.  The logarithms of the ``HOT_CELLS`` most used cells are
broadcast (32 MB at most) and summed where the text is; a text's other cells go to a join with the table
of cells.  Which way a cell goes doesn't change its logarithm.

The base score needs the count of every word, and words have no bound.  Words that are frequent, up to
``FREQUENT`` words of ``FREQUENT_BYTES`` bytes at most, are broadcast and summed where the text is; each
other word of a document goes to a join with the word table.  Frequent words therefore never meet in
one task.

Defined cases: a null or empty text is one end token; a null document id is no held-out document;
repeated rows are scored and counted as often as they occur; with no training text every count is 0;
an empty table gives no rows; texts of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabsense.llm.common import BLANKS, as_bytes, spill

DEPTH, CLASS_BITS = 6, 8
KINDS, _BITS = 1 << CLASS_BITS, DEPTH * CLASS_BITS
#: Nodes up to depth ``TOP`` (65,536 contexts of two bytes at most) are mixed on the driver, subtrees below in the tasks.
TOP, SUBTREE_CELLS = 2, 1 << 17
#: Cells whose logarithms are broadcast; all others go through a join, with equal results.
HOT_CELLS = 1 << 21
#: Binary decisions of all nodes that are worked out together.
AT_A_TIME = 8
FREQUENT, FREQUENT_BYTES = 200_000, 64
#: Texts that are worked out together: their number fits a byte beside the 56 bits of a cell.
SLICE_ROWS, SLICE_BYTES, SLICE_TEXTS = 64, 1 << 19, 256
#: Bytes of text whose words are looked up together.
SPAN_BYTES = 1 << 22
#: Places and bytes of words that are held until their counts are handed on, and rows of buckets that are added up at a time.
HELD_PLACES, HELD_WORD_BYTES, BUCKET_ROWS = 1 << 23, 1 << 24, 1 << 8
_PAD = b"\n" * (DEPTH + 1)
_BLANK = np.isin(np.arange(256), list(BLANKS))
_SUBTREE = 8 + CLASS_BITS * (DEPTH - TOP - 1)  # bits of a cell below the root of its subtree
_SUBTREES = CLASS_BITS * (TOP + 1)  # bits of a subtree's name
_IN_BUCKET = _SUBTREES - 11  # bits of a subtree's name, after ``_dealt``, below its bucket's
_N_BUCKETS, _TOGETHER = 1 << _SUBTREES - _IN_BUCKET, 64  # buckets in all, and those packed at a time
_FACTOR = 0x9E3779


def byte_classes() -> np.ndarray:
    """The class of each byte in a context: the byte itself."""
    return np.arange(256, dtype=np.int32)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Cells of all places of texts in a row, their number in each text, the words in a row, and their number in each text.

    A cell is ``context << 8 | byte``, nearest byte of the context highest.  Before each text lie
    ``DEPTH + 1`` line ends, the first of which ends the text before it.
    """
    stream = np.frombuffer(bytearray((_PAD + _PAD.join(texts) + b"\n").lower()), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + len(_PAD)) - sizes
    keep = ~_BLANK[stream]
    change = np.flatnonzero(keep[1:] != keep[:-1])  # the stream begins and ends with a blank
    before, last = change[::2], change[1::2]  # the blank before each word, and the word's last byte
    offsets = np.zeros(len(before) + 1, np.int32)
    np.cumsum(last - before, out=offsets[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(before), [None, pa.py_buffer(offsets), pa.py_buffer(stream[keep])])
    first = np.searchsorted(before, begins - 1)
    n_words = np.diff(first, append=len(before))
    single = np.ones(len(before), bool)
    single[first[n_words > 0]] = False
    single = before[single]
    stream[single], keep[single] = 0x20, True
    keep[(begins[:, None] - 1 - np.arange(len(_PAD))).ravel()] = True
    keep[-1] = True
    stream = stream[keep]
    places = np.add.reduceat(keep, begins, dtype=np.int64) - DEPTH
    places[-1] += DEPTH  # no line ends follow the last text
    # Eight bytes up to each place: one too many, the context from far to near, and the byte, highest.
    cells = np.ndarray(len(stream) - len(_PAD), "<i8", stream, strides=(1,)) & ~np.int64(255) & (1 << 8 + _BITS) - 1
    cells |= stream[len(_PAD):]
    gaps = np.cumsum(places[:-1] + DEPTH)[:, None] - 1 - np.arange(DEPTH)
    return np.delete(cells, gaps.ravel()), places, words, n_words


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts, about ``SLICE_BYTES`` and at most ``SLICE_TEXTS`` at a time, with the place of the first."""
    found, size, first = [], 0, 0
    texts = batch.column("text")
    for begin in range(0, len(texts), SLICE_ROWS):
        for k, t in enumerate(as_bytes(texts.slice(begin, SLICE_ROWS)), begin):
            found.append(t)
            size += len(t)
            if size >= SLICE_BYTES or len(found) == SLICE_TEXTS:
                yield first, found
                found, size, first = [], 0, k + 1
    if found:
        yield first, found


def _batches_of_words(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts of each slice."""
    for first, texts in _slices(batch):
        yield first, [t.lower().split() for t in texts]


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[int, Iterator[list[bytes]]]]:
    """The batch's slices, those of about ``SPAN_BYTES`` in a row, with the place of the first text."""
    slices = _slices(batch)

    def span(texts: list[bytes]) -> Iterator[list[bytes]]:
        size = 0
        while texts:
            yield texts
            size += sum(map(len, texts))
            texts = next(slices, (0, []))[1] if size < SPAN_BYTES else []

    for first, texts in slices:
        yield first, span(texts)


def _dealt(cells: np.ndarray, factor: int = _FACTOR) -> np.ndarray:
    """Cells with the names of their subtrees multiplied, which spreads subtrees evenly and keeps each one together."""
    names = (cells >> _SUBTREE) * factor & (1 << _SUBTREES) - 1
    return names << _SUBTREE | cells & (1 << _SUBTREE) - 1


def _undealt(cells: np.ndarray) -> np.ndarray:
    return _dealt(cells, pow(_FACTOR, -1, 1 << _SUBTREES))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value begins."""
    change = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=change[1:])
    return np.flatnonzero(change)


def _planes(*columns: np.ndarray) -> np.ndarray:
    """Bytes of columns of integers, one row for the first byte of each value, one for the second and so on."""
    return np.concatenate([c.view(np.uint8).reshape(len(c), c.itemsize).T for c in columns])


def _column(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def corpus_parts(texts: DataFrame) -> DataFrame:
    """``(word, n, bucket, cells)`` of ``(text, held_out)``: partial counts of training words, and of all cells.

    A word has a row (``bucket`` null) wherever it was counted; cells have one for each bucket (``word``
    null), ``n`` of them in order of the dealt cells, compressed: 16-bit steps from one subtree's name to the
    next, the 32 bits of a cell below its subtree, and its count with a last bit that is set for held-out texts.
    """
    names = ["word", "n", "bucket", "cells"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = np.empty(HELD_PLACES, np.int64), 0
        words: list[pa.Array] = []
        size = 0

        def of_words() -> Iterator[pa.RecordBatch]:
            found = pa.chunked_array(words, pa.binary()).value_counts()
            words.clear()
            m = len(found)
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts"), pa.nulls(m, pa.int32()),
                                              pa.nulls(m, pa.binary())], names)

        def of_cells() -> Iterator[pa.RecordBatch]:
            own = held[:filled]
            own.sort()
            edges = np.searchsorted(own, np.arange(0, _N_BUCKETS + 1, _TOGETHER) << _SUBTREE + _IN_BUCKET + 1)
            for some in np.split(own, edges[1:-1]):  # little is held besides
                if len(some):
                    yield of_buckets(some)

        def of_buckets(own: np.ndarray) -> pa.RecordBatch:
            first = _starts(own)
            keys = own[first]
            n = np.diff(first, append=len(own)).astype(np.uint32) << 1 | (keys & 1).astype(np.uint32)
            cells = keys >> 1
            name = cells >> _SUBTREE
            bucket = (name >> _IN_BUCKET).astype(np.int32)
            begins = _starts(bucket)
            steps = np.diff(name, prepend=0)
            steps[begins] = name[begins] & (1 << _IN_BUCKET) - 1
            sizes = np.diff(begins, append=len(n))
            planes = _planes(steps.astype(np.uint16), cells.astype(np.uint32), n)
            packed = [pa.compress(planes[:, b:b + size].tobytes(), codec="zstd", asbytes=True) for b, size in zip(begins, sizes)]
            return pa.RecordBatch.from_arrays([pa.nulls(len(begins), pa.binary()), pa.array(sizes), pa.array(bucket[begins]),
                                               pa.array(packed, pa.binary())], names)

        for batch in batches:
            is_held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for at, slice_ in _slices(batch):
                cells, places, own, n_words = _laid_out(slice_)
                apart = is_held[at:at + len(slice_)]
                keys = _dealt(cells) << 1 | np.repeat(apart.astype(np.int64), places)
                while len(keys):
                    some = keys[:HELD_PLACES - filled]
                    held[filled:filled + len(some)] = some
                    keys, filled = keys[len(some):], filled + len(some)
                    if filled == HELD_PLACES:
                        yield from of_cells()
                        filled = 0
                if apart.any():
                    own = own.filter(pa.array(np.repeat(~apart, n_words)))
                words.append(own)
                size += sum(map(len, slice_))
                if size >= HELD_WORD_BYTES:
                    yield from of_words()
                    size = 0
        if words:
            yield from of_words()
        if filled:
            yield from of_cells()

    return texts.select("text", "held_out").mapInArrow(count, "word binary, n long, bucket int, cells binary")


def word_counts(parts: DataFrame) -> DataFrame:
    """``(word, n)`` of all training words."""
    return parts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))


def cell_counts(parts: DataFrame) -> DataFrame:
    """``(cell, n, used)`` of all cells: their counts in training texts, 0 for cells that only other texts have, and in all texts."""
    names = ["cell", "n", "used"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, trained = [np.zeros(0, np.int64)] * 3

        def whole(cells: np.ndarray, n: np.ndarray, trained: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (_undealt(cells), trained, n)], names)

        for batch in (b.slice(k, BUCKET_ROWS) for b in batches for k in range(0, b.num_rows, BUCKET_ROWS)):
            sizes = batch.column("n").to_numpy()
            planes = np.concatenate([np.frombuffer(pa.decompress(x, 10 * size, "zstd"), np.uint8).reshape(10, size)
                                     for x, size in zip(batch.column("cells").to_pylist(), sizes.tolist())], axis=1)
            steps, ends, counts = [_column(planes[at], kind) for at, kind in (
                (slice(2), np.uint16), (slice(2, 6), np.uint32), (slice(6, 10), np.uint32))]
            begins = np.cumsum(sizes) - sizes
            bucket = batch.column("bucket").to_numpy().astype(np.int64)
            name = np.cumsum(steps)
            name += np.repeat((bucket << _IN_BUCKET) - (name[begins] - steps[begins]), sizes)
            cells = np.concatenate([cells, name << _SUBTREE | ends])
            n, trained = np.concatenate([n, counts >> 1]), np.concatenate([trained, np.where(counts & 1, 0, counts >> 1)])
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            first = _starts(cells)
            cells, n, trained = cells[first], np.add.reduceat(n[order], first), np.add.reduceat(trained[order], first)
            bits = _SUBTREE + _IN_BUCKET
            cut = np.searchsorted(cells, cells[-1] >> bits << bits)  # more of the last bucket may follow
            if cut:
                yield whole(cells[:cut], n[:cut], trained[:cut])
            cells, n, trained = cells[cut:], n[cut:], trained[cut:]
        if len(cells):
            yield whole(cells, n, trained)

    dealt = parts.where(F.col("bucket").isNotNull()).select("bucket", "n", "cells").repartition("bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(merge, "cell long, n long, used long")


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``(word, cell, n)``: counts of words (``cell`` null) and of context-and-byte cells (``word`` null)."""
    parts = spill(corpus_parts(texts.select("text", F.lit(False).alias("held_out"))), "lm-parts")
    words = word_counts(parts).select("word", F.lit(None).cast("long").alias("cell"), "n")
    return words.union(cell_counts(parts).select(F.lit(None).cast("binary"), "cell", "n"))


def frequent_contexts(counts: DataFrame, max_nodes: int) -> DataFrame:
    """``(depth, context, byte, n)`` of the contexts of depth 1 to ``DEPTH`` that a ``Tree`` keeps.

    Contexts fall into bands by the logarithm of their count; the highest bands that hold ``max_nodes``
    contexts together, less one for the root, are kept.
    """
    context = F.expr(f"shiftright(cell, 8 + {CLASS_BITS} * ({DEPTH} - depth))")
    levels = spill(
        counts.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))))
        .groupBy("depth", context.alias("context"), (F.col("cell").bitwiseAND(F.lit(255))).cast("int").alias("byte"))
        .agg(F.sum("n").alias("n")), "lm-contexts")
    totals = levels.groupBy("depth", "context").agg(F.sum("n").alias("total"))
    band = _band("total")
    lowest = _lowest_band(totals.groupBy(band.alias("band")).count().collect(), max_nodes - 1)
    if lowest is None:
        return levels.where(F.lit(False))
    return levels.join(totals.where(band >= lowest).select("depth", "context"), ["depth", "context"])


def _band(count: str) -> Column:
    return F.floor(F.log2(F.col(count).cast("double")) * 8).cast("int")


def _lowest_band(sizes: list, room: int) -> int | None:
    """The lowest of the highest bands that fit into ``room``; there are 512 bands at most."""
    lowest = None
    for r in sorted(sizes, key=lambda r: -r["band"]):
        room -= r["count"]
        if room < 0:
            break
        lowest = r["band"]
    return lowest


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; exact to about 1e-12 for x >= 0.5."""
    y, steps = x + 8.0, np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    inverse = 1.0 / y
    tail = inverse * (1 / 12 - inverse ** 2 * (1 / 360 - inverse ** 2 * (1 / 1260 - inverse ** 2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - np.log(steps)


_HALF, _ONE = _log_gamma(np.arange(1 << 13) + 0.5), _log_gamma(np.arange(1 << 13) + 1.0)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithms of Krichevsky-Trofimov estimates of integer counts; those of small counts are looked up."""
    total = zeros + ones
    out = np.zeros(zeros.shape)  # an estimate without counts is 1
    few = (total > 0) & (total < len(_ONE))
    a, b, n = zeros[few], ones[few], total[few]
    out[few] = _HALF[a] + _HALF[b] - _ONE[n] - math.log(math.pi)
    many = total >= len(_ONE)
    a, b = zeros[many].astype(np.float64), ones[many].astype(np.float64)
    out[many] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)
    return out


class Tree:
    """A small context tree in memory: for each node, its step for every class and its row of logarithms.

    ``score_documents`` doesn't use it: its tree has no bound and is worked out on Spark.  What the missing
    children of a node would hold is one further leaf of it.

    ``step[node * KINDS + class]`` is the child; a class without a child leads to ``node + size``, a state
    that no class leaves.  Row ``state % size`` holds log10 probabilities of the next byte.
    """

    def __init__(self, depth: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray, root: np.ndarray) -> None:
        names = depth.astype(np.int64) << _BITS | context
        known, place = np.unique(names, return_inverse=True)
        self.size = len(known) + 1
        node_depth = np.concatenate([[0], known >> _BITS])
        node_context = np.concatenate([[0], known & ((1 << _BITS) - 1)])
        counts = np.zeros((self.size, 256), np.int64)
        counts[0] = root
        counts[place + 1, byte] = n
        nearer = node_context >> CLASS_BITS
        parent = np.where(node_depth <= 1, 0, np.searchsorted(known, (node_depth - 1) << _BITS | nearer) + 1)
        kind = node_context & (KINDS - 1)
        self.step = np.repeat(np.arange(2 * self.size, dtype=np.int32) % self.size + self.size, KINDS).astype(np.int32)
        self.step[parent[1:] * KINDS + kind[1:]] = np.arange(1, self.size)
        self.rows = self._mixture(counts, node_depth, parent)

    def _mixture(self, counts: np.ndarray, depth: np.ndarray, parent: np.ndarray) -> np.ndarray:
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        inner = np.zeros(self.size, bool)
        inner[parent[1:]] = True
        out = np.zeros((self.size, 256), np.float32)
        for bit in range(8):
            wide = 256 >> bit
            for first in range(0, 1 << bit, AT_A_TIME):
                last = min(first + AT_A_TIME, 1 << bit)
                cut = slice(first * wide, last * wide)
                pair = counts[:, cut].reshape(self.size, last - first, 2, wide // 2).sum(axis=3)
                others = pair.copy()  # what falls to no kept child; integers, so 0 is 0
                np.subtract.at(others, parent[1:], pair[1:])
                own, rest = _log_kt(pair[..., 0], pair[..., 1]), _log_kt(others[..., 0], others[..., 1])
                guess, guess_rest = [(x[..., 1] + 0.5) / (x.sum(axis=-1) + 1.0) for x in (pair, others)]
                del pair, others
                below, stop = np.where(inner[:, None], rest, 0.0), np.ones_like(own)
                weighted = own.copy()
                for level in reversed(levels):
                    mixed = level[inner[level]]
                    stop[mixed] = 1.0 / (1.0 + np.exp(np.clip(below[mixed] - own[mixed], -700, 700)))
                    weighted[mixed] = math.log(0.5) + np.logaddexp(own[mixed], below[mixed])
                    if depth[level[0]]:
                        np.add.at(below, parent[level], weighted[level])
                fixed, free = np.zeros_like(own), np.ones_like(own)
                for level in levels[1:]:
                    p = parent[level]
                    fixed[level] = fixed[p] + free[p] * stop[p] * guess[p]
                    free[level] = free[p] * (1.0 - stop[p])
                chance = fixed + free * (stop * guess + (1.0 - stop) * guess_rest)
                logs = np.log10(np.stack([1.0 - chance, chance], axis=2)).astype(np.float32)
                out[:, cut] += np.repeat(logs.reshape(self.size, -1), wide // 2, axis=1)
        return out

    def score(self, words: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text."""
        cells, places, _, _ = _laid_out([b" ".join(w) for w in words])
        state = np.zeros(len(cells), np.int32)
        for back in range(1, DEPTH + 1):
            state = self.step[state * KINDS + (cells >> (8 + CLASS_BITS * (DEPTH - back)) & (KINDS - 1))]
        state %= self.size
        logs = self.rows.ravel()[state.astype(np.int64) << 8 | cells & 255].astype(np.float64)
        return np.add.reduceat(logs, np.cumsum(places) - places)


def context_tree(counts: DataFrame, max_nodes: int = 1 << 16) -> Tree:
    """A ``Tree`` of a table of cells, pruned to ``max_nodes``."""
    root = np.zeros(256, np.int64)
    for r in counts.groupBy(F.col("cell").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("n").alias("n")).collect():
        root[r["byte"]] = r["n"]
    kept = frequent_contexts(counts, max_nodes).select("depth", "context", "byte", "n").toArrow()
    depth, context, byte, n = (kept.column(k).to_numpy() for k in range(4))
    return Tree(depth, context, byte, n, root)


def _upper(key: np.ndarray) -> np.ndarray:
    """The key ``context << 8 | decision`` of a node's parent."""
    return key >> (8 + CLASS_BITS) << 8 | key & 255


class _Level:
    """Nodes of one depth with their counts, own estimates, and the log-weights of what lies below them."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        change = np.diff(key, prepend=-1) != 0
        first = np.flatnonzero(change)
        self.key = key[first]
        self.zeros, self.ones = np.add.reduceat(zeros[order], first), np.add.reduceat(ones[order], first)
        self.below = None if below is None else np.add.reduceat(below[order], first)
        #: The node of each row that was given.
        self.node = np.empty(len(key), np.int64)
        self.node[order] = np.cumsum(change) - 1

    def mix(self) -> None:
        own = _log_kt(self.zeros, self.ones)
        self.guess = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        if self.below is None:  # of full depth
            self.stop, self.weighted = np.ones(len(own)), own
        else:
            self.stop = 1.0 / (1.0 + np.exp(np.clip(self.below - own, -700, 700)))
            self.weighted = math.log(0.5) + np.logaddexp(own, self.below)

    def above(self) -> _Level:
        return _Level(_upper(self.key), self.zeros, self.ones, self.weighted)

    def down(self, fixed: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixture's decided part and the weight left, after the node, from those before it."""
        return fixed + free * self.stop * self.guess, free * (1.0 - self.stop)


def _climb(cells: np.ndarray, n: np.ndarray, bit: int) -> list[_Level]:
    """Levels of the subtrees of sorted cells for one binary decision a byte, from depth ``DEPTH`` to ``TOP``, the last unmixed."""
    one = cells >> (7 - bit) & 1
    levels = [_Level(cells >> 8 << 8 | 1 << bit | (cells & 255) >> (8 - bit), n * (1 - one), n * one, None)]
    for _ in range(DEPTH - TOP):
        levels[-1].mix()
        levels.append(levels[-1].above())
    return levels


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Cells, counts and uses of whole subtrees below depth ``TOP``, many at a time, from sorted cells."""
    parts: list[list[np.ndarray]] = []
    fresh = 0
    for batch in batches:
        parts.append([batch.column(k).to_numpy() for k in range(3)])
        fresh += batch.num_rows
        if fresh >= SUBTREE_CELLS:
            whole = [np.concatenate(x) for x in zip(*parts)]
            cut = np.searchsorted(whole[0], whole[0][-1] >> _SUBTREE << _SUBTREE)
            if cut:
                yield [x[:cut] for x in whole]
            parts, fresh = [[x[cut:] for x in whole]], 0
    if parts and sum(len(p[0]) for p in parts):
        yield [np.concatenate(x) for x in zip(*parts)]


def _mixed_top(sums: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the nodes of depth ``TOP``, and the mixture's decided part and weight left after each."""
    key, zeros, ones, below = (sums.column(k).to_numpy() for k in range(4))
    if not len(key):
        return key, np.zeros(0), np.zeros(0)
    levels = [_Level(key, zeros, ones, below)]
    levels[0].mix()
    for _ in range(TOP):
        levels.append(levels[-1].above())
        levels[-1].mix()
    fixed, free = np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key))
    for lower, level in zip([*levels[-2::-1], None], levels[::-1]):
        fixed, free = level.down(fixed, free)
        if lower is not None:
            fixed, free = fixed[level.node], free[level.node]
    return levels[0].key, fixed, free


def cell_scores(cells: DataFrame) -> DataFrame:
    """``(cell, used, logp)`` of all cells: the log10 probability of each cell's byte after its context, under the whole tree.

    ``cells`` is ``(cell, n, used)`` with the counts ``n`` of training text, 0 for cells that only other texts have: a node
    without counts leaves the mixture as it is.
    """
    ordered = cells.select("cell", "n", "used").repartition(F.shiftright("cell", _SUBTREE)).sortWithinPartitions("cell")

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, n, _ in _subtrees(batches):
            for bit in range(8):
                top = _climb(cell, n, bit)[-1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (top.key, top.zeros, top.ones, top.below)], names)

    names = ["key", "zeros", "ones", "below"]
    sums = ordered.mapInArrow(climb, "key long, zeros long, ones long, below double")
    top = _mixed_top(sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow())
    shared = cells.sparkSession.sparkContext.broadcast(top)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top_fixed, top_free = shared.value
        for cell, n, used in _subtrees(batches):
            logp = np.zeros(len(cell))
            for bit in range(8):
                levels = _climb(cell, n, bit)
                at = np.searchsorted(key, levels[-1].key)
                fixed, free = top_fixed[at], top_free[at]
                for upper, level in zip(levels[:0:-1], levels[-2::-1]):
                    fixed, free = level.down(fixed[upper.node], free[upper.node])
                chance = fixed[levels[0].node]
                logp += np.log10(np.where(cell >> (7 - bit) & 1, chance, 1.0 - chance))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(used), pa.array(logp)], ["cell", "used", "logp"])

    return ordered.mapInArrow(descend, "cell long, used long, logp double")


def _hot_cells(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, Column]:
    """The most used cells in order, their logarithms, and the condition that picks them."""
    band = _band("used")
    lowest = _lowest_band(cells.groupBy(band.alias("band")).count().collect(), HOT_CELLS)
    chosen = F.lit(False) if lowest is None else band >= lowest
    taken = cells.where(chosen).select("cell", "logp").toArrow()
    cell, logp = (taken.column(k).to_numpy() for k in range(2))
    order = np.argsort(cell)
    return cell[order], logp[order], chosen


def _score_hot(cells: np.ndarray, places: np.ndarray, hot: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the hot cells of each of ``SLICE_TEXTS`` texts at most; text, cell and number of the others."""
    pairs = cells.astype(np.uint64) << 8 | np.repeat(np.arange(len(places), dtype=np.uint64), places)
    pairs.sort()
    first = _starts(pairs)
    pairs, number = pairs[first], np.diff(first, append=len(pairs))
    cells, text = (pairs >> 8).astype(np.int64), (pairs & 255).astype(np.int64)
    if not len(hot):
        return np.zeros(len(places)), text, cells, number
    first = _starts(cells)
    at = np.minimum(np.searchsorted(hot, cells[first]), len(hot) - 1)
    at = np.repeat(np.where(hot[at] == cells[first], at, -1), np.diff(first, append=len(cells)))
    known, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    sums = np.bincount(text[known], number[known] * logp[at[known]], len(places))
    return sums, text[rare], cells[rare], number[rare]


def _score_frequent(words: pa.Array, n_words: np.ndarray, frequent: pa.Array,
                    logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Sums of logarithms and number of the frequent words of each text; text, word and number of the others."""
    at = pc.index_in(words, value_set=frequent)
    is_rare = at.is_null()
    rare = words.filter(is_rare).dictionary_encode()
    is_rare = is_rare.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(n_words)), n_words)
    known = text[~is_rare]
    sums = np.bincount(known, logs[at.drop_null().to_numpy()], len(n_words))
    size = max(len(rare.dictionary), 1)
    name, number = np.unique(text[is_rare] * size + rare.indices.to_numpy(), return_counts=True)
    return sums, np.bincount(known, minlength=len(n_words)), name // size, rare.dictionary.take(pa.array(name % size)), number


def _cell_keys(cells: np.ndarray) -> pa.Array:
    """Keys of cells in the join with words: a space, which no word has, and eight bytes."""
    raw = np.empty((len(cells), 9), np.uint8)
    raw[:, 0] = 0x20
    raw[:, 1:] = cells.astype(">i8").view(np.uint8).reshape(-1, 8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(9), len(cells), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _frequent(vocabulary: DataFrame) -> tuple[pa.Array, np.ndarray, Column]:
    """The frequent words, their counts, and the condition that picks them.

    Short words of the highest bands of counts that hold ``FREQUENT`` words together are taken.
    """
    short = F.octet_length("word") <= FREQUENT_BYTES
    band = _band("n")
    lowest = _lowest_band(vocabulary.where(short).groupBy(band.alias("band")).count().collect(), FREQUENT)
    chosen = F.lit(False) if lowest is None else short & (band >= lowest)
    taken = vocabulary.where(chosen).select("word", "n").toArrow()
    return taken.column(0).combine_chunks().cast(pa.binary()), taken.column(1).to_numpy(), chosen


def score_documents(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    ``held_out`` is a condition on the input's columns; rows where it isn't true train the model.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         F.coalesce(held_out, F.lit(False)).alias("held_out"))
    parts = spill(corpus_parts(chosen), "lm-parts")
    vocabulary = spill(word_counts(parts), "lm-words")
    n_ends = chosen.where(~F.col("held_out")).count()
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    n_all, n_distinct = size["n"] + n_ends, size["v"] + (1 if n_ends else 0)

    cells = spill(cell_counts(parts), "lm-cells")
    cells = spill(cell_scores(cells), "lm-scores")
    hot, hot_logp, is_hot = _hot_cells(cells)
    common, common_counts, is_common = _frequent(vocabulary)
    shared = spark.sparkContext.broadcast((hot, hot_logp, common, np.log10(common_counts + 1.0)))
    del hot, hot_logp, common

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_logp, frequent, log_counts = shared.value
        row = TaskContext.get().partitionId() << 36

        def joined(owner: np.ndarray, key: pa.Array, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(owner), key, pa.array(times), pa.nulls(len(owner), kind)], names)

        for batch in batches:
            for first, slices in _spans(batch):
                parts, begin = [], row
                for texts in slices:
                    cells, places, *words = _laid_out(texts)
                    score, text, cell, times = _score_hot(cells, places, hot, hot_logp)
                    yield joined(row + text, _cell_keys(cell), times)
                    parts.append((score, *words))
                    row += len(texts)
                score, words, n_words = zip(*parts)
                n_words, n = np.concatenate(n_words), row - begin
                base, known, text, word, times = _score_frequent(pa.concat_arrays(words), n_words, frequent, log_counts)
                yield joined(begin + text, word, times)
                rows = np.arange(begin, row)
                doc = pa.StructArray.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("held_out").slice(first, n), pa.array(n_words + 1),
                     pa.array(known + (n_ends > 0)), pa.array(base + math.log10(n_ends + 1)), pa.array(np.concatenate(score))],
                    fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array([b" %d" % r for r in rows], pa.binary()), pa.array(np.ones(n, np.int64)), doc], names)

    names = ["row", "key", "m", "doc"]
    kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                      ("base", pa.float64()), ("score", pa.float64())])
    parts = chosen.mapInArrow(score, "row long, key binary, m long, doc struct<doc_id long, held_out boolean, "
                                     "n_tokens long, known long, base double, score double>")
    rare_words = vocabulary.where(~is_common).select("word", "n", F.lit(None).cast("double").alias("logp"))
    rare_cells = cells.where(~is_hot).select(
        F.concat(F.expr("X'20'"), F.unhex(F.lpad(F.hex("cell"), 16, "0"))), F.lit(None).cast("long"), "logp")
    joined = parts.join(rare_words.union(rare_cells), F.col("key") == F.col("word"), "left").select("row", "doc.*", "m", "n", "logp")
    rare_known = F.when(F.col("n").isNotNull(), F.col("m"))
    per_row = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(rare_known), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.col("m") * F.log10((F.col("n") + 1).cast("double"))), F.lit(0.0))).alias("gain"),
        (F.max("score") + F.coalesce(F.sum(F.col("m") * F.col("logp")), F.lit(0.0))).alias("score"))
    return per_row.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
                          (F.col("gain") - F.col("n_tokens") * math.log10(n_all + n_distinct + 1)).alias("base_score"),
                          "score")
