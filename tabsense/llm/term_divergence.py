"""Source divergence audit: terms of many documents by iceberg prefix refinement, then exact divergences.

Which terms a language keeps (those in at least ``least`` of its documents) is found level by level.  A
level counts, for every language, the documents that hold a complete term of up to ``L`` bytes or a longer
term's first ``L`` bytes.  A document that holds a term holds all its prefixes, so a prefix in fewer than
``least`` documents is discarded with every term that it begins; the next level, of twice the bytes, counts
only what extends a kept prefix.  The refinement ends when complete terms alone are left.

A level is one scan.  Tasks count the texts that they hold together and shuffle one row per language and prefix.  A scan
numbers only terms longer than the prefixes of the level before, cut to what tells their keys, in arrays.  The kept
prefixes reach the next scan as a Bloom filter of at most ``BLOOM_BITS``: a wrongly passed prefix costs a
count and changes no result, as every complete term's documents are counted in full before it is kept.

Defined cases: null text, lang and source are empty strings; every row is a document, so repeated rows
count as often as they stand there; a document without terms makes its group occur; a language that keeps
no term gives pairs of value 0 and no term rows; an empty table gives no rows; ties rank by the UTF-8 bytes
of the item; other columns than doc_id are not read; texts and terms may have any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsense.llm.common import n_tasks, pick, spill, text_or_empty

LEAST_DOCS = 10
#: Bytes of the first level's prefixes.
FIRST_LEVEL = 6
#: Bits of the largest filter (8 MB), and bits a kept prefix while it is smaller.
BLOOM_BITS, BITS_A_KEY = 1 << 26, 16
#: Bytes of text that a task counts together, and of a text that is counted in pieces.
TASK_BYTES, LONG_TEXT = 32 << 20, 8 << 20
#: Terms whose keys are looked up together.
TASK_TERMS = 300_000
#: Counts of one block of the pairwise sums, and cells of a matrix of shares.
BLOCK_COUNTS, BLOCK_CELLS = 200_000, 1 << 20
#: Shares are in billionths.
SCALE = 1_000_000_000
_OPEN = b"*"  # marks a prefix of longer terms; no term holds this byte
_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Blank for every byte that ends a term, and A-Z lower-cased.
_PLAIN = bytes(32 if b not in _LETTERS else b + 32 if b < 0x5B else b for b in range(256))


def number_terms(texts: list[bytes], above: int = 0, width: int | None = None) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """The term number and text number of every occurrence of more than ``above`` bytes, and the terms cut to ``width``.

    Terms are runs of letters and non-ASCII bytes, only A-Z lower-cased.
    """
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_PLAIN), np.uint8)
    edge = np.flatnonzero(np.diff(data != 32, prepend=False, append=False))
    first, length = edge[::2], edge[1::2] - edge[::2]
    if above:
        first, length = first[length > above], length[length > above]
    per_text = np.diff(np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in texts)])))
    if width:
        length = np.minimum(length, width)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first], inside[first + length] = 1, -1
    letters = data[np.cumsum(inside, out=inside)[:-1].view(bool)]
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), per_text), coded.dictionary


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about ``LONG_TEXT`` bytes, cut where no term is."""
    plain = text.translate(_PLAIN)
    start = 0
    while start < len(plain):
        cut = plain.find(b" ", start + LONG_TEXT)
        cut = len(plain) if cut < 0 else cut
        yield plain[start:cut]
        start = cut


# ----------------------------------------------------------------------------- the filter of kept prefixes

def _places(seeds: Iterable[int], keys: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three bits of each key, in a filter whose last bit is number ``last``; a seed is the hash of the key's language."""
    h = np.array([xxhash.xxh3_64_intdigest(k, seed) for k, seed in zip(keys.to_numpy(zero_copy_only=False), seeds)], np.uint64)
    step, bits = h >> np.uint64(32) | np.uint64(1), np.uint64(last)
    return tuple((h + np.uint64(k) * step & bits).astype(np.int64) for k in range(3))


def bloom_filter(keys: DataFrame, n_keys: int) -> bytes:
    """Bits of a Bloom filter over (lang, key); its words are joined on Spark, at most ``BLOOM_BITS`` reach the driver."""
    bits = min(BLOOM_BITS, 1 << max(16, (BITS_A_KEY * n_keys - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.sort(np.concatenate(_places(map(xxhash.xxh3_64_intdigest, batch.column(0).to_pylist()), batch.column(1), bits - 1)))
            first = np.flatnonzero(np.diff(at >> 3, prepend=-1))
            word = at[first] >> 3
            value = np.bitwise_or.reduceat(1 << (at & 7), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value, pa.int64())], ["word", "bits"])

    joined = keys.select("lang", "key").mapInArrow(words, "word long, bits long") \
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 3, np.uint8)
    out[joined.column(0).to_numpy()] = joined.column(1).to_numpy().astype(np.uint8)
    return out.tobytes()


class _Known:
    """The keys under which a language's terms count: null where the filter lacks them."""

    def __init__(self, lang: str, before: int, level: int | None, kept: bytes | None) -> None:
        self.seed, self.before, self.level = xxhash.xxh3_64_intdigest(lang), before, level
        self.kept = None if kept is None else np.frombuffer(kept, np.uint8)

    def __getitem__(self, term: bytes) -> bytes | None:
        return self.keys(pa.array([term], pa.binary()))[0].as_py()

    def keys(self, terms: pa.Array) -> pa.Array:
        out = terms if self.level is None else _open(terms, self.level)
        if self.kept is None:
            return out
        sought = (terms if self.level is None else _open(terms, self.before)).dictionary_encode()
        passes = pa.array(self._passes(sought.dictionary)).take(sought.indices)
        return pc.if_else(passes, out, pa.scalar(None, out.type))

    def _passes(self, sought: pa.Array) -> np.ndarray:
        out = np.ones(len(sought), bool)
        for at in _places(repeat(self.seed), sought, (len(self.kept) << 3) - 1):
            out &= (self.kept[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        if self.level is not None:  # a term without a mark was counted at an earlier level
            out &= pc.ends_with(sought, _OPEN).to_numpy(zero_copy_only=False)
        return out


def _open(terms: pa.Array, level: int) -> pa.Array:
    """Terms of more than ``level`` bytes as the marked prefix, others as they are."""
    cut = pc.binary_join_element_wise(pc.binary_slice(terms, 0, level), _OPEN, b"")
    return pc.if_else(pc.greater(pc.binary_length(terms), level), cut, terms)


def _batch(group: tuple, keys: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    names = [pa.repeat(pa.scalar(x, pa.string()), len(keys)) for x in group]
    return pa.RecordBatch.from_arrays([*names, keys, pa.array(n, pa.int64())], names=[*("lang", "source")[:len(group)], "key", "n"])


class _Texts:
    """Texts of one task by group, counted together whenever they are many."""

    def __init__(self, before: int, level: int | None, kept: bytes | None) -> None:
        self.args = (before, level, kept)
        self.texts: dict[tuple, list[bytes]] = {}
        self.held = 0

    def add(self, group: tuple, text: bytes) -> None:
        self.texts.setdefault(group, []).append(text)
        self.held += len(text)

    def _number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
        """Terms longer than the last level's prefixes, with one byte more than this level's: enough to tell their keys."""
        before, level, _ = self.args
        return number_terms(texts, before, None if level is None else level + 1)

    def _keys(self, lang: str, terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each term's key (-1: none), and the keys."""
        known = _Known(lang, *self.args)
        parts = [known.keys(terms.slice(k, TASK_TERMS)) for k in range(0, len(terms), TASK_TERMS)]
        keys = pa.concat_arrays([pa.array([], pa.binary()), *parts]).dictionary_encode()
        return keys.indices.fill_null(-1).to_numpy(), keys.dictionary

    def documents(self) -> Iterator[pa.RecordBatch]:
        """In how many of the held texts each key stands."""
        for group, texts in self.texts.items():
            short = [t for t in texts if len(t) <= LONG_TEXT]
            code, owner, terms = self._number(short)
            at, keys = self._keys(group[0], terms)
            key = at[code]
            here = key >= 0
            held = np.sort(owner[here] * max(len(keys), 1) + key[here])  # a text's equal keys in a row
            once = held[np.diff(held, prepend=-1) != 0]
            yield _batch(group, keys, np.bincount(once % max(len(keys), 1), minlength=len(keys)))
            for text in texts:
                if len(text) > LONG_TEXT:
                    found: set[bytes] = set()
                    for piece in pieces(text):
                        found.update(self._keys(group[0], self._number([piece])[2])[1].to_pylist())
                    yield _batch(group, pa.array(list(found), pa.binary()), np.ones(len(found), np.int64))
        self.texts, self.held = {}, 0

    def occurrences(self) -> Iterator[pa.RecordBatch]:
        """How often each key stands in the held texts."""
        for group, texts in self.texts.items():
            for part in [[t for t in texts if len(t) <= LONG_TEXT], *([p] for t in texts if len(t) > LONG_TEXT for p in pieces(t))]:
                code, _, terms = self._number(part)
                at, keys = self._keys(group[0], terms)
                key = at[code]
                yield _batch(group, keys, np.bincount(key[key >= 0], minlength=len(keys)))
        self.texts, self.held = {}, 0


def _scan(docs: DataFrame, before: int, level: int | None, kept: Broadcast | None, by_source: bool) -> DataFrame:
    """Counts of the tasks: documents of each key of the level, or occurrences of kept terms by source."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Texts(before, level, kept.value if kept else None)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lang, source = part.column(0).to_pylist(), part.column(1).to_pylist()
                for k, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                    held.add((lang[k], source[k]) if by_source else (lang[k],), text)
                    if held.held > TASK_BYTES:
                        yield from held.occurrences() if by_source else held.documents()
        yield from held.occurrences() if by_source else held.documents()

    kinds = "lang string, source string, key binary, n long" if by_source else "lang string, key binary, n long"
    return docs.mapInArrow(count, kinds)


# ----------------------------------------------------------------------------- refinement

def _plain(docs: DataFrame) -> DataFrame:
    return pick(docs, "lang", "source", "text", "doc_id").select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")], "doc_id")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, key, n): the terms in at least ``least`` documents of their language, and in how many.

    ``docs`` has the columns lang, source and text (in this order, first), without nulls.
    """
    spark = docs.sparkSession
    complete: list[DataFrame] = []
    before, level, kept = 0, FIRST_LEVEL, None
    while True:
        found = _scan(docs, before, level, kept, False).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        found = spill(found.where(F.col("n") >= least), "term-prefixes")
        is_open = F.substring("key", -1, 1) == F.lit(_OPEN)
        complete.append(found.where(~is_open))
        longer = found.where(is_open)
        n_open = longer.count()
        if kept is not None:
            kept.unpersist()
        if not n_open:
            break
        kept = spark.sparkContext.broadcast(bloom_filter(longer, n_open))
        before, level = level, 2 * level
    out = complete[0]
    for more in complete[1:]:
        out = out.unionAll(more)
    return out


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, key, n, total): occurrences of kept terms in each group that has them, and in the language."""
    passes = docs.sparkSession.sparkContext.broadcast(bloom_filter(kept, kept.count()))
    by_group = docs.repartitionByRange("lang", "source", F.xxhash64("doc_id", "text"))  # a task counts few groups
    per_task = _scan(by_group.select("lang", "source", "text"), 0, None, passes, True).repartition(n_tasks(docs.sparkSession), "lang", "key")
    counts = per_task.groupBy("lang", "source", "key").agg(F.sum("n").alias("n"))
    counts = counts.join(kept.select("lang", "key").hint("shuffle_hash"), ["lang", "key"], "left_semi")
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "key")))
    out = spill(counts.select("lang", "source", "key", "n", "total"), "term-counts")
    passes.unpersist()
    return out


# ----------------------------------------------------------------------------- divergence

def _share(count: str, size: str, n_terms: str = "n_terms") -> Column:
    """1 + floor(SCALE * (count + 2) / (size + 2 * n_terms)), in whole decimals."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)))"
                  f" div cast({size} + 2 * {n_terms} as decimal(20,0))")


def _shares(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same in numpy: a long division by thousands, exact while sizes stay below 2^53, else with Python's integers."""
    if len(size) and int(size.max()) >= 1 << 53:
        return np.array([1 + SCALE * (int(c) + 2) // int(s) for c, s in zip(count, size)], np.int64)
    whole, rest = np.divmod(count + 2, size)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + more
    return 1 + whole


def _pair_sums(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of f over one block of a language's terms, for every two of its groups."""
    source = groups.column("source").to_pylist()
    size = groups.column("size").to_numpy() + 2 * groups.column("n_terms").to_numpy()
    n = len(source)
    sums = np.zeros((n, n), np.int64)
    if counts.num_rows:
        place = {s: k for k, s in enumerate(source)}
        column = np.array([place[s] for s in counts.column("source").to_pylist()])
        terms = counts.column("key").combine_chunks().dictionary_encode()
        row = terms.indices.to_numpy()
        share = _shares(counts.column("n").to_numpy(), size[column])
        order = np.argsort(row, kind="stable")
        row, column, share = row[order], column[order], share[order]
        none = _shares(np.zeros(n, np.int64), size)
        step = max(1, BLOCK_CELLS // n)
        for first in range(0, len(terms.dictionary), step):
            last = min(first + step, len(terms.dictionary))
            a, b = np.searchsorted(row, (first, last))
            p = np.tile(none, (last - first, 1))
            p[row[a:b] - first, column[a:b]] = share[a:b]
            for k in range(n - 1):
                apart, both = p[:, k + 1:] - p[:, k:k + 1], p[:, k + 1:] + p[:, k:k + 1]
                sums[k, k + 1:] += (apart * apart // both).sum(axis=0)
        sums += sums.T
    left, right = np.nonzero(~np.eye(n, dtype=bool))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()),
                     "source": pa.array([source[k] for k in left], pa.string()),
                     "item": pa.array([source[k] for k in right], pa.string()),
                     "value": pa.array(sums[left, right], pa.int64())})


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how the groups of a language differ, by group and by term.

    Part ``pair`` sets a (lang, source) group against each other source of its language, over all kept terms;
    part ``term`` names the ``top`` terms that the group uses more than its language does.
    """
    docs = _plain(docs)
    kept = kept_terms(docs, least)
    counts = term_counts(docs, kept)

    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("n_counts"))
    n_terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(n_terms, "lang", "left")
    groups = spill(groups.na.fill(0), "term-groups")
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.ceil(F.sum("n_counts") / BLOCK_COUNTS).alias("n_blocks"))
    langs = langs.withColumn("n_blocks", F.greatest(F.col("n_blocks"), F.lit(1).cast("long")))
    groups = groups.join(langs, "lang")

    by_block = groups.select("lang", "source", "size", "n_terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    blocks = counts.join(langs.select("lang", "n_blocks"), "lang") \
        .select("lang", F.expr("pmod(xxhash64(key), n_blocks)").alias("block"), "source", "key", "n")
    sums = blocks.groupBy("lang", "block").cogroup(by_block.groupBy("lang", "block")) \
        .applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    p, q = F.col("p"), F.col("q")
    sizes_of = groups.select("lang", "source", "size", "n_terms", "lang_size")
    shares = counts.join(sizes_of, ["lang", "source"]).select(
        "lang", "source", F.col("key").cast("string").alias("item"), _share("n", "size").alias("p"), _share("total", "lang_size").alias("q"))
    terms = shares.where(p > q).select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.withColumn("part", F.lit("term")))


#: DuckDB SQL of ``divergence`` over ``documents``.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
full_p AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (size + 2 * v) AS p
           FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
lang_p AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
           FROM c JOIN v USING (lang) GROUP BY lang, term),
pair_sum AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pair_sum s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
         FROM full_p JOIN lang_p USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
