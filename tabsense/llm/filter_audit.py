"""Filter interaction audit: what every order of five filters removes, from one Gray-code walk over their subsets.

Documents are first counted by part and by the mask of the filters that they fail (32 cells a part).  The
walk then visits all 32 subsets of filters, toggling one filter at a time: every cell has a counter of the
active filters that it fails, and the running survivors lose a cell when its counter leaves zero and regain
it when the counter is back there.  The 32 states are stored; a step of any order is the difference of two.

Filters: A under 50 words; B distinct words under 65 % of the words; C capitals A-Z over 5 % of the code
points; D any of ``#$%&*|``; E a text that a smaller doc_id has too, anywhere in the table.

Defined cases: null text and null source are empty strings; a text without words fails A alone; a row
without id is no copy of others and makes no other row a copy; rows of equal id and text are counted each
and are no copies of each other; labels of one id are joined (1 if any row says 1), a document without label
has neither; an empty table has no part and gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsense.llm.common import pick, text_or_empty

#: The filters, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
MARKS = "[#$%&*|]"
_BLANKS = r"[ \t\n\x0B\f\r]+"
_CELLS = 1 << len(FILTERS)
#: What is counted of each cell.
MEASURES = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails A, B, C and D."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < LEAST_WORDS, 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"),
             100 * capitals.cast("long") > CAPITALS_PERCENT * F.char_length(text).cast("long"), text.rlike(MARKS))
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << bit).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    per_doc = pick(docs, "doc_id", "text", "source").select("doc_id", text_or_empty("source").alias("part"), text_or_empty().alias("text"))
    per_doc = per_doc.select("doc_id", "part", F.sha2("text", 256).alias("digest"), text_mask(F.col("text")).alias("mask"))
    per_doc = per_doc.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))

    marks = pick(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # rows without id match no label: a key of their own keeps them from meeting in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0).cast("long"))
    marked = per_doc.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left") \
        .na.fill(0, ["good", "toxic"])

    # rows of one text, summed by part and label before they meet; the least id's rows are counted apart
    alike = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_apart"))
    first = F.min("least").over(Window.partitionBy("digest"))
    alike = alike.withColumn("passing", F.col("n_apart") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
                   F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    split = alike.select("part", "good", "toxic", F.inline(both)).where(F.col("n") > 0)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                             F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, along the last axis, from the counts of every mask's cell.

    Subset ``s`` and mask ``m`` have bit k for filter k.  Each step toggles one filter.
    """
    states = np.empty_like(counts)
    active = np.zeros(_CELLS, np.int64)  # of each cell: the active filters that it fails
    survivors = counts.sum(axis=-1)
    masks = np.arange(_CELLS)
    subset = 0
    states[..., subset] = survivors
    for step in range(1, _CELLS):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        touched = masks[masks >> bit & 1 == 1]
        if subset >> bit & 1:
            survivors = survivors - counts[..., touched[active[touched] == 0]].sum(axis=-1)
            active[touched] += 1
        else:
            active[touched] -= 1
            survivors = survivors + counts[..., touched[active[touched] == 0]].sum(axis=-1)
        states[..., subset] = survivors
    return states


def _steps() -> list[tuple[str, int, int, int]]:
    """Every order's steps: order, step, the subset before it, the filter's bit."""
    out = []
    for order in permutations(range(len(FILTERS))):
        subset = 0
        for step, bit in enumerate(order, 1):
            out.append(("".join(FILTERS[b] for b in order), step, subset, bit))
            subset |= 1 << bit
    return out


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows a part from its cells."""
    steps = _steps()
    before = np.array([s[2] for s in steps])
    bit = np.array([s[3] for s in steps])
    alone, everything = 1 << np.arange(len(FILTERS)), _CELLS - 1
    for batch in batches:
        for k in range(batch.num_rows):
            counts = np.zeros((len(MEASURES), _CELLS), np.int64)
            for cell in batch.column(1)[k].as_py():
                counts[:, cell["mask"]] = [cell[m] for m in MEASURES]
            states = gray_walk(counts)
            n, good, toxic = states
            after = before | 1 << bit
            removed = n[before] - n[after]
            failing = n[0] - n[alone]
            shapley = np.zeros(len(FILTERS), np.int64)
            np.add.at(shapley, bit, removed)
            unique = n[everything ^ alone] - n[everything]
            columns = {
                "part": pa.array([batch.column(0)[k].as_py()] * len(steps), pa.string()),
                "filter_order": pa.array([s[0] for s in steps], pa.string()),
                "step": pa.array([s[1] for s in steps], pa.int32()),
                "kept": n[after], "removed": removed, "redundant": failing[bit] - removed, "unique_fails": unique[bit],
                "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after], "shapley": shapley[bit]}
            yield pa.RecordBatch.from_pydict(columns)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step of all 120 orders of the filters, per source."""
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # at most 32 a part
    return by_part.mapInArrow(_audit_rows, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                           "unique_fails long, good_lost long, toxic_lost long, shapley long")


#: DuckDB SQL of ``interactions`` over ``documents`` and ``labels``.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
flt AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
orders AS (SELECT '' AS filter_order, 0 AS taken UNION ALL
           SELECT filter_order || letter, taken + bit FROM orders, flt WHERE taken & bit = 0),
steps AS (SELECT o.filter_order, s.step, flt.letter, flt.bit,
                 (SELECT coalesce(sum(p.bit), 0) FROM flt p WHERE position(p.letter IN o.filter_order) < s.step)::INTEGER AS before
          FROM (SELECT filter_order FROM orders WHERE taken = 31) o, (SELECT unnest(range(1, 6)) AS step) s, flt
          WHERE flt.letter = o.filter_order[s.step]),
r AS (SELECT part, filter_order, step, letter,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM cell, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r"""
