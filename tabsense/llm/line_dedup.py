"""Line dedup with keep bitmaps, on DataFrame functions only.

Lines leave their documents as hashes.  The hashes are dealt into ranges with a secondary sort by
document and position, and one pass along each range sees the first line of every document that holds
a key, which counts the key's documents and finds its first occurrence.  What goes back to a document
is a bitmap of its lines, 64 to a word, in runs: words that lose a line, each with the number of whole
words before it.  Texts are never shuffled with their lines.

Scale: a key is cut into ``SALTS`` parts by a hash of the document before the range sort, so that a
line which a third of all documents share is spread over many ranges; the parts' counts are added up
afterwards, and the occurrences of a common line meet its count part by part.  Documents are named by
id and a hash of the text.  A document's work is linear in its lines.

Defined cases: a null or empty text is one empty line; lines whose key is empty are always kept; a
document is a row, so ten rows with equal id and text hold each of their lines ten times; such rows
lose the same lines (and, where first occurrences are spared, keep the same); a null id is an id; an
empty table gives no rows; any number of lines and any length of line are handled; other columns pass
through untouched, also those whose names differ from ``doc_id`` or ``text`` in case alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsense.llm.common import n_tasks, pick, spill

SALTS = 64
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, ASCII letters lower-cased."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # then lower() touches A-Z alone
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")


def line_hashes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, text_hash, pos, h1, h2)`` of every line whose key isn't empty."""
    whole = pick(docs, doc_id, text).toDF("doc_id", "text").withColumn("text", _text(F.col("text")))
    # The hash is drawn before lines become rows: beside the generator it would be drawn anew for each.
    split = whole.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    lines = split.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where("key <> ''")
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def key_counts(lines: DataFrame) -> DataFrame:
    """``(h1, h2, n_docs, first, salts)``: each key's documents, its first occurrence and its parts.

    The first occurrence is the least by document and position.  Repeated rows stand side by side in
    the sort, and each counts.
    """
    dealt = lines.withColumn("salt", _salt()).repartitionByRange(n_tasks(lines.sparkSession), "h1", "salt")
    along = Window.partitionBy("h1", "h2", "salt", "doc_id", "text_hash").orderBy("pos")
    streamed = dealt.withColumn("least", F.min("pos").over(along)).where("pos = least")
    place = F.struct("doc_id", "text_hash", "pos")
    parts = streamed.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"),
                                         F.collect_list("salt").alias("salts"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, keep, n_dropped)`` of the documents that lose lines.

    ``keep`` lists ``(gap, bits)`` in order: ``gap`` words of 64 kept lines, then a word whose cleared
    bits are lost lines; what follows the last word is kept.  Lines go if their key occurs in
    ``min_docs`` documents; ``keep_first`` spares the first occurrence in the corpus.
    """
    lines = spill(line_hashes(docs, doc_id, text), "line-hashes")
    common = key_counts(lines).where(F.col("n_docs") >= min_docs)
    common = common.select("h1", "h2", "first", F.explode("salts").alias("salt"))
    lost = lines.withColumn("salt", _salt()).join(common, ["h1", "h2", "salt"])
    if keep_first:
        lost = lost.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    words = lost.groupBy("doc_id", "text_hash", F.expr("cast(pos div 64 as int)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits"))
    runs = F.expr("""transform(array(array_sort(collect_list(struct(word, bits)))), s -> transform(s, (x, i) ->
        struct(x.word - coalesce(get(s, i - 1).word, -1) - 1 AS gap, ~x.bits AS bits)))[0]""")
    return words.groupBy("doc_id", "text_hash").agg(runs.alias("keep"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def without_lines(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  name: str = "_lines") -> DataFrame:
    """``docs`` and a struct column ``name``: ``text`` (the kept lines), ``n_lines`` and ``n_dropped``."""
    apart = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    own_id, own_text = F.col(f"_{docs.columns.index(doc_id)}"), _text(F.col(f"_{docs.columns.index(text)}"))
    joined = apart.withColumn("t", own_text).join(
        bitmaps, own_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64("t") == F.col("text_hash")), "left")
    # The lambda over a list of one binds the unrolled words, so that each line finds its word by place.
    kept = F.expr("""array_join(transform(
        array(flatten(transform(keep, r -> concat(array_repeat(-1L, r.gap), array(r.bits))))),
        w -> filter(split(t, '\\n', -1),
                    (line, i) -> getbit(coalesce(get(w, cast(i div 64 as int)), -1L), cast(i % 64 as int)) = 1))[0], '\\n')""")
    whole = F.struct(
        F.when(F.col("keep").isNull(), F.col("t")).otherwise(kept).alias("text"),
        (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    return joined.select(*apart.columns, whole.alias(name)).toDF(*docs.columns, name)


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, doc_id: str = "doc_id",
                text: str = "text", name: str = "_lines") -> DataFrame:
    """``docs`` with the struct ``name`` of :func:`without_lines`, under the bitmaps of all documents."""
    return without_lines(docs, keep_bitmaps(docs, min_docs, keep_first, doc_id, text), doc_id, text, name)
