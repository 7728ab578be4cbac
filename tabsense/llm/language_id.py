"""Language identification by cross-parsing entropy (Ziv and Merhav's relative entropy estimate).

Every learned language has a reference: pieces of its labelled texts, joined.  Its suffix automaton knows
all substrings of the reference, so walking a text through it cuts the text into phrases, each the longest
match from where the last one ended; a symbol that the reference lacks is a phrase of its own.  A text of
``n`` symbols that needs ``c`` phrases of a reference of ``m`` symbols costs about ``c * log2(m) / n`` bits a
symbol, and the language with the fewest such normalised phrases wins.

Texts are lower-cased and every run of bytes other than a-z and non-ASCII ones becomes one blank; references
and texts are read as UTF-8 bytes.  A text is walked in blocks of ``BLOCK`` bytes (a cut adds at most one
phrase, and the same one to every language), many blocks of many texts in step, so that a long text needs
no more memory or steps than many short ones.

The reference is a bounded sample of labelled rows: for each language and each of ``SLOTS`` slots of text
hashes, the piece of at most ``PIECE`` characters of the row with the least hash, taken at a hashed place.
Copies share a hash, so a group of copies fills one slot at most.  All languages' references together have
at most ``MODEL_BYTES``.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text where no
language could be learned; a row without id is neither held out nor special otherwise; a label whose sample
holds no letter is not learned; ties go to the first language by name, with score 0; repeated rows are
scored each and fill one slot; an empty table gives no rows; other columns, also of the names used here,
pass through ``identify`` untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabsense.llm.common import pick

UNKNOWN = "und"
#: The bound of the labelled sample: slots a language, characters a piece, bytes of all references.
SLOTS, PIECE, MODEL_BYTES = 96, 400, 1 << 20
#: Bytes of a block, and blocks that are walked in step.
BLOCK, LANES = 256, 16_384
SEED = 11

_NOT_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def plain_bytes(text: str) -> bytes:
    """Lower-cased UTF-8 with one blank for every run of other bytes than letters and non-ASCII ones."""
    return _NOT_LETTERS.sub(b" ", text.lower().encode("utf-8", "replace"))


# ----------------------------------------------------------------------------- references

def references(labelled: DataFrame) -> dict[str, bytes]:
    """A reference for every language of (lang, text), from the bounded sample; both columns without nulls."""
    h = F.xxhash64("text", F.lit(SEED))
    start = 1 + F.pmod(F.xxhash64("text", F.lit(SEED + 1)), F.greatest(F.char_length("text") - PIECE, F.lit(1)))
    rows = labelled.select("lang", F.pmod(h, F.lit(SLOTS)).alias("slot"), h.alias("h"),
                           F.col("text").substr(start.cast("int"), F.lit(PIECE)).alias("piece"))
    best = rows.groupBy("lang", "slot").agg(F.min(F.struct("h", "piece")).alias("best"))
    pieces: dict[str, list[tuple[int, str]]] = {}
    for r in best.select("lang", "slot", "best.piece").toLocalIterator():  # at most SLOTS rows a language
        pieces.setdefault(r["lang"], []).append((r["slot"], r["piece"]))
    share = max(64, MODEL_BYTES // max(len(pieces), 1))
    out = {}
    for lang in sorted(pieces):
        joined = b" ".join(plain_bytes(piece).strip() for _, piece in sorted(pieces[lang]))
        if joined.strip():
            out[lang] = b" " + joined[:share - 1]
    return out


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts every suffix of ``text`` (state 0 is the start)."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                split = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = split
                    at = link[at]
                link[target] = link[new] = split
        last = new
    return moves


class Parser:
    """Cross-parsing against the references: one table a language, indexed by state and symbol.

    An entry is the next state's row times two, plus one where the symbol begins a phrase.
    """

    def __init__(self, refs: dict[str, bytes]) -> None:
        self.langs = list(refs)
        used = np.unique(np.frombuffer(b"".join(refs.values()), np.uint8))
        self.width = len(used) + 1  # the last symbol stands for every byte that no reference has
        self.symbol = np.full(256, len(used), np.uint8)
        self.symbol[used] = np.arange(len(used))
        self.tables = [self._table(ref) for ref in refs.values()]
        self.bits = np.array([math.log2(max(len(ref), 2)) for ref in refs.values()])

    def _table(self, ref: bytes) -> np.ndarray:
        moves = suffix_automaton(self.symbol[np.frombuffer(ref, np.uint8)].tobytes())
        first = np.zeros(self.width, np.int64)
        for symbol, state in moves[0].items():
            first[symbol] = state
        table = np.tile(first * self.width << 1 | 1, (len(moves), 1))  # a phrase begins
        state = np.repeat(np.arange(1, len(moves)), [len(m) for m in moves[1:]])
        symbol = np.fromiter((s for m in moves[1:] for s in m), np.int64, len(state))
        table[state, symbol] = np.fromiter((t for m in moves[1:] for t in m.values()), np.int64, len(state)) * self.width << 1
        return table.ravel().astype(np.int32 if table.max() < 1 << 31 else np.int64)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text under each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + ordinal * BLOCK
        length = np.minimum(sizes[owner] - ordinal * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")  # blocks that end early leave the walk from the back
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for a in range(0, len(order), LANES):
            lanes = order[a:a + LANES]
            walking = len(lanes) - np.searchsorted(length[lanes][::-1], np.arange(length[lanes[0]]), side="right")
            begin = start[lanes]
            symbols = [data[begin[:w] + k] for k, w in enumerate(walking)]
            for number, table in enumerate(self.tables):
                row, n = np.zeros(len(lanes), table.dtype), np.zeros(len(lanes), np.int32)
                for w, symbol in zip(walking, symbols):
                    entry = table[row[:w] + symbol]
                    n[:w] += entry & 1
                    row[:w] = entry >> 1
                out[:, number] += np.bincount(owner[lanes], n, len(texts)).astype(np.int64)
        return out

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number, and by what part it beats the second (1 where there is but one)."""
        cost = self.phrases(texts) * self.bits
        best = cost.argmin(axis=1)
        if len(self.langs) == 1:
            return best, np.ones(len(texts))
        two = np.partition(cost, 1, axis=1)[:, :2]
        return best, 1.0 - two[:, 0] / two[:, 1]


@lru_cache(maxsize=1)
def _parser(refs: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(dict(refs))


# ----------------------------------------------------------------------------- prediction

def identify(docs: DataFrame, refs: dict[str, bytes], name: str = "_language") -> DataFrame:
    """``docs`` with a struct of ``lang_pred`` and ``score`` for its column ``text``, by the given references.

    An existing column called ``name`` is an error.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"a column {name!r} exists already")
    spark = docs.sparkSession
    place = docs.columns.index("text")
    model = spark.sparkContext.broadcast(tuple(refs.items()))  # MODEL_BYTES at most
    answer = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def judge(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parser = _parser(model.value)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if parser.langs else []
        held: list[int] = []
        size = 0
        plain: list[bytes] = []
        for k in known:
            plain.append(plain_bytes(texts[k]))
            held.append(k)
            size += len(plain[-1])
            if size >= BLOCK * LANES or k == known[-1]:
                best, margin = parser.judge(plain)
                for j, b, m in zip(held, best, margin):
                    names[j], scores[j] = parser.langs[b], m
                held, plain, size = [], [], 0
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                names, scores = judge(part.column(place).to_pylist())
                found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], fields=list(answer))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    verdict = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, verdict)]))


def predict_languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; languages are learned from the rows not held out.

    ``held_out`` is a condition on ``doc_id``.
    """
    rows = pick(docs, "doc_id", "lang", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    refs = references(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"))
    found = identify(rows.select("doc_id", "held_out", "text"), refs)
    return found.select("doc_id", "held_out", "_language.lang_pred", "_language.score")
