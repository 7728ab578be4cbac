"""Packing along a space-filling curve.

Every document is encoded once, its hashed bag of tokens is projected to a few dimensions, and the
point's place on a Hilbert curve becomes its sort key.  Documents are dealt into key ranges, sorted
inside each range and laid end to end; sequences are cut from that stream every ``capacity`` ids, so
neighbours on the curve share sequences and only the very last sequence can need padding.

Scale: ids travel once, as two bytes each where the vocabulary allows it.  Range bounds are quantiles
of the key, whose low bits hash the document id, so a large group of equal documents is cut into many
ranges.  The driver holds one bound and one token total per range (the number of ranges is
``spark.sql.shuffle.partitions``).

Defined cases: a null or empty text is one end id; a null document id is kept; repeated rows are
packed as often as they occur; an empty table gives no pieces; a text of any length is encoded whole
and cut wherever a sequence ends; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsense.llm.common import WordIndex, as_bytes, mix64, n_tasks, resident, spill
from tabsense.llm.subwords import Merges, segment_many

DIMENSIONS, BITS, TIE_BITS = 4, 10, 23
#: Bytes of text encoded at a time, and words remembered by a worker.
SLICE_BYTES, WORD_CACHE = 1 << 20, 400_000
#: Seed of the random projection of token ids.
PROJECTION_SEED = 20_240_601
_END = b" "  # no word holds a blank
#: Letters and punctuation by code point: words of up to 60 letters, then up to 60 punctuation marks are cut into
#: at most two parts by the tokenizer's pattern, whatever its normalization does.
_PART = 60
_POINTS = np.arange(0x130)
_LETTER = np.array([chr(c).isalpha() and (c < 128 or 0xC0 <= c) for c in _POINTS])
_PUNCT = np.array([33 <= c < 127 and not chr(c).isalnum() and c != 39 for c in _POINTS])
_LOWER = np.array([ord(chr(c).lower()) if _LETTER[c] else c for c in _POINTS], np.int64)


class WordEncoder:
    """Ids of whole texts from a bounded memory of words.

    The tokenizer never joins anything across ASCII white space, so a text's ids are its words' ids in
    a row.  New words are encoded together; when the memory is full, the half used most stays.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        rng = np.random.default_rng(PROJECTION_SEED)
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.directions = rng.standard_normal((self.size, DIMENSIONS)).astype(np.float32)
        self._read_merges(path)
        self.index = WordIndex([_END])
        self.starts, self.lengths, self.used = np.zeros(1, np.int64), np.ones(1, np.int64), np.ones(1, np.int64)
        self.pool = np.array([end_id], np.uint32)
        self.vectors = self.directions[[end_id]]

    def _read_merges(self, path: str) -> None:
        """The merges, and each byte's symbol inside a part and at its end, from the tokenizer's file."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rank = np.full(self.size, 1 << 30, np.int64)
        rank[[vocab[a + b] for a, b in pairs]] = np.arange(len(pairs))
        self.merges = Merges([(vocab[a] << 20 | vocab[b], vocab[a + b]) for a, b in pairs], rank)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        suffix = model["end_of_word_suffix"]
        self.inside = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has.

        Plain words (Latin letters, then ASCII punctuation) are merged together in arrays, by the
        tokenizer's own merges; the tokenizer takes all others.
        """
        joined = b"".join([w + _END for w in words]).decode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.flatnonzero(points == _END[0])
        begins = np.append(0, ends[:-1] + 1)
        known = np.minimum(points, len(_POINTS) - 1)
        low = points < len(_POINTS)
        letter, punct = _LETTER[known] & low, _PUNCT[known] & low
        n_letters, n_punct = (np.add.reduceat(k.astype(np.int64), begins) for k in (letter, punct))
        turns = np.append(False, punct[:-1]) & letter  # a letter after a mark
        plain = ((n_letters + n_punct == ends - begins) & (n_letters <= _PART) & (n_punct <= _PART)
                 & ~np.logical_or.reduceat(turns, begins))
        # bytes of the plain words, and the last of each part
        own = np.repeat(plain, ends - begins + 1)
        own[ends] = False
        chosen = _LOWER[points[own]]
        wide = chosen >= 128
        letters = np.repeat(chosen, 1 + wide)
        second = np.cumsum(1 + wide)[wide] - 1
        letters[second - 1], letters[second] = 0xC0 | chosen[wide] >> 6, 0x80 | chosen[wide] & 63
        symbols = self.inside[letters]
        bytes_of_letters = np.bincount(np.repeat(np.arange(len(words)), ends - begins + 1)[own],
                                       np.where(punct[own], 0, 1 + wide), len(words)).astype(np.int64)[plain]
        sizes = np.column_stack([bytes_of_letters, n_punct[plain]]).ravel()
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.final[letters[last]]
        ids, counts = segment_many(self.merges, symbols, sizes[sizes > 0], np.zeros(1, np.uint64), np.uint64(0))
        per_part = np.zeros(len(sizes), np.int64)
        per_part[sizes > 0] = counts
        others = [joined[a:b] for a, b in zip(begins[~plain].tolist(), ends[~plain].tolist())]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.zeros(len(words), np.int64)
        lengths[plain] = per_part.reshape(-1, 2).sum(axis=1)
        lengths[~plain] = np.fromiter(map(len, rest), np.int64, len(rest))
        out = np.empty(int(lengths.sum()), np.uint32)
        of_plain = np.repeat(plain, lengths)
        out[of_plain] = ids
        out[~of_plain] = [i for x in rest for i in x]
        return out, lengths

    def learn(self) -> None:
        words, self.index.fresh = self.index.fresh, []
        ids, lengths = self._encode_words(words)
        ends = np.cumsum(lengths)
        sums = np.zeros((len(words), DIMENSIONS), np.float32)
        some = lengths > 0
        if some.any():
            sums[some] = np.add.reduceat(self.directions[ids], (ends - lengths)[some], axis=0)
        self.starts = np.concatenate([self.starts, len(self.pool) + ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.pool = np.concatenate([self.pool, ids])
        self.vectors = np.concatenate([self.vectors, sums])

    def shrink(self) -> None:
        self.used[0] = self.used.max() + 1
        keep = np.sort(np.argsort(-self.used, kind="stable")[:WORD_CACHE // 2])
        words = list(self.index)
        self.index = WordIndex([words[k] for k in keep])
        lengths = self.lengths[keep]
        first = np.cumsum(lengths) - lengths
        self.pool = self.pool[np.repeat(self.starts[keep] - first, lengths) + np.arange(lengths.sum())]
        self.starts, self.lengths, self.used, self.vectors = first, lengths, self.used[keep] // 2, self.vectors[keep]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by the end id; each text's number and direction sum."""
        if len(self.index) > WORD_CACHE:
            self.shrink()
        words: list[bytes] = []
        n_words = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = t.split()
            words += own
            words.append(_END)
            n_words[k] = len(own) + 1
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            self.learn()
        self.used += np.bincount(at, minlength=len(self.used))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        spread = np.repeat(self.starts[at] - (ends - lengths), lengths)
        ids = self.pool[spread + np.arange(len(spread))]
        last = np.cumsum(n_words)
        sums = np.add.reduceat(self.vectors[at], last - n_words, axis=0)
        return ids, np.diff(ends[last - 1], prepend=0), sums


def _encoder(path: str, end_id: int) -> WordEncoder:
    return resident(("word encoder", path, end_id), lambda: WordEncoder(path, end_id))


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one row each, with ``bits`` bits a coordinate."""
    x = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    zero = np.uint64(0)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for k in range(len(x)):
            flip = (x[k] & bit) != zero
            swap = np.where(flip, zero, (x[0] ^ x[k]) & low)
            x[k] = x[k] ^ swap
            x[0] = x[0] ^ np.where(flip, low, swap if k else zero)
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << b)) != zero, np.uint64((1 << b) - 1), zero)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << np.uint64(1)) | (((c ^ turn) >> np.uint64(b)) & np.uint64(1))
    return key


def _curve_keys(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    top = (1 << BITS) - 1
    return hilbert_index(np.clip(np.rint((unit + 1) / 2 * top), 0, top).astype(np.uint64), BITS)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encoded_on_curve(docs: DataFrame, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, curve_key)``: each document's ids, little-endian, and its sort key.

    ``ids`` has two bytes an id where the vocabulary fits, else four (``width``).
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, end_id)
        kind = np.dtype("<u2") if encoder.size <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in _slices(texts):
                ids, n, vectors = encoder.encode(texts[a:b])
                ends = np.cumsum(n)
                packed = ids.astype(kind)
                name = batch.column(0).slice(a, b - a)
                tie = mix64(name.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                key = (_curve_keys(vectors) << np.uint64(TIE_BITS)) | (tie >> np.uint64(64 - TIE_BITS))
                yield pa.RecordBatch.from_arrays(
                    [name, pa.array(n, pa.int64()),
                     pa.array([packed[e - m:e].tobytes() for e, m in zip(ends, n)], pa.binary()),
                     pa.array(np.full(b - a, kind.itemsize), pa.int32()), pa.array(key.astype(np.int64), pa.int64())],
                    ["doc_id", "n_tokens", "ids", "width", "curve_key"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, width int, curve_key long")


def _lay(base: list[int], capacity: int):
    """Pieces of the documents of one range, which arrive in curve order."""
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            n = batch.column(2).to_numpy()
            begin = np.empty(len(n), np.int64)
            for r in np.unique(part):  # one range a task, as they are dealt by id
                own = part == r
                first = place.get(int(r), base[int(r)])
                begin[own] = first + np.cumsum(n[own]) - n[own]
                place[int(r)] = first + int(n[own].sum())
            cuts = (begin + n - 1) // capacity - begin // capacity + 1
            row = np.repeat(np.arange(len(n)), cuts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            sequence = begin[row] // capacity + nth
            left = np.maximum(begin[row], sequence * capacity)
            right = np.minimum(begin[row] + n[row], (sequence + 1) * capacity)
            start = left - begin[row]
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4")
                   for x, w in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(row)), pa.array(start), pa.array(right - left), pa.array(n[row]),
                 pa.array(sequence), pa.array(left - sequence * capacity),
                 pa.array([ids[k][s:s + m].tobytes() for k, s, m in zip(row, start, right - left)], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return lay


def pack_on_curve(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.  Piece after piece fills each
    sequence without a gap; ``start`` counts the document's ids before the piece.
    """
    spark = docs.sparkSession
    encoded = spill(encoded_on_curve(docs, tokenizer_path, end_id, doc_id, text), "packing-ids")
    n = n_tasks(spark)
    bounds = encoded.agg(F.percentile_approx("curve_key", [k / n for k in range(1, n)] or [0.5],
                                             F.lit(max(10_000, 20 * n))).alias("b")).head()["b"] or []
    edges = np.array(sorted(set(bounds)) if n > 1 else [], np.int64)

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    ranged = encoded.select(range_of("curve_key").alias("part"), "doc_id", "n_tokens", "ids", "width", "curve_key")
    totals = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, running = [], 0
    for part in range(len(edges) + 1):
        base.append(running)
        running += totals.get(part, 0)
    dealt = ranged.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions("part", "curve_key", "doc_id", "ids")
    return dealt.mapInArrow(_lay(base, capacity), "doc_id long, start long, length long, doc_tokens long, "
                                                  "sequence_id long, offset long, ids binary")
