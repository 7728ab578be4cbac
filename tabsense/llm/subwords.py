"""SentencePiece BPE with seeded merge dropout, and its decoder.

A text is cut into chunks that no vocabulary piece crosses (runs of word marks with the word after
them, and line feeds).  In each chunk an agenda of adjacent pairs whose union is a piece is worked off
by score, leftmost first.  Each candidate merge is skipped if a hash keyed by seed, document, the
chunk's ordinal and the merge's place falls below the dropout rate, so every occurrence has draws of its
own, but any part of it can be recomputed.

Two forms of the agenda give equal results: the chunks of a slice of texts stand side by side as columns
of an array and advance together, one merge a chunk and round; a chunk of more than ``LONG`` characters
has a heap of its own.

Decoding joins the pieces; characters outside the vocabulary are UTF-8 byte pieces, and so is a literal
U+2581, which SentencePiece itself would take for a space.  Every text is therefore restored.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null document id counts
as 0 in the key; repeated rows get equal ids; an empty table gives no rows; texts of any length are
encoded whole; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tabsense.llm.common import as_bytes, list_array, mix64

MARK = "▁"
DROPOUT = 0.1
#: Chunks longer than this have their own heap; bytes of text encoded, ids decoded and symbols advanced at a time.
LONG, SLICE_BYTES, SLICE_IDS, CELLS = 250, 1 << 19, 1 << 18, 1 << 16
#: Chunks remembered between slices: none, as the draws differ by occurrence.
STATE_CACHE = 0
_CHUNKS = re.compile(b" +[^ \n]*|[^ \n]+|\n")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_FIRST_POINT = 1 << 18  # symbols from here on are code points outside the vocabulary
_APART = _FIRST_POINT - 1  # stands for all of them, and for what lies outside a chunk, where only merges matter
_NONE = np.int32((1 << 31) - 1)


def _place_hash(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(key ^ (start.astype(np.uint64) * _K[0] + middle.astype(np.uint64) * _K[1]
                            + end.astype(np.uint64) * _K[2]))


class Merges:
    """The pairs of symbols that merge: ``(left << 20 | right, union)``, and the rank of each union.

    A hash table holds them, an entry being ``left << 36 | right << 18 | union``.
    """

    def __init__(self, pairs: list[tuple[int, int]], rank: np.ndarray) -> None:
        keys, unions = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.rank = np.minimum(rank, 1 << 22).astype(np.int32)
        self.bits = max((4 * len(pairs)).bit_length(), 4)
        self.table = np.full(1 << self.bits, -1, np.int64)
        key = keys >> 20 << 18 | keys & ((1 << 20) - 1)
        slot, left, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(left):  # each round the first of those that want a free slot gets it
            at = (slot[left] + self.probes) & (len(self.table) - 1)
            free = np.flatnonzero(self.table[at] == -1)
            taken, first = np.unique(at[free], return_index=True)
            self.table[taken] = key[left[free[first]]] << 18 | unions[left[free[first]]]
            left = np.delete(left, free[first])
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * _K[0]) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's union, or -1, for 64-bit symbols up to ``_APART``."""
        key = left << 18 | right
        slot = self._slot(key)
        entry = self.table[slot]
        out = np.where(entry >> 18 == key, entry & _APART, -1)
        away = np.flatnonzero((out < 0) & (entry >= 0))
        for k in range(1, self.probes):
            if not len(away):
                break
            entry = self.table[(slot[away] + k) & (len(self.table) - 1)]
            hit = entry >> 18 == key[away]
            out[away[hit]] = entry[hit] & _APART
            away = away[~hit & (entry >= 0)]
        return out

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's union, or -1."""
        return self.find(*(np.minimum(x, _APART).astype(np.int64) for x in (left, right)))


class Vocabulary(Merges):
    """Pieces, their scores and the pairs that merge, from a SentencePiece BPE model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        score = np.array([model.get_score(i) for i in range(n)])
        levels = np.unique(-score)
        super().__init__([(ids[p[:k]] << 20 | ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p))
                          if p[:k] in ids and p[k:] in ids], np.searchsorted(levels, -score))  # 0 is the best score
        self.symbol = np.arange(0x110000, dtype=np.int32) + _FIRST_POINT
        for p, i in ids.items():
            if len(p) == 1 and p != MARK:
                self.symbol[ord(p)] = i
        self.symbol[0x20] = ids[MARK]  # chunks hold spaces until here
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() if plain[i] else b""
                      for i, p in enumerate(pieces)]


def segment_one(vocab: Merges, symbols: np.ndarray, key: np.uint64, rate: np.uint64) -> np.ndarray:
    """The agenda of one chunk as a heap of candidate merges."""
    n = len(symbols)
    ids, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a < 0 or b >= n:
            return
        union = int(vocab.merged(np.array([ids[a]]), np.array([ids[b]]))[0])
        if union >= 0 and _place_hash(key, np.array([a]), np.array([b]), np.array([after[b]]))[0] >= rate:
            heapq.heappush(agenda, (int(vocab.rank[union]), a, b, after[b], union))

    for k in range(n - 1):
        offer(k, k + 1)
    while agenda:
        _, a, b, end, union = heapq.heappop(agenda)
        if ids[a] < 0 or ids[b] < 0 or after[a] != b or after[b] != end:
            continue  # one side has changed since
        ids[a], ids[b], after[a] = union, -1, end
        if end < n:
            before[end] = a
        offer(before[a], a)
        offer(a, end)
    return np.array([i for i in ids if i >= 0], np.int64)


def _advance(vocab: Merges, ids: np.ndarray, keys: np.ndarray, rate: np.uint64) -> None:
    """Works off the agendas of chunks, one a column of ``ids``; the last row and what lies below a chunk is ``_APART``.

    A union takes the place of its first symbol; the places that it swallows become -1.
    """
    width, n = ids.shape[0] - 1, ids.shape[1]
    flat, last = ids.reshape(-1), width * n
    here = np.arange(flat.size)
    after, before = np.minimum(here + n, last + here % n), here - n
    before[:n] += last + n  # nothing merges with the last row
    order, union = np.full(flat.size, _NONE, np.int32), np.zeros(flat.size, np.int64)
    rows = order.reshape(width + 1, n)

    def offer(a: np.ndarray, b: np.ndarray) -> None:
        """Candidates of symbols and those after them: priority and union."""
        both = vocab.find(flat[a], flat[b])
        order[a] = _NONE
        good = np.flatnonzero(both >= 0)
        a, b, both = a[good], b[good], both[good]
        row = a // n
        if rate:
            drawn = np.flatnonzero(_place_hash(keys[a - row * n], row, b // n, after[b] // n) >= rate)
            a, both, row = a[drawn], both[drawn], row[drawn]
        order[a] = vocab.rank[both] << 8 | row
        union[a] = both

    offer(here[:last], here[n:])
    while True:
        best = np.minimum.reduce(rows[:width], axis=0)
        column = np.flatnonzero(best < _NONE)
        if not len(column):
            return
        a = (best[column] & 255).astype(np.int64) * n + column
        b = after[a]
        end, left = after[b], before[a]
        flat[a], flat[b], order[b] = union[a], -1, _NONE
        after[a], before[end] = end, a
        offer(np.concatenate([a, left]), np.concatenate([end, a]))


def segment_many(vocab: Merges, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The agendas of many chunks at once; symbols in a row. Returns final symbols and their counts.

    At a rate of 0 the keys don't matter.  No chunk has more than ``LONG`` symbols.
    """
    lengths = np.asarray(lengths, np.int64)
    begins = np.cumsum(lengths) - lengths
    small = np.minimum(symbols, _APART).astype(np.int64)
    out = small.copy()
    by_length = np.argsort(lengths.astype(np.uint8), kind="stable")
    ordered = lengths[by_length]
    first = int(np.searchsorted(ordered, 2))
    while first < len(ordered):
        # columns of nearly equal length: none below nine tenths of the longest
        stop = int(np.searchsorted(ordered, ordered[first] * 10 // 9, side="right"))
        stop = min(stop, first + max(CELLS // int(ordered[stop - 1]), 1))
        own, width = by_length[first:stop], int(ordered[stop - 1])
        inside = np.arange(width + 1)[:, None] < lengths[own]
        at = np.where(inside, begins[own] + np.arange(width + 1)[:, None], 0)
        ids = np.where(inside, small[at], _APART)
        _advance(vocab, ids, keys[own] if rate else keys, rate)
        out[at[inside]] = ids[inside]
        first = stop
    kept = out >= 0
    out = np.where(out == _APART, symbols, out)[kept]
    upto = np.concatenate([[0], np.cumsum(kept)])
    return out, upto[begins + lengths] - upto[begins]


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, dropout: float, seed: int) -> None:
        self.vocab = Vocabulary(path)
        self.rate = np.uint64(min(int(dropout * 2.0 ** 64), 2 ** 64 - 1))
        self.seed = mix64(np.array([seed & (2 ** 64 - 1)], np.uint64))[0]

    def _symbols(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of chunks in a row, their numbers, and a fingerprint of each chunk."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begins = np.cumsum(lengths) - lengths
        with np.errstate(over="ignore"):
            weight = mix64(points.astype(np.uint64) * _K[0] + (np.arange(len(points)) - np.repeat(begins, lengths)).astype(np.uint64) * _K[1])
            prints = np.add.reduceat(weight, begins) if len(points) else np.zeros(0, np.uint64)
        return self.vocab.symbol[points], lengths, prints

    def _spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with characters outside the vocabulary as byte pieces."""
        apart = np.flatnonzero(ids >= _FIRST_POINT)
        if not len(apart):
            return ids.astype(np.int32), counts
        raw = [chr(i - _FIRST_POINT).encode() for i in ids[apart].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[apart] = np.fromiter(map(len, raw), np.int64, len(raw))
        bytewise = np.zeros(len(ids), bool)
        bytewise[apart] = True
        out = np.repeat(ids, sizes).astype(np.int32)
        out[np.repeat(bytewise, sizes)] = self.vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return out, upto[ends] - upto[ends - counts]

    def _segment(self, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by their own keys."""
        long = lengths > LONG
        inside = np.repeat(~long, lengths)
        ids, counts = segment_many(self.vocab, symbols[inside], lengths[~long], keys[~long], self.rate)
        if long.any():
            begins = np.cumsum(lengths) - lengths
            short = np.cumsum(~long) - ~long  # short chunks before each chunk
            upto = np.concatenate([[0], np.cumsum(counts)])
            parts, sizes, done = [], np.zeros(len(lengths), np.int64), 0
            sizes[~long] = counts
            for k in np.flatnonzero(long).tolist():
                far = segment_one(self.vocab, symbols[begins[k]:begins[k] + lengths[k]], keys[k], self.rate)
                parts += [ids[done:upto[short[k]]], far]
                sizes[k], done = len(far), upto[short[k]]
            ids, counts = np.concatenate([*parts, ids[done:]]), sizes
        return self._spelled(ids, counts)

    def encode(self, texts: list[bytes], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number for each text; ``documents`` are the keys of the texts."""
        marked = [" " + t.decode("utf-8", "replace") if t else "" for t in texts]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        # chunks as _CHUNKS cuts them: at line feeds and after them, and at the first of a run of spaces
        space, feed = points == 0x20, points == 0x0A
        starts = feed | (space & ~np.append(False, space[:-1])) | np.append(False, feed[:-1])
        begins = np.cumsum(sizes) - sizes
        starts[begins[sizes > 0]] = True
        upto = np.concatenate([[0], np.cumsum(starts)])
        first, n_chunks = upto[begins], upto[begins + sizes] - upto[begins]
        at = np.flatnonzero(starts)
        ordinal = np.arange(len(at)) - np.repeat(first, n_chunks)
        with np.errstate(over="ignore"):
            keys = mix64(np.repeat(mix64(documents.astype(np.int64).view(np.uint64) ^ self.seed), n_chunks)
                         + ordinal.astype(np.uint64) * _K[0])
        ids, counts = self._segment(self.vocab.symbol[points], np.diff(np.append(at, len(points))), keys)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[first + n_chunks] - upto[first]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, dropout: float, seed: int) -> Encoder:
    return Encoder(path, dropout, seed)


@functools.lru_cache(maxsize=2)
def _piece_bytes(path: str) -> list[bytes]:
    return Vocabulary(path).bytes


def encode(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = 0, doc_id: str = "doc_id",
           text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` and a column ``name``: the ids of the text under seeded merge dropout."""
    at_id, at_text = docs.columns.index(doc_id), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path, dropout, seed)
        for batch in batches:
            texts = as_bytes(batch.column(at_text))
            own = batch.column(at_id).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            first = size = 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= SLICE_BYTES or k + 1 == len(texts):
                    ids, n = encoder.encode(texts[first:k + 1], own[first:k + 1])
                    part = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, list_array(ids, n, pa.int32())],
                                                     [*batch.schema.names, name])
                    first, size = k + 1, 0

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` and a column ``name``: the text of its ids."""
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(_piece_bytes(model_path), pa.large_binary())
        for batch in batches:
            offsets, values, first = batch.column(at).offsets.to_numpy(), batch.column(at).values, 0
            while first < batch.num_rows:
                last = max(int(np.searchsorted(offsets, offsets[first] + SLICE_IDS, side="right")) - 1, first + 1)
                own = offsets[first:last + 1] - offsets[first]
                spelled = pieces.take(values.slice(offsets[first], own[-1]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(own), spelled), pa.scalar(b"", pa.large_binary()))
                texts = [x[1:] for x in joined.to_pylist()]  # without the mark before the first word
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                                 [*batch.schema.names, name])
                first = last

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = 0, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, lossless)`` of every document."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    both = decode(encode(chosen, model_path, dropout, seed), model_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("text") == F.col("decoded")).alias("lossless"))
