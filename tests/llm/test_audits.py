"""Language identification, filter interactions and source divergence against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as E
from tabsense.llm import filter_audit, language_id, term_divergence
from tests.conftest import SF_SMALL

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


def _rows():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 14))) for _ in range(60)]
    rows = []
    for k in range(150):
        words = rng.choice(vocabulary, int(rng.integers(0, 90)))
        text = " ".join(w.upper() if rng.random() < 0.05 else w for w in words) + ("" if k % 5 else " $ 12")
        rows.append((k, text, ["x", "y", None][k % 3], ["s1", "s2", "s3", None][int(rng.integers(4))]))
    rows += [(200 + k, rows[7][1], "x", "s1") for k in range(60)]  # copies
    rows += [(7, rows[7][1], "x", "s1")] * 4  # repeated rows
    rows += [(None, rows[8][1], "x", "s2"), (None, rows[8][1], "x", "s2"), (None, None, None, None), (400, None, "x", "s1"),
             (401, "", "z", "only"), (402, "12 34", "z", "more"), (403, " \t\n", "y", "s2"), (404, "long" * 3000 + " " + "ab " * 4000, "x", "s9")]
    rows += [(500 + k, "Q" * 700 + f" pre{'e' * k} ÉÉ日本", "y", "s2") for k in range(14)]  # one long term in 14 documents
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for name in ("part", "mask", "n", "good", "toxic", "digest", "key", "term", "value", "item", "Text", "LANG", "held_out", "score", "word"):
        df = df.withColumn(f"_{name}", F.lit("clash")).withColumnRenamed(f"_{name}", name)
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ----------------------------------------------------------------------------- language identification

def test_automaton_knows_exactly_the_substrings():
    text = b"abcabxabcdabcabxbbaacab"
    moves = language_id.suffix_automaton(text)
    parts = {text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
    found, todo = set(), [(0, b"")]
    while todo:
        state, word = todo.pop()
        for symbol, target in moves[state].items():
            found.add(word + bytes([symbol]))
            todo.append((target, word + bytes([symbol])))
    assert found == parts
    assert len(moves) <= 2 * len(text)


def _phrases(text: bytes, ref: bytes) -> int:
    n = 0
    for a in range(0, len(text), language_id.BLOCK):
        block, at = text[a:a + language_id.BLOCK], 0
        while at < len(block):
            size = 1
            while at + size < len(block) and block[at:at + size + 1] in ref:
                size += 1
            at += size
            n += 1
    return n


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 64)
    monkeypatch.setattr(language_id, "LANES", 7)
    rng = np.random.default_rng(3)
    refs = {"a": bytes(rng.choice(list(b"abc "), 300).tolist()), "b": bytes(rng.choice(list(b"abd "), 90).tolist())}
    texts = [bytes(rng.choice(list(b"abcdz "), int(n)).tolist()) for n in rng.integers(1, 400, 25)] + [b"a", b"zzz"]
    got = language_id.Parser(refs).phrases(texts)
    assert got.tolist() == [[_phrases(t, r) for r in refs.values()] for t in texts]


def test_languages_of_planted_texts(spark, none):
    rng = np.random.default_rng(9)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(300)]
             for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklabéü"))}
    rows = [(k, " ".join(rng.choice(words[lang], 60)), lang, None)
            for k in range(240) for lang in [("aa", "bb", "cc")[k % 3]]]
    rows += [(1000, None, "aa", None), (1001, "12 !? 34", "bb", None), (1002, "", "cc", None), (None, rows[0][1], "aa", None),
             (1003, rows[1][1] * 400, None, None), (1004, "日本語", None, None), (0, *rows[0][1:]), (1005, "#1", "dd", None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4).select("*", F.lit(0).alias("score"), F.lit("clash").alias("TEXT"))
    got = language_id.predict_languages(df, F.col("doc_id") % 4 == 0).collect()
    assert len(got) == len(rows)
    true = {r[0]: r[2] for r in rows}
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0.0 <= r.score <= 1.0 and r.held_out == (r.doc_id is not None and r.doc_id % 4 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 50 and all(r.lang_pred == true[r.doc_id] for r in held)
    assert {by_id[k][0].lang_pred for k in (1000, 1001, 1002, 1005)} == {"und"}
    assert by_id[1003][0].lang_pred == "bb"
    assert by_id[1004][0].lang_pred in words and len(by_id[0]) == 2
    assert language_id.predict_languages(none, F.col("doc_id") % 4 == 0).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None, None)], DOCS)
    assert [r.lang_pred for r in language_id.predict_languages(unlabelled, F.col("doc_id") % 4 == 0).collect()] == ["und"]
    with pytest.raises(ValueError):
        language_id.identify(df.withColumn("_language", F.lit(1)), {"a": b" ab"})


def test_reference_is_bounded_and_ignores_copies(spark):
    rows = [(k, "copy of one text", "en", None) for k in range(500)] + [(600 + k, f"text number {'x' * k}" * 60, "en", None) for k in range(200)]
    refs = language_id.references(spark.createDataFrame(rows, DOCS).repartition(6).select("lang", "text"))
    assert refs["en"].count(b"copy of one text") <= 1
    assert len(refs["en"]) <= language_id.SLOTS * (language_id.PIECE + 1) + 1


def test_held_out_accuracy(spark):
    got = E.queries()["op11_language_id"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out").collect()
    assert len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


# ----------------------------------------------------------------------------- filter interactions

def _fails(rows):
    least = {}
    for doc_id, text, _, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        out.append((source or "", doc_id, {f for f, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)), doc_id is not None and text in least and doc_id > least[text])) if bad}))
    return out


def test_filter_interactions(spark, docs, none, rows):
    labels = [(k, int(k % 2 == 0), int(k % 7 == 0)) for k in range(0, 260, 3)] + [(3, 0, 1), (None, 1, 1), (6, None, None)]
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    marks = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(docs, marks).collect()}
    fails = _fails(rows)
    parts = {p for p, _, _ in fails}
    assert len(got) == 600 * len(parts)
    shapley = Counter()
    want = {}
    for part in parts:
        mine = [(d, f) for p, d, f in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                want[part, order, step] = (
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
    for k, w in want.items():
        r = got[k]
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == w
        assert r.shapley == shapley[k[0], k[1][k[2] - 1]]
    assert filter_audit.interactions(none, marks).collect() == []
    assert len(filter_audit.interactions(docs, marks.limit(0)).collect()) == len(got)


def test_gray_walk_is_every_subset():
    counts = np.random.default_rng(1).integers(0, 50, (3, 32))
    states = filter_audit.gray_walk(counts)
    for subset in range(32):
        assert states[:, subset].tolist() == [sum(c[m] for m in range(32) if not m & subset) for c in counts]


# ----------------------------------------------------------------------------- source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _divergence(rows, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    in_docs, used, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        found = TERM.findall((text or "").translate(lower))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        in_docs.update({(lang, t) for t in found})
        used[lang, source].update(found)
    out = set()
    for lang, source in groups:
        kept = sorted(t for (l, t), n in in_docs.items() if l == lang and n >= least)
        sources = sorted(s for l, s in groups if l == lang)

        def share(names):
            n = Counter()
            for s in names:
                n.update({t: c for t, c in used[lang, s].items() if t in set(kept)})
            size = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 2) // (size + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        n, p = share([source])
        pairs = [(s, sum(f(p[t], q) for t, q in share([s])[1].items())) for s in sources if s != source]
        q = share(sources)[1]
        terms = [(t, f(p[t], q[t])) for t in kept if n[t] and p[t] > q[t]]
        for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top], 1):
                out.add((lang, source, part, item, value, rank))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(docs, none, rows, monkeypatch, small):
    if small:  # many levels, filters that pass wrongly, many blocks, counters that are full all the time
        for name, value in (("FIRST_LEVEL", 1), ("TASK_TERMS", 5), ("TASK_BYTES", 900), ("BLOCK_COUNTS", 4), ("BLOCK_CELLS", 8), ("LONG_TEXT", 100)):
            monkeypatch.setattr(term_divergence, name, value)
        monkeypatch.setattr(term_divergence, "BLOOM_BITS", 64)
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in term_divergence.divergence(docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _divergence(rows, 10)
    assert any(r[2] == "pair" and r[4] == 0 and r[0] == "z" for r in got)  # a language without kept terms
    if not small:
        assert term_divergence.divergence(none).collect() == []


def test_prefixes_are_discarded(spark, docs, rows):
    kept = {(r.lang, bytes(r.key).decode()): r.n for r in term_divergence.kept_terms(term_divergence._plain(docs), 12).collect()}
    want = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, _ in rows:
        want.update({(lang or "", t) for t in TERM.findall((text or "").translate(lower))})
    assert kept == {k: n for k, n in want.items() if n >= 12}
    # a later level passes nothing below a prefix that was discarded
    keys = spark.createDataFrame([("x", b"abcdef*")], "lang string, key binary")
    known = term_divergence._Known("x", 6, 12, term_divergence.bloom_filter(keys, 1))
    assert known[b"abcdefgh"] == b"abcdefgh" and known[b"abcdefghijklmn"] == b"abcdefghijkl*"
    assert known[b"abcdef"] is None and known[b"zbcdefgh"] is None


def test_shares_are_exact():
    count = np.array([0, 5, 10**12, 4 * 10**15, 7], np.int64)
    for size in ([10**9, 11, 3 * 10**12, 5 * 10**15, 9], [10**9, 11, 3 * 10**12, 1 << 60, 9]):
        got = term_divergence._shares(count, np.array(size, np.int64))
        assert got.tolist() == [1 + 10**9 * (int(c) + 2) // s for c, s in zip(count, size)]


def test_levels_number_only_what_they_count(monkeypatch):
    texts = [b"Abcdef abcdefg, abcdefGH!", b"", "\xe4".encode() * 4 + b"@xyz " + b"q" * 40, b"abcdefgh1abcdefgh"]
    lower = bytes(b + 32 if 0x41 <= b < 0x5B else b for b in range(256))
    for above, width in ((0, None), (0, 7), (6, 13), (12, 25), (24, 49), (40, 99)):
        code, owner, terms = term_divergence.number_terms(texts, above, width)
        want = [(k, t[:width]) for k, text in enumerate(texts)
                for t in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower)) if len(t) > above]
        assert list(zip(owner.tolist(), [terms[c].as_py() for c in code.tolist()])) == want
        assert len(terms) == len({t for _, t in want})
    # the filter is asked once for a prefix, however many terms begin with it
    asked, places = [], term_divergence._places
    monkeypatch.setattr(term_divergence, "_places", lambda seeds, keys, last: asked.extend(keys.to_pylist()) or places(seeds, keys, last))
    terms = [b"abcdef" + bytes([97 + k]) for k in range(20)]
    number, keys = term_divergence._Texts(6, 12, b"\xff" * 8192)._keys("x", pa.array([*terms, b"abc"], pa.binary()))
    assert number.tolist() == [*range(20), -1] and keys.to_pylist() == terms
    assert sorted(asked) == [b"abc", b"abcdef*"]
