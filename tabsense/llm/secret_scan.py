"""Secret scans over a trigram inverted index, on DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that every match must contain
(case folded).  The postings of those trigrams, and of no others, are drawn from all documents; a
document's postings are intersected against each rule's query, and only the surviving (document, rule)
pairs are verified with the expression itself.  Rules without a mandatory trigram scan every document.

Scale: the postings of a document are at most as many as the queries' trigrams (a few dozen), they meet
by document, and texts are joined to their candidates by document; no list of documents is built.

Defined cases: a null or empty text has no spans; rows with equal id and text get equal spans; a null
id is an id; an empty table gives no rows; positions count code points of the whole text, however
long and however many its spans (the work grows linearly with both); other columns pass through
untouched, also those whose names differ from ``doc_id`` or ``text`` in case alone.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from tabsense.llm.common import pick


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the group whose length must reach ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


_WORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"),
)
#: Alternatives that are spelled out before a query gives up on a part.
MAX_STRINGS = 64

#: A query: every clause must hold; a clause holds if all trigrams of one of its alternatives occur.
Query = list[list[frozenset[str]]]


def _clause(strings: set[str]) -> Query:
    """The clause that one of these strings occurs; empty if one is too short to demand a trigram."""
    if any(len(s) < 3 for s in strings):
        return []
    wanted = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return [sorted((w for w in wanted if not any(o < w for o in wanted)), key=sorted)]


def _spelled(op, value) -> set[str] | None:
    """All (lower-cased) strings that a part of an expression matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                found.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MAX_STRINGS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _spelled_row(value[3])
    if op is sre.BRANCH:
        rows = [_spelled_row(row) for row in value[1]]
        return None if any(r is None for r in rows) else set().union(*rows)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 3:
        one = _spelled_row(value[2])
        if one is not None:
            return {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
    return None


def _spelled_row(row) -> set[str] | None:
    strings = {""}
    for op, value in row:
        own = _spelled(op, value)
        if own is None or len(own) * len(strings) > MAX_STRINGS:
            return None
        strings = {a + b for a in strings for b in own}
    return strings


def trigram_query(pattern: str) -> Query:
    """The clauses that a text with a match of ``pattern`` must meet; none: no mandatory trigram."""
    def of_row(row) -> Query:
        clauses: Query = []
        strings = {""}
        for op, value in row:
            own = _spelled(op, value)
            if own is not None and len(own) * len(strings) <= MAX_STRINGS:
                strings = {a + b for a in strings for b in own}
                continue
            clauses += _clause(strings)
            strings = {""}
            if own is not None:
                strings = own
            elif op is sre.SUBPATTERN:
                clauses += of_row(value[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                clauses += of_row(value[2])
        return clauses + _clause(strings)

    return of_row(re._parser.parse(pattern))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def postings(docs: DataFrame, trigrams: list[str], doc_id: str, text: str) -> DataFrame:
    """``(trigram, doc_id, text_hash)``: the inverted index of the given trigrams, case folded."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    found = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    whole = pick(docs, doc_id, text).toDF("doc_id", "text").withColumn("text", _text(F.col("text")))
    held = whole.select("doc_id", F.xxhash64("text").alias("text_hash"), found.alias("trigrams"))
    return held.select(F.explode("trigrams").alias("trigram"), "doc_id", "text_hash")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``(doc_id, text_hash, kinds)``: the rules whose trigram query a document's postings meet."""
    def holds(query: Query) -> Column:
        every = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for alternative in clause:
                missing = F.array_except(F.array(*[F.lit(t) for t in sorted(alternative)]), F.col("have"))
                some = some | (F.size(missing) == 0)
            every = every & some
        return every

    met = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("have"))
    kinds = F.filter(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]), lambda k: k.isNotNull())
    return met.select("doc_id", "text_hash", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN_TYPE = "array<struct<start:bigint,ord:int,end:bigint,kind:string,from_byte:bigint,to_byte:bigint,size:int>>"
#: Running values are formed in pieces of this many elements, and over the pieces: an array grows by copying.
PIECE = 256


def _running(values: str, start: str, merge: str) -> str:
    """SQL for the value before each element of the array ``values``, from ``start`` on by ``merge(a, x)``."""
    def scan(array: str, first: str, step: str) -> str:
        return (f"aggregate({array}, named_struct('a', {first}, 'out', slice(array({first}), 1, 0)), (z, x) -> "
                f"named_struct('a', {step}, 'out', concat(z.out, array(z.a))), z -> z.out)")

    one, whole = merge.replace("@a", "z.a").replace("@x", "x"), merge.replace("@a", "a").replace("@x", "x")
    pieces = (f"transform(sequence(0, cast(size({values}) div {PIECE} as int)), "
              f"k -> slice({values}, k * {PIECE} + 1, {PIECE}))")
    return (f"transform(array({pieces}), p -> flatten(zip_with(p, {scan(f'transform(p, c -> aggregate(c, {start}, (a, x) -> {whole}))', start, one)}, "
            f"(c, base) -> {scan('c', 'base', one)})))[0]")


def _spans(text: str, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches of a rule as ``(start, ord, end, kind, from_byte, to_byte, size)``.

    The pieces between matches and the matches themselves alternate, so their lengths give positions,
    in code points and in bytes.  The lambdas over lists of one bind arrays that are worked out once.
    """
    p = _quoted(rule.pattern)
    cut = (f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), "
           f"regexp_extract_all({text}, {p}, {rule.group}))")

    def before(length: str) -> str:
        lengths = f"transform(cut, y -> cast({length}(y.`0`) + coalesce({length}(y.`1`), 0) AS bigint))"
        return f"transform(array({lengths}), v -> {_running('v', '0L', '@a + @x')})[0]"

    return F.expr(f"""
        transform(array({cut}), cut -> filter(zip_with(cut, arrays_zip({before('char_length')}, {before('octet_length')}),
            (m, at) -> if(m.`1` IS NULL, NULL, named_struct(
                'start', at.`0` + char_length(m.`0`), 'ord', {order}, 'end', at.`0` + char_length(m.`0`) + char_length(m.`1`),
                'kind', '{rule.kind}', 'from_byte', at.`1` + octet_length(m.`0`),
                'to_byte', at.`1` + octet_length(m.`0`) + octet_length(m.`1`), 'size', char_length(m.`2`)))),
            s -> s.size >= {rule.least}))[0]""")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text",
                 name: str = "_spans") -> DataFrame:
    """``docs`` and a column ``name``: all spans as structs ``start, ord, end, kind, from_byte, to_byte``, in order.

    ``ord`` is the rule's place in ``rules``, ``end`` and ``to_byte`` are exclusive; bytes are those of UTF-8.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for alternative in clause for t in alternative})
    apart = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    own_id = F.col(f"_{docs.columns.index(doc_id)}")
    whole = apart.withColumn("t", _text(F.col(f"_{docs.columns.index(text)}")))
    if queries:
        met = candidates(postings(docs, trigrams, doc_id, text), queries)
        whole = whole.join(met, own_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64("t") == F.col("text_hash")), "left")
    parts = []
    for order, rule in enumerate(rules):
        holds = F.expr(f"t rlike {_quoted(rule.pattern)}")
        if rule.kind in queries:
            holds = F.coalesce(F.array_contains(F.col("kinds"), rule.kind), F.lit(False)) & holds
        parts.append(F.when(holds, _spans("t", rule, order)).otherwise(F.expr(f"cast(array() AS {_SPAN_TYPE})")))
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(*[s[c].alias(c) for c in _FIELDS]))
    return whole.select(*apart.columns, spans.alias(name)).toDF(*docs.columns, name)


_FIELDS = ("start", "ord", "end", "kind", "from_byte", "to_byte")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``.

    Pieces are cut by byte, which doesn't count through the text before them.
    """
    ends = f"transform(`{spans}`, s -> s.to_byte)"
    reach = f"transform(array({ends}), e -> {_running('e', '0L', 'greatest(@a, @x)')})[0]"
    return F.expr(f"""
        transform(array(struct(cast(`{text}` AS binary) AS b, {reach} AS r)), v ->
            array_join(concat(
                filter(zip_with(`{spans}`, v.r, (x, r) -> if(x.from_byte < r, NULL,
                    cast(substring(v.b, cast(r + 1 AS int), cast(x.from_byte - r AS int)) AS string))), y -> y IS NOT NULL),
                array(cast(substring(v.b, cast(coalesce(array_max({ends}), 0L) + 1 AS int)) AS string))),
                '{mark}'))[0]""")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the registered query: every rule scans every text."""
    scans = []
    for order, r in enumerate(rules):
        p = "'" + r.pattern.replace("'", "''") + "'"
        scans.append(f"SELECT rid, '{r.kind}' AS kind, {order} AS ord, {r.least} AS least, regexp_extract_all(t, {p}) AS hits, "
                     f"regexp_extract_all(t, {p}, {r.group}) AS parts, regexp_split_to_array(t, {p}) AS gaps FROM d "
                     f"WHERE regexp_matches(t, {p})")
    n_base = sum(r.base for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
scans AS ({' UNION ALL '.join(scans)}),
hits AS (SELECT rid, kind, ord, least, gaps, hits, unnest(hits) AS hit, unnest(parts) AS part,
                generate_subscripts(hits, 1) AS i FROM scans),
placed AS (SELECT rid, kind, ord, length(hit) AS size,
                  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS BIGINT)
                  + CAST(coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b
           FROM hits WHERE length(part) >= least),
per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, ord) FILTER (ord < {n_base}) AS base,
               string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, ord) AS spans
        FROM placed GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON d.rid = per.rid"""
