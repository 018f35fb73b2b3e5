"""Secret scans with a trigram index, in DataFrame functions only.

From each rule's regular expression follows which trigrams a matching text must hold: a list of clauses, all of
which must be met, each a list of alternatives, each a set of trigrams. The postings of these trigrams (lists of
document keys, cut into blocks of documents so that no list grows with the corpus) are intersected and united as the
clauses say. Only the candidates are then verified with the expression itself; a rule without a mandatory
trigram scans every text. Trigrams are those of the lower-cased text, so the query holds for either case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from purser.llm.common import id_and_text

BLOCK_DOCS = 512
#: A character class or repeat with more strings than this has none that are mandatory.
MAX_STRINGS = 64
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters. The pattern means the same in Python and Java."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed values. A run of a class is maximal, so 'at least n of it' may stand in the pattern where nothing precedes it.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

Clauses = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Clauses:
    """Clauses of alternatives of trigrams, lower-cased; no clause means that any text may match."""
    clauses: Clauses = []

    def close(strings: set[str]) -> None:
        alternatives = [frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings]
        if alternatives and all(alternatives):
            # What needs more trigrams than another alternative adds nothing to it.
            clauses.append(sorted((a for a in set(alternatives) if not any(b < a for b in alternatives)), key=sorted))

    def strings_of(items) -> set[str] | None:
        """All strings that the items can match, or None if they are too many to list."""
        found = {""}
        for item in items:
            own = one(item)
            if own is None or len(own) * len(found) > MAX_STRINGS:
                return None
            found = {a + b for a in found for b in own}
        return found

    def one(item) -> set[str] | None:
        name, value = str(item[0]), item[1]
        if name == "LITERAL":
            return {chr(value)}
        if name == "IN" and all(str(x[0]) == "LITERAL" for x in value):
            return {chr(x[1]) for x in value}
        if name == "SUBPATTERN":
            return strings_of(value[3])
        if name == "BRANCH":
            ways = [strings_of(way) for way in value[1]]
            return None if None in ways else set().union(*ways)
        if name == "MAX_REPEAT":
            low, high, inner = value
            own = strings_of(inner) if high <= 4 else None
            if own is None:
                return None
            powers = [{""}]
            for _ in range(int(high)):
                powers.append({a + b for a in powers[-1] for b in own})
                if len(powers[-1]) > MAX_STRINGS:
                    return None
            return set().union(*powers[low:])
        return None

    def walk(items) -> None:
        run = {""}
        for item in items:
            own = one(item)
            if own is not None and len(run) * len(own) <= MAX_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = own or {""}
            if own is None and str(item[0]) == "SUBPATTERN":
                walk(item[1][3])
        close(run)

    walk(re._parser.parse(pattern))
    return clauses


def _candidates(keyed: DataFrame, queries: dict[str, Clauses], block_docs: int) -> DataFrame:
    """(key, one boolean for each indexed rule) of the documents whose trigrams meet the rule's clauses."""
    trigrams = sorted({t for clauses in queries.values() for ways in clauses for way in ways for t in way})
    blocks = 1 + keyed.count() // block_docs
    low = F.lower("text")
    present = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t))
    postings = (
        keyed.select("key", F.explode(present).alias("trigram"))
        .groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))
        .groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    )
    none = F.array().cast("array<bigint>")

    def way(trigrams_of_way) -> Column:
        lists = [F.coalesce(F.element_at("lists", F.lit(t)), none) for t in sorted(trigrams_of_way)]
        return reduce(F.array_intersect, lists)

    def met(clauses: Clauses) -> Column:
        return reduce(F.array_intersect, [reduce(F.array_union, map(way, ways)) for ways in clauses])

    def named(kind: str) -> Column:
        return F.transform(met(queries[kind]), lambda key: F.struct(key.alias("key"), F.lit(kind).alias("kind")))

    found = F.flatten(F.array(*map(named, queries)))
    pairs = postings.select(F.explode(found).alias("pair")).select("pair.*")
    return pairs.groupBy("key").agg(*[F.max(F.col("kind") == kind).alias(f"may_{kind}") for kind in queries])


def _matches(rule: Rule, rank: int, may: Column) -> Column:
    """The rule's spans in a text, as an array of (start, rank, end) in code points."""
    pattern = F.lit(rule.pattern)
    empty = F.array().cast("array<struct<start: int, rank: int, end: int>>")
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    tested = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    # What lies before each match, and after the last: with the matches' lengths these give the places.
    between = F.split("text", rule.pattern, -1)
    parts = F.arrays_zip(F.transform(whole, F.length).alias("size"), F.transform(tested, F.length).alias("tested"),
                         F.transform(F.slice(between, 1, F.size(whole)), F.length).alias("before"))

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + part["before"]
        end = start + part["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        kept = F.when(part["tested"] >= rule.least, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda seen: seen["spans"])
    return F.when(may & F.rlike("text", pattern), spans).otherwise(empty)


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``docs`` as struct ``row``, its ``doc_id`` and ``text`` (null: empty), and the ``spans`` of all rules by start, then rule.

    All columns of a row stay in ``row``, whatever their names. Rows are told apart by nothing: rows with the same id share
    their candidate flags, which only cost a verification, and each gets its own spans. A null id is a key like another. An
    empty table gives an empty one.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(doc_id).cast("long")).alias("key"))
    if queries:
        ids = id_and_text(docs, doc_id, text).select(F.xxhash64("doc_id").alias("key"), "text")
        keyed = keyed.join(_candidates(ids, queries, block_docs), "key", "left")
    flags = [F.col(f"may_{kind}") for kind in queries]
    keyed = keyed.select(
        "row", F.col("row")[doc_id].cast("long").alias("doc_id"), F.coalesce(F.col("row")[text], F.lit("")).alias("text"), *flags)
    may = {r.kind: F.coalesce(F.col(f"may_{r.kind}"), F.lit(False)) if r.kind in queries else F.lit(True) for r in rules}
    spans = F.array_sort(F.concat(*[_matches(r, i, may[r.kind]) for i, r in enumerate(rules)]))
    return keyed.select("row", "doc_id", "text", spans.alias("spans"))


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: how many spans of each kind, all spans as text, and the digest of the spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    out = found.select("doc_id", *counts, written.alias("spans"))
    return out.withColumn("base_sha256", F.sha2("spans", 256))


def masked_text(text: str = "text", spans: str = "spans", mask: str = MASK) -> Column:
    """The text with each stretch of spans that touch or overlap replaced by the mask."""
    source = F.col(text)

    def step(seen: Column, span: Column) -> Column:
        apart = (span["start"] > seen["at"]) | (seen["at"] == 0)
        added = F.concat(seen["out"], source.substr(seen["at"] + 1, span["start"] - seen["at"]), F.lit(mask))
        return F.struct(F.greatest(seen["at"], span["end"]).alias("at"), F.when(apart, added).otherwise(seen["out"]).alias("out"))

    return F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda seen: F.concat(seen["out"], source.substr(seen["at"] + 1, F.length(source))))


def _spans_sql(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
m{rank} AS (
  SELECT doc_id, row, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {rule.group}) AS tested,
    string_split_regex(text, '{pattern}') AS between FROM d),
s{rank} AS (
  SELECT row, {rank} AS rank, unnest(list_filter(list_transform(whole, lambda x, i: {{
    'start': list_sum(list_transform(between[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda y: length(y))), 0),
    'size': length(x), 'tested': length(tested[i])}}), lambda s: s.tested >= {rule.least})) AS s FROM m{rank})"""


#: DuckDB SQL for ``report`` of RULES over ``documents``.
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),"
    + ",".join(_spans_sql(r, i) for i, r in enumerate(RULES))
    + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(RULES))) + "), "
    + "named AS (SELECT row, rank, CAST(s.start AS BIGINT) AS a, CAST(s.start + s.size AS BIGINT) AS b FROM every), grouped AS (SELECT row, "
    + ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(RULES))
    + f", string_agg({[r.kind for r in RULES]}[rank + 1] || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM named GROUP BY row) "
    + "SELECT doc_id, " + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)
    + ", coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN grouped USING (row)"
)
