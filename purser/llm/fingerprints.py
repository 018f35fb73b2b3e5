"""I-Match fingerprints of documents, in DataFrame functions only.

The lexicon is all terms whose share of documents lies in a band: rarer ones are names and errors, commoner ones say
nothing. A band bounds the lexicon whatever the corpus: terms in at least a share s of the documents are at most
(mean distinct terms of a document) / s. Each term belongs to some of the randomised sub-lexicons, by the digits
of its MD5; these keep a half, an eighth, a 32nd or a 128th of the terms. A document has one hash for each sub-lexicon: of its
distinct terms there, sorted. So a small edit changes some hashes only, and the sparse ones last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from purser.llm.common import partitions
from purser.session import written

#: The band of the terms' shares of documents.
LEAST_SHARE, MOST_SHARE = 0.002, 0.2
#: For each sub-lexicon: the place of a byte of the MD5, in hexadecimal digits from 1, and what it must be below.
SUBSETS = tuple((2 * i + 1, ("80", "20", "08", "02")[i % 4]) for i in range(16))
NONE = "--------"
SEPARATOR = r"[^\p{L}\p{N}]+"
#: A lexicon of at most so many rows is broadcast (some 10 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def terms(text: str | Column) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != ""))


def lexicon(docs: DataFrame, n_docs: int, text: str = "text") -> DataFrame:
    """(term, subsets) of all terms in the band, counted over all documents; bit i of subsets: the term is in sub-lexicon i."""
    seen = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return seen.where((F.col("n") >= LEAST_SHARE * n_docs) & (F.col("n") <= MOST_SHARE * n_docs)).select("term", _subsets(F.md5("term")).alias("subsets"))


def _subsets(digest: Column) -> Column:
    bits = [F.when(F.substring(digest, place, 2) < below, 1 << i).otherwise(0) for i, (place, below) in enumerate(SUBSETS)]
    return sum(bits[1:], bits[0])


def fingerprint(found: Column, otherwise: Column) -> Column:
    """The hashes of a document's sorted lexicon terms (with their subsets), or the other digest for each where it has none."""

    def own(bit: Column) -> Column:
        kept = F.filter(found, lambda t: t["subsets"].bitwiseAND(bit) != 0)
        return F.array_join(F.transform(kept, lambda t: t["term"]), " ")

    bits = F.array(*[F.lit(1 << i) for i in range(len(SUBSETS))])
    hashes = F.transform(F.transform(bits, own), lambda j: F.when(j != "", F.substring(F.md5(j), 1, 8)).otherwise(NONE))
    alone = F.array_repeat(F.substring(otherwise, 1, 8), len(SUBSETS))
    return F.array_join(F.when(F.size(found) > 0, hashes).otherwise(alone), ".")


def likeness(a: Column, b: Column) -> Column:
    """Of the sub-lexicons where either document has a term, the share with the same hash; equal fingerprints are 1."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("x"), F.split(b, r"\.").alias("y"))
    used = F.filter(pairs, lambda p: (p["x"] != NONE) | (p["y"] != NONE))
    same = F.size(F.filter(used, lambda p: p["x"] == p["y"])) / F.size(used)
    return F.when(a == b, 1.0).when(F.size(used) == 0, 0.0).otherwise(same).cast("double")


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(part, place, doc_id, text, next_part, next_place, next_text), each row with the next by id, then text; last, the first.

    Rows are dealt into parts by quantiles of the id, so no task sorts them all; what follows a part's last row is looked
    up in the table of the parts' first rows. A null id comes first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("c")).first()["c"]
    inside = F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("doc_id")) if cuts else F.array()
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(inside)))
    by_id = Window.partitionBy("part").orderBy("doc_id", "text")
    rows = rows.withColumns({
        "place": F.row_number().over(by_id), "next_text": F.lead("text").over(by_id),
    })
    # One row for each part.
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(inside)).alias("part")
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lowest = ids.groupBy(part).agg(F.min("doc_id").alias("low"))
    heads = ids.join(F.broadcast(lowest), F.col("doc_id").eqNullSafe(F.col("low"))).groupBy("part").agg(F.min("text").alias("text"))
    by_part = Window.orderBy("part")
    everything = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(everything)).alias("head_part"),
        F.coalesce(F.lead("text").over(by_part), F.first("text").over(everything)).alias("head_text"))
    last = F.col("next_text").isNull()
    return rows.join(F.broadcast(heads), "part").select(
        "part", "place", "doc_id", "text",
        F.when(last, F.col("head_part")).otherwise(F.col("part")).alias("next_part"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
        F.when(last, F.col("head_text")).otherwise(F.col("next_text")).alias("next_text"))


def edited_text() -> Column:
    """The text with its last floor(n / 2) characters replaced by the next text's first as many, or all it has."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of its whole text and of its edited text, and how alike the first is to the second and to the next row's.

    A null text is empty; equal texts, also empty ones, have equal fingerprints; rows that repeat an id follow each other by
    their texts; a single row is its own next; an empty table gives an empty one; other columns are not looked at.
    """
    rows = in_order(docs, doc_id, text).withColumn("edited", edited_text())
    words = lexicon(docs.where(F.col(text).isNotNull()), docs.count(), text)
    words = written(words, "lexicon")
    words = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))
    both = rows.select(
        "part", "place", "doc_id", "next_part", "next_place", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.explode(versions).alias("v"))
    both = both.withColumn("terms", terms("v.body"))
    every = F.when(F.size("terms") > 0, F.array_join(F.sort_array("terms"), " ")).otherwise(F.col("v.body"))
    carried = ("doc_id", "next_part", "next_place", "n_chars", "edited_sha256", "otherwise")
    spread = both.withColumn("otherwise", F.md5(every)).select(
        "part", "place", "v.version", *carried, F.posexplode_outer("terms").alias("pos", "term"))
    known = spread.join(words, "term", "left").where("subsets is not null or coalesce(pos, 0) = 0")
    known = known.withColumn("known", F.when(F.col("subsets").isNotNull(), F.struct("term", "subsets")))
    # All of this happens inside the parts: their rows are together since they were numbered.
    prints = known.groupBy("part", "place", "version").agg(
        F.sort_array(F.collect_list("known")).alias("found"), *[F.first(c).alias(c) for c in carried])
    prints = prints.withColumn("print", fingerprint(F.col("found"), F.col("otherwise")))
    of = {v: F.max(F.when(F.col("version") == v, F.col("print"))) for v in (0, 1)}
    prints = prints.groupBy("part", "place").agg(
        of[0].alias("fingerprint"), of[1].alias("edited_fingerprint"), *[F.first(c).alias(c) for c in carried[:-1]])
    prints = written(prints, "fingerprints")
    after = prints.select(
        F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    return prints.join(after, ["next_part", "next_place"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


_SUBSETS_SQL = ", ".join(
    f"coalesce(left(md5(nullif(array_to_string(list_filter(found, lambda t: substr(md5(t), {place}, 2) < '{below}'), ' '), '')), 8), '{NONE}')"
    for place, below in SUBSETS)

#: DuckDB SQL for ``fingerprint_documents`` over ``documents``.
SQL = f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS place FROM documents),
n AS (SELECT count(*) AS n FROM ordered),
pairs AS (
  SELECT a.doc_id, a.place, a.place % n + 1 AS next_place, a.text, b.text AS next_text, length(a.text) AS n_chars,
    length(a.text) // 2 AS half
  FROM n, ordered a JOIN ordered b ON b.place = a.place % n + 1),
bodies AS (
  SELECT place, 0 AS version, text AS body FROM pairs
  UNION ALL SELECT place, 1, left(text, n_chars - half) || left(next_text, half) FROM pairs),
terms AS (
  SELECT *, list_sort(list_distinct(list_filter(string_split_regex(lower(body), '{SEPARATOR}'), lambda t: t <> ''))) AS terms FROM bodies),
seen AS (SELECT unnest(terms) AS term FROM terms WHERE version = 0),
lexicon AS (
  SELECT term FROM seen GROUP BY term
  HAVING count(*) >= {LEAST_SHARE} * (SELECT n FROM n) AND count(*) <= {MOST_SHARE} * (SELECT n FROM n)),
spread AS (SELECT place, version, unnest(terms) AS term FROM terms),
kept AS (SELECT place, version, list(term ORDER BY term) AS found FROM spread JOIN lexicon USING (term) GROUP BY ALL),
prints AS (
  SELECT place, version, CASE WHEN found IS NULL
    THEN array_to_string(list_transform(range({len(SUBSETS)}), lambda i: left(md5(
      CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE body END), 8)), '.')
    ELSE array_to_string([{_SUBSETS_SQL}], '.') END AS p, body
  FROM terms LEFT JOIN kept USING (place, version)),
sides AS (
  SELECT p.doc_id, p.n_chars, a.p AS fingerprint, b.p AS edited_fingerprint, c.p AS next_fingerprint, sha256(b.body) AS edited_sha256
  FROM pairs p JOIN prints a ON a.place = p.place AND a.version = 0 JOIN prints b ON b.place = p.place AND b.version = 1
  JOIN prints c ON c.place = p.next_place AND c.version = 0),
zipped AS (
  SELECT *, list_filter(list_zip(string_split(fingerprint, '.'), string_split(edited_fingerprint, '.')), lambda x: x[1] <> '{NONE}' OR x[2] <> '{NONE}') AS e,
    list_filter(list_zip(string_split(fingerprint, '.'), string_split(next_fingerprint, '.')), lambda x: x[1] <> '{NONE}' OR x[2] <> '{NONE}') AS f
  FROM sides)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0 WHEN len(e) = 0 THEN 0.0
    ELSE CAST(len(list_filter(e, lambda x: x[1] = x[2])) AS DOUBLE) / len(e) END AS near_edited,
  CASE WHEN fingerprint = next_fingerprint THEN 1.0 WHEN len(f) = 0 THEN 0.0
    ELSE CAST(len(list_filter(f, lambda x: x[1] = x[2])) AS DOUBLE) / len(f) END AS near_next
FROM zipped"""
