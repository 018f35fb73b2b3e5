"""Quality of documents: a classifier's evidence combined with what their site is like (hierarchical empirical Bayes).

Level by level a mean is shrunk toward the level above: the corpus, the source, the host, the path on the host. A document without
a site stands on its source. A level's prior
weighs as many documents as the spread of its means asks for (method of moments): hosts that hardly differ
are nearly the corpus, and a site with few documents is nearly its parent. A document's score is its own log odds plus
those of its lowest level against the corpus; its own evidence is left out of its site's. Only counts and sums are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from purser.llm.common import held_out
from purser.session import written

#: The labelled rows that the classifier is fitted on: so many at most, lowest id hashes first.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
RIDGE = 1e-3
#: A level's prior weighs this many documents at least and at most.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6


def sites_of_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """(doc_id, host, path) of pages whose address ends in the number of their document; of several, the first in order.

    The path is the first directory. Addresses without a host or a number, and nulls, name no document.
    """
    parts = pages.select(
        F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]+)/", 1).alias("path"),
        F.regexp_extract(url, r"/(\d{1,18})(?:\.html)?/?(?:[?#].*)?$", 1).try_cast("long").alias("doc_id"))
    named = parts.where("host <> '' and doc_id is not null")
    first = named.groupBy("doc_id").agg(F.min(F.struct("host", "path")).alias("site"))
    return first.select("doc_id", "site.host", "site.path")


def features(text: str | Column = "text") -> dict[str, Column]:
    """What a text looks like, without its words."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.greatest(F.length(text), F.lit(1))
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")
    return {
        "f_words": F.log1p(F.size(words)),
        "f_word_length": F.log1p(n / F.size(words)),
        "f_upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / n,
        "f_digits": F.regexp_count(text, F.lit(r"\p{N}")) / n,
        "f_marks": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")) / n,
        "f_new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "f_new_words": F.size(F.array_distinct(words)) / F.size(words),
    }


@dataclass(frozen=True)
class QualityModel:
    """Logistic regression over the features."""

    weights: tuple[tuple[str, float], ...]
    intercept: float

    def log_odds(self) -> Column:
        total = F.lit(self.intercept)
        for name, weight in self.weights:
            total = total + F.col(name) * weight
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def fit_quality(featured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> QualityModel:
    """Fit on at most ``SAMPLE_ROWS`` labelled rows outside the held-out fold. Without both labels all odds are even."""
    sample = _known(labels, doc_id, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    names = [c for c in featured.columns if c.startswith("f_")]
    rows = featured.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(
        F.min("label").alias("label"), *[F.min(c).alias(c) for c in names]).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return QualityModel((), 0.0)
    x = np.array([[r[c] for c in names] for r in rows], float)
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    beta = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (y - p) / len(y) - RIDGE * np.r_[0, beta[1:]]
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + RIDGE * np.eye(len(beta))
        move = np.linalg.solve(curve, slope)
        beta += move
        if np.abs(move).max() < 1e-9:
            break
    weights = beta[1:] / scale
    return QualityModel(tuple(zip(names, map(float, weights), strict=True)), float(beta[0] - weights @ mean))


def _known(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, label) that may be learned from; of several labels of a document the lowest."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.where(F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))


def _prior_weight(groups: DataFrame, mean: Column) -> float:
    """How many documents a level's prior weighs, from (n, total, squares) of its groups and the mean each is shrunk to.

    The means' spread around the mean above, less what sampling alone gives them, is the spread of the level itself.
    """
    inside = F.greatest(F.col("squares") - F.col("total") ** 2 / F.col("n"), F.lit(0.0))
    row = groups.select("n", inside.alias("inside"), (F.col("n") * (F.col("total") / F.col("n") - mean) ** 2).alias("between")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("inside").alias("inside"), F.sum("between").alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not row["n"] or row["groups"] < 2 or row["n"] <= row["groups"]:
        return MOST_PRIOR
    noise = row["inside"] / (row["n"] - row["groups"])
    size = (row["n"] - row["n2"] / row["n"]) / (row["groups"] - 1)
    spread = max(0.0, (row["between"] / (row["groups"] - 1) - noise) / max(size, 1e-9))
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, noise / spread))) if spread > 0 else MOST_PRIOR


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def score_quality(
    docs: DataFrame, labels: DataFrame, sites: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", source: str = "source",
) -> DataFrame:
    """Per row: fold, score, prediction, the classifier's own score, the site and the shrunk means of source, host and path.

    ``sites`` is (doc_id, host, path), one row for each document; one without a row, or with a null host, stands on its source,
    and one without a source (or a table without that column) on the corpus' prior. A null text is empty. Rows that repeat an id
    are scored each; a null id has no label and no site. An empty table gives an empty one; other columns are not looked at.
    """
    of = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), of.alias("source"))
    featured = written(texts.select("doc_id", "source", *[c.cast("double").alias(n) for n, c in features().items()]), "features")
    model = fit_quality(featured, labels, doc_id, label)
    placed = featured.select("doc_id", "source", model.log_odds().alias("log_odds"))
    placed = placed.join(_known(labels, doc_id, label), "doc_id", "left").join(sites.select("doc_id", "host", "path"), "doc_id", "left")
    own = 1 / (1 + F.exp(-F.col("log_odds")))
    placed = written(placed.select(
        "doc_id", "log_odds", own.alias("doc_score"), F.coalesce(F.col("label").cast("double"), own).alias("evidence"), "source", "host",
        F.coalesce("path", F.lit("")).alias("path")), "evidence")

    sums = (F.count(F.lit(1)).cast("double").alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") ** 2).alias("squares"))
    total = placed.agg(*sums).first()
    mean = total["total"] / total["n"] if total["n"] else 0.5
    sources = written(placed.where("source is not null").groupBy("source").agg(*sums), "sources")
    of_source = _prior_weight(sources, F.lit(mean))
    above = sources.select("source", ((of_source * mean + F.col("total")) / (of_source + F.col("n"))).alias("above"), F.col("n").alias("source_n"),
                           F.col("total").alias("source_total"))
    # Rows without a key are no rows of a join: they would all be dealt to one task.
    known = placed.where("source is not null").join(above, "source")
    nowhere = placed.where("source is null").select("*", F.lit(mean).alias("above"), *[F.lit(None).cast("double").alias(c) for c in ("source_n", "source_total")])
    rows = written(known.select(*nowhere.columns).unionByName(nowhere), "sourced")

    # A host's level above is what its documents' sources are like; a document's is its own source.
    paths = rows.where("host is not null").groupBy("host", "path").agg(*sums, F.sum("above").alias("above"))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "above")])
    of_host = _prior_weight(hosts, F.col("above") / F.col("n"))
    shrunk = hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total"), (F.col("above") / F.col("n")).alias("host_above"))
    paths = written(paths.drop("above").join(shrunk, "host"), "paths")
    of_path = _prior_weight(paths, (of_host * F.col("host_above") + F.col("host_total")) / (of_host + F.col("host_n")))

    placed_at = ("n", "total", "host_n", "host_total")
    sited = rows.where("host is not null").join(paths.select("host", "path", *placed_at), ["host", "path"])
    unsited = rows.where("host is null").select("*", *[F.lit(None).cast("double").alias(c) for c in placed_at])
    rows = sited.select(*unsited.columns).unionByName(unsited)
    # Each mean leaves out the row's own evidence.
    e = F.col("evidence")
    source_mean = F.coalesce((of_source * mean + F.col("source_total") - e) / (of_source + F.col("source_n") - 1), F.lit(mean))
    rows = rows.withColumn("source_mean", source_mean)
    rows = rows.withColumn("host_mean", F.coalesce(
        (of_host * F.col("source_mean") + F.col("host_total") - e) / (of_host + F.col("host_n") - 1), F.col("source_mean")))
    rows = rows.withColumn("path_mean", F.coalesce(
        (of_path * F.col("host_mean") + F.col("total") - e) / (of_path + F.col("n") - 1), F.col("host_mean")))
    odds = F.col("log_odds") + _odds(F.col("path_mean")) - _odds(F.lit(mean))
    out = rows.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "doc_score",
        "source", "host", "path", "source_mean", "host_mean", "path_mean")
