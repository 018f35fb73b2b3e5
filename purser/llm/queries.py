"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from purser.llm import ball_tree, embeddings, exact_copies, fingerprints, language, minhash, packing, pieces, quality, runs, secrets, token_shards, toxicity
from purser.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_token_shards(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_shards.read_token_shards(token_shards.write_token_shards(table(spark, sf_dir, "documents"), vocabulary))


@query
def op2_sentencepiece(spark, sf_dir):
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_language(docs))


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op4_secrets(spark, sf_dir):
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query
def op1_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


ORACLE["op4_secrets"] = secrets.SQL
ORACLE["op5_fingerprints"] = fingerprints.SQL


@query
def op8_quality(spark, sf_dir):
    docs, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    return quality.score_quality(docs, labels, quality.sites_of_pages(pages))


@query
def op7_embeddings(spark, sf_dir):
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"))


@query
def op13_exact_copies(spark, sf_dir):
    return exact_copies.exact_copies(table(spark, sf_dir, "documents"))


ORACLE["op13_exact_copies"] = exact_copies.SQL


@query
def op11_runs(spark, sf_dir):
    return runs.digests(runs.find_runs(table(spark, sf_dir, "documents"), rewrite=runs.with_repeats))


@query
def op12_ranked_search(spark, sf_dir):
    return ball_tree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_ranked_search"] = ball_tree.SQL
