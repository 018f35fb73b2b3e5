"""The stages on a small corpus: what each must drop or change, and what it must leave."""

import re

import public_tokenizers
import pytest
from cases import AWKWARD, DOC
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from purser.llm import minhash
from purser.llm.common import table
from purser.session import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def after(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return {"documents": table(spark, SF, "documents"), **out}


def ids(frame):
    return [r["doc_id"] for r in frame.select("doc_id").collect()]


def test_columns_and_order(after):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "secrets", "packing"]
    for name, _ in pipeline.STAGES[:-1]:
        assert after[name].columns == after["documents"].columns
        assert len(ids(after[name])) == len(set(ids(after[name])))


def test_toxic_documents_go_and_clean_ones_stay(spark, after):
    kept = set(ids(after["toxicity"]))
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    assert all(d in kept for d, toxic in labels.items() if toxic == 0)
    gone = set(ids(after["documents"])) - kept
    insult = re.compile(r"\b(idiot|scum|pathetic|loser|worthless|moron|trash|stupid|disgusting|clown)\b", re.I)
    loud = {r["doc_id"] for r in after["documents"].collect() if len(insult.findall(r["text"])) >= 2}
    assert loud <= gone


def test_few_documents_have_no_language(after):
    assert len(ids(after["language"])) > 0.98 * len(ids(after["toxicity"]))


def test_one_document_of_each_class(after):
    rows = minhash.near_duplicates(after["language"]).collect()
    assert sorted(ids(after["near_duplicates"])) == sorted({r["class_id"] for r in rows})
    assert minhash.near_duplicates(after["near_duplicates"]).where("not kept").count() == 0


def test_secrets_are_masked_and_the_rest_unchanged(after):
    before = {r["doc_id"]: r for r in after["near_duplicates"].collect()}
    changed = 0
    for r in after["secrets"].collect():
        old = before.pop(r["doc_id"])
        if r["text"] != old["text"]:
            changed += 1
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
            assert re.sub(r"\s+", "", re.sub(r"\[SECRET\].*", "", r["text"], flags=re.S)) in re.sub(r"\s+", "", old["text"])
        else:
            assert r == old
    assert changed and not before


def test_packing_holds_every_id(after):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in after["secrets"].collect()}
    got = {r["doc_id"]: r["n"] for r in after["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == wanted


def test_run(spark, after):
    assert pipeline.run(spark, SF).count() == after["packing"].count()


def test_awkward_documents_pass_every_stage(spark, awkward, nothing, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    awkward = awkward.withColumn("a.b", F.lit(1))
    for docs in (awkward, nothing, spark.createDataFrame(AWKWARD[4:5], DOC)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= 2 * docs.count(), name
            assert name == "packing" or out.columns == docs.columns


def test_a_worker_forgets_what_another_operator_kept():
    """Words, models and encoders of one stage are no memory of the next one's tasks in the same process."""
    from purser.llm import common, shingles, tokens, toxicity

    common.remembering("near duplicates", minhash._forget)
    shingles.shingles(shingles.words("some words that are remembered"))
    common.remembering("near duplicates", minhash._forget)
    assert shingles._HASHES
    common.remembering("toxicity", toxicity._forget)
    assert not shingles._HASHES
    toxicity.Scorer.of(toxicity.ToxicityModel(toxicity.np.zeros(0, "int64"), toxicity._index_of([], toxicity.np.zeros(0)).to_bytes(), (1.0, 1.0), 0.0))
    encode = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    assert toxicity.Scorer._last is None and tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), False) is encode
    common.remembering("near duplicates", minhash._forget)
    assert not tokens._encoder.cache_info().currsize
