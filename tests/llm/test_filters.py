"""Operators 6, 8 and 9: held-out accuracy, exact neighbours, and shrinkage."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import AWKWARD, DOC
from pyspark.sql import functions as F

from purser.llm import language, quality, toxicity
from purser.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return {name: table(spark, SF, name) for name in ("documents", "labels", "pages")}


def test_language_accuracy(corpus):
    docs = corpus["documents"]
    model = language.fit_language(docs)
    assert [name for name, _ in model.dictionaries] == ["de", "en", "es", "fr"]
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.02 and all(0 <= r["score"] <= 1 for r in rows)


def test_a_rare_language_leaves_the_others_as_they_are(spark, corpus):
    docs = corpus["documents"]
    ids = spark.range(10_000_000, 10_000_020).selectExpr("id AS doc_id").where("crc32(CAST(doc_id AS STRING)) % 4 != 2").limit(1)
    rare = ids.selectExpr("doc_id", "'krølle bølle' AS text", "'xx' AS lang", "'s' AS source", "12L AS n_chars")
    model, before = language.fit_language(docs.select(rare.columns).unionByName(rare)), language.fit_language(docs)
    assert [d for d in model.dictionaries if d[0] != "xx"] == list(before.dictionaries)
    assert min(len(d) for _, d in before.dictionaries) > 10_000 and dict(model.dictionaries)["xx"] == "krølle bølle".encode()
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and np.mean([r["rejected"] for r in rows]) < 0.02


def test_a_language_of_little_text_is_found(corpus):
    docs = corpus["documents"]
    model = language.fit_language(docs)
    short = language.LanguageModel(tuple((name, d[:2000] if name == "fr" else d) for name, d in model.dictionaries))
    rows = language.identify(docs, short).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == "fr" for r in rows if r["lang"] == "fr"]) > 0.9
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["lang"] != "fr"]) > 0.97


def test_long_texts_keep_their_margin(corpus):
    docs = corpus["documents"]
    model = language.fit_language(docs)
    english = " ".join(r["text"] for r in docs.where("lang = 'en' AND text IS NOT NULL").orderBy("doc_id").collect())
    short, long = (language._predict(text, model.dictionaries) for text in (english[:20_000], english * 3))
    assert len(english) > 1_000_000 and short[0] == long[0] == "en"
    assert long[1] > short[1] / 2 > 10 * language.MIN_MARGIN


def test_language_of_awkward_texts(spark, corpus, awkward, nothing):
    model = language.fit_language(corpus["documents"])
    rows = language.identify(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in rows}
    for doc in (1, 2, 4):
        assert by_id[doc]["lang_pred"] == "und" and by_id[doc]["rejected"] and by_id[doc]["score"] == 0
    assert by_id[8]["lang_pred"] != "und" and by_id[None]["lang_pred"] != "und"
    assert language.identify(nothing, model).collect() == []
    none = language.fit_language(nothing)
    assert {r["lang_pred"] for r in language.identify(awkward, none).collect()} == {"und"}
    assert language.fit_language(awkward).dictionaries


def test_labels_of_the_held_out_fold_teach_nothing(corpus):
    docs = corpus["documents"]
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert language.fit_language(changed) == language.fit_language(docs)
    labels = corpus["labels"]
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, flipped) == toxicity.fit_toxicity(docs, labels)


@pytest.fixture(scope="module")
def toxic_model(corpus):
    return toxicity.fit_toxicity(corpus["documents"], corpus["labels"])


def test_toxic_documents_are_found(corpus, toxic_model):
    rows = toxicity.score(corpus["documents"], toxic_model).join(corpus["labels"], "doc_id").collect()
    words = set("idiot scum pathetic loser worthless moron trash stupid disgusting clown".split())
    texts = {r["doc_id"]: r["text"] for r in corpus["documents"].collect()}
    insulting = [r for r in rows if len(words & set(texts[r["doc_id"]].lower().split())) >= 2]
    assert insulting and all(r["predicted"] == 1 and r["evidence"] for r in insulting)
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def plain_terms(text):
    """Every term of a text and its times, as strings."""
    times = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        times.update([word, *(f"{word[:n]}*" for n in toxicity.BEGINNINGS if len(word) > n)])
    return times


@pytest.mark.parametrize("stretch", [1 << 19, 7])
def test_terms_of_whole_texts(monkeypatch, stretch):
    """The terms and times of strings, whatever the letters are and where the texts are cut into stretches."""
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    toxicity._known_powers.cache_clear()
    texts = ["", "1_2", "abcd abcde abcdef ABCDEF", "İstanbul ΑΣ ΑΣ\nΣ ΑΣ", "ab\ud800cd x²y 1a2b _q_ Straße", "ω" * 40 + " ωωωω ωωωωω", "a", "é" * 6] * 20
    every = {h: t for text in texts for t, h in hashes_of(text).items()}
    known = np.array(sorted(every)[::2])
    for text, (terms, times), (places, n) in zip(texts, toxicity.Terms().of(texts), toxicity.Terms(known).of(texts), strict=True):
        wanted = plain_terms(text)
        assert {every[h]: k for h, k in zip(terms.tolist(), times.tolist(), strict=True)} == wanted
        assert sorted(terms.tolist()) == terms.tolist() and sorted(places.tolist()) == places.tolist()
        assert {every[h]: k for h, k in zip(known[places].tolist(), n.tolist(), strict=True)} == {t: k for t, k in wanted.items() if hashes_of(text)[t] in known}
    toxicity._known_powers.cache_clear()


def hashes_of(text):
    """The hash of each term of a text."""
    out = {}
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        own = toxicity.term_hashes(word)
        out |= {word: own[0], **{f"{word[:n]}*": h for n, h in zip(toxicity.BEGINNINGS, own[1:], strict=True) if len(word) > n}}
    return out


def test_many_new_words_cost_no_memory_of_words():
    """Texts of words that occur once: nothing is looked up, or remembered, word by word."""
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" * 2 for j in range(300)) for i in range(200)]
    terms = toxicity.Terms(np.array(sorted(toxicity.term_hashes("worda"))))
    assert sum(len(t) for t, _ in terms.of(texts)) and vars(terms).keys() == {"known"}


def plain_vectors(texts, docs, gain_of):
    """Unit vectors of the texts over the terms that have a gain."""
    out = []
    for text in texts:
        raw = {t: (1 + math.log(n)) * gain_of[t] for t, n in plain_terms(text).items() if t in gain_of}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({t: v / norm for t, v in raw.items()} if norm else {})
    return out


def plain_gains(corpus, labels):
    """(examples, gain of each term) by sums over strings."""
    texts = {r["doc_id"]: r["text"] for r in corpus["documents"].collect()}
    examples = {}
    for doc, y in sorted(labels.items()):
        if doc in texts and zlib.crc32(str(doc).encode()) % 4 != 2:
            first, label = examples.get(texts[doc], (doc, y))
            examples[texts[doc]] = (first, max(label, y))
    n, positive = len(examples), sum(y for _, y in examples.values())
    have, toxic, seen = Counter(), Counter(), Counter()
    for text, (_, y) in examples.items():
        have.update(plain_terms(text).keys())
        if y:
            toxic.update(plain_terms(text).keys())
    for text in texts.values():
        seen.update(plain_terms(text).keys() & have.keys())
    gain = {}
    for t, k in have.items():
        off = max(abs(toxic[t] * n - k * positive) - n / 2, 0)
        spread = k * (n - k) * positive * (n - positive)
        chi = off * off * n / spread if spread else 0
        strength = max(chi / (chi + toxicity.HALF_CHI_SQUARE), toxicity.LEAST_WEIGHT)
        gain[t] = strength * max(math.log((1 + len(texts)) / (1 + seen[t])), 1e-3) ** toxicity.IDF_POWER
    return {first: (text, y) for text, (first, y) in examples.items()}, gain


def test_neighbours_are_exact(corpus, toxic_model):
    """Against all cosines, from strings, with every term of the examples."""
    examples, gain = plain_gains(corpus, {r["doc_id"]: r["toxic"] for r in corpus["labels"].collect()})
    assert len(toxic_model.terms) == len(gain)
    vectors = dict(zip(examples, plain_vectors([t for t, _ in examples.values()], None, gain), strict=True))
    scorer = toxicity.Scorer(toxic_model)
    rows = corpus["documents"].collect()
    checked = 0
    for r, (_, ids, labels, cosines) in zip(rows, scorer([r["text"] for r in rows]), strict=True):
        own = plain_vectors([r["text"]], None, gain)[0]
        best = sorted(((sum(w * v.get(t, 0.0) for t, w in own.items()), d) for d, v in vectors.items()), reverse=True)[: toxicity.NEIGHBOURS]
        assert cosines.tolist() == pytest.approx([c for c, _ in best if c > 1e-12], rel=1e-5)
        assert [examples[d][1] for d in ids.tolist()] == labels.tolist()
        checked += bool(len(ids))
    assert checked > 20


def random_index(pick, n, kinds=40, words=60):
    """Examples of some kinds that share few rare terms and all frequent ones."""
    terms = [np.unique(np.concatenate([pick.integers(0, 30, 12), 30 + words * pick.integers(kinds) + pick.integers(0, words, 20)])) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
    gain = np.where(np.arange(30 + words * kinds) < 30, 0.3, 10.0)
    flat, times = np.concatenate(terms), pick.integers(1, 4, starts[-1]).astype(float)
    labels = np.array([i % 3 == 0 for i in range(n)], np.int32)
    return terms, toxicity.BlockMaxIndex.build(np.arange(n), labels, starts, flat, times, gain), [
        dict(zip(t.tolist(), toxicity.weighted(times[a:b], gain[t]), strict=True)) for t, a, b in zip(terms, starts, starts[1:], strict=False)], gain


@pytest.mark.parametrize("n", [1, 40, 900])
def test_postings_are_skipped_without_loss(n):
    pick = np.random.default_rng(n)
    terms, index, vectors, gain = random_index(pick, n)
    index = toxicity.BlockMaxIndex.from_bytes(index.to_bytes())
    for at in pick.integers(0, n, 60).tolist():
        asked = np.unique(np.concatenate([terms[at][::2], pick.integers(0, len(gain), 3)]))
        own = dict(zip(asked.tolist(), toxicity.weighted(np.ones(len(asked)), gain[asked]), strict=True))
        for but in (None, at):
            every = sorted((-sum(w * v.get(t, 0) for t, w in own.items()), i) for i, v in enumerate(vectors) if i != but)[: toxicity.NEIGHBOURS]
            got = index.nearest(asked, np.ones(len(asked)), but=but)
            assert got[0].tolist() == pytest.approx([-c for c, _ in every if c < 0], rel=1e-5)
            assert but not in index.ids[got[1]].tolist()
    if n == 900:
        assert len(index.weight[0]) and index.read < index.posted / 4


def test_most_examples_are_never_looked_at(corpus, toxic_model):
    """Of the corpus' own texts: the lists of frequent terms are needed for few examples."""
    scorer = toxicity.Scorer(toxic_model)
    scorer([r["text"] for r in corpus["documents"].collect()])
    assert scorer.index.looked < 0.25 * scorer.index.offered and scorer.index.read < 0.4 * scorer.index.posted


def test_document_frequencies(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    monkeypatch.setattr(toxicity, "GROUPS", 3)
    texts = corpus["documents"].select("text").repartition(11)
    seen = Counter(t for r in texts.collect() for t in plain_terms(r["text"]))
    words = sorted(w for w in seen if not w.endswith("*"))[::40] + ["nosuchword"]
    hashes = {w: toxicity.term_hashes(w)[0] for w in words}
    n, counts = toxicity.document_frequencies(texts, np.array(sorted(hashes.values())))
    place = {h: i for i, h in enumerate(sorted(hashes.values()))}
    rows = [set(re.findall(r"[^\W\d_]+", r["text"].lower())) for r in texts.collect()]
    assert n == len(rows) and {w: counts[place[h]] for w, h in hashes.items()} == {w: sum(w in r for r in rows) for w in words}


def test_long_labelled_texts_are_bounded(spark, corpus, monkeypatch):
    """Rows over the length, and after the characters of their class, are no examples; the others are."""
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} word{chr(97 + i)} " * (400 if i == 3 else 10)) for i in range(20)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    monkeypatch.setattr(toxicity, "LONGEST", 1000)
    ids = toxicity.BlockMaxIndex.from_bytes(toxicity.fit_toxicity(docs, labels).index).ids.tolist()
    known = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(ids) == [i for i in known if i != 3]
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 350)
    model = toxicity.fit_toxicity(docs, labels)
    assert 0 < len(toxicity.BlockMaxIndex.from_bytes(model.index).ids) < len(ids) and len(model.terms)


def test_a_rare_insult_is_a_term(spark):
    """A word of eight toxic rows among hundreds of clean ones, too few for a chi-square of 30 to be likely, still tells."""
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    pick = np.random.default_rng(8)
    texts = {i: " ".join(pick.choice(plain, 30)) for i in range(1200)}
    toxic = {i for i in range(1200) if i % 3 == 0}
    for i, doc in enumerate(sorted(toxic)):
        texts[doc] += f" slur{'abcdefghijklmnopqrstuvwxyzäöüßéèêëàáâãåæçñìíîïòóôõøùúûý'[i // 8]}"
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in texts], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    scorer = toxicity.Scorer(model)
    example = int(scorer.index.ids[scorer.index.labels == 1][0])
    score, ids, _, cosines = scorer([texts[example]])[0]
    assert score >= toxicity.THRESHOLD and ids[0] == example and cosines[0] == pytest.approx(1)
    assert set(model.terms.tolist()) >= {toxicity.term_hashes(w)[0] for w in plain}


def test_calibration():
    assert toxicity.logistic_curve([]) == (1.0, 0.0)
    pick = np.random.default_rng(5)
    votes = pick.random(4000)
    sharp = [(float(v), int(pick.random() < v * v / (v * v + (1 - v) ** 2)), 1.0) for v in votes]  # twice the log odds
    slope, shift = toxicity.logistic_curve(sharp)
    assert slope == pytest.approx(2, abs=0.2) and shift == pytest.approx(0, abs=0.2)
    scores = [toxicity.calibrated(v, (slope, shift)) for v in (0.0, 0.2, 0.5, 0.9, 1.0)]
    assert scores == sorted(scores) and 0 <= scores[0] and scores[-1] <= 1


def test_toxicity_of_awkward_texts(spark, toxic_model, awkward, nothing):
    rows = toxicity.score(awkward, toxic_model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(nothing, toxic_model).collect() == []
    labels = spark.createDataFrame([(3, None, 1), (3, 1, None), (8, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (awkward, nothing):
        for known in (labels, labels.limit(0)):
            assert toxicity.score(awkward, toxicity.fit_toxicity(docs, known)).count() == len(AWKWARD)


def test_quality_accuracy(corpus):
    sites = quality.sites_of_pages(corpus["pages"])
    docs = corpus["documents"]
    rows = quality.score_quality(docs, corpus["labels"], sites).join(corpus["labels"], "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["predicted"] for r in rows if r["quality"] == 1)


def test_sites_are_read_from_addresses(spark):
    urls = [("http://a.example/fr/12",), ("https://a.example/de/7.html?x=1",), ("http://b.example/en/12/#top",), (None,), ("nothing",), ("http://c/",)]
    got = {tuple(r) for r in quality.sites_of_pages(spark.createDataFrame(urls, "url string")).collect()}
    assert got == {(12, "a.example", "fr"), (7, "a.example", "de")}


def test_small_sites_shrink_to_their_parents(spark):
    """Good and bad hosts of many documents that look alike; the site decides, and a host of one document stays in between."""
    rows, sites, labels = [], [], []
    for i in range(1200):
        host = "good" if i < 500 else "bad" if i < 1000 else f"one{i}"
        rows.append((i, "the same words in every text here", "en", "s", 1))
        sites.append((i, host, "p"))
        labels.append((i, 1 if host == "good" else 0 if host == "bad" else i % 2, 0))
    docs = spark.createDataFrame(rows, DOC)
    out = quality.score_quality(
        docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(sites, "doc_id long, host string, path string"))
    means = {host: [] for host in ("good", "bad", "one")}
    for r in out.collect():
        means[r["host"].rstrip("0123456789")].append(r["path_mean"])
    assert min(means["good"]) > 0.8 and max(means["bad"]) < 0.2
    assert 0.3 < np.mean(means["one"]) < 0.7 and all(math.isfinite(x) for v in means.values() for x in v)


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    sites = spark.createDataFrame([(3, "h", None), (8, None, "p"), (9, "h", "q")], "doc_id long, host string, path string")
    rows = quality.score_quality(awkward, labels, sites).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(nothing, labels, sites).collect() == []


def test_levels_are_direct_sums(spark, corpus):
    """Every mean and score from plain sums over the evidence, level by level."""
    sites = quality.sites_of_pages(corpus["pages"])
    labels = {r["doc_id"]: r["quality"] for r in corpus["labels"].collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    rows = quality.score_quality(corpus["documents"], corpus["labels"], sites).collect()
    source = {r["doc_id"]: r["source"] for r in corpus["documents"].collect()}
    place = {r["doc_id"]: (r["host"], r["path"] or "") for r in sites.collect()}
    e = {r["doc_id"]: float(labels.get(r["doc_id"], r["doc_score"])) for r in rows}
    mean = sum(e.values()) / len(e)

    def weight(groups, above):
        """Of groups of evidence and the mean above each: the method of moments."""
        n, k = sum(map(len, groups)), len(groups)
        if k < 2 or n <= k:
            return quality.MOST_PRIOR
        inside = sum(sum((x - sum(g) / len(g)) ** 2 for x in g) for g in groups) / (n - k)
        between = sum(len(g) * (sum(g) / len(g) - a) ** 2 for g, a in zip(groups, above, strict=True)) / (k - 1)
        spread = max(0.0, (between - inside) / max((n - sum(len(g) ** 2 for g in groups) / n) / (k - 1), 1e-9))
        return min(quality.MOST_PRIOR, max(quality.LEAST_PRIOR, inside / spread)) if spread > 0 else quality.MOST_PRIOR

    def grouped(key):
        out = {}
        for d in e:
            if key(d) is not None:
                out.setdefault(key(d), []).append(d)
        return out

    by_source, by_host = grouped(source.get), grouped(lambda d: place[d][0] if d in place else None)
    by_path = grouped(place.get)
    of_source = weight([[e[d] for d in g] for g in by_source.values()], [mean] * len(by_source))
    above = {d: (of_source * mean + sum(e[x] for x in by_source[source[d]])) / (of_source + len(by_source[source[d]])) if source[d] else mean for d in e}
    host_above = {h: sum(above[d] for d in g) / len(g) for h, g in by_host.items()}
    of_host = weight([[e[d] for d in g] for g in by_host.values()], list(host_above.values()))
    host_mean = {h: (of_host * host_above[h] + sum(e[d] for d in g)) / (of_host + len(g)) for h, g in by_host.items()}
    of_path = weight([[e[d] for d in g] for g in by_path.values()], [host_mean[h] for h, _ in by_path])

    def shrunk(of, prior, group, d):
        return (of * prior + sum(e[x] for x in group) - e[d]) / (of + len(group) - 1)

    for r in rows:
        d = r["doc_id"]
        of_doc = shrunk(of_source, mean, by_source[source[d]], d) if source[d] else mean
        host = shrunk(of_host, of_doc, by_host[place[d][0]], d) if d in place else of_doc
        path = shrunk(of_path, host, by_path[place[d]], d) if d in place else host
        assert (r["source_mean"], r["host_mean"], r["path_mean"]) == pytest.approx((of_doc, host, path), rel=1e-6)
        odds = math.log(r["doc_score"] / (1 - r["doc_score"])) + math.log(path / (1 - path)) - math.log(mean / (1 - mean))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-4)
    assert len(place) and len(by_source) > 1
