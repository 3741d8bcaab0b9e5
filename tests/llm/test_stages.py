"""The pipeline's stages on rows with repeated and null ids and columns named like an operator's, and run() as a whole."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm import quality_net
from tidemark.tables import Tables

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans string, n_words string, items string"
SF = "/root/testdata/sf0.001"


def row(doc_id, text, mark="own"):
    return (doc_id, text, "en", "src1", None if text is None else len(text), f"{mark}-s", f"{mark}-p", f"{mark}-w", f"{mark}-i")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    return [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(6)]


def columns(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def test_near_duplicates_keep_one_row_of_a_group(spark, texts):
    a, b, c, d, e, f = texts
    near = a.split(" ")
    near[5] = "changed"
    rows = [
        row(5, a), row(3, " ".join(near)), row(9, a),  # a group of three: 3 stays
        row(7, b), row(7, b), row(7, b, "other"),  # one id and text three times: one row
        row(2, c), row(2, d),  # one id, two texts that are far apart: both stay
        row(None, e), row(4, e), row(None, f), row(None, f),  # a numbered copy goes before a null id; null ids alone: one row
        row(10, None), row(11, ""), row(11, ""), row(12, " \n")]  # no words: no group
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF)
    assert found.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = columns(found.collect())
    one = Counter([row(3, " ".join(near)), row(2, c), row(2, d), row(4, e), row(None, f), row(10, None), row(11, ""), row(11, ""), row(12, " \n")])
    assert not one - got
    rest = got - one
    assert sum(rest.values()) == 1 and set(rest) <= {row(7, b), row(7, b, "other")}
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_stages_give_back_own_columns(spark, texts):
    benchmark = Tables(spark, SF).benchmark.where("length(text) > 100").orderBy("item_id").first()["text"]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(20, texts[0] + " " + benchmark), row(None, texts[1]), row(21, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    kept = corpus_pipeline.contaminated(spark, docs, SF)
    assert kept.schema == docs.schema and columns(kept.collect()) == columns(r for r in rows if r[0] != 20)
    whole = Tables(spark, SF).documents
    given = docs.unionByName(whole.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "'q' AS score", "'q' AS spans", "'q' AS n_words", "'q' AS items"))
    accepted = corpus_pipeline.quality(spark, given, SF)
    assert accepted.schema == given.schema
    assert not columns(accepted.collect()) - columns(given.collect())
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.columns == docs.columns and set(columns(mixed.collect())) == set(columns(rows))


def test_run_applies_all_stages(spark):
    """run() on the smallest tables, against each stage by brute force on what the one before kept."""
    t = Tables(spark, SF)
    documents = {r["doc_id"]: r["text"] or "" for r in t.documents.collect()}
    result = corpus_pipeline.run(spark, SF).collect()
    net = quality_net.fit(t.documents, t.labels)
    accepted = {r["doc_id"] for r in quality_net.score(t.documents, net).where(f"score >= {quality_net.THRESHOLD}").collect()}
    words = {d: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), documents[d])) for d in accepted}
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for d, w in words.items()}
    label = {d: d for d in accepted}
    pairs = [(a, b) for a in accepted for b in accepted if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(accepted)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    heads = {d for d in accepted if label[d] == d}
    plain = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def low(text):
        return plain.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for r in t.benchmark.collect():
        w = low(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    sizes = {len(w) for w in windows}

    def hit(d):
        w = low(documents[d])
        return any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    clean = {d for d in heads if not hit(d)}
    assert {r["doc_id"] for r in result} == clean and len(clean) > 50
    times = Counter(r["doc_id"] for r in result)
    assert set(times.values()) <= {1, 2}
    # ids of all rows lie one behind the other, in order of doc_id
    at = 0
    for r in sorted(result, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
