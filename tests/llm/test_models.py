import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from quernel.llm import gbdt, quality, toxicity
from quernel.llm.labelled import training
from quernel.llm.queries import QUERIES
from quernel.sources.tables import table


def judged(spark, name, sf_dir, label):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r[label] for r in table(spark, sf_dir, "labels").collect()}
    return [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]


def test_quality_on_held_out_rows(spark):
    rows = judged(spark, "op10_quality", "/root/testdata/sf0.01", "quality")
    assert all(p == (s >= 0.3) for _, s, p in rows)
    assert np.mean([p == y for y, _, p in rows]) > 0.94


def test_toxicity_on_held_out_rows(spark):
    rows = judged(spark, "op9_toxicity", "/root/testdata/sf0.1", "toxic")
    assert all(p == (s >= 0.5) for _, s, p in rows)
    found = [y for y, _, p in rows if p]
    assert np.mean(found) > 0.95 and sum(found) > 0.88 * sum(y for y, _, _ in rows)


def test_training_rows_are_bounded_however_often_ids_repeat(spark):
    docs = spark.range(3000).selectExpr("id % 3 + 1 AS doc_id", "concat('t', id % 7) AS text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    rows = training(docs, labels, "quality", "doc_id", "text", 2).collect()
    again = training(docs.orderBy(F.desc("text")), labels, "quality", "doc_id", "text", 2).collect()
    assert len(rows) <= 2 and sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert 1 <= len(training(docs, labels, "quality", "doc_id", "text").collect()) <= 3


@pytest.mark.parametrize("op", [quality, toxicity])
def test_models_without_labels_or_rows(spark, op):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "words here"), (None, "x"), (3, "words here")], "doc_id long, text string")
    for labels in ([], [(1, None), (2, 0)], [(3, 1), (3, 0)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("doc_id", "quality", "quality AS toxic")
        got = op.judged(docs, frame).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert op.judged(docs.where("false"), frame).count() == 0


def test_trees_learn_a_rule_and_are_flat():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = gbdt.train(x[:1500], y[:1500])
    assert np.mean((trees.score(x[1500:]) > 0.5) == y[1500:]) > 0.95
    assert trees.feature.shape == (80, 15) and trees.leaf.shape == (80, 16)
    one = np.array([walk(trees, row) for row in x[:20]])
    assert np.allclose(one, trees.margin(x[:20]))


def walk(trees, row):
    total = trees.base
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_statistics_of_odd_texts():
    for text in (b"", b" ", b"\n", b"x", "é".encode() * 1000, b"a b " * 50_000, bytes(range(256))):
        assert quality.statistics(text).shape == (quality.N_FEATURES,) and np.isfinite(quality.statistics(text)).all()


def test_stages_with_odd_rows_and_clashing_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    text = table(spark, sf_dir, "documents").where("doc_id = 6").first().text
    rows = [(1, text, "en", "s", 1), (None, text, None, None, None), (1, text, "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, text + " token=abcdefgh1", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["score", "_score", "found", "base", "kept", "n_words", "hit_spans", "ids", "n_tokens", "row", "_text"]
    more = docs.withColumns({n: F.lit(7) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns if name != "tokens" else out.columns[:5] == docs.columns
        got = out.collect()
        assert {r["row"] for r in got} <= {7} and (name == "quality" or any(r.doc_id is None for r in got))


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "secrets", "tokens"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        rows = {r.doc_id: r for r in out.collect()}
        texts = {i: r.text for i, r in rows.items()}
        if name == "near-duplicates":
            group = brute.groups(list(before.items()), 5, 80)
            assert set(rows) == {i for i in before if group[i] == i}
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
            bad = {i for i, t in before.items() for n, hit, _ in [brute.hits(t, items)] if hit and 20 * hit >= n}
            assert set(rows) == set(before) - bad
        elif name == "secrets":
            assert set(rows) == set(before)
            assert all(not brute.secrets(t) for t in texts.values())
            assert all((texts[i] == t) == (not brute.secrets(t)) or "[SECRET]" in texts[i] for i, t in before.items())
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "tokens":
            assert texts == before and all(r.n_tokens == len(r.ids) > 0 for r in rows.values())
        if name != "tokens":
            assert out.columns == columns
        before, docs, kept[name] = texts, out, set(rows)
    assert kept["quality"] and {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept["tokens"]
