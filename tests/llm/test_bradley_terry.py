import math

from helpers import SF, clashing, documents, odd_rows, parquet_rows, prose

from censusloom.llm import bradley_terry as bt
from censusloom.llm.queries import QUERIES


def test_features():
    width = len(bt.FEATURES)
    for text in (None, "", " \n", "word", "A whole sentence.\nAnd another one!", "x " * 5_000, "|" * 50, "\x00"):
        found = bt.features(text)
        assert len(found) == width and all(math.isfinite(x) for x in found)


def sample(spark, good, bad):
    rows = [([float(i % 5), 1.0 + i * 0.01] + [0.0] * (len(bt.FEATURES) - 2), True, f"g{i:03d}") for i in range(good)]
    rows += [([float(i % 5), -1.0 - i * 0.01] + [0.0] * (len(bt.FEATURES) - 2), False, f"b{i:03d}") for i in range(bad)]
    return spark.createDataFrame(rows, "features array<double>, good boolean, order string")


def test_pairs_use_every_document(spark):
    for good, bad in ((20, 3), (3, 20)):
        pairs = bt.preference_pairs(sample(spark, good, bad), rounds=2).collect()
        assert len(pairs) == 2 * max(good, bad)
        assert all(r.difference[1] > 0 for r in pairs)


def test_fit_puts_the_cut_at_the_share_of_bad_labels(spark):
    labelled = sample(spark, 30, 10)
    weights, cut = bt.fit(labelled)
    assert weights[1] > 0 and abs(weights[0]) < weights[1]
    scores = labelled.select(bt.score(labelled, weights, cut).alias("s"), "good").collect()
    assert all((r.s >= bt.CUT_SCORE) == r.good for r in scores)
    assert bt.fit(labelled.where("good"))[0] == [0.0] * len(bt.FEATURES)


def test_query_held_out_accuracy(spark):
    found = {r.doc_id: r for r in QUERIES["op1_bradley_terry"](spark, SF).collect()}
    labels = parquet_rows("labels", "doc_id, quality")
    held = [(found[i], q) for i, q in labels if found[i].held_out]
    assert len(held) >= 10
    assert sum(r.predicted == q for r, q in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())


def test_tables(spark):
    docs = clashing(documents(spark, odd_rows()))
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (2, None, 0), (5, 0, 0), (6, 0, None), (None, 1, 0), (99, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    found = bt.classify(docs, labels)
    assert found.count() == len(odd_rows())
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert bt.classify(docs.limit(0), labels).count() == 0
    assert bt.classify(docs, labels.limit(0)).count() == len(odd_rows())


def test_cut_rests_on_all_labels(spark, monkeypatch):
    rows = [(i, prose(i, 30 + i % 50) + " | $$ 11" * (i % 4), "en", "s", 1) for i in range(400)]
    labels = [(i, int(i % 4 == 0 or i % 8 == 2), 0) for i in range(400)]
    cuts, original = [], bt.cut_at_share
    monkeypatch.setattr(bt, "cut_at_share", lambda scored: (cuts.append(scored.count()), original(scored))[1])
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = bt.classify(documents(spark, rows), labels, training_documents=30).join(labels, "doc_id").where("NOT held_out").collect()
    assert cuts[-1] == len(found) > 30
    assert sum(not r.predicted for r in found) == sum(not r.quality for r in found)
