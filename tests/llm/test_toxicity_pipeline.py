import os
import random
import zlib

import duckdb
import pytest

import corpus_pipeline
from panelspark.functions.ordering import pinned
from panelspark.llm import queries, toxicity

DATA = "/root/testdata/sf0.001"


def made(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abdeilmnost") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grunk", "zarp" + rng.choice(["on", "al", "ixt", "um"])])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def tables(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = made(1500)
    docs, marks = tables(spark, rows, labels)
    scores = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    truth = {i: t for i, _, t in labels}
    own = [i for i in truth if held_out(i)]
    assert all(scores[i].held_out == held_out(i) for i in truth)
    assert sum(scores[i].predicted == truth[i] for i in own) / len(own) > 0.97
    turned = [(i, q, 1 - t if held_out(i) else t) for i, q, t in labels]
    again = toxicity.score(docs, toxicity.train(docs, tables(spark, rows, turned)[1])).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in scores.items()}


def test_scores_of_odd_texts(spark):
    rows, labels = made(300)
    docs, marks = tables(spark, rows, labels)
    model = toxicity.train(docs, marks)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x " * 50000)], "doc_id long, text string")
    out = toxicity.score(odd, model).collect()
    assert len(out) == 4 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_without_labels_the_insult_list_decides(spark):
    docs, marks = tables(spark, [(1, "you IDIOT!"), (2, "fine")], [(1, None, None), (2, 1, 0)])
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    assert out[1] == pytest.approx(0.9) and out[2] == pytest.approx(0.1)


def test_posterior_discounts_copied_voters():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y) * 2 - 1
    bad = np.where(rng.random(4000) < 0.55, y, ~y) * 2 - 1
    votes = np.stack([good] + [bad] * 8, axis=1)
    noisy = np.where(rng.random(4000) < 0.95, y, ~y).astype(int)
    q = toxicity.posterior(votes, noisy, np.ones(4000))
    one = toxicity.posterior(votes[:, :2], noisy, np.ones(4000))
    assert ((q > 0.5) == y).mean() > 0.93
    assert ((q > 0.5) == (one > 0.5)).mean() > 0.98


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in "documents embeddings conversations benchmark".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    rows = queries.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = pinned(stage(spark, docs, DATA))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(before, model).collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, s in scores.items() if s < 0.5}
    texts = [r.text for r in seen["personal_data"][1].collect()]
    assert not any("@mail" in t for t in texts) and len(texts) == seen["personal_data"][0].count()
    mixed = {}
    for r in seen["mixing"][1].collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert max(mixed.values()) <= 3
    packed = {}
    for r in seen["packing"][1].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + (r.piece == 0)
    assert packed == mixed
