import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, nothing, prose, sample_rows
from vectorloom.llm import toxicity as tx


def _corpus(n=1500, seed=5):
    rng, rows, toxic = random.Random(seed), [], {}
    for i in range(n):
        words = prose(seed * 10_000 + i, rng.randrange(20, 120), 900).split(" ")
        toxic[i] = int(rng.random() < 0.15)
        if toxic[i]:
            for _ in range(rng.randrange(3, 7)):
                words[rng.randrange(len(words))] = rng.choice(["Idiot,", "scum", f"grobz{rng.randrange(50)}", "trash."])
        rows.append((i, " ".join(words), "en", "a", 1))
    return rows, toxic


def _labels(spark, toxic, noise=0.0):
    rng = random.Random(1)
    rows = [(i, 1, 1 - t if rng.random() < noise else t) for i, t in toxic.items() if i % 3]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_documents_are_recognised(spark):
    rows, toxic = _corpus()
    got = tx.toxicity_scores(documents(spark, rows), _labels(spark, toxic, noise=0.03)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.97 * len(held)
    found = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert found >= 0.9 * sum(toxic[r.doc_id] for r in held)


def test_held_out_labels_are_never_learned_from(spark):
    rows, toxic = _corpus(400)
    docs = documents(spark, rows)
    other = {i: 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in toxic.items()}
    one, two = ({r.doc_id: r.score for r in tx.toxicity_scores(docs, _labels(spark, t)).collect()} for t in (toxic, other))
    assert one == pytest.approx(two)


def test_only_texts_enter_a_score(spark):
    rows, toxic = _corpus(400)
    rows.append((10_000, rows[7][1], "xx", None, 99))
    scores = {r.doc_id: r.score for r in tx.toxicity_scores(documents(spark, rows), _labels(spark, toxic)).collect()}
    assert scores[10_000] == pytest.approx(scores[7])


def test_edge_rows_and_labels(spark):
    labels = spark.createDataFrame(
        [(1, None, 1), (2, 0, 0), (2, 0, 0), (4, 1, None), (None, 1, 1), (6, 1, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int"
    )
    got = tx.toxicity_scores(documents(spark), labels).collect()
    assert len(got) == len(sample_rows()) and all(0 <= r.score <= 1 for r in got)
    nobody = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in tx.toxicity_scores(documents(spark), nobody).collect()} <= {0, 1}
    assert tx.toxicity_scores(nothing(spark), labels).collect() == []


def test_toxic_documents_go(spark):
    rows, toxic = _corpus(600)
    docs = documents(spark, rows)
    labels = _labels(spark, toxic)
    gone = {r.doc_id for r in tx.toxicity_scores(docs, labels).collect() if r.predicted}
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - gone
    # a null id is kept
    assert tx.drop_toxic(documents(spark), labels).where("doc_id is null").count() == 2


def test_only_the_rejected_texts_of_an_id_go(spark):
    rows, toxic = _corpus(600)
    bad = next(r[1] for r in rows if toxic[r[0]] and r[1].count("scum") + r[1].count("trash") > 2)
    good = next(r[1] for r in rows if not toxic[r[0]])
    rows += [(i, text, "en", "a", 1) for i in (None, 5000) for text in (bad, good, None)]
    docs, labels = documents(spark, rows), _labels(spark, toxic)
    kept = sorted(str(r.text) for r in tx.drop_toxic(docs, labels).where("doc_id is null or doc_id = 5000").collect())
    assert kept == sorted(["None", good] * 2)
    # a score is that of the text
    texts = {r[0]: r[1] for r in rows[:600]}
    gone = {texts[r.doc_id] for r in tx.toxicity_scores(docs, labels).collect() if r.predicted and r.doc_id in texts}
    assert bad in gone and sorted(str(r.text) for r in tx.drop_toxic(docs, labels).collect()) == sorted(str(r[1]) for r in rows if r[1] not in gone)


def _votes(spark, n=500, seed=5):
    """Votes of a corpus, with the terms that cast them."""
    rows, toxic = _corpus(n, seed)
    # two words that mostly come together
    rows = [(i, text + " crook" * (toxic[i] and i % 2) + " swindler" * (toxic[i] and i % 2 and i % 5 > 0), *rest) for i, text, *rest in rows]
    label = {i: t for i, t in toxic.items() if i % 3}
    terms = tx.propose_voters(spark.createDataFrame([(rows[i][1], t) for i, t in label.items()], "text string, toxic int"))
    table = [(i, i % 7 == 0, label.get(i), text) for i, text, *_ in rows]
    df = spark.createDataFrame(table, "doc_id bigint, held_out boolean, label int, text string").repartition(3)
    schema = "doc_id bigint, held_out boolean, label int, voters array<bigint>, counts array<bigint>, n_tokens bigint"
    return terms, df.mapInArrow(tx._cast_votes(terms), schema).cache()


def _dense(votes, n):
    """Which voter fires on which row, once and again, the labels, and the classifier's features."""
    rows = votes.orderBy("doc_id").collect()
    fired, x = np.zeros((len(rows), 2 * n)), np.zeros((len(rows), n + 4))
    for r, row in enumerate(rows):
        for v, c in zip(row.voters, row.counts):
            fired[r, v], fired[r, n + v], x[r, v] = 1, c > 1, np.log1p(c)
        hits = sum(row.counts)
        x[r, n:] = np.log1p(len(row.voters)), np.log1p(hits), 20 * hits / (row.n_tokens + 20), 1
    return fired, np.array([np.nan if r.label is None else r.label for r in rows], float), x


def _posterior(fired, label, balance, toxic, clean, discount):
    on, off = np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))
    logit = np.log(balance / (1 - balance)) + (discount * np.where(fired > 0, on, off)).sum(axis=1)
    logit += np.where(np.isnan(label), 0, np.where(label > 0.5, 1, -1) * np.log(tx.LABEL_ACCURACY / (1 - tx.LABEL_ACCURACY)))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def test_label_model_against_a_plain_one(spark):
    terms, votes = _votes(spark)
    n = len(terms)
    fired, label, _ = _dense(votes, n)
    start = tx._start(votes, 2 * n, 0.15)
    model = tx.fit_label_model(votes, 2 * n, start)
    balance, toxic, clean, discount = 0.15, start.toxic, start.clean, np.ones(2 * n)
    weight = np.where(np.isnan(label), start.others, 1.0)
    for step in range(tx.EM_STEPS):
        p = _posterior(fired, label, balance, toxic, clean, discount)
        n1, n0 = (p * weight).sum(), ((1 - p) * weight).sum()
        toxic = (fired.T @ (p * weight) + 0.1) / (n1 + 0.2)
        clean = (fired.T @ ((1 - p) * weight) + 0.1) / (n0 + 0.2)
        if step == tx.EM_STEPS - 2:
            together = fired.T @ (fired * (p * weight)[:, None]) / n1
            spread = np.sqrt(np.outer(toxic * (1 - toxic), toxic * (1 - toxic)))
            r = np.minimum((together - np.outer(toxic, toxic)) / spread, 1)
            r[(r < tx.REPEATS) | (together == 0)] = 0
            np.fill_diagonal(r, 0)
            discount = 1 / (1 + r.sum(axis=1))
        balance = (n1 + 0.5) / (n1 + n0 + 1)
    assert model.balance == pytest.approx(balance)
    for got, want in ((model.toxic, toxic), (model.clean, clean), (model.discount, discount)):
        assert np.allclose(got, want, rtol=1e-7)
    assert (discount < 0.99).any() and n > 10


def test_classifier_against_newton_steps(spark):
    terms, votes = _votes(spark)
    n = len(terms)
    fired, label, x = _dense(votes, n)
    model = tx.fit_label_model(votes, 2 * n, tx._start(votes, 2 * n, 0.15))
    target = _posterior(fired, label, model.balance, model.toxic, model.clean, model.discount)
    weight = np.where(np.isnan(label), model.others, 1.0)
    ridge = np.full(n + 4, tx.RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(n + 4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (weight * (target - p)) - ridge * w)
        w += step * min(1, 2 / abs(step).max())
    got = tx.fit_classifier(votes, n, model)
    assert np.abs(1 / (1 + np.exp(-x @ got)) - 1 / (1 + np.exp(-x @ w))).max() < 0.02


def test_a_label_is_one_vote_among_others(spark):
    """Many voters outvote a label, none doesn't."""
    model = tx.LabelModel(0.2, np.array([0.6, 0.6, 0.6, 0.3, 0.3, 0.3]), np.array([0.01, 0.01, 0.01, 0.005, 0.005, 0.005]), np.ones(6), 0.5)
    kind = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 1, None], pa.int32()), pa.array([[0, 1, 2], [], []], kind), pa.array([[2, 2, 2], [], []], kind)], names=["label", "voters", "counts"]
    )
    p, weight = model.posterior(batch)
    assert p[0] > 0.99 and p[1] > p[2] and list(weight) == [1, 1, 0.5]


def test_no_significant_voter_is_left_out(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        toxic = int(i % 4 == 0)
        text = prose(i, 12, 300).split(" ") + [f"{rng.choice('abcdefgh')}{rng.randrange(40)}vile" for _ in range(5 * toxic)]
        rows.append((" ".join(text), toxic))
    found = tx.propose_voters(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(found) > 250  # of 320, a word and its beginnings count once
