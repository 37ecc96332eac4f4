import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tests.llm.helpers import documents, nothing, prose, sample_rows, tokens
from vectorloom.llm import hmm_lm


def _base(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1:
            count.update(tokens(text))
            count[None] += 1
    total, size = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    out = []
    for doc_id, text, *_ in rows:
        words = [*tokens(text), None]
        score = sum(math.log10((count[w] + 0.5) / size) for w in words)
        out.append((doc_id, len(words), sum(count[w] > 0 for w in words), total, score))
    return out


def _check(rows, got):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    want = sorted(_base(rows), key=key)
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [w[:4] for w in want] == [f[:4] for f in found]
    assert [w[4] for w in want] == pytest.approx([f[4] for f in found])
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1) for r in got)


def test_base_scores(spark):
    _check(sample_rows(), hmm_lm.hmm_scores(documents(spark), steps=2).collect())


def test_rare_words_meet_their_counts(spark, monkeypatch):
    """With almost no room in the bounded tables the results are the same."""
    monkeypatch.setattr(hmm_lm, "KNOWN", 16)
    monkeypatch.setattr(hmm_lm, "HELD", 64)
    _check(sample_rows(), hmm_lm.hmm_scores(documents(spark), steps=1).collect())


def test_states_help_held_out_texts(spark):
    """Two vocabularies, never mixed within a text: the states learn them."""
    rows = [(i, prose(i, 60, 50).replace("w", "ab"[i % 2]), "en", "a", 1) for i in range(200)]
    got = hmm_lm.hmm_scores(documents(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)
    assert {r.doc_id: r.score for r in got} == pytest.approx({r.doc_id: r.score for r in hmm_lm.hmm_scores(documents(spark, rows, partitions=5)).collect()}, rel=1e-6)


def _model(states, classes, seed=0):
    rng = np.random.default_rng(seed)
    rows = lambda n, m: (lambda x: x / x.sum(axis=1, keepdims=True))(rng.random((n, m)) + 0.05)
    return hmm_lm.Hmm(rows(1, states)[0], rows(states, states), rows(states, classes))


def _paths(model, seq):
    for path in product(range(len(model.initial)), repeat=len(seq)):
        p = model.initial[path[0]] * model.emission[path[0], seq[0]]
        for t in range(1, len(seq)):
            p *= model.transition[path[t - 1], path[t]] * model.emission[path[t], seq[t]]
        yield path, p


def test_forward_and_expected_counts_are_exact():
    import pyarrow as pa

    model = _model(3, 5)
    sequences = [[0, 1, 4, 2], [3], [2, 2], [], [1, 0, 0]]
    column = pa.array([np.array(s, np.uint16).tobytes() for s in sequences], pa.binary())
    totals, start, moves, emitted = np.zeros(5), np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for rows, flat, alive in hmm_lm.packs(column):
        out = hmm_lm.forward(model, flat, alive)[0]
        totals[rows[: len(out)]] = out
        for total, part in zip((start, moves, emitted), hmm_lm.expected_counts(model, flat, alive)):
            total += part
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for n, seq in enumerate(sequences):
        if not seq:
            continue
        whole = sum(p for _, p in _paths(model, seq))
        assert totals[n] == pytest.approx(math.log10(whole))
        for path, p in _paths(model, seq):
            want[0][path[0]] += p / whole
            for t, s in enumerate(path):
                want[2][s, seq[t]] += p / whole
                if t:
                    want[1][path[t - 1], s] += p / whole
    for got, expected in zip((start, moves, emitted), want):
        assert got == pytest.approx(expected)


def test_a_model_is_a_distribution():
    """Class probabilities of all sequences of one length add up to one."""
    model = _model(2, 3)
    import pyarrow as pa

    column = pa.array([np.array(s, np.uint16).tobytes() for s in product(range(3), repeat=4)], pa.binary())
    total = sum((10 ** hmm_lm.forward(model, flat, alive)[0]).sum() for _, flat, alive in hmm_lm.packs(column))
    assert total == pytest.approx(1)


def test_empty_table(spark):
    assert hmm_lm.hmm_scores(nothing(spark), steps=1).collect() == []
