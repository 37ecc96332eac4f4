from itertools import combinations

import numpy as np
import pytest

from tests.llm.helpers import classes, documents, nothing, prose, sample_rows, shingle_set, varied
from vectorloom.llm import ngram_join as nj


def _brute(rows):
    sets = [shingle_set(r[1]) for r in rows]
    linked = [
        (a, b)
        for a, b in combinations(range(len(rows)), 2)
        if sets[a] == sets[b] or (sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    ]
    return sets, linked, classes(len(rows), linked)


def _check(rows, got):
    sets, linked, component = _brute(rows)
    key = lambda i: (i is not None, i or 0)
    want = []
    for n, (doc_id, *_) in enumerate(rows):
        own = [b if a == n else a for a, b in linked if n in (a, b)]
        members = [rows[m][0] for m in range(len(rows)) if component[m] == component[n]]
        copies = [rows[m][0] for m in range(len(rows)) if sets[m] == sets[n]]
        others = {sets[m] for m in own} - {sets[n]}
        want.append((doc_id, min(copies, key=key), min(members, key=key), len(members), len(own), len(others)))
    found = [(r.doc_id, r.copy_id, r.class_id, r.class_size, r.n_links, r.n_class_links) for r in got]
    order = lambda t: tuple(key(x) for x in t)
    assert sorted(found, key=order) == sorted(want, key=order)


def test_links_and_classes(spark):
    rows = sample_rows()
    _check(rows, nj.ngram_jaccard_join(documents(spark)).collect())


@pytest.mark.parametrize("block", [3, 2048])
def test_a_large_group_is_cut_into_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BUCKET_BLOCK", block)
    monkeypatch.setattr(nj, "SET_BLOCK", block)
    base = prose(5, 200, 5000)
    rows = [(i, varied(base, i, i % 9), "en", "a", 1) for i in range(40)]
    _check(rows, nj.ngram_jaccard_join(documents(spark, rows)).collect())


def test_kept_documents(spark):
    docs = documents(spark)
    kept = nj.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    _, _, component = _brute(sample_rows())
    assert len(rows) == len(set(component))
    assert {r.kept for r in rows} == {"own kept"}


def test_empty_table(spark):
    assert nj.ngram_jaccard_join(nothing(spark)).collect() == []
    assert nj.drop_near_copies(nothing(spark)).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    """With m agreements among n values the posterior is a binomial tail; a pair is dropped only below the tolerance."""
    least = nj.least_agreements()
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(200):
        a = rng.integers(0, 2**32, (1, nj.VALUES), dtype=np.uint32)
        b = np.where(rng.random((500, nj.VALUES)) < 0.8, a, rng.integers(0, 2**32, (500, nj.VALUES), dtype=np.uint32)).astype(np.uint32)
        lost += 500 - len(nj.plausible(a, b))
    assert lost == 0 and least == sorted(least)
    unlike = rng.integers(0, 2**32, (100, nj.VALUES), dtype=np.uint32)
    assert len(nj.plausible(a, unlike)) == 0


def test_minhash_estimates_similarity(spark):
    rng = np.random.default_rng(2)
    common, own = rng.integers(0, 2**63, 600, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.concatenate((common, own[:200])), np.concatenate((common, own[200:]))
    sig = nj.minhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
