import re

import numpy as np
import pytest

from tests.llm.helpers import documents, nothing, prose, sample_rows
from vectorloom.llm import mixing


def _targets(rows):
    size = {}
    for _, text, _, source, _ in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: 1 + n % 3 for n, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(size.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return size, target | share
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
            open_.discard(s)
    return size, target


def _check(rows, got, slack):
    size, target = _targets(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= slack


def test_targets_and_totals(spark):
    rows = [(i, prose(i, 20 + i % 60), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(900)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    _check(rows, got, slack=3)
    small = mixing.mix_sources(documents(spark, rows), block=16).collect()
    _check(rows, small, slack=60)
    again = mixing.mix_sources(documents(spark, rows, partitions=7), block=16).collect()
    assert {(r.doc_id, r.copies) for r in small} == {(r.doc_id, r.copies) for r in again}


def test_joined_targets_are_the_same(spark, monkeypatch):
    rows = [(i, prose(i, 5 + i % 9), "en", f"s{i % 3}" if i % 5 else None, 1) for i in range(60)]
    one = {(r.doc_id, r.target, r.copies) for r in mixing.mix_sources(documents(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert {(r.doc_id, r.target, r.copies) for r in mixing.mix_sources(documents(spark, rows)).collect()} == one


def test_a_source_stops_at_three_times_its_size(spark):
    rows = [(i, prose(i, 50), "en", "a", 1) for i in range(40)] + [(100, "only three words", "en", "b", 1), (101, "", "en", "empty", 1)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    _check(rows, got, slack=50)
    assert {r.taken for r in got if r.source == "b"} == {9}


def test_edge_rows(spark):
    rows = sample_rows()
    _check(rows, mixing.mix_sources(documents(spark)).collect(), slack=max(len((r[1] or "").split()) for r in rows))


def test_documents_are_repeated(spark):
    docs = documents(spark)
    taken = mixing.mix_sources(docs).collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count, want = {}, {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    for r in taken:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert count == {k: v for k, v in want.items() if v}


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 500, 60)
    p = rng.random(60)
    mean = np.zeros(60)
    for n in range(600):
        x = mixing.flight(p, size, np.random.Generator(np.random.PCG64(n)))
        assert ((x > 0) & (x < 1)).sum() <= 2
        assert abs((x - p).sum()) < 1e-6 and abs(((x - p) * size).sum()) < 1e-4
        mean += x / 600
    assert np.abs(mean - p).max() < 0.12


def test_empty_table(spark):
    assert mixing.mix_sources(nothing(spark)).collect() == []
    assert mixing.mixed_documents(nothing(spark)).collect() == []
