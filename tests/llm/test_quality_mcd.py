from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest

from tests.llm.helpers import documents, nothing, sample_rows
from vectorloom.llm import quality_mcd as qm


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup, seen = 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts():
    rng = random.Random(2)
    some = [None, "", " \n\t", "one", "a b c d e a b c d e", "a a a a a a a", "x\n \nx\nx \n\n\nx", "naïve ▁ 漢字     x | # <b> A a A a"]
    some += [" ".join(rng.choices("abcABC", k=rng.randrange(60))) for _ in range(80)]
    some += ["\n".join(rng.choices(["l 1", "l 2", "", " ", "L 1"], k=rng.randrange(30))) for _ in range(30)]
    return some


def test_counts_against_plain_ones():
    for text in texts():
        assert qm.text_counts(text)[:5] == brute_counts(text), text


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(qm, "_PIECE", 7)
    for text in texts():
        assert qm.text_counts(text)[:5] == brute_counts(text), text


@pytest.mark.parametrize("k", [1, 2, 8, 10])
def test_chi_square(k):
    for q in (0.5, 0.975, 1 - 1e-9):
        assert abs(qm.chi2_cdf(qm.chi2_quantile(q, k), k) - q) < 1e-12
    assert abs(qm.chi2_quantile(0.975, 1) - 5.0238861873) < 1e-8 and abs(qm.chi2_quantile(0.95, 8) - 15.5073130559) < 1e-8


def vector(text):
    n, chars, symbols, dup, rep, distinct, lines, upper, punct = qm.text_counts(text)
    w, c = n + 20, chars + 100
    return [
        np.log(n + 1), np.log(c / w), np.sqrt(symbols / c), np.sqrt(dup / (lines + 4)), np.sqrt(rep / w), np.log((distinct + 20) / w),
        np.sqrt((upper + 2) / c), np.sqrt((punct + 3) / c),
    ]


def brute_distances(x):
    """The estimate of one group with exact order statistics."""
    floors = np.diag(np.array(list(qm.FLOORS.values())) ** 2)
    p, n = x.shape[1], len(x)

    def rank(v, q):
        return np.sort(v)[max(0, int(np.ceil(q * n)) - 1)]

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def estimate(rows, factor=1.0):
        return rows.mean(0), np.cov(rows.T, bias=True).reshape(p, p) * factor + floors

    m = np.array([rank(x[:, k], 0.5) for k in range(p)])
    s = np.sqrt((1.4826 * np.array([rank(abs(x[:, k] - m[k]), 0.5) for k in range(p)])) ** 2 + np.diag(floors))
    t = np.cov(np.tanh((x - m) / s).T, bias=True) + 0.01 * np.eye(p)
    width = np.sqrt(np.diag(t))
    fits = []
    for c in (np.diag(s**2), t / np.outer(width, width) * np.outer(s, s)):
        fit = (m, c)
        for _ in range(qm.START_STEPS):
            d = distance(*fit)
            fit = estimate(x[d <= rank(d, qm.COVERED)])
        fits.append(fit)
    best = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
    for _ in range(qm.MAX_STEPS):
        d = distance(*best)
        after = estimate(x[d <= rank(d, qm.COVERED)])
        fall = np.linalg.slogdet(best[1])[1] - np.linalg.slogdet(after[1])[1]
        best = after
        if fall < qm.FALL:
            break
    d = distance(*best)
    cut = qm.chi2_quantile(qm.REWEIGHTED, p)
    near = d <= cut * rank(d, 0.5) / qm.chi2_quantile(0.5, p)
    return distance(*estimate(x[near], qm.REWEIGHTED / qm.chi2_cdf(cut, p + 2)))


def corpus(n=900, seed=1):
    """Two sources of ordinary texts, a tenth of them spoilt; few texts of a third source and of a second language."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000)]
    rows, spoilt = [], set()
    for i in range(n):
        text = ". ".join(" ".join(rng.choices(words, k=rng.randrange(5, 15))).capitalize() for _ in range(rng.randrange(3, 40)))
        lang, source = ("en", ["a", "b"][i % 2]) if i % 30 else (rng.choice(["en", None]), "rare")
        if i % 10 == 3:
            spoilt.add(i)
            text = [text.upper() + "!!", re.sub(" ", "### ", text), re.sub(" ", "|x ", text)][i % 3]
        rows.append((i, text, lang, source, 1))
    return rows, spoilt


def test_spoilt_texts_go_and_others_stay(spark):
    rows, spoilt = corpus()
    got = {r.doc_id: r for r in qm.quality_rules(documents(spark, rows)).collect()}
    assert {i for i, r in got.items() if not r.kept} == spoilt
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())


def test_distances_against_an_exact_estimate(spark):
    rows, _ = corpus()
    got = {r.doc_id: r.distance for r in qm.quality_rules(documents(spark, rows)).collect()}
    groups = {"a": [r for r in rows if r[2:4] == ("en", "a")], "b": [r for r in rows if r[2:4] == ("en", "b")]}
    for members in groups.values():
        want = brute_distances(np.array([vector(r[1]) for r in members]))
        assert np.allclose([got[r[0]] for r in members], want, rtol=1e-6)
    whole = brute_distances(np.array([vector(r[1]) for r in rows]))  # judges the language of too few rows
    few = [i for i, r in enumerate(rows) if r[2] is None]
    assert few and np.allclose([got[rows[i][0]] for i in few], whole[few], rtol=1e-6)
    english = [r for r in rows if r[2] == "en"]
    of_language = dict(zip((r[0] for r in english), brute_distances(np.array([vector(r[1]) for r in english]))))
    rare = [r[0] for r in english if r[3] == "rare"]
    assert rare and np.allclose([got[i] for i in rare], [of_language[i] for i in rare], rtol=1e-6)


def test_awkward_rows(spark):
    got = qm.quality_rules(documents(spark)).collect()
    assert got[0].__fields__ == ["doc_id", *qm.COUNTS[:5], "base_failed", "kept", "distance"]
    want = []
    for doc_id, text, *_ in sample_rows():
        counts = brute_counts(text)
        want.append((doc_id, *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all(not r.kept and r.distance is None for r in got if r.base_failed)
    assert qm.quality_rules(nothing(spark)).collect() == []
    [one] = qm.quality_rules(documents(spark, [(1, "one two three four five six seven eight nine ten", None, None, 1)])).collect()
    assert one.kept and not one.base_failed


def test_labelled_quality_of_the_given_table(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("tables not at hand")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = qm.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    poor = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in poor) <= 0.05 * len(poor)
