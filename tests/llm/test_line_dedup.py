import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, nothing, sample_rows, tokens
from vectorloom.llm import line_dedup as ld


def _brute(rows):
    """Kept line numbers by (id, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    kept, earlier = {}, []
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}, key=key):
        own = kept.setdefault((doc_id, text), [])
        for n, line in enumerate(text.split("\n")):
            words = frozenset(tokens(line))
            if not words:
                continue
            if not any(5 * len(words & e) >= 4 * len(words | e) for e in earlier):
                own.append(n)
            earlier.append(words)
    return kept


def _lines(seed, n):
    rng = random.Random(seed)
    pool = [" ".join(f"x{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    out = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = rng.choice(pool).split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(60)}"
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(words))
            if rng.random() < 0.2:
                lines.append("")
        out.append((doc, "\n".join(lines), "en", "a", 1))
    return out


def _check(rows, got):
    want = _brute(rows)
    by_id = {}
    for (doc_id, text), kept in want.items():
        by_id.setdefault(doc_id, []).append((len(text.split("\n")) if text else 0, kept))
    for r in got:
        assert (r.n_lines, r.kept_lines) in by_id[r.doc_id]
    assert len(got) == len(rows)


@pytest.mark.parametrize("meet,block", [(4096, 512), (4, 3)])
def test_lines_against_brute_force(spark, monkeypatch, meet, block):
    monkeypatch.setattr(ld, "MEET", meet)
    monkeypatch.setattr(ld, "SET_BLOCK", block)
    rows = _lines(3, 60)
    _check(rows, ld.line_dedup(documents(spark, rows)).collect())


def test_edge_rows(spark):
    # rows of one id with different texts have an undefined order here, so they are left out
    rows = [r for r in sample_rows() if r[0] != 60 and r[0] is not None]
    got = ld.line_dedup(documents(spark, rows)).collect()
    _check(rows, got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_lines == 0 and by_id[3].kept_lines == [] and by_id[9].kept_lines == [0, 1] and by_id[9].n_removed == 1


def test_texts_without_repeated_lines(spark):
    rows = [(1, "a b c d e\n\nf", "en", "a", 1), (2, "x\nA B C D E\nf", "en", "a", 1), (3, None, "en", "a", 1)]
    docs = documents(spark, rows)
    out = ld.without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a b c d e\n\nf", 2: "x", 3: ""}


def test_empty_table(spark):
    assert ld.line_dedup(nothing(spark)).collect() == []


def test_prefixes_are_long_enough():
    n = np.arange(1, 200)
    p = ld.prefix_length(n)
    assert (p[:3] == 0).all()  # one to three words: only an equal set reaches 0.8
    for a in range(4, 200):
        assert a - p[a - 1] + 1 == -(-4 * a // 5)


def test_bitmaps_never_drop_a_pair():
    rng = np.random.default_rng(1)
    for n in (4, 30, 60, 200, 900):
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            sets = [np.sort(rng.choice(pool, n, replace=False)) for _ in range(2)]
            lines = ld.Lines.__new__(ld.Lines)
            lines.words, lines.size = np.concatenate(sets), np.array([n, n])
            maps, width = ld._bitmaps(lines)
            folded = ld._folded(maps, np.cumsum(width) - width, width)
            unlike = len(np.setxor1d(*sets))
            assert ld._different(folded, width, np.array([0]), np.array([1]), np.array([10**6]))[0] <= unlike


def test_copies_of_a_line_are_dealt_out_once():
    """Lines of the same words that are read together send one record to a bucket."""
    text = "\n".join(f"{'abcdefghij'[i % 10]} one two three four five six seven" for i in range(200))
    batch = pa.record_batch([pa.array([1, 2]), pa.array([text, text])], names=["doc_id", "text"])
    rarity = np.full(1 << ld.RARITY_BITS, 2, np.int64)
    dealt = pa.Table.from_batches(ld._entries(rarity, 16)([batch]))
    for lines in dealt.column("lines").to_pylist():
        digests = np.frombuffer(lines, ld._LINE)["digest"]
        assert len(set(digests.tolist())) == len(digests) <= 10
