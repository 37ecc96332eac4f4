from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import pytest

from tests.llm.helpers import documents, nothing, sample_rows
from vectorloom.llm import merkle_log as ml


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row) -> str:
    doc_id, text, lang, source, n_chars = row
    out = ""
    for v in (doc_id, source, lang, n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode('utf-8'))}:{v}"
    return sha(out)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def way(levels, i):
    steps = []
    for level in levels[:-1]:
        run = i - i % 3
        steps.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return steps


def brute(rows):
    """The contract, one row after the other."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = ordered, levels_of([leaf_of(r) for r in ordered])
    over = levels_of([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        ordered, levels = trees[s]
        for i, row in enumerate(ordered):
            steps = way(levels, i) + way(over, k)
            shown = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                shown = (row[0], row[1].replace("\n", ""), *row[2:])
            node = leaf_of(shown)
            for left, right in steps:
                node = sha(left + node + right)
            root = over[-1][0]
            proof = sha("".join(left + right for left, right in steps))
            out.append((row[0], leaf_of(row), levels[-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equals_the_contract(spark, levels):
    got = ml.verified_manifest(documents(spark), levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute(sample_rows())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_around_full_trees(spark, n):
    rows = [(7 * i, f"text\n{i}", "en", "only", i) for i in range(n)]
    got = ml.verified_manifest(documents(spark, rows), levels=1).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert n < 9 or {r.verified for r in got} == {True, False}


def test_empty_table(spark):
    assert ml.verified_manifest(nothing(spark)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 9, 10, 26, 27, 28, 82])
def test_places_are_the_order_of_completion(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = ml.height(n)
    log, whole = ml.postorder_log(leaves, levels), levels_of(leaves)
    for level, nodes in enumerate(whole):
        assert [log[ml.place(level, j, n, levels)] for j in range(len(nodes))] == nodes
    assert len(log) == sum(map(len, whole))


def test_log_of_blocks_is_the_log_of_the_whole_tree(spark):
    leaves = [sha(str(i)) for i in range(40)]
    df = spark.createDataFrame([("t", i, h, 40) for i, h in enumerate(leaves)], "tree string, i bigint, hash string, n bigint")
    tiers = ml.build_logs(df, levels=2)
    assert len(tiers) == 2
    log = sorted(ml.log_entries(tiers, levels=2).collect(), key=lambda r: r.position)
    assert [r.position for r in log] == list(range(len(log)))
    assert [r.hash for r in log] == ml.postorder_log(leaves, ml.height(40))


def test_a_changed_row_fails_and_no_other(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(1, 30)]
    proven = ml.merkle_manifest(documents(spark, rows), levels=2).collect()
    for r in proven:
        assert len({r.root for r in proven}) == 1
        node = r.leaf if r.doc_id != 5 else sha("other")
        for step in r.path:
            node = sha(step.left + node + step.right)
        assert (node == r.root) == (r.doc_id != 5)


def test_whole_table_against_the_contract(spark):
    table = "/root/testdata/sf0.001/documents.parquet"
    if not Path(table).exists():
        pytest.skip("tables not at hand")
    df = spark.read.parquet(table)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, ml.verified_manifest(df).collect()), key=str) == brute(rows)
