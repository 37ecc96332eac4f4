import hashlib

from tests.llm.helpers import documents, nothing, sample_rows
from vectorloom.llm.exact_dedup import drop_copies, exact_dedup


def _expected():
    groups = {}
    for doc_id, text, *_ in sample_rows():
        groups.setdefault(text or "", []).append(doc_id)
    return groups


def _check(rows):
    groups = _expected()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == len(sample_rows())
    for sha, ids in by_sha.items():
        own = [r for r in rows if r.text_sha256 == sha]
        known = [i for i in ids if i is not None]
        assert len(own) == len(ids) and {r.group_size for r in own} == {len(ids)}
        assert {r.keep_id for r in own} == {max(known) if known else None}
        assert [r.doc_id for r in own if r.kept] == [max(known) if known else None]


def test_all_copies_are_found(spark):
    _check(exact_dedup(documents(spark)).collect())


def test_heavy_and_light_digests_agree(spark):
    docs = documents(spark)
    _check(exact_dedup(docs, heavy=4, tracked=64).collect())  # groups of 12 rows or more are heavy
    _check(exact_dedup(docs, heavy=30, tracked=64).collect())  # most are


def test_kept_documents_have_all_columns(spark):
    docs = documents(spark)
    for heavy in (4, 30, 1024):
        kept = drop_copies(docs, heavy=heavy, tracked=max(64, heavy))
        assert kept.columns == docs.columns
        rows = kept.collect()
        groups = _expected()
        assert len(rows) == len(groups)
        for r in rows:
            known = [i for i in groups[r.text or ""] if i is not None]
            assert r.doc_id == (max(known) if known else None) and r.kept == "own kept"


def test_empty_table(spark):
    assert exact_dedup(nothing(spark)).collect() == []
    assert drop_copies(nothing(spark)).collect() == []


def test_native(spark):
    plan = exact_dedup(documents(spark, extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
