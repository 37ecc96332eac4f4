import hashlib

from tests.llm.helpers import classes, documents, prose, shingle_set

import corpus_pipeline


def test_stages_in_order(spark, tmp_path):
    """Every stage but the last keeps the columns; the whole run equals the stages' decisions made by hand."""
    rows = [(i, prose(i, 60, 3000), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], "en", "s0", 1) for i in range(4)]  # copies
    rows += [(200 + i, rows[5][1] + f" tail{i}", "en", "s1", 1) for i in range(3)]  # near copies
    documents(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "sentencepiece"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = sorted(r.doc_id for r in docs.collect())
        if name == "toxicity":  # no toxic label
            assert ids == sorted(left)
        elif name == "exact_dedup":
            left = {i: r for i, r in left.items() if i != 3 and not 100 <= i < 103}
            assert ids == sorted(left)
        elif name == "ngram_jaccard_join":
            known = sorted(left)
            sets = [shingle_set(left[i][1]) for i in known]
            linked = [(a, b) for a in range(len(known)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            left = {known[c]: left[known[c]] for c in classes(len(known), linked)}
            assert ids == sorted(left) and not {200, 201, 202} & set(ids)
        else:
            assert set(ids) <= set(left)
    mixed = ids
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == mixed and all(r.exact for r in got)
    assert all(r.text_sha256 == hashlib.sha256(left[r.doc_id][1].encode()).hexdigest() for r in got)
