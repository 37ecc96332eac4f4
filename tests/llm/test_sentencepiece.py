import hashlib
import os
import random

import numpy as np
import pytest

from tests.llm.helpers import documents, nothing, sample_rows
from vectorloom.llm import sentencepiece_viterbi as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load()


def _plain(vocabulary, text):
    """Best total score by a search over the whole marked text, word by word from nothing."""
    score = {p: s for n, (p, s) in enumerate(zip(vocabulary.pieces, vocabulary.scores)) if n not in vocabulary.special}
    unknown = min(score.values()) - sp.UNKNOWN
    longest = max(map(len, score))
    text = sp.MARK + text.replace(" ", sp.MARK)
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for at in range(max(0, end - longest), end):
            s = score.get(text[at:end])
            if s is None and end - at == 1:
                s = unknown
            if s is not None:
                best[end] = max(best[end], best[at] + s)
    return best[-1]


def _total(vocabulary, ids):
    unknown = min(s for n, s in enumerate(vocabulary.scores) if n not in vocabulary.special) - sp.UNKNOWN
    total, raw = 0.0, b""
    for n in ids:
        if n in vocabulary.byte_ids:
            raw += bytes([vocabulary.byte_ids.index(n)])
            try:
                raw.decode()
            except UnicodeDecodeError:
                continue
            total, raw = total + unknown, b""
        else:
            total += vocabulary.scores[n]
    return total


def test_scores_are_the_best_possible(vocabulary):
    rng = random.Random(1)
    texts = ["", " ", "  two  spaces ", "the cat sat", "a\nb\n\nc", "naïve 漢字 \U0001d11e", "x" * 300, "ththe the thes then thenceforth"]
    texts += ["".join(rng.choice("aeiou thnsr.,é\n") for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    encoder = sp.Encoder(vocabulary)
    for text, packed in zip(texts, encoder.encode(texts)):
        ids = np.frombuffer(packed, np.int32).tolist()
        assert _total(vocabulary, ids) == (_plain(vocabulary, text) if text else 0)


def test_shared_prefixes_change_nothing(vocabulary):
    rng = random.Random(2)
    words = sorted({sp.MARK + "".join(rng.choice("then") for _ in range(rng.randrange(1, 12))) for _ in range(400)})
    together = dict(sp.Encoder(vocabulary).search(words))
    alone = {w: next(iter(sp.Encoder(vocabulary).search([w])))[1] for w in words[::7]}
    assert all(together[w] == ids for w, ids in alone.items())


def test_agrees_with_the_library(vocabulary):
    """The library's n-best search over the same pieces, as a unigram model."""
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(sp.MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ("the cat sat on the mat", "Is and retitioning ouen the of", "unbelievable thenceforth"):
        ids = np.frombuffer(sp.Encoder(vocabulary).encode([text])[0], np.int32).tolist()
        assert _total(vocabulary, ids) == _total(vocabulary, library.nbest_encode_as_ids(text, 4)[0])


def test_round_trip(spark, vocabulary):
    rows = sample_rows()
    got = sp.round_trip(documents(spark), vocabulary).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    assert sorted(r.text_sha256 for r in got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert sp.round_trip(nothing(spark), vocabulary).collect() == []


def test_encode_and_decode_keep_other_columns(spark, vocabulary):
    docs = documents(spark)
    encoded = sp.encode(docs, vocabulary)
    assert set(encoded.columns) == (set(docs.columns) - {"text"}) and dict(encoded.dtypes)["ids"] == "array<int>"
    texts = {r.doc_id: r.text for r in sp.decode(encoded, vocabulary).where("doc_id < 20").collect()}
    assert texts == {r[0]: r[1] or "" for r in sample_rows() if r[0] is not None and r[0] < 20}


def test_memory_of_words_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(sp, "CACHE", 10)
    encoder = sp.Encoder(vocabulary)
    for n in range(5):
        encoder.encode([" ".join(f"w{n}{k}" for k in range(8))])
        assert len(encoder.known) <= 10
