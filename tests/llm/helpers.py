"""Small tables for the tests of the training-data operators, and brute-force versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

#: Names that operators use inside, as columns of the input.
CLASHING = ["rid", "digest", "kept", "row", "ids", "g", "component", "copies", "winner", "text_sha256", "target", "label", "n", "score"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


def varied(text: str, seed: int, changes: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return " ".join(words)


def sample_rows() -> list[tuple]:
    """Documents with nulls, empty and very long texts, copies, near copies, ties and repeated rows."""
    base = prose(1, 300)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t\n ", "en", None, 5),
        (4, "Two words", None, "b", 9),
        (5, "two  WORDS", "en", "b", 10),
        (6, "one", "en", "c", 3),
        (None, "without an id " + base, "en", "c", 1),
        (None, "without an id " + base, "en", "c", 1),
        (7, prose(2, 30_000), "en", "a", 1),
        (8, "naïve ▁mark \U0001d11e 漢字 ퟿ <|im_end|> $$$", "fr", "ü", 1),
        (9, "line one is here today\nline two is there\n\nline one is here today", "en", "b", 1),
    ]
    rows += [(20 + i, base, "en", "a", 1) for i in range(6)]
    rows += [(40 + i, varied(base, i, 1 + i), "en", "b", 1) for i in range(12)]
    rows += [(60 + i, prose(100 + i, 40 + 7 * i), "de", None if i % 5 == 0 else "c", 1) for i in range(25)]
    rows += [(60, prose(100, 40), "de", None, 1)] * 2 + [(60, prose(7, 9), "de", "c", 1)]
    return rows


def documents(spark, rows=None, extra: bool = True, partitions: int = 3):
    df = spark.createDataFrame(sample_rows() if rows is None else rows, SCHEMA).repartition(partitions)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if extra else df


def nothing(spark):
    return documents(spark, [])


def tokens(text: str | None) -> list[bytes]:
    """Words: runs of bytes other than ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    w = tokens(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def classes(n: int, linked) -> list[int]:
    """Smallest member of the component of each of n nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
