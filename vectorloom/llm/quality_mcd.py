"""Quality rules by robust multivariate outliers.

Every text becomes a vector of transformed statistics (length, word length, vocabulary, shares of symbols, capitals, punctuation, repeated
lines and repeated words). For every language and source a minimum covariance determinant estimate gives centre and scatter of the ordinary
texts: concentration steps from two deterministic starts, each keeping the COVERED share of rows that lie nearest, the start of the
smaller determinant going on until it stops falling, then one reweighting step. A text is rejected if its squared Mahalanobis distance
is beyond the chi-square quantile of TAIL. All steps use all rows; a step is two partial aggregations, so a source that holds most
rows is no single task's work, and the estimates (one row per group) stay tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.sizing import checkpointed, join_small, written

#: Share of the rows of a group that determines its estimate.
COVERED = 0.75
#: Groups with fewer rows are judged by the estimate of their whole language, small languages by that of all rows.
MIN_GROUP = 200
#: Probability of a larger distance for an ordinary text.
TAIL = 1e-9
#: Share of ordinary texts that the reweighting step uses.
REWEIGHTED = 0.975
#: Steps of each start, steps at most after the better one is chosen, and the fall of the log determinant that still counts.
START_STEPS, MAX_STEPS, FALL = 2, 10, 1e-3
#: Words of neutral text added to each document's shares, so that those of short texts scatter less.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 20, 100, 4
#: The statistics, and the scatter each has at least (its square is added to the variance, so estimates are never singular).
FLOORS = {
    "length": 0.1,
    "word_length": 0.03,
    "symbols": 0.03,
    "dup_lines": 0.15,
    "repeats": 0.15,
    "vocabulary": 0.05,
    "capitals": 0.03,
    "punctuation": 0.03,
}
NAMES = list(FLOORS)
P = len(NAMES)
_RANK_ACCURACY = 10_000
_MAX_BROADCAST_GROUPS = 50_000

# --- counts -----------------------------------------------------------------------------------

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_punct")
WINDOW = 5
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_PUNCTUATION = np.frombuffer(b".,;:!?\"'()-/", np.uint8)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


def _word_ids(raw: bytes) -> tuple[np.ndarray, int]:
    """Every word as the number of its first occurrence's word, and how many different ones there are. Exact; case counts."""
    names: dict[bytes, int] = {}
    found, at = [], 0
    while at < len(raw):  # long texts by pieces, so that only different words are held as objects
        cut = _SPACE_BYTE.search(raw, at + _PIECE)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()  # of bytes: at the six ASCII white space characters
        found.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
        at = end
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), len(names)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs, equal for equal pairs only."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].ravel()


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    window = ids[:n]
    for k in range(1, width):
        window = _paired(window, ids[k : k + n])
    starts = np.flatnonzero(np.bincount(window)[window] > 1)
    change = np.bincount(starts, minlength=len(ids) + 1) - np.bincount(starts + width, minlength=len(ids) + 1)
    return int((np.cumsum(change) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ids, distinct = _word_ids(raw)
    of_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(of_byte[0x80:0xC0].sum())
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return (
        len(ids), points - int(of_byte[_SPACE].sum()), int(of_byte[_SYMBOLS].sum()), duplicates, repeated_words(ids),
        distinct, lines, int(of_byte[65:91].sum()), int(of_byte[_PUNCTUATION].sum()),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = [text_counts(t.as_py()) for t in batch.column("text")]
        counts = [pa.array([r[k] for r in table], pa.int64()) for k in range(len(COUNTS))]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *counts], names=[*kept, *COUNTS])


def statistics() -> list[Column]:
    """The transformed statistics, from the counts."""
    words, chars = F.col("n_words") + PRIOR_WORDS, F.col("word_chars") + PRIOR_CHARS
    values = {
        "length": F.log(F.col("n_words") + 1),
        "word_length": F.log((F.col("word_chars") + PRIOR_CHARS) / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES)),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "vocabulary": F.log((F.col("n_distinct") + PRIOR_WORDS) / words),
        "capitals": F.sqrt((F.col("n_upper") + 0.02 * PRIOR_CHARS) / chars),
        "punctuation": F.sqrt((F.col("n_punct") + 0.03 * PRIOR_CHARS) / chars),
    }
    return [values[name].cast("double").alias(name) for name in NAMES]


# --- chi-square -------------------------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma function, by its series."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


# --- estimates --------------------------------------------------------------------------------

_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_ESTIMATE = "g string, n bigint, logdet double, centre array<double>, precision array<double>"


def _estimate(factor: float):
    """Sums of the rows of each group to centre, inverse scatter (upper triangle) and log determinant."""
    floors = np.diag([FLOORS[c] ** 2 for c in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                n = row["n"]
                centre = np.array(row["s"]) / n
                second = np.zeros((P, P))
                for (i, j), v in zip(_PAIRS, row["ss"]):
                    second[i, j] = second[j, i] = v / n
                scatter = (second - np.outer(centre, centre)) * factor + floors
                rows.append(_inverted(row["g"], n, centre, scatter))
            yield _estimates(rows)

    return run


def _inverted(g: str, n: int, centre: np.ndarray, scatter: np.ndarray) -> tuple:
    inverse = np.linalg.inv(scatter)
    return g, n, float(np.linalg.slogdet(scatter)[1]), centre.tolist(), [float(inverse[i, j]) for i, j in _PAIRS]


def _estimates(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    names = ["g", "n", "logdet", "centre", "precision"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _sums(rows: DataFrame, values: Sequence[Column]) -> DataFrame:
    """``(g, n, s, ss)``: partial aggregation of sums and sums of products."""
    named = rows.select("g", *[v.alias(f"v{k}") for k, v in enumerate(values)])
    sums = [F.sum(f"v{k}").alias(f"s{k}") for k in range(P)]
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"ss{i}_{j}") for i, j in _PAIRS]
    grouped = named.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    return grouped.select("g", "n", F.array(*[f"s{k}" for k in range(P)]).alias("s"), F.array(*[f"ss{i}_{j}" for i, j in _PAIRS]).alias("ss"))


def _fitted(rows: DataFrame, factor: float = 1.0) -> DataFrame:
    return written(_sums(rows, [F.col(c) for c in NAMES]).mapInArrow(_estimate(factor), _ESTIMATE))


def _measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Add ``d2``, the squared distance from the estimate of the row's group, which has to have one."""
    flat = estimates.select(
        "g",
        *[F.col("centre")[k].alias(f"_m{k}") for k in range(P)],
        *[F.col("precision")[k].alias(f"_p{k}") for k in range(len(_PAIRS))],
    )
    joined = join_small(rows, flat, ["g"], "length", max_rows=_MAX_BROADCAST_GROUPS)
    away = joined.withColumns({f"_d{k}": F.col(c) - F.col(f"_m{k}") for k, c in enumerate(NAMES)})
    terms = [F.col(f"_p{k}") * F.col(f"_d{i}") * F.col(f"_d{j}") * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return away.withColumn("d2", total).select(*rows.columns, "d2")


def _nearest(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """A concentration step: the estimate of the COVERED share of each group's rows that lie nearest to the one given."""
    measured = _measured(rows, estimates)
    bound = measured.groupBy("g").agg(F.percentile_approx("d2", COVERED, _RANK_ACCURACY).alias("bound"))
    return _fitted(join_small(measured, checkpointed(bound), ["g"], "length", max_rows=_MAX_BROADCAST_GROUPS).where("d2 <= bound"))


def _starts(rows: DataFrame) -> list[DataFrame]:
    """Two deterministic starts around the medians: independent statistics, and correlations of their squashed values."""
    median = checkpointed(rows.groupBy("g").agg(*[F.percentile_approx(c, 0.5, _RANK_ACCURACY).alias(f"_c{k}") for k, c in enumerate(NAMES)]))
    around = join_small(rows, median, ["g"], "length", max_rows=_MAX_BROADCAST_GROUPS)
    away = around.select("g", "length", *[F.abs(F.col(c) - F.col(f"_c{k}")).alias(f"a{k}") for k, c in enumerate(NAMES)])
    spread = away.groupBy("g").agg(*[F.percentile_approx(f"a{k}", 0.5, _RANK_ACCURACY).alias(f"_s{k}") for k in range(P)])
    frame = checkpointed(median.join(spread, "g").select("g", *[f"_c{k}" for k in range(P)], *[
        (F.sqrt((1.4826 * F.col(f"_s{k}")) ** 2 + FLOORS[c] ** 2)).alias(f"_s{k}") for k, c in enumerate(NAMES)
    ]))
    scaled = join_small(rows, frame, ["g"], "length", max_rows=_MAX_BROADCAST_GROUPS)
    squashed = _sums(scaled, [F.tanh((F.col(c) - F.col(f"_c{k}")) / F.col(f"_s{k}")) for k, c in enumerate(NAMES)])
    both = checkpointed(squashed.join(frame, "g"))
    return [checkpointed(both.mapInArrow(_started(correlated), _ESTIMATE)) for correlated in (False, True)]


def _started(correlated: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                centre, spread = (np.array([row[f"{name}{k}"] for k in range(P)]) for name in ("_c", "_s"))
                shape = np.eye(P)
                if correlated:
                    mean, second = np.array(row["s"]) / row["n"], np.zeros((P, P))
                    for (i, j), v in zip(_PAIRS, row["ss"]):
                        second[i, j] = second[j, i] = v / row["n"]
                    moments = second - np.outer(mean, mean) + 0.01 * np.eye(P)
                    width = np.sqrt(np.diag(moments))
                    shape = moments / np.outer(width, width)
                rows.append(_inverted(row["g"], row["n"], centre, shape * np.outer(spread, spread)))
            yield _estimates(rows)

    return run


def fit(rows: DataFrame) -> DataFrame:
    """Reweighted minimum covariance determinant estimates of ``rows (g, *NAMES)``: one row per ``g``."""
    fits = _starts(rows)
    for _ in range(START_STEPS):
        fits = [_nearest(rows, f) for f in fits]
    best = written(
        fits[0].unionByName(fits[1]).groupBy("g").agg(F.min_by(F.struct("n", "logdet", "centre", "precision"), "logdet").alias("e")).select("g", "e.*")
    )
    for _ in range(MAX_STEPS):
        after = _nearest(rows, best)
        fall = best.join(after.select("g", F.col("logdet").alias("now")), "g").agg(F.max(F.col("logdet") - F.col("now")).alias("most")).head().most
        best = after
        if fall is None or fall < FALL:
            break
    measured = _measured(rows, best)
    scale = measured.groupBy("g").agg((F.percentile_approx("d2", 0.5, _RANK_ACCURACY) / chi2_quantile(0.5, P)).alias("scale"))
    cut = chi2_quantile(REWEIGHTED, P)
    near = join_small(measured, checkpointed(scale), ["g"], "length", max_rows=_MAX_BROADCAST_GROUPS).where(F.col("d2") <= cut * F.col("scale"))
    return _fitted(near, REWEIGHTED / chi2_cdf(cut, P + 2))


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """``(lang, source, g, also)``: the group whose estimate judges the rows of a language and source, and all groups they are part of."""
    pairs = checkpointed(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    of_lang = pairs.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.max((F.col("n") < min_group).cast("int")).alias("poor"))
    joined = pairs.join(of_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    level = F.when(F.col("n") >= min_group, 0).when(F.col("n_lang") >= min_group, 1).otherwise(2)
    levels = checkpointed(joined.withColumn("level", level))
    whole = levels.where("level = 2").head() is not None
    names = [F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("all")]
    also = F.array_compact(
        F.array(
            F.when(F.col("level") == 0, names[0]),
            F.when((F.col("poor") == 1) & (F.col("n_lang") >= min_group), names[1]),
            F.when(F.lit(whole), names[2]),
        )
    )
    own = F.when(F.col("level") == 0, names[0]).when(F.col("level") == 1, names[1]).otherwise(names[2])
    return levels.select("lang", "source", own.alias("g"), also.alias("also"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP
) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)``, one row per document.

    ``base_failed``: fewer than ten words, or more than a fifth of them in repeated windows of five; such texts take no part in the
    estimates, have no distance and aren't kept. Others are kept unless their squared distance is beyond the cut.

    A null text has no words; null languages and sources are values of their own. Groups of fewer than ``min_group`` rows are judged by
    their language, small languages by all rows together; with a handful of rows in all, the smallest scatter (FLOORS) still gives an
    estimate. Repeated rows and ids are rows like others. Only the four columns are read, whatever others there are; an empty table
    gives an empty result.
    """
    read = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"),
    )
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    counted = checkpointed(read.mapInArrow(_count, schema))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    ordinary = judged.where("NOT base_failed").select("lang", "source", *statistics())
    groups = checkpointed(_groups(ordinary, min_group))
    members = join_small(ordinary, groups.select("lang", "source", "also"), ["lang", "source"], "length", null_safe=True)
    estimates = fit(members.select(F.explode("also").alias("g"), *NAMES))
    own = judged.select("*", *statistics())
    own = join_small(own, groups.select("lang", "source", "g"), ["lang", "source"], "length", "left", null_safe=True)
    passed = _measured(own.where("NOT base_failed"), estimates).withColumn("kept", F.col("d2") <= chi2_quantile(1 - TAIL, P))
    rest = own.where("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return passed.unionByName(rest).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.col("d2").alias("distance"))
