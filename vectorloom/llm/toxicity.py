"""Toxicity by weak supervision.

Labelled rows propose many voters: words (a lexicon) and word beginnings (patterns) that toxic documents hold far more often. A
generative label model estimates by expectation-maximisation how often each voter fires on toxic and on clean documents, over all
documents that may be learned from, and the correlations of the voters given the class, so that voters which repeat each other count
less. A linear classifier is trained on the posterior labels and gives the score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.sizing import SMALL_ROWS, checkpointed

#: Labelled rows of each class that propose voters (the expected size of a sample by id hash); it bounds the labels that are broadcast.
LABELLED = 20_000
#: Lengths of the word beginnings that are tried as patterns.
PREFIXES = (4, 5)
#: A voter needs this many toxic labelled documents, and this lift of its rate among toxic over clean ones.
MIN_TOXIC, MIN_LIFT = 3, 4.0
#: And a log-likelihood ratio that reaches the logarithm of the number of terms tried less this, so that few are there by chance.
MARGIN = 1.0
EM_STEPS = 6
#: Descent steps of the classifier at most, the step pairs it remembers, and the relative gain at which it stops.
STEPS, MEMORY, GAIN = 20, 8, 1e-4
#: Voters whose correlation among toxic documents is at least this say the same thing and share their weight.
REPEATS = 0.5
#: How often a given label is right (it is one more voter of its row), the weight of all other rows together against all labelled ones, and the classifier's ridge.
LABEL_ACCURACY, OTHERS, RIDGE = 0.97, 0.5, 0.3
_WORD = re.compile(r"\w+")
_CACHE = 100_000


def held_out(id_col: str, remainder: int = 0) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def terms(token: str) -> list[str]:
    """The words in a token and their beginnings; a term's first character tells its kind."""
    found = []
    for word in _WORD.findall(token.lower()):
        found.append("=" + word)
        found += ["^" + word[:n] for n in PREFIXES if len(word) > n]
    return found


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to partial document counts (term, toxic, clean)."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
            names=["term", "toxic", "clean"],
        )
        counts.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for term in {t for token in set((text or "").split()) for t in terms(token)}:
                counts[term][toxic] += 1
            if len(counts) > _CACHE:
                yield flush()
    if counts:
        yield flush()


def propose_voters(labelled: DataFrame) -> list[str]:
    """All terms of rows ``(text, toxic)`` that speak for toxic documents beyond chance, by log-likelihood ratio.

    Their number is bounded by the terms of the labelled rows, and so by LABELLED; counting is a partial aggregation.
    """
    totals = labelled.groupBy().agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).head()
    toxic = float(totals.toxic or 0)
    clean = float(totals.n) - toxic
    if not toxic:
        return []
    counts = labelled.mapInArrow(_count_terms, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")
    )
    lift = ((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (clean + 1))
    n = F.col("a") + F.col("b")

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    share = toxic / (toxic + clean)
    gain = (
        part(F.col("a"), n * share)
        + part(F.col("b"), n * (1 - share))
        + part(F.lit(toxic) - F.col("a"), (toxic + clean - n) * share)
        + part(F.lit(clean) - F.col("b"), (toxic + clean - n) * (1 - share))
    )
    # a voter that is nearly a third of all documents says nothing of its own; the lift excludes it
    tried = checkpointed(counts.where(f"a >= {MIN_TOXIC}"))
    least = math.log(max(1, tried.count())) - MARGIN
    best = tried.where(lift >= MIN_LIFT).withColumn("gain", F.round(gain, 6)).where(F.col("gain") >= least)
    ranked = best.orderBy(F.desc("gain"), F.length("term"), "term").collect()
    # a beginning that fires on as many documents as one of its words, or the other way round, is the same voter
    seen: set[tuple] = set()
    chosen = []
    for r in ranked:
        name = (r.term[1 : 1 + min(PREFIXES)], r.a, r.b)
        if name not in seen:
            seen.add(name)
            chosen.append(r.term)
    return chosen


class _Lookup(dict):
    """Token to the numbers of the voters it fires; bounded."""

    def __init__(self, voters: list[str]):
        super().__init__()
        self.numbers = {t: n for n, t in enumerate(voters)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > _CACHE:
            self.clear()
        found = self[token] = tuple(self.numbers[t] for t in terms(token) if t in self.numbers)
        return found


def _cast_votes(voters: list[str], carried: tuple[str, ...] = ()):
    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(voters)
        for batch in batches:
            ids, counts, length = [], [], []
            for text in batch.column("text"):
                tokens = (text.as_py() or "").split()
                hits = [n for found in map(lookup.__getitem__, tokens) if found for n in found]
                number, count = np.unique(np.array(hits, np.int64), return_counts=True)
                ids.append(number)
                counts.append(count)
                length.append(len(tokens))
            rest = [batch.column(c) for c in ("doc_id", "held_out", "label", *carried)]
            yield pa.RecordBatch.from_arrays(
                rest + [pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(length, pa.int64())],
                names=["doc_id", "held_out", "label", *carried, "voters", "counts", "n_tokens"],
            )

    return cast


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every list element."""
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _fired(batch: pa.RecordBatch, terms_: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and voter of every vote: a term votes once if it occurs, and as voter ``terms_ + number`` if it occurs again."""
    row, voter = _sparse(batch.column("voters"))
    again = _sparse(batch.column("counts"))[1] > 1
    return np.concatenate((row, row[again])), np.concatenate((voter, voter[again] + terms_))


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    """Given labels, NaN where there is none."""
    return batch.column("label").to_numpy(zero_copy_only=False).astype(float)


class LabelModel:
    """Rates of each voter given the class, the class balance, a discount for voters that repeat others, and the weight of rows without a label."""

    def __init__(self, balance: float, toxic: np.ndarray, clean: np.ndarray, discount: np.ndarray, others: float):
        self.balance, self.toxic, self.clean, self.discount, self.others = balance, toxic, clean, discount, others

    def posterior(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each row by the votes, its label among them if it has one, and the row's weight."""
        silent = self.discount * np.log((1 - self.toxic) / (1 - self.clean))
        fired = self.discount * np.log(self.toxic / self.clean) - silent
        row, voter = _fired(batch, len(self.toxic) // 2)
        logit = np.full(batch.num_rows, np.log(self.balance / (1 - self.balance)) + silent.sum())
        np.add.at(logit, row, fired[voter])
        label = _labels(batch)
        known = ~np.isnan(label)
        logit[known] += np.where(label[known] > 0.5, 1.0, -1.0) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), np.where(known, 1.0, self.others)


_PIECE = 1024  # numbers that are added up together


def _sums(rows: DataFrame, size: int, function) -> np.ndarray:
    """The sum over all tasks of the (2, size) arrays that ``function`` makes of a task's batches.

    Tasks send their arrays in pieces, so few rows are shuffled whatever the size, and a piece is added up by one task.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(function(batches))
        yield _packed({n: flat[n * _PIECE : (n + 1) * _PIECE] for n in range(-(-len(flat) // _PIECE))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist()):
                totals[piece] = totals.get(piece, 0.0) + np.frombuffer(part)
        yield _packed(totals)

    kind = "piece int, sums binary"
    summed = rows.mapInArrow(pieces, kind).repartition("piece").sortWithinPartitions("piece", "sums").mapInArrow(added, kind)
    total = np.zeros(2 * size)
    for r in summed.collect():
        part = np.frombuffer(r.sums)
        total[r.piece * _PIECE : r.piece * _PIECE + len(part)] = part
    return total.reshape(2, size)


def _packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["piece", "sums"])


def _table(i, j, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(i, np.int32)), pa.array(np.asarray(j, np.int32)), pa.array(np.asarray(a, float)), pa.array(np.asarray(b, float))],
        names=["i", "j", "a", "b"],
    )


def fit_label_model(votes: DataFrame, voters: int, start: LabelModel, steps: int = EM_STEPS) -> LabelModel:
    """Expectation-maximisation over ``votes``; each step sums expected counts over partitions.

    Correlations given the class are taken before the last step (:func:`_repeats`), which then counts voters that repeat each other less.
    """
    model = start
    for step in range(steps):

        def expected(batches, model=model):
            once = np.zeros((2, voters + 1))
            for batch in batches:
                p, weight = model.posterior(batch)
                row, voter = _fired(batch, voters // 2)
                for y, q in ((1, p * weight), (0, (1 - p) * weight)):
                    once[y, :voters] += np.bincount(voter, q[row], voters)
                    once[y, voters] += q.sum()
            return once[::-1]

        sums = _sums(votes, voters + 1, expected)
        n1, n0 = sums[:, -1]
        toxic, clean = (sums[0, :-1] + 0.1) / (n1 + 0.2), (sums[1, :-1] + 0.1) / (n0 + 0.2)
        discount = 1 / (1 + _repeats(votes, voters, model, toxic, n1)) if step == steps - 2 else model.discount
        balance = float(np.clip((n1 + 0.5) / (n1 + n0 + 1), 1e-6, 1 - 1e-6))
        model = LabelModel(balance, toxic, clean, discount, model.others)
    return model


_PAIRS_AT_ONCE = 1 << 21


def _repeats(votes: DataFrame, voters: int, model: LabelModel, toxic: np.ndarray, n1: float) -> np.ndarray:
    """For each voter the sum of its correlations of REPEATS or more with other voters among toxic documents.

    Only pairs that fire together are counted, as rows of a table; what comes back is one number per voter.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, weight = model.posterior(batch)
            row, voter = _fired(batch, voters // 2)
            order = np.lexsort((voter, row))
            row, voter = row[order], voter[order]
            # every vote with the later ones of its row
            later = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1
            done = np.concatenate(([0], np.cumsum(later)))
            a = 0
            while a < len(row):
                b = max(a + 1, int(np.searchsorted(done, done[a] + _PAIRS_AT_ONCE, "right")) - 1)
                first = np.repeat(np.arange(a, b), later[a:b])
                second = first + 1 + np.arange(len(first)) - np.repeat(done[a:b] - done[a], later[a:b])
                key, place = np.unique(voter[first] * voters + voter[second], return_inverse=True)
                sums = np.bincount(place.ravel(), (p * weight)[row[first]], len(key))
                yield _table(key // voters, key % voters, sums, np.zeros(len(key)))
                a = b

    pairs = votes.mapInArrow(together, "i int, j int, a double, b double").groupBy("i", "j").agg(F.sum("a").alias("a"))
    rates = votes.sparkSession.createDataFrame(pa.table({"v": pa.array(np.arange(voters), pa.int32()), "rate": pa.array(toxic)}))
    for side in ("i", "j"):
        pairs = pairs.join(F.broadcast(rates.toDF(f"_{side}", f"rate_{side}")), F.col(side) == F.col(f"_{side}"))
    spread = F.sqrt(F.col("rate_i") * (1 - F.col("rate_i")) * F.col("rate_j") * (1 - F.col("rate_j")))
    correlation = (F.col("a") / F.lit(max(n1, 1e-9)) - F.col("rate_i") * F.col("rate_j")) / F.greatest(spread, F.lit(1e-9))
    strong = pairs.withColumn("r", F.least(correlation, F.lit(1.0))).where(F.col("r") >= REPEATS)
    found = strong.select(F.explode(F.array("i", "j")).alias("v"), "r").groupBy("v").agg(F.sum("r").alias("r")).collect()
    repeats = np.zeros(voters)
    for one in found:
        repeats[one.v] = one.r
    return repeats


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, voter and logarithmic count of every vote; per row how many voters and hits there are, hits per word, and a constant."""
    row, voter = _sparse(batch.column("voters"))
    _, count = _sparse(batch.column("counts"))
    n = batch.num_rows
    hits = np.bincount(row, count, n) if len(row) else np.zeros(n)
    whole = np.stack(
        [np.log1p(np.bincount(row, minlength=n)), np.log1p(hits), 20 * hits / (batch.column("n_tokens").to_numpy() + 20.0), np.ones(n)], axis=1
    )
    return row, voter, np.log1p(count), whole


def _margin(features, weights: np.ndarray) -> np.ndarray:
    row, voter, x, whole = features
    return (np.bincount(row, x * weights[voter], len(whole)) if len(row) else 0.0) + whole @ weights[-4:]


def fit_classifier(votes: DataFrame, voters: int, model: LabelModel, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic regression on the posterior labels: quasi-Newton steps whose loss and gradient are summed over partitions."""
    size = voters + 4
    ridge = np.full(size, RIDGE)
    ridge[-1] = 1e-6

    def evaluated(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def moments(batches, weights=weights):
            gradient, curvature, loss = np.zeros(size), np.zeros(size), 0.0
            for batch in batches:
                features = row, voter, x, whole = _features(batch)
                margin = np.clip(_margin(features, weights), -30, 30)
                p = 1 / (1 + np.exp(-margin))
                target, weight = model.posterior(batch)
                loss += float((weight * (np.log1p(np.exp(margin)) - target * margin)).sum())
                pull, bend = weight * (p - target), weight * p * (1 - p)
                gradient[:voters] += np.bincount(voter, x * pull[row], voters)
                curvature[:voters] += np.bincount(voter, x * x * bend[row], voters)
                gradient[voters:] += whole.T @ pull
                curvature[voters:] += (whole * whole).T @ bend
            return np.array([[*gradient, loss], [*curvature, 0.0]])

        sums = _sums(votes, size + 1, moments)
        loss = float(sums[0, -1]) + 0.5 * float((ridge * weights * weights).sum())
        return loss, sums[0, :-1] + ridge * weights, sums[1, :-1] + ridge

    weights = np.zeros(size)
    weights[-1] = np.log(model.balance / (1 - model.balance))
    loss, gradient, curvature = evaluated(weights)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction = -_curved(gradient, pairs, curvature)
        length = 1.0
        while True:
            there = weights + length * direction
            after, slope, bend = evaluated(there)
            if after <= loss + 1e-4 * length * float(gradient @ direction) or length < 1e-4:
                break
            length /= 2
        change = there - weights, slope - gradient
        if change[0] @ change[1] > 1e-12:
            pairs = [*pairs, change][-MEMORY:]
        gain, weights, loss, gradient, curvature = loss - after, there, after, slope, bend
        if gain <= GAIN * max(1.0, abs(loss)):
            break
    return weights


def _curved(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], curvature: np.ndarray) -> np.ndarray:
    """Gradient times the approximate inverse curvature, from its diagonal and the last steps (limited-memory BFGS)."""
    q, kept = gradient.copy(), []
    for step, change in reversed(pairs):
        share = (step @ q) / (step @ change)
        q -= share * change
        kept.append(share)
    q /= curvature
    for (step, change), share in zip(pairs, reversed(kept)):
        q += step * (share - (change @ q) / (step @ change))
    return q


def label_sample(labels: DataFrame, label_col: str = "toxic", per_class: int = LABELLED) -> DataFrame:
    """Labels ``(doc_id, label)`` that may be learned from, about ``per_class`` of each class at most, chosen by a hash of the id.

    Null ids and labels are left out; of contradicting labels toxic counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.withColumn("label", (F.col("label") > 0).cast("int"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_class / max(1, sizes.get(0, 0))))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, held_out, score, predicted)``.

    Only texts enter a score. Labels are learned from rows that aren't held out; voters' rates and the classifier are fitted on all
    documents that aren't held out. A null text counts as empty; without any toxic label all scores are the share of toxic labels, smoothed. Repeated rows get equal
    scores. Only the two named columns of ``docs``, and ``doc_id`` and ``toxic`` of ``labels``, are read.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return _scores(rows, labels)


def _scores(rows: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of rows ``(doc_id, held_out, text)``, and their bigint columns ``carried``."""
    sample = checkpointed(label_sample(labels))
    # about 2 * LABELLED rows at most
    marked = rows.join(F.broadcast(sample), "doc_id", "left")
    found = propose_voters(marked.where("label is not null").select("text", F.col("label").alias("toxic")))
    n = len(found)
    kept = "".join(f", {c} bigint" for c in carried)
    schema = f"doc_id bigint, held_out boolean, label int{kept}, voters array<bigint>, counts array<bigint>, n_tokens bigint"
    votes = checkpointed(marked.select("doc_id", "held_out", "label", *carried, "text").mapInArrow(_cast_votes(found, carried), schema))
    learned = votes.where("not held_out")
    given = sample.agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).head()
    balance = ((given.a or 0) + 0.5) / (given.n + 1.0)
    weights = np.zeros(4)
    weights[-1] = np.log(balance / (1 - balance))
    if n:
        start = _start(learned, 2 * n, balance)
        weights = fit_classifier(learned, n, fit_label_model(learned, 2 * n, start))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(_margin(_features(batch), weights), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *[batch.column(c) for c in carried]],
                names=["doc_id", "held_out", "score", "predicted", *carried],
            )

    return votes.mapInArrow(score, f"doc_id bigint, held_out boolean, score double, predicted int{kept}")


def _start(votes: DataFrame, voters: int, balance: float) -> LabelModel:
    """Rates among the labelled rows."""

    def count(batches):
        once, rows = np.zeros((2, voters + 1)), 0
        for batch in batches:
            label = _labels(batch)
            row, voter = _fired(batch, voters // 2)
            rows += int(np.isnan(label).sum())
            for y in (0, 1):
                once[y, :voters] += np.bincount(voter, (label == y)[row], voters)
                once[y, voters] += (label == y).sum()
        return np.array([[*once[1], rows], [*once[0], 0]])

    sums = _sums(votes, voters + 2, count)
    (n1, n0), unlabelled = sums[:, voters], sums[0, voters + 1]
    others = min(1.0, OTHERS * (n1 + n0) / max(1.0, unlabelled))
    return LabelModel(balance, (sums[0, :voters] + 0.5) / (n1 + 1), (sums[1, :voters] + 0.5) / (n0 + 1), np.ones(voters), others)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns.

    Ids of toxic documents are joined with a digest of the text, and broadcast if they are measured few; other texts with the same id, or
    without one, stay.
    """
    doc_id, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"), F.xxhash64(text).alias("digest"))
    toxic = _scores(rows, labels, carried=("digest",)).where("predicted = 1")
    toxic = checkpointed(toxic.select(F.col("doc_id").alias("__toxic"), F.col("digest").alias("__digest")).distinct())
    if toxic.count() <= SMALL_ROWS:
        toxic = F.broadcast(toxic)
    return docs.join(toxic, doc_id.eqNullSafe(F.col("__toxic")) & (F.xxhash64(text) == F.col("__digest")), "left_anti")
