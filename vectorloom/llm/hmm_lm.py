"""A hidden Markov language model: trained by Baum-Welch over partitions, scored by the scaled forward recursion.

Words fall into classes: each of the ``OWN`` most frequent training words is a class of its own, the others share ``SHARED``
classes by digest, and the end of a text is a class. A hidden state emits classes; a class emits its words with probabilities smoothed
from their exact counts over all training texts. So the tables that every task needs are bounded, while counts of all words stay
distributed: rare words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import words
from vectorloom.llm.toxicity import held_out
from vectorloom.operators.sizing import checkpointed

STATES = 4
STEPS = 6
#: Classes of one word, shared classes, and words whose counts every task holds.
OWN, SHARED, KNOWN = 8192, 1024, 1 << 18
#: Weight of the corpus-wide class distribution in a state's emissions, and of each transition before counting.
EMISSION_PRIOR, TRANSITION_PRIOR = 50.0, 1.0
#: Tokens in one pack of texts that go through the recursion together, and word counts held by a task before it reports them.
PACK, HELD = 1 << 20, 1 << 21
SEED = 9


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (word, c); a task reports when it holds many different words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        names = np.concatenate([h[0] for h in held])
        counts = np.concatenate([h[1] for h in held])
        order = np.argsort(names, kind="stable")
        bounds = words.runs(names[order])
        return names[order][bounds[:-1]], np.add.reduceat(counts[order], bounds[:-1])

    def table(names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], names=["word", "c"])

    for batch in batches:
        data, bounds = words.text_buffer(batch.column("text"))
        for a, b in words.chunks(bounds):
            digests, _ = words.word_digests(data, bounds[a : b + 1])
            if len(digests):
                held.append(np.unique(digests, return_counts=True))
            if sum(len(h[0]) for h in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield table(*held[0])
                    held = []
    if held:
        yield table(*merged())


class Lexicon:
    """The bounded tables: frequent words with their counts, and the size of each shared class."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, shared: dict[int, tuple[int, int]], ends: int, tokens: int, distinct: int):
        rank = np.lexsort((names, -counts))  # by count, ties by digest
        own = np.full(len(names), -1, np.int64)
        own[rank[:OWN]] = np.arange(min(OWN, len(names)))
        order = np.argsort(names)
        self.names, self.counts, self.own = names[order], counts[order], own[order]
        self.ends, self.tokens, self.distinct = ends, tokens, distinct
        total = np.array([shared.get(k, (0, 0)) for k in range(SHARED)], float).reshape(SHARED, 2)
        self.shared_tokens = total[:, 0]
        self.log_size = np.log10(total[:, 0] + 0.5 * (total[:, 1] + 1))

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Place of each word in the table, -1 for others."""
        if not len(self.names):
            return np.full(len(digests), -1)
        at = np.minimum(np.searchsorted(self.names, digests), len(self.names) - 1)
        return np.where(self.names[at] == digests, at, -1)

    def prior(self) -> np.ndarray:
        """Smoothed share of each class among the training tokens: the end, single words, shared classes."""
        counts = np.zeros(1 + OWN + SHARED)
        counts[0] = self.ends
        single = self.own >= 0
        counts[1 + self.own[single]] = self.counts[single]
        counts[1 + OWN :] = self.shared_tokens
        return (counts + 0.5) / (counts + 0.5).sum()


def build_lexicon(train: DataFrame) -> tuple[DataFrame, Lexicon]:
    """Counts of all words of ``train (text)`` as a table, and the bounded part of them."""
    counts = checkpointed(
        train.mapInArrow(_count_words, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    )
    ends = train.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).head()
    # the most frequent words by whole steps of a logarithmic scale of counts, KNOWN at most
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, left = 1 << 30, KNOWN
    for size in sorted(sizes, reverse=True):
        left -= size.n
        if left < 0:
            break
        least = size.step
    top = counts.where(step >= least).toArrow()
    names, seen = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    first = Lexicon(names, seen, {}, 0, 0, 0)
    single = first.names[first.own >= 0]
    shared = counts.mapInArrow(_class_sizes(np.sort(single)), "k bigint, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    sizes = {r.k: (r.n, r.v) for r in shared.collect()}  # SHARED rows at most
    return counts, Lexicon(names, seen, sizes, ends, total.n + ends, total.v + (ends > 0))


def _shared_class(digests: np.ndarray) -> np.ndarray:
    return (words.mix(digests) % np.uint64(SHARED)).astype(np.int64)


def _class_sizes(single: np.ndarray):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        for batch in batches:
            digests = batch.column("word").to_numpy().view(np.uint64)
            counts = batch.column("c").to_numpy()
            others = ~np.isin(digests, single)
            k = _shared_class(digests[others])
            n += np.bincount(k, counts[others], SHARED).astype(np.int64)
            v += np.bincount(k, minlength=SHARED)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    return sizes


def _encode(lexicon: Lexicon):
    """Texts as class sequences, with the sums over their known words and the list of their others."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_count = np.log10(lexicon.counts + 0.5)
        for batch in batches:
            data, bounds = words.text_buffer(batch.column("text"))
            for a, b in words.chunks(bounds):
                digests, before = words.word_digests(data, bounds[a : b + 1])
                n = np.diff(before)
                doc = np.repeat(np.arange(b - a), n)
                at = lexicon.find(digests)
                known = at >= 0
                own = np.where(known, lexicon.own[at], -1) if len(lexicon.own) else np.full(len(at), -1)
                k = _shared_class(digests)
                cls = np.where(own >= 0, 1 + own, 1 + OWN + k)
                value = np.where(known, log_count[at], 0.0) if len(log_count) else np.zeros(len(at))
                inner = np.where(own >= 0, 0.0, value - lexicon.log_size[k])
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((digests[rare], doc[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (digests[order][1:] != digests[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                starts = np.flatnonzero(new)
                per_doc = np.concatenate(([0], np.cumsum(np.bincount(doc[order][starts], minlength=b - a))))
                times = np.diff(np.concatenate((starts, [len(order)])))
                # the end of each text is its last token
                with_end = np.zeros(len(cls) + b - a, np.uint16)
                with_end[np.arange(len(cls)) + doc] = cls
                ends = np.concatenate(([0], np.cumsum(n + 1)))
                end_log = np.log10(lexicon.ends + 0.5)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("row", "doc_id", "held_out")]
                    + [
                        pa.array(n + 1),
                        pa.array(np.bincount(doc, known, b - a).astype(np.int64) + (lexicon.ends > 0)),
                        pa.array(np.bincount(doc, value, b - a) + end_log),
                        pa.array(np.bincount(doc, inner, b - a)),
                        words.packed(with_end, ends),
                        words.packed(digests[order][starts], per_doc),
                        words.packed(times.astype(np.int32), per_doc),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "inner", "classes", "rare", "times"],
                )

    return encode


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, at = words.unpacked(batch.column("rare"), np.uint64)
        times, _ = words.unpacked(batch.column("times"), np.int32)
        row = np.repeat(batch.column("row").to_numpy(), np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(row), pa.array(times)], names=["word", "row", "times"])


class Hmm:
    """Initial, transition and emission probabilities."""

    def __init__(self, initial: np.ndarray, transition: np.ndarray, emission: np.ndarray):
        self.initial, self.transition, self.emission = initial, transition, emission

    @classmethod
    def start(cls, prior: np.ndarray, states: int = STATES) -> Hmm:
        """Sticky states whose emissions vary around the corpus-wide distribution."""
        rng = np.random.Generator(np.random.PCG64(SEED))
        emission = prior * np.exp(rng.normal(0, 1, (states, len(prior))))
        transition = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(transition, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), transition, emission / emission.sum(axis=1, keepdims=True))


def packs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of about ``PACK`` tokens by falling length: their rows, their tokens step by step, and how many are left at each step."""
    flat, at = words.unpacked(column, np.uint16)
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    a = 0
    while a < len(order):
        size = np.cumsum(length[order[a:]])
        b = a + max(1, int(np.searchsorted(size, PACK, "right")))
        rows = order[a:b]
        own = length[rows]
        longest = int(own[0])
        alive = np.searchsorted(-own, -np.arange(1, longest + 1), "right")  # sequences that have a token at each step
        starts = np.concatenate(([0], np.cumsum(alive)))
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)  # step of each token, sequence by sequence
        rank = np.repeat(np.arange(len(rows)), own)
        packed = np.empty(int(own.sum()), np.int64)
        packed[starts[place] + rank] = flat[np.repeat(at[rows], own) + place]
        yield rows, packed, alive
        a = b


def forward(model: Hmm, tokens: np.ndarray, alive: np.ndarray, keep: bool = False):
    """Scaled forward recursion; log10 likelihood of every sequence of a pack, and with ``keep`` the states and scales of all steps."""
    seen = np.ascontiguousarray(model.emission.T)[tokens]
    if not len(alive):
        return np.zeros(0), seen, seen, np.zeros(0)
    total = np.zeros(int(alive[0]))
    states = np.empty_like(seen) if keep else None
    scales = np.empty(len(tokens)) if keep else None
    at, now = 0, np.broadcast_to(model.initial, (int(alive[0]), len(model.initial)))
    for step, n in enumerate(alive.tolist()):
        now = (now[:n] @ model.transition if step else now) * seen[at : at + n]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        total[:n] += np.log10(scale)
        if keep:
            states[at : at + n], scales[at : at + n] = now, scale
        at += n
    return total, seen, states, scales


def expected_counts(model: Hmm, tokens: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions of the sequences of a pack."""
    _, seen, states, scales = forward(model, tokens, alive, keep=True)
    k = len(model.initial)
    moves = np.zeros((k, k))
    at, later, after = len(tokens), None, 0
    for n in reversed(alive.tolist()):
        at -= n
        back = np.ones((n, k))
        if later is not None:
            moves += states[at : at + after].T @ later
            back[:after] = later @ model.transition.T
        # what the step before needs: emission * backward / scale of this step
        posterior = states[at : at + n] * back
        later = seen[at : at + n] * back / scales[at : at + n, None]
        after = n
        seen[at : at + n] = posterior
    emitted = np.stack([np.bincount(tokens, seen[:, s], model.emission.shape[1]) for s in range(k)])
    return seen[: alive[0]].sum(axis=0), moves * model.transition, emitted


def baum_welch(sequences: DataFrame, prior: np.ndarray, states: int = STATES, steps: int = STEPS) -> Hmm:
    """Train on all of ``sequences (classes)``; a step adds up expected counts over partitions and brings back one row per class."""
    model = Hmm.start(prior, states)
    names = [f"s{k}" for k in range(states)]
    schema = "i int, " + ", ".join(f"{n} double" for n in names)
    for _ in range(steps):

        def counts(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            start, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros(model.emission.shape)
            for batch in batches:
                for _, tokens, alive in packs(batch.column("classes")):
                    for total, part in zip((start, moves, emitted), expected_counts(model, tokens, alive)):
                        total += part
            rows = np.concatenate((emitted.T, moves, start[None]))
            some = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32))] + [pa.array(rows[some, k]) for k in range(states)], names=["i", *names])

        summed = sequences.mapInArrow(counts, schema).groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        rows = np.zeros((len(prior) + states + 1, states))
        rows[summed.column("i").to_numpy()] = np.stack([summed.column(n).to_numpy() for n in names], axis=1) if summed.num_rows else 0
        emission = rows[: len(prior)].T + EMISSION_PRIOR * prior
        moves = rows[len(prior) : -1] + TRANSITION_PRIOR
        start = rows[-1] + TRANSITION_PRIOR
        model = Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emission / emission.sum(axis=1, keepdims=True))
    return model


def _score(model: Hmm):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, tokens, alive in packs(batch.column("classes")):
                out[rows] = forward(model, tokens, alive)[0]
            kept = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "inner"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out)], names=[*kept, "sequence"])

    return score


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, steps: int = STEPS) -> DataFrame:
    """One row per document: ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    Trained on rows whose crc32 of the id as text, modulo 5, is not 1. Tokens are the words of the whole text (see
    :mod:`vectorloom.llm.words`) and its end. ``base_score`` is the smoothed unigram log10 probability, ``score`` that of the hidden Markov
    model. A null text is empty: its only token is the end. Repeated rows count, and are scored, each. Without training rows the model is its
    prior. Only the two named columns are read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        held_out(id_col, 1).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    counts, lexicon = build_lexicon(rows.where("not held_out").select("text"))
    schema = (
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, inner double, "
        "classes binary, rare binary, times binary"
    )
    encoded = checkpointed(rows.mapInArrow(_encode(lexicon), schema))
    rare = encoded.where(F.length("rare") > 0).select("row", "rare", "times").mapInArrow(_rare_words, "word bigint, row bigint, times int")
    met = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    model = baum_welch(encoded.where("not held_out").select("classes"), lexicon.prior(), states, steps)
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "inner", "classes").mapInArrow(
        _score(model),
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, inner double, sequence double",
    )
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    size = float(np.log10(lexicon.tokens + 0.5 * (lexicon.distinct + 1)))
    return scored.join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(lexicon.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("sequence") + F.col("inner") + rare_logs).alias("score"),
    )
