"""Mixing sources to target weights by the cube method of balanced sampling.

A document of a source is wanted ``target / source size`` times: the whole part is taken as that many copies, the fraction is the
inclusion probability of one more. The flight phase moves the fractions of a block of documents through the null space of two
constraints, the block's words and its number of documents, until at most two fractions are left; these meet in larger blocks, and so on
until one block is left per source. Its last fractions are the landing
problem: they are rounded, and one or two decisions at a time are changed, towards the target of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm import words
from vectorloom.operators.sizing import checkpointed

#: Documents in one block of the flight phase.
BLOCK = 4096
#: Sources up to which the table of targets is broadcast; beyond, it is joined on a salted key.
MAX_BROADCAST_SOURCES = 50_000
#: Salts of that join.
SALTS = 64
SEED = 11
_EPS = 1e-9


def word_count(text_col: str) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source_no, source, source_size, docs, target)`` for rows ``(source, size)``.

    Sources in code point order, null last, weigh ``weights`` repeating and share the total size; a target stops at ``most`` times its
    source's size and the excess is shared again by weight. That fixed point is ``min(cap, weight * level)``; the level follows from running sums in
    the order of cap / weight. One row per source passes through these windows.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    numbered = sources.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(pattern, F.col("source_no") % len(weights) + 1)
    )
    capped = numbered.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "source_no")
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - (F.sum("cap").over(order) - F.col("cap"))
    weight = F.sum("weight").over(whole) - (F.sum("weight").over(order) - F.col("weight"))
    levelled = capped.withColumn("level", left / weight)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(whole)["level"]
    return levelled.select(
        "source_no",
        "source",
        "source_size",
        "docs",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double"))).alias("target"),
    )


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with the columns of their source; the same rows for either way of joining."""
    targets = targets.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if targets.count() <= MAX_BROADCAST_SOURCES:
        return rows.join(F.broadcast(targets), same).drop("__source")
    salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__key", F.pmod("rid", F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("__key") == F.col("__salt"))).drop("__source", "__salt", "__key")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight phase: all 0 or 1 but for two at most.

    Sums of ``p`` and of ``p * size`` stay as they are. Documents enter in the given order.
    """
    p = p.astype(float).copy()
    waiting = iter(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist())
    held: list[int] = []
    values, sizes, draws = p.tolist(), size.tolist(), iter(())
    while True:
        while len(held) < 3:
            following = next(waiting, None)
            if following is None:
                break
            held.append(following)
        if len(held) < 3:
            break
        i, j, k = held
        u = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((((1 - values[x]) / v) if v > 0 else (values[x] / -v)) for x, v in zip(held, u) if v)
        down = min(((values[x] / v) if v > 0 else ((1 - values[x]) / -v)) for x, v in zip(held, u) if v)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(256).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for x, v in zip(held, u):
            value = values[x] + step * v
            values[x] = 0.0 if value < _EPS else 1.0 if value > 1 - _EPS else value
        held = [x for x in held if 0.0 < values[x] < 1.0]
    return np.array(values)


def land(start: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing problem: round the fractions that a flight from ``start`` left, then improve the total of words.

    The (two at most) fractions take the nearest total. They tend to be the largest documents, so the rest of the error is worked off by changing
    the decision of one document, or of two, as long as the total comes nearer; only documents with a fraction at the start are changed.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    best = None
    for bits in range(1 << len(open_)):
        x = np.array([(bits >> n) & 1 for n in range(len(open_))], float)
        off = (abs(((x - p[open_]) * size[open_]).sum()), abs((x - p[open_]).sum()), bits)
        best = min(best or (off, x), (off, x), key=lambda b: b[0])
    out = p.copy()
    out[open_] = best[1]
    free = np.flatnonzero((start > 0) & (start < 1))
    error = ((out - start) * size).sum()
    while len(free) and abs(error) >= 1:
        change = np.where(out[free] > 0.5, -1.0, 1.0) * size[free]
        order = np.argsort(change, kind="stable")
        steps = change[order]
        one = int(np.argmin(np.abs(error + steps)))
        at = np.clip(np.searchsorted(steps, -error - steps), 1, len(steps) - 1) if len(steps) > 1 else np.zeros(1, np.int64)
        pairs = [(abs(error + steps[i] + steps[j]), i, j) for j_ in (at, at - 1) for i, j in _nearest(steps, error, j_)]
        moves = [(abs(error + steps[one]), (one,))] + [(off, (i, j)) for off, i, j in pairs]
        off, chosen = min(moves)
        if off >= abs(error) - 0.5:
            break
        rows = free[order[list(chosen)]]
        error += steps[list(chosen)].sum()
        out[rows] = 1.0 - out[rows]
    return out


def _nearest(steps: np.ndarray, error: float, partner: np.ndarray) -> list[tuple[int, int]]:
    """The best of the pairs (i, partner[i])."""
    i = np.flatnonzero(partner != np.arange(len(steps)))
    if not len(i):
        return []
    best = i[int(np.argmin(np.abs(error + steps[i] + steps[partner[i]])))]
    return [(int(best), int(partner[best]))]


def _fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block ``g``; the fraction ``p`` of each after its block's flight, and landing where the block is its source's only one."""
    for table in words.whole_groups(batches, "g"):
        g, size, land_here = (table.column(c).to_numpy() for c in ("g", "size", "land"))
        p = table.column("p").to_numpy().copy()
        bounds = words.runs(g)
        for a, b in zip(bounds[:-1], bounds[1:]):
            start = np.where(p[a:b] < _EPS, 0.0, np.where(p[a:b] > 1 - _EPS, 1.0, p[a:b]))
            q = flight(start, size[a:b], np.random.Generator(np.random.PCG64([SEED, int(g[a])])))
            p[a:b] = land(start, q, size[a:b]) if land_here[a] else q
        yield from table.set_column(table.schema.get_field_index("p"), "p", pa.array(p)).to_batches()


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``(rid, doc_id, source, size, source_size, target, copies, taken)``.

    ``taken`` is ``copies * size``. Each source's sum of ``taken`` comes as near to its target as changing two decisions of its last block can bring it. Draws
    depend only on ids, sizes and blocks, so a rerun takes the same documents. A null text has size 0, a null source is a source; rows
    repeated with the same id and text are documents of their own and share ``rid``. Only the three named columns are read.
    """
    rows = docs.select(
        F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))).alias("rid"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
    )
    rows = checkpointed(rows)
    targets = checkpointed(source_targets(rows, weights, most))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    open_ = (
        _with_targets(rows, targets)
        .withColumn("wanted", wanted)
        .withColumn("whole", F.floor(F.col("wanted") + _EPS).cast("bigint"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole")))
        .drop("wanted")
    )
    settled: list[DataFrame] = []
    per_source = F.col("docs")
    while True:
        blocks = F.ceil(per_source / block).cast("bigint")
        dealt = open_.withColumn("land", blocks <= 1).withColumn(
            "g", F.col("source_no").cast("bigint") * F.lit(1 << 32) + F.pmod(F.xxhash64("rid", F.lit(len(settled))), F.greatest(blocks, F.lit(1)))
        )
        order = [F.col("g"), F.col("size").desc(), F.xxhash64("rid", F.lit(SEED)), F.col("doc_id")]
        flown = dealt.repartition("g").sortWithinPartitions(*order)
        flown = checkpointed(flown.mapInArrow(_fly, flown.schema))
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(flown.where(~undecided))
        left = flown.where(undecided)
        counts = checkpointed(left.groupBy("source_no").agg(F.count(F.lit(1)).alias("left")))
        if counts.head() is None:
            break
        # two rows at most are left of every block
        open_ = left.drop("left", "land", "g").join(counts, "source_no")
        per_source = F.col("left")
    columns = ["rid", "doc_id", "source", "size", "source_size", "target", "whole", "p"]
    done = reduce(DataFrame.union, [part.select(columns) for part in settled])
    copies = F.col("whole") + F.round("p").cast("bigint")
    return done.select("rid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    taken = mix_sources(docs, id_col, text_col, source_col).groupBy("rid").agg(F.sum("copies").cast("int").alias("__copies"))
    key = F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")))
    one = Window.partitionBy("__rid").orderBy(F.xxhash64(*docs.columns))
    return (
        docs.withColumn("__rid", key)
        .join(taken.where("__copies > 0").withColumnRenamed("rid", "__rid"), "__rid")
        .withColumn("__rank", F.row_number().over(one))
        .withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy("__rid")))
        # the copies of repeated rows are dealt to them in turn
        .withColumn("__copies", F.floor((F.col("__copies") + F.col("__rows") - F.col("__rank")) / F.col("__rows")).cast("int"))
        .where("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*docs.columns)
    )
