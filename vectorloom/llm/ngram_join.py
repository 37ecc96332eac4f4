"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of five-word shingles, equal sets one class. Classes whose MinHash values agree in one of the bands are compared
value by value: a pair is dropped as soon as the posterior probability that its similarity reaches the threshold, given the agreements
so far and a uniform prior, falls below ``TOLERANCE``. The rest is verified exactly on the shingle sets.

Two passes keep every group bounded. The first compares MinHash values within band buckets and only ties together classes that
may be linked (a spanning forest, not the pairs). The second brings the shingle sets of each tied component together once and settles all its
pairs. Groups larger than a block are cut into blocks, and every pair of blocks is a group of its own, so a very large group of
copies is spread over tasks; pairs are counted where they are found and never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm import words
from vectorloom.llm.components import components, join_heavy
from vectorloom.operators.sizing import checkpointed

WIDTH = 5
THRESHOLD = Fraction(4, 5)
#: 32 bands of 4 values miss a pair at the threshold with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
#: A pair is dropped below this posterior probability of reaching the threshold.
TOLERANCE = 1e-9
#: MinHash values compared before each decision.
STEP = 16
#: Classes compared in one group, by MinHash values and by shingle sets.
BUCKET_BLOCK, SET_BLOCK = 2048, 512
#: Buckets up to this size report all surviving pairs, larger ones a spanning forest.
SMALL = 12

_RANDOM = np.random.Generator(np.random.PCG64(5))
_A = _RANDOM.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2**32, VALUES, dtype=np.uint32)


def least_agreements(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, values: int = VALUES, step: int = STEP) -> list[int]:
    """After each ``step`` values, the fewest agreements with which a pair stays.

    With a uniform prior the similarity given m of n agreements is Beta(m + 1, n - m + 1), so that
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = float(threshold), []
    for n in range(step, values + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


_LEAST = least_agreements()


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of MinHash values (``a`` may be one row) may reach the threshold."""
    alive = np.arange(len(b))
    agreed = np.zeros(len(b), np.int32)
    for k, least in enumerate(_LEAST):
        part = slice(k * STEP, (k + 1) * STEP)
        left = a[:, part] if len(a) == 1 else a[alive, part]
        agreed = agreed + (left == b[alive, part]).sum(axis=1, dtype=np.int32)
        stay = agreed >= least
        if not stay.all():
            alive, agreed = alive[stay], agreed[stay]
        if not len(alive):
            break
    return alive


def minhash(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``VALUES`` MinHash values for each set; sets must not be empty."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], offsets[:-1])
    return out


def _sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, concatenated, and their offsets."""
    digests, before = words.word_digests(data, bounds)
    every, at = words.shingles(digests, before, WIDTH)
    parts = [np.unique(every[i:j]) for i, j in zip(at[:-1], at[1:])]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def _names(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit name of each set: two independent sums over its members."""
    total = np.zeros((2, len(sets) + 1), np.uint64)
    np.cumsum(words.mix(sets ^ np.uint64(0xA0761D6478BD642F)), out=total[0, 1:])
    np.cumsum(words.mix(sets ^ np.uint64(0xE7037ED1A0B428DB)), out=total[1, 1:])
    ends = total[:, offsets[1:]] - total[:, offsets[:-1]]
    return np.ascontiguousarray(ends.T)


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) to (rid, doc_id, cls, sig)."""
    for batch in batches:
        data, bounds = words.text_buffer(batch.column("text"))
        for a, b in words.chunks(bounds):
            sets, offsets = _sets(data, bounds[a : b + 1])
            size = np.diff(offsets)
            sig = np.zeros((b - a, VALUES), np.uint32)
            full = np.flatnonzero(size)
            if len(full):
                sig[full] = minhash(sets, np.concatenate((offsets[:-1][full], offsets[-1:])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").slice(a, b - a),
                    batch.column("doc_id").slice(a, b - a),
                    words.packed(_names(sets, offsets).ravel(), np.arange(b - a + 1) * 2),
                    words.packed(sig[full].ravel(), np.concatenate(([0], np.cumsum(np.where(size > 0, VALUES, 0))))),
                ],
                names=["rid", "doc_id", "cls", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, sig) to (bucket, cls), a row per band."""
    place = words.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        values, _ = words.unpacked(batch.column("sig"), np.uint32)
        rows = values.reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(place, rows.shape[:2]).copy()
        for k in range(ROWS):
            key = words.mix(key ^ rows[:, :, k])
        names = batch.column("cls").take(pa.array(np.repeat(np.arange(len(rows)), BANDS)))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), names], names=["bucket", "cls"])


def pair_blocks(rows: DataFrame, group: str, member: str, size: str, block: int) -> DataFrame:
    """Members of each ``group`` of ``size`` rows, dealt to groups ``g`` of at most two blocks.

    All pairs of a group meet in exactly one ``g``: those within a block where ``side`` is 0 throughout, those between two blocks where one
    has side 0 and the other side 1.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(17)), n.cast("bigint")).cast("int")
    dealt = rows.withColumn("__n", n).withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    return dealt.withColumns(
        {"g": F.xxhash64(group, low, high), "side": (F.col("__own") > F.col("__other")).cast("int")}
    ).drop("__n", "__own", "__other")


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between classes of a bucket whose MinHash values make a link plausible: all in small groups, a spanning forest in others."""
    for table in words.whole_groups(batches, "g"):
        g = table.column("g").to_numpy()
        side = table.column("side").to_numpy()
        names = table.column("cls").combine_chunks()
        sig = words.unpacked(table.column("sig"), np.uint32)[0].reshape(-1, VALUES)
        bounds = words.runs(g)
        size = np.diff(bounds)
        left, right = [], []
        small = np.repeat(size <= SMALL, size)
        for d in range(1, SMALL):
            i = np.flatnonzero(small[:-d] & (g[:-d] == g[d:])) if len(g) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            crossed = _crossed(g, side, bounds)
            i = i[(~crossed[i]) | (side[i] != side[i + d])]
            if len(i):
                i = i[plausible(sig[i], sig[i + d])]
                left.append(i)
                right.append(i + d)
        for a, b in zip(bounds[:-1][size > SMALL], bounds[1:][size > SMALL]):
            for i, j in _forest(sig[a:b], side[a:b]):
                left.append(np.full(len(j), a + i))
                right.append(a + j)
        if left:
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.concatenate(x).astype(np.int64))) for x in (left, right)], names=["a", "b"]
            )


def _crossed(g: np.ndarray, side: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row, whether its group holds two blocks, of which only pairs across count."""
    two = np.add.reduceat(side, bounds[:-1]) > 0
    return np.repeat(two, np.diff(bounds))


def _forest(sig: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Breadth-first search over plausible pairs; yields a row and the rows it newly reaches."""
    crossed = side.any()
    free = np.ones(len(sig), bool)
    for root in range(len(sig)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(free & (side != side[i]) if crossed else free)
            if not len(rest):
                continue
            found = rest[plausible(sig[i : i + 1], sig[rest])]
            if len(found):
                free[found] = False
                queue.extend(found.tolist())
                yield i, found


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of tied classes as shingle sets with their MinHash values; rows whose set isn't that of their class go."""
    for batch in batches:
        data, bounds = words.text_buffer(batch.column("text"))
        for a, b in words.chunks(bounds):
            sets, offsets = _sets(data, bounds[a : b + 1])
            part = batch.slice(a, b - a)
            names = words.unpacked(part.column("cls"), np.uint64)[0].reshape(-1, 2)
            same = (names == _names(sets, offsets)).all(axis=1) & (np.diff(offsets) > 0)
            if not same.any():
                continue
            keep = np.flatnonzero(same)
            sig = minhash(sets, np.concatenate((offsets[:-1][np.diff(offsets) > 0], offsets[-1:])))[same[np.diff(offsets) > 0]]
            sets = sets[np.repeat(same, np.diff(offsets))]
            ends = np.concatenate(([0], np.cumsum(np.diff(offsets)[keep])))
            rows = part.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in ("component", "members", "cls", "n_docs")]
                + [words.packed(sig.ravel(), np.arange(len(keep) + 1) * VALUES), words.packed(sets, ends)],
                names=["component", "members", "cls", "n_docs", "sig", "sets"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group, exactly: per class their number and the documents behind them, and a spanning forest."""
    for table in words.whole_groups(batches, "g"):
        bounds = words.runs(table.column("g").to_numpy())
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                out = _verify_group(table.slice(a, b - a).combine_chunks())
                if out is not None:
                    yield out


def _verify_group(table: pa.Table) -> pa.RecordBatch | None:
    names = np.asarray(table.column("cls").to_pylist(), object)
    _, first = np.unique(np.array([n + bytes([s]) for n, s in zip(names, table.column("side").to_pylist())], object), return_index=True)
    table, names = table.take(pa.array(first)), names[first]  # a class comes once, whatever rows are repeated
    side = table.column("side").to_numpy()
    docs = table.column("n_docs").to_numpy()
    order = np.argsort(side, kind="stable")
    table, names, side, docs = table.take(pa.array(order)), names[order], side[order], docs[order]
    sig = words.unpacked(table.column("sig"), np.uint32)[0].reshape(-1, VALUES)
    sets, offsets = words.unpacked(table.column("sets"), np.uint64)
    _, ids = np.unique(sets, return_inverse=True)
    size, n = np.diff(offsets), len(names)
    split = int(np.searchsorted(side, 1))
    num, den = THRESHOLD.numerator, THRESHOLD.denominator
    mark = np.zeros(ids.max() + 1, np.int8)
    links, linked = np.zeros(n, np.int64), np.zeros(n, np.int64)
    parent = list(range(n))
    edges = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(split if split < n else n - 1):
        low = split if split < n else i + 1
        rest = low + plausible(sig[i : i + 1], sig[low:])
        if not len(rest):
            continue
        mine = ids[offsets[i] : offsets[i + 1]]
        mark[mine] = 1
        if len(rest) * 4 > n - low:
            shared = np.add.reduceat(mark[ids[offsets[low] :]], offsets[low:-1] - offsets[low], dtype=np.int64)[rest - low]
        else:
            shared = np.array([mark[ids[offsets[j] : offsets[j + 1]]].sum(dtype=np.int64) for j in rest])
        mark[mine] = 0
        # shared / (size i + size j - shared) >= num / den
        rest = rest[shared * (den + num) >= num * (size[i] + size[rest])]
        links[i] += len(rest)
        links[rest] += 1
        linked[i] += docs[rest].sum()
        linked[rest] += docs[i]
        for j in rest:
            x, y = root(i), root(int(j))
            if x != y:
                parent[y] = x
                edges.append((i, int(j)))
    if not edges:
        return None
    some = np.flatnonzero(links)
    a = [bytes(names[i]) for i in some] + [bytes(names[i]) for i, _ in edges]
    b = [None] * len(some) + [bytes(names[j]) for _, j in edges]
    zeros = np.zeros(len(edges), np.int64)
    return pa.RecordBatch.from_arrays(
        [words.binary(a), words.binary(b), pa.array(np.concatenate((links[some], zeros))), pa.array(np.concatenate((linked[some], zeros)))],
        names=["a", "b", "links", "linked"],
    )


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(rid, doc_id, copy_id, class_id, class_size, n_links, n_class_links, kept)``.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more (words as in
    :mod:`vectorloom.llm.words`; a text of one to four words is one shingle; texts without words have equal, empty sets and count as linked).
    ``copy_id`` is the smallest id among equal sets, ``class_id`` the smallest id among documents joined by links, directly or through others;
    ``n_links`` counts the other documents linked to this one, ``n_class_links`` the different sets linked to its set. ``kept`` marks
    the document of each class with the smallest (id, row key), null ids first.

    Rows repeated with the same id and text share the row key ``rid``. Only the two named columns are read.
    """
    rows = docs.select(
        _row_key(id_col, text_col).alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    described = checkpointed(rows.mapInArrow(_describe, "rid bigint, doc_id bigint, cls binary, sig binary"))
    first = F.min(F.struct("doc_id", "rid"))
    classes = checkpointed(
        described.groupBy("cls").agg(first.alias("first"), F.count(F.lit(1)).alias("n_docs"), F.first("sig").alias("sig"))
    )
    signed = classes.where(F.length("sig") > 0).select("cls", "sig")
    bands = signed.mapInArrow(_bands, "bucket bigint, cls binary")
    shared = checkpointed(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    n_docs = described.count()
    dealt = pair_blocks(join_heavy(bands, shared, "bucket", "members", n_docs), "bucket", "cls", "members", BUCKET_BLOCK)
    met = dealt.select("g", "side", "cls").join(signed, "cls").repartition("g").sortWithinPartitions("g", "side")
    ties = components(met.select("g", "side", "cls", "sig").mapInArrow(_ties, "a binary, b binary"))
    # the texts of tied classes, one for each class
    sizes = ties.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    wanted = (
        ties.join(sizes, "component")
        .join(classes.select(F.col("cls").alias("node"), "first", "n_docs"), "node")
        .select("first", F.col("node").alias("cls"), "component", "members", "n_docs")
    )
    # by id and digest: a digest of 64 bits alone isn't unique at scale
    same = (F.col("rid") == F.col("first.rid")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    texts = rows.join(wanted, same).select("rid", "text", "cls", "component", "members", "n_docs")
    schema = "component binary, members bigint, cls binary, n_docs bigint, sig binary, sets binary"
    sets = texts.mapInArrow(_rebuild, schema)
    blocks = pair_blocks(sets, "component", "cls", "members", SET_BLOCK)
    settled = checkpointed(
        blocks.select("g", "side", "cls", "n_docs", "sig", "sets")
        .repartition("g")
        .sortWithinPartitions("g", "side")
        .mapInArrow(_verify, "a binary, b binary, links bigint, linked bigint")
    )
    counts = settled.where("b is null").groupBy("a").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    joined = components(settled.where("b is not null").select("a", "b"))
    named = (
        classes.select("cls", "first", "n_docs")
        .join(counts.withColumnRenamed("a", "cls"), "cls", "left")
        .join(joined.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    named = checkpointed(named)
    heads = named.groupBy("component").agg(F.min("first").alias("head"), F.sum("n_docs").alias("class_size"), F.count(F.lit(1)).alias("members"))
    named = join_heavy(named, checkpointed(heads), "component", "members", n_docs).select("cls", "first", "n_docs", "links", "linked", "head", "class_size")
    return join_heavy(described.select("rid", "doc_id", "cls"), checkpointed(named), "cls", "n_docs", n_docs).select(
        "rid",
        "doc_id",
        F.col("first.doc_id").alias("copy_id"),
        F.col("head.doc_id").alias("class_id"),
        "class_size",
        (F.coalesce("linked", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_class_links"),
        (F.struct("doc_id", "rid") == F.col("head")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of :func:`ngram_jaccard_join`, with all its columns; of repeated rows one stays."""
    kept = ngram_jaccard_join(docs, id_col, text_col).where("kept").select(F.col("rid").alias("__kept"), F.col("doc_id").alias("__kept_id")).distinct()
    order = Window.partitionBy("__rid", "__id").orderBy(F.xxhash64(*docs.columns))
    same = (F.col("__rid") == F.col("__kept")) & F.col("__id").eqNullSafe(F.col("__kept_id"))
    return (
        docs.withColumns({"__rid": _row_key(id_col, text_col), "__id": F.col(id_col).cast("bigint")})
        .join(kept, same, "left_semi")
        .withColumn("__rank", F.row_number().over(order))
        .where("__rank = 1")
        .select(*docs.columns)
    )
