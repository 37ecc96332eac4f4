"""Inverted lists with 8-bit scalar codes: train, assign, encode, append, search.

An index covers one or many parts (splits, clusters) of a corpus at once:
``coarse(part_id, list_id, centroid)``, ``sq(part_id, vmin, vdiff)`` and the postings
``(part_id, list_id, vec_id, code)`` with one byte per dimension in ``code``. Stored postings come in
blocks ``(part_id, list_id, vec_ids ARRAY<BIGINT>, codes BINARY)``, a run of rows of one list per row:
a search then moves whole lists from the files to the kernel instead of single vectors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.arrow import (
    code_binary,
    code_matrix,
    combine_arrays,
    int_column,
    key_groups,
    list_matrix,
    matrix_list,
)
from vectorloom.functions.kernels import sq8_decode, sq8_encode
from vectorloom.operators.kmeans import lloyd, spaced_start
from vectorloom.operators.match import (
    centroid_groups,
    decoding_ranges,
    missing_part,
    nearest_centroid,
    nearest_in_batch,
    topk_join,
)
from vectorloom.operators.partition import train_sample, train_sizes
from vectorloom.operators.sizing import BROADCAST_LIMIT_BYTES, checkpointed, collect_within, join_small, vector_dim

_HELD_BYTES = 256 << 20
POSTINGS_SCHEMA = "part_id int, list_id int, vec_id bigint, code binary"
BLOCKS_SCHEMA = "part_id int, list_id int, vec_ids array<bigint>, codes binary"


@dataclass(frozen=True)
class IvfIndex:
    coarse: DataFrame
    sq: DataFrame
    blocks: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """One row per stored vector."""
        return unpack_postings(self.blocks)


def _cell(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


# --- training ---------------------------------------------------------------------------------


def sq8_train(train: DataFrame) -> DataFrame:
    """``(part_id, vmin, vdiff)``: per-dimension range of the training rows of every part."""
    rows = train.select("part_id", "embedding", "embedding").toDF("part_id", "lo", "hi")
    keys, arrays = ["part_id"], {"lo": np.minimum, "hi": np.maximum}
    schema = "part_id int, lo array<double>, hi array<double>"
    partial = rows.mapInArrow(lambda it: combine_arrays(it, keys, None, arrays, _HELD_BYTES), schema)
    merged = partial.repartition("part_id").mapInArrow(lambda it: combine_arrays(it, keys, None, arrays), schema)
    width = F.transform(F.arrays_zip("lo", "hi"), lambda r: r["hi"] - r["lo"])
    return merged.select("part_id", F.col("lo").alias("vmin"), width.alias("vdiff"))


def ivf_train(partitioned: DataFrame, niter: int = 10, **options) -> IvfIndex:
    """Coarse centroids and code ranges of every part of ``partitioned(part_id, vec_id, embedding)``.

    All parts are trained by the same jobs. Lists per part: floor(sqrt(rows)); training rows: the
    first tenth of the part. They are kept by the executors while training goes on, and given up after it.
    """
    sizes = checkpointed(train_sizes(partitioned))
    n_centroids = sizes.agg(F.sum("nlist").alias("n")).head().n
    train = train_sample(partitioned.select("part_id", "vec_id", "embedding"), sizes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = sizes.select("part_id", "nlist", F.col("n_train").alias("n"))
        coarse = lloyd(train, spaced_start(train, counts), niter, n_centroids=n_centroids, **options)
        return IvfIndex(coarse=coarse, sq=checkpointed(sq8_train(train)))
    finally:
        train.unpersist()


# --- filling ----------------------------------------------------------------------------------


def ivf_assign(partitioned: DataFrame, coarse: DataFrame, **match) -> DataFrame:
    """Add ``list_id``: the list of the row's own part with the largest inner product."""
    return nearest_centroid(partitioned, coarse, on=["part_id"], metric="ip", **match)


def sq8_encode_rows(rows: DataFrame, sq: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``code`` (one byte per dimension) in place of ``embedding``."""

    def encode(column, ranges):
        return code_binary(sq8_encode(list_matrix(column), *ranges))

    return _map_codes(rows, sq, "embedding", "code", "binary", encode, limit_bytes)


def sq8_decode_rows(rows: DataFrame, sq: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``decoded`` (DOUBLE vector) in place of ``code``."""

    def decode(column, ranges):
        return matrix_list(sq8_decode(code_matrix(column), *ranges), pa.float64())

    return _map_codes(rows, sq, "code", "decoded", "array<double>", decode, limit_bytes)


def _map_codes(rows, sq, source, target, target_type, convert, limit_bytes) -> DataFrame:
    """Convert a column by the ranges of each row's part: broadcast if they fit, else joined to the rows."""
    kept = [c for c in rows.columns if c != source]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    ranges = decoding_ranges(sq, limit_bytes, vector_dim(sq, "vmin"))
    payload = None
    if ranges is False:
        ranges = sq.select("part_id", "vmin", "vdiff")
        rows = join_small(rows, ranges, ["part_id"], source, "left", max_rows=0).select(*kept, source, "vmin", "vdiff")
    else:
        payload = rows.sparkSession.sparkContext.broadcast(ranges)

    def scan(batches):
        for batch in batches:
            for (part_id,), at in key_groups([int_column(batch, "part_id")], batch.num_rows):
                part = batch.take(pa.array(at))
                if payload is None:
                    own = [_cell(part, c)[0].values for c in ("vmin", "vdiff")]
                    own = None if None in own else [x.to_numpy(zero_copy_only=False) for x in own]
                else:
                    own = payload.value.get(part_id)
                if own is None:
                    raise missing_part(part_id, "code range")
                made = convert(_cell(part, source), own)
                yield pa.RecordBatch.from_arrays([*[_cell(part, c) for c in kept], made], [*kept, target])

    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in kept], f"{target} {target_type}"])
    return rows.mapInArrow(scan, schema)


def _frozen(index: IvfIndex, limit_bytes: int):
    """Centroids by part and code ranges, collected; None when they exceed the limit."""
    dim = vector_dim(index.coarse, "centroid")
    table = collect_within(index.coarse.select("part_id", "list_id", "centroid"), limit_bytes // max(1, 8 * dim))
    ranges = decoding_ranges(index.sq, limit_bytes, dim) if table is not None else False
    return None if ranges is False else (centroid_groups(table, ["part_id"], "ip", dim), ranges)


def index_append(
    index: IvfIndex, partitioned: DataFrame, *, limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Postings of new rows under a trained index: assign and encode, centroids stay frozen.

    With centroids and ranges within the limit both steps are one narrow, stateless pass; beyond it
    the rows are joined with the centroids of their part. A row of a part that the index doesn't know is an
    error in either form.
    """
    frozen = _frozen(index, limit_bytes)
    if frozen is None:
        assigned = ivf_assign(partitioned, index.coarse, strategy="packed")
        rows = assigned.select("part_id", "list_id", "vec_id", "embedding")
        return sq8_encode_rows(rows, index.sq, limit_bytes).select("part_id", "list_id", "vec_id", "code")
    payload = partitioned.sparkSession.sparkContext.broadcast(frozen)

    def scan(batches):
        groups, ranges = payload.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = nearest_in_batch(batch, groups, ["part_id"], "ip")
            matrix = list_matrix(_cell(batch, "embedding"))
            for (part,), rows in key_groups([int_column(batch, "part_id")], len(matrix)):
                if part not in ranges:
                    raise missing_part(part, "code range")
                codes = sq8_encode(matrix[rows], *ranges[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), part, np.int32)),
                        pa.array(lists[rows], pa.int32()),
                        _cell(batch, "vec_id").take(pa.array(rows)),
                        code_binary(codes),
                    ],
                    ["part_id", "list_id", "vec_id", "code"],
                )

    return partitioned.select("part_id", "vec_id", "embedding").mapInArrow(scan, POSTINGS_SCHEMA)


def pack_postings(postings: DataFrame) -> DataFrame:
    """Blocks of the postings, a narrow pass: rows of one list that arrive together share a block.

    Sorted input gives blocks of up to one Arrow batch; unsorted input gives smaller ones.
    """

    def pack(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, codes = int_column(batch, "vec_id"), code_matrix(_cell(batch, "code"))
            keys, id_lists, blobs = [], [], []
            for key, rows in key_groups([int_column(batch, "part_id"), int_column(batch, "list_id")], len(ids)):
                rows = rows[np.argsort(ids[rows], kind="stable")]
                keys.append(key)
                id_lists.append(ids[rows])
                blobs.append(codes[rows].tobytes())
            ends = np.cumsum([0, *map(len, id_lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part for part, _ in keys], pa.int32()),
                    pa.array([list_id for _, list_id in keys], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(id_lists))),
                    pa.array(blobs, pa.binary()),
                ],
                ["part_id", "list_id", "vec_ids", "codes"],
            )

    return postings.select("part_id", "list_id", "vec_id", "code").mapInArrow(pack, BLOCKS_SCHEMA)


def unpack_postings(blocks: DataFrame) -> DataFrame:
    """Blocks as one row per vector."""
    width = (F.length("codes") / F.size("vec_ids")).cast("int")
    rows = blocks.select("part_id", "list_id", "codes", width.alias("w"), F.posexplode("vec_ids").alias("pos", "vec_id"))
    code = F.substring(F.col("codes"), F.col("pos") * F.col("w") + 1, F.col("w"))
    return rows.select("part_id", "list_id", "vec_id", code.alias("code"))


def build_index(partitioned: DataFrame, niter: int = 10, **options) -> IvfIndex:
    """Train on, and fill with, all parts of a corpus."""
    trained = ivf_train(partitioned, niter, **options)
    return IvfIndex(trained.coarse, trained.sq, pack_postings(index_append(trained, partitioned, **options)))


def stack_indexes(indexes: Sequence[tuple[IvfIndex, int]]) -> IvfIndex:
    """Several indexes as one: the parts of each are renumbered from its offset on.

    One search over the stack then answers for all of them in a single pass.
    """
    def stacked(name: str) -> DataFrame:
        shifted = [
            getattr(index, name).withColumn("part_id", (F.col("part_id") + offset).cast("int")) for index, offset in indexes
        ]
        return reduce(DataFrame.unionByName, shifted)

    return IvfIndex(stacked("coarse"), stacked("sq"), stacked("blocks"))


# --- search -----------------------------------------------------------------------------------


def probe_lists(queries: DataFrame, coarse: DataFrame, nprobe: int, **match) -> DataFrame:
    """``(qid, part_id, list_id, probe_rk, score)``: the best ``nprobe`` lists per query and part."""
    items = coarse.select("part_id", F.col("list_id").cast("bigint").alias("item_id"), F.col("centroid").alias("vec"))
    best = topk_join(queries, items, nprobe, per=["part_id"], **{"prefer": "items", **match})
    return best.select(
        "qid", "part_id", F.col("item_id").cast("int").alias("list_id"), F.col("rk").alias("probe_rk"), "score"
    )


def search_probed(
    queries: DataFrame, index: IvfIndex, probes: DataFrame, k: int, per: tuple[str, ...] = (), **match
) -> DataFrame:
    """Top ``k`` decoded vectors among the probed lists, per query or per query and ``per``."""
    items = index.blocks.select("part_id", "list_id", F.col("vec_ids").alias("item_ids"), "codes")
    hits = topk_join(queries, items, k, on=["part_id", "list_id"], per=per, probes=probes, sq=index.sq, **match)
    return hits.withColumnRenamed("item_id", "vec_id")


def ivf_topk(queries: DataFrame, index: IvfIndex, k: int, nprobe: int, **match) -> DataFrame:
    """``(qid, vec_id, score, rk)``: approximate top ``k`` over all parts of the index."""
    return search_probed(queries, index, probe_lists(queries, index.coarse, nprobe), k, **match)
