"""Vector matching: top-k items per query under optional equality keys.

Every search and every assignment is one of these two functions. Three physical forms:

``queries``  the query side is small: it is broadcast, items stream past it once, each task
             keeps a running top-k, and only those short lists are shuffled; a larger query side goes in
             shares, each with a pass of its own, so that a task's memory doesn't grow with it;
``items``    the item side is small (centroids): it is broadcast, queries stream past it and
             the answer needs no shuffle;
``packed``   neither side fits: both sides are packed into bounded blocks by key and salt and dealt over
             a grid of query stripes and item stripes per key; each cell is one join key, so neither
             a hot key nor a large side is one task's work.

``auto`` counts the preferred side first and takes the first form whose broadcast fits the limit; queries of several shares come last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.arrow import code_matrix, int_column, key_groups, list_matrix
from vectorloom.functions.kernels import (
    NO_ID,
    QueryBlock,
    block_topk,
    l2_as_product,
    merge_topk,
    sq8_decode,
    with_constant,
)
from vectorloom.operators.sizing import BROADCAST_LIMIT_BYTES, collect_within, join_small, table_shape, vector_dim

_PACK_ROWS = 4096  # rows per packed block
_STRIPE_PACKS = 16  # blocks of one key and side in a stripe; a grid cell pairs a query stripe with an item stripe
_ITEM_CHUNK = 8192  # items scored at once
_PRUNE_VALUES = 256  # longest IN list pushed to the scan
_STATE_ROWS = 4_000_000  # running top-k entries held by a task before they are emitted
_SHARE_BYTES = 8 << 20  # query vectors (as DOUBLE) that a task holds at once
_TASK_HITS = 8_192  # hits of the answer (per group) that one task of the last merge holds


# --- helpers that run on executors ------------------------------------------------------------


def _stored(column) -> np.ndarray:
    """Item vectors of an Arrow column as they are stored: plain lists or 8-bit codes."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return code_matrix(column)
    return list_matrix(column)


def _block(ids, values, dtype=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of one block (Arrow scalars), without copying."""
    ids = ids.values.to_numpy().astype(np.int64, copy=False)
    return ids, np.frombuffer(values.as_buffer(), dtype).reshape(len(ids), -1)


def _item_groups(batch: pa.RecordBatch, columns: Sequence[str]):
    """``(key, ids, stored vectors)`` of a batch of item rows or of item blocks."""
    keys = [int_column(batch, c) for c in columns]
    if "item_ids" in batch.schema.names:
        ids, codes = (batch.column(batch.schema.get_field_index(c)) for c in ("item_ids", "codes"))
        for row in range(batch.num_rows):
            yield tuple(int(c[row]) for c in keys), *_block(ids[row], codes[row])
        return
    ids = int_column(batch, "item_id")
    stored = _stored(batch.column(batch.schema.get_field_index("vec")))
    for key, rows in key_groups(keys, len(ids)):
        yield key, ids[rows], stored[rows]


def _decoded(stored: np.ndarray, params) -> np.ndarray:
    return stored if params is None else sq8_decode(stored, *params)


def missing_part(part, what: str) -> ValueError:
    """A row of a part the index doesn't know: an error in every physical form, never a lost row."""
    return ValueError(f"part {part} has no {what} in this index; train it, or leave its rows out")


def _range_of(params: dict, part: int):
    if part not in params:
        raise missing_part(part, "code range")
    return params[part]


def _topk_over(queries: QueryBlock, items: np.ndarray, ids: np.ndarray, k: int, floor=None):
    """:func:`block_topk` over item chunks of bounded size."""
    best = block_topk(queries, items[:_ITEM_CHUNK], ids[:_ITEM_CHUNK], k, floor)
    for a in range(_ITEM_CHUNK, len(ids), _ITEM_CHUNK):
        low = best[0][:, -1] if floor is None else np.maximum(floor, best[0][:, -1])
        best = merge_topk(*best, *block_topk(queries, items[a : a + _ITEM_CHUNK], ids[a : a + _ITEM_CHUNK], k, low))
    return best


def _long_form(names, qids, keys, scores, ids, ranks=False) -> pa.RecordBatch:
    """Padded (queries, k) arrays as rows, without the padding."""
    row, col = np.nonzero(ids != NO_ID)
    data = [pa.array(qids[row], pa.int64())]
    data += [pa.array(np.full(len(row), v, np.int32)) for v in keys]
    data += [pa.array(ids[row, col], pa.int64()), pa.array(scores[row, col], pa.float64())]
    if ranks:
        data.append(pa.array((col + 1).astype(np.int32)))
    return pa.RecordBatch.from_arrays(data, names)


def _item_columns(items: DataFrame) -> list[str]:
    return ["item_ids", "codes"] if "item_ids" in items.columns else ["item_id", "vec"]


def _hit_names(per: Sequence[str]) -> list[str]:
    return ["qid", *per, "item_id", "score"]


def _hit_schema(per: Sequence[str]) -> str:
    return ", ".join(["qid bigint", *[f"{c} int" for c in per], "item_id bigint", "score double"])


# --- driver side ------------------------------------------------------------------------------


def best_per(hits: DataFrame, k: int, by: Sequence[str], id_col: str = "item_id") -> DataFrame:
    """The ``k`` best rows per group, ties to the lower id; adds ``rk``.

    Spark cuts every task's input to k rows per group before the shuffle (WindowGroupLimit).
    """
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(id_col))
    return hits.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def decoding_ranges(sq: DataFrame | None, limit_bytes: int, dim: int):
    """Decoding ranges per part as a dictionary; False when they exceed the limit."""
    if sq is None:
        return None
    cap = limit_bytes // max(1, 16 * dim)
    table = sq.select("part_id", "vmin", "vdiff").limit(cap + 1).toArrow()  # one row per part
    if table.num_rows > cap:
        return False
    table = table.combine_chunks()
    if table.num_rows == 0:
        return {}
    vmin = list_matrix(table.column("vmin").chunk(0))
    vdiff = list_matrix(table.column("vdiff").chunk(0))
    return {p: (vmin[i], vdiff[i]) for i, p in enumerate(table.column("part_id").to_pylist())}


def _arrow_matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    if table.num_rows == 0:
        return np.zeros((0, dim))
    parts = [list_matrix(c) for c in table.column(column).chunks if len(c)]
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError("vectors of different length reached a kernel; filter invalid vectors first")
    return np.concatenate(parts)


def _int_array(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def topk_join(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    on: Sequence[str] = (),
    per: Sequence[str] = (),
    probes: DataFrame | None = None,
    sq: DataFrame | None = None,
    strategy: str = "auto",
    prefer: str = "queries",
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Top ``k`` items by inner product for every query (and every ``per`` group of items).

    ``queries(qid, qv)``; ``items(item_id, vec)`` plus integer ``on`` and ``per`` columns.
    With ``on``, a query meets only items of its own key: ``probes(qid, *on)`` lists the keys of
    each query, without ``probes`` the queries carry the ``on`` columns themselves.
    Items may also come as blocks of 8-bit codes, ``item_ids`` ARRAY<BIGINT> and ``codes`` BINARY per
    row; ``sq(part_id, vmin, vdiff)`` decodes them and ``part_id`` must be among ``on`` or ``per``.
    Returns ``(qid, *per, item_id, score, rk)``.
    """
    on, per = list(on), list(per)
    n_queries, dim = table_shape(queries, "qv")
    max_rows = limit_bytes // max(1, 8 * dim)
    if strategy == "auto":
        # coded items and probed keys have no broadcast form of the item side
        sides = ["queries"] if sq is not None or probes is not None else ["queries", "items"]
        if prefer == "items":
            sides.reverse()
        rows = {"queries": lambda: n_queries, "items": items.count}
        one_share = {"queries": min(max_rows, _SHARE_BYTES // max(1, 8 * dim)), "items": max_rows}
        strategy = next((side for side in sides if rows[side]() <= one_share[side]), "queries" if n_queries <= max_rows else "packed")
    n_tasks = merge_tasks(n_queries, k)
    if strategy == "items":
        hits = _items_broadcast(queries, items, k, on, per, dim)
        # in place of another form, the rows of a repeated query are merged as there
        return hits if prefer == "items" else _best_of(hits.drop("rk"), k, per, n_tasks)
    if strategy == "queries":
        params = decoding_ranges(sq, limit_bytes, dim)
        pairs = None
        if probes is not None:
            cap = limit_bytes // (8 * (1 + len(on)))
            pairs = probes.select("qid", *on).limit(cap + 1).toArrow()
        if params is not False and (pairs is None or pairs.num_rows <= cap):
            # a part of the queries whose vectors and running top-k fit a task's state, and a pass over the items for each
            shares = max(1, -(-n_queries * k // _STATE_ROWS), -(-n_queries * 8 * dim // _SHARE_BYTES))
            own = queries if shares == 1 else queries.withColumn("_share", F.pmod(F.xxhash64("qid"), F.lit(shares)))
            hits = [
                _queries_broadcast(own if shares == 1 else own.where(F.col("_share") == n), items, k, on, per, pairs, params, dim)
                for n in range(shares)
            ]
            if shares == 1:  # few queries: a task's lists are small, however they are merged
                return best_per(hits[0], k, ["qid", *per])
            return _best_of(reduce(DataFrame.unionByName, hits), k, per, n_tasks)
    hits = _packed(queries, items, k, on, per, probes, sq)
    return _best_of(hits, k, per, n_tasks)


def merge_tasks(n_queries: int, k: int) -> int:
    """Tasks over which the lists of several shares, or of packed blocks, are dealt by query."""
    return max(1, -(-n_queries * k // _TASK_HITS))


def _best_of(hits: DataFrame, k: int, per: Sequence[str], n_tasks: int) -> DataFrame:
    """:func:`best_per` of lists that tasks have cut to ``k`` already: they aren't sorted before the shuffle, and a task takes a bounded share of the queries."""
    return best_per(hits.repartition(n_tasks, "qid"), k, ["qid", *per])


def _queries_broadcast(queries, items, k, on, per, pairs, params, dim) -> DataFrame:
    own_keys = on if pairs is None else []
    table = queries.select("qid", "qv", *own_keys).toArrow()
    qids = _int_array(table, "qid")
    matrix = _arrow_matrix(table, "qv", dim)
    lookup = None
    if on:
        if pairs is None:
            rows, keys = np.arange(len(qids)), [_int_array(table, c) for c in on]
        else:
            order = np.argsort(qids, kind="stable")
            pq = _int_array(pairs, "qid")
            pos = np.searchsorted(qids, pq, sorter=order)
            known = pos < len(qids)
            known[known] = qids[order[pos[known]]] == pq[known]
            rows = order[pos[known]]
            keys = [_int_array(pairs, c)[known] for c in on]
        lookup = {key: np.sort(rows[at]) for key, at in key_groups(keys, len(rows))}
        spark = items.sparkSession
        wanted = spark.createDataFrame(
            pa.table({c: pa.array([key[i] for key in lookup], pa.int32()) for i, c in enumerate(on)}),
        )
        for i, c in enumerate(on):
            values = sorted({key[i] for key in lookup})
            if len(values) <= _PRUNE_VALUES:  # prunes folders of parts nobody asked for
                items = items.where(F.col(c).isin(values))
        # bounded by the collected pairs: rows of keys nobody asked for never reach Python
        items = items.join(F.broadcast(wanted), on, "left_semi")
    payload = items.sparkSession.sparkContext.broadcast((qids, matrix, lookup, params))
    columns = list(dict.fromkeys([*on, *per]))
    part_at = columns.index("part_id") if params is not None else None
    one_key = lookup is not None and set(on) <= set(per)

    def scan(batches):
        qids, matrix, lookup, params = payload.value
        block = QueryBlock(matrix)
        names = _hit_names(per)
        state: dict[tuple, tuple] = {}
        held = 0

        def drain():
            for key, (members, scores, ids) in state.items():
                yield _long_form(names, qids if members is None else qids[members], key, scores, ids)
            state.clear()

        for batch in batches:
            for key, ids, stored in _item_groups(batch, columns):
                at = dict(zip(columns, key))
                asking = None
                if lookup is not None:
                    asking = lookup.get(tuple(at[c] for c in on))
                    if asking is None:
                        continue
                    if len(asking) == len(qids):
                        asking = None
                vectors = _decoded(stored, None if params is None else _range_of(params, key[part_at]))
                group = tuple(at[c] for c in per)
                # one key per group: keep state for the queries of that key only
                members = asking if one_key else None
                if group not in state:
                    size = len(qids) if members is None else len(members)
                    if held + size * k > _STATE_ROWS:  # other groups are done with, or come back for the next merge
                        yield from drain()
                        held = 0
                    state[group] = (members, np.full((size, k), -np.inf), np.full((size, k), NO_ID, np.int64))
                    held += size * k
                _, scores, found = state[group]
                take = slice(None) if asking is None or one_key else asking
                got = _topk_over(block.take(asking), vectors, ids, k, floor=scores[take, -1])
                scores[take], found[take] = merge_topk(scores[take], found[take], *got)
        yield from drain()

    return items.select(*columns, *_item_columns(items)).mapInArrow(scan, _hit_schema(per))


def _items_broadcast(queries, items, k, on, per, dim) -> DataFrame:
    columns = list(dict.fromkeys([*on, *per]))
    table = items.select(*columns, "item_id", "vec").toArrow()
    ids, matrix = _int_array(table, "item_id"), _arrow_matrix(table, "vec", dim)
    groups: dict[tuple, list] = {}
    for key, rows in key_groups([_int_array(table, c) for c in columns], len(ids)):
        at = dict(zip(columns, key))
        groups.setdefault(tuple(at[c] for c in on), []).append(
            (tuple(at[c] for c in per), ids[rows], matrix[rows])
        )
    payload = queries.sparkSession.sparkContext.broadcast(groups)

    def stream(batches):
        names = [*_hit_names(per), "rk"]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            qids = int_column(batch, "qid")
            block = QueryBlock(list_matrix(batch.column(batch.schema.get_field_index("qv"))))
            for key, rows in key_groups([int_column(batch, c) for c in on], len(qids)):
                for group, item_ids, vectors in payload.value.get(key, ()):
                    scores, found = _topk_over(block.take(rows), vectors, item_ids, k)
                    yield _long_form(names, qids[rows], group, scores, found, ranks=True)

    return queries.select("qid", "qv", *on).mapInArrow(stream, _hit_schema(per) + ", rk int")


def _sizes(df: DataFrame, on: list[str], pack_rows: int, stripe: str) -> DataFrame:
    """Blocks and stripes (``stripe``) per key, from one map-side combined count."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))
    packs = F.ceil(F.col("n_rows") / pack_rows).cast("int")
    return counts.select(
        *on,
        packs.alias("n_packs"),
        F.ceil(packs / _STRIPE_PACKS).cast("int").alias(stripe),
    )


def _copied(df: DataFrame, stripe: str, copies) -> DataFrame:
    """A copy of every block for each stripe of the other side."""
    return df.withColumn(stripe, F.explode(F.sequence(F.lit(0), copies - 1)))


def _component_type(df: DataFrame, column: str):
    return np.float64 if df.schema[column].dataType.elementType.typeName() == "double" else np.float32


def _narrow_blocks(df: DataFrame, columns: list[str], id_col: str, vec_col: str, ids_out: str, out: str) -> DataFrame:
    """Rows as blocks ``(columns, ids_out ARRAY<BIGINT>, out BINARY)`` without a shuffle."""
    dtype = _component_type(df, vec_col)

    def pack(batches):
        for batch in batches:
            ids = int_column(batch, id_col)
            matrix = list_matrix(batch.column(batch.schema.get_field_index(vec_col)), dtype)
            for key, rows in key_groups([int_column(batch, c) for c in columns], len(ids)):
                for a in range(0, len(rows), _PACK_ROWS):
                    part = rows[a : a + _PACK_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array([v], pa.int32()) for v in key],
                            pa.array([ids[part]], pa.list_(pa.int64())),
                            pa.array([matrix[part].tobytes()], pa.binary()),
                        ],
                        [*columns, ids_out, out],
                    )

    schema = ", ".join([*[f"{c} int" for c in columns], f"{ids_out} array<bigint>, {out} binary"])
    return df.select(*columns, id_col, vec_col).mapInArrow(pack, schema)


def _packed(queries, items, k, on, per, probes, sq) -> DataFrame:
    """Both sides as blocks, fragmented and replicated over a grid: cell (key, query stripe, item stripe) is a join key."""
    if on:
        left, right, types = _keyed_blocks(queries, items, on, per, probes)
    else:
        left, right, types = _striped_blocks(queries, items, per)
    decode = []
    if sq is not None:
        ids = "item_ids" if "item_ids" in right.columns else "item_pack"
        right, decode = join_small(right, sq.select("part_id", "vmin", "vdiff"), ["part_id"], ids, "left"), ["vmin", "vdiff"]
    sides = [c for c in ("query_pack", "item_pack", "qids", "qvecs", "item_ids", "codes") if c in [*left.columns, *right.columns]]
    known = [c for c in ("part_id",) if decode and c not in per]
    pairs = left.join(right, [*on, "query_stripe", "item_stripe"]).select(*per, *sides, *decode, *known)

    def side(cell, pack, ids, values, dtype):
        if pack in cell:
            ids, vectors = cell[pack].values.flatten()
            return ids.to_numpy().astype(np.int64), _stored(vectors)
        return _block(cell[ids], cell[values], dtype)

    def score(batches):
        names = _hit_names(per)
        state: dict[tuple, list] = {}  # running top-k of the query packs this task has met
        held = 0

        def drain():
            for (group, _), (qids, scores, found) in state.items():
                yield _long_form(names, qids, group, scores, found)
            state.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                qids, vectors = side(cell, "query_pack", "qids", "qvecs", types[0])
                ids, stored = side(cell, "item_pack", "item_ids", "codes", types[1])
                if decode and cell["vmin"].values is None:
                    raise missing_part(cell["part_id"].as_py(), "code range")
                params = tuple(cell[c].values.to_numpy(zero_copy_only=False) for c in decode) or None
                key = (tuple(cell[c].as_py() for c in per), qids.tobytes())
                old = state.get(key)
                got = _topk_over(QueryBlock(vectors), _decoded(stored, params), ids, k, old and old[1][:, -1])
                if old is None:
                    state[key] = [qids.copy(), *got]
                    held += len(qids) * k
                else:
                    old[1:] = merge_topk(old[1], old[2], *got)
            if held > _STATE_ROWS:
                yield from drain()
                held = 0
        yield from drain()

    return pairs.mapInArrow(score, _hit_schema(per))


def _keyed_blocks(queries, items, on, per, probes):
    """Rows of one key come together in salted groups; a hot key is many groups in several stripes, on either side."""
    columns = list(dict.fromkeys([*on, *per]))
    keyed = queries if probes is None else probes.select("qid", *on).join(queries.select("qid", "qv"), "qid")
    blocks = "item_ids" in items.columns
    item_sizes = _sizes(items, on, 1 if blocks else _PACK_ROWS, "n_item_stripes")
    query_sizes = _sizes(keyed, on, _PACK_ROWS, "n_query_stripes")
    items = join_small(items, item_sizes, on, "item_ids" if blocks else "item_id")
    if blocks:  # stored blocks are packs already
        right = items.withColumn("item_stripe", F.pmod(F.xxhash64("item_ids"), F.col("n_item_stripes")).cast("int"))
        right = right.drop("n_packs", "n_item_stripes")
    else:
        salt = F.pmod(F.xxhash64("item_id"), F.col("n_packs")).cast("int")
        salted = items.withColumn("salt", salt).withColumn("item_stripe", F.pmod("salt", "n_item_stripes").cast("int"))
        right = salted.groupBy(*columns, "item_stripe", "salt").agg(
            F.collect_list(F.struct("item_id", "vec")).alias("item_pack")
        )
    right = join_small(right, query_sizes.select(*on, "n_query_stripes"), on, "item_ids" if blocks else "salt")
    right = _copied(right, "query_stripe", F.col("n_query_stripes")).drop("salt", "n_query_stripes")
    keyed = join_small(keyed, query_sizes, on, "qid")
    left = (
        keyed.withColumn("salt", F.pmod(F.xxhash64("qid"), F.col("n_packs")).cast("int"))
        .withColumn("query_stripe", F.pmod("salt", "n_query_stripes").cast("int"))
        .groupBy(*on, "query_stripe", "salt")
        .agg(F.collect_list(F.struct("qid", "qv")).alias("query_pack"))
    )
    left = join_small(left, item_sizes.select(*on, "n_item_stripes"), on, "salt")
    left = _copied(left, "item_stripe", F.col("n_item_stripes")).drop("salt", "n_item_stripes")
    return left, right, (None, np.uint8)


def _striped_blocks(queries, items, per):
    """No key: a block nested loop as an equi-join over the cells of the grid."""
    rows_of_stripe = _PACK_ROWS * _STRIPE_PACKS
    n_items = items.agg(F.sum(F.size("item_ids")).alias("n")).head().n or 0 if "item_ids" in items.columns else items.count()
    n_item_stripes, n_query_stripes = (max(1, -(-n // rows_of_stripe)) for n in (n_items, queries.count()))
    types = (_component_type(queries, "qv"), np.uint8)
    if "item_ids" not in items.columns:
        types = (types[0], _component_type(items, "vec"))
        items = _narrow_blocks(items, per, "item_id", "vec", "item_ids", "codes")
    right = items.withColumn("item_stripe", F.pmod(F.xxhash64("item_ids"), F.lit(n_item_stripes)).cast("int"))
    left = _narrow_blocks(queries, [], "qid", "qv", "qids", "qvecs")
    left = left.withColumn("query_stripe", F.pmod(F.xxhash64("qids"), F.lit(n_query_stripes)).cast("int"))
    return _copied(left, "item_stripe", F.lit(n_item_stripes)), _copied(right, "query_stripe", F.lit(n_query_stripes)), types


# --- assignment: one best item per row, all columns kept ----------------------------------------


def nearest_centroid(
    rows: DataFrame,
    centroids: DataFrame,
    *,
    on: Sequence[str] = (),
    metric: str = "l2",
    strategy: str = "auto",
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Add ``list_id``: the nearest centroid (``l2``) or the best product (``ip``), ties to the lower id.

    ``rows(embedding, *on, ...)``, ``centroids(*on, list_id, centroid)``. With centroids
    within the limit this is a narrow map; beyond it the blocks of both sides are joined. A row whose key
    has no centroid is an error in either form.
    """
    on = list(on)
    dim = vector_dim(centroids, "centroid")
    table = None
    if strategy in ("auto", "items"):
        table = collect_within(centroids.select(*on, "list_id", "centroid"), limit_bytes // max(1, 8 * dim))
    if table is None:
        return _nearest_packed(rows, centroids, on, metric)
    groups = centroid_groups(table, on, metric, dim)
    payload = rows.sparkSession.sparkContext.broadcast(groups)

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            best = nearest_in_batch(batch, payload.value, on, metric)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32())], [*batch.schema.names, "list_id"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "list_id int"])
    return rows.mapInArrow(assign, schema)


def centroid_groups(table: pa.Table, on: Sequence[str], metric: str, dim: int) -> dict:
    """Collected centroids by key: ``{key: (list ids, vectors ready for an inner product)}``."""
    ids, matrix = _int_array(table, "list_id"), _arrow_matrix(table, "centroid", dim)
    if metric == "l2":
        matrix = l2_as_product(matrix)
    return {key: (ids[at], matrix[at]) for key, at in key_groups([_int_array(table, c) for c in on], len(ids))}


def nearest_in_batch(batch: pa.RecordBatch, groups: dict, on: Sequence[str], metric: str) -> np.ndarray:
    """Best list id per row of a batch; a key without centroid is an error."""
    vectors = list_matrix(batch.column(batch.schema.get_field_index("embedding")))
    if metric == "l2":
        vectors = with_constant(vectors)
    best = np.empty(len(vectors), np.int64)
    for key, at in key_groups([int_column(batch, c) for c in on], len(vectors)):
        if key not in groups:
            raise missing_part(key[0] if len(key) == 1 else key, "centroid")
        ids, matrix = groups[key]
        best[at] = _topk_over(QueryBlock(vectors[at]), matrix, ids, 1)[1][:, 0]
    return best


def _nearest_packed(rows, centroids, on, metric) -> DataFrame:
    """Blocks of whole rows meet all centroids of their key, so no row has to be found again.

    Rows stay in the blocks of their task and are dealt over stripes, as many as the key's rows need; each stripe gets a copy of the
    key's centroids. A block is done when it has met as many packs of centroids as its key has.
    """
    types = {c: rows.schema[c].dataType.simpleString() for c in on}
    packs = _sizes(centroids, on, _PACK_ROWS, "_stripes").select(*on, "n_packs")
    # a stripe has many more rows than its key has centroids, which bounds what the copies cost
    most = F.greatest(F.lit(_PACK_ROWS), F.col("n_packs").cast("bigint") * _PACK_ROWS) * _STRIPE_PACKS
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    sizes = counts.join(packs.withColumnsRenamed({c: f"_{c}" for c in on}), reduce(lambda a, b: a & b, same, F.lit(True)), "left").select(
        *on, "n_packs", F.ceil(F.col("n_rows") / F.coalesce(most, F.lit(1 << 62))).cast("int").alias("n_row_stripes")
    )
    left = join_small(_row_blocks(rows, on, types), sizes, on, "_block", null_safe=True)
    left = left.withColumn("row_stripe", F.pmod("_block", "n_row_stripes").cast("int"))
    salt = F.pmod(F.xxhash64("list_id"), F.col("n_packs")).cast("int")
    salted = join_small(centroids.select(*on, "list_id", "centroid"), packs, on, "list_id", null_safe=True).withColumn("salt", salt)
    right = salted.groupBy(*on, "salt", "n_packs").agg(F.collect_list(F.struct("list_id", "centroid")).alias("pack"))
    copies = sizes.where("n_packs IS NOT NULL").select(*on, "n_row_stripes")
    right = join_small(right, copies, on, "salt", null_safe=True)
    # packs that the hash has left empty don't come
    filled = salted.select(*on, "salt").distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("n_filled"))
    left = join_small(left, filled, on, "_block", "left", null_safe=True)
    right = _copied(right, "row_stripe", F.col("n_row_stripes")).select(*[F.col(c).alias(f"_{c}") for c in on], F.col("row_stripe").alias("_stripe"), "pack")
    pairs = left.join(right, reduce(lambda a, b: a & b, same, F.col("row_stripe") == F.col("_stripe")), "left")

    def assign(batches):
        waiting: dict[tuple, list] = {}  # blocks that haven't met all packs: packs met, best scores, best ids
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                needed = cell["n_filled"].as_py()
                with pa.ipc.open_stream(cell["rows"].as_buffer()) as stream:
                    block = stream.read_all().combine_chunks().to_batches()[0]
                if needed is None:
                    key = tuple(cell[c].as_py() for c in on)
                    raise missing_part(key[0] if len(key) == 1 else key, "centroid")
                vectors = list_matrix(block.column(block.schema.get_field_index("embedding")))
                ids, matrix = cell["pack"].values.flatten()
                matrix = list_matrix(matrix)
                if metric == "l2":
                    vectors, matrix = with_constant(vectors), l2_as_product(matrix)
                got = _topk_over(QueryBlock(vectors), matrix, ids.to_numpy().astype(np.int64), 1)
                name = (*(cell[c].as_py() for c in on), cell["_block"].as_py())
                met, *best = waiting.pop(name, [0, *got])
                if met:
                    best = merge_topk(*best, *got)
                if met + 1 < needed:
                    waiting[name] = [met + 1, *best]
                    continue
                found = pa.array(best[1][:, 0], pa.int32())
                yield pa.RecordBatch.from_arrays([*block.columns, found], [*block.schema.names, "list_id"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "list_id int"])
    return pairs.select(*on, "_block", "rows", "n_filled", "pack").mapInArrow(assign, schema)


def _row_blocks(rows: DataFrame, on: list[str], types: dict[str, str]) -> DataFrame:
    """``(*on, _block, rows)``: whole rows of a key as Arrow streams of bounded size, without a shuffle."""

    def pack(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for key, at in key_groups([int_column(batch, c) for c in on], batch.num_rows):
                for a in range(0, len(at), _PACK_ROWS):
                    part = batch.take(pa.array(at[a : a + _PACK_ROWS]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    columns = [pa.array([v], batch.column(batch.schema.get_field_index(c)).type) for c, v in zip(on, key)]
                    block = pa.array([(task << 32) + number], pa.int64())
                    number += 1
                    yield pa.RecordBatch.from_arrays([*columns, block, pa.array([sink.getvalue().to_pybytes()], pa.binary())], [*on, "_block", "rows"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in on], "_block bigint, rows binary"])
    return rows.mapInArrow(pack, schema)
