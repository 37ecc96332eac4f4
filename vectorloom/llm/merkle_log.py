"""Merkle manifest of a dataset as append logs in postorder.

Every group of rows (a source) is a tree with runs of three: leaves ascend by id, a run of up to three nodes becomes the digest of their hex
texts, until one node is left; the roots of the groups, ordered by group, form one more tree of the same kind.

Builders work on aligned blocks of ``3 ** LEVELS`` leaves and append each node to the block's log when its last child is complete, which is
postorder. The block roots are the leaves of the next tier, and so on. A node's place in a log follows from the sizes of the
complete subtrees before it (:func:`place`), so proofs take siblings from the log by address: first in the few blocks of the top tier, then
in the blocks below, which get the path of their root from there. No task holds more than one block, however many rows a group has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.positions import ordered_rows
from vectorloom.operators.sizing import checkpointed, join_small

#: Children of a node.
ARITY = 3
#: Levels of a block; a block has ARITY ** LEVELS leaves.
LEVELS = 7
#: Columns of a document's leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, in lowercase hex, of the values: ``-`` for null, else UTF-8 byte count, colon, value."""
    shown = [c.cast("string") for c in columns]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(n: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def place(level: int, j: int, n: int, levels: int, arity: int = ARITY) -> int:
    """Postorder position of node ``j`` of ``level`` in the log of a tree with ``n`` leaves and ``levels`` levels.

    Before a leaf stand the leaves before it and the inner nodes they complete. A node follows its last leaf, after one node of each lower level.
    """
    last = min((j + 1) * arity**level, n) - 1
    return sum(last // arity**k for k in range(levels + 1)) + level


def _digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def postorder_log(leaves: Sequence[str], levels: int, arity: int = ARITY) -> list[str]:
    """All nodes in the order in which they are complete; the root is last. Short runs are closed at the end, even those of one node."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = _digest(open_runs[level])
        open_runs[level] = []
        log.append(node)
        open_runs[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        level = 0
        while level < levels and len(open_runs[level]) == arity:
            close(level)
            level += 1
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return log


def siblings(log: Sequence[str], n: int, levels: int, arity: int = ARITY) -> list[list[tuple[str, str]]]:
    """Per level and node: hex texts of the run's nodes before and after it, read from the log by address."""
    found = []
    for level in range(levels):
        m = -(-n // arity**level)
        nodes = [log[place(level, j, n, levels, arity)] for j in range(m)]
        found.append(
            [("".join(nodes[j - j % arity : j]), "".join(nodes[j + 1 : min(m, j - j % arity + arity)])) for j in range(m)]
        )
    return found


# --- building ---------------------------------------------------------------------------------


def _in_tier(n: Column, tier: int, block: int) -> Column:
    """Nodes of a tree of ``n`` leaves that enter a tier."""
    return F.ceil(n / F.lit(block**tier)).cast("bigint")


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows by (tree, block); the batches are sorted by both."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["tree"], row["block"])
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _build_blocks(levels: int, arity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _blocks_of(batches):
            m = rows[0]["m"]
            up = levels if m > arity**levels else height(m, arity)
            log = postorder_log([r["hash"] for r in rows], up, arity)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree], pa.string()),
                    pa.array([block], pa.int64()),
                    pa.array([rows[0]["n"]], pa.int64()),
                    pa.array([len(rows)], pa.int64()),
                    pa.array([up], pa.int32()),
                    pa.array([log[-1]], pa.string()),
                    pa.array([bytes.fromhex("".join(log))], pa.binary()),
                ],
                names=["tree", "block", "n", "n_leaves", "levels", "hash", "log"],
            )

    return run


_BLOCKS = "tree string, block bigint, n bigint, n_leaves bigint, levels int, hash string, log binary"


def build_logs(leaves: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> list[DataFrame]:
    """Block logs of all trees, one table per tier, for ``leaves (tree, i, hash, n)`` with n leaves in the tree."""
    block = arity**levels
    largest = leaves.agg(F.max("n").alias("n")).head().n or 0
    tiers: list[DataFrame] = []
    nodes = leaves.select("tree", "i", "hash", "n")
    while not tiers or -(-largest // block ** len(tiers)) > 1:
        tier = len(tiers)
        if tier:
            nodes = tiers[-1].where(_in_tier(F.col("n"), tier, block) > 1).select("tree", F.col("block").alias("i"), "hash", "n")
        dealt = (
            nodes.withColumns({"block": F.floor(F.col("i") / block), "m": _in_tier(F.col("n"), tier, block)})
            .repartition("tree", "block")
            .sortWithinPartitions("tree", "block", "i")
        )
        tiers.append(checkpointed(dealt.mapInArrow(_build_blocks(levels, arity), _BLOCKS)))
    return tiers


def roots(tiers: Sequence[DataFrame], levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """``(tree, root)`` of every tree."""
    tops = [_tops(blocks, tier, arity**levels).select("tree", F.col("hash").alias("root")) for tier, blocks in enumerate(tiers)]
    return _union(tops)


def _tops(blocks: DataFrame, tier: int, block: int) -> DataFrame:
    """Blocks that end at the root of their tree."""
    return blocks.where(_in_tier(F.col("n"), tier, block) <= block)


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


# --- proofs -----------------------------------------------------------------------------------


def _extract(names: Sequence[str], schema: pa.Schema, levels: int, arity: int):
    """Siblings of every row of a block, from the block's log, which comes first."""

    def emit(rows: list[dict], paths: list[list[tuple[str, str]]], upper: dict) -> pa.RecordBatch:
        flat = [step for path in paths for step in path]
        offsets = [0]
        for path in paths:
            offsets.append(offsets[-1] + len(path))
        steps = pa.StructArray.from_arrays(
            [pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], names=["left", "right"]
        )
        own = [pa.array([r[c] for r in rows], schema.field(c).type) for c in names]
        path_column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
        same = [pa.array([upper[c]] * len(rows), pa.string()) for c in ("subroot", "root")]
        return pa.RecordBatch.from_arrays([*own, path_column, *same], names=[*names, "path", "subroot", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block), rows in _blocks_of(batches):
            upper, children = rows[0], rows[1:]
            if not children:
                continue
            raw, first = upper["_log"].hex(), block * arity**levels
            log = [raw[i : i + 64] for i in range(0, len(raw), 64)]
            local = siblings(log, upper["_leaves"], upper["_levels"], arity)
            above = [(s["left"], s["right"]) for s in upper["upper"]]
            paths = [[local[k][(r["i"] - first) // arity**k] for k in range(len(local))] + above for r in children]
            yield emit(children, paths, upper)

    return run


def extract_proofs(
    leaves: DataFrame, tiers: Sequence[DataFrame], tops: DataFrame, levels: int = LEVELS, arity: int = ARITY
) -> DataFrame:
    """``leaves (tree, i, ...)`` with ``path`` (siblings left and right, level by level), ``subroot`` and ``root``.

    ``tops (tree, path, subroot, root)`` has the way from the root of every tree on.
    """
    block = arity**levels
    below: DataFrame | None = None  # blocks of this tier that have a parent, with their paths
    for tier in reversed(range(len(tiers))):
        named = tops.select(F.col("tree").alias("_tree"), F.col("path").alias("upper"), "subroot", "root")
        logs = _tops(tiers[tier], tier, block).join(named, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if below is not None:
            logs = logs.unionByName(below.withColumnRenamed("path", "upper").select(logs.columns))
        if tier:
            children = tiers[tier - 1].where(_in_tier(F.col("n"), tier - 1, block) > block).withColumn("i", F.col("block"))
            below = checkpointed(_with_paths(children.drop("block"), logs, levels, arity).withColumnRenamed("i", "block"))
        else:
            return _with_paths(leaves, logs, levels, arity)
    raise ValueError("no tiers")


def _with_paths(children: DataFrame, logs: DataFrame, levels: int, arity: int) -> DataFrame:
    names = children.columns
    own = children.withColumns({"block": F.floor(F.col("i") / arity**levels), "_kind": F.lit(1)})
    held = logs.select(
        "tree", "block", F.lit(0).alias("_kind"), "subroot", "root", "upper", F.col("log").alias("_log"),
        F.col("n_leaves").alias("_leaves"), F.col("levels").alias("_levels"),
    )
    both = own.unionByName(held, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "_kind")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in children.schema)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in children.schema])
    run = _extract(names, schema, levels, arity)
    return both.mapInArrow(run, f"{fields}, path {PATH}, subroot string, root string")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def log_entries(tiers: Sequence[DataFrame], levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """``(tree, position, level, hash)``: every node at its place in the append log of its whole tree."""
    block = arity**levels

    def run(tier: int):
        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n, total, raw = row["n"], height(row["n"], arity), row["log"].hex()
                    out = []
                    for level in range(0 if tier == 0 else 1, row["levels"] + 1):  # its leaves are in the tier below
                        for j in range(-(-row["n_leaves"] // arity**level)):
                            at = 64 * place(level, j, row["n_leaves"], row["levels"], arity)
                            up, across = tier * levels + level, row["block"] * arity ** (levels - level) + j
                            out.append((place(up, across, n, total, arity), up, raw[at : at + 64]))
                    columns = [pa.array([row["tree"]] * len(out), pa.string())]
                    columns += [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "position", "level", "hash"])

        return entries

    return _union([b.mapInArrow(run(t), "tree string, position bigint, level int, hash string") for t, b in enumerate(tiers)])


# --- documents --------------------------------------------------------------------------------


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    columns: Sequence[str] = LEAF_COLUMNS,
    candidates: Mapping[str, Column] | None = None,
    levels: int = LEVELS,
    arity: int = ARITY,
) -> DataFrame:
    """``(doc_id, source, i, leaf, path, subroot, root)`` and the ``candidates``: every row with its proof.

    ``candidates`` names further columns of text (digests of other versions of a row) that are computed in the same reading. Ids ascend within
    a group, a null id first, equal ids by leaf; repeated rows are leaves of their own. A null group is a tree of its own, before all
    others. Null and empty values have different leaves. Only the named columns are read, whatever others there are; an empty table gives
    an empty result. Texts are read once and never shuffled.
    """
    further = dict(candidates or {})
    hashed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(group_col).cast("string").alias("tree"),
        leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        *[c.cast("string").alias(f"candidate_{name}") for name, c in further.items()],
    )
    # written first: putting rows in order reads them three times (count, sample, exchange)
    placed = ordered_rows(checkpointed(hashed), ["doc_id", "leaf"], by=["tree"]).withColumnRenamed("pos", "i").drop("_ord")
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    leaves = join_small(placed, sizes, ["tree"], "i", null_safe=True)
    tiers = build_logs(leaves.withColumnRenamed("leaf", "hash"), levels, arity)
    groups = ordered_rows(roots(tiers, levels, arity), ["tree"]).drop("_ord")
    n_groups = groups.count()
    over = groups.select(
        F.lit("").alias("tree"), F.col("pos").alias("i"), F.col("root").alias("hash"), F.lit(n_groups).cast("bigint").alias("n"), F.col("tree").alias("group")
    )
    over_tiers = build_logs(over, levels, arity)
    whole = roots(over_tiers, levels, arity).select(
        "tree", F.array().cast(PATH).alias("path"), F.col("root").alias("subroot"), "root"
    )
    tops = extract_proofs(over, over_tiers, whole, levels, arity).select(
        F.col("group").alias("tree"), "path", F.col("hash").alias("subroot"), "root"
    )
    proven = extract_proofs(leaves.drop("n"), tiers, checkpointed(tops), levels, arity)
    named = {f"candidate_{name}": name for name in further}
    return proven.withColumnsRenamed({"tree": "source", **named}).select("doc_id", "source", "i", "leaf", "path", "subroot", "root", *further)


def verified_manifest(docs: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``: proofs checked against tampered texts.

    Where 2 divides the unsigned CRC-32 of the decimal id, the line ends of the text are deleted before the leaf is computed again; a text without any, a null text
    and a row with a null id stay as they are. Nulls, ties and empty tables: see :func:`merkle_manifest`.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = leaf_digest([text if c == "text" else F.col(c) for c in LEAF_COLUMNS])
    proven = merkle_manifest(docs, candidates={"presented": tampered}, levels=levels, arity=arity)
    folded = proven.withColumn("folded_root", fold(F.col("presented"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
