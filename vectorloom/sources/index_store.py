"""Indexes as Parquet tables, in versions.

Below the path of an index lie ``trained/<folder>/coarse`` and ``.../sq``, written by training only, the blocks of postings in
``blocks/folder=<folder>/part_id=...``, and a manifest per version (:mod:`vectorloom.sources.snapshots`). Folders never change once they are published:
writing an index anew, adding to it and merging additions all fill new folders and publish a version that names them.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators.ivf import IvfIndex, index_append, pack_postings, unpack_postings
from vectorloom.operators.sizing import checkpointed
from vectorloom.sources import snapshots
from vectorloom.sources.snapshots import Entry, Snapshot

_BLOCKS = "list_id int, vec_ids array<bigint>, codes binary, part_id int"
#: Additions of one level that are merged into one of the next.
FAN = 8


def index_write(index: IvfIndex, path: str, mode: str = "overwrite") -> None:
    """Write an index below ``path`` as a new version; what was added to an older one isn't part of it.

    Readers see the version before until the new one is complete. ``mode="error"`` refuses a path that holds an index.
    """
    if mode == "append":
        raise ValueError("centroids and ranges are written by training only; add vectors with index_extend")
    spark = index.coarse.sparkSession
    if mode == "error" and snapshots.versions(spark, path):
        raise ValueError(f"{path} holds an index")
    trained, base = snapshots.new_folder(), snapshots.new_folder()
    index.coarse.write.parquet(f"{path}/trained/{trained}/coarse")
    index.sq.write.parquet(f"{path}/trained/{trained}/sq")
    write_postings(index.postings, f"{path}/blocks/folder={base}")
    snapshots.publish(spark, path, lambda _: Snapshot(0, trained, base))


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings as blocks in one folder per part, every file a contiguous range of lists.

    A search for few parts opens few folders, and row-group statistics skip the lists nobody probes.
    Ranges over (part, list, id) are balanced by size: a hot part or list is cut into several files,
    small ones share a writer. The postings are staged first, because finding the ranges reads them
    twice and assigning every vector twice would cost more than the codes take.
    """
    staged = checkpointed(postings)
    ranged = staged.repartitionByRange("part_id", "list_id", "vec_id")
    blocks = pack_postings(ranged.sortWithinPartitions("part_id", "list_id", "vec_id"))
    blocks.sortWithinPartitions("part_id", "list_id").write.partitionBy("part_id").parquet(path)


def index_extend(spark: SparkSession, path: str, arrivals: DataFrame, batch: str | None = None, **options) -> None:
    """Add ``arrivals(part_id, vec_id, embedding)`` to the index stored at ``path``; its centroids and ranges stay as they are.

    ``batch`` names the addition: writing one of the same name again replaces it in one step, so that a repeated
    micro-batch is stored once. One that was merged with others since (:func:`index_compact`) can't be replaced, which is an error. Vectors
    of a part that the index doesn't know are an error. The addition belongs to the training it was encoded with: if the index is written anew
    meanwhile, that is an error too.
    """
    name = batch or uuid.uuid4().hex
    pinned = _pinned(spark, path)
    _replaceable(pinned, name)
    folder = snapshots.new_folder()
    postings = index_append(index_read(spark, path, pinned.version), arrivals, **options)
    write_postings(postings, f"{path}/blocks/folder={folder}")

    def added(latest: Snapshot | None) -> Snapshot:
        if latest is None or latest.trained != pinned.trained:
            raise RuntimeError(f"the index at {path} was written anew while {name} was added")
        _replaceable(latest, name)
        others = [d for d in latest.deltas if d.batches != (name,)]
        return replace(latest, deltas=(*others, Entry(folder, (name,))))

    snapshots.publish(spark, path, added)


def _replaceable(snapshot: Snapshot, name: str) -> None:
    if any(d.level and snapshots.holds(d, name) for d in snapshot.deltas):
        raise ValueError(f"addition {name} has been merged with others and can't be replaced")


def _due(snapshot: Snapshot, fan: int) -> list[Entry]:
    """The oldest ``fan`` additions of the lowest level that has as many. The last addition of a stream stays as it is: it may be repeated."""
    last = {d.batches[0].rpartition("-")[0]: d.folder for d in snapshot.deltas if d.level == 0}
    free = [d for d in snapshot.deltas if d.level or last[d.batches[0].rpartition("-")[0]] != d.folder]
    for level in sorted({d.level for d in free}):
        same = [d for d in free if d.level == level]
        if len(same) >= fan:
            return same[:fan]
    return []


def index_compact(spark: SparkSession, path: str, fan: int = FAN) -> int:
    """Merge additions until no level has ``fan`` of them; return the number of merges.

    ``fan`` additions become one whose blocks are as long and as sorted as those of a written index, so n additions leave at most about
    ``fan * log(n)`` folders, and a vector is rewritten once per level. Searches give the same results before and after.
    """
    merges = 0
    while True:
        due = _due(_pinned(spark, path), fan)
        if not due:
            return merges
        folder = snapshots.new_folder()
        write_postings(unpack_postings(_blocks(spark, path, [d.folder for d in due])), f"{path}/blocks/folder={folder}")
        merged = Entry(folder, snapshots.folded([b for d in due for b in d.batches]), due[0].level + 1)

        def swapped(latest: Snapshot | None, due=due, merged=merged) -> Snapshot | None:
            if latest is None or not set(due) <= set(latest.deltas):
                return None  # one of them was replaced meanwhile: look again
            at = min(latest.deltas.index(d) for d in due)
            left = [d for d in latest.deltas if d not in due]
            return replace(latest, deltas=(*left[:at], merged, *left[at:]))

        snapshots.publish(spark, path, swapped)
        merges += 1


def _pinned(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    snapshot = snapshots.read_snapshot(spark, path, version)
    if snapshot is None:
        raise FileNotFoundError(f"no index at {path}" + ("" if version is None else f" in version {version}"))
    return snapshot


def _blocks(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    reader = spark.read.schema(f"{_BLOCKS}, folder string").option("basePath", f"{path}/blocks")
    return reader.parquet(*[f"{path}/blocks/folder={f}" for f in folders]).select("part_id", "list_id", "vec_ids", "codes")


def index_read(spark: SparkSession, path: str, version: int | None = None) -> IvfIndex:
    """The index below ``path`` as it is now, or was in a ``version`` that is still kept; later changes don't show in it."""
    pinned = _pinned(spark, path, version)
    trained = f"{path}/trained/{pinned.trained}"
    return IvfIndex(
        spark.read.schema("part_id int, list_id int, centroid array<double>").parquet(f"{trained}/coarse"),
        spark.read.schema("part_id int, vmin array<double>, vdiff array<double>").parquet(f"{trained}/sq"),
        _blocks(spark, path, pinned.folders),
    )


def postings_manifest(index: IvfIndex) -> DataFrame:
    """``(part_id, list_id, n_rows)`` of a stored index, without touching the codes."""
    return index.blocks.groupBy("part_id", "list_id").agg(F.sum(F.size("vec_ids")).alias("n_rows"))
