"""Repair of the turn structure of conversations by a persistent audit DP.

A conversation's rows are edited (keep, rerole, delete, insert) until their roles read ``(s?(ua)+)?``, at the lowest cost; of equally cheap audits
(the initials of the edits, in order) the ASCII-least one counts. The DP has a cell per state of that pattern. A cell holds its cost and
the last edit of its audit, a node that is linked to the edits before it, so audits share their prefixes. Nodes know their ancestors at
distances 1, 2, 4 ... and a rolling hash of the audit up to them: two audits of equal cost are compared by a search for their longest
common prefix, and equal hashes are verified on the edits.

Rows are put in order once, by a range exchange that doesn't gather a conversation in one task. Conversations are cut into blocks of BLOCK rows; a block's
DP answers, for each state it may be entered in, the cheapest audit to each state it may be left in. The blocks of a conversation
are then joined by the same DP, with a block's audit as a single edit. This is exact: the best audit through a state is the best one to
it followed by the best one from it, as no audit of the same rows is a proper prefix of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.positions import ordered_rows
from vectorloom.operators.sizing import checkpointed

#: Rows of a conversation whose DP is one task's work at a time.
BLOCK = 4096
#: Costs of the edits; a truncated row that isn't deleted costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

_SPACES = " \t\n\x0b\x0c\r"
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # kinds of roles
_NAMES = {USER: "user", ASSISTANT: "assistant"}
NONE, BLANK, DUPLICATE, CUT = range(4)  # faults
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)  # states of the pattern
_NEXT = {
    (START, SYSTEM): AFTER_SYSTEM,
    (START, USER): AFTER_USER,
    (AFTER_SYSTEM, USER): AFTER_USER,
    (AFTER_USER, ASSISTANT): AFTER_ASSISTANT,
    (AFTER_ASSISTANT, USER): AFTER_USER,
}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


# --- audits -----------------------------------------------------------------------------------

_MOD = (1 << 61) - 1
_BASE = 0x1F3B5A9D7C2E4681 % _MOD


class Edits:
    """An audit, as its last part and a link to the audit before it."""

    __slots__ = ("before", "part", "depth", "hash", "up")

    def __init__(self, before: Edits | None, part: str):
        self.before, self.part = before, part
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + int.from_bytes(part.encode(), "big")) % _MOD
        up = [before]
        while len(up[-1].up) >= len(up):  # the ancestor at distance 2^k has one at distance 2^k itself
            up.append(up[-1].up[len(up) - 1])
        self.up = up

    def parts(self) -> list[Edits]:
        """The nodes, first one first."""
        found, node = [], self
        while node.before is not None:
            found.append(node)
            node = node.before
        return found[::-1]

    def text(self) -> str:
        return "".join(n.part for n in self.parts())


def _at_depth(node: Edits, depth: int) -> Edits:
    while node.depth > depth:
        step = (node.depth - depth).bit_length() - 1
        node = node.up[step]
    return node


def _equal(a: Edits, b: Edits) -> bool:
    """Equal audits of equal depth; shared nodes end the check."""
    while a is not b:
        if a.part != b.part:
            return False
        a, b = a.before, b.before
    return True


def less(a: Edits, b: Edits) -> bool:
    """Whether audit ``a`` comes before ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = _at_depth(a, depth), _at_depth(b, depth)
    if x.hash == y.hash:
        return a.depth < b.depth if _equal(x, y) else a.text() < b.text()
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if not _equal(x.before, y.before) or x.part.startswith(y.part) or y.part.startswith(x.part):
        return a.text() < b.text()  # a collision of hashes, or parts that don't decide
    return x.part < y.part


Cell = tuple[int, Edits]


def _better(cell: Cell | None, cost: int, before: Edits, part: str) -> Cell:
    """The cheaper, then ASCII-lesser, of a cell and another audit, whose last node is made only if it may win."""
    if cell is not None and cell[0] < cost:
        return cell
    node = Edits(before, part)
    return (cost, node) if cell is None or cost < cell[0] or less(node, cell[1]) else cell


def _with_inserts(cells: Sequence[Cell | None]) -> list[Cell | None]:
    """Cells after any insertions of empty messages; more than two in a row never pay."""
    start, system, user, assistant = cells
    asked = user
    for cell in (start, system):
        if cell is not None:
            asked = _better(asked, cell[0] + INSERT, cell[1], "I")
    answered = assistant if asked is None else _better(assistant, asked[0] + INSERT, asked[1], "I")
    if assistant is not None:
        asked = _better(asked, assistant[0] + INSERT, assistant[1], "I")
    return [start, system, asked, answered]


def _moves(kind: int, fault: int) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, edit) of the edits of a row."""
    moves = [(s, s, DELETE, "D") for s in range(4)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for (state, role), after in _NEXT.items():
            if role == kind:
                moves.append((state, after, KEEP + extra, "K"))
            elif role in _NAMES:
                moves.append((state, after, REROLE + extra, "R"))
    return moves


_MOVES = {(kind, fault): _moves(kind, fault) for kind in range(4) for fault in range(4)}


def block_audits(kinds: Sequence[int], faults: Sequence[int], entries: Sequence[int]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit): the best audit of a run of rows, for each pair of states."""
    found = []
    for entry in entries:
        cells: list[Cell | None] = [None] * 4
        cells[entry] = (0, Edits(None, ""))
        for row in zip(kinds, faults):
            cells = _with_inserts(cells)
            after: list[Cell | None] = [None] * 4
            for state, to, cost, edit in _MOVES[row]:
                if cells[state] is not None:
                    after[to] = _better(after[to], cells[state][0] + cost, cells[state][1], edit)
            cells = after
        found += [(entry, state, cell[0], cell[1].text()) for state, cell in enumerate(cells) if cell is not None]
    return found


def joined_audit(blocks: Sequence[Sequence[tuple[int, int, int, str]]]) -> Cell:
    """The best audit of a whole conversation: one node per block, then a node per empty message at the end."""
    cells: list[Cell | None] = [(0, Edits(None, "")), None, None, None]
    for block in blocks:
        after: list[Cell | None] = [None] * 4
        for entry, state, cost, audit in block:
            if cells[entry] is not None:
                after[state] = _better(after[state], cells[entry][0] + cost, cells[entry][1], audit)
        cells = after
    cells = _with_inserts(cells)
    best = None
    for cell in (cells[START], cells[AFTER_ASSISTANT]):
        if cell is not None and (best is None or cell[0] < best[0] or (cell[0] == best[0] and less(cell[1], best[1]))):
            best = cell
    return best




def replay(audit: str, state: int, kinds: Sequence[int]) -> Iterator[tuple[str, int | None, int]]:
    """(edit, number of the row or None, state after it) along an audit that is entered in ``state``."""
    row = 0
    for edit in audit:
        kind = kinds[row] if edit == "K" else ASSISTANT if state == AFTER_USER else USER
        if edit != "D":
            state = _NEXT[state, kind]
        yield edit, None if edit == "I" else row, state
        row += edit != "I"


# --- rows -------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``, damaged by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it at once, 4 gives it the role user. Null roles and texts become
    one space; a null id or turn stays null and counts as one space in the sum.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = _given(conversations).withColumn("fate", F.crc32(key.cast("binary")) % 20).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))
    ).drop("col")


def _given(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )


def _said() -> Column:
    """Identity of role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def inspect_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn, kind, fault, said)`` without the texts: every row at its place, with its first fault.

    Rows go by turn (null first), role and a digest of the text. ``fault``: 1 no visible character, 2 role and text seen
    earlier in the conversation, 3 the last visible character ends no sentence, else 0. A text that one conversation repeats any number of times
    is found by partial aggregation; no conversation is gathered in one task.
    """
    visible = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(visible == "", BLANK).when(F.right(visible, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(CUT)
    compact = rows.select("conv_id", "turn", "role", _said().alias("said"), kind.cast("int").alias("kind"), fault.cast("int").alias("fault"))
    # written first: putting rows in order reads them three times (count, sample, exchange)
    placed = ordered_rows(checkpointed(compact), ["turn", "role", "said"], by=["conv_id"]).drop("role")
    first = placed.groupBy("conv_id", "said").agg(F.min("_ord").alias("_first")).select("_first")
    marked = placed.join(first, F.col("_ord") == F.col("_first"), "left")
    repeated = F.col("_first").isNull() & (F.col("fault") != BLANK)
    return marked.withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("fault"))).drop("_first", "_ord")


_AUDIT = "array<struct<entry:int,state:int,cost:bigint,audit:string>>"
_SEGMENTS = (
    "conv_id bigint, block bigint, n bigint, low bigint, high bigint, turns bigint, faults array<bigint>, illegal bigint, "
    f"audits {_AUDIT}, kinds binary, said binary"
)


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[dict]]:
    """Rows that agree on ``keys``, by which the batches are sorted."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if rows and now != key:
                yield rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield rows


class _Output:
    """Rows gathered into batches of bounded weight."""

    def __init__(self, types: dict[str, pa.DataType]):
        self.types, self.rows, self.weight = types, [], 0

    def add(self, rows: list[dict], weight: int) -> Iterator[pa.RecordBatch]:
        self.rows += rows
        self.weight += weight
        if self.weight >= BLOCK:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _record(self.rows, self.types)
        self.rows, self.weight = [], 0


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Output(_SEGMENT_TYPES)
    for rows in _runs(batches, ["conv_id", "block"]):
        kinds, faults = [r["kind"] for r in rows], [r["fault"] for r in rows]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        block = rows[0]["block"]
        audits = block_audits(kinds, faults, [START] if block == 0 else range(4))
        one = {
            "conv_id": rows[0]["conv_id"], "block": block, "n": len(rows),
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
            "faults": [faults.count(f) for f in (BLANK, DUPLICATE, CUT)],
            "illegal": sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:])),
            "audits": [dict(zip(("entry", "state", "cost", "audit"), a)) for a in audits],
            "kinds": bytes(kinds),
            "said": b"".join(r["said"] for r in rows),
        }
        yield from out.add([one], len(rows))
    yield from out.rest()


def _record(rows: list[dict], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))


_SEGMENT_TYPES = {
    **{c: pa.int64() for c in ("conv_id", "block", "n", "low", "high", "turns")},
    "faults": pa.list_(pa.int64()),
    "illegal": pa.int64(),
    "audits": pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
    "kinds": pa.binary(),
    "said": pa.binary(),
}
#: One row per conversation (block null), with its report, and one per block, with the part of the audit it takes.
_CHOICE_TYPES = {
    **{c: pa.int64() for c in ("conv_id", "block", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "place")},
    "state": pa.int32(),
    "audit": pa.string(),
}
_CHOICES = "conv_id bigint, block bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, place bigint, state int, audit string"
_LARGEST = (1 << 63) - 1


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Output(_CHOICE_TYPES)
    for blocks in _runs(batches, ["conv_id"]):
        cost, last = joined_audit([[(a["entry"], a["state"], a["cost"], a["audit"]) for a in b["audits"]] for b in blocks])
        with_turns = [b for b in blocks if b["turns"]]
        distinct = sum(b["turns"] for b in with_turns) - sum(a["high"] == b["low"] for a, b in zip(with_turns, with_turns[1:]))
        gaps = with_turns[-1]["high"] - with_turns[0]["low"] + 1 - distinct if with_turns else 0
        blank, duplicate, cut = (sum(b["faults"][k] for b in blocks) for k in range(3))
        illegal = sum(b["illegal"] for b in blocks) + sum((a["kinds"][-1], b["kinds"][0]) not in _LEGAL for a, b in zip(blocks, blocks[1:]))
        report = dict.fromkeys(_CHOICE_TYPES) | {
            "conv_id": blocks[0]["conv_id"], "gaps": min(gaps, _LARGEST), "blank": blank, "duplicate": duplicate, "truncated": cut,
            "illegal": illegal, "cost": cost, "audit": last.text(),
        }
        state, place, rows = START, 0, [report]
        parts = [n.part for n in last.parts()]
        parts[len(blocks) - 1 :] = ["".join(parts[len(blocks) - 1 :])]  # messages at the end belong to the last block
        for block, part in zip(blocks, parts):
            rows.append(dict.fromkeys(_CHOICE_TYPES) | {"conv_id": block["conv_id"], "block": block["block"], "place": place, "state": state, "audit": part})
            for edit, _, after in replay(part, state, block["kinds"]):
                state, place = after, place + (edit != "D")
        yield from out.add(rows, sum(b["n"] for b in blocks))
    yield from out.rest()


_ENTRY_TYPES = {"conv_id": pa.int64(), "place": pa.int64(), "edit": pa.string(), "new_role": pa.string(), "said": pa.binary()}


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Output(_ENTRY_TYPES)
    for batch in batches:
        for block in batch.to_pylist():
            place, rows = block["place"], []
            for edit, row, after in replay(block["audit"], block["state"], block["kinds"]):
                if edit == "D":
                    continue
                role = None if edit == "K" else _NAMES[ASSISTANT if after == AFTER_ASSISTANT else USER]
                said = None if row is None else block["said"][32 * row : 32 * row + 32]
                rows.append({"conv_id": block["conv_id"], "place": place, "edit": edit, "new_role": role, "said": said})
                place += 1
            yield from out.add(rows, len(rows))
    yield from out.rest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines; only the running digest is held."""
    key, digest = None, None
    done: list[dict] = []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if digest is None or conv_id != key:
                if digest is not None:
                    done.append({"conv_id": key, "repaired_sha256": digest.hexdigest()})
                key, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield _record(done, _HASH_TYPES)
        done = []
    if digest is not None:
        yield _record([{"conv_id": key, "repaired_sha256": digest.hexdigest()}], _HASH_TYPES)


_HASH_TYPES = {"conv_id": pa.int64(), "repaired_sha256": pa.string()}


# --- the operator -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Repaired:
    """``report``: a row per conversation that has rows; ``rows``: the repaired conversations (conv_id, place, role, text, edit)."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, block_rows: int = BLOCK) -> Repaired:
    """Repair the conversations of ``rows (conv_id, turn, role, text)``.

    The report has ``gaps`` (turns missing between the first and the last), the counts of rows whose first fault is ``blank``, ``duplicate`` or
    ``truncated``, ``illegal`` (neighbours whose role initials aren't su, ua or au), and the ``cost`` and ``audit`` of the edits.

    Null roles and texts count as one space, null turns come first and don't count for gaps, a null id is a conversation of its own. Rows that
    tie on turn go by role, then by a digest of the text. A role whose initial isn't s, u or a (also an empty one) can't be kept. Only the
    four columns are read; an empty table gives empty results. Texts travel once to their edit and once to their conversation;
    the order, the faults and the DP work on digests. One conversation's audit is one value, so it has to fit one row.
    """
    given = _given(rows)
    block = F.floor(F.col("pos") / block_rows).alias("block")
    dealt = inspect_rows(rows).select("conv_id", block, "pos", "turn", "kind", "fault", "said").repartition("conv_id", "block")
    segments = checkpointed(dealt.sortWithinPartitions("conv_id", "block", "pos").mapInArrow(_segments, _SEGMENTS))
    by_conversation = segments.drop("said").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    choices = checkpointed(by_conversation.mapInArrow(_choices, _CHOICES))
    report = choices.where("block IS NULL").drop("block", "place", "state")
    taken = choices.where("block IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "place", "state", "audit")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    entries = taken.join(segments.select("conv_id", "block", "kinds", "said"), same).drop("_conv", "_block")
    entries = entries.mapInArrow(_entries, "conv_id bigint, place bigint, edit string, new_role string, said binary")
    texts = given.withColumn("_said", _said()).groupBy(F.col("conv_id").alias("_conv"), "_said").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    found = entries.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    role = F.coalesce("new_role", "role").alias("role")
    return Repaired(report, found.select("conv_id", "place", role, F.coalesce("text", F.lit("")).alias("text"), "edit"))


def repaired_hashes(rows: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of repaired rows: a digest is sequential, so one task reads a conversation, holding none of it."""
    ordered = rows.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(_hashes, "conv_id bigint, repaired_sha256 string")


def repair_report(conversations: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Damage the conversations (:func:`damage`), repair them, and report on every conversation there was.

    A conversation without a row after the damage has zeros, an empty audit and the digest of nothing.
    """
    repaired = repair(damage(conversations), block_rows)
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    report, hashes = repaired.report.withColumnRenamed("conv_id", "_r"), repaired_hashes(repaired.rows).withColumnRenamed("conv_id", "_h")
    whole = ids.join(report, F.col("conv_id").eqNullSafe(F.col("_r")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
