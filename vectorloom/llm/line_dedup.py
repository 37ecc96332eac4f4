"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity; two lines whose Jaccard similarity reaches 0.8 share a word in their prefixes, the
rarest fifth or so of each. Lines meet by the words of their prefixes, and pairs go by length, by the position of the shared
word, and by parity bitmaps of their words (the symmetric difference of two sets is at least the number of different bits). Lines that
pairs are left of form components; the word sets of each component are brought together once and verified.

Rarity is the number of lines that a word's bucket occurs in, over all lines, in a table of bounded size. Any fixed order gives the same
result; a bucket shared by several words only makes prefixes a little less selective.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import words
from vectorloom.llm.components import components
from vectorloom.llm.ngram_join import pair_blocks
from vectorloom.operators.sizing import checkpointed

THRESHOLD = Fraction(4, 5)
#: Bits of the rarity table, and of the filter of lines that are verified.
RARITY_BITS, FILTER_BITS = 22, 24
#: Lines that meet by one word in one group; a more frequent word is cut into pairs of blocks of that many lines.
MEET = 8192
#: Entries (a line and a word of its prefix) in one bucket of the candidate search, buckets at least, and lines verified together.
BUCKET_ENTRIES, MIN_BUCKETS, SET_BLOCK = 1 << 18, 16, 512
#: Entries of a table in one of the pieces that are added up (as bits), and words in a line for one 64-bit word of its bitmap.
_PIECE, _PER_BITMAP = 14, 48
#: Partitions of the candidate search: a bucket each, until there are so many.
MAX_PARTITIONS = 20_000
#: Bytes of text whose lines share a blob per bucket.
_BLOB_TEXT = 1 << 19
#: Bits of a word's rarity in the order; rarities beyond are equal, and digests decide.
_RANK_BITS = 16
_NO_ID = np.iinfo(np.int64).min

_LINE = np.dtype([("digest", "u8"), ("n", "i4")])
_ENTRY = np.dtype([("key", "u4"), ("line", "u4"), ("pos", "u4"), ("side", "u1")])
_PLACE = np.dtype([("digest", "u8"), ("doc", "i8"), ("rid", "i8"), ("number", "i4")])
_DOC = np.dtype([("rid", "i8"), ("doc", "i8"), ("n_lines", "i8"), ("with_words", "i8")])


def _needed(total):
    """Words that two lines of ``total`` words together must share."""
    return -(-THRESHOLD.numerator * total // (THRESHOLD.numerator + THRESHOLD.denominator))


def prefix_length(n):
    """Rarest words of a line of ``n`` among which a partner must have one; 0 where only equal sets can match."""
    own = n - -(-THRESHOLD.numerator * n // THRESHOLD.denominator) + 1
    return np.where(n * (THRESHOLD.denominator - THRESHOLD.numerator) >= THRESHOLD.numerator, own, 0)


def _order(major: np.ndarray, *minor: np.ndarray) -> np.ndarray:
    """Order by ``major`` (small numbers), then by the minor keys; the last key is a 64-bit digest.

    One packed 64-bit key is sorted; only if it leaves different digests side by side is the exact, slower sort done.
    """
    *ranks, digest = minor
    bits = 64 - int(major.max(initial=0)).bit_length()
    key = major.astype(np.uint64) << np.uint64(bits)
    for rank in ranks:
        bits -= _RANK_BITS
        key |= rank.astype(np.uint64) << np.uint64(bits)
    key |= digest >> np.uint64(64 - bits)
    order = np.argsort(key)
    key, digest_ = key[order], digest[order]
    if ((key[1:] == key[:-1]) & (digest_[1:] != digest_[:-1])).any():
        return np.lexsort((digest, *ranks[::-1], major))
    return order


class Lines:
    """The lines that hold words of some texts: their distinct words, sorted by digest, and where they stand."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        raw, rel = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        starts = words.word_starts(raw, rel)
        digests = words.start_digests(raw, starts)
        breaks = np.flatnonzero(raw == 10)
        first = np.searchsorted(starts, rel)  # words before each text
        text = np.repeat(np.arange(len(rel) - 1), np.diff(first))
        # a new line begins at every newline and at every text
        passed = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1)[: len(starts)])
        line = passed + text
        order = _order(line, digests)
        line, digests, text, passed = line[order], digests[order], text[order], passed[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (digests[1:] != digests[:-1])
        self.words, line = digests[new], line[new]
        self.offsets = words.runs(line)
        self.size = np.diff(self.offsets)
        newlines = np.searchsorted(breaks, rel)  # newlines before each text
        # a text that isn't empty has one line more than newlines
        self.lines_of = np.where(np.diff(rel) > 0, np.diff(newlines) + 1, 0)
        self.text = text[new][self.offsets[:-1]]
        self.number = passed[new][self.offsets[:-1]] - newlines[self.text]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(self.words ^ np.uint64(0xD6E8FEB86659FD93)))))
        self.digest = words.mix(total[self.offsets[1:]] - total[self.offsets[:-1]])


def _texts(batch: pa.RecordBatch, size: int = words.CHUNK) -> Iterator[tuple[int, Lines]]:
    data, bounds = words.text_buffer(batch.column("text"))
    for a, b in words.chunks(bounds, size):
        yield a, Lines(data, bounds[a : b + 1])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(int(_NO_ID)).to_numpy()


def _row(kind: int, piece: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([piece], pa.int32()), words.binary([x.tobytes()]), words.binary([y.tobytes()])],
        names=["kind", "piece", "x", "y"],
    )


_ROW = "kind int, piece int, x binary, y binary"


def _pieces(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table of counts as sparse pieces: the places that aren't zero, and their counts."""
    some = np.flatnonzero(counts)
    bounds = words.runs(some >> _PIECE)
    for a, b in zip(bounds[:-1], bounds[1:]):
        at = some[a:b]
        yield _row(0, int(at[0] >> _PIECE), (at & ((1 << _PIECE) - 1)).astype(np.uint16), counts[at].astype(np.uint32))


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pieces that come sorted by number, and in bits which of them aren't zero."""
    total, number = np.zeros(1 << _PIECE, np.int64), None
    for batch in batches:
        for piece, x, y in zip(batch.column("piece").to_pylist(), batch.column("x"), batch.column("y")):
            if piece != number:
                if number is not None:
                    yield _dense(number, total)
                total, number = np.zeros(1 << _PIECE, np.int64), piece
            total[np.frombuffer(x.as_buffer(), np.uint16)] += np.frombuffer(y.as_buffer(), np.uint32)
    if number is not None:
        yield _dense(number, total)


def _dense(number: int, total: np.ndarray) -> pa.RecordBatch:
    return _row(0, number, np.minimum(total, 2**32 - 1).astype(np.uint32), np.packbits(total > 0))


def _summed(pieces: DataFrame, bits: int, counts: bool = True) -> np.ndarray:
    """The table that sparse pieces add up to, or the bits of what isn't zero in it; the size is fixed by ``bits``."""
    kind, per, column = (np.uint32, 1, "x") if counts else (np.uint8, 8, "y")
    out = np.zeros((1 << bits) // per, kind)
    rows = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_add_pieces, _ROW).select("piece", column).toArrow()
    for piece, x in zip(rows.column("piece").to_pylist(), rows.column(column)):
        out[(piece << _PIECE) // per : ((piece + 1) << _PIECE) // per] = np.frombuffer(x.as_buffer(), kind)
    return out


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reading of the texts: counts per word bucket (kind 0), lines with words (1), the number of prefix entries (2), documents (3)."""
    counts, entries, none = np.zeros(1 << RARITY_BITS, np.int64), 0, np.zeros(0, np.uint8)
    for batch in batches:
        ids, rid = _ids(batch), batch.column("rid").to_numpy()
        for a, lines in _texts(batch):
            doc = np.empty(len(lines.lines_of), _DOC)
            own = slice(a, a + len(doc))
            doc["rid"], doc["doc"], doc["n_lines"] = rid[own], ids[own], lines.lines_of
            doc["with_words"] = np.bincount(lines.text, minlength=len(doc))
            yield _row(3, 0, doc, none)
            if len(lines.size):
                np.add.at(counts, (lines.words >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
                entries += int(prefix_length(lines.size).sum())
                place = np.empty(len(lines.size), _PLACE)
                place["digest"], place["doc"] = lines.digest, ids[a + lines.text]
                place["rid"], place["number"] = rid[a + lines.text], lines.number
                yield _row(1, 0, place, none)
    yield from _pieces(counts)
    yield _row(2, 0, np.array([entries], np.int64), none)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("x"):
            p = np.frombuffer(x.as_buffer(), _PLACE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["digest"].copy().view(np.int64)), _nullable(p["doc"]), pa.array(p["rid"].copy()), pa.array(p["number"].copy())],
                names=["digest", "doc_id", "rid", "number"],
            )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("x"):
            d = np.frombuffer(x.as_buffer(), _DOC)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["rid"].copy()), _nullable(d["doc"]), pa.array(d["n_lines"].copy()), pa.array(d["with_words"].copy())],
                names=["rid", "doc_id", "n_lines", "with_words"],
            )


def _nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids.copy(), mask=ids == _NO_ID)


def _width(size: np.ndarray) -> np.ndarray:
    return np.maximum(1, 1 << np.ceil(np.log2(size / _PER_BITMAP)).clip(0).astype(np.int64))


def _bitmaps(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmap of each line, of 1, 2, 4 ... 64-bit words by its size, concatenated; and these widths."""
    width = _width(lines.size)
    offsets = np.concatenate(([0], np.cumsum(width)))
    line = np.repeat(np.arange(len(width)), lines.size)
    which = offsets[line] + ((lines.words >> np.uint64(6)) % width[line].astype(np.uint64)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    bit = np.uint64(1) << (lines.words & np.uint64(63))
    bounds = words.runs(which[order])
    out = np.zeros(offsets[-1], np.uint64)
    out[which[order][bounds[:-1]]] = np.bitwise_xor.reduceat(bit[order], bounds[:-1])
    return out, width


def _entries(rarity: np.ndarray, buckets: int):
    """Lines with the words of their prefixes, dealt to buckets by word; a blob per bucket and chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lines in _texts(batch, _BLOB_TEXT):
                if not len(lines.size):
                    continue
                n = lines.size
                line = np.repeat(np.arange(len(n)), n)
                count = rarity[(lines.words >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                order = _order(line, np.minimum(count, (1 << _RANK_BITS) - 1), lines.words)
                # equal lines are one wherever they meet: the first of them stands for all
                fresh = np.zeros(len(n), bool)
                fresh[np.unique(lines.digest, return_index=True)[1]] = True
                prefix = np.where(fresh, prefix_length(n), 0)
                pos = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                owner = np.repeat(np.arange(len(n)), prefix)
                at = order[np.repeat(lines.offsets[:-1], prefix) + pos]
                # a word whose bucket occurs in one line only brings no partner
                met = count[at] > 1
                at, owner, pos = at[met], owner[met], pos[met]
                # a word of many lines is met in pairs of blocks of them
                blocks = (np.maximum(count[at], 1).astype(np.int64) + MEET - 1) // MEET
                own = (lines.digest[owner] % blocks.astype(np.uint64)).astype(np.int64)
                other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                each = np.repeat(np.arange(len(at)), blocks)
                low, high = np.minimum(own[each], other), np.maximum(own[each], other)
                key = lines.words[at][each]
                key = np.where(blocks[each] > 1, words.mix(key ^ (low * (1 << 31) + high + 1).astype(np.uint64)), key)
                side = np.where(low == high, 0, np.where(own[each] == low, 1, 2))
                bucket = (words.mix(key) % np.uint64(buckets)).astype(np.int64)
                entry = np.empty(len(each), _ENTRY)
                entry["key"], entry["line"], entry["pos"], entry["side"] = key >> np.uint64(32), owner[each], pos[each], side
                order = np.argsort(bucket, kind="stable")
                entry, bounds = entry[order], words.runs(bucket[order])
                maps, width = _bitmaps(lines)
                starts = np.cumsum(width) - width
                table = np.empty(len(n), _LINE)
                table["digest"], table["n"] = lines.digest, n
                out = []
                for i, j in zip(bounds[:-1], bounds[1:]):
                    part = entry[i:j]
                    used, part["line"] = np.unique(part["line"], return_inverse=True)
                    w = width[used]
                    some = np.repeat(starts[used] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                    out.append((int(bucket[order[i]]), table[used].tobytes(), maps[some].tobytes(), part.tobytes()))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64())] + [words.binary(list(c)) for c in cols[1:]], names=["g", "lines", "maps", "entries"]
                    )

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket that pass all filters, as a spanning forest (a, b) of line digests."""
    for table in words.whole_groups(batches, "g"):
        bounds = words.runs(table.column("g").to_numpy())
        for a, b in zip(bounds[:-1], bounds[1:]):
            left, right = _bucket_pairs(table.slice(a, b - a))
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"])


def _bucket_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lines, maps, entries, at, bit = [], [], [], 0, 0
    starts = []
    for x, m, e in zip(*(table.column(c).to_pylist() for c in ("lines", "maps", "entries"))):
        own = np.frombuffer(x, _LINE)
        part = np.frombuffer(e, _ENTRY).copy()
        part["line"] += at
        width = _width(own["n"])
        starts.append(bit + np.cumsum(width) - width)
        bit += int(width.sum())
        at += len(own)
        lines.append(own)
        maps.append(np.frombuffer(m, np.uint64))
        entries.append(part)
    lines, entries, maps, starts = (np.concatenate(x) for x in (lines, entries, maps, starts))
    # equal lines are one
    digest, first, cls = np.unique(lines["digest"], return_index=True, return_inverse=True)
    size, starts = lines["n"][first].astype(np.int64), starts[first]
    width = _width(size)
    packed = (entries["key"].astype(np.uint64) << np.uint64(32)) | cls[entries["line"]].astype(np.uint64)
    order = np.argsort(packed)
    packed = packed[order]
    entries = entries[order[np.concatenate(([True], packed[1:] != packed[:-1]))]]
    # words that one line alone has here have no pair
    bounds = words.runs(entries["key"])
    entries = entries[np.repeat(np.diff(bounds) > 1, np.diff(bounds))]
    own = cls[entries["line"]]
    order = np.argsort((entries["key"].astype(np.uint64) << np.uint64(32)) | size[own].astype(np.uint64))
    entries, own = entries[order], own[order]
    key, pos, side, n = entries["key"], entries["pos"].astype(np.int64), entries["side"], size[own]
    folded = _folded(maps, starts, width)
    forest = _Forest(len(digest))
    active = np.arange(len(key))
    for d in range(1, len(key)):
        active = active[active + d < len(key)]
        i, j = active, active + d
        near = (key[i] == key[j]) & (THRESHOLD.denominator * n[i] >= THRESHOLD.numerator * n[j])
        active = i = i[near]  # lengths rise within a word, so that a pair too far apart stays so
        if not len(i):
            break
        j = i + d
        need = _needed(n[i] + n[j])
        good = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & ((side[i] == 0) | (side[i] != side[j]))
        i, j, need = i[good], j[good], need[good]
        unlike = n[i] + n[j] - 2 * need
        good = _different(folded, width, own[i], own[j], unlike) <= unlike
        forest.join(own[i[good]], own[j[good]])
    a, b = forest.edges()
    return digest[a], digest[b]


def _folded(maps: np.ndarray, starts: np.ndarray, width: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width the place of each line, and the bitmaps of all lines at least that wide, folded to it by exclusive or."""
    out = {}
    w = 1
    while w <= int(width.max(initial=1)):
        some = np.flatnonzero(width >= w)
        table = np.empty((len(some), w), np.uint64)
        for full in np.unique(width[some]):
            which = width[some] == full
            rows = maps[starts[some[which]][:, None] + np.arange(full)]
            table[which] = np.bitwise_xor.reduce(rows.reshape(-1, full // w, w), axis=1)
        place = np.full(len(width), -1)
        place[some] = np.arange(len(some))
        out[w] = (place, table)
        w *= 2
    return out


def _different(folded, width, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of pairs differ, on the wider bitmaps only where the narrow ones don't settle it."""
    place, table = folded[1]
    out = np.bitwise_count(table[place[a], 0] ^ table[place[b], 0]).astype(np.int64)
    common = np.minimum(width[a], width[b])
    for w in np.unique(common[common > 1]):
        some = np.flatnonzero((common == w) & (out <= most))
        place, table = folded[int(w)]
        out[some] = np.bitwise_count(table[place[a[some]]] ^ table[place[b[some]]]).sum(axis=1)
    return out


class _Forest:
    """Union-find that keeps the edges which joined something."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        fresh = self.root[a] != self.root[b]
        if not fresh.any():
            return
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            p, q = self._find(x), self._find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.kept.append((x, y))
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                break
            self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(self.kept, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _filter_place(names: np.ndarray) -> np.ndarray:
    return (words.mix(names.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_filter_place(batch.column("name").to_numpy())] = True
    yield from _pieces(bits)


def _filter(names: DataFrame) -> np.ndarray:
    """A bit filter of fixed size for ``names (name)``: it passes all of them, and few others while they are few."""
    return _summed(names.mapInArrow(_filter_pieces, _ROW), FILTER_BITS, counts=False)


def _passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = _filter_place(names)
    return np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)


def _word_sets(lines_filter: np.ndarray, texts_filter: np.ndarray):
    """Lines that may have candidates, with their word sets, from texts that may hold one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(_passes(texts_filter, batch.column("rid").to_numpy())))
            ids = _ids(batch)
            for a, lines in _texts(batch):
                some = _passes(lines_filter, lines.digest)
                some = some[np.unique(lines.digest[some], return_index=True)[1]]
                if not len(some):
                    continue
                size = lines.size[some]
                ends = np.concatenate(([0], np.cumsum(size)))
                at = np.repeat(lines.offsets[:-1][some] - ends[:-1], size) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lines.digest[some].view(np.int64)),
                        _nullable(ids[a + lines.text[some]]),
                        pa.array(lines.number[some].astype(np.int32)),
                        words.packed(lines.words[at], ends),
                    ],
                    names=["digest", "doc_id", "number", "words"],
                )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lines that match an earlier line of their group."""
    for table in words.whole_groups(batches, "g"):
        bounds = words.runs(table.column("g").to_numpy())
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                found = _later_in(table.slice(a, b - a).combine_chunks())
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found)], names=["digest"])


def _later_in(table: pa.Table) -> np.ndarray:
    digest, number, side = (table.column(c).to_numpy() for c in ("digest", "number", "side"))
    doc = table.column("doc_id").fill_null(int(_NO_ID)).to_numpy()
    order = np.lexsort((digest, number, doc))
    sets, offsets = words.unpacked(table.column("words"), np.uint64)
    _, ids = np.unique(sets, return_inverse=True)
    size, crossed = np.diff(offsets), bool(side.any())
    mark = np.zeros(int(ids.max()) + 1, np.int8)
    num, den = THRESHOLD.numerator, THRESHOLD.denominator
    open_ = np.ones(len(order), bool)
    for rank, i in enumerate(order[:-1]):
        rest = order[rank + 1 :]
        rest = rest[open_[rest]]
        rest = rest[(den * np.minimum(size[rest], size[i]) >= num * np.maximum(size[rest], size[i])) & ((side[rest] != side[i]) | (not crossed))]
        if not len(rest):
            continue
        n = size[rest]
        ends = np.cumsum(n)
        at = np.repeat(offsets[rest] - (ends - n), n) + np.arange(ends[-1])
        mine = ids[offsets[i] : offsets[i + 1]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[ids[at]], ends - n, dtype=np.int64)
        mark[mine] = 0
        open_[rest[shared * (den + num) >= num * (n + size[i])]] = False
    return digest[~open_]


def _rid(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(rid, doc_id, n_lines, kept_lines, n_removed)``.

    Lines end at ``\\n``; their order is (id, number in the text, digest), null ids first. A line goes if its set of words (see
    :mod:`vectorloom.llm.words`) has a Jaccard similarity of 0.8 or more with that of any earlier line. ``kept_lines`` are the numbers, from 0, of the lines
    with words that stay; lines without words always stay and aren't listed. An empty or null text has no line. Rows repeated with the same id and
    text count as one document and get equal results. Only the two named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_rid(id_col, text_col).alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    survey = checkpointed(rows.mapInArrow(_survey, _ROW))
    rarity = _summed(survey.where("kind = 0"), RARITY_BITS)
    entries = sum(int.from_bytes(r.x, "little") for r in survey.where("kind = 2").select("x").toLocalIterator())
    buckets = max(MIN_BUCKETS, -(-entries // BUCKET_ENTRIES))
    blobs = rows.mapInArrow(_entries(rarity, buckets), "g bigint, lines binary, maps binary, entries binary")
    partitions = min(buckets, MAX_PARTITIONS)
    dealt = blobs.repartitionById(partitions, (F.col("g") % partitions).cast("int")).sortWithinPartitions("g")
    edges = dealt.mapInArrow(_candidates, "a bigint, b bigint")
    tied = checkpointed(components(edges))
    places = survey.where("kind = 1").mapInArrow(_places, "digest bigint, doc_id bigint, rid bigint, number int")
    first = checkpointed(places.groupBy("digest").agg(F.min(F.struct("doc_id", "number", "rid")).alias("first")))
    lines_filter = _filter(tied.select(F.col("node").alias("name")))
    texts_filter = _filter(first.join(tied, F.col("digest") == F.col("node")).select(F.col("first.rid").alias("name")))
    sets = rows.mapInArrow(_word_sets(lines_filter, texts_filter), "digest bigint, doc_id bigint, number int, words binary")
    sets = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.first("words").alias("words"))
    sizes = tied.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    met = sets.join(tied.withColumnRenamed("node", "digest"), "digest").join(sizes, "component")
    groups = (
        pair_blocks(met, "component", "digest", "members", SET_BLOCK)
        .select("g", "side", "digest", "first.doc_id", "first.number", "words")
        .repartition("g")
        .sortWithinPartitions("g")
    )
    removed = groups.mapInArrow(_later, "digest bigint").distinct()
    kept = (
        first.join(removed, "digest", "left_anti")
        .groupBy("first.rid")
        .agg(F.sort_array(F.collect_list("first.number")).alias("kept_lines"))
    )
    counted = survey.where("kind = 3").mapInArrow(_documents, "rid bigint, doc_id bigint, n_lines bigint, with_words bigint")
    kept_lines = F.coalesce("kept_lines", F.array().cast("array<int>"))
    return counted.join(kept, "rid", "left").select(
        "rid", "doc_id", "n_lines", kept_lines.alias("kept_lines"), (F.col("with_words") - F.size(kept_lines)).cast("bigint").alias("n_removed")
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose texts lack the lines that :func:`line_dedup` removes; a null text becomes an empty one."""
    found = line_dedup(docs, id_col, text_col).select(F.col("rid").alias("__rid"), F.col("kept_lines").alias("__kept")).dropDuplicates(["__rid"])
    stays = F.filter(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1),
        lambda x, i: ~x.rlike(r"[^\x20\x09-\x0D]") | F.array_contains("__kept", i),
    )
    out = docs.withColumn("__rid", _rid(id_col, text_col)).join(found, "__rid", "left").withColumn(text_col, F.array_join(stays, "\n"))
    return out.select(*docs.columns)
