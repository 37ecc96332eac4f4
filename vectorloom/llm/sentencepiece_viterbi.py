"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked (a space becomes the mark, one mark stands before it) and cut into words where no piece can reach across. The
distinct words of some texts are sorted, which is a depth-first walk of their trie: the forward scores of a word are those of the word before up to
their common prefix, and only the rest is computed. Characters that are no piece are spelled in byte pieces, so decoding is exact.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from vectorloom.llm import words

#: Default vocabulary file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark that is in a text; no valid text holds it.
_LITERAL = "\ud800"
#: Bytes of text whose words are searched together, and words a task remembers.
CHUNK, CACHE = 1 << 20, 200_000
#: An unknown character costs this much more than the worst piece.
UNKNOWN = 10.0


class Vocabulary:
    """Pieces and scores by id; ids of the 256 byte pieces. Small enough to travel with a task: its size is that of the file."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int], dummy_prefix: bool = True):
        self.pieces, self.scores, self.byte_ids, self.special = pieces, scores, byte_ids, special
        self.dummy_prefix = dummy_prefix
        if any(MARK in p.lstrip(MARK) for n, p in enumerate(pieces) if n not in special):
            raise ValueError("a piece has a mark after other characters; words can't be cut at marks")

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a SentencePiece model file on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids = [-1] * 256
        special = set()
        for n in range(size):
            if model.is_byte(n):
                byte_ids[int(model.id_to_piece(n)[1:-1], 16)] = n
            if model.is_byte(n) or model.is_control(n) or model.is_unknown(n) or model.is_unused(n):
                special.add(n)
        if -1 in byte_ids:
            raise ValueError(f"{path} lacks byte pieces; unknown characters couldn't be decoded")
        return cls([model.id_to_piece(n) for n in range(size)], [model.get_score(n) for n in range(size)], byte_ids, special)


class Encoder:
    """Viterbi search over one vocabulary, with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        normal = [n for n in range(len(vocabulary.pieces)) if n not in vocabulary.special]
        self.tree: dict = {}  # of reversed pieces; at key 0 the piece's score and id
        for n in normal:
            node = self.tree
            for c in reversed(vocabulary.pieces[n]):
                node = node.setdefault(c, {})
            node[0] = (vocabulary.scores[n], n)
        self.unknown = min((vocabulary.scores[n] for n in normal), default=0.0) - UNKNOWN
        breaks = "".join(c for c in "\n\r\t" if not any(c in vocabulary.pieces[n] for n in normal))
        other = f"[^{MARK}{breaks}]"
        self.cut = re.compile(f"{MARK}+{other}*|{other}+" + (f"|[{breaks}]" if breaks else "")).findall
        self.known: dict[str, bytes] = {}

    def marked_words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, _LITERAL).replace(" ", MARK)
        return self.cut(MARK + text if self.vocabulary.dummy_prefix else text)

    def search(self, sorted_words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """The best pieces of each word, as packed 32-bit ids; of equal scores the longest last piece wins.

        Position j of ``best``, ``start`` and ``piece`` belongs to the word's first j characters, so that the next word takes them over up
        to the common prefix.
        """
        tree, unknown, byte_ids = self.tree, self.unknown, self.vocabulary.byte_ids
        best, start, piece, last = [0.0], [0], [0], ""
        for word in sorted_words:
            shared, n = 0, min(len(word), len(last))
            while shared < n and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], start[shared + 1 :], piece[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node = tree.get(word[end - 1])
                found = node and node.get(0)
                at = end - 1
                if found:
                    top, top_at, top_piece = best[at] + found[0], at, found[1]
                else:
                    top, top_at, top_piece = best[at] + unknown, at, -1
                while node and at:
                    node = node.get(word[at - 1])
                    if not node:
                        break
                    at -= 1
                    found = node.get(0)
                    if found and best[at] + found[0] >= top:
                        top, top_at, top_piece = best[at] + found[0], at, found[1]
                best.append(top)
                start.append(top_at)
                piece.append(top_piece)
            out, end = [], len(word)
            while end:
                if piece[end] >= 0:
                    out.append(piece[end])
                else:
                    c = word[end - 1]
                    out += [byte_ids[b] for b in reversed((MARK if c == _LITERAL else c).encode())]
                end = start[end]
            out.reverse()
            last = word
            yield word, array("i", out).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [self.marked_words(t) for t in texts]
        new = {w for ws in cut for w in ws if w not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = {w for ws in cut for w in ws}
        self.known.update(self.search(sorted(new)))
        find = self.known.__getitem__
        return [b"".join(map(find, ws)) for ws in cut]


def _lists(column: list[bytes]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(b) // 4 for b in column]))).astype(np.int32)
    flat = np.frombuffer(b"".join(column), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _extended(df: DataFrame, name: str, kind: DataType) -> StructType:
    """Schema of ``df`` with a column added, or replaced if one has that name."""
    fields = [f for f in df.schema.fields if f.name != name]
    return StructType(fields).add(name, kind)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", keep_text: bool = False) -> DataFrame:
    """``docs`` with the piece ids of its texts in ``ids_col`` (array<int>), which replaces a column of that name; the text column goes unless ``keep_text``.

    Null and empty texts have no ids. Rows stay where they are: nothing is shuffled.
    """
    given = docs.drop(ids_col)
    kept = given if keep_text else given.drop(text_col)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            column = batch.column(text_col)
            bounds = words.text_buffer(column)[1]
            for a, b in words.chunks(bounds, CHUNK):
                ids = encoder.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], _lists(ids)], names=[*names, ids_col])

    return given.mapInArrow(run, _extended(kept, ids_col, ArrayType(IntegerType())))


class Speller:
    """Texts that ids spell. Control pieces spell nothing; bytes that aren't UTF-8 become replacement characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.prefix = vocabulary.dummy_prefix
        self.spelled = [b"" if n in vocabulary.special else p.replace(MARK, " ").encode() for n, p in enumerate(vocabulary.pieces)]
        for value, n in enumerate(vocabulary.byte_ids):
            self.spelled[n] = bytes([value])

    def text(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the texts its ids spell in ``text_col``, which replaces a column of that name; null ids give an empty text.

    Control pieces spell nothing; bytes that aren't UTF-8 become replacement characters.
    """
    given = encoded.drop(text_col)
    names = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(vocabulary)
        for batch in batches:
            ids = (batch.column(ids_col)[row].values for row in range(batch.num_rows))
            texts = ["" if one is None else speller.text(one.to_numpy(zero_copy_only=False)) for one in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, text_col])

    return given.mapInArrow(run, _extended(given, text_col, StringType()))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, n_tokens, ids, text_sha256, exact)``; ``exact`` says that the decoded ids have the text's digest."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
    # both directions in one pass: a task then keeps one Python worker, not two
    names = ["doc_id", "text_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, speller = Encoder(vocabulary), Speller(vocabulary)
        for batch in batches:
            column = batch.column("text")
            bounds = words.text_buffer(column)[1]
            for a, b in words.chunks(bounds, CHUNK):
                ids = encoder.encode(column.slice(a, b - a).to_pylist())
                texts = pa.array([speller.text(np.frombuffer(one, np.int32)) for one in ids], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], _lists(ids), texts], names=[*names, "ids", "text"])

    kind = rows.schema["doc_id"].dataType
    schema = StructType().add("doc_id", kind).add("text_sha256", StringType()).add("ids", ArrayType(IntegerType())).add("text", StringType())
    back = rows.mapInArrow(run, schema)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        "text_sha256",
        (F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256")).alias("exact"),
    )
