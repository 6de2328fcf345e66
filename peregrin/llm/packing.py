"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised, ended by one id and cut at every multiple of the
sequence length. The pieces are dealt at random (by a hash) into groups of some
thousands, and each group is packed on its own: pieces in order of falling
length, each into the first bin with room. A tournament tree over the bins holds
the largest room below each node, so the first such bin is found from the root
in log(bins) steps.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialise, texts

SEQUENCE = 2048
END_ID = 1
#: As many pieces make a group, on average.
GROUP_PIECES = 8192
#: Entries in each generation of what a task remembers of the ids of chunks and words (some 160 MB in all).
REMEMBERED = 200_000


class Memory:
    """A dictionary of two generations, so that what is often asked for stays."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class ChunkEncoder:
    """Encodes texts by their chunks between white space, which the tokenizer never merges.

    The result equals that of the tokenizer on the whole text: it drops white
    space, works on each chunk alone, and U+001C to U+001F, which Python takes
    for white space and the tokenizer does not, send a text to the tokenizer as
    it is. Chunks repeat, so the ids of most come from a dictionary.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.chunks, self.pieces = Memory(REMEMBERED), Memory(REMEMBERED)
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$%&#]*)").fullmatch
        self.odd = re.compile("[\x1c-\x1f]").search
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.new.get(piece) or self.pieces.old.get(piece)
        if ids is None:
            seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = _packed([t.id for t in self.model.tokenize(seen)])
        return self.pieces.put(piece, ids) if piece not in self.pieces.new else ids

    def chunk(self, chunk: str) -> bytes:
        if m := self.plain(chunk):
            word, marks = m.groups()
            ids = self._piece(word.lower())
            return ids + self._piece(marks) if marks else ids
        return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.odd(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        out, memory = [], self.chunks
        for c in text.split():
            ids = memory.new.get(c)
            if ids is None:
                ids = memory.put(c, memory.old[c] if c in memory.old else self.chunk(c))
            out.append(ids)
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _tokenizer(path: str):
    """One tokenizer for each Python worker process; what an encoder remembers lasts for a task only,
    as workers go on to other stages, whose memory it would take."""
    import os

    import tokenizers

    held = tokenizers.__dict__.setdefault("_peregrin_tokenizers", {})
    if path not in held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        held[path] = tokenizers.Tokenizer.from_file(path)
    return held[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])
    end = _packed([end_id])

    def cut(batches):
        encode = ChunkEncoder(tokenizer_path).encode
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = encode(text.decode()) + end
                n = len(ids) // 4
                for a in range(0, n, sequence):
                    b = min(n, a + sequence)
                    doc.append(key)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(cut, schema)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For lengths in falling order: the bin of each, and its offset there.

    Bins stand at the leaves of a complete tree; each node holds the largest
    room of the leaves below it. No more bins than pieces are ever needed.
    """
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < size:
            node *= 2
            if room[node] < n:
                node += 1
        offsets.append(capacity - room[node])
        bins.append(node - size)
        room[node] -= n
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            room[node] = a if a > b else b
    return bins, offsets


def pack(pieces: DataFrame, *, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Adds sequence_id and offset to each piece.

    Groups hold group_pieces pieces on average, however long the documents: their
    number follows that of the pieces, and a hash of a piece's place in the table
    deals these out evenly, so that equal rows don't gather. pieces has to be a
    written table, where a row has the same place whenever it is read. Equal
    pieces of equal ids may stand in one order or the other.
    """
    groups = max(1, round(pieces.count() / group_pieces))
    schema = T.StructType([f for f in pieces.schema.fields] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def group(table: pa.Table) -> pa.Table:
        base = table["grp"][0].as_py() << 32
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), *((n, "ascending") for n in ("doc_id", "start", "ids_crc32"))])
        table = table.drop_columns(["grp"]).take(order)
        bins, offsets = first_fit_decreasing(table["length"].to_pylist(), sequence)
        return table.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups))).groupBy("grp").applyInArrow(group, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Packs all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; an empty table gives no pieces;
    repeated rows are packed each; other columns are not read.
    """
    pieces = materialise(cut_pieces(docs, tokenizer_path, **options), "pieces")
    return pack(pieces, sequence=options.get("sequence", SEQUENCE))
