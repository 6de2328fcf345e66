"""Fill-in-middle transformation by a secondary sort over pieces of documents.

A document is cut into code points, and its prefix, middle and suffix are moved
round between sentinels. No task ever holds a document's output: a document is
sent out as pieces of at most `chunk` units, keyed by document and output
position; repartitionAndSortWithinPartitions brings them into order, and each
partition streams them into an incremental digest. The same stream reads the
sentinels again and deals the pieces out by their place in the text; a second
sort within the same partitions (the partitioner is the same, so nothing is
shuffled again) streams the restored text into its own digest.

The key of a document is a hash of its id and text, so a piece finds the same
place whichever attempt of a task made it, and repeated rows meet: a task sends
a repeated row's pieces once and a count of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

#: Sentinels of prefix, suffix and middle, in the order of a text's sections where they are restored: 0, 2, 1.
SENTINELS = {"<P>": 0, "<S>": 2, "<M>": 1}
#: Percent of documents to transform, and of those the percent in suffix-prefix-middle order.
RATE, SPM_RATE, SEED = 90, 20, 1
#: Code points of a piece.
CHUNK = 16_384
#: Bytes of text that a partition gets on average, at most.
PARTITION = 64 << 20


def split_points(doc_id: int | None, n: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Ends of prefix and middle in n units, and two draws for the form; a null id counts as empty."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3 % 100, h4 % 100


def plan(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int, int]:
    """Form (plain, psm, spm) and the ends of prefix and middle."""
    a, b, h3, h4 = split_points(doc_id, len(text), seed)
    if not text or h3 >= rate or any(s in text for s in SENTINELS):
        return "plain", a, b
    return "spm" if h4 < spm_rate else "psm", a, b


def sections(form: str, a: int, b: int, n: int) -> list[tuple[str, int, int]]:
    """Sentinel and stretch of the text, in output order."""
    prefix, suffix, middle = ("<P>", 0, a), ("<S>", b, n), ("<M>", a, b)
    return {"plain": [("", 0, n)], "psm": [prefix, suffix, middle], "spm": [suffix, prefix, middle]}[form]


def document_key(doc_id: int | None, text: str) -> bytes:
    return hashlib.blake2b(f"{doc_id}:{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def place(key: tuple) -> int:
    """Of a sort key, the partition: by document alone."""
    return int.from_bytes(key[0][:8], "little")


def packed(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text.encode("utf-8", "surrogatepass"))


def unpacked(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def pieces(rows: Iterable, chunk: int = CHUNK, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Iterator[tuple]:
    """((document, output position), value) of a partition's (id, text) rows.

    Position 0 is the head (id, units, form, prefix, middle); -1 counts rows that repeat one of this partition.
    """
    again: dict[bytes, int] = {}
    for doc_id, text in rows:
        text = text or ""
        key = document_key(doc_id, text)
        if key in again:
            again[key] += 1
            continue
        again[key] = 0
        form, a, b = plan(doc_id, text, seed, rate, spm_rate)
        plain = form == "plain"
        yield (key, 0), (doc_id, len(text), form, None if plain else a, None if plain else b - a)
        at = 1
        for sentinel, start, end in sections(form, a, b, len(text)):
            for i in range(start, max(end, start + 1), chunk):
                data = (sentinel if i == start else "") + text[i : min(end, i + chunk)]
                if data:
                    yield (key, at), packed(data)
                    at += 1
    for key, more in again.items():
        if more:
            yield (key, -1), more


class Reader:
    """Reads the output of a document piece by piece: (section, text), sentinels taken away."""

    def __init__(self, form: str):
        self.form, self.section, self.rest = form, 0, ""

    def feed(self, data: str) -> Iterator[tuple[int, str]]:
        if self.form == "plain":
            yield 0, data
            return
        data = self.rest + data
        while True:
            found = [(i, s) for s in SENTINELS if (i := data.find(s)) >= 0]
            if not found:
                break
            i, s = min(found)
            if i:
                yield self.section, data[:i]
            self.section, data = SENTINELS[s], data[i + len(s) :]
        # What may be a sentinel's beginning waits for the next piece.
        keep = next((k for k in (2, 1) if len(data) >= k and any(s.startswith(data[-k:]) for s in SENTINELS)), 0)
        self.rest = data[len(data) - keep :]
        if len(data) > keep:
            yield self.section, data[: len(data) - keep]

    def close(self) -> Iterator[tuple[int, str]]:
        if self.rest:
            yield self.section, self.rest


def documents(stream: Iterable) -> Iterator[tuple]:
    """A sorted stream as (document, rows, head, iterator of output pieces); of repeated pieces the first counts."""
    current = None
    stream = iter(stream)
    item = next(stream, None)
    while item is not None:
        (current, at), value = item
        rows, head = 0, None
        while item is not None and item[0][0] == current and item[0][1] <= 0:
            (_, at), value = item
            rows, head = (rows + value, head) if at < 0 else (rows + 1, value)
            item = next(stream, None)

        def body():
            nonlocal item
            last = 0
            while item is not None and item[0][0] == current:
                if item[0][1] != last:
                    last = item[0][1]
                    yield unpacked(item[1])
                item = next(stream, None)

        texts = body()
        yield current, rows, head, texts
        for _ in texts:
            pass


def assemble(stream: Iterable) -> Iterator[tuple]:
    """Digests each document's output as it streams by, and deals its pieces out by their place in the text.

    The head at (-1, 0) gets the digest and the number of rows.
    """
    for key, rows, head, texts in documents(stream):
        digest, reader, at = hashlib.sha256(), Reader(head[2]), 0
        for data in texts:
            digest.update(data.encode("utf-8", "surrogatepass"))
            for section, part in reader.feed(data):
                yield (key, section, at), packed(part)
                at += 1
        for section, part in reader.close():
            yield (key, section, at), packed(part)
            at += 1
        yield (key, -1, 0), (*head, digest.hexdigest(), rows)


def restore(stream: Iterable) -> Iterator[tuple]:
    """Digests each restored text: a row per row of the input."""
    digest, head = hashlib.sha256(), None
    for (_, section, _), value in stream:
        if section < 0:
            if head is not None:
                yield from [(*head[:-1], digest.hexdigest())] * head[-1]
            digest, head = hashlib.sha256(), value
        else:
            digest.update(unpacked(value).encode("utf-8", "surrogatepass"))
    if head is not None:
        yield from [(*head[:-1], digest.hexdigest())] * head[-1]


def output_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> RDD:
    """The sorted stream of all documents' output pieces, as assemble() and documents() take it.

    A first job counts the bytes of all texts, by which partitions are numbered.
    """
    rows = docs.select(F.col(id_col), F.col(text_col)).rdd
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    return rows.mapPartitions(lambda it: pieces(it, chunk, seed, rate, spm_rate)).repartitionAndSortWithinPartitions(parts, place)


def middle_texts(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, form, part, text: each document's output in pieces, in order by part from 0.

    Documents whose output is empty have no piece. Of rows that repeat id and
    text one is given; otherwise as middle_report.
    """

    def texts(stream):
        for _, _, head, body in documents(stream):
            for i, data in enumerate(body):
                yield head[0], head[2], i, data

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.sparkSession.createDataFrame(output_pieces(docs, id_col=id_col, **options).mapPartitions(texts), f"doc_id {kind}, form string, part int, text string", verifySchema=False)


def middle_report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for each row of docs.

    Units are code points. A null text is empty, and empty texts stay plain; a
    null id draws as an empty one. Rows that repeat id and text have equal rows;
    rows of one id with different texts are documents of their own. Texts of any
    length stream by in pieces. An empty table gives no rows; other columns
    aren't read.
    """
    sorted_out = output_pieces(docs, id_col=id_col, **options)
    by_place = sorted_out.mapPartitions(assemble, preservesPartitioning=True)
    rows = by_place.repartitionAndSortWithinPartitions(sorted_out.getNumPartitions(), place).mapPartitions(restore)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.sparkSession.createDataFrame(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", verifySchema=False)
