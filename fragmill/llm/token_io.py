"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is one archive of the Zstandard Seekable Format: frames that decompress each for itself,
then a skippable frame that lists every frame's compressed and decompressed size and the low 32
bits of the XXH64 of its content, and ends in a footer. Frame 0 holds the documents' index
(doc_id, tokens), the others whole documents' ids up to about FRAME bytes, so a reader who wants a few
documents reads the footer, the index and the frames that hold them.

Files come from Spark's own text writer, one record a file, so any store that Spark writes to
will do, and its commit protocol keeps one copy when tasks run again or twice. The writer ends a
record with its line separator, which here is the footer's magic number. Files are in ascending
doc_id order by the numbers in their names, documents in ascending doc_id order in them, rows of equal doc_id by
their texts' hashes.

Cases: a null or empty text is the end id alone. A null doc_id comes first. Repeated rows are kept
each. An empty table writes no archive and reads back as no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, small_batches, table, temporary, tokenizer_path

END_ID = 2
#: Bytes of ids in a frame and in a file, before compression; a longer document has a frame or file of its own.
FRAME, FILE = 1 << 17, 24 << 20
#: The seekable format's numbers: of skippable frames, and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
_NO_ID = -(1 << 63)


def archive(docs: list[tuple[int | None, bytes]], frame_bytes: int = FRAME) -> bytes:
    """The file without its last four bytes (the footer's magic number)."""
    import xxhash
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    index = b"".join(struct.pack("<qI", _NO_ID if d is None else d, len(ids) // 4) for d, ids in docs)
    contents, held, size = [index], [], 0
    for _, ids in docs:
        if held and size + len(ids) > frame_bytes:
            contents.append(b"".join(held))
            held, size = [], 0
        held.append(ids)
        size += len(ids)
    contents.append(b"".join(held))
    frames = [press.compress(c) for c in contents]
    entries = b"".join(struct.pack("<III", len(f), len(c), xxhash.xxh64_intdigest(c) & 0xFFFFFFFF) for f, c in zip(frames, contents, strict=True))
    footer = struct.pack("<IB", len(frames), 0x80)
    return b"".join([*frames, struct.pack("<II", SKIPPABLE, len(entries) + len(footer) + 4), entries, footer])


class Reader:
    """A file's documents; only the frames that are asked for are decompressed."""

    def __init__(self, data: bytes, frame_bytes: int = FRAME):
        n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != FOOTER or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        self.data, at, places = data, 0, len(data) - 9 - 12 * n
        self.frames = []
        for k in range(n):
            packed, size, check = struct.unpack_from("<III", data, places + 12 * k)
            self.frames.append((at, packed, size, check))
            at += packed
        self.docs, frame, used, start = [], 1, 0, 0  # doc_id, its ids before it in the file, ids, frame, place in it
        for doc, n_ids in struct.iter_unpack("<qI", self.content(0)):
            if used and used == self.frames[frame][2]:
                frame, used = frame + 1, 0
            self.docs.append((None if doc == _NO_ID else doc, start, n_ids, frame, used))
            used, start = used + 4 * n_ids, start + n_ids
        self.last: tuple[int, bytes] = (-1, b"")

    def content(self, k: int) -> bytes:
        import xxhash
        import zstandard

        at, packed, size, check = self.frames[k]
        got = zstandard.ZstdDecompressor().decompress(self.data[at : at + packed], max_output_size=size)
        if xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return got

    def ids(self, position: int) -> bytes:
        _, _, n, frame, place = self.docs[position]
        if self.last[0] != frame:
            self.last = (frame, self.content(frame))
        return self.last[1][place : place + 4 * n]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE) -> None:
    """Encodes (doc_id, text) and writes archives below path.

    Texts are dealt by ranges of doc_id and encoded after the shuffle: a text is smaller than its ids.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size = encoder(tokenizer).encode, [], 0
        out = lambda: pa.RecordBatch.from_pydict({"value": pa.array([archive(held)], pa.binary())})
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                if held and size + len(ids) + 4 > file_bytes:
                    yield out()
                    held, size = [], 0
                held.append((doc, ids + end))
                size += len(ids) + 4
        if held:
            yield out()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Rows of one doc_id, or of none, may be many: the text's hash deals them on.
    place = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    files = ordered.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    tail = struct.pack("<I", FOOTER).decode("iso-8859-1")
    files.write.option("maxRecordsPerFile", 1).option("lineSep", tail).option("encoding", "ISO-8859-1").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path string, content binary: the archives below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("path", "content")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the archives below path: doc_id, file, start_in_file, n_tokens, ids_crc32, ids binary.

    doc_ids: decompress the frames of these documents alone.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                reader, rows, size = Reader(data.as_py()), [], 0
                for k, (doc, start, n, _, _) in enumerate(reader.docs):
                    if wanted is None or doc in wanted:
                        ids = reader.ids(k)
                        rows.append((doc, name.as_py(), start, n, zlib.crc32(ids), ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    small_batches(spark)  # few files in a batch: its bytes are bounded
    return files(spark, path).mapInArrow(run, "doc_id long, file string, start_in_file long, n_tokens long, ids_crc32 long, ids binary")


def starts(docs: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before, over all files in their order: by the writing task, then by its count of files.

    Both are numbers in a file's name; as text, the thousandth file would come before the second.
    """
    number = lambda pattern: F.regexp_extract(F.element_at(F.split("file", "/"), -1), pattern, 1).cast("long")
    sizes = docs.groupBy("file").agg(F.sum("n_tokens").alias("in_file")).select("file", "in_file", number(r"^part-(\d+)-").alias("task"), number(r"-c(\d+)\b").alias("count"))
    up = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = sizes.groupBy("task").agg(F.sum("in_file").alias("in_task")).select("task", up(Window.orderBy("task"), "in_task").alias("earlier"))
    sizes = sizes.withColumn("here", up(Window.partitionBy("task").orderBy("count"), "in_file")).join(tasks, "task")
    return docs.join(sizes.select("file", (F.col("earlier") + F.col("here")).alias("before")), "file").withColumn("start", F.col("before") + F.col("start_in_file"))


def op8_token_binary(spark, sf_dir):
    path = f"{temporary(spark, 'token-ids')}/archives"
    write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return starts(read(spark, path).drop("ids")).select("doc_id", "start", "n_tokens", "ids_crc32")
