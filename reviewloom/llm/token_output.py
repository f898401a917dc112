"""Token-ID output: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a run of documents in ascending id order:

    frame*        zstandard frames, each of whole documents' ids as little-endian unsigned 32-bit integers
    index         skippable frame: per document its id, whether it is null, first id in the file, ids, frame
    seek table    skippable frame in the layout of the public seekable format of zstandard: compressed size,
                  size and checksum (low half of XXH64) of every frame, their number, a flag byte, a magic number

Any zstandard decoder reads the ids of a whole file; ``TokenFile`` seeks to the frames of the documents asked
for, decompresses only those and checks them. Tasks write the files of their range of ids under a name of
their attempt, and report them only when complete; the reports are written as a table, so a repeated or
speculative task leaves files that nobody lists. ``start`` is the sum over the files before.

Files are written and read through Arrow's file systems, by the URI of the shared folder. The tokenizer's path
is a parameter. Texts of Latin letters are cut into words by the tokenizer's own pattern, and words that a
worker has seen are not encoded again; any other text is encoded whole by the tokenizer, and so is a text that
holds the string of an added token, which gets that token's id.

Defined results: a null text counts as empty and has the end id only. Null ids come first. Rows that repeat
are written each. An empty table has no files. Only ``id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewloom.llm.common import documents, text_or_empty
from reviewloom.session import cut_lineage, scratch_path

END = struct.pack("<I", 0)  # the end id
FRAME_IDS = 1 << 15  # a frame ends with the document that reaches this
FILE_IDS = 1 << 26  # so does a file
CACHE_WORDS = 1 << 18  # and as many of the generation before: about 130 MB in each worker at most
LEVEL = 3
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8"), ("ids", "<u8"), ("frame", "<u4")])
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
# The tokenizer's own word pattern, written out for texts of Latin letters up to U+024F, on whose classes
# every library agrees; other texts are encoded whole.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", " \t\n\r"
OTHER = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
WORDS = re.compile(
    f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{LETTERS}{NUMBERS}{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others,
    in order, for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """A tokenizer that remembers the words it has encoded last: two generations of ``CACHE_WORDS``, of which the older one
    goes when the younger is full, so words in use stay and the memory of a worker does not grow with its input."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens become these tokens' ids, as the library does it; such texts are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> bytes:
        """Ids of one word, as the tokenizer's model gives them for its byte letters."""
        letters = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if OTHER.search(text) or any(token in text for token in self.added):
            return np.array(self.whole(text), dtype="<u4").tobytes()
        words = WORDS.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.older = {}, self.known
            new = set(words)
        for word in new:
            self.known[word] = self.older.pop(word, None) or self.word(word)
        return b"".join(map(self.known.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class TokenWriter:
    """Writes one file to a binary stream."""

    def __init__(self, out):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.index: list[tuple] = []
        self.seek: list[tuple] = []
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        count = len(ids) // 4
        self.index.append((doc_id or 0, doc_id is None, self.total, count, len(self.seek)))
        self.waiting.append(ids)
        self.held += count
        self.total += count
        if self.held >= FRAME_IDS:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.waiting:
            return
        raw = b"".join(self.waiting)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        index = np.array(self.index, dtype=INDEX).tobytes() + struct.pack("<I", len(self.index))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        seek = np.array(self.seek, dtype=SEEK).tobytes() + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class TokenFile:
    """Reads documents of one file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_END or flags != CHECKSUMS:
            raise ValueError("no seek table at the end")
        at = size - 9 - frames * SEEK.itemsize
        self.seek = np.frombuffer(self._read(at, frames * SEEK.itemsize), dtype=SEEK)
        at -= 8
        documents_ = struct.unpack("<I", self._read(at - 4, 4))[0]
        self.index = np.frombuffer(self._read(at - 4 - documents_ * INDEX.itemsize, documents_ * INDEX.itemsize), dtype=INDEX)
        self.offsets = np.concatenate(([0], np.cumsum(self.seek["packed"], dtype=np.int64)))
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, number: int) -> np.ndarray:
        entry = self.seek[number]
        raw = self.unpack.decompress(self._read(int(self.offsets[number]), int(entry["packed"])), max_output_size=int(entry["size"]))
        if len(raw) != entry["size"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(raw, dtype="<u4")

    def read(self, places: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) of the documents at ``places``, all by default. A frame is
        decompressed once for neighbouring documents, and not at all if none is asked for."""
        number, ids, base = -1, None, 0
        for place in range(len(self.index)) if places is None else places:
            entry = self.index[place]
            if entry["frame"] != number:
                number = int(entry["frame"])
                ids, base = self.frame(number), int(self.index["start"][np.searchsorted(self.index["frame"], number)])
            first = int(entry["start"])
            yield (None if entry["null"] else int(entry["doc_id"]), first, ids[first - base : first - base + int(entry["ids"])])


def write_files(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` in id order under ``folder``; gives the written table of files: part, number, path, documents, ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        writer = stream = path = None
        encode = encoder(tokenizer)

        def finished():
            writer.close()
            stream.close()
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": path, "documents": len(writer.index), "ids": writer.total}], schema=REPORT)

        for batch in batches:
            for key, value in zip(batch.column("doc_id"), batch.column("text")):
                if writer is None:
                    path = f"{base}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids.zst"
                    stream = store.open_output_stream(path, compression=None)  # it is compressed already
                    writer = TokenWriter(stream)
                writer.add(key.as_py(), encode.ids(value.as_py()) + END)
                if writer.total >= FILE_IDS:
                    yield finished()
                    writer, number = None, number + 1
        if writer is not None:
            yield finished()

    reports = ordered.mapInArrow(write, "part int, number int, path string, documents long, ids long")
    return cut_lineage(reports.repartition(1))  # a row per file: the tasks write token files only, not a table file each


REPORT = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the files."""
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    placed = files.withColumn("base", F.coalesce(before, F.lit(0)))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    found = []
                    for key, first, ids in TokenFile(source).read():
                        found.append((key, row["base"] + first, len(ids), zlib.crc32(ids.tobytes())))
                        if len(found) == 10_000:
                            yield table(found)
                            found = []
                    yield table(found)

    def table(found):
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, FOUND.types)], schema=FOUND)

    return placed.select("path", "base").repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    files = write_files(documents(spark, sf_dir).select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(files, folder)


QUERIES = {"op8_token_output": op8_token_output}
