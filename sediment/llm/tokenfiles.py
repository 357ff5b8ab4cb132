"""Token ids in seekable files: a zstandard frame for each document, a trailing seek table, a checksum for each frame.

A file is a plain concatenation, readable by any zstandard decoder:

    skippable frame 0x184D2A50   JSON: version, width of an id in bytes, tokenizer, end id
    one frame or more a document little-endian unsigned ids; each frame ends with zstandard's own content checksum
    skippable frame 0x184D2A51   zstandard of the document index: has_id u1, doc_id i8, tokens i8, frames u4, as columns
    skippable frame 0x184D2A5E   seek table in the public seekable format: sizes and XXH64 checksum of every frame

A reader fetches the tail, then only the frames of the documents that it wants.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import bases, cut, lean, new_path, shuffle_partitions, slices
from sediment.llm.tokens import encoder

#: Fixed values of the zstandard and seekable formats, and of this format's two frames.
SKIPPABLE_HEAD, SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids in one frame at most; longer documents take several.
FRAME_IDS = 1 << 20


def _opened(uri: str):
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return where, path


class TokenFileWriter:
    """Writes one file; it appears under its name only when it is complete, so a lost task leaves no half file."""

    def __init__(self, uri: str, width: int = 2, about: dict | None = None):
        import zstandard

        if width not in (2, 4):
            raise ValueError("an id takes 2 or 4 bytes")
        self.fs, self.path = _opened(uri)
        task = TaskContext.get()
        self.temp = f"{self.path}.{task.taskAttemptId() if task else 0}.part"
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.out = self.fs.open_output_stream(self.temp)
        self.width, self.frames, self.docs = width, [], []
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self._skippable(SKIPPABLE_HEAD, json.dumps({"version": 1, "width": width, **(about or {})}).encode())

    def _skippable(self, magic: int, body: bytes) -> None:
        self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.frames.append((8 + len(body), 0, 0))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: unsigned little-endian 32-bit integers."""
        import xxhash

        n, data = len(ids) // 4, ids
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            if n and int(wide.max()) > 0xFFFF:
                raise ValueError("an id doesn't fit into 2 bytes")
            data = wide.astype("<u2").tobytes()
        step = FRAME_IDS * self.width
        parts = [data[i : i + step] for i in range(0, len(data), step)] or [b""]
        for part in parts:
            packed = self.zstd.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append((doc_id, n, len(parts)))

    def close(self) -> None:
        ids, tokens, frames = ([d[k] for d in self.docs] for k in range(3))
        index = np.array([i is not None for i in ids], "u1").tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
        index += np.array(tokens, "<i8").tobytes() + np.array(frames, "<u4").tobytes()
        self._skippable(SKIPPABLE_INDEX, struct.pack("<Q", len(ids)) + self.zstd.compress(index))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        self.fs.move(self.temp, self.path)


class TokenFile:
    """Random access to one file. ``docs`` has (doc_id, tokens, first frame, frames) in the order of the file."""

    def __init__(self, uri: str):
        import zstandard

        where, path = _opened(uri)
        self.file, size = where.open_input_file(path), where.get_file_info(path).size
        self.zstd = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        self.frames = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        self.about = json.loads(self._at(8, int(self.frames[0, 0]) - 8))
        body = self._at(int(self.starts[n - 1]) + 8, int(self.frames[n - 1, 0]) - 8)
        k, columns = struct.unpack("<Q", body[:8])[0], self.zstd.decompress(body[8:])
        has, ids = np.frombuffer(columns, "u1", k), np.frombuffer(columns, "<i8", k, k)
        tokens, frames = np.frombuffer(columns, "<i8", k, 9 * k), np.frombuffer(columns, "<u4", k, 17 * k)
        first = 1 + np.concatenate([[0], np.cumsum(frames)])[:-1] if k else []
        self.docs = list(zip([int(i) if h else None for h, i in zip(has, ids, strict=True)], tokens.tolist(), np.asarray(first, np.int64).tolist(), frames.tolist(), strict=True))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, position: int) -> np.ndarray:
        """The ids of the document at this position, as unsigned 32-bit integers; only its frames are read. Raises if a
        checksum is wrong."""
        import xxhash

        _, tokens, first, n = self.docs[position]
        raw, out = self._at(int(self.starts[first]), int(self.starts[first + n] - self.starts[first])), []
        for k in range(first, first + n):
            at = int(self.starts[k] - self.starts[first])
            data = self.zstd.decompress(raw[at : at + int(self.frames[k, 0])], max_output_size=int(self.frames[k, 1])) if self.frames[k, 1] else b""
            if len(data) != self.frames[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            out.append(data)
        found = np.frombuffer(b"".join(out), f"<u{self.about['width']}").astype("<u4")
        if len(found) != tokens:
            raise ValueError(f"document {position} is not whole")
        return found


def _writer(folder: str, tokenizer: str, end_id: int, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, part = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        uri, out, tokens = f"{folder}/part-{part:06d}.tok.zst", None, 0
        for batch in batches:
            for piece in slices(batch):
                for doc, ids in zip(piece.column(0).to_pylist(), known.ids(piece.column(1).to_pylist()), strict=True):
                    out = out or TokenFileWriter(uri, width, {"tokenizer": tokenizer.rpartition("/")[2], "end_id": end_id})
                    out.add(doc, ids + end)
                    tokens += len(ids) // 4 + 1
        if out:
            out.close()
            ids = [d[0] for d in out.docs if d[0] is not None]
            ends = pa.array([min(ids, default=None)], pa.int64()), pa.array([max(ids, default=None)], pa.int64())
            columns = [pa.array([part], pa.int32()), pa.array([uri]), *ends, pa.array([len(out.docs)], pa.int64()), pa.array([tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "uri", "first_id", "last_id", "docs", "tokens"])

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every whole text (null: empty) and ``end_id`` after it, in ascending id order over all files.

    Returns the manifest, a row a file: ``part, uri, first_id, last_id, docs, tokens``. Null ids come first, rows with equal ids follow
    each other in the order of their texts, an empty table gives no file. Other columns are ignored. ``folder`` is a
    URI that executors and readers share; ``tokenizer`` the path of a tokenizers file that every executor has.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = chosen.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(lean(_writer(folder, tokenizer, end_id, width), before=False), "part int, uri string, first_id long, last_id long, docs long, tokens long"), "manifest")


def _reader(wanted: Sequence[int] | None):
    only = None if wanted is None else set(wanted)
    ordered = sorted(only or ())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri, low, high in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if only is not None and (low is None or bisect_left(ordered, low) == bisect_right(ordered, high)):
                    continue
                file, start, rows, held = TokenFile(uri), 0, [], 0
                for position, (doc, tokens, _, _) in enumerate(file.docs):
                    if only is None or doc in only:
                        ids = file.ids(position).tobytes()
                        rows.append((part, doc, start, tokens, ids))
                        held += len(ids)
                    start += tokens
                    if held > 8_000_000 or len(rows) >= 10_000 or rows and position == len(file.docs) - 1:
                        columns = list(zip(*rows, strict=True))
                        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "doc_id", "local", "n_tokens", "ids"])
                        rows, held = [], 0

    return read


def read_token_files(manifest: DataFrame, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """``part, doc_id, start, n_tokens, ids`` (binary) of the documents in the manifest's files, or of ``doc_ids``
    alone, for which only the files are opened whose range of ids has one; ``start`` counts the ids of all documents before, over all files."""
    files = manifest.select("part", "uri", "first_id", "last_id").repartition(max(1, min(manifest.count(), 4 * shuffle_partitions(manifest.sparkSession))), "part")
    rows = files.mapInArrow(lean(_reader(doc_ids)), "part int, doc_id long, local long, n_tokens long, ids binary")
    # a row a file
    return rows.join(F.broadcast(bases(manifest, "part", "tokens")), "part").select(
        "part", "doc_id", (F.col("local") + F.col("tokens_base")).alias("start"), "n_tokens", "ids"
    )


def token_file_digest(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from its file."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = pa.array([zlib.crc32(x) for x in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(lean(crc), "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_folder(spark: SparkSession) -> str:
    return new_path(spark, "tokens")
