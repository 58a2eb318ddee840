"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending id order. Each frame is a zstandard frame of its own over the ids of some
documents (little-endian, 2 bytes where the vocabulary allows it, else 4). The last frame is skippable; its payload is

    per frame      u32 compressed bytes, u32 crc32 of the compressed bytes, u32 documents
    per document   i64 id, u32 ids, u8 (0: the id is null)
    tail           u32 frames, u32 documents, u8 bytes per id, 4 bytes "TMSK"

so a reader finds a document from the table and decompresses its frame only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.batches import only, released, rows, slices, texts
from tidemark.llm.word_ids import BATCH_BYTES, lengths, word_ids
from tidemark.plans.checkpoints import new_folder, stable

SKIPPABLE = 0x184D2A5E  # one of the magic numbers of skippable frames
TAIL = struct.Struct("<IIB4s")
FRAME_TABLE = np.dtype([("bytes", "<u4"), ("crc", "<u4"), ("docs", "<u4")])
DOC_TABLE = np.dtype([("id", "<i8"), ("ids", "<u4"), ("has_id", "u1")])
MAGIC = b"TMSK"
FRAME_IDS = 1 << 18
FILE_BYTES = 64 << 20
LEVEL = 3


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder as a file system of the task, whatever its scheme."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


class FrameWriter:
    def __init__(self, out, id_bytes: int, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.dtype, self.frame_ids = out, f"<u{id_bytes}", frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.held_ids = self.held_docs = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents and their ids, one after the other."""
        table = np.zeros(len(counts), DOC_TABLE)
        table["id"], table["ids"], table["has_id"] = doc_ids, counts, known
        self.docs.append(table)
        at = doc = 0
        for end in np.cumsum(counts).tolist():
            doc += 1
            if end - at + self.held_ids >= self.frame_ids:
                self._hold(ids[at:end], doc)
                self._frame()
                at, doc = end, 0
        self._hold(ids[at:], doc)

    def _hold(self, ids: np.ndarray, docs: int) -> None:
        self.held.append(ids)
        self.held_ids += len(ids)
        self.held_docs += docs

    def _frame(self) -> None:
        if self.held_docs:
            data = self.pack.compress(np.concatenate(self.held).astype(self.dtype).tobytes())
            self.out.write(data)
            self.frames.append((len(data), zlib.crc32(data), self.held_docs))
        self.held, self.held_ids, self.held_docs = [], 0, 0

    def close(self) -> None:
        self._frame()
        frames = np.array(self.frames, FRAME_TABLE) if self.frames else np.zeros(0, FRAME_TABLE)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, DOC_TABLE)
        payload = frames.tobytes() + docs.tobytes() + TAIL.pack(len(frames), len(docs), int(self.dtype[2:]), MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(payload)) + payload)


class FrameReader:
    """Random access to one file (``pyarrow`` input file)."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - TAIL.size)
        n_frames, n_docs, self.id_bytes, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("no seek table")
        table = n_frames * FRAME_TABLE.itemsize + n_docs * DOC_TABLE.itemsize
        file.seek(size - TAIL.size - table)
        raw = file.read(table)
        self.frames = np.frombuffer(raw, FRAME_TABLE, n_frames)
        self.docs = np.frombuffer(raw, DOC_TABLE, n_docs, n_frames * FRAME_TABLE.itemsize)
        ends = np.cumsum(self.frames["bytes"].astype(np.int64))
        self.begins = ends - self.frames["bytes"]
        self.doc_ends = np.cumsum(self.frames["docs"].astype(np.int64))

    def frame(self, i: int) -> np.ndarray:
        self.file.seek(int(self.begins[i]))
        data = self.file.read(int(self.frames["bytes"][i]))
        if zlib.crc32(data) != int(self.frames["crc"][i]):
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(self.unpack.decompress(data), f"<u{self.id_bytes}").astype("<u4")

    def frame_docs(self, i: int) -> np.ndarray:
        end = int(self.doc_ends[i])
        return self.docs[end - int(self.frames["docs"][i]):end]

    def document(self, place: int) -> np.ndarray:
        """Ids of the document at ``place`` in the file; one frame is decompressed."""
        i = int(np.searchsorted(self.doc_ends, place, "right"))
        counts = self.frame_docs(i)["ids"].astype(np.int64)
        inside = place - int(self.doc_ends[i]) + len(counts)
        start = int(counts[:inside].sum())
        return self.frame(i)[start:start + int(counts[inside])]


def write_frames(docs: DataFrame, tokenizer: str, folder: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files below ``folder`` and returns their manifest (shard, file, n_docs, n_ids), in order of shards.

    One range sort by (doc_id, hash of the text), null first; a file is written under a name of its own attempt, and the
    manifest names those of the attempts that counted. Null and empty texts are the end id alone; repeated rows are
    written each; an empty table gives an empty manifest.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = writer = None
        for batch in slices(batches, limit=BATCH_BYTES):
            if writer is None:
                words = word_ids(tokenizer)
                id_bytes = 2 if max(words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                shard = TaskContext.get().partitionId()
                files, path = open_folder(folder)
                files.create_dir(path, recursive=True)
                name = f"tokens-{shard:06d}-{uuid.uuid4().hex}.zst"
                out = files.open_output_stream(f"{path}/{name}", compression=None)
                writer, n_docs, n_ids = FrameWriter(out, id_bytes), 0, 0
            encoded = words.encode(texts(batch))
            counts = lengths(encoded)
            ids = np.insert(encoded.ids, np.cumsum(counts), end_id)
            keys = batch.column("doc_id")
            writer.add(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False), ids, counts + 1)
            n_docs, n_ids = n_docs + len(counts), n_ids + len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield rows(shard=[shard], file=[name], n_docs=[n_docs], n_ids=[n_ids])
    source = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = source.withColumn("_tie", F.xxhash64("text"))
    placed = placed.repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return stable(placed.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"))


def read_frames(manifest: DataFrame, folder: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files frame by frame.

    ``start`` counts the ids of all documents before it: those of earlier files from the manifest (one row per file), those
    of the same file from its seek table.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(f"{path}/{name}") as file:
                    reader = FrameReader(file)
                    for i in range(len(reader.frames)):
                        ids, docs = reader.frame(i), reader.frame_docs(i)
                        counts = docs["ids"].astype(np.int64)
                        ends = np.cumsum(counts)
                        view = memoryview(ids).cast("B")
                        out = {"doc_id": pa.array(docs["id"].astype(np.int64), mask=docs["has_id"] == 0), "start": start + ends - counts, "n_tokens": counts,
                               "ids_crc32": np.fromiter((zlib.crc32(view[4 * (e - c):4 * e]) for c, e in zip(counts.tolist(), ends.tolist())), np.int64, len(counts))}
                        if with_ids:
                            out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                        start += int(ends[-1])
                        yield rows(**out)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start"))
    files = max(1, manifest.count())
    return placed.repartition(files, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` and reads the files back; see ``write_frames`` and ``read_frames``."""
    folder = folder or new_folder(docs.sparkSession)
    return read_frames(write_frames(docs, tokenizer, folder, **options), folder)
