"""Token ids in files of fixed-width packed blocks.

Every id takes the fewest bits that the vocabulary needs. A file holds::

    "TMIDS1\\0\\0"
    blocks       BLOCK ids each (the last fewer), lowest bit first, from a whole byte on
    offsets      where each block begins, and the end of the last (64 bits each)
    documents    doc_id, whether it is known (one byte each), and each one's first id, then the end
    footer       bits, block, ids, documents, places of offsets and documents, "TMIDS1\\0\\0"

so any range of ids is read by seeking to its blocks and unpacking them with a few numpy
operations. Documents are dealt by ranges of doc_id and sorted within; each task streams
its documents into files of at most about ``FILE_IDS`` ids, written under a name of their own and
then renamed, so that a task that runs again leaves the same files. Files go below the given
folder, which all executors share, through pyarrow's file systems.

A null text is taken as empty: it has the end id alone. Rows with the same doc_id stand
next to each other, ordered by a hash of the text; a null doc_id comes first. An empty table
gives no files. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymap.llm.encode import encoder
from tallymap.llm.tables import map_rows, parts
from tallymap.session import new_path, write_stage

MAGIC = b"TMIDS1\0\0"
FOOTER = struct.Struct("<IIQQQQ8s")
#: Ids of a block; a multiple of 8, so that a block ends with a whole byte.
BLOCK = 8192
#: Ids after which a task begins a new file.
FILE_IDS = 1 << 24


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits == 0 or not len(ids):
        return b""
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_ids(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids: each is read from the eight bytes in which its bits begin."""
    padded = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    at = np.arange(count, dtype=np.int64) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(count, dtype=np.uint64)
    for k in range((bits + 14) // 8):
        word |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class IdWriter:
    """One file, written from front to back."""

    def __init__(self, system: fs.FileSystem, path: str, attempt: int, bits: int, block: int = BLOCK):
        folder, _, name = path.rpartition("/")
        self.system, self.path, self.bits, self.block = system, path, bits, block
        self.under = f"{folder}/.{name}.{attempt}"
        self.out = system.open_output_stream(self.under)
        self.out.write(MAGIC)
        self.at, self.offsets = len(MAGIC), []
        self.docs: list[int] = []
        self.known: list[int] = []
        self.first: list[int] = []
        self.ids, self.rest = 0, b""

    def _blocks(self, data: bytes) -> None:
        for i in range(0, len(data), 4 * self.block):
            packed = pack_ids(np.frombuffer(data[i : i + 4 * self.block], dtype="<u4"), self.bits)
            self.offsets.append(self.at)
            self.out.write(packed)
            self.at += len(packed)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc or 0)
        self.known.append(doc is not None)
        self.first.append(self.ids)
        self.ids += len(ids) // 4
        data = self.rest + ids
        whole = len(data) // (4 * self.block) * (4 * self.block)
        self._blocks(data[:whole])
        self.rest = data[whole:]

    def close(self) -> None:
        self._blocks(self.rest)
        blocks = self.at
        self.out.write(np.array([*self.offsets, self.at], dtype="<u8").tobytes())
        docs = blocks + 8 * (len(self.offsets) + 1)
        self.out.write(np.array(self.docs, dtype="<i8").tobytes() + np.array(self.known, dtype=np.uint8).tobytes())
        self.out.write(np.array([*self.first, self.ids], dtype="<u8").tobytes())
        self.out.write(FOOTER.pack(self.bits, self.block, self.ids, len(self.docs), blocks, docs, MAGIC))
        self.out.close()
        self.system.move(self.under, self.path)


class IdFile:
    """Random access to a file's ids."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.data = system.open_input_file(path)
        size = self.data.size()
        footer = self.data.read_at(FOOTER.size, size - FOOTER.size)
        self.bits, self.block, self.n_ids, self.n_docs, blocks, docs, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a file of packed ids")
        self.offsets = np.frombuffer(self.data.read_at(docs - blocks, blocks), dtype="<u8").astype(np.int64)
        tail = self.data.read_at(size - FOOTER.size - docs, docs)
        n = self.n_docs
        self.docs = np.frombuffer(tail[: 8 * n], dtype="<i8")
        self.known = np.frombuffer(tail[8 * n : 9 * n], dtype=np.uint8)
        self.first = np.frombuffer(tail[9 * n :], dtype="<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``; only their blocks are read."""
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        low, high = start // self.block, (end - 1) // self.block
        data = self.data.read_at(int(self.offsets[high + 1] - self.offsets[low]), int(self.offsets[low]))
        count = min(self.n_ids, (high + 1) * self.block) - low * self.block
        # full blocks end with a whole byte, so consecutive ones are one run of bits
        return unpack_ids(data, count, self.bits)[start - low * self.block : end - low * self.block]

    def close(self) -> None:
        self.data.close()


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_ids(docs: DataFrame, folder: str, path: str, vocabulary: int, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; one row per file: its
    place in the order (task, number), file, documents, ids. Runs once, when called."""
    bits = bits_for(vocabulary)

    def run(batches):
        import pyarrow as pa

        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        out, found = None, []

        def closed():
            out.close()
            found.append((task, len(found), out.path.rpartition("/")[2], len(out.docs), out.ids))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name = f"part-{task:07d}-{len(found):04d}.ids"
                    out = IdWriter(system, f"{root}/{name}", attempt, bits)
                out.add(doc, enc.ids(text) + end)
                if out.ids >= file_ids:
                    closed()
                    out = None
        if out is not None:
            closed()
        if found:
            yield pa.RecordBatch.from_pydict(
                dict(zip(("task", "number", "file", "n_docs", "n_ids"), map(list, zip(*found, strict=True)), strict=True)),
                schema=pa.schema([("task", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    files = rows.mapInArrow(run, "task int, number int, file string, n_docs long, n_ids long")
    return write_stage(files, "id-files")


def read_ids(files: DataFrame, folder: str, most: int = 1 << 18) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids.

    ``files`` is what ``write_ids`` gives; files before a file decide where its ids start.
    """
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("start"))

    def rows(batch):
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, root = _place(folder)
            file = IdFile(system, f"{root}/{name}")
            first = file.first.tolist()
            doc = 0
            while doc < file.n_docs:
                # documents whose ids are read at once; one that is larger is read in runs
                last = max(doc + 1, int(np.searchsorted(file.first, first[doc] + most, side="right")) - 1)
                if last == doc + 1:
                    crc = 0
                    for at in range(first[doc], first[last], most):
                        crc = zlib.crc32(file.ids(at, min(first[last], at + most)).astype("<u4").tobytes(), crc)
                    crcs = [crc]
                else:
                    ids = file.ids(first[doc], first[last]).astype("<u4")
                    crcs = [zlib.crc32(ids[first[d] - first[doc] : first[d + 1] - first[doc]].tobytes()) for d in range(doc, last)]
                for d, crc in zip(range(doc, last), crcs, strict=True):
                    yield (int(file.docs[d]) if file.known[d] else None), start + first[d], first[d + 1] - first[d], crc
                doc = last
            file.close()

    spread = placed.repartition(max(1, files.count()), "file")
    return map_rows(spread, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, vocabulary: int, end_id: int = 2) -> DataFrame:
    """Write all documents' ids to a new folder in the shared one and read them back."""
    folder = new_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, path, vocabulary, end_id), folder)
