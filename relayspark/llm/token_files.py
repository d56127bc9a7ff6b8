"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A writer task holds a run of documents in ``doc_id`` order and writes it as one or more files below the
shared folder, each renamed into place when whole, so a task that runs twice leaves the same files. A file:

    magic, counts | boundary low bits | boundary high bits | select samples | document ids | token ids

The boundaries (n + 1 rising offsets) take about 2 + log2(ids / documents) bits each. ``EliasFano.select_run``
answers the i-th offset, and those behind it, from the high bits and a sample of every 256th one; readers
take documents by it, a batch at a time, without a table of all offsets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayspark.llm.common import BATCH_ROWS, python_ready, shared_dir, written
from relayspark.llm.encoding import binary_array, encoder, with_end

#: Fixed values of the file format.
MAGIC = b"RSEFTOK1"
HEADER = "<8sQQQQQQQ"
SAMPLE = 256
#: The id that ends a document, and the ids after which a writer starts a new file (8 or 16 MB).
END_ID = 2
FILE_IDS = 4 << 20

MANIFEST = "part int, file int, path string, n_docs long, n_ids long, ids_before long"
RESULT = "doc_id long, start long, n_tokens long, ids binary"


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.select_run(i, 1)[0])

    def select_run(self, i: int, n: int) -> np.ndarray:
        """The i-th value and those behind it, ``n`` in all: only the high bits from the sample before the first
        to the sample behind the last are read."""
        at, last = int(self.samples[i // SAMPLE]), (i + n - 1) // SAMPLE + 1
        stop = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        window = np.unpackbits(self.high[at >> 3 : (stop >> 3) + 1], bitorder="little")[at & 7 :]
        index = np.arange(i, i + n, dtype=np.int64)
        upper = at + np.flatnonzero(window)[index - i // SAMPLE * SAMPLE] - index
        first = i * self.low_bits
        end = first + n * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (end + 7) >> 3], bitorder="little")[first & 7 :][: end - first]
        lower = bits.reshape(n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (upper << self.low_bits) + lower


def file_bytes(doc_ids: list[int | None] | pa.Array, counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """One file of the documents' ``tokens``, 16 or 32 bits each."""
    names = doc_ids if isinstance(doc_ids, pa.Array) else pa.array(doc_ids, pa.int64())
    ef = EliasFano.encode(np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))]))
    known = np.packbits(names.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
    keys = names.fill_null(0).to_numpy().astype("<i8")
    head = struct.pack(HEADER, MAGIC, len(names), len(tokens), tokens.itemsize, ef.low_bits, len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([head, *(x.tobytes() for x in (ef.low, ef.high, ef.samples, known, keys, tokens))])


class TokenFile:
    """A file's contents: ``boundaries`` (Elias-Fano), document ids, and ids by document."""

    def __init__(self, data: bytes):
        magic, n_docs, n_ids, width, low_bits, n_low, n_high, n_samples = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        low, high, samples = take("u1", n_low), take("u1", n_high), take("<u4", n_samples)
        self.boundaries = EliasFano(n_docs + 1, low_bits, low, high, samples)
        known = np.unpackbits(take("u1", -(-n_docs // 8)), bitorder="little")[:n_docs]
        self.doc_ids = pa.array(take("<i8", n_docs), mask=known == 0)
        self.ids = take("<u4" if width == 4 else "<u2", n_ids)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        start, end = self.boundaries.select_run(i, 2)
        return self.ids[start:end]


def _store(uri: str):
    """A file system that executors reach, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _write(vocabulary: str, folder: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        enc = encoder(vocabulary)
        kind = "<u4" if enc.wide or end_id >= 1 << 16 else "<u2"
        store, root = _store(folder)
        keys, counts, bodies, made, before, held = [], [], [], [], 0, 0

        def flush():
            nonlocal keys, counts, bodies, before, held
            path = f"{root}/part-{part:06d}-{len(made):06d}.tok"
            names = pa.concat_arrays(keys)
            with store.open_output_stream(f"{path}.{attempt}.tmp") as out:
                out.write(file_bytes(names, np.concatenate(counts), np.concatenate(bodies)))
            store.move(f"{path}.{attempt}.tmp", path)
            made.append((part, len(made), path, len(names), held, before))
            before += held
            keys, counts, bodies, held = [], [], [], 0

        for batch in batches:
            ids, sizes = with_end(*enc.encode_column(batch.column("text")), end_id, kind)
            keys.append(batch.column("doc_id"))
            counts.append(sizes)
            bodies.append(ids)
            held += len(ids)
            if held >= file_ids:
                flush()
        if held:
            flush()
        columns = list(zip(*made, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["part", "file", "path", "n_docs", "n_ids", "ids_before"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    got = TokenFile(source.readall())
                for at in range(0, len(got.doc_ids), BATCH_ROWS):
                    names = got.doc_ids.slice(at, BATCH_ROWS)
                    bounds = got.boundaries.select_run(at, len(names) + 1)
                    sizes = np.diff(bounds)
                    ids = binary_array(got.ids[bounds[0] : bounds[-1]].astype("<u4"), sizes).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(bounds[:-1] + base), pa.array(sizes), ids], ["doc_id", "start", "n_tokens", "ids"]
                    )

    return run


def write_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Write the files; their folder and a manifest with one row per file.

    ``docs`` needs ``doc_id`` and ``text``. Documents lie in ascending ``doc_id`` order over all files, null
    ids first, equal ids by a hash of their text (so rows of one id, or of none, spread over the writers; only
    rows that are the same in both lie in one range). A null or empty text is the end id alone. An empty table
    gives no files.
    """
    spark = docs.sparkSession
    python_ready(spark)
    folder = shared_dir(spark, "tokens")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place, "text")
    return folder, written(ordered.mapInArrow(_write(vocabulary, folder, end_id, file_ids), MANIFEST), "manifest")


def read_files(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files alone: ``start`` counts the ids of all documents before it."""
    # One row per writer task, so the running sum over them is small whatever the corpus is.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(ahead), F.lit(0)).alias("part_start"))
    files = manifest.join(parts, "part").select("path", (F.col("part_start") + F.col("ids_before")).alias("base"))
    spread = files.repartition(max(1, min(manifest.count(), 100_000)), "path")
    return spread.mapInArrow(_read(folder), RESULT)
