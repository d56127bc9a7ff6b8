"""Packing token ids into sequences: first-fit decreasing on a tournament tree, in randomised groups.

Documents are cut into pieces of the sequence length and a rest. The pieces are dealt out evenly, whatever
document they are from, and each task takes its own in the order of a hash, in groups of about ``GROUP_IDS``
ids. A group is packed on its own, so packing needs one shuffle (of ids, 16 bits each where the vocabulary
allows) and its memory follows the group, not the corpus, a document or an id that many rows share. In a group
the pieces, longest first, go to the first bin with room, found by descending a tournament tree of the bins'
free space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import BATCH_ROWS, python_ready
from relayspark.llm.encoding import binary_array, encoder, with_end

SEQUENCE = 2048
#: Ids after which a group is packed (8 MB at 16 bits).
GROUP_IDS = 4 << 20
#: Fixed value: the id that ends a document.
END_ID = 1

CUT = "doc_id long, start long, length long, doc_tokens long, width int, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class BinTree:
    """A tournament tree of free space: the winner of each match is the larger one; bins open left to right."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; the bin and the space that was left in it."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        room = free[at]
        spot = at - self.leaves
        free[at] = room - size
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return spot, room


def first_fit_decreasing(lengths: list[int] | np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length, in the order given. Equal lengths keep their order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    placed = [(0, 0)] * len(lengths)
    # What fills a bin comes first, and has one of its own.
    whole = int((lengths == capacity).sum())
    for spot, i in enumerate(order[:whole].tolist()):
        placed[i] = (spot, 0)
    # First fit leaves at most one bin half empty.
    rest = lengths[order[whole:]]
    tree = BinTree(int(min(len(rest), 2 * rest.sum() // capacity + 1)), capacity)
    for i, size in zip(order[whole:].tolist(), rest.tolist(), strict=True):
        spot, room = tree.place(size)
        placed[i] = (whole + spot, capacity - room)
    return placed


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = "<u4" if enc.wide or end_id >= 1 << 16 else "<u2"
        for batch in batches:
            ids, counts = with_end(*enc.encode_column(batch.column("text")), end_id, kind)
            parts = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), parts)
            start = capacity * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
            length = np.minimum(capacity, counts[row] - start)
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(counts[row]),
                    pa.array(np.full(len(row), ids.itemsize, dtype=np.int32)),
                    binary_array(ids, length).cast(pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "width", "ids"],
            )
            for at in range(0, len(row), BATCH_ROWS):
                yield made.slice(at, BATCH_ROWS)

    return run


def _packed(held: list[pa.RecordBatch], capacity: int, first: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a group with their places in sequences numbered from ``first``."""
    table = pa.Table.from_batches(held)
    placed = np.asarray(first_fit_decreasing(table.column("length").to_numpy(), capacity), dtype=np.int64)
    table = table.append_column("sequence_id", pa.array(placed[:, 0] + first)).append_column("offset", pa.array(placed[:, 1]))
    for some in table.combine_chunks().to_batches(max_chunksize=BATCH_ROWS):
        width = some.column("width")[0].as_py()
        raw = b"".join(some.column("ids").to_pylist())
        ids = binary_array(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4"), some.column("length").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [some.column(c) if c != "ids" else ids.cast(pa.binary()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def _pack(capacity: int, group_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch.column("length").to_numpy().sum())
            if size >= group_ids:
                for made in _packed(held, capacity, first):
                    yield made
                first += size // capacity * 2 + 2  # more than the sequences of this group
                held, size = [], 0
        if size:
            yield from _packed(held, capacity, first)

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = SEQUENCE,
    group_ids: int = GROUP_IDS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece of a document: its ids, and where they lie in which sequence.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Every id of every document lies in
    exactly one piece, pieces of a sequence lie without gaps from offset 0, and a sequence holds at most
    ``capacity`` ids; what is left of it is padding. A null or empty text is the end id alone. Rows with a
    null or repeated ``doc_id`` are packed each on its own, and are dealt out like any others. Sequences are
    numbered with gaps. An empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Dealt out in turns after a sort of each task's rows, so a task that runs again deals alike; the hash
    # makes the groups random, and the same for whatever order rows arrive in.
    dealt = rows.mapInArrow(_cut(vocabulary, end_id, capacity), CUT).hint("rebalance")
    mixed = dealt.sortWithinPartitions(F.xxhash64("doc_id", "start", "ids"), "doc_id", "start", "ids")
    return mixed.mapInArrow(_pack(capacity, group_ids), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ids in order as one binary, with their number and the number of pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("hexed"),
        F.sum("length").alias("tokens"),
        F.count(F.lit(1)).alias("pieces"),
    ).select("sequence_id", F.unhex("hexed").alias("ids"), "tokens", "pieces")
