"""Near-duplicate documents by circulant MinHash.

1. Each document's shingle set gives a digest and a signature. Two permutations of 32-bit numbers suffice:
   the first scatters the shingles, the second, shifted circularly by 0, 1, 2, ..., gives each coordinate.
2. Documents of one digest are one class, so exact copies (and copies up to order that leaves the set as it
   is) go on as a single row.
3. Bands of the signature meet in buckets. A bucket joins its classes to its smallest one; the components of
   these joins are the clusters in which a link can lie.
4. Classes of a cluster get their full sets once, and links are confirmed on them. A cluster of more than a
   block is first compared block by block with itself and with one hub block; what that leaves unjoined is
   then compared with the whole cluster, block against block. A task returns a spanning forest of the links
   it confirmed, never all pairs.
5. The components of the links are the groups of near copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import python_ready, small_side, spare, written
from relayspark.llm.components import connected_components
from relayspark.llm.shingles import shingle_sets

#: 32 bands of 4: two sets of similarity 0.8 share no bucket with probability below 1e-7.
BANDS = 32
ROWS = 4
#: Classes and shingles that a block of a cluster may hold on average.
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 400_000
#: Pairs of a block whose overlaps are counted at once.
_SIGN_CHUNK = 1 << 14
#: The bit that tells negative numbers; turned round, numbers sort as their bytes do.
_SIGN = -(1 << 63)


def _first(x: np.ndarray) -> np.ndarray:
    """The first permutation, of the low 32 bits of the shingle hashes."""
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _second(x: np.ndarray, into: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, without new arrays."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=into)
    np.multiply(into, np.uint32(0x7FEB352D), out=into)
    np.right_shift(into, np.uint32(15), out=spare)
    np.bitwise_xor(into, spare, out=into)
    np.multiply(into, np.uint32(0x846CA68B), out=into)
    np.right_shift(into, np.uint32(16), out=spare)
    return np.bitwise_xor(into, spare, out=into)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima for each non-empty set."""
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    at = 0
    while at < len(sets):
        size, end = 0, at
        while end < len(sets) and (size < _SIGN_CHUNK or end == at):
            size += len(sets[end])
            end += 1
        spread = _first(np.concatenate(sets[at:end]))
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)]).astype(np.int64)
        value, spare = np.empty_like(spread), np.empty_like(spread)
        for k in range(coordinates):
            _second(spread, value, spare)
            out[at:end, k] = np.minimum.reduceat(value, first)
            spread -= np.uint32(1)  # the circular shift
        at = end
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    from relayspark.llm.shingles import mix64

    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


SIGNED = "doc_id long, row_key binary, n_shingles long, class binary, bands array<long>"


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text").to_pylist(), width))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                found = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                for i, row in zip(full, found, strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "row_key", "n_shingles", "class", "bands"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text").to_pylist(), width))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["class", "body"],
            )

    return run


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with 100 * intersection >= percent * union, by exact counts of shared shingles.

    Shingles that only one of all the sets holds cannot be shared and are left out of the counting; the
    counts are products of 0/1 matrices over the rest, in strips of columns.
    """
    sets = left + right
    lengths = np.asarray([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = np.repeat(np.arange(len(sets)), lengths)[keep], number[column[keep]]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[row[a:b], column[a:b] - at] = 1
        common += held[: len(left)] @ held[len(left) :].T
    common = common.astype(np.int64)
    union = lengths[: len(left), None] + lengths[None, len(left) :] - common
    return np.nonzero(100 * common >= percent * union)


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
    """Of the pairs, those that join what was not yet joined."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            yield a, b


def _confirm(percent: int):
    """Links between the rows of a cell: side 0 with side 0 and with side 1 (side 1 is not compared with itself)."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("node").to_pylist()
        sides = table.column("side").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("body").to_pylist()]
        zero = [i for i, s in enumerate(sides) if s == 0]
        one = [i for i, s in enumerate(sides) if s == 1]
        pairs: list[tuple[int, int]] = []
        for at in range(0, len(zero), 512):
            rows = zero[at : at + 512]
            for to in range(0, len(zero) + len(one), 512):
                columns = (zero + one)[to : to + 512]
                found = linked_pairs([sets[i] for i in rows], [sets[j] for j in columns], percent)
                fresh = ((rows[i], columns[j]) for i, j in zip(*(x.tolist() for x in found), strict=True))
                pairs = list(_forest(iter([*pairs, *((i, j) for i, j in fresh if i != j)]), len(sets)))
        return pa.table(
            {"a": pa.array([names[i] for i, _ in pairs], pa.binary()), "b": pa.array([names[j] for _, j in pairs], pa.binary())}
        )

    return run


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    return rows.select("cluster", "cell", "side", "node", "body").groupBy("cluster", "cell").applyInArrow(
        _confirm(percent), "a binary, b binary"
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key(text: Column) -> Column:
    """A digest that tells rows of one ``doc_id`` apart by their text; null for null."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def signed(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, class and band keys of each document."""
    python_ready(docs.sparkSession)
    texts = _texts(docs).select("doc_id", row_key(F.col("text")).alias("row_key"), "text")
    return texts.mapInArrow(_sign(width, bands, rows), SIGNED)


def node_of(doc_id: Column, name: Column) -> Column:
    """A class, or one row of it, as a node of the graph: binaries that sort by ``doc_id`` (null last), then by the
    class. So the smallest node of a component tells the smallest ``doc_id`` in it, without another join."""
    number = F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0")
    return F.unhex(F.concat(F.when(doc_id.isNull(), "01").otherwise("00"), number, F.hex(name)))


def doc_of(node: Column) -> Column:
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", number)


def clusters_of(classes: DataFrame) -> DataFrame:
    """(node, cluster) of the classes (node, bands) that share a bucket with another."""
    keys = classes.select("node", F.explode("bands").alias("bucket"))
    heads = keys.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join reads plain tables and a bucket of very many classes can be split.
    edges = keys.join(written(heads.drop("n"), "heads"), "bucket").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return connected_components(edges.distinct()).select("node", F.col("component").alias("cluster"))


def grouped(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row_key, n_shingles, own, root and shared for each row of ``docs`` (``doc_id``, ``text``; others
    ignored). ``own`` is the row's node and ``root`` the smallest node of its group of linked texts; both are null
    for an empty set. ``shared`` says whether another row may be in the group."""
    sign = written(signed(docs, width, bands, rows), "signed")
    first = (F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("times"))
    classes = sign.where("class is not null").groupBy("class").agg(*first)
    classes = written(classes.withColumn("node", node_of(F.col("doc_id"), F.col("class"))), "classes")
    members = written(classes.select("node", "class", "doc_id", "n").join(clusters_of(classes), "node"), "clustered")
    joined = connected_components(_links(docs, members, width, percent))
    # One row of each class that others are with. Rows meet it by their class; copies of one text, however many,
    # are split there, as both sides are plain shuffles.
    found = classes.select("class", "node", "times").join(joined, "node", "left").where("times > 1 or component is not null")
    roots = written(found.select("class", F.coalesce("component", "node").alias("root")), "roots")
    own = node_of(F.col("doc_id"), F.col("class"))
    out = sign.drop("bands").join(roots, "class", "left").withColumn("own", F.when(F.col("class").isNotNull(), own))
    return out.select("doc_id", "row_key", "n_shingles", "own", F.coalesce("root", "own").alias("root"), F.col("root").isNotNull().alias("shared"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (``doc_id``, ``text``; others ignored).

    Documents are linked if 100 times the size of the intersection of their sets of ``width``-word shingles
    is at least ``percent`` times that of the union. ``component_id`` is the smallest ``doc_id`` that can be
    reached over links; ``kept`` marks that document. A null or wordless text is linked with nothing. Rows
    of one ``doc_id`` are judged each by its own text. A null ``doc_id`` takes part in links but is no
    ``component_id``; where all of a group are null, so is its component, and all are kept. An empty table
    gives no rows.
    """
    lowest = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(doc_of(F.col("root")))
    found = grouped(docs, width, percent, bands, rows).withColumn("component_id", lowest)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest ``doc_id`` (ties: by class and text; a
    null id comes last). Null and wordless texts belong to no group, and all stay. Repeated rows leave one. Columns
    stay as they are; an empty table stays empty."""
    rows = grouped(docs, width, percent).where("shared").groupBy("root", "own", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("times"))
    rows = written(rows, "grouped")
    # The smallest node is one row, unless rows share id and set of shingles.
    first = rows.where("own = root").groupBy("root").agg(F.min("row_key").alias("first"))
    heads = rows.where("own = root").join(first, "root")
    key, doc, row = spare(docs, "__key", "__doc", "__row")
    ids = (F.col("doc_id").alias(doc), F.col("row_key").alias(row))
    gone = rows.where("own <> root").select(*ids).unionByName(heads.where("row_key <> first").select(*ids))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col(key).eqNullSafe(F.col(row))
    keyed = docs.withColumn(key, row_key(F.col("text")))
    left = keyed.join(small_side(written(gone, "gone"), 40), same, "left_anti")
    # Rows that are repeated as a whole leave one.
    again = written(heads.where("row_key = first and times > 1").select(*ids), "repeated")
    if not again.isEmpty():
        again = small_side(again, 40)
        once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", key])
        left = left.join(again, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)


def _in_blocks() -> Column:
    """Blocks that the classes of a cluster need."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes; enough of them to give the components of all."""
    # One row for each cluster, in a table of its own, so a cluster of very many classes can be split in the join.
    totals = written(members.groupBy("cluster").agg(_in_blocks().alias("blocks")), "totals")
    placed = members.join(totals, "cluster")
    # One text of each class that lies in a cluster; ids may repeat or be null, so the class decides.
    wanted = small_side(members.select(F.col("doc_id").alias("rep")).distinct(), 16)
    bodies = (
        _texts(docs).join(wanted, F.expr("doc_id <=> rep"), "left_semi")
        .select("text")
        .mapInArrow(_full_sets(width), "class binary, body binary")
        .where("class is not null")
    )
    full = bodies.join(placed, "class").dropDuplicates(["class"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    full = written(full.select("cluster", "blocks", "node", "n", "body", block.alias("block")), "sets")

    # First: each block with itself and with block 0, the hub.
    own = full.select("*", F.lit(0).alias("side"), F.col("block").cast("string").alias("cell"))
    hub = full.where("block = 0 and blocks > 1").select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1).cast("array<string>")).alias("cell"))
    first = written(_cells(own.unionByName(hub), percent), "links")

    # Then: in clusters of several blocks, all that lies outside the largest component so far, with all.
    large = full.where("blocks > 1")
    if large.isEmpty():
        return first
    reached = connected_components(first)
    large = large.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = large.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("many"))
    most = written(sizes.groupBy("cluster").agg(F.max_by("component", F.struct("many", "component")).alias("main")), "main")
    large = large.join(small_side(most, 64), "cluster")
    rest = large.where("component <> main")
    counts = small_side(written(rest.groupBy("cluster").agg(_in_blocks().alias("parts")), "rest"), 40)
    rest = rest.join(counts, "cluster").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    cell = F.concat_ws("/", "part", "block")
    left = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.lit(0).alias("side"), cell.alias("cell"))
    right = large.join(counts, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("*", F.lit(1).alias("side"), cell.alias("cell"))
    columns = ["cluster", "cell", "side", "node", "body"]
    return first.unionByName(written(_cells(left.select(columns).unionByName(right.select(columns)), percent), "links"))
