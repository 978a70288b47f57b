"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VNODES`` points of a ring; equal texts have one point and go to the shard of the
next node clockwise. A shard takes no more than its capacity: keys that find it full continue
clockwise to the next node of a shard with room. Capacities add up to the rows (law ``rows``: counts
at most one apart), so balance is guaranteed and only overflow moves.

Arcs between nodes are dealt to shards as whole stretches of rows, so the walk needs the counts of
cells (an arc and a hash of doc_id) only, never a list of keys. A row finds its place by its rank in
its cell. An arc has as many cells as its rows need, so a text that a third of all rows have spreads
over many, and rows without doc_id are spread by their place in the checkpoint.

Defined results: a null text counts as empty, its size is 1; ties are ordered by doc_id, then size
and checksum; repeated rows get slots of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import bounded_batches, cut

SHARDS = 8
#: Nodes of a shard on the ring.
VNODES = 64
#: Rows of one cell, about, and cells of an arc at least (a text that many rows have has one arc).
CELL_ROWS, LEAST_CELLS = 20_000, 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) by point; points are signed 64-bit and do not depend on the other shards."""
    return sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(arcs: list[int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc its stretches (rows, shard), in order; overflow continues clockwise."""
    room, out = list(capacity), []
    for k, rows in enumerate(arcs):
        stretches, at = [], k
        while rows:
            shard = nodes[at % len(nodes)][1]
            if take := min(rows, room[shard]):
                stretches.append((take, shard))
                room[shard] -= take
                rows -= take
            at += 1
        out.append(stretches)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    bounded_batches(docs.sparkSession, 5000)
    nodes = ring(shards, vnodes)
    text = F.coalesce(F.col("text"), F.lit(""))
    points = [p for p, _ in nodes]

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(points, np.int64)
        for batch in batches:
            arc = np.searchsorted(at, np.asarray(batch.column("point")), "left") % len(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(arc.astype(np.int32))], names=["doc_id", "size", "text_crc32", "arc"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("point"))
    rows = cut(rows.mapInArrow(arcs, "doc_id long, size long, text_crc32 long, arc int"))
    cells = np.full(len(nodes), LEAST_CELLS, np.int64)
    for r in rows.groupBy("arc").count().collect():
        cells[r.arc] = max(LEAST_CELLS, -(-r["count"] // CELL_ROWS))
    first_cell = np.cumsum(cells) - cells
    spread = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("salt", F.pmod(spread, F.get(F.lit(cells), F.col("arc"))))
    counts = np.zeros(int(cells.sum()), np.int64)
    for r in rows.groupBy("arc", "salt").count().toLocalIterator():
        counts[first_cell[r.arc] + r.salt] = r["count"]
    # rows in the order of arcs, cells and ranks have one global position; stretches are ranges of it
    begin = np.cumsum(counts) - counts
    used, end, ends, owners, shifts = [0] * shards, 0, [], [], []
    for stretch in walk(np.add.reduceat(counts, first_cell).tolist(), nodes, capacities(int(counts.sum()), shards)):
        for many, s in stretch:
            shifts.append(used[s] - end)
            used[s], end = used[s] + many, end + many
            ends.append(end), owners.append(s)
    ends_, owners_, shifts_ = np.array(ends, np.int64), np.array(owners, np.int32), np.array(shifts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            at = begin[first_cell[np.asarray(batch.column("arc"))] + np.asarray(batch.column("salt"))] + np.asarray(batch.column("r")) - 1
            k = np.searchsorted(ends_, at, "right")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(["rows"] * n, pa.string()), pa.array(owners_[k]), pa.array(at + shifts_[k]), pa.nulls(n, pa.int32())], names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    order = Window.partitionBy("arc", "salt").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("r", F.row_number().over(order).cast("long"))
    return placed.mapInArrow(place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
