"""Packed token-id matrices by best-fit decreasing with a segment tree.

Each task packs what it reads, in chunks of at most ``chunk_tokens`` ids, so nothing is shuffled and memory is
bounded; at most one sequence a chunk is far from full. In a chunk pieces go longest first into the open sequence
with the least room that suffices. A segment tree over room sizes finds it: its leaves count open sequences by
room, and a descent gives the smallest room at or above a length.

A sequence is one row of the id matrix, padded with ``pad_id`` to the capacity: ``ids`` holds little-endian 32-bit
ids, ``cu_seqlens`` the cumulative segment lengths from 0, ``position_ids`` positions that restart with each segment
(and over the padding). Overlong documents are cut without loss: pieces carry the start in their document, and
``unpack`` gives the documents back.

Edge cases: a NULL or empty text is the end mark alone; rows that repeat are written each; a NULL doc_id is written
as NULL in the list; empty input gives no sequences; other columns are not read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import keyed
from tickspark.llm.tokens import VOCABULARY, encoder, pieces_of

SCHEMA = """sequence_id long, n_tokens long, ids binary, cu_seqlens array<int>, position_ids binary,
doc_ids array<long>, starts array<long>"""


class RoomTree:
    """Open sequences by room, with the smallest sufficient room in O(log capacity)."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base <= capacity:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += by
            node //= 2

    def put(self, room: int, sequence: int) -> None:
        insort(self.open[room], -sequence)  # the oldest sequence is taken first
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the smallest room that holds ``length``."""
        node = self.base + length
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):  # up until a right sibling has some
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.base
        self._add(room, -1)
        return room, -self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """For each sequence the indexes of its pieces."""
    tree, out = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = tree.take(n)
        if found is None:
            room, k = capacity, len(out)
            out.append([])
        else:
            room, k = found
        out[k].append(i)
        if room > n:
            tree.put(room - n, k)
    return out


def packed_sequences(
    docs: DataFrame, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    chunk_tokens: int = 1 << 21, pad_id: int = 50256,
) -> DataFrame:
    """One row per sequence, see SCHEMA."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for d, text_ in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = enc.encode(text_.as_py())
                for start, n in pieces_of(len(ids) // 4, capacity):
                    held.append((d, start, ids[4 * start : 4 * (start + n)]))
                    total += n
                    if total >= chunk_tokens:
                        yield from rows_of(held)
                        held, total = [], 0
        yield from rows_of(held)

    def rows_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sequences = best_fit_decreasing([len(x) // 4 for *_, x in held], capacity)
        pad = np.uint32(pad_id).astype("<u4").tobytes()
        steps = np.arange(capacity, dtype="<u4")
        for at in range(0, len(sequences), 512):
            cols: list[list] = [[] for _ in range(6)]
            for members in sequences[at : at + 512]:
                sizes = [len(held[i][2]) // 4 for i in members]
                used = sum(sizes)
                values = (
                    used,
                    b"".join([held[i][2] for i in members]) + pad * (capacity - used),
                    np.concatenate(([0], np.cumsum(sizes))).tolist(),
                    b"".join([steps[:n].tobytes() for n in (*sizes, capacity - used)]),
                    [held[i][0] for i in members],
                    [held[i][1] for i in members],
                )
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = (
                pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"],
            )

    source = keyed(docs, text, doc_id=doc_id).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = source.mapInArrow(written, SCHEMA.split(",", 1)[1])
    return rows.select(F.monotonically_increasing_id().alias("sequence_id"), *rows.columns)


def unpack(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every piece, ids as an array: the inverse of packing."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for ids, ends, docs, starts in zip(
                *(batch[c].to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "starts")), strict=True
            ):
                row = np.frombuffer(ids, "<u4")
                rows += [(d, s, row[a:b].tolist()) for d, s, a, b in zip(docs, starts, ends, ends[1:], strict=False)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "ids"]
            )

    return sequences.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(
        split, "doc_id long, start long, ids array<long>"
    )
