"""Best-fit packing with exact complements.

Documents are encoded, closed with an end mark, and those above the capacity are cut. Only the number of pieces of
each length matters for the plan, and there are at most ``capacity`` lengths, so the plan is made from that
histogram, whatever the size of the corpus. From the longest length down, the gap that a piece leaves is
looked up among the lengths, the sums of two and the sums of three lengths still available; the combination is used
as often as the counts allow. What finds no exact complement is packed by best fit, longest first, either into the
fullest open sequence or with the lengths that leave least of its gap, whichever needs fewer sequences.

The plan is a list of patterns, each with a multiplicity and so a range of sequence numbers. Pieces of one length are
numbered in parallel (a count for each bucket, then a number inside it), and the number decides the pattern.

Edge cases: a NULL or empty text is the end mark alone; rows that repeat are packed each on their own; a NULL
doc_id is carried as it is; empty input gives empty output; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import keyed, materialise, text_groups
from tickspark.llm.tokens import VOCABULARY, encoder, pieces_of

Pattern = tuple[tuple[int, ...], int]
BUCKET_ROWS = 50_000


def tokenised(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in text_groups(batch["text"]):
                rows: list[tuple] = []
                for i in range(part.start, part.stop):
                    d, ids = batch["doc_id"][i].as_py(), enc.encode(batch["text"][i].as_py())
                    for k, (start, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        rows.append((d, k, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(encoded, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _times(combo: tuple[int, ...], count: np.ndarray) -> int:
    """How often a combination of lengths can be taken."""
    return min(int(count[x]) // n for x, n in Counter(combo).items())


def _pair(total: int, most: int, others: tuple[int, ...], count: np.ndarray, have: np.ndarray) -> tuple[int, ...] | None:
    """Two available lengths that add up to ``total``, neither above ``most``, the longest first."""
    top = min(most, total - 1)
    if top < (total + 1) // 2:
        return None
    longer = np.arange(top, (total + 1) // 2 - 1, -1)
    for a in longer[have[longer] & have[total - longer]]:
        if _times((*others, int(a), total - int(a)), count):
            return int(a), total - int(a)
    return None


def _complement(seed: int, parts: int, gap: int, count: np.ndarray, have: np.ndarray) -> tuple[int, ...] | None:
    """``parts`` (one to three) available lengths that add up to ``gap`` exactly."""
    if parts == 1:
        return (gap,) if have[gap] and _times((seed, gap), count) else None
    if parts == 2:
        return _pair(gap, gap - 1, (seed,), count, have)
    for a in np.flatnonzero(have[: max(gap - 1, 0)])[::-1]:
        if 3 * a < gap:
            return None
        if found := _pair(gap - int(a), int(a), (seed, int(a)), count, have):
            return (int(a), *found)
    return None


def plan(lengths: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths, how many sequences) that use up a histogram of lengths.

    Exact sums of two or three short lengths can use up what longer pieces need later, so plans that look for
    complements of up to three, two, one and no lengths are made, and the one with the fewest sequences is kept.
    """
    plans = [_plan(lengths, capacity, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _plan(lengths: dict[int, int], capacity: int, most: int) -> list[Pattern]:
    count = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        count[length] = n
    patterns: list[Pattern] = [((capacity,), int(count[capacity]))] if count[capacity] else []
    count[capacity] = 0
    have = count > 0
    for parts in range(1, most + 1):
        for seed in range(capacity - 1, 0, -1):
            while count[seed] and (rest := _complement(seed, parts, capacity - seed, count, have)):
                combo = (seed, *rest)
                times = _times(combo, count)
                patterns.append((combo, times))
                for x in combo:
                    count[x] -= times
                have = count > 0
    fits = (_fill(count.copy(), capacity), _best_fit(count.copy(), capacity))
    return patterns + min(fits, key=lambda p: sum(n for _, n in p))


def _fullest(gap: int, count: np.ndarray) -> tuple[int, ...]:
    """The available lengths that fill most of ``gap``, with few and long ones where sums are equal."""
    reach, steps = 1, []  # bit s of reach: the sum s can be made
    for x in (int(x) for x in np.flatnonzero(count[: gap + 1])[::-1]):
        left, part = min(int(count[x]), gap // x), 1
        while left:
            part = min(part, left)
            steps.append((x, part, reach))
            reach |= (reach << (x * part)) & ((2 << gap) - 1)
            left -= part
            part *= 2
        if reach >> gap:
            break
    total, out = reach.bit_length() - 1, []
    for x, part, before in reversed(steps):
        if not (before >> total) & 1:
            out += [x] * part
            total -= x * part
    return tuple(out)


def _fill(count: np.ndarray, capacity: int) -> list[Pattern]:
    """The longest piece that is left, and with it what fills its gap best, as often as the counts allow."""
    patterns: list[Pattern] = []
    for seed in range(capacity, 0, -1):
        while count[seed]:
            count[seed] -= 1
            combo = (seed, *_fullest(capacity - seed, count))
            count[seed] += 1
            times = _times(combo, count)
            patterns.append((combo, times))
            for x, n in Counter(combo).items():
                count[x] -= times * n
    return patterns


def _best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest first into the fullest sequence with room, many equal pieces at a time."""
    room: dict[int, list[Pattern]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(combo: tuple[int, ...], times: int) -> None:
        left = capacity - sum(combo)
        room.setdefault(left, []).append((combo, times))
        rooms[left] = True

    for length in range(capacity, 0, -1):
        n = int(count[length])
        while n:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            left = length + int(fitting[0])
            combo, times = room[left].pop()
            if not room[left]:
                del room[left]
                rooms[left] = False
            used = min(n, times)
            n -= used
            if times > used:
                put(combo, times - used)
            put((*combo, length), used)
    return [x for at_left in room.values() for x in at_left]


def _slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, offset) in order of the number."""
    taken: Counter[int] = Counter()
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for combo, times in patterns:
        offset = 0
        for length in combo:
            out.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(
    docs: DataFrame, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    source = keyed(docs, text, doc_id=doc_id).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = materialise(tokenised(source, capacity, vocabulary), "pack-pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan(lengths, capacity)))  # a few rows a length

    buckets = max(1, sum(lengths.values()) // BUCKET_ROWS)
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    numbered = placed.withColumn("number", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("base"))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine, table = length == x, slots.value[int(x)]
                row = table[np.searchsorted(table[:, 0], number[mine], side="right") - 1]
                sequence[mine], offset[mine] = row[:, 1] + number[mine] - row[:, 0], row[:, 2]
            keep = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    return numbered.select(*columns).mapInArrow(assigned, schema)
