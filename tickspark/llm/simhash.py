"""Near duplicates by SimHash fingerprints and meet-in-the-middle balls.

A fingerprint's bit is set if it is set in over half of the 64-bit hashes of the document's word shingles, repeats
included. Two fingerprints within ``2 r`` bits have a word between them that is within ``r`` bits of both, so every
fingerprint stands for all its variants within ``r`` bits, and equal variants meet. Whoever shares a variant is
within ``2 r`` bits of everyone there: a meeting of n fingerprints gives n - 1 links to its smallest, never all pairs,
and no link of the relation is lost for the components. Links are confirmed before they are used, and a task passes
on only as many as hold its components together.

The shuffle carries variants by their leading bits: one row for each way to change up to ``r`` of the first 16 bits
(137 rows for r = 2) stands for all variants that begin so (2,081 in all), and the task that receives it writes out the
rest. A prefix that gathers more than ``max_variants`` variants is cut by the next 16 bits, and again up to whole
variants, which meet by an aggregate; so one crowded region of fingerprints never is one task.

Edge cases: NULL and wordless texts have fingerprint zero and are linked like any other; a text of fewer than
``shingle`` words is one shingle; repeated rows share a fingerprint and repeat in the result; a NULL doc_id gets the
smallest id of its component, or NULL if none has an id; empty input gives empty output; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import groups, keyed, materialise
from tickspark.llm.components import components

U = np.uint64
SEED = 42
BITS = 64
#: Leading bits by which a level of the shuffle tells variants apart.
STEP = 16
#: Hashes whose bits are counted at once.
COUNT_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the shingles' XXH64; only A to Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    n, half = len(starts), np.zeros(BITS, np.int64)
    hashed = (xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True))
    hashes = np.fromiter(hashed, dtype="<u8", count=n)
    for at in range(0, n, COUNT_ROWS):
        octets = hashes[at : at + COUNT_ROWS].view(np.uint8).reshape(-1, BITS // 8)
        half += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * half > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()
            for part in groups(sizes):
                texts = batch["text"].slice(part.start, part.stop - part.start)
                prints = np.array([fingerprint(t.as_py(), shingle) for t in texts], U).view(np.int64)
                ids = batch["doc_id"].slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints)], names=["doc_id", "fp"])

    source = keyed(docs, text, doc_id=doc_id).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(made, "doc_id long, fp long")


def changes(bits: int, most: int) -> list[int]:
    """Every way to change up to ``most`` of ``bits`` bits, as masks; fewest changes first."""
    return [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(bits), k)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a, b) that connect what all of them connect: one fewer than each component has nodes.

    In every round each component takes its first link to a smaller one, if it has any.
    """
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, left, right = np.arange(len(nodes)), ends[: len(a)], ends[len(a) :]
    kept = [np.empty(0, np.int64)]
    while len(apart := np.flatnonzero(root[left] != root[right])):
        x, y = root[left[apart]], root[right[apart]]
        larger, first = np.unique(np.maximum(x, y), return_index=True)
        root[larger] = np.minimum(x, y)[first]
        kept.append(apart[first])
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
    some = np.concatenate(kept)
    return a[some], b[some]


def _cut(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """(key, fp, used): rows of (key, fp, used) with keys of ``level`` steps, cut by one step of bits more.

    ``used`` is the number of changed bits so far, so a row has as many children as its remaining changes allow.
    """
    shift = BITS - STEP * (level + 1)
    field = F.shiftrightunsigned("fp", shift).bitwiseAND((1 << STEP) - 1)
    by_used: Column = F.lit(None).cast("array<int>")
    for used in range(radius + 1):
        masks = F.lit(changes(STEP, radius - used))
        by_used = F.when(F.col("used") == used, masks).otherwise(by_used)
    key = F.shiftleft("key", STEP).bitwiseOR(field.bitwiseXOR(F.col("mask").cast("long")))
    return rows.withColumn("mask", F.explode(by_used)).select(
        key.alias("key"), "fp", (F.col("used") + F.bit_count("mask")).alias("used")
    )


def _met(level: int, radius: int):
    """Of one group of rows (key, fp, used): links (a, b) that connect those sharing a variant."""
    low = BITS - STEP * level
    masks = [np.array(changes(low, radius - used), U) for used in range(radius + 1)]

    def links(table: pa.Table) -> pa.Table:
        key, fp = (table[c].to_numpy().view(U) for c in ("key", "fp"))
        used = table["used"].to_numpy()
        begin = (key << U(low)) | (fp & U((1 << low) - 1))
        each = [used == k for k in range(radius + 1)]
        variants = np.concatenate([(begin[m][:, None] ^ masks[k]).ravel() for k, m in enumerate(each)])
        owners = np.concatenate([np.repeat(fp[m], len(masks[k])) for k, m in enumerate(each)])
        order = np.argsort(variants)
        variants, owners = variants[order], owners[order]
        starts = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1])))
        least = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(variants))))
        linked = (least != owners) & (np.bitwise_count(least ^ owners) <= 2 * radius)
        a, b = forest(least[linked], owners[linked])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return links


def links(fps: DataFrame, radius: int = 2, group_variants: int = 1 << 20, max_variants: int = 1 << 22) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` that connect all within ``2 * radius`` bits, in stars."""
    found = None
    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("used"))
    for level in range(1, BITS // STEP):
        rows = _cut(rows, level - 1, radius)
        low = BITS - STEP * level
        stands_for: Column = F.lit(0)
        for used in range(radius + 1):
            stands_for = F.when(F.col("used") == used, len(changes(low, radius - used))).otherwise(stands_for)
        loads = materialise(rows.groupBy("key").agg(F.sum(stands_for.cast("long")).alias("load")), "simhash-loads")
        crowded = loads.where(F.col("load") > max_variants).select("key")
        any_crowded = not crowded.isEmpty()
        calm = rows.join(crowded, "key", "left_anti") if any_crowded else rows
        total = loads.where(F.col("load") <= max_variants).agg(F.sum("load")).first()[0] or 0
        group = F.pmod(F.xxhash64("key"), F.lit(total // group_variants + 1)).alias("group")
        here = calm.select(group, "key", "fp", "used").groupBy("group")
        met = here.applyInArrow(_met(level, radius), "a long, b long")
        found = met if found is None else found.union(met)
        if not any_crowded:
            return found
        rows = materialise(rows.join(crowded, "key", "left_semi"), "simhash-crowded")
    # whole variants: an aggregate finds the smallest of each, and everyone else there is linked to it
    whole = _cut(rows, BITS // STEP - 1, radius).select("key", "fp")
    firsts = whole.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("key", "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= 2 * radius
    met = whole.join(firsts, "key").where((F.col("a") != F.col("fp")) & near).select("a", F.col("fp").alias("b"))
    return found.union(met.distinct())


def simhash_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id, kept. ``2 * radius`` differing bits are a link."""
    prints = materialise(fingerprints(docs, shingle, doc_id, text), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comp = components(materialise(links(distinct.select("fp"), radius).distinct(), "simhash-links"))
    known = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.withColumn("comp", F.coalesce("comp", "fp"))
    smallest = known.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_print = known.join(smallest, "comp").select("fp", "component_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id", kept.alias("kept"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")
