"""Near duplicates by fast similarity sketching.

A document's set holds its distinct k-word shingles as 64-bit hashes. The sketch has ``bins`` coordinates: in each
of the first ``bins`` rounds every element is thrown into one bin with a random value, in the next ``bins`` rounds
all elements go to one bin each; a coordinate is the smallest (round, value) that reached its bin. Every coordinate
fills, and two sketches agree in a coordinate with probability equal to the sets' similarity, concentrated as for
independent draws. Most sets need two or three rounds.

Coordinates are banded. Documents with equal sets form one class, and only class representatives are banded. In
each bucket every member is paired with the leader, the member that shares most buckets with others (in a group of
edited copies the original); verified pairs give components. Then what is still apart is compared: members whose
buckets mostly have the same leader form a family, which is brought together and compared without making a row for
each pair; members of one bucket but different families are paired. So each pair that shares a bucket has been compared
or is known to be connected. Outside families, pairs whose sketches agree in less than ``min_agree`` of the coordinates
are left out (five and a half deviations below what the threshold gives); the rest are confirmed on their full sets.
With 32 bands of four, a pair at 0.8 shares no bucket with probability 5e-8.

Edge cases: NULL and wordless texts have an empty set and are linked with nothing; a text of fewer than k words is
one shingle; repeated rows belong to one class and repeat in the result; a NULL doc_id gets the class's smallest
id; empty input gives empty output; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import WordHashes, groups, keyed, materialise, mixed, with_size_check
from tickspark.llm.components import components

U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5
    similarity: int = 80  # per cent
    bins: int = 128
    rows: int = 4
    min_agree: int = 78


#: Shingles of a block of documents that are compared in one task; a task holds two blocks.
BLOCK_SHINGLES = 2_000_000


def shingles(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    if not words:
        return np.empty(0, U)
    h = mixed(hashes.of(words))
    n = len(h)
    width = min(k, n)
    x = np.full(n - width + 1, U(width), U)
    for j in range(width):
        x = mixed(x ^ h[j : n - width + 1 + j])
    return np.unique(x)


def lowered(text: str | None) -> list[bytes]:
    """Words of a text with A to Z in lower case; bytes.lower() changes no other letter."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each."""
    out = np.full((len(sets), bins), EMPTY, U)
    if not sets:
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets)
    flat = out.reshape(-1)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            x = mixed(items ^ mixed(np.full(1, i + 1, U)))
            at = (x % U(bins)).astype(np.int64) if i < bins else i - bins
            np.minimum.at(flat, owner * bins + at, (x >> U(16)) | (U(i) << U(48)))
            open_ = (out == EMPTY).any(axis=1)
            if not open_.any():
                break
            left = open_[owner]
            owner, items = owner[left], items[left]
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sketches.shape
    parts = sketches[:, : bins // rows * rows].reshape(n, bins // rows, rows)
    with np.errstate(over="ignore"):
        x = mixed(np.arange(parts.shape[1], dtype=U))[None, :].repeat(n, 0)
        for j in range(rows):
            x = mixed(x ^ parts[:, :, j])
    return x


def _signatures(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (two longs), bands, sketch bytes."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in groups([len(t) if t else 0 for t in texts]):
                with np.errstate(over="ignore"):
                    sets = [shingles(lowered(t), cfg.shingle, hashes) for t in texts[part]]
                full = [s for s in sets if len(s)]
                made = sketch(full, cfg.bins)
                keys, low = iter(band_keys(made, cfg.rows).view(np.int64)), iter(mixed(made).astype(np.uint8))
                ids = [np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(part.start, part.stop - part.start),
                        batch["text_hash"].slice(part.start, part.stop - part.start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(x[0]) for x in ids], pa.int64()),
                        pa.array([int(x[1]) for x in ids], pa.int64()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    schema = (
        "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"
    )
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(signed, schema)


def _promising(pairs: DataFrame, reps: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    size = reps.select("node", "n_shingles", "sketch")
    both = pairs.join(size.toDF("a", "n_a", "s_a"), "a").join(size.toDF("b", "n_b", "s_b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= cfg.similarity * F.greatest("n_a", "n_b")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(x[c].to_pylist()), np.uint8).reshape(x.num_rows, cfg.bins) for c in ("s_a", "s_b")
            )
            yield x.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= cfg.min_agree))

    return both.where(fits).select("a", "b", "s_a", "s_b").mapInArrow(agreeing, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Pairs confirmed on full sets."""
    both = pairs.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b").select("a", "b", "t_a", "t_b")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for x in batches:
            good = []
            for ta, tb in zip(x["t_a"], x["t_b"], strict=True):
                with np.errstate(over="ignore"):
                    sa, sb = (shingles(lowered(t.as_py()), cfg.shingle, hashes) for t in (ta, tb))
                shared = len(np.intersect1d(sa, sb, assume_unique=True))
                good.append(100 * shared >= cfg.similarity * (len(sa) + len(sb) - shared))
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(confirmed, "a long, b long")


def _within_families(placed: DataFrame, reps: DataFrame, texts: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Links between different components of one family, on full sets.

    A family goes to one task, or, above ``BLOCK_SHINGLES`` shingles, in blocks to a task for each pair of blocks. A
    pair with neither member in the task's largest component is met, too: each member outside it is held against all.
    """
    sized = placed.join(reps.select("node", "n_shingles"), "node")
    apart = sized.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n_shingles").alias("n"))
    apart = apart.where("lo != hi").select("family", F.ceil(F.col("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = placed.join(apart, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp"
    )

    def compared(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        nodes, comps = table["node"].to_numpy(), table["comp"].to_numpy()
        with np.errstate(over="ignore"):
            sets = [shingles(lowered(t.as_py()), cfg.shingle, hashes) for t in table["text"]]
        size = np.array([len(x) for x in sets], np.int64)
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.concatenate(([0], np.cumsum(size)[:-1]))
        values, counts = np.unique(comps, return_counts=True)
        here = np.zeros(len(names), np.int64)
        a, b = [], []
        for k in np.flatnonzero(comps != values[np.argmax(counts)]):
            own = at[ends[k] : ends[k] + size[k]]
            here[own] = 1
            both = np.add.reduceat(here[at], ends)
            here[own] = 0
            linked = (comps != comps[k]) & (100 * both >= cfg.similarity * (size + size[k] - both))
            b += nodes[linked].tolist()
            a += [int(nodes[k])] * int(linked.sum())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    brought = dealt.join(texts, "node").select("family", "i", "j", "node", "comp", "text")
    return brought.groupBy("family", "i", "j").applyInArrow(compared, "a long, b long")


def near_duplicates(
    docs: DataFrame, cfg: NearDupConfig = NearDupConfig(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id, text_hash."""
    source = keyed(docs, text, doc_id=doc_id).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialise(_signatures(source, cfg), "near-signatures")
    full = signed.where("n_shingles > 0")
    firsts = full.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("first"), F.min_by("text_hash", "doc_id").alias("first_hash")
    )
    # written with the number, so every later read agrees on it
    classes = materialise(firsts.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    is_first = F.col("doc_id").eqNullSafe(F.col("first")) & (
        F.col("first_hash").isNull() | (F.col("text_hash") == F.col("first_hash"))
    )
    picked = full.join(classes, ["set_a", "set_b"]).where(is_first)
    # rows of a class that share its first id and text, or have no id at all, are still one representative
    reps = materialise(
        picked.groupBy("node").agg(
            *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "doc_id", "text_hash"))
        ),
        "near-representatives",
    )
    # every bucket with company, and as its leader the member that shares most buckets with most others
    placed = reps.select("node", F.explode("bands").alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(placed.join(with_size_check(counts, "near-buckets"), "bucket"), "near-shared")
    score = shared.groupBy("node").agg(F.sum(F.log("n")).alias("score"))
    leaders = shared.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("best"))
    led = materialise(
        shared.join(leaders, "bucket").select("bucket", "node", F.col("best.node").alias("leader")), "near-led"
    )
    first_pairs = led.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    texts = materialise(_texts(source, led.select("node").distinct().join(reps, "node").select("node", "doc_id", "text_hash")), "near-texts")
    links = materialise(_verified(_promising(first_pairs, reps, cfg), texts, cfg), "near-links")
    comp = components(links)

    # what is still apart: inside the family of one leader, compared where the family is brought together
    often = led.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    family = often.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("most"))
    placed_in = family.select("node", F.col("most.leader").alias("family")).join(comp, "node", "left")
    placed_in = materialise(placed_in.withColumn("comp", F.coalesce("comp", "node")), "near-families")
    links = links.union(_within_families(placed_in, reps, texts, cfg))
    # and across families, pair by pair
    members = led.select("bucket", "node").join(placed_in, "node")
    mixed_up = members.groupBy("bucket").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo != hi")
    members = members.join(mixed_up.select("bucket"), "bucket")
    one, two = members.toDF("a", "bucket", "family_a", "comp_a"), members.toDF("b", "bucket", "family_b", "comp_b")
    cross = one.join(two, "bucket").where("family_a < family_b and comp_a != comp_b").select("a", "b").distinct()
    more = _verified(_promising(cross, reps, cfg), texts, cfg)
    links = materialise(links.union(more), "near-links")
    comp = components(links)

    known = classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = known.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = known.join(smallest, "comp")
    of_class = of_class.select("set_a", "set_b", "component_id", F.col("first").alias("class_id"))
    alone = F.col("n_shingles") == 0
    rows = signed.select("doc_id", "n_shingles", "set_a", "set_b", "text_hash").join(of_class, ["set_a", "set_b"], "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "text_hash",
    )


def _texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of representatives, found by id and text hash."""
    keyed_docs = source.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    want = with_size_check(wanted, "near-wanted")
    on = keyed_docs["d"].eqNullSafe(want["doc_id"]) & (keyed_docs["h"] == want["text_hash"])
    return keyed_docs.join(want, on).select("node", "text").dropDuplicates(["node"])


def drop_near_duplicates(
    docs: DataFrame, cfg: NearDupConfig = NearDupConfig(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each group, the one with the smallest id, with all its columns. Rows that repeat an id
    and text are one; rows without an id stay unless a row with one is in their group."""
    judged = near_duplicates(docs, cfg, doc_id, text)
    kept = judged.where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    kept = materialise(kept.toDF("id_", "hash_", "copies_"), "near-kept")

    def rows_of(some: DataFrame) -> DataFrame:
        some = with_size_check(some.select("id_", "hash_"), "near-kept")
        same = docs[doc_id].cast("long").eqNullSafe(some["id_"]) & (F.xxhash64(docs[text].cast("string")) == some["hash_"])
        return docs.join(some, same, "left_semi")

    several = kept.where("copies_ > 1")
    once = rows_of(kept.where("copies_ = 1"))
    return once if several.isEmpty() else once.unionByName(rows_of(several).dropDuplicates([doc_id, text]))
