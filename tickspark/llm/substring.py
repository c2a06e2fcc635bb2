"""Removal of repeated passages with suffix automata over reference shards.

A window is ``width`` consecutive words. A window that starts earlier elsewhere (smaller id, or earlier in the same
document) is a repeat, and every word it covers goes. Per position of a passage the automaton of earlier text gives
the matching statistic, the length of the longest match that ends there; where it reaches ``width``, the window is a
repeat if the earliest end of that match is before its own.

The reference is the corpus itself, so it can't be broadcast whole. It is cut down and dealt out:

1. Documents of equal text form a class; only its first member is reference, later members go whole.
2. Each window is anchored at the smallest hash among its ``width - anchor + 1`` short word runs. Equal windows have
   equal anchors. Neighbouring windows of one anchor form a segment. An anchor seen once holds no repeat.
3. Equal segments of one anchor are merged before anything else moves: all but the first are repeats throughout.
4. The distinct segments of an anchor are the reference shard's text, in order of document and position. They are
   dealt by anchor; a task builds the automaton of each anchor's segments and streams them through it.
   Where an anchor has more than ``max_segments`` distinct segments, they are cut by a second anchor, chosen in
   another order, and go through 2 to 4 again; at the last level they are cut to single windows.

Shards are as small as an anchor, and travel by shuffle to the task that matches them, since no size bound can be
proven for a broadcast. Words are compared as 64-bit hashes.

Edge cases: NULL and empty texts have no words and nothing is removed; rows that repeat an id and text are one
document and get the same result; texts that share an id are ordered by a hash of the text; a NULL id comes first;
empty input gives empty output; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import WordHashes, fingerprint, groups, keyed, materialise, mixed, with_size_check, words_of

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Times that the segments of an anchor with many of them are cut finer; the last time to single windows.
LAST_LEVEL = 3


class SuffixAutomaton:
    """Suffix automaton over a sequence of segments of integers; ``first`` is the earliest end of a state's words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]
        self.last = 0

    def restart(self) -> None:
        """A new segment: matches don't run across its start."""
        self.last = 0

    def extend(self, c: int, end: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        p = self.last
        if c in nxt[p]:  # a generalised automaton: the state may exist from an earlier segment
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                self.last = q
            else:
                self.last = self._clone(p, c, q)
            return
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        self.first.append(end)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        self.last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.first.append(self.first[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matches(self, seq: list[int], width: int) -> Iterator[tuple[int, int]]:
        """For each position of ``seq`` whose match reaches ``width``: the position and the state of its last
        ``width`` words."""
        nxt, link, length = self.next, self.link, self.len
        state, size = 0, 0
        for i, c in enumerate(seq):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
                while length[link[state]] >= width:
                    state = link[state]
                    size = length[state]
            if size >= width:
                yield i, state


def repeats_in_order(segments: list[list[int]], width: int) -> list[list[int]]:
    """For each segment, given in corpus order, the starts of its windows that occur in an earlier segment or
    earlier in itself."""
    automaton, out, end = SuffixAutomaton(), [], 0
    for seq in segments:
        automaton.restart()
        own = end
        for c in seq:
            automaton.extend(c, end)
            end += 1
        first = automaton.first
        out.append([i - width + 1 for i, state in automaton.matches(seq, width) if first[state] < own + i])
    return out


def _anchored(h: np.ndarray, width: int, anchor: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """Segments of one document's word hashes: anchor hash, start, number of windows, content hash, and whether the
    anchor's words occur twice in it (1 or 0), as they must where a window repeats inside its own segment."""
    n = len(h)
    if n < width:
        z = np.empty(0, np.int64)
        return z, z, z, z, z
    x = np.full(n - anchor + 1, U(anchor), U)
    for j in range(anchor):
        x = mixed(x ^ h[j : n - anchor + 1 + j])
    if level:  # another order of the same short runs
        x = mixed(x ^ mixed(np.full(1, level, U)))
    short, need, span = x, width - anchor + 1, 1
    while span < need:  # minimum over `need` short runs, by doubling
        step = min(span, need - span)
        x = np.minimum(x[: len(x) - step], x[step:])
        span += step
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    count = np.diff(np.append(start, len(x)))
    power = np.concatenate((np.ones(1, U), np.cumprod(np.full(n, ODD, U))))
    back = np.concatenate((np.ones(1, U), np.cumprod(np.full(n, INVERSE, U))))
    total = np.concatenate((np.zeros(1, U), np.cumsum(h * power[:n], dtype=U)))
    content = mixed((total[start + count - 1 + width] - total[start]) * back[start] ^ mixed(count.astype(U)))
    loops = np.zeros(len(start), np.int64)
    if len(np.unique(short)) < len(short):
        for i, (s, c, a) in enumerate(zip(start, count, x[start], strict=True)):
            loops[i] = np.count_nonzero(short[s : s + c + need - 1] == a) > 1
    return x[start].view(np.int64), start, count, content.view(np.int64), loops


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]).astype(np.int64)))


def _segments(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in groups([len(t) if t else 0 for t in texts]):
                with np.errstate(over="ignore"):
                    made = [_anchored(mixed(hashes.of(words_of(t))), width, anchor) for t in texts[part]]
                yield pa.RecordBatch.from_arrays(
                    [batch[c].slice(part.start, part.stop - part.start) for c in ("doc_id", "fp_a", "fp_b")]
                    + [_lists([m[i] for m in made]) for i in range(5)],
                    names=["doc_id", "fp_a", "fp_b", "anchor", "start", "windows", "content", "loops"],
                )

    schema = """doc_id long, fp_a long, fp_b long, anchor array<long>, start array<long>, windows array<long>,
    content array<long>, loops array<long>"""
    return docs.select("doc_id", "fp_a", "fp_b", "text").mapInArrow(cut, schema)


def _words_at(docs: DataFrame, wanted: DataFrame, width: int, few: bool = False) -> DataFrame:
    """The word hashes of the segments in ``wanted`` (doc, anchor, start, windows), from the documents' texts."""
    per_doc = wanted.groupBy("doc_id", "fp_a").agg(
        F.collect_list(F.struct("anchor", "start", "windows")).alias("cuts")  # bounded by one document
    )
    # passages of hot anchors are often in few documents, and then need no second shuffle of all texts
    if few:
        cuts = with_size_check(per_doc, "substring-cuts", 50_000)
    else:  # texts without such passages stay where they are
        cuts, with_cuts = per_doc, with_size_check(wanted.select("doc_id", "fp_a").distinct(), "substring-docs", 3_000_000)
        asked = docs["doc_id"].eqNullSafe(with_cuts["doc_id"]) & (docs["fp_a"] == with_cuts["fp_a"])
        docs = docs.join(with_cuts, asked, "left_semi")
    same = docs["doc_id"].eqNullSafe(cuts["doc_id"]) & (docs["fp_a"] == cuts["fp_a"])
    joined = docs.join(cuts, same).select(docs["doc_id"], docs["fp_a"], "text", "cuts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for d, a, text, of_doc in zip(*(batch[c] for c in ("doc_id", "fp_a", "text", "cuts")), strict=True):
                h = hashes.of(words_of(text.as_py())).view(np.int64)
                for c in of_doc.as_py():
                    s = c["start"]
                    rows.append((c["anchor"], d.as_py(), a.as_py(), s, h[s : s + c["windows"] - 1 + width]))
                if len(rows) > 20_000:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols[:4]] + [_lists(list(cols[4]))],
            names=["anchor", "doc_id", "fp_a", "start", "words"],
        )

    return joined.mapInArrow(read, "anchor long, doc_id long, fp_a long, start long, words array<long>")


def _stream(shards: DataFrame, width: int) -> DataFrame:
    """Windows of the shards' segments that repeat earlier ones, as runs: doc_id, fp_a, start, windows."""
    dealt = shards.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "fp_a", "start")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for s, *row in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if s != shard:
                    out += finish(held)
                    shard, held = s, []
                if not held or held[-1][:3] != row[:3]:  # a repeated row of the input is the same passage
                    held.append(row)
            if out:
                yield rows_of(out)
        if out := finish(held):
            yield rows_of(out)

    def finish(held: list[list]) -> list[tuple]:
        if len(held) < 2 and not (held and len(set(held[0][3])) < len(held[0][3])):
            return []
        found = repeats_in_order([h[3] for h in held], width)
        return [(h[0], h[1], h[2] + i, n) for h, starts in zip(held, found, strict=True) for i, n in runs_of(starts)]

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp_a", "start", "windows"])

    return dealt.mapInArrow(streamed, "doc_id long, fp_a long, start long, windows long")


def runs_of(starts: list[int]) -> list[tuple[int, int]]:
    """Ascending starts as (first, number) of their runs of neighbours."""
    runs: list[tuple[int, int]] = []
    for i in starts:
        if runs and i == sum(runs[-1]):
            runs[-1] = (runs[-1][0], runs[-1][1] + 1)
        else:
            runs.append((i, 1))
    return runs


def _cut_again(segments: DataFrame, width: int, anchor: int, level: int) -> DataFrame:
    """Segments of an anchor with many distinct ones, cut by a second anchor that is chosen in another order. The
    last level cuts to single windows, whose anchor is the window itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for a, d, f, start, words in zip(*(batch[c] for c in batch.schema.names), strict=True):
                h = words.values.to_numpy().view(U)
                with np.errstate(over="ignore"):
                    if level < LAST_LEVEL:
                        key, at, n, content, loops = _anchored(h, width, anchor, level)
                        key = mixed(key.view(U) ^ mixed(np.full(1, a.as_py(), np.int64).view(U))).view(np.int64)
                    else:
                        at = np.arange(len(h) - width + 1)
                        n, loops = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
                        key = np.full(len(at), width, U)
                        for j in range(width):
                            key = mixed(key ^ h[j : j + len(at)])
                        key = content = key.view(np.int64)
                for row in zip(key.tolist(), (at + start.as_py()).tolist(), n.tolist(), content.tolist(), loops.tolist(), strict=True):
                    rows.append((d.as_py(), f.as_py(), *row))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    names = ["doc_id", "fp_a", "anchor", "start", "windows", "content", "loops"]
    return segments.mapInArrow(cut, ", ".join(f"{c} long" for c in names))


def _resolved(source: DataFrame, rows: DataFrame, width: int, anchor: int, max_segments: int, level: int) -> DataFrame:
    """Runs of windows (doc_id, fp_a, start, windows) that repeat earlier ones, from all segments."""
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("loops").alias("loops"))
    often = often.where("n > 1 or loops = 1").select("anchor")
    often = with_size_check(often, "substring-anchors", 3_000_000)  # one long a row
    repeated = materialise(rows.join(often, "anchor"), "substring-repeated")

    place = F.struct("doc_id", "fp_a", "start")
    distinct = materialise(
        repeated.groupBy("anchor", "content").agg(
            F.min(place).alias("first"), F.max("windows").alias("windows"), F.max("loops").alias("loops")
        ),
        "substring-distinct",
    )
    again = repeated.join(distinct.select("anchor", "content", "first"), ["anchor", "content"])
    again = again.where(place != F.col("first")).select("doc_id", "fp_a", "start", "windows")
    # an anchor with one distinct segment needs no automaton unless that repeats itself
    per_anchor = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("loops").alias("loops"))
    shared = per_anchor.where("n > 1 or loops = 1")
    shared = shared.select("anchor", (F.col("n") > max_segments).alias("hot"))
    wanted = distinct.join(with_size_check(shared, "substring-shared"), "anchor")
    wanted = materialise(wanted.select("first.*", "anchor", "windows", "hot"), "substring-wanted")
    if level > LAST_LEVEL:  # single windows: what is not the first of its kind is a repeat
        return again
    found = again.unionByName(_stream(_words_at(source, wanted.where("not hot"), width), width))
    hot = wanted.where("hot")
    if hot.isEmpty():
        return found
    finer = materialise(_cut_again(_words_at(source, hot, width, few=True), width, anchor, level), "substring-finer")
    return found.unionByName(_resolved(source, finer, width, anchor, max_segments, level + 1))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20, anchor: int = 8,
    max_segments: int = 500,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one blank)."""
    source = keyed(docs, text, doc_id=doc_id)
    source = source.select(F.col("doc_id").cast("long").alias("doc_id"), *fingerprint(F.col("text")), "text")
    cut = materialise(_segments(source, width, anchor), "substring-segments")
    key = ["doc_id", "fp_a"]
    firsts = cut.groupBy("fp_a", "fp_b").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.count(F.lit(1)).alias("n")
    )
    classes = materialise(
        firsts.where("n > 1").select("fp_a", "fp_b", F.when(~F.col("no_id"), F.col("first")).alias("first")),
        "substring-classes",
    )
    copies = with_size_check(classes, "substring-copies")
    marked = cut.join(copies.withColumn("several", F.lit(True)), ["fp_a", "fp_b"], "left")
    later = F.coalesce("several", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    reference = marked.where(~later)
    rows = reference.select(*key, F.explode(F.arrays_zip("anchor", "start", "windows", "content", "loops")).alias("s")).select(*key, "s.*")
    found = _resolved(source, rows, width, anchor, max_segments, 1)
    spans = found.groupBy(*key).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))  # bounded by one document
    return _cut_out(source, spans, copies, width)


def _cut_out(source: DataFrame, spans: DataFrame, copies: DataFrame, width: int) -> DataFrame:
    removed = spans.withColumnRenamed("doc_id", "id")
    same = source["doc_id"].eqNullSafe(removed["id"]) & (source["fp_a"] == removed["fp_a"])
    marked = source.join(removed.select("id", "fp_a", "spans"), same, "left").select(
        source["doc_id"], source["fp_a"], source["fp_b"], source["text"], "spans"
    )
    marked = marked.join(copies.withColumn("several", F.lit(True)), ["fp_a", "fp_b"], "left")
    later = F.coalesce("several", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts, copy in zip(*(batch[c] for c in ("text", "spans", "copy")), strict=True):
                words = words_of(text.as_py())
                keep = words
                if copy.as_py() and len(words) >= width:
                    keep = []
                elif cuts.is_valid:
                    gone = np.zeros(len(words) + 1, np.int64)
                    start = cuts.values.field("start").to_numpy()
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + cuts.values.field("windows").to_numpy() + (width - 1), -1)
                    keep = [w for w, g in zip(words, np.cumsum(gone[:-1]), strict=True) if not g]
                out.append((len(words), len(words) - len(keep), b" ".join(keep).decode("utf-8", "surrogatepass")))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    columns = marked.select("doc_id", "text", "spans", later.alias("copy"))
    return columns.mapInArrow(cleaned, "doc_id long, n_words long, n_removed long, kept_text string")
