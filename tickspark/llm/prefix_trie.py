"""A trie of conversations by their common prefixes, kept compacted and searched by fat binary search.

A prefix of d turns is known by d and two 64-bit hashes, each the exclusive or of its turns' hashes, which depend on
the position. A compacted node is a prefix at which conversations part or end; the edge above it covers the depths
(top, depth]. The node is stored under its handle, the prefix at the two-fattest depth of that range: the one
divisible by the largest power of two. A conversation of L turns finds where it leaves the trie with about log2(L)
look-ups of handles, each a join for all conversations of a batch at once:

* between a depth known to be in the trie and the depth where the search ends, look up the handle at the two-fattest
  depth; if it is there and the node's whole prefix agrees, go on below the node, else above the handle,
* the edge that begins with the next turn, if there is one, is compared turn by turn.

A batch is inserted at once: edges are split where conversations leave them, and what remains of the batch below
these places is grouped by prefix. Batches grow, so that most conversations meet a trie that has their beginning, and
only their own ends are grouped. At last the edges are expanded to one row per depth.

Turns are rows throughout: no conversation, list of members or subtree is gathered in one row or task. Only the hash
of a node's ending members, which has to be taken in order, reads them as a stream, in strings of some thousand ids.

Edge cases: rows without conv_id belong to no conversation; turns that are equal or NULL are ordered by role and
text; NULL role or text is empty; repeated turns are turns of their own; an empty table has no nodes; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import materialise

#: Turns of a conversation that one window row group holds.
BUCKET = 1024
#: Conversations whose hash falls below these parts form the first, second … batch.
BATCHES = (16, 4, 1)
#: Ids that are joined before they are hashed in order.
CHUNK = 4096
NODE = ["depth", "a", "b"]


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the largest power of two; needs 0 <= low < high."""
    bit = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bit), bit)


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, text) with pos from 1 in the order of turns, NULL first.

    Positions are counted in ranges of turn numbers, with one row per range carried over.
    """
    source = rows.select(
        rows[conv].cast("long").alias("conv"), rows[turn].cast("long").alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null").withColumn("part", F.floor(F.col("turn") / BUCKET))
    sizes = source.groupBy("conv", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv").orderBy(F.asc_nulls_first("part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = source.withColumn("nth", F.row_number().over(inside))
    same = (F.col("conv") == F.col("c")) & F.col("part").eqNullSafe(F.col("p"))
    return placed.join(sizes, same).select("conv", (F.col("before") + F.col("nth")).alias("pos"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, d, a, b, up_a, up_b, bytes): each turn (conv, d, role, text) with the prefix that ends there and the one
    above it, and the bytes of the conversation's texts so far."""
    coded = turns.select(
        "conv", "d", F.floor(F.col("d") / BUCKET).alias("part"),
        F.xxhash64("d", "role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role", "d").alias("y"),
        F.octet_length("text").cast("long").alias("size"),
    )
    inside = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = coded.groupBy("conv", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    parts = parts.select(
        "conv", "part", zero(F.bit_xor("x").over(before)).alias("x0"), zero(F.bit_xor("y").over(before)).alias("y0"),
        zero(F.sum("size").over(before)).alias("size0"),
    )
    run = coded.select(
        "conv", "part", "d", "x", "y", F.bit_xor("x").over(inside).alias("rx"), F.bit_xor("y").over(inside).alias("ry"),
        F.sum("size").over(inside).alias("bytes"),
    ).join(parts, ["conv", "part"])
    a, b = F.col("rx").bitwiseXOR(F.col("x0")), F.col("ry").bitwiseXOR(F.col("y0"))
    return run.select(
        "conv", F.col("d").cast("long").alias("d"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"),
        b.bitwiseXOR(F.col("y")).alias("up_b"), (F.col("bytes") + F.col("size0")).alias("bytes"),
    )


def _at(rows: DataFrame, paths: DataFrame, seq: str, depth: str, a: str, b: str) -> DataFrame:
    """``rows`` with the prefix hashes (a, b) of conversation ``seq`` at ``depth``; NULL where it has no such turn."""
    found = paths.select(F.col("seq").alias(seq), F.col("d").alias(depth), F.col("a").alias(a), F.col("b").alias(b))
    return rows.join(found, [seq, depth], "left")


def _locate(batch: DataFrame, paths: DataFrame, trie: DataFrame) -> DataFrame:
    """(seq, len, base, edge columns): ``base`` turns of the conversation are in the trie; top to rep are those of the
    edge that it leaves or ends on, NULL at a node."""
    handles = trie.select(F.col("handle").alias("f"), F.col("ha").alias("xa"), F.col("hb").alias("xb"),
                          F.col("top").alias("over"), F.col("depth").alias("to"), F.col("a").alias("na"), F.col("b").alias("nb"))
    state = batch.select("seq", "len", F.lit(0).cast("long").alias("low"), F.col("len").alias("high"))
    done = None
    while True:
        ended = state.where("low >= high").select("seq", "len", "low")
        done = ended if done is None else done.union(ended)
        going = state.where("low < high")
        if going.isEmpty():
            break
        probe = _at(going.withColumn("f", fattest(F.col("low"), F.col("high"))), paths, "seq", "f", "xa", "xb")
        found = _at(probe.join(handles, ["f", "xa", "xb"], "left"), paths, "seq", "to", "ya", "yb")
        agrees = (F.col("ya") == F.col("na")) & (F.col("yb") == F.col("nb"))
        # a handle whose node does not agree lies on the edge where the conversation leaves
        left = F.col("to").isNotNull()
        state = materialise(found.select(
            "seq", "len", F.when(agrees, F.col("to")).when(left, F.col("over")).otherwise(F.col("low")).alias("low"),
            F.when(agrees, F.col("high")).when(left, F.col("over")).otherwise(F.col("f") - 1).alias("high"),
        ), "trie-search")
    edges = trie.select(F.col("top").alias("low"), F.col("entry_a").alias("ea"), F.col("entry_b").alias("eb"),
                        "top", *NODE, "rep")
    first = _at(done.withColumn("next", F.col("low") + 1), paths, "seq", "next", "ea", "eb")
    exits = materialise(first.join(edges, ["low", "ea", "eb"], "left").select("seq", "len", "low", "top", *NODE, "rep"), "trie-exits")
    here = paths.select("seq", "d", F.col("a").alias("xa"), F.col("b").alias("xb"))
    there = paths.select(F.col("seq").alias("rep"), "d", F.col("a").alias("xa"), F.col("b").alias("xb"))
    on_edge = exits.where("rep is not null").select("seq", "rep", "top", "depth").join(here, "seq")
    on_edge = on_edge.where("d > top and d <= depth").join(there, ["rep", "d", "xa", "xb"])
    shared = on_edge.groupBy("seq").agg(F.count("*").alias("shared"))
    base = F.col("low") + F.coalesce("shared", F.lit(0))
    return exits.join(shared, "seq", "left").select("seq", "len", base.alias("base"), "top", *NODE, "rep")


def _edges(stops: DataFrame, paths: DataFrame) -> DataFrame:
    """Trie rows of (rep, top, depth): the node's prefix, its handle, the first prefix of its edge and the one above."""
    each = stops.withColumn("handle", fattest(F.col("top"), F.col("depth")))
    needed = F.array_distinct(F.array("handle", F.col("top") + 1, "depth"))
    rows = each.withColumn("d", F.explode(needed)).join(paths.withColumnRenamed("seq", "rep"), ["rep", "d"])
    of = lambda column, at: F.max(F.when(F.col("d") == at, F.col(column)))
    return rows.groupBy("rep", "top", "depth", "handle").agg(
        of("a", F.col("depth")).alias("a"), of("b", F.col("depth")).alias("b"),
        of("a", F.col("handle")).alias("ha"), of("b", F.col("handle")).alias("hb"),
        of("a", F.col("top") + 1).alias("entry_a"), of("b", F.col("top") + 1).alias("entry_b"),
        of("up_a", F.col("top") + 1).alias("up_a"), of("up_b", F.col("top") + 1).alias("up_b"),
    )


def _insert(trie: DataFrame | None, batch: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie with the conversations (seq, len) of a batch."""
    if trie is None:
        exits = batch.withColumn("base", F.lit(0).cast("long"))
        kept, split_stops = None, None
    else:
        exits = materialise(_locate(batch, paths, trie), "trie-bases")
        # edges that are left in their middle
        cuts = exits.where("rep is not null and base > top and base < depth").select("top", *NODE, "rep", F.col("base").alias("stop")).distinct()
        ends = cuts.select("top", *NODE, "rep", F.col("depth").alias("stop")).distinct()
        along = Window.partitionBy(*NODE).orderBy("stop")
        pieces = cuts.union(ends).withColumn("from", F.coalesce(F.lag("stop").over(along), F.col("top")))
        split_stops = pieces.select("rep", F.col("from").alias("top"), F.col("stop").alias("depth"))
        kept = trie.join(cuts.select(*NODE).distinct(), NODE, "left_anti")
    # below the exits: prefixes at which conversations of the batch part or end
    below = paths.join(exits.select("seq", "len", "base"), "seq").where("d > base")
    groups = below.groupBy(F.col("d").alias("depth"), "a", "b", "up_a", "up_b").agg(F.max((F.col("d") == F.col("len")).cast("int")).alias("ends"))
    groups = materialise(groups, "trie-groups")
    parts = groups.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    fresh = groups.select(*NODE, "ends").join(parts.where("children > 1"), NODE, "left").where("ends = 1 or children > 1")
    stops = below.withColumnRenamed("d", "depth").join(fresh.select(*NODE), NODE)
    along = Window.partitionBy("seq").orderBy("depth")
    stops = stops.withColumn("top", F.coalesce(F.lag("depth").over(along), F.col("base")))
    one = stops.groupBy(*NODE).agg(F.min(F.struct("seq", "top")).alias("one"))
    new_stops = one.select(F.col("one.seq").alias("rep"), F.col("one.top").alias("top"), "depth")
    if split_stops is not None:
        new_stops = new_stops.union(split_stops)
    new = _edges(materialise(new_stops, "trie-stops"), paths)
    return materialise(new if kept is None else kept.unionByName(new), "trie")


def _digests(members: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of the members' ids in order, joined by commas; members are (conv, seq)."""
    chunk = F.floor(F.col("conv") / CHUNK).alias("chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = members.groupBy("seq", chunk).agg(joined.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None
        for batch in batches:
            names, digests = [], []
            for s, ids in zip(batch["seq"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if s == seq:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        names.append(seq)
                        digests.append(state.hexdigest())
                    seq, state = s, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests, pa.string())], names=["seq", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([state.hexdigest()])], names=["seq", "ends"])

    placed = chunks.repartition("seq").sortWithinPartitions("seq", "chunk").select("seq", "ids")
    return placed.mapInArrow(hashed, "seq long, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in ``convs`` (conv), whose turns are (conv, d, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    every = materialise(prefixes(turns), "trie-prefixes")
    last = every.groupBy("conv").agg(F.max(F.struct("d", "a", "b")).alias("last")).select("conv", "last.*")
    zero = F.lit(0).cast("long")
    whole = convs.select("conv").distinct().join(last, "conv", "left").select(
        "conv", *(F.coalesce(c, zero).alias(c) for c in ("d", "a", "b"))
    )
    whole = materialise(whole, "trie-whole")
    seqs = whole.groupBy("d", "a", "b").agg(F.min("conv").alias("seq"), F.count("*").alias("n"))
    seqs = materialise(seqs.withColumnRenamed("d", "len"), "trie-sequences")
    paths = every.join(seqs.select(F.col("seq").alias("conv")), "conv", "left_semi").withColumnRenamed("conv", "seq")
    paths = materialise(paths, "trie-paths")

    trie, place = None, F.pmod(F.xxhash64("seq"), F.lit(BATCHES[0]))
    bounds = [0, *(BATCHES[0] // part for part in BATCHES)]
    for low, high in zip(bounds, bounds[1:], strict=False):
        batch = seqs.where((F.col("len") > 0) & (place >= low) & (place < high)).select("seq", "len")
        trie = _insert(trie, batch, paths)

    # what is known of compacted nodes: sums over the sequences that pass them
    inner = trie.select(F.col("up_a").alias("a"), F.col("up_b").alias("b"), F.col("top").alias("depth"))
    children = inner.groupBy(*NODE).agg(F.count("*").alias("n_children"))
    ends = seqs.select(F.col("len").alias("depth"), "a", "b", "seq", "n")
    ends = ends.join(children, NODE, "left").select("seq", "n", F.col("n_children").isNull().cast("long").alias("leaf"))
    passed = paths.withColumnRenamed("d", "depth").join(trie.select(*NODE, "top", "rep"), NODE).select("seq", *NODE, "top", "rep")
    passed = materialise(passed.join(ends, "seq"), "trie-passed")
    counts = passed.groupBy(*NODE).agg(F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"))
    to = paths.select(F.col("seq").alias("rep"), F.col("d").alias("depth"), F.col("bytes").alias("bytes_to"))
    since = paths.select(F.col("seq").alias("rep"), F.col("d").alias("top"), F.col("bytes").alias("bytes_from"))
    known = trie.join(counts, NODE).join(to, ["rep", "depth"]).join(since, ["rep", "top"], "left")
    cost = (F.col("n_convs") - 1) * (F.col("bytes_to") - F.coalesce("bytes_from", zero))
    known = materialise(known.withColumn("cost", cost), "trie-known")
    # an edge's saving is entered on its representative's way, and summed up from below along every way
    own = known.select(F.col("rep").alias("seq"), *NODE, "cost")
    deeper = Window.partitionBy("seq").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    ways = passed.select("seq", *NODE).join(own, ["seq", *NODE], "left").withColumn("cost", F.coalesce("cost", zero))
    ways = ways.withColumn("under", F.coalesce(F.sum("cost").over(deeper), zero))
    under = ways.groupBy(*NODE).agg(F.sum("under").alias("under"))
    digest = _digests(whole.join(seqs.select(F.col("len").alias("d"), "a", "b", "seq"), ["d", "a", "b"]).select("conv", "seq"))
    ended = seqs.join(digest, "seq").select(F.col("len").alias("depth"), "a", "b", "ends")
    parents = known.select(F.col("depth").alias("top"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("above"))
    known = known.join(under, NODE).join(children, NODE, "left").join(ended, NODE, "left").join(parents, ["top", "up_a", "up_b"], "left")

    least = whole.agg(F.min("conv").alias("least"))
    nothing = F.sha2(F.lit(""), 256)
    # expanded edges, some thousand depths at a time
    steps = known.withColumn("at", F.explode(F.sequence(F.col("top") + 1, "depth", F.lit(CHUNK).cast("long"))))
    steps = steps.withColumn("d", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK - 1, "depth"))))
    above = paths.select(F.col("seq").alias("rep"), (F.col("d") + 1).alias("d"), F.col("bytes").alias("bytes_above"))
    steps = steps.join(above, ["rep", "d"], "left").crossJoin(F.broadcast(least))
    bottom = F.col("d") == F.col("depth")
    saved = F.col("under") + (F.col("n_convs") - 1) * (F.col("bytes_to") - F.coalesce("bytes_above", zero))
    parent = F.when(F.col("d") > F.col("top") + 1, F.col("conv_id")).otherwise(F.coalesce("above", "least"))
    nodes = steps.select(
        "conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.coalesce("n_children", zero)).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        saved.alias("saved_tokens"), F.when(bottom, F.coalesce("ends", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    totals = whole.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    leaves = ends.agg(F.coalesce(F.sum("leaf"), zero).alias("n_leaves"))
    savings = own.agg(F.coalesce(F.sum("cost"), zero).alias("saved_tokens"))
    tops = inner.where("depth = 0").agg(F.count("*").alias("n_children"))
    turnless = ended.where("depth = 0").agg(F.max("ends").alias("ends"))
    root = totals.crossJoin(leaves).crossJoin(savings).crossJoin(tops).crossJoin(turnless).select(
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"),
    )
    return nodes.unionByName(root)


def branched(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations of which every one begins with turns of its group's first.

    Conversation c takes the first h = crc32(c) mod ``most`` turns of conversation c - c mod ``group`` and then its own
    turns after its first h. Returns (turns, convs) for ``prefix_trie``.
    """
    turns = materialise(ordered_turns(rows), "trie-turns")
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).alias("h")
    convs = turns.select("conv").distinct().select("conv", head, (F.col("conv") - F.col("conv") % group).alias("first"))
    lead = turns.where(F.col("pos") < most).select(F.col("conv").alias("first"), "pos", "role", "text")
    led = convs.join(lead, "first").where("pos <= h")
    taken = led.groupBy("conv").agg(F.count("*").alias("taken"))
    heads = convs.join(taken, "conv", "left").select("conv", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    own = turns.join(heads, "conv").where("pos > h")
    d = (F.col("taken") + F.col("pos") - F.col("h")).cast("long").alias("d")
    built = led.select("conv", F.col("pos").cast("long").alias("d"), "role", "text").union(own.select("conv", d, "role", "text"))
    return built, convs.select("conv")
