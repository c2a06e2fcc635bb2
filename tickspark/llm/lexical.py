"""Ranked lexical search by posting lists in blocks with exact summaries.

Words are counted where the texts are read, and a posting is one row (document, asked term, occurrences): no row carries
a document's other terms, so the work grows with the postings. Documents are placed in blocks of similar ones: a
document's signature holds the signs of random projections of its weighted terms, and all lists are cut by as many
leading signs as the number of documents asks for. A block's summary holds, for every asked term, the largest impact in
the block: the coordinatewise maximum, so that no document of the block can score above the sum of an item's weights
times these. Any ten scores of an item give a floor below its tenth best score:

* terms whose largest contributions together stay under the floor need no list of theirs to be read,
* a block of the other lists is skipped if its summary stays under the floor, and only then,
* all documents of the other blocks are scored in full.

The floor comes from documents of the item's shortest lists, of which a hashed part is looked at when they are long;
a poor floor costs reading and changes no result.

Edge cases: a NULL text has no term and is not counted among documents; an item without terms, or whose terms are in
no document, has no rows; repeated documents are ranked one by one, with a NULL doc_id last among equal scores;
repeated item rows are searched one by one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import groups, keyed, materialise, with_size_check

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes of a text with its terms lower-cased and a space at every byte outside of a term.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Projections of a signature, and the documents that a block is meant to have.
SIGNS, BLOCK = 12, 64
#: A floor is looked for in so many of an item's shortest lists, in about so many entries of each.
SEED_LISTS, SEED_ENTRIES = 8, 1000
#: The word and the term number that stand for a document itself: no term is empty.
NO_WORD, NO_TERM = "", -1


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, words) of texts with a term: its distinct words and how often each occurs, and one empty word."""
    for batch in batches:
        texts = batch.column("text")
        for part in groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            found = [Counter(text.translate(FOLD).split()) if text else {} for text in texts[part].to_pylist()]
            kept = [i for i, words in enumerate(found) if words]
            found = [found[i] for i in kept]
            offsets = np.cumsum([0, *(len(words) + 1 for words in found)])
            word = pa.array([w for words in found for w in (b"", *words)], pa.binary()).cast(pa.string())
            tf = pa.array([t for words in found for t in (0, *words.values())], pa.int64())
            entries = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([word, tf], ["word", "tf"]))
            n = pa.array([sum(words.values()) for words in found], pa.int64())
            ids = batch.column("doc_id")[part].take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, n, entries], ["doc_id", "n", "words"])


def search(
    docs: DataFrame, items: DataFrame, k: int = 10,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    asked = keyed(items, item_text, item_id=item_id).withColumn("item", F.monotonically_increasing_id())
    asked = asked.select("item", "item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("word"))
    asked = materialise(asked, "search-items")
    itself = docs.sparkSession.range(1).select(F.lit(NO_WORD).alias("word"), F.lit(NO_TERM).cast("long").alias("term"))
    vocabulary = asked.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    vocabulary = materialise(vocabulary.unionByName(itself), "search-vocabulary")
    names = asked.select("item", "item_id").distinct()

    # postings: the asked terms of every document, and one row for itself
    source = keyed(docs, text, doc_id=doc_id).select("doc_id", F.col("text").cast("binary").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    read = source.mapInArrow(counted, f"doc_id {id_type}, n long, words array<struct<word: string, tf: long>>")
    read = read.withColumn("doc", F.monotonically_increasing_id()).select("doc", "doc_id", "n", F.inline("words"))
    known = with_size_check(vocabulary, "search-known")
    postings = materialise(read.join(known, "word").select("doc", "doc_id", "n", "term", "tf"), "search-postings")
    n_docs, n_terms = postings.where(F.col("term") == NO_TERM).agg(F.count("*"), F.sum("n")).first()
    postings = postings.where(F.col("term") != NO_TERM)
    postings = postings.withColumn("m", 10 + F.expr(f"(90 * n * {n_docs or 0}L) div {n_terms or 1}L"))
    postings = postings.select("doc", "doc_id", "term", F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)").alias("impact"))

    lists = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    lists = materialise(lists.withColumn("w", weight), "search-lists")
    asked = materialise(asked.join(vocabulary, "word").join(lists, "term").drop("word", "item_id"), "search-asked")
    placed = materialise(_placed(postings, lists, n_docs), "search-placed")

    floors = materialise(_floors(placed, asked, k), "search-floors")
    asked = with_size_check(_marked(asked, floors), "search-marked")
    summaries = placed.groupBy("block", "term").agg(F.max("impact").alias("most"))
    bounds = summaries.join(asked, "term").groupBy("item", "block", "floor")
    bounds = bounds.agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.max("heavy").alias("listed"))
    opened = bounds.where("listed and bound >= floor and bound > 0").select("item", "block")
    opened = with_size_check(opened, "search-blocks")
    met = placed.join(asked.select("item", "term", "w", "floor"), "term").join(opened, ["block", "item"])
    scored = met.groupBy("item", "doc", "doc_id", "floor").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    ranked = scored.where("score > 0 and score >= floor").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _placed(postings: DataFrame, lists: DataFrame, n_docs: int) -> DataFrame:
    """(doc, doc_id, block, term, impact): the postings of every document, with its block."""
    sign = lambda i: 1 - 2 * F.shiftright(F.xxhash64("term"), i).bitwiseAND(1)
    signs = lists.select("term", *[(F.col("w") * sign(i)).alias(f"w{i}") for i in range(SIGNS)])
    dealt = postings.repartition("doc")
    sums = [F.sum(F.col("impact") * F.col(f"w{i}")).alias(f"s{i}") for i in range(SIGNS)]
    depth = min(SIGNS, max(0, math.ceil(math.log2(max(n_docs, 1) / BLOCK))))
    block = sum(((F.col(f"s{i}") > 0).cast("int") * (1 << (depth - 1 - i)) for i in range(depth)), F.lit(0))
    blocks = dealt.join(with_size_check(signs, "search-signs"), "term").groupBy("doc").agg(*sums).select("doc", block.alias("block"))
    return dealt.join(blocks, "doc").select("doc", "doc_id", "block", "term", "impact")


def _floors(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item, floor): the ``k``-th best score among some documents; no row if fewer have been looked at."""
    shortest = Window.partitionBy("item").orderBy("df", "term")
    seeds = asked.withColumn("nth", F.row_number().over(shortest)).where(F.col("nth") <= SEED_LISTS)
    seeds = with_size_check(seeds.select("item", "term", "w", "df"), "search-seeds")
    part = F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) * F.col("df") < F.lit(SEED_ENTRIES << 20)
    guess = placed.join(seeds, "term").where(part).groupBy("item", "doc").agg(F.sum(F.col("w") * F.col("impact")).alias("guess"))
    likely = guess.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("guess"), "doc")))
    likely = with_size_check(likely.where(F.col("nth") <= 3 * k).select("item", "doc"), "search-likely")
    weights = asked.select("item", "term", "w")
    scored = placed.join(likely, "doc").join(weights, ["item", "term"]).groupBy("item", "doc")
    scored = scored.agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("nth", nth).where(F.col("nth") == k).select("item", F.col("score").alias("floor"))


def _marked(asked: DataFrame, floors: DataFrame) -> DataFrame:
    """(item, term, w, floor, heavy): a document without any heavy term of an item does not reach its floor."""
    light_first = Window.partitionBy("item").orderBy(F.col("w") * F.col("top"), "term")
    reach = F.sum(F.col("w") * F.col("top")).over(light_first.rowsBetween(Window.unboundedPreceding, 0))
    out = asked.withColumn("reach", reach).join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    return out.select("item", "term", "w", "floor", (F.col("reach") >= F.col("floor")).alias("heavy"))
