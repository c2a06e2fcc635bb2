"""Line deduplication with a log-template tree, in built-in functions only.

Tokens with a digit are variable. The tree has a fixed depth: a line goes to the leaf of its token count and its
first ``depth`` tokens. In a leaf that ``min_docs`` documents reach, a token is constant at its position if
lines of ``min_docs`` documents have it there, and a variable field otherwise; a line's template is its
constant tokens and the places of its variable ones. A template with at least ``min_constant`` constant tokens out of
100, which tokens with a digit never are, that occurs in ``min_docs``
documents or more is recurring. Its lines are dropped, except in the document that has it first (smallest id) and
that document's exact copies.

Documents count by text: exact copies are one document, so a copied text keeps its lines and only what different
texts share is dropped. A document counts once for a leaf, token or template, however many of its lines have it.

Lines move as hashes. Each pass over the texts cuts the lines anew instead of moving them: one counts leaves, one
reads the tokens of one copy of every line in a leaf that recurs, the last rebuilds the texts.

Edge cases: a NULL text stays NULL; lines of fewer than ``min_tokens`` tokens are kept; a text whose lines all go
becomes empty, and its row stays; a NULL id comes first; rows that repeat are one document; empty input gives empty
output; all columns of the input pass through, also under names that are used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import SPACE_CLASS, WORD_CLASS, fingerprint, keyed, materialise, with_size_check

VARIABLE = "<*>"


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, f"{SPACE_CLASS}+"), lambda t: t != "")


def _masked(token: Column) -> Column:
    return F.when(F.regexp_like(token, F.lit("[0-9]")), F.lit(VARIABLE)).otherwise(token)


def _lines(source: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(doc_id, fp_a, at, line, n_tokens, line_hash, leaf) of the lines that have a template."""
    each = source.select("doc_id", "fp_a", "fp_b", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    each = each.withColumn("n_tokens", F.length(F.regexp_replace(F.trim(F.regexp_replace("line", f"{WORD_CLASS}+", "w")), "[^w]", "")))
    head = F.slice(_tokens(F.regexp_extract("line", f"^{SPACE_CLASS}*(?:{WORD_CLASS}+{SPACE_CLASS}*){{1,{depth}}}", 0)), 1, depth)
    return each.where(F.col("n_tokens") >= min_tokens).select(
        "doc_id", "fp_a", "fp_b", "at", "line", "n_tokens",
        F.xxhash64("line").alias("line_hash"), F.xxhash64("n_tokens", F.transform(head, _masked)).alias("leaf"),
    )


def recurring_lines(
    source: DataFrame, depth: int = 3, min_tokens: int = 3, min_docs: int = 10, min_constant: int = 60
) -> tuple[DataFrame, DataFrame]:
    """Narrow lines of all documents, and the (leaf, line_hash) that belong to a recurring template with the
    fingerprint of the document that has the template first and the number of documents."""
    narrow = materialise(
        _lines(source, depth, min_tokens).select("doc_id", "fp_a", "fp_b", "at", "line_hash", "leaf"), "lines"
    )
    texts = narrow.select("leaf", "fp_a", "fp_b").distinct()
    leaves = texts.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    leaves = with_size_check(leaves, "line-leaves")
    carriers = narrow.join(leaves, "leaf").groupBy("leaf", "line_hash", "fp_a", "fp_b").agg(F.min("doc_id").alias("doc_id"))
    carriers = materialise(carriers, "line-carriers")
    place = F.struct("doc_id", "fp_a", "fp_b")
    known = carriers.groupBy("leaf", "line_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first"))
    known = materialise(known, "line-known")

    # the tokens of every line there, read from the first document that has it
    pick = with_size_check(known.select(F.col("leaf").alias("leaf_"), F.col("line_hash").alias("hash_"), "first"), "line-pick")
    lines = _lines(source, depth, min_tokens)
    here = (
        (F.col("line_hash") == F.col("hash_"))
        & (F.col("leaf") == F.col("leaf_"))
        & F.struct("doc_id", "fp_a", "fp_b").eqNullSafe(F.col("first"))
    )
    codes = F.transform(_tokens(F.col("line")), lambda t, i: F.xxhash64(i, _masked(t)))
    read = lines.join(pick, here).select("leaf", "line_hash", codes.alias("codes"))
    read = materialise(read.dropDuplicates(["leaf", "line_hash"]), "line-tokens")

    weighed = read.join(known.select("leaf", "line_hash", "n_docs"), ["leaf", "line_hash"])
    support = weighed.select("leaf", "n_docs", F.explode("codes").alias("code"))
    # a document with several lines of a leaf counts once a code: what it has beyond is taken off
    several = carriers.groupBy("leaf", "fp_a", "fp_b").agg(F.collect_list("line_hash").alias("of"))  # bounded by one document
    several = several.where(F.size("of") > 1).select("leaf", "fp_a", "fp_b", F.explode("of").alias("line_hash"))
    tokens = with_size_check(read, "line-codes", 200_000)
    again = several.join(tokens, ["leaf", "line_hash"]).select("leaf", "fp_a", "fp_b", F.explode("codes").alias("code"))
    again = again.groupBy("leaf", "fp_a", "fp_b", "code").agg((1 - F.count(F.lit(1))).alias("n_docs")).where("n_docs < 0")
    support = support.unionByName(again.select("leaf", "n_docs", "code")).groupBy("leaf", "code")
    constant = support.agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "code")
    # at most one code per min_docs of the leaf's documents and position
    fixed = constant.groupBy("leaf").agg(F.collect_list("code").alias("fixed"))
    shaped = read.join(fixed, "leaf").withColumn("constants", F.array_intersect("codes", "fixed"))
    # masked tokens mark a field of the template and are no constants
    masked = F.transform(F.sequence(F.lit(0), F.size("codes") - 1), lambda i: F.xxhash64(i, F.lit(VARIABLE)))
    shaped = shaped.where(100 * F.size(F.array_except("constants", masked)) >= min_constant * F.size("codes"))
    shaped = shaped.select("leaf", "line_hash", F.xxhash64("constants").alias("template"))
    shaped = with_size_check(shaped, "line-shaped")
    # documents of a template: those of its lines, each once
    of = carriers.join(shaped, ["leaf", "line_hash"]).groupBy("leaf", "template", "fp_a", "fp_b").agg(F.min("doc_id").alias("doc_id"))
    total = of.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n_template"), F.min(place).alias("owner"))
    total = total.where(F.col("n_template") >= min_docs)
    found = shaped.join(total, ["leaf", "template"]).select("leaf", "line_hash", "template", "n_template", "owner")
    return narrow, found


def drop_recurring_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 3, min_tokens: int = 3,
    min_docs: int = 10, min_constant: int = 60,
) -> DataFrame:
    """``docs`` with recurring lines removed from the text column; other columns as they are."""
    source = keyed(docs, text, doc_id=doc_id)
    source = source.select(F.col("doc_id").cast("long").alias("doc_id"), *fingerprint(F.col("text")), "text")
    narrow, found = recurring_lines(source, depth, min_tokens, min_docs, min_constant)
    drop = with_size_check(found.select("leaf", "line_hash", "owner"), "line-drop")
    gone = narrow.join(drop, ["leaf", "line_hash"]).where(
        (F.col("fp_a") != F.col("owner.fp_a")) | (F.col("fp_b") != F.col("owner.fp_b"))
    )
    per_doc = gone.groupBy("doc_id", "fp_a", "fp_b").agg(F.collect_set("at").alias("gone"))  # bounded by one document
    per_doc = with_size_check(per_doc.toDF("id_", "a_", "b_", "gone_"), "line-gone", 300_000)
    a, b = fingerprint(docs[text].cast("string"))
    same = docs[doc_id].cast("long").eqNullSafe(per_doc["id_"]) & (a == per_doc["a_"]) & (b == per_doc["b_"])
    kept = F.array_join(
        F.filter(F.split(docs[text].cast("string"), "\n"), lambda line, i: ~F.array_contains(per_doc["gone_"], i)), "\n"
    )
    new = F.when(per_doc["gone_"].isNull(), docs[text].cast("string")).otherwise(kept)
    return docs.join(per_doc, same, "left").select(
        *(new.alias(c) if c == text else docs[c] for c in docs.columns)
    )
