"""Quality rules: line frequency across the documents of a host.

Lines are normalised (case, white space, numbers) and hashed. A line that more than ``max_docs`` distinct
documents of one host carry is boilerplate there and is removed, except from the document that has it first
(smallest id) and that document's exact copies. Exact copies count as one document, so a popular text does not
turn its own lines into boilerplate. A document left with fewer than ``min_words`` words is depleted and rejected.

Edge cases: a NULL or empty text has no words and fails; a NULL host is a host of its own; lines of fewer than
``min_line_words`` words are neither counted nor removed; a row that repeats counts once and yields its own result;
empty input gives empty output; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import keyed, materialise, text_groups, with_size_check, words_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
DIGITS = re.compile(r"[0-9]+")

SCHEMA = """doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long,
n_repeat_words long, base_failed boolean, line array<long>, line_words array<long>"""


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 5 - max(i, reach)
            reach = i + 5
    return total


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def measure(text: str | None, min_line_words: int) -> tuple:
    """Everything the rules need from one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    n_dup_lines, seen, lines = 0, set(), {}
    for line in (text or "").split("\n"):
        parts = words_of(line)
        if not parts:
            continue
        if line in seen:
            n_dup_lines += 1
        seen.add(line)
        if len(parts) >= min_line_words:
            norm = DIGITS.sub("0", b" ".join(parts).decode("utf-8", "surrogatepass").lower())
            key = _signed(xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass")))
            lines[key] = lines.get(key, 0) + len(parts)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    n_repeat = repeat_words(words)
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (
        n_words, len(text or "") - spaces, symbols, n_dup_lines, n_repeat, failed, list(lines), list(lines.values())
    )


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    max_docs: int = 10, min_line_words: int = 4, min_words: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, ``removed_words``, ``depleted`` and ``kept``."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            for part in text_groups(b["text"]):
                here = b.slice(part.start, part.stop - part.start)
                cols = list(zip(*(measure(t.as_py(), min_line_words) for t in here["text"]), strict=True))
                made = [pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([here["doc_id"], here["host"], here["text_hash"], *made], names=names)

    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    source = keyed(docs, text, doc_id=doc_id, host=host).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "host": F.coalesce(F.col("host").cast("string"), F.lit("\0none"))}
    ).withColumn("text_hash", F.xxhash64("text"))
    base = materialise(
        source.mapInArrow(measured, SCHEMA).withColumn("row", F.monotonically_increasing_id()), "quality-base"
    )
    lines = base.select("row", "doc_id", "host", "text_hash", F.explode(F.arrays_zip("line", "line_words")).alias("l"))
    lines = lines.select("row", "doc_id", "host", "text_hash", "l.line", "l.line_words")
    carriers = lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    frequent = (
        carriers.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .where(F.col("n_docs") > max_docs)
        .select("host", "line", F.col("first.text_hash").alias("first_hash"))
    )
    removed = (
        lines.join(with_size_check(frequent, "quality-frequent"), ["host", "line"])
        .where(F.col("text_hash") != F.col("first_hash"))
        .groupBy("row")
        .agg(F.sum("line_words").alias("removed_words"))
    )
    out = base.drop("line", "line_words").join(removed, "row", "left").fillna({"removed_words": 0})
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (left < min_words)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), "removed_words", depleted.alias("depleted"), "text_hash",
    )


def drop_rejected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **options) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns. Texts that share an id are judged apart."""
    judged = quality_rules(docs, doc_id, text, host, **options)
    bad = judged.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    bad = with_size_check(bad.toDF("id_", "hash_"), "quality-rejected")
    same = docs[doc_id].cast("long").eqNullSafe(bad["id_"]) & (F.xxhash64(docs[text].cast("string")) == bad["hash_"])
    return docs.join(bad, same, "left_anti")
