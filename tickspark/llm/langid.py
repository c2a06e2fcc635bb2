"""Language identification by compression against per-language dictionaries.

A dictionary is raw text of one language. A text is compressed with every dictionary; the language whose
dictionary makes it smallest wins. The score is the share by which the runner-up is larger, scaled to 0..1; below
``min_margin`` the prediction stays but ``accepted`` is false.

Fitting reads labelled rows only, and a bounded number of them: about ``sample_docs`` texts a language, chosen by a
hash of the text, each to at most ``sample_chars`` characters, into dictionaries of at most ``dict_bytes`` bytes.
A language with less text has it repeated up to the size of the largest dictionary, so it doesn't shrink the others.
Prediction reads whole texts, in pieces of ``piece_chars`` so that a text of any length needs bounded memory.

Edge cases: a NULL text, or one without a letter, is ``und`` with score 0; equal sizes go to the first language in
alphabetical order; without labelled rows every text is ``und``; repeated rows repeat in the result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import keyed

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
OUT = "doc_id long, lang_pred string, score double, accepted boolean"


def normalise(text: str) -> str:
    """Letters in lower case, with single blanks between runs of them."""
    return NOT_LETTERS.sub(" ", text).lower().strip()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 6
    min_margin: float = 0.02
    piece_chars: int = 1 << 16


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 400, sample_chars: int = 300,
    dict_bytes: int = 30_000, level: int = 6, min_margin: float = 0.02,
) -> LanguageModel:
    """Dictionaries from rows whose ``lang`` is not NULL."""
    rows = keyed(labelled, text, lang=lang).where("lang is not null and text is not null")
    # copies of a text are drawn together, so they count as one
    counts = rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n"))
    counts = {r["lang"]: r["n"] for r in counts.collect()}
    if not counts:
        return LanguageModel((), ())
    # a hash threshold a language keeps about sample_docs of its rows, whatever their number
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, sample_docs / n))), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.col("text"), F.lit("sample")), F.lit(1_000_000)) < rate * 1_000_000
    # a slice of each text at a place that its hash chooses, so that heads of texts don't stand for all of them
    free = F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1
    part = F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("text", F.lit("place")), free)).cast("int"), F.lit(sample_chars))
    order = F.xxhash64("text", F.lit("order")).alias("order")
    sample = rows.where(drawn).select("lang", part.alias("text"), order).distinct().collect()
    parts: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(sample, key=lambda r: (r["lang"], r["order"], r["text"])):
        parts[r["lang"]].append(normalise(r["text"]))
    parts = {k: v for k, v in parts.items() if any(v)}
    langs = sorted(parts)
    texts = [" ".join(parts[k]).encode()[:dict_bytes].decode(errors="ignore").encode() for k in langs]
    # equal sizes, so that no language gains by having more bytes to copy from
    size = max(map(len, texts), default=0)
    return LanguageModel(tuple(langs), tuple(((t + b" ") * (size // (len(t) + 1) + 1))[:size] for t in texts), level, min_margin)


def classifier(model: LanguageModel):
    """A function from a text to (language, score, accepted)."""
    coders = []
    for data in model.dictionaries:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=model.level)
        coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False))

    def of(text: str | None) -> tuple[str, float, bool]:
        clean = normalise(text) if text else ""
        if not coders or not any(map(str.isalpha, clean)):
            return UNKNOWN, 0.0, False
        step = model.piece_chars
        pieces = [clean[i : i + step].encode("utf-8", "ignore") for i in range(0, len(clean), step)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / second
        return model.languages[best], min(1.0, max(0.0, 4 * margin)), margin >= model.min_margin

    return of


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most dict_bytes a language

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classifier(shared.value)
        for b in batches:
            cols = list(zip(*(of(t.as_py()) for t in b["text"]), strict=True)) or [(), (), ()]
            made = [pa.array(c, type=k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *made], names=["doc_id", "lang_pred", "score", "accepted"])

    source = keyed(docs, text, doc_id=doc_id).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(classified, OUT)
