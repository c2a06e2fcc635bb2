"""Benchmark decontamination by template, in built-in functions only.

Numbers (digits or words), units and names become typed placeholders, and case and outer punctuation go, so a
benchmark question with other numbers or names keeps its template. Windows of ``width`` template tokens are hashed,
every one of each benchmark item and of each document. The hash join gives the shared windows with the offsets at
which they line up.

Names are told by capitals, which a copy may have lost. So items are also indexed with their names left as words,
which is how a document without capitals reads, and both sides with all words as they are, but for case and outer
punctuation: a copy in any case is found by its words. A template window counts only with ``min_literals`` tokens that
are no placeholders; a row of numbers is no likeness to another row of numbers. An item with too few words beside its
slots is thus found by its own numbers only.

A document can hold an item in several parts, as each inserted or deleted word shifts what follows: each offset is an
alignment of its own. Slots are compared at the item positions that the alignment's windows cover. Each placeholder of
the item must stand for one value of the document throughout: a consistent change of slots is a re-parameterised
question, an inconsistent one a chance likeness. Alignments that agree count together, larger ones first, and the
share of the item's windows that they hold must reach ``coverage``. Alignments without a changed slot always agree.
As many windows of the document must take part, so one phrase is no copy of an item that repeats it.

Items of fewer than ``width`` tokens are windows of their own length, and documents are cut to those lengths too.
Those of fewer than ``min_tokens`` tokens are searched by their words only, not by template.

Edge cases: NULL and empty texts match nothing; an item of punctuation is searched like words; rows that repeat an id
and text, or an item, are one; texts that share an id are judged apart; empty input gives empty output; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import fingerprint, keyed, materialise, with_size_check

# fixed values: marks of the placeholders, and the units that may follow a number
NUMBER, UNIT, NAME = "‹n›", "‹u›", "‹p›"
UNITS = (
    "mm|cm|m|km|in|ft|yd|mi|inch|inches|feet|foot|yards?|miles?|meters?|metres?|kilometers?|kilometres?|"
    "mg|g|kg|lbs?|oz|tons?|tonnes?|grams?|kilograms?|pounds?|ounces?|ml|l|liters?|litres?|gallons?|cups?|"
    "s|sec|secs|min|mins|h|hrs?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|"
    "mph|kmh|km/h|m/s|percent|%|dollars?|euros?|cents?|usd|eur|degrees?|w|kw|v|a|hz|khz|mhz|ghz|kb|mb|gb|tb"
)
# fixed values: number words; those from twenty-one to ninety-nine follow by rule
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
LARGE = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
WORD_VALUES = {
    **{w: n for n, w in enumerate(ONES)}, **{w: 10 * n for n, w in enumerate(TENS, 2)},
    **{f"{t}-{o}": 10 * n + k for n, t in enumerate(TENS, 2) for k, o in enumerate(ONES[:10]) if k}, **LARGE,
}


def _number_word() -> str:
    """The pattern of number words, by first letter, so that other words are left at once."""
    words = sorted([*ONES, *TENS, *LARGE], reverse=True)
    by_letter = {w[0]: "|".join(x[1:] for x in words if x[0] == w[0]) for w in words}
    return f"(?:{'|'.join(f'{k}(?:{v})' for k, v in by_letter.items())})(?:(?<=ty)-(?:{'|'.join(ONES[1:10])}))?"


NUMBER_WORD = _number_word()


def spaced(text: Column) -> Column:
    """Words with single blanks between them."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def canonical(words: Column) -> Column:
    """The template of a spaced text, word by word: splitting both at blanks lines them up."""
    # a name: a capital inside a sentence, of which a text in capitals has none
    # the capital is looked for first: what stands before it is only looked at there
    name = r"(?=\p{Lu})(?:(?<=\p{Ll} |\p{Ll}[,;:] )\p{Lu}[\p{L}'’-]*|(?<=[›,;:] )\p{Lu}(?=[\p{Ll}'’-]|(?!\p{L}))[\p{L}'’-]*)"
    return bare(F.regexp_replace(_numbered(words), name, NAME))


def bare(words: Column) -> Column:
    """Lower case without outer punctuation, unless a word is nothing else."""
    mark = r"[^\p{L}\p{N}‹› %]"
    x = F.regexp_replace(words, rf"(?={mark})(?:(?<=[^ ]){mark}++(?= |$)|(?<= |^){mark}++(?=[^ ]))", "")
    return F.lower(x)


def _numbered(words: Column) -> Column:
    x = F.regexp_replace(words, rf"(?<= |^)(?:[^ 0-9]*+[0-9][^ ]*|(?i:{NUMBER_WORD})(?![\p{{L}}\p{{N}}’'-])[^ ]*)", NUMBER)
    return F.regexp_replace(x, rf"(?<={NUMBER} )(?i:{UNITS})(?=[ .,;:!?)]|$)[^ ]*", UNIT)


def _windows(tokens: Column, width: int) -> Column:
    """Hashes of the windows that start at each token, in order; windows of two widths never share a hash.

    A window's hash is made of those of two shorter ones that cover it, so a token costs a few hashes of two numbers.
    """

    def joined(x: Column, shift: int, *mark: Column) -> Column:
        n = F.greatest(F.size(x) - shift, F.lit(0))
        return F.zip_with(F.slice(x, 1, n), F.slice(x, shift + 1, n), lambda a, b: F.xxhash64(a, b, *mark))

    def with_(x: Column, shift: int, *mark: Column) -> Column:
        # by way of an array of one, so that x is worked out once
        return F.get(F.transform(F.array(x), lambda y: joined(y, shift, *mark)), F.lit(0))

    hashes, span = F.transform(tokens, lambda t: F.xxhash64(t)), 1
    while 2 * span < width:
        hashes, span = with_(hashes, span), 2 * span
    return with_(hashes, width - span, F.lit(width))


def _windows_of(tokens: Column, width: Column, widths: range) -> Column:
    """The windows where the width is a column."""
    return F.coalesce(*(F.when(width == w, _windows(tokens, w)) for w in widths))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _index(items: DataFrame, widths: range, min_tokens: int, min_literals: int) -> DataFrame:
    """(item_id, item, n_windows, i_at, h): the windows of an item's words, and of its templates where they have enough
    tokens that are no placeholders."""
    index = None
    for c in ("i_bare", "i_named", "i_tokens"):
        cut = items.withColumn("of", F.col(c)).withColumn("hashes", _windows_of(F.col("of"), F.col("w"), widths))
        rows = cut.select("item_id", "item", "n_windows", "w", "of", F.posexplode("hashes").alias("i_at", "h"))
        if c != "i_bare":
            literal = F.filter(F.slice("of", F.col("i_at") + 1, F.col("w")), lambda t: ~t.isin(NUMBER, UNIT, NAME))
            rows = rows.where((F.size("of") >= min_tokens) & (F.size(literal) >= F.least(F.col("w"), F.lit(min_literals))))
        rows = rows.select("item_id", "item", "n_windows", "i_at", "h")
        index = rows if index is None else index.union(rows)
    return index.distinct()


def _agreeing(lines: Column, start: Column) -> Column:
    """``start`` with the slots, windows and places of those lines that agree with it and with each other, in their order."""

    def add(so_far: Column, line: Column) -> Column:
        slots = F.array_distinct(F.concat(so_far["slots"], line["slots"]))
        stands = F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["was"])))
        merged = [F.array_union(so_far[c], line[c]).alias(c) for c in ("windows", "places")]
        both = F.struct(slots.alias("slots"), *merged)
        return F.when(F.size(slots) == F.size(stands), both).otherwise(so_far)

    return F.aggregate(lines, start, add)


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = 8, coverage: int = 50, min_tokens: int = 5, min_literals: int = 3,
) -> DataFrame:
    """One row per document and item found in it: doc_id, fp_a, fp_b, item_id, n_windows, n_found, coverage,
    n_slots, reparameterised."""
    items = keyed(benchmark, item_text, item_id=item_id).where("text is not null").distinct()
    items = items.select("item_id", F.xxhash64("text").alias("item"), spaced(F.col("text")).alias("words"))
    words = F.col("words")
    items = items.select(
        "item_id", "item", _split(words).alias("i_words"), _split(canonical(words)).alias("i_tokens"),
        _split(bare(_numbered(words))).alias("i_named"), _split(bare(words)).alias("i_bare"),
    ).where("size(i_tokens) > 0")
    items = items.withColumn("w", F.least(F.size("i_tokens"), F.lit(width)))
    items = materialise(items.withColumn("n_windows", F.size("i_tokens") - F.col("w") + 1), "leak-items")
    widths = [r["w"] for r in items.select("w").distinct().orderBy("w").collect()]  # at most `width` numbers
    index = with_size_check(_index(items, range(1, width + 1), min_tokens, min_literals), "leak-index", 500_000)

    source = keyed(docs, text, doc_id=doc_id).where("text is not null")
    source = source.select(F.col("doc_id").cast("long").alias("doc_id"), *fingerprint(F.col("text")), "text")
    lined = source.select("doc_id", "fp_a", "fp_b", spaced(F.col("text")).alias("words"))
    # a window without placeholders is the same in both
    tokens = lined.select("doc_id", "fp_a", "fp_b", _split(canonical(words)).alias("tokens"), _split(bare(words)).alias("bare"))
    cut = [
        F.arrays_zip(_windows(F.col("tokens"), w).alias("h"), _windows(F.col("bare"), w).alias("g")) for w in widths
    ] or [F.array().cast("array<struct<h:bigint,g:bigint>>")]
    seen = tokens.select("doc_id", "fp_a", "fp_b", F.explode(F.array(*cut)).alias("hashes"))
    seen = seen.select("doc_id", "fp_a", "fp_b", F.posexplode("hashes").alias("at", "x"))
    either = F.when(F.col("x.h") == F.col("x.g"), F.array("x.h")).otherwise(F.array("x.h", "x.g"))
    seen = seen.select("doc_id", "fp_a", "fp_b", "at", F.explode(either).alias("h"))
    pair = ["doc_id", "fp_a", "fp_b", "item_id", "item"]
    hits = seen.join(index, "h").groupBy(*pair, "n_windows", (F.col("at") - F.col("i_at")).alias("offset"))
    lines = hits.agg(F.collect_set("i_at").alias("shared"))  # bounded by one item
    lines = lines.groupBy(*pair, "n_windows").agg(F.collect_list(F.struct("offset", "shared")).alias("lines"))
    most = F.size(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["shared"]))))
    pairs = materialise(lines.where(100 * most >= coverage * F.col("n_windows")), "leak-pairs")

    # the texts of candidates only
    wanted = pairs.select(*(F.col(c).alias(f"{c}_") for c in pair[:3])).distinct()
    wanted = with_size_check(wanted, "leak-wanted", 300_000)
    same = (
        F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("fp_a") == F.col("fp_a_")) & (F.col("fp_b") == F.col("fp_b_"))
    )
    texts = source.join(wanted, same).select("doc_id_", "fp_a_", "fp_b_", _split(spaced(F.col("text"))).alias("d_words")).distinct()
    both = pairs.join(texts, same).join(
        items.select(F.col("item_id").alias("id_"), F.col("item").alias("of_"), "i_words", "i_tokens", "w"),
        F.col("item_id").eqNullSafe(F.col("id_")) & (F.col("item") == F.col("of_")),
    )
    # written, because expressions over these arrays would work them out again for every element
    both = materialise(both.select(*pair, "n_windows", "lines", "d_words", "i_words", "i_tokens", "w"), "leak-both")
    at = lambda c, i: F.get(F.col(c), i)
    plain = lambda c, i: F.lower(F.regexp_replace(at(c, i), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", ""))
    in_digits = F.create_map(*(F.lit(x) for w, n in WORD_VALUES.items() for x in (w, str(n))))
    value = lambda c, i: F.coalesce(F.try_element_at(in_digits, plain(c, i)), plain(c, i))

    def slots(line: Column) -> Column:
        """Placeholders of the item where the line's windows are, with the values there."""
        covered = F.array_distinct(F.flatten(F.transform(line["shared"], lambda i: F.sequence(i, i + F.col("w") - 1))))
        holders = F.filter(covered, lambda j: at("i_tokens", j).isin(NUMBER, UNIT, NAME))
        found = lambda j: F.struct(
            at("i_tokens", j).alias("kind"), value("i_words", j).alias("was"), value("d_words", j + line["offset"]).alias("is")
        )
        return F.array_sort(F.array_distinct(F.transform(holders, found)))

    changed = lambda s: F.exists(s, lambda x: x["was"] != x["is"])
    places = lambda x: F.transform(F.array_sort(x["shared"]), lambda i: i + x["offset"])
    found = F.transform("lines", lambda x: F.struct(
        F.array_sort(x["shared"]).alias("windows"), places(x).alias("places"), slots(x).alias("slots")
    ))
    judged = materialise(both.select(*pair, "n_windows", F.array_distinct(found).alias("lines")), "leak-lines")
    # larger alignments first, among equals those without a change
    ranked = F.transform("lines", lambda x: F.struct((-F.size(x["windows"])).alias("n"), changed(x["slots"]).alias("changed"), x["windows"], x["places"], x["slots"]))
    ranked = F.transform(F.array_sort(ranked), lambda x: F.struct(x["slots"].alias("slots"), x["windows"].alias("windows"), x["places"].alias("places"), x["changed"].alias("changed")))
    judged = judged.select(*pair, "n_windows", ranked.alias("lines"))
    lines = F.col("lines")
    verbatim = F.filter(lines, lambda x: ~x["changed"])
    none = F.struct(*(F.slice(lines[0][c], 1, 0).alias(c) for c in ("slots", "windows", "places")))
    # what the largest hold, what the unchanged hold, and what each alignment holds with those that agree with it
    first = F.array(_agreeing(lines, none), _agreeing(F.concat(verbatim, lines), none))
    each = F.transform(lines, lambda x: _agreeing(F.concat(F.array(x), lines), none))
    judged = materialise(judged.select(*pair, "n_windows", "lines", first.alias("held")), "leak-first")
    size = lambda x: F.least(F.size(x["windows"]), F.size(x["places"]))
    enough = lambda x: 100 * size(x) >= coverage * F.col("n_windows")
    held = F.when(F.exists("held", enough), F.col("held")).otherwise(each)
    sized = F.transform(held, lambda x: F.struct(size(x).alias("n"), (~changed(x["slots"])).alias("same"), x["slots"].alias("slots")))
    judged = judged.select(*pair, "n_windows", F.array_max(sized).alias("best"))
    return judged.where(100 * F.col("best.n") >= coverage * F.col("n_windows")).select(
        "doc_id", "fp_a", "fp_b", "item_id", F.col("n_windows").cast("long").alias("n_windows"),
        F.col("best.n").cast("long").alias("n_found"), (F.col("best.n") / F.col("n_windows")).alias("coverage"),
        F.size("best.slots").cast("long").alias("n_slots"), (~F.col("best.same")).alias("reparameterised"),
    ).distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item was found."""
    found = leaks(docs, benchmark, doc_id, text, **options).select("doc_id", "fp_a", "fp_b").distinct()
    found = with_size_check(found.toDF("id_", "a_", "b_"), "leak-found")
    a, b = fingerprint(docs[text].cast("string"))
    same = docs[doc_id].cast("long").eqNullSafe(found["id_"]) & (a == found["a_"]) & (b == found["b_"])
    return docs.join(found, same, "left_anti")
