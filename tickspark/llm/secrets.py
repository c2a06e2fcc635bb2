"""Secret scan through a trigram index, with built-in functions only.

Each rule is a regular expression. A Boolean query of trigrams that any match must contain is derived from it:
AND over a literal run, OR over alternatives, nothing for classes and repeats. Postings (trigram, document) are made
for the trigrams of those queries; they are intersected per document, and only the documents that satisfy a rule's
query are verified with the rule's expression. A rule without mandatory trigrams scans every text.

Spans are half-open code point ranges of leftmost, non-overlapping matches, kind by kind. Texts with no candidate
rule are not searched by those rules at all.

Edge cases: a NULL text is empty; a NULL doc_id is treated like any other; rows that share a doc_id share their
candidates, and each is verified on its own text; empty input gives empty output; other columns are not read.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import keyed, with_size_check

Query = tuple[frozenset[str], ...] | None  # alternatives, each a set of trigrams; None: no condition


@dataclass(frozen=True)
class Rule:
    """``pattern`` must not match the empty text. Of the matches, those with ``least`` or more characters in group
    ``group`` count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: kinds and patterns of the scan, base kinds first
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]+", 0, 27),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str, most: int = 64) -> Query:
    """Sets of lower-case trigrams; each match contains all of at least one set."""

    def strings(seq, limit: int) -> list[list[str]]:
        """Alternatives, each a list of literal runs; runs break where the text is not fixed."""
        out: list[list[str]] = [[""]]
        for op, arg in seq:
            name = str(op)
            if name == "LITERAL":
                parts = [[chr(arg).lower()]]
            elif name == "SUBPATTERN":
                parts = strings(arg[-1], limit)
            elif name == "BRANCH":
                parts = [x for branch in arg[1] for x in strings(branch, limit)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1) and _literal(arg[2]) is not None:
                parts = [[""], [_literal(arg[2])]]
            elif name == "IN" and 0 < len(chars := _members(arg)) <= 6:
                parts = [[c] for c in chars]
            elif name in ("AT", "ASSERT_NOT"):
                parts = [[""]]
            else:
                parts = [["", ""]]  # a break
            out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in out for b in parts]
            if len(out) > limit:
                out = [["", ""]]
        return out

    found = {frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)) for runs in strings(sre.parse(pattern), most)}
    if not all(found):
        return None
    return tuple(sorted((s for s in found if not any(o < s for o in found)), key=sorted))


def _literal(seq) -> str | None:
    chars = [chr(a).lower() if str(o) == "LITERAL" else None for o, a in seq]
    return None if None in chars else "".join(chars)


def _members(items) -> list[str]:
    if any(str(o) not in ("LITERAL", "RANGE") for o, _ in items):
        return []
    out: list[str] = []
    for o, a in items:
        out += [chr(a)] if str(o) == "LITERAL" else [chr(c) for c in range(a[0], min(a[1], a[0] + 9) + 1)]
    return sorted({c.lower() for c in out})


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): documents whose postings satisfy the query of some rule, with the numbers of those rules."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    low = F.lower("text")
    present = F.array_compact(F.array(*(F.when(low.contains(g), F.lit(n)) for n, g in enumerate(grams))))
    postings = docs.select("doc_id", F.explode(present).alias("gram"))
    clauses = [(i, c, grams.index(g), len(s)) for i, q in queries.items() for c, s in enumerate(q) for g in s]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(clauses, "rule int, clause int, gram int, needed int")
    hits = (
        postings.distinct()
        .join(F.broadcast(wanted), "gram")  # as long as the rules
        .groupBy("doc_id", "rule", "clause", "needed")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return hits.where("n = needed").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, text: Column, searched: Column) -> Column:
    """Array of (start, end, kind) of a rule's matches in ``text``, where ``searched`` holds."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), checked.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(at.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        good = F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pieces, start, step, lambda acc: acc["found"])
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.when(searched & F.regexp_like(text, F.lit(_long_enough(rule))), found).otherwise(none)


def _long_enough(rule: Rule) -> str:
    """For a rule that is one repeated class, the class that many times; else the pattern. Saves listing the many
    short runs that would be dropped."""
    return f"{rule.pattern[:-1]}{{{rule.least}}}" if rule.pattern.startswith("[") and rule.pattern.endswith("]+") else rule.pattern


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``found``, an array of (start, end, kind) by start, then by the order
    of the rules."""
    source = keyed(docs, text, doc_id=doc_id)
    source = source.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = with_size_check(candidates(source, rules), "secret-candidates", 300_000).withColumnRenamed("doc_id", "id")
    joined = source.join(some, source["doc_id"].eqNullSafe(some["id"]), "left")
    needs = {i for i, r in enumerate(rules) if trigram_query(r.pattern) is not None}
    each = [
        _spans(r, F.col("text"), F.coalesce(F.array_contains("rules", i), F.lit(False)) if i in needs else F.lit(True))
        for i, r in enumerate(rules)
    ]
    rank = {r.kind: i for i, r in enumerate(rules)}
    order = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    flat = F.transform(
        F.concat(*each),
        lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    found = F.transform(F.sort_array(flat), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select("doc_id", found.alias("found"))
