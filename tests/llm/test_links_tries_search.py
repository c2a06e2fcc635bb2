"""SimHash links, the prefix trie and the ranked search against brute force, and their edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
import xxhash
from tests.llm import brute

from tickspark.llm import lexical, prefix_trie, queries, simhash

SMALL = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=4):
    w = brute.words(lower(text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_components(prints, 4)
    got = queries.op11_simhash(spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in want}
    assert len(got) == len(rows)


@pytest.mark.parametrize("most", [1 << 22, 3000, 1])
def test_balls_meet_within_twice_the_radius(spark, most):
    """Random fingerprints and close ones in every way of spreading the bits; small limits force the deeper cuts."""
    rng = random.Random(5)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    prints = {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for n in range(1, 7):
            prints.add(f)
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            prints.add(g)
    of = dict(enumerate(sorted(signed(f) for f in prints)))
    want = plain_components({i: f % (1 << 64) for i, f in of.items()}, 4)
    fps = spark.createDataFrame([(f,) for f in of.values()], "fp long")
    found = [(r.a, r.b) for r in simhash.links(fps, 2, group_variants=1 << 12, max_variants=most).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in found)
    back = {f: i for i, f in of.items()}
    parent = {i: i for i in of}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        x, y = sorted((root(back[a]), root(back[b])))
        parent[y] = x
    assert {i: root(i) for i in of} == want


def test_simhash_edge_cases(spark, documents):
    texts = [None, "", " \n", "one two", "ONE two", "one two", "a b c d e " * 3000]
    got = sorted(simhash.simhash_duplicates(documents(texts, [7, 3, 5, None, 9, 9, 1])).collect(), key=str)
    assert len(got) == 7
    assert {r.component_id for r in got if r.fp == 0} == {3}
    assert {r.component_id for r in got if r.doc_id in (9, None)} == {9}
    assert simhash.simhash_duplicates(documents([])).count() == 0


# --- trie ----------------------------------------------------------------------------------------------------------


def plain_trie(convs):
    """{(conv_id, depth): other columns} of {conv: [(role, text), …]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(p))
        for p, m in list(members.items())
    )


def trie_rows(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_prefix_sets(spark, seed, monkeypatch):
    """Bushy, path-like and repeated conversations; small buckets and chunks."""
    monkeypatch.setattr(prefix_trie, "BUCKET", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rng = random.Random(seed)
    spine = [("user", f"s{i}") for i in range(40)]
    convs = {-3: [], 0: spine, 1: spine[:17], 2: spine + [("user", "é")]}
    for c in range(3, 60):
        start = spine[: rng.randrange(0, 41)] if seed else []
        convs[c] = start + [(rng.choice("ua"), rng.choice("xyz") * rng.randrange(2)) for _ in range(rng.randrange(0, 9))]
    rows = [(c, d + 1, *t) for c, turns in convs.items() for d, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, d long, role string, text string")
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    assert trie_rows(prefix_trie.prefix_trie(turns, ids)) == plain_trie(convs)


def test_rebuilt_conversations(spark):
    """NULL and repeated turns, NULL roles and ids, absent first conversations, clashing columns."""
    rng = random.Random(11)
    rows = []
    for c in [None, *range(-7, 30)]:
        if c not in (5, 20):
            for i in range(rng.randrange(1, 12)):
                rows.append((c, rng.choice([None, i, i, 2000 * i]), rng.choice([None, "user"]), rng.choice([None, "", "Hi", "ho"]), 1, 2))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, d int, seq int")
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    assert trie_rows(prefix_trie.prefix_trie(*prefix_trie.branched(table))) == plain_trie(built)
    assert prefix_trie.prefix_trie(*prefix_trie.branched(table.limit(0))).count() == 0


def test_turnless_conversations_only(spark):
    turns = spark.createDataFrame([], "conv long, d long, role string, text string")
    ids = spark.createDataFrame([(4,), (2,)], "conv long")
    assert trie_rows(prefix_trie.prefix_trie(turns, ids)) == plain_trie({4: [], 2: []})


def test_fattest(spark):
    rows = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a long, b long").withColumn("f", prefix_trie.fattest(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


# --- search --------------------------------------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    """(item_id, rank, doc_id, score) of lists of (id, text)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    counted = [(i, Counter(cut(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    big, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * big // total
            weigh = lambda t: math.floor(1000 * math.log((2.0 * big + 2) / (2.0 * df[t] + 1)))
            score = sum(weigh(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, n, s[3], -s[0]) for n, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 1])
def test_search_equals_full_scoring(spark, documents, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SEED_ENTRIES", 20)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)] + ["É", "ünï", "Ab"]
    frequent = [1 / (1 + i) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, frequent, k=rng.randrange(1, 60))) for _ in range(300)]
    texts += [texts[0]] * 30 + [None, "", "--", "w1-w1_w2.AB\x7fab", "w3 " * 40000]
    ids = [*range(len(texts) - 1), None]
    items = [(j, " ".join(rng.choices(words, k=rng.randrange(1, 15)))) for j in range(12)]
    items += [(20, None), (21, "nowhere"), (22, texts[0]), (23, "?!")]
    asked = spark.createDataFrame([(*i, 0, "x") for i in items], "item_id long, text string, term int, doc string")
    got = lexical.search(documents(texts, ids), asked).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(list(zip(ids, texts)), items)


def test_search_of_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(documents([]), items).count() == 0
    assert lexical.search(documents(["a b"]), items.limit(0)).count() == 0
    assert lexical.search(documents(["a b"] * 3, [1, 1, 1]), items).count() == 3


def test_search_stores_postings_and_no_lists_of_a_document(spark, documents, monkeypatch):
    """A document's terms once for each of its terms were more than four times the input."""
    stored, keep = {}, lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df, name: stored.setdefault(name, keep(df, name)))
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert lexical.search(documents(["a b c", "b c d", "x"]), items).count() == 2
    assert stored and not [n for n, df in stored.items() if any("array" in t for _, t in df.dtypes)]


def test_folded_bytes_hold_the_terms():
    text = "".join(map(chr, [*range(0x250), 0x3A9, 0x2028, 0x3000, 0x1F600])) * 2
    plain = re.findall(lexical.TERM, lower(text))
    assert [w.decode() for w in text.encode().translate(lexical.FOLD).split()] == plain


def test_forest_keeps_links_and_components():
    def roots(links):
        of = {}
        for a, b in links:
            x, y = of.setdefault(a, a), of.setdefault(b, b)
            of = {n: min(x, y) if r in (x, y) else r for n, r in of.items()}
        return of

    for seed in range(100):
        rng = random.Random(seed)
        links = {(rng.randrange(40), 40 + rng.randrange(30)) for _ in range(rng.randrange(60))}
        a, b = (np.array(x, np.uint64) for x in (zip(*links) if links else ((), ())))
        kept = list(zip(*(x.tolist() for x in simhash.forest(a, b)), strict=True))
        assert set(kept) <= links and roots(kept) == roots(links)
        assert len(kept) == len(roots(links)) - len(set(roots(links).values()))
