"""The operators without a fixed contract, the trained ones, the pipeline, and edge cases of all."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from tickspark.llm import decontaminate, dom, html_extract, langid, line_dedup, near_dup, packing, queries, secrets, substring, token_output, tokens
from tickspark.llm import quality as quality_rules

SMALL = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(n: int) -> str:
    out = ""
    while True:
        out += LETTERS[n % 26]
        n //= 26
        if not n:
            return out


def prose(rng, n):
    return " ".join(word(rng.randrange(26, 20000)) for _ in range(n))


# --- Line dedup -------------------------------------------------------------------------------------


def brute_line_dedup(rows, depth=3, min_tokens=3, min_docs=10, min_constant=60):
    """{doc_id: new text} of distinct ids, by plain dictionaries."""
    lines, holders, first = {}, defaultdict(set), {}
    for i, t in sorted(rows):
        for k, line in enumerate((t if t is not None else "").split("\n")):
            w = ["<*>" if any(c in "0123456789" for c in x) else x for x in brute.words(line)]
            if len(w) >= min_tokens:
                key = ((len(w), tuple(w[:depth])), line)
                lines[key] = w
                holders[key].add(t)
                first.setdefault(key, (i, t))
    leaf = Counter()
    for key in lines:
        leaf[key[0]] += len(holders[key])
    support = Counter()
    for key, w in lines.items():
        if leaf[key[0]] >= min_docs:
            for j, x in enumerate(w):
                support[key[0], j, x] += len(holders[key])
    template = {}
    for key, w in lines.items():
        fixed = tuple((j, x) for j, x in enumerate(w) if support[key[0], j, x] >= min_docs)
        if 100 * len(fixed) >= min_constant * len(w):
            template[key] = (key[0], fixed)
    total, owner = Counter(), {}
    for key, tp in template.items():
        total[tp] += len(holders[key])
        owner[tp] = min(owner.get(tp, first[key]), first[key])
    gone = {key: owner[tp][1] for key, tp in template.items() if total[tp] >= min_docs}
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            w = ["<*>" if any(c in "0123456789" for c in x) else x for x in brute.words(line)]
            key = ((len(w), tuple(w[:depth])), line)
            if key not in gone or gone[key] == t:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def line_texts():
    rng = random.Random(1)
    texts = [None, "", "\n\n", "a b", "one two three"]
    for i in range(14):
        texts.append(f"{prose(rng, 12)}\nPosted by user{i} on 2024-01-{i:02d} in the news section\n{prose(rng, 9)}")
    texts += [f"{prose(rng, 20)}\nthe of and {prose(rng, 9)}" for _ in range(14)]  # one leaf, nothing in common
    texts += ["copied line number one here\nand another copied line"] * 12
    texts += [f"Posted by user{i} on 2023-02-{i:02d} in the news section" for i in range(3)]
    return texts


def test_line_dedup(spark, documents):
    texts = line_texts()
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(documents(texts)).collect()}
    assert got == brute_line_dedup(list(enumerate(texts)))
    assert "Posted by" in got[5] and not any("Posted by" in got[i] for i in range(6, 19))
    assert got[40] == texts[40] and got[-1 + len(texts)] == ""
    assert line_dedup.drop_recurring_lines(documents(texts)).columns == documents(texts).columns


def test_line_dedup_on_the_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert got == brute_line_dedup(rows)


def test_lines_count_documents_once(spark, documents):
    rng = random.Random(13)
    steps = lambda a, b: "\n".join(f"Step {k} of the plan" for k in range(a, b))
    two = [f"{prose(rng, 20)}\n{steps(0, 9)}", f"{prose(rng, 20)}\n{steps(9, 10)}"]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(documents(two)).collect()}
    assert got == dict(enumerate(two))
    ten = [f"{prose(rng, 20)}\n{steps(k, k + 2)}" for k in range(10)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(documents(ten)).collect()}
    assert got[0] == ten[0] and not any("Step" in got[i] for i in range(1, 10))


def test_rows_of_numbers_stay(spark, documents):
    rng = random.Random(14)
    row = lambda: " ".join(f"{rng.randrange(999)}.{rng.randrange(9)}" for _ in range(3))
    texts = [f"{prose(rng, 20)}\n{row()}\n{row()}" for _ in range(15)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(documents(texts)).collect()}
    assert got == dict(enumerate(texts))


# --- Language identification ------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    langs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(langs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.96
    assert found.where("score < 0 or score > 1 or lang_pred = 'und'").isEmpty()


def test_language_edges(spark, documents):
    rng = random.Random(4)
    a, b = ["ab", "ba", "abba", "baab"], ["xy", "yx", "xyyx", "yxxy"]
    some = lambda v: " ".join(rng.choice(v) for _ in range(60))
    train = documents([some(a) for _ in range(9)]).union(documents([some(b) for _ in range(9)], lang="xx"))
    model = langid.fit(train.union(documents([some(b)], lang=None)))
    texts = [some(a), some(b), None, "", "123 !? ·", some(a) * 2000]
    got = {r.doc_id: r for r in langid.predict(documents(texts), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "xx", "und", "und", "und", "en"]
    nothing = langid.predict(documents(texts), langid.fit(train.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_with_little_text(spark, documents):
    rng = random.Random(15)
    vocabulary = {k: [f"{c}{word(rng.randrange(26, 5000))}" for _ in range(300)] for k, c in (("en", "q"), ("xx", "z"))}
    some = lambda k: " ".join(rng.choice(vocabulary[k]) for _ in range(40))
    many = {k: [some(k) for _ in range(60)] for k in vocabulary}
    rare = documents(["wenige worte einer seltenen sprache hier"], lang="yy")
    train = documents(many["en"]).union(documents(many["xx"] + many["xx"][:1] * 2000, lang="xx")).union(rare)
    model = langid.fit(train, sample_docs=20, dict_bytes=3000)
    assert model.languages == ("en", "xx", "yy") and {len(d) for d in model.dictionaries} == {3000}
    assert len(set(model.dictionaries[1].split())) > 100, "copies don't thin the draw"
    texts = [some("en"), some("xx"), "seltenen sprache hier wenige worte"]
    assert [r.lang_pred for r in langid.predict(documents(texts), model).orderBy("doc_id").collect()] == ["en", "xx", "yy"]


# --- Decontamination --------------------------------------------------------------------------------


def benchmark(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, words string")


def test_leaks_and_parameters(spark, documents):
    rng = random.Random(7)
    item = (
        "A farmer named Alice sells 12 kg of apples to Bob for 3 dollars and then Alice buys 12 pears "
        "while Bob keeps 7 kg of apples for himself at home"
    )
    other = item.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "45").replace(" 3 ", " 9 ").replace(" 7 ", " 8 ")
    broken = item.replace("12 kg", "45 kg")  # 12 stands for two values
    half = " ".join(item.split()[:14])
    texts = [
        None, "", prose(rng, 50) + " " + item + " " + prose(rng, 30), prose(rng, 40) + " " + other, broken, half,
        prose(rng, 300), "the answer is simply forty two", "", prose(rng, 20) + "\n" + item.replace(" ", "\n"),
    ]
    items = benchmark(spark, [item, None, "", "too short", "answer is simply forty two", prose(rng, 40)])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(documents(texts), items).collect()}
    assert set(got) >= {(2, 0), (3, 0), (7, 4), (9, 0)} and not {d for d, _ in got} & {0, 1, 4, 6}
    assert not got[2, 0].reparameterised and got[3, 0].reparameterised and got[3, 0].n_slots >= 6
    kept = decontaminate.drop_leaks(documents(texts), items)
    assert {r.doc_id for r in kept.collect()} == set(range(10)) - {d for d, _ in got}
    assert kept.columns == documents(texts).columns
    assert decontaminate.leaks(documents(texts), benchmark(spark, [])).count() == 0


def test_leaks_of_the_tables(spark):
    """Whole items that stand in a document, found by plain search."""
    sf = "/root/testdata/sf0.01"
    flat = lambda t: " ".join((t or "").lower().split())
    docs = {r.doc_id: flat(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for i, x in items.items() for d, t in docs.items() if x in t}
    assert {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf).collect()} == want and want


def test_short_items_at_every_position(spark, documents):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (5, 7, 8, 9, 10, 11, 12, 13)]
    near = [" ".join(["qq", *t.split()[1:]]) for t in items[5:]]  # one word changed at an end
    near += [" ".join([*t.split()[:-1], "qq"]) for t in items[5:]]
    of = [*range(8), 5, 6, 7, 5, 6, 7]
    texts = [" ".join(["zz"] * lead + [t, "yy"]) for lead in range(9) for t in items + near]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(texts), benchmark(spark, items)).collect()}
    assert got == {(d, of[d % len(of)]) for d in range(len(texts))}


def test_leaks_of_edited_copies(spark, documents):
    rng = random.Random(12)
    part = lambda n: prose(rng, n)
    item = f"{part(12)} Anna Bell {part(12)} 12 {part(10)} Anna Bell {part(10)} 12 {part(8)}"
    w = item.split()
    inserted, deleted = " ".join(w[:25] + ["extra"] + w[25:]), " ".join(w[:20] + w[21:])
    other = lambda t: t.replace("Anna", "Carla").replace("Bell", "Stone").replace("12", "45")
    broken = " ".join(w[:29] + ["extra"] + w[29:]).replace("12", "45", 1)  # 12 stands for two values
    third = " ".join(w[:24]) + " zz " + other(" ".join(w[24:]))
    texts = [inserted, deleted, other(inserted), other(deleted), f"{item} {part(20)} {other(item)}", broken, third]
    got = {r.doc_id: r for r in decontaminate.leaks(documents(texts), benchmark(spark, [item])).collect()}
    assert set(got) >= {0, 1, 2, 3, 4} and [got[i].reparameterised for i in range(5)] == [False, False, True, True, False]
    assert got[0].n_found == got[2].n_found == len(w) - 7 - 7 and got[4].n_found == len(w) - 7
    assert all(got[i].n_found < len(w) - 7 - 7 for i in (5, 6) if i in got), "parts that disagree do not count together"


def test_leaks_in_any_case_and_number_words(spark, documents):
    rng = random.Random(13)
    item = (
        "A farmer named Alice sells 12 kg of apples to Bob for 3 dollars and then Alice buys 12 pears "
        "while Bob keeps 7 kg of apples for himself at home"
    )
    other = item.replace("12", "45").replace(" 3 ", " 9 ").replace(" 7 ", " 8 ")
    spelt = item.replace("12", "twelve").replace(" 3 ", " three ").replace(" 7 ", " Seven, ")
    texts = [
        item.upper(), item.lower(), item.title(), other.lower(), spelt, other.replace("45 pears", "forty-five pears"),
        other.replace("45 pears", "forty-six pears"), spelt.upper(),
    ]
    texts = [f"{prose(rng, 30)}\n{t}\n{prose(rng, 30)}" for t in texts]
    got = {r.doc_id: r for r in decontaminate.leaks(documents(texts), benchmark(spark, [item])).collect()}
    assert set(got) >= {0, 1, 2, 3, 4, 5, 7}
    assert [got[i].reparameterised for i in (0, 1, 2, 3, 4, 5)] == [False, False, False, True, False, True]
    assert 6 not in got or got[6].n_found < got[5].n_found


def test_rows_of_numbers_and_repeats_are_no_leaks(spark, documents):
    numbers, chant = "1 2 3 5 8 13 21 34 55 89 144 233", " ".join(["la"] * 60)
    items = benchmark(spark, [numbers, chant, "Which 12 34 56 78 90 11 13 15 17 19 21 23 25", "short one", "Alice"])
    rows = "12.5 3.1 0.7 4 5 6 7 8 9 10 11 12 13 14\n" * 3
    texts = [rows, f"so {numbers} it goes", " ".join(["la"] * 12), chant.upper(), "a SHORT one, here", "one short", "alice!", "5 6 7 8 9"]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(texts), items).collect()}
    assert got == {(1, 0), (3, 1), (4, 3), (6, 4)}
    assert decontaminate.leaks(documents([]), items).count() == 0


def test_leaks_of_rows_without_id(spark):
    text = "the quick brown fox jumps over the lazy dog while nobody looks at it from the window"
    docs = spark.createDataFrame([(None, text, 1), (None, "clean", 2), (7, text, 3), (7, text, 4), (8, "x " * 20_000 + text, 5)], "doc_id long, text string, h long")
    items = benchmark(spark, [text])
    assert sorted((r.doc_id or 0) for r in decontaminate.leaks(docs, items).collect()) == [0, 7, 8]
    assert [r.h for r in decontaminate.drop_leaks(docs, items).collect()] == [2]


# --- Page extraction --------------------------------------------------------------------------------


def test_blocks_of_broken_markup():
    page = "<div>a<p>b<b>c<br>d<p>e</div><script>x='</p>'</script><!-- <p>no --><ul><li>f<li>g</ul>&lt;h&nbsp; i"
    assert [b.text for b in dom.blocks(page)] == ["a", "bc d", "e", "f", "g", "<h i"]
    assert dom.blocks(None) == dom.blocks("") == dom.blocks("<p> </p>") == [] and dom.blocks("plain")[0].text == "plain"
    assert [b.text for b in dom.blocks("<a href='x>y'>z</a")] == ["z", "</a"] or dom.blocks("<a href='x>y'>z</a")


def test_text_behind_skipped_elements():
    for tag in ('<svg class="i"/>', "<svg-icon></svg-icon>", "<title-bar>", "<template-x></template-x>", "<iframe src=x>", "<svg><title>t</title></svg>"):
        assert [b.text for b in dom.blocks(f"<p>a {tag}b</p><p>c</p>")] == ["a b", "c"], tag
    assert [b.text for b in dom.blocks("<p>a</p><script>b<p>c")] == ["a"]


def test_quotes_in_attributes():
    texts = lambda page: [b.text for b in dom.blocks(page)]
    page = "<p title=it's>First part.</p><p>Second part.</p><p>It's the end > now</p>"
    assert texts(page) == ["First part.", "Second part.", "It's the end > now"]
    assert texts('<p class="x>First.') == ["First."]
    assert texts('<p class="x>First.</p><p id="y">Second.</p>') == ["Second."], "a quote is closed by the next one"
    assert texts("<p a='1>2' b = \"x>'y\" c=\"\">z</p>") == ["z"] and texts("<p/ =x ='>y") == ["y"]
    assert texts("a < b <3 <") == ["a < b <3 <"] and texts("<p>a</p><p b='") == ["a", "<p b='"]
    for part in ('<p a="', "<a b='c>", "<", "< a", "<a ", "<svg ", "<!-", "<script "):
        start = time.perf_counter()
        dom.blocks(part * 100_000 + "x > y")
        assert time.perf_counter() - start < 10, part


def test_pages_of_every_kind(spark):
    kind = "page_id long, url string, html string, text string, n_chars int, features string"
    rows = [(1, "u", None, "t", 1, "f"), (2, None, "", "t", 1, "f"), (None, "u", "<p>" + "word " * 400_000 + "</p>", None, None, None)] * 2
    got = html_extract.extract(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 6 and sorted((r.page_id or 0, r.n_chars == 0) for r in got)[2:] == [(1, True)] * 2 + [(2, True)] * 2
    assert html_extract.extract(spark.createDataFrame([], kind)).count() == 0


def test_held_out_pages():
    model = html_extract.default_model()
    right = total = 0
    for page in html_extract.training_pages(120, seed=99):
        states = model.decode([b for b, _ in page])
        right += sum(s == label for s, (_, label) in zip(states, page, strict=True))
        total += len(page)
    assert right / total > 0.97


def test_pages_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op9_html_extraction(spark, SMALL).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        want = [b.text for b in dom.blocks(article)]
        assert r.text.split("\n") == want and r.n_chars == len(r.text)


# --- Pipeline and edges -----------------------------------------------------------------------------


def test_pipeline_equals_its_stages_in_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = quality_rules.quality_rules(docs).where("kept").select("doc_id").collect()
    keep = {r.doc_id for r in kept}
    assert all(not brute.base_quality(t)[-1] for i, t in rows if i in keep)
    rows = [(i, t) for i, t in rows if i in keep]
    lined = brute_line_dedup(rows)
    groups = brute.near_groups(list(lined.items()), 5)
    lined = {i: t for i, t in lined.items() if groups[i][1] == i}
    left = spark.createDataFrame([(i, t) for i, t in lined.items()], "doc_id long, text string")
    leaky = {r.doc_id for r in decontaminate.leaks(left, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    lined = {i: t for i, t in lined.items() if i not in leaky}
    from tests.llm.test_contracts import check_packing

    check_packing(out.collect(), lined)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_keep_columns_and_take_empty_tables(spark, documents):
    for docs in (documents(["x " * 30, None, "", "y z " * 40]), documents([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == documents([]).columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


OPERATORS = {
    "line_dedup": line_dedup.drop_recurring_lines,
    "near_dup": near_dup.near_duplicates,
    "near_drop": near_dup.drop_near_duplicates,
    "substring": substring.remove_repeats,
    "quality": quality_rules.quality_rules,
    "secrets": secrets.find_secrets,
    "packing": packing.pack,
    "token_output": token_output.packed_sequences,
    "language": lambda d: langid.predict(d, langid.fit(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_null_and_repeated_rows(spark, documents, name):
    assert OPERATORS[name](documents([])).collect() == []
    text = "some words that repeat often " * 8
    docs = documents([text, text, None, "", text + "x", None], ids=[3, 3, 5, None, None, 5])
    rows = OPERATORS[name](docs).collect()
    if name == "near_drop":
        assert sorted((r.doc_id or -1, r.text) for r in rows if r.doc_id == 3) == [(3, text)]
    elif name not in ("token_output",):
        assert len(rows) == 6, "a row for each row"


def test_near_drop_keeps_the_first_of_each_group(spark, documents):
    rng = random.Random(5)
    base = prose(rng, 200).split()
    texts = [" ".join(base), " ".join(base[:-1] + ["q"]), prose(rng, 100), " ".join(base)]
    got = near_dup.drop_near_duplicates(documents(texts, ids=[9, 4, 7, 8])).collect()
    assert sorted(r.doc_id for r in got) == [4, 7]


def test_quality_hosts_without_a_name(spark, documents):
    docs = documents(["w " * 3, "one two three four five six seven eight nine ten eleven"], source=None)
    assert [r.kept for r in quality_rules.quality_rules(docs).orderBy("doc_id").collect()] == [False, True]


def test_a_text_is_encoded_in_one_call(monkeypatch):
    coder = tokens.Encoder()
    calls = []

    class Counted:
        def encode_to_numpy(self, text, **options):
            calls.append(text)
            return plain.encode_to_numpy(text, **options)

    plain, coder._coder = coder._coder, Counted()
    text = " ".join(f"w{i}x" for i in range(500)) + "  two blanks\n\n"
    assert coder.encode(text)[:-4] == plain.encode_to_numpy(text).astype("<u4").tobytes()
    assert calls == [text] and coder.encode(None) == coder.encode("") == (2).to_bytes(4, "little")


def test_templates_look_at_marks_and_capitals_first(spark):
    """Outer punctuation and names in odd places; the patterns start with the character they are about."""
    cases = {
        "He met Anna-Lena, (Bob) and X.": ("he met ‹p› bob and ‹p›", "he met anna-lena bob and x"),
        "ALL CAPS HERE! ... '' ok%": ("all caps here . ' ok%", "all caps here . ' ok%"),
        "It cost 12 km, said Éva's (aunt).": ("it cost ‹n› ‹u› said ‹p› aunt", "it cost 12 km said éva's aunt"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t STRING")
    got = {r.t: (r.a, r.b) for r in rows.select("t", decontaminate.canonical(F.col("t")).alias("a"), decontaminate.bare(F.col("t")).alias("b")).collect()}
    assert got == cases
    plan = rows.select(decontaminate.bare(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "(?=[^" in plan and plan.index("(?=[^") < plan.index("(?<=")
