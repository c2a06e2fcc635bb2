"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks in order. A block's features are the tags of its ancestors, what their class, id and
role say, and its text's length, share of links and ending. The chain has the states boilerplate and main text;
decoding is by Viterbi, so a block is also judged by its neighbours. Main blocks are joined by a line feed.

The model is trained on labelled pages (``training_pages``: ``n_pages`` pages laid out from a fixed list of
layouts, where each block's label is known as it is written), by gradient ascent on the regularised likelihood with
forward-backward sums. Its size is the number of features, some hundreds, so it is sent to every task.

Edge cases: a NULL or empty page gives an empty text and 0 characters; a page without markup is one block; broken and
unclosed markup is read as browsers do (an open paragraph ends at the next block); pages that repeat repeat in the
result; other columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.dom import Block, blocks

MARK = "⁠"  # ends the main blocks of a training page, and is cut off again


@dataclass(frozen=True)
class ChainModel:
    """Log weights: main minus boilerplate for each feature, and of the second state after the first."""

    weights: dict[str, float]
    follow: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the likeliest states of a page's blocks."""
        get = self.weights.get
        (f00, f01), (f10, f11) = self.follow
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for i, b in enumerate(page):
            w = sum(get(f, 0.0) for f in b.features)
            if i:
                a0, b0, a1, b1 = s0 + f00, s1 + f10, s0 + f01, s1 + f11
                back.append((int(b0 > a0), int(b1 > a1)))
                s0, s1 = max(a0, b0), max(a1, b1)
            s1 += w
        state = int(s1 > s0)
        states = [state] if page else []
        for choice in reversed(back):
            state = choice[state]
            states.append(state)
        return [bool(x) for x in reversed(states)]


def _sum(a: float, b: float) -> float:
    m = a if a > b else b
    return m + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[list[tuple[Block, bool]]], rounds: int = 8, rate: float = 0.3, shrink: float = 1e-3) -> ChainModel:
    """Stochastic gradient ascent (with a step for each weight) on the likelihood of the labelled pages."""
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    follow = [[0.0, 0.0], [0.0, 0.0]]
    order = list(range(len(pages)))
    rng = random.Random(5)
    for _ in range(rounds):
        rng.shuffle(order)
        for k in order:
            page = pages[k]
            if not page:
                continue
            scores = [sum(weights.get(f, 0.0) for f in b.features) for b, _ in page]
            ahead = [(0.0, scores[0])]
            for w in scores[1:]:
                p, q = ahead[-1]
                ahead.append((_sum(p + follow[0][0], q + follow[1][0]), _sum(p + follow[0][1], q + follow[1][1]) + w))
            behind = [(0.0, 0.0)]
            for w in reversed(scores[1:]):
                p, q = behind[-1]
                behind.append((_sum(follow[0][0] + p, follow[0][1] + w + q), _sum(follow[1][0] + p, follow[1][1] + w + q)))
            behind.reverse()
            total = _sum(*ahead[-1])
            slope = [[0.0, 0.0], [0.0, 0.0]]
            for i, (b, label) in enumerate(page):
                error = label - math.exp(ahead[i][1] + behind[i][1] - total)
                for f in b.features:
                    g = error - shrink * weights.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-6) + g * g
                    weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
                if i:
                    slope[page[i - 1][1]][label] += 1
                    for s in (0, 1):
                        for t in (0, 1):
                            joint = ahead[i - 1][s] + follow[s][t] + (scores[i] if t else 0.0) + behind[i][t] - total
                            slope[s][t] -= math.exp(joint)
            for s in (0, 1):
                for t in (0, 1):
                    follow[s][t] += 0.05 * (slope[s][t] - shrink * follow[s][t])
    return ChainModel({f: w for f, w in weights.items() if w}, (tuple(follow[0]), tuple(follow[1])))


class _Writer:
    """Labelled pages in many layouts; main text ends with MARK."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choice("aeiou") + self.rng.choice("dlmnrst") for _ in range(self.rng.randint(1, 4))) for _ in range(400)]

    def some(self, a: int, b: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(a, b)))

    def sentence(self, a: int = 3, b: int = 22) -> str:
        return self.some(a, b).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def text(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 3, 5, 9, 20])))

    def attribute(self, cue: str) -> str:
        from tickspark.llm.dom import CUES

        word = self.rng.choice(CUES[cue].split())
        extra = self.rng.choice(["", "-box", " wrap", "-inner", "_1"])
        return f'{self.rng.choice(["class", "id"])}="{word}{extra}"'

    def links(self) -> str:
        item = lambda: f'<a href="/{self.some(1, 1)}">{self.some(1, 4)}</a>'
        n = self.rng.randint(2, 9)
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return "".join(self.rng.choice(["{} ", "<div>{}</div>", "<p>{}</p>"]).format(item()) for _ in range(n))

    def lines(self, most: int = 3) -> str:
        return "".join(self.rng.choice(["<p>{}</p>", "<div>{}</div>", "{}"]).format(self.sentence()) for _ in range(self.rng.randint(1, most)))

    def outside(self, cue: str) -> str:
        """A part that is not the article."""
        rng = self.rng
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(cue, "div")
        attribute = self.attribute(cue)
        if tag != "div" and rng.random() < 0.5:
            attribute = rng.choice(["", 'class="x1"'])
        elif rng.random() < 0.5:
            tag = rng.choice(["div", "section"])
        inner = {
            "menu": self.links,
            "head": lambda: f"<h1><a href='/'>{self.some(1, 3)}</a></h1>" * rng.randint(0, 1) + self.lines(2),
            "foot": lambda: rng.choice(["&copy; ", "", "Copyright "]) + self.some(1, 5) + rng.choice([" &middot; ", " | ", ". "]) + self.sentence() + rng.choice(["", self.links()]),
            "side": lambda: f"<h3>{self.some(1, 4)}</h3>" + rng.choice([self.links, self.lines])(),
            "notice": lambda: self.lines(2) + f"<button>{self.some(1, 2)}</button>" * rng.randint(0, 1),
            "ad": lambda: rng.choice([self.lines, self.links])(),
            "form": lambda: f"<label>{self.some(1, 3)}</label><input type='text'><button>{self.some(1, 2)}</button>" + rng.choice(["", self.lines(1)]),
            "comment": lambda: f"<h3>{self.some(1, 3)}</h3>" + "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(self.text()) for _ in range(rng.randint(1, 6))),
            "share": self.links,
        }[cue]()
        return f"<{tag} {attribute}>{inner}</{tag}>"

    def article(self) -> str:
        rng, parts = self.rng, []
        mark = lambda t: t + MARK
        if rng.random() < 0.8:
            parts.append(f"<h1>{mark(self.some(2, 14).capitalize())}</h1>")
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.75:
                text = self.text()
                if rng.random() < 0.3:
                    link = f'<a href="/x">{self.some(1, 3)}</a>'
                    text = f"{self.sentence()} {link} {text}"
                parts.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(mark(text)))
            elif kind < 0.85:
                parts.append(f"<h2>{mark(self.some(1, 8))}</h2>")
            elif kind < 0.93:
                parts.append("<ul>" + "".join(f"<li>{mark(self.sentence(1, 9))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.97:
                parts.append(f"<blockquote>{mark(self.text())}</blockquote>")
            else:
                parts.append(self.outside(rng.choice(["ad", "share", "side", "notice", "form"])))
        body = "".join(parts)
        tag, attribute = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", self.attribute("main")), ("section", self.attribute("main"))])
        wrapped = f"<{tag} {attribute}>{body}</{tag}>"
        return f"<main>{wrapped}</main>" if tag == "article" and rng.random() < 0.3 else wrapped

    def page(self) -> str:
        rng = self.rng
        before = [self.outside(c) for c in ("head", "menu", "ad", "notice", "side", "form", "share") if rng.random() < 0.5]
        after = [self.outside(c) for c in ("share", "comment", "side", "ad", "form", "menu", "notice") if rng.random() < 0.4]
        foot = [self.outside("foot")] if rng.random() < 0.9 else []
        return "<html><head><title>t</title></head><body>" + "".join([*before, self.article(), *after, *foot]) + rng.choice(["</body></html>", ""])


def training_pages(n_pages: int = 260, seed: int = 11) -> list[list[tuple[Block, bool]]]:
    writer, out = _Writer(seed), []
    for _ in range(n_pages):
        labelled = blocks(writer.page())
        cut = [(b.text.replace(MARK, "").strip(), MARK in b.text) for b in labelled]
        plain = blocks_of_plain(labelled, cut)
        out.append(plain)
    return out


def blocks_of_plain(marked: list[Block], cut: list[tuple[str, bool]]) -> list[tuple[Block, bool]]:
    """Blocks with the mark out of text and features: it may only hide the full stop before it."""
    out = []
    for b, (text, label) in zip(marked, cut, strict=True):
        ends = "stop" if text[-1:] in tuple(".!?…»”\"'") and text else "no stop"
        out.append((Block(text, sorted({f for f in b.features if f not in ("stop", "no stop")} | {ends})), label))
    return out


@lru_cache(maxsize=4)
def default_model(n_pages: int = 260) -> ChainModel:
    return train(training_pages(n_pages))


def main_text(page: str | None, model: ChainModel) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, main in zip(found, model.decode(found), strict=True) if main)


def extract(
    pages: DataFrame, model: ChainModel | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred weights

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), shared.value) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return source.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
