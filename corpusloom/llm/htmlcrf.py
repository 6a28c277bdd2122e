"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

The field has one weight per feature and label and one per pair of neighbouring labels; it is trained by gradient ascent
on the conditional likelihood of labelled pages (forward-backward) and decoded by Viterbi. The labelled pages
are written by `labelled_pages` from a grammar of layouts with a fixed seed: articles in semantic or plain
containers, with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside them.

White space inside a block becomes one space, as does a line break element; blocks are joined by a line end. Null and
empty pages have the empty text. Rows are extracted each. Extra columns are ignored by the query. An empty table
gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .htmlblocks import Block, blocks, features

TRAIN_PAGES, SEED = 600, 11


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """(html, the texts of its main blocks); every block's text is unlike all others of its page."""
    rng = random.Random(seed)
    for _ in range(n):
        used: set[str] = set()

        def text(lo: int, hi: int, stop: bool) -> str:
            while True:
                words = ["".join(rng.choice(("ka", "lo", "mi", "re", "tu", "n", "st", "é")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
                t = " ".join(words).capitalize() + (rng.choice(".....!?") if stop else "")
                if t not in used:
                    used.add(t)
                    return t

        def prose() -> str:
            return text(1, 6, True) if rng.random() < 0.3 else text(4, 60, rng.random() < 0.85)

        main: set[str] = set()

        def own(t: str) -> str:
            main.add(t)
            return t

        def links(k: int) -> str:
            return "<ul>" + "".join(f'<li><a href="#">{text(1, 3, rng.random() < 0.2)}</a></li>' for _ in range(k)) + "</ul>"

        def loud(kind: str) -> str:
            name = rng.choice({"ad": ["ad", "ads", "advert", "sponsored", "promo banner"], "notice": ["cookie-notice", "notice", "alert", "newsletter", "consent"], "more": ["related", "share", "tags", "popular"]}[kind])
            tag = rng.choice(["div", "div", "section", "aside", "p"])
            inner = prose() if tag == "p" or rng.random() < 0.5 else f"<p>{prose()}</p>" if kind != "more" else links(3)
            return f'<{tag} {rng.choice(["class", "id"])}="{name}">{inner}</{tag}>'

        def comments() -> str:
            tag = rng.choice(["section", "div"])
            notes = "".join(rng.choice([f'<div class="comment"><b>{text(1, 2, False)}</b><p>{prose()}</p></div>', f"<p>{prose()}</p>", f'<li class="comment">{prose()}</li>']) for _ in range(rng.randint(1, 5)))
            return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "replies", "discussion"])}"><h3>{text(1, 2, False)}</h3>{notes}</{tag}>'

        def form() -> str:
            """A form that asks the reader for something."""
            fields = "".join(rng.choice([f"<label>{text(1, 3, False)}</label><input>", f"<p>{text(1, 4, False)} <input></p>", f"<div><label>{text(1, 2, False)}</label><select><option>{text(1, 1, False)}</select></div>"]) for _ in range(rng.randint(1, 3)))
            lead = rng.choice(["", f"<p>{prose()}</p>", f"<h3>{text(1, 4, False)}</h3>", f"<legend>{text(1, 3, False)}</legend>"])
            return f"<form{rng.choice(['', ' class=search', ' id=login', ' action=go'])}>{lead}{fields}<button>{text(1, 1, False)}</button></form>"

        def body() -> str:
            out = [f"<h1>{own(text(2, 9, rng.random() < 0.4))}</h1>"] if rng.random() < 0.85 else []
            for _ in range(rng.randint(1, 12)):
                r = rng.random()
                if r < 0.7:
                    out.append(f"<p>{own(prose())}" + rng.choice(["</p>", "</p>", ""]))
                elif r < 0.76:
                    out.append(f"<p><b>{own(prose())}<br>")
                elif r < 0.82:
                    out.append(f"<h2>{own(text(1, 6, False))}</h2>")
                elif r < 0.86:
                    out.append("<ul>" + "".join(f"<li>{own(prose())}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
                elif r < 0.9:
                    out.append(f"<blockquote><p>{own(prose())}</p></blockquote>")
                elif r < 0.93:
                    out.append(f'<p>{text(3, 9, True)[:-1]} <a href="#">kalo</a>.</p>')
                    own(_joined(out[-1]))
                elif r < 0.96:
                    out.append(loud(rng.choice(["ad", "notice", "more"])))
                else:
                    out.append(f"<table><tr><td>{own(text(1, 4, False))}</td><td>{own(text(1, 4, False))}</td></tr></table>")
            if rng.random() < 0.2:
                out.append(comments())
            return "".join(out)

        tag, name = rng.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ' id="content"'), ("div", ' class="content"'), ("div", ' id="article-body"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", "")])
        before = []
        if rng.random() < 0.8:
            k = rng.randint(2, 8)
            before.append(rng.choice([f"<nav>{links(k)}</nav>", f'<div class="{rng.choice(["menu", "navbar", "nav"])}">{links(k)}</div>', f"<header>{text(1, 3, False)}<nav>{links(k)}</nav></header>"]))
        if rng.random() < 0.3:
            start, end = rng.choice([("<header>", "</header>"), ("<div class=header>", "</div>")])
            before.append(f"{start}<h2>{text(1, 3, False)}</h2><p>{prose()}</p>{end}")
        before += [loud("ad")] * (rng.random() < 0.6) + [loud("notice")] * (rng.random() < 0.3)
        after = [comments()] * (rng.random() < 0.35)
        if rng.random() < 0.4:
            after.append(rng.choice([f"<aside><h3>{text(1, 3, False)}</h3>{links(3)}<p>{prose()}</p></aside>", f'<div class="sidebar"><p>{prose()}</p>{links(2)}</div>']))
        if rng.random() < 0.3:
            (after if rng.random() < 0.6 else before).append(form())
        after += [loud("more")] * (rng.random() < 0.3)
        if rng.random() < 0.85:
            after.append(rng.choice([f"<footer>&copy; site &middot; {prose()}</footer>", f"<footer><p>{prose()}</p>{links(2)}</footer>", f'<div class="footer">{prose()}</div>']))
        inner = body()
        # some servers put the whole page or its article into one form
        around = rng.random()
        if around < 0.08:
            before.insert(0, f'<form {rng.choice(["id=form", "id=mainForm method=post", "class=page-form", ""])}><input type="hidden">')
            after.append("</form>")
        elif around < 0.16:
            inner = f"<form{rng.choice(['', ' id=form', ' action=x'])}>{inner}</form>"
        html = f"<!DOCTYPE html><html><head><title>{text(2, 6, False)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}<{tag}{name}>{inner}</{tag}>{''.join(after)}" + rng.choice(["</body></html>", ""])
        yield html, main


def _joined(html: str) -> str:
    return blocks(html)[0].text


class Field:
    """Weights of a chain with two labels: 0 is left out, 1 is main text."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves
        self.seen: dict[tuple[str, ...], tuple[float, float]] = {}

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        out = []
        for b in page:
            own = tuple(features(b))
            if own not in self.seen:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                rows = [self.names[f] for f in own if f in self.names]
                self.seen[own] = tuple(self.weights[rows].sum(0).tolist())
            out.append(self.seen[own])
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        (stay0, go1), (go0, stay1) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, (x, y) in enumerate(self.scores(page)):
            if i:
                from0 = 0 if a + stay0 >= b + go0 else 1
                from1 = 0 if a + go1 > b + stay1 else 1
                a, b = (a + stay0 if from0 == 0 else b + go0) + x, (a + go1 if from1 == 0 else b + stay1) + y
                back.append((from0, from1))
            else:
                a, b = x, y
        if not page:
            return []
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximise the conditional likelihood of the labels by full-batch gradient steps with per-weight scaling."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    flat: list[list[int]] = [[names.setdefault(f, len(names)) for f in features(b)] for page, _ in pages for b in page]
    longest = max(len(p[0]) for p in pages)
    mask = np.zeros((len(pages), longest), bool)
    gold = np.zeros((len(pages), longest), int)
    for i, (page, labels) in enumerate(pages):
        mask[i, : len(page)] = True
        gold[i, : len(page)] = labels
    rows = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    cols = np.concatenate([np.array(f) for f in flat])
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    sum_w, sum_t = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    truth = np.eye(2)[gold[mask]]
    pairs = mask[:, 1:]
    true_moves = np.zeros((2, 2))
    np.add.at(true_moves, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for _ in range(rounds):
        emit = np.zeros((len(flat), 2))
        np.add.at(emit, rows, w[cols])
        e = np.zeros((len(pages), longest, 2))
        e[mask] = emit
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, longest):
            step = lse(alpha[:, k - 1, :, None] + t[None], 1) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = lse(t[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(mask[:, k + 1, None], step, 0)
        total = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - total[:, None, None])[mask]
        edge = np.exp(alpha[:, :-1, :, None] + t[None, None] + (e + beta)[:, 1:, None, :] - total[:, None, None, None])[pairs].sum(0)
        grad_w = np.zeros_like(w)
        np.add.at(grad_w, cols, (truth - node)[rows])
        grad_w = grad_w / len(pages) - decay * w
        grad_t = (true_moves - edge) / len(pages) - decay * t
        sum_w += grad_w**2
        sum_t += grad_t**2
        w += rate * grad_w / np.sqrt(sum_w)
        t += rate * grad_t / np.sqrt(sum_t)
    return Field(names, w, t)


_FIELD: list[Field] = []


def default_field() -> Field:
    """The field trained on the labelled pages of the fixed seed, once per process."""
    if not _FIELD:
        made = []
        for html, main in labelled_pages(TRAIN_PAGES, SEED):
            page = blocks(html)
            made.append((page, [int(b.text in main) for b in page]))
        _FIELD.append(train(made))
    return _FIELD[0]


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, label in zip(page, field.decode(page), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = [main_text(h, field) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
