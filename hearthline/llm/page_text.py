"""Main text of web pages: a recurrent labeller decides for each block of a page, with the whole page as context.

A page is cut into leaf blocks in page order, each with its tag path. A block's input is the sum of learned vectors of the
tags, class and id words on its path, the mean of learned vectors of its hashed words, and a few measures. A
bidirectional LSTM in numpy reads the sequence of blocks both ways, and a logistic output labels each block as main text or
not, so a label depends on everything before and after it.

The model is trained on a bounded sample of pages (`sample` rows of smallest hash). Their labels come from markup that
says what it is (article and main against nav, aside, footer, form and telling class names). Each sampled page is also read
in other layouts, made by moving its own blocks into other containers with menus, notices, sidebars, forms and reader
comments around them, so that the labels do not hang on one site's markup. The weights, some 100 KB, go to all tasks;
labelling is one pass over all pages without a shuffle.

Defined results: a null or empty html, and one without main text, gives the empty text; markup that is cut off or not closed
is read as browsers do, as far as paragraphs, list items and cells close each other; pages of any length are read whole;
repeated pages are read each; without pages to train on nothing is labelled as main text.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, hash_words, text_bytes

SAMPLE = 240
PATH_SIZE, PATH_WIDTH, WORD_SIZE, WORD_WIDTH, MEASURES, HIDDEN = 1024, 16, 1024, 6, 6, 16
EPOCHS, BATCH, RATE = 10, 16, 0.01

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title", "head")
#: An opening tag closes the nearest open one of these, up to a container.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
HOLDS = frozenset("table ul ol dl div section article main aside nav header footer form body html td th li dd figure blockquote details fieldset".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

NOT_MAIN_TAGS = frozenset("nav header footer aside form menu dialog button".split())
MAIN_TAGS = frozenset("article main".split())
NOT_MAIN_WORDS = frozenset("ad ads advert advertisement banner bar breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo related replies respond share sharing side sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
MAIN_WORDS = frozenset("article body content entry main post story text".split())


@dataclass
class Block:
    text: str
    path: list[str]
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: list[str] = field(default_factory=list)
    hidden: bool = False


def _names_of(attributes: str) -> list[str]:
    out = []
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        out += [f"{m[1].lower()[0]}.{w}" for w in re.split(r"[\s_-]+", value) if w]
    return out


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order. White space within a block is one blank, and character references are
    decoded; scripts, styles and other content that is no text are skipped."""
    blocks: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = anchors = 0
    hidden = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, [x for o in stack if o.tag not in INLINE for x in (f"t.{o.tag}", *o.names)], min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal hidden, anchors
        for o in stack[depth:]:
            hidden -= o.hidden
            anchors -= o.tag == "a"
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece and not hidden:
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                close_block()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if depth is not None and (tag not in INLINE or not any(o.tag not in INLINE for o in stack[depth:])):
                pop_to(depth)
            continue
        if tag in _END_OF and tag != "head" and not m[3].endswith("/"):
            end = _END_OF[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            close_block()
            closes = CLOSES.get(tag)
            if closes:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in closes:
                        pop_to(k)
                    elif stack[k].tag in HOLDS:
                        break
        if tag not in VOID and not m[3].endswith("/"):
            hide = bool(_HIDDEN.search(m[3])) if m[3] else False
            stack.append(_Open(tag, _names_of(m[3]) if m[3] else [], hide))
            hidden += hide
            anchors += tag == "a"
    close_block()
    return blocks


def markup_label(path: list[str]) -> int | None:
    """1 for main text, 0 for the rest, None where the markup does not tell. The innermost telling element decides, but
    nothing inside a menu, notice, form or the like is main text."""
    main = None
    for step in path:
        kind, _, name = step.partition(".")
        if (kind == "t" and name in NOT_MAIN_TAGS) or (kind in "cir" and name in NOT_MAIN_WORDS):
            return 0
        if (kind == "t" and name in MAIN_TAGS) or (kind in "ci" and name in MAIN_WORDS):
            main = 1
    return main


def other_layout(blocks: list[Block], labels: list[int], words: list[str], rng: random.Random) -> str:
    """A page with the same main text in another layout, with the page's other blocks and made-up rests around it."""
    main = [b for b, y in zip(blocks, labels, strict=True) if y]
    rest = [b.text for b, y in zip(blocks, labels, strict=True) if not y]
    esc = entities.escape
    say = lambda a, b: esc(" ".join(rng.choices(words, k=rng.randint(a, b))))
    items = lambda n: "".join(f"<li><a href='/{k}'>{esc(rng.choice(rest)) if rest and rng.random() < 0.5 else say(1, 3)}</a></li>" for k in range(n))
    paragraphs = lambda a, b: "".join(f"<p>{say(5, 40)}</p>" for _ in range(rng.randint(a, b)))
    around = [
        lambda: f"<nav><ul>{items(rng.randint(2, 9))}</ul></nav>",
        lambda: f"<div class='{rng.choice(['menu', 'nav', 'navbar', 'navigation', 'breadcrumbs', 'top-menu'])}'>{items(rng.randint(2, 8))}</div>",
        lambda: f"<header>{rng.choice(['<h1>', '<div>', '<p>'])}{say(1, 6)}</header>",
        lambda: f"<div class='{rng.choice(['header', 'site-header', 'masthead', 'banner'])}'><p>{say(1, 8)}</p></div>",
        lambda: f"<div {rng.choice(['class', 'id'])}='{rng.choice(['cookie-notice', 'notice', 'consent', 'cookie', 'popup', 'modal'])}'><p>{say(4, 30)}</p><button>{say(1, 2)}</button></div>",
        lambda: f"<aside>{paragraphs(1, 4)}</aside>",
        lambda: f"<div class='{rng.choice(['sidebar', 'widget', 'related', 'side-bar', 'promo', 'newsletter'])}'><h3>{say(1, 4)}</h3>{paragraphs(1, 4) if rng.random() < 0.5 else '<ul>' + items(4) + '</ul>'}</div>",
        lambda: f"<div class='{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'ad banner', 'advertisement'])}'>{say(3, 20)}</div>",
        lambda: f"<form action='/s'><label>{say(1, 3)}</label><input name='q'><p>{say(1, 8)}</p><button>{say(1, 1)}</button></form>",
        lambda: f"<{rng.choice(['div', 'section'])} {rng.choice(['class', 'id'])}='{rng.choice(['comments', 'comment-list', 'replies', 'respond', 'reader-comments', 'discussion'])}'><h3>{say(1, 3)}</h3>" + "".join(f"<div class='comment'><p>{say(3, 60)}</p></div>" for _ in range(rng.randint(1, 5))) + f"</{rng.choice(['div', 'section'])}>",
        lambda: f"<div class='{rng.choice(['share', 'social', 'tags', 'pagination', 'toolbar'])}'>{items(3)}</div>",
        lambda: f"<footer>{rng.choice(['', '<p>'])}&copy; {say(1, 12)}</footer>",
        lambda: f"<div {rng.choice(['class', 'id'])}='{rng.choice(['footer', 'site-footer', 'copyright'])}'>{say(2, 14)}</div>",
    ]
    tag, name = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry content"), ("div", "article body"), ("section", "story"), ("div", "main text"), ("div", "")])
    body = "".join(_marked(b, rng) for b in main)
    inner = f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''} data-main>{body}</{tag}>"
    if rng.random() < 0.3:
        inner = f"<main><div class='wrap'>{inner}</div></main>"
    before = "".join(rng.choice(around[:9])() for _ in range(rng.randint(0, 4)))
    after = "".join(rng.choice(around[4:])() for _ in range(rng.randint(0, 5)))
    middle = rng.choice(around[5:11])() if rng.random() < 0.3 else ""
    if middle and tag != "p":
        inner = inner.replace(f"</{tag}>", f"{middle}</{tag}>", 1)
    shell = rng.choice(["{}", "<div id='page'>{}</div>", "<div class='container'><div class='row'>{}</div></div>"])
    return f"<html><head><title>{say(1, 5)}</title></head><body>{shell.format(before + inner + after)}</body></html>"


def _marked(b: Block, rng: random.Random) -> str:
    tag = next((p[2:] for p in reversed(b.path) if p.startswith("t.")), "p")
    tag = tag if tag in ("p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "td") else "p"
    if tag == "li":
        return f"<ul><li>{entities.escape(b.text)}</li></ul>"
    if tag == "td":
        return f"<table><tr><td>{entities.escape(b.text)}</td></tr></table>"
    return f"<{tag}>{'<b>' if rng.random() < 0.1 else ''}{entities.escape(b.text)}</{tag}>"


@dataclass
class Inputs:
    """Blocks of many pages one after the other."""

    path_ids: np.ndarray
    path_starts: np.ndarray
    word_ids: np.ndarray
    word_starts: np.ndarray
    measures: np.ndarray


def _bucket(step: str) -> int:
    return zlib.crc32(step.encode()) % PATH_SIZE


def inputs_of(pages: list[list[Block]]) -> Inputs:
    cache: dict[str, int] = {}
    path_ids, path_starts, texts, measures = [], [0], [], []
    for page in pages:
        for k, b in enumerate(page):
            for step in b.path:
                if step not in cache:
                    cache[step] = _bucket(step)
                path_ids.append(cache[step])
            if not b.path:
                path_ids.append(_bucket("none"))
            path_starts.append(len(path_ids))
            texts.append(b.text)
            n = len(b.text)
            stops = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
            measures.append((np.log1p(n) / 6, b.linked / n, min(1.0, 10 * stops / n), k / len(page), 1 / (1 + k), 1 / (len(page) - k)))
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    hashes, word_starts = hash_words(data, offsets)
    return Inputs(np.array(path_ids), np.array(path_starts), (hashes % np.uint64(WORD_SIZE)).astype(np.int64), word_starts, np.array(measures, dtype=np.float64).reshape(-1, MEASURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of the network, its forward pass and its gradients."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        width = PATH_WIDTH + WORD_WIDTH + MEASURES
        self.w = {"path": rng.normal(0, 0.3, (PATH_SIZE, PATH_WIDTH)), "word": rng.normal(0, 0.3, (WORD_SIZE, WORD_WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN + width), "bias": np.zeros(1)}
        for d in ("fw", "bw"):
            self.w[f"{d}_x"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
            self.w[f"{d}_h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.w[f"{d}_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def vectors(self, f: Inputs) -> np.ndarray:
        if not len(f.measures):
            return np.zeros((0, PATH_WIDTH + WORD_WIDTH + MEASURES))
        path = np.add.reduceat(self.w["path"][f.path_ids], f.path_starts[:-1], axis=0)
        words = np.add.reduceat(self.w["word"][f.word_ids], f.word_starts[:-1], axis=0) / np.diff(f.word_starts)[:, None]
        return np.concatenate([path, words, f.measures], axis=1)

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: (steps, pages, width) -> (steps, pages, HIDDEN)."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        gates, out, saved = x @ self.w[f"{d}_x"] + self.w[f"{d}_b"], np.zeros((steps, pages, HIDDEN)), []
        for t in range(steps):
            z = gates[t] + h @ self.w[f"{d}_h"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            th = np.tanh(c)
            if keep:
                saved.append((i, f, o, g, before, th, h))
            h = o * th
            out[t] = h
        return out, saved

    def _back(self, d: str, x: np.ndarray, saved: list, grad: np.ndarray, g: dict) -> np.ndarray:
        steps, pages, _ = x.shape
        dz_all, dh, dc = np.zeros((steps, pages, 4 * HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        for t in range(steps - 1, -1, -1):
            i, f, o, c_in, before, th, h_before = saved[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - th**2)
            dz = np.concatenate([dc * c_in * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - c_in**2)], axis=1)
            dz_all[t] = dz
            g[f"{d}_h"] += h_before.T @ dz
            dh, dc = dz @ self.w[f"{d}_h"].T, dc * f
        g[f"{d}_x"] += np.einsum("tpi,tpj->ij", x, dz_all)
        g[f"{d}_b"] += dz_all.sum(axis=(0, 1))
        return dz_all @ self.w[f"{d}_x"].T

    @staticmethod
    def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each block in a (steps, pages) grid, read forward and backward; padding follows the page both ways."""
        page = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return step * len(lengths) + page, (np.repeat(lengths, lengths) - 1 - step) * len(lengths) + page

    def forward(self, v: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """The log-odds of each block; v holds the vectors of the pages' blocks one after the other."""
        steps, pages = int(lengths.max(initial=0)), len(lengths)
        ahead, behind = self._grid(lengths)
        sides = []
        for d, place in (("fw", ahead), ("bw", behind)):
            x = np.zeros((steps * pages, v.shape[1]))
            x[place] = v
            x = x.reshape(steps, pages, -1)
            out, saved = self._run(d, x, keep)
            sides.append((x, out.reshape(steps * pages, HIDDEN)[place], saved, place))
        state = np.concatenate([sides[0][1], sides[1][1], v], axis=1)
        return state @ self.w["out"] + self.w["bias"], (sides, state)

    def gradients(self, f: Inputs, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        v = self.vectors(f)
        z, (sides, state) = self.forward(v, lengths, keep=True)
        dz = (_sigmoid(z) - y) * weight / max(1.0, weight.sum())
        g = {k: np.zeros_like(a) for k, a in self.w.items()}
        g["out"], g["bias"] = state.T @ dz, np.array([dz.sum()])
        dstate = dz[:, None] * self.w["out"]
        dv = dstate[:, 2 * HIDDEN :].copy()
        for k, (x, _, saved, place) in enumerate(sides):
            steps, pages, width = x.shape
            grad = np.zeros((steps * pages, HIDDEN))
            grad[place] = dstate[:, k * HIDDEN : (k + 1) * HIDDEN]
            dx = self._back(("fw", "bw")[k], x, saved, grad.reshape(steps, pages, HIDDEN), g)
            dv += dx.reshape(steps * pages, width)[place]
        np.add.at(g["path"], f.path_ids, np.repeat(dv[:, :PATH_WIDTH], np.diff(f.path_starts), axis=0))
        n = np.diff(f.word_starts)
        np.add.at(g["word"], f.word_ids, np.repeat(dv[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / n[:, None], n, axis=0))
        return g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """True for the blocks of main text."""
        lengths = np.array([len(p) for p in pages])
        if not lengths.sum():
            return [np.zeros(0, dtype=bool) for _ in pages]
        z, _ = self.forward(self.vectors(inputs_of(pages)), lengths)
        return np.split(z > 0, np.cumsum(lengths)[:-1])


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 1) -> Labeller:
    """Adam on cross entropy; each page weighs the same."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    mean, square, step = {k: np.zeros_like(a) for k, a in model.w.items()}, {k: np.zeros_like(a) for k, a in model.w.items()}, 0
    pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
    batches = [pages[k : k + BATCH] for k in range(0, len(pages), BATCH)]
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            lengths = np.array([len(b) for b, _ in batches[k]])
            y = np.concatenate([np.array(labels, dtype=float) for _, labels in batches[k]])
            g = model.gradients(inputs_of([b for b, _ in batches[k]]), lengths, y, np.repeat(1 / lengths, lengths))
            norm = np.sqrt(sum((a**2).sum() for a in g.values()))
            step += 1
            rate = RATE * (0.5 if epoch >= epochs - 2 else 1.0)
            for name, a in g.items():
                a = a * min(1.0, 1.0 / (norm + 1e-12))
                mean[name] = 0.9 * mean[name] + 0.1 * a
                square[name] = 0.999 * square[name] + 0.001 * a**2
                model.w[name] -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    return model


def training_pages(sampled: list[str], seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Sampled pages whose markup tells about main text, labelled, and two other layouts of each."""
    rng, out = random.Random(seed), []
    for page in sampled:
        blocks = read_blocks(page)
        told = [markup_label(b.path) for b in blocks]
        if not any(told):
            continue
        labels = [int(bool(y)) for y in told]
        out.append((blocks, labels))
        words = [w for b in blocks for w in b.text.split()][:2000]
        short = [b for b, y in zip(blocks, labels, strict=True) if y][:12]
        for _ in range(3):
            made = read_blocks(other_layout([*short, *(b for b, y in zip(blocks, labels, strict=True) if not y)], [1] * len(short) + [0] * (len(blocks) - sum(labels)), words, rng).replace("data-main", 'role="truemain"'))
            marks = []
            for b in made:
                inside = b.path[b.path.index("r.truemain") + 1 :] if "r.truemain" in b.path else None
                marks.append(int(inside is not None and markup_label(inside) != 0))
                b.path = [s for s in b.path if s != "r.truemain"]
            out.append((made, marks))
    return out


def sample_pages(pages: DataFrame, most: int) -> list[str]:
    """The html of the `most` pages of smallest hash."""
    place = F.xxhash64("page_id", F.lit("sample"))
    rows = columns_only(pages, "page_id", "html").where("html is not null").orderBy(place, "html").limit(most).select("html").collect()
    return [r["html"] for r in rows]


def main_texts(pages: DataFrame, sample: int = SAMPLE, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of each page."""
    if model is None:
        model = train(training_pages(sample_pages(pages, sample)))
    shared = pages.sparkSession.sparkContext.broadcast(model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.w = shared.value
        for batch in batches:
            for first in range(0, len(batch), 128):
                part = batch.slice(first, 128)
                read = [read_blocks(h or "") for h in part.column(2).to_pylist()]
                order = sorted(range(len(read)), key=lambda i: len(read[i]))
                texts, kept = [""] * len(read), [0] * len(read)
                for k in range(0, len(order), 32):
                    group = order[k : k + 32]
                    for i, main in zip(group, labeller.label([read[i] for i in group]), strict=True):
                        texts[i] = "\n".join(b.text for b, y in zip(read[i], main, strict=True) if y)
                        kept[i] = int(main.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in read], pa.int64()), pa.array(kept, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return columns_only(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_main long")
