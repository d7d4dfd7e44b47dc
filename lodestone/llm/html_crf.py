"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant reader cuts a page into leaf blocks: runs of text between the borders of block elements,
with the elements around them. Each block is the article's or not; its features are the tags around it, the words of
their class, id and role, pairs of neighbouring tags, and the block's length, links, punctuation and cue
words. The field adds weights for two neighbouring labels, and Viterbi decoding picks the likeliest labels
of the whole page.

The weights are learned on labelled pages: of about ``TRAIN_PAGES`` pages drawn by hash, those whose own
markup tells the article from the rest are taken as they are, and the texts of all are dressed
anew in layouts whose parts are known (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, with or without telling names). Prediction is one narrow pass with fixed weights.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

TRAIN_PAGES, DRESSED, LONGEST_TRAINED, EPOCHS, SEED = 300, 4, 200_000, 20, 5
MAX_DEPTH, MAX_CACHED = 200, 50_000

# Reading ------------------------------------------------------------------------------------------

#: Elements that begin and end blocks, those without an end tag, and those whose content is no markup.
BLOCKS = frozenset("address article aside blockquote body button canvas caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("iframe noembed noframes script style template textarea title xmp".split())
#: What a start tag ends if it is open, and where the search stops.
_LIST, _CELL, _TABLE = frozenset(("ul", "ol", "menu", "dir")), frozenset(("td", "th", "caption", "button", "object")), frozenset(("table",))
ENDS = {"li": (("li",), _LIST), "dd": (("dd", "dt"), frozenset(("dl",))), "dt": (("dd", "dt"), frozenset(("dl",))), "tr": (("tr",), _TABLE), "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))), "option": (("option",), frozenset(("select",)))}

_MARKUP = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_NAMES = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
#: An attribute of training pages: whether what it holds is the article's.
_TOLD = re.compile(r"data-told=(\d)")


@dataclass(frozen=True)
class Frame:
    """An open element: its tag, the words of its class, id and role, and what a training page tells of it."""

    tag: str
    words: tuple[str, ...]
    told: int | None = None


def _frame(tag: str, attributes: str) -> Frame:
    names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attributes))
    told = _TOLD.search(attributes)
    return Frame(tag, tuple(dict.fromkeys(w.lower() for w in _WORDS.findall(entities.unescape(names)))), int(told[1]) if told else None)


@dataclass
class Block:
    text: str
    path: tuple[Frame, ...]
    linked: float  # share of the text that is in links


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in page order: character references decoded, white space as one blank. Broken markup is read on."""
    out: list[Block] = []
    stack: list[Frame] = []
    pieces: list[str] = []
    seen: dict[tuple[str, str], Frame] = {}
    links, in_links, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal in_links
        if pieces and (text := " ".join("".join(pieces).split())):
            out.append(Block(text, tuple(stack[:MAX_DEPTH]), min(1.0, in_links / len(text))))
        pieces.clear()
        in_links = 0

    def leave(tags: tuple[str, ...], until: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    while at < end:
        found = _MARKUP.search(page, at)
        text = page[at : found.start() if found else end]
        if text:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            in_links += len(text) if links else 0
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
            if found[1]:
                leave((tag,), _CELL if tag in ("p", "li") else frozenset())
            else:
                leave(("p",), _CELL)
                if tag in ENDS:
                    leave(*ENDS[tag])
                if tag not in VOID:
                    key = (tag, found[3])
                    if key not in seen:
                        seen[key] = _frame(*key)
                    stack.append(seen[key])
            links = 0
        elif tag == "a":
            links = 0 if found[1] else 1
        elif tag == "br":
            pieces.append(" ")
        if tag in RAW and not found[1]:
            close = _CLOSERS[tag].search(page, at)
            at = close.end() if close else end
            if tag in BLOCKS:
                leave((tag,), frozenset())
    flush()
    return out


# Features -----------------------------------------------------------------------------------------

#: Words that go with what isn't the article.
CUES = frozenset("advertisement sponsored cookie cookies privacy subscribe newsletter copyright rights reserved login sign share comments comment reply related menu search terms contact".split())


def path_features(path: tuple[Frame, ...]) -> list[str]:
    tags = [f.tag for f in path if f.tag not in ("html", "body")]
    counts: dict[str, int] = {}
    for t in tags:
        counts[t] = counts.get(t, 0) + 1
    out = {f"t:{t}" for t in tags} | {f"tt:{t}" for t, n in counts.items() if n > 1} | {f"p:{a}>{b}" for a, b in zip(["body", *tags], tags, strict=False)}
    out |= {f"c:{w}" for f in path for w in f.words}
    # the innermost names say most: an advert in an article bears both
    out |= {f"i:{w}" for w in next((f.words for f in reversed(path) if f.words), ())}
    return [*sorted(out), f"l:{tags[-1] if tags else 'body'}"]


def text_features(block: Block) -> list[str]:
    text, n = block.text, block.text.count(" ") + 1
    out = [f"n:{min(6, n.bit_length())}", f"a:{int(block.linked * 3.99)}", f"e:{text[-1] in '.!?…。'}", f",:{min(2, text.count(','))}"]
    if "©" in text:
        out.append("copyright")
    if n <= 30:
        out += sorted({f"k:{w}" for w in text.lower().split() if w in CUES})
    return out


# The field ----------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of features for the article's label against the other; of pairs of labels, of a page's first and last."""

    weights: dict[str, float]
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray
    cached: dict = field(default_factory=dict)

    def score(self, block: Block) -> float:
        known = self.cached.get(block.path)
        if known is None:
            if len(self.cached) >= MAX_CACHED:
                self.cached.clear()
            known = self.cached[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        return known + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.pairs.tolist()
        scores = [self.score(b) for b in page]
        no, yes, back = float(self.first[0]), float(self.first[1]) + scores[0], []
        for s in scores[1:]:
            to_no, to_yes = (no + aa, yes + ba), (no + ab, yes + bb)
            back.append((to_no[1] > to_no[0], to_yes[1] > to_yes[0]))
            no, yes = max(to_no), max(to_yes) + s
        now = yes + float(self.last[1]) > no + float(self.last[0])
        out = [now]
        for to_no, to_yes in reversed(back):
            now = to_yes if now else to_no
            out.append(now)
        return out[::-1]


def learn(pages: list[list[Block]], labels: list[list[int]], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood with a small penalty, by AdaGrad over batches of pages; forward and backward sums run over all pages of a batch at once."""
    names: dict[str, int] = {}
    coded = [[[names.setdefault(f, len(names)) for f in [*path_features(b.path), *text_features(b)]] for b in page] for page in pages]
    w, extra = np.zeros(len(names)), np.zeros(8)  # extra: four pairs, two firsts, two lasts
    heat, heat_extra = np.full(len(names), 1e-6), np.full(8, 1e-6)
    rng, rate, penalty = np.random.default_rng(SEED), 0.5, 1e-5
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), 64):
            some = sorted(order[at : at + 64], key=lambda i: -len(coded[i]))
            longest, size = len(coded[some[0]]), len(some)
            there, gold, flat, place = np.zeros((longest, size), bool), np.zeros((longest, size), int), [], []
            for k, i in enumerate(some):
                there[: len(coded[i]), k] = True
                gold[: len(coded[i]), k] = labels[i]
                for t, fs in enumerate(coded[i]):
                    flat += fs
                    place += [t * size + k] * len(fs)
            flat, place = np.array(flat), np.array(place)
            node = np.zeros((longest, size, 2))
            node[:, :, 1] = np.bincount(place, w[flat], longest * size).reshape(longest, size)
            pairs, first, last = extra[:4].reshape(2, 2), extra[4:6], extra[6:]
            ends = there & ~np.vstack([there[1:], np.zeros((1, size), bool)])
            node[0] += first
            node += ends[:, :, None] * last
            forward, backward = np.zeros_like(node), np.zeros_like(node)
            forward[0] = node[0]
            for t in range(1, longest):
                forward[t] = np.logaddexp(forward[t - 1, :, :1] + pairs[0], forward[t - 1, :, 1:] + pairs[1]) + node[t]
            for t in range(longest - 2, -1, -1):
                step = (backward[t + 1] + node[t + 1])[:, None, :] + pairs
                backward[t] = np.where(there[t + 1][:, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
            total = np.logaddexp(forward[0, :, 0] + backward[0, :, 0], forward[0, :, 1] + backward[0, :, 1])
            share = np.exp(forward + backward - total[:, None]) * there[:, :, None]
            off = (gold - share[:, :, 1]) * there
            g = np.bincount(flat, off.ravel()[place], len(w)) - penalty * size * w
            wrong = np.stack([(gold == 0) - share[:, :, 0], (gold == 1) - share[:, :, 1]], axis=2) * there[:, :, None]
            both = there[1:]
            joint = np.exp(np.clip(forward[:-1, :, :, None] + pairs + (node + backward)[1:, :, None, :] - total[:, None, None], -700, 0)) * both[:, :, None, None]
            came = np.bincount((gold[:-1] * 2 + gold[1:])[both], minlength=4)
            h = np.concatenate([came - joint.sum(axis=(0, 1)).ravel(), wrong[0].sum(axis=0), wrong[ends].sum(axis=0)]) - penalty * size * extra
            heat += g * g
            heat_extra += h * h
            w += rate * g / np.sqrt(heat)
            extra += rate * h / np.sqrt(heat_extra)
    return Field({n: float(w[i]) for n, i in names.items()}, extra[:4].reshape(2, 2), extra[4:6], extra[6:])


# Labelled pages -----------------------------------------------------------------------------------

#: Names that such parts of pages commonly bear.
NAMES = {
    "main": "content|post|entry|article|article-body|story|post-content|main-content|text|page-content|entry-content|body-text",
    "menu": "menu|nav|navbar|navigation|topnav|main-menu|breadcrumb|breadcrumbs|toolbar|links",
    "header": "header|site-header|masthead|top|page-header|logo|branding",
    "footer": "footer|site-footer|copyright|bottom|site-info|legal|colophon",
    "side": "sidebar|side|widget|related|recommended|trending|popular|aside|more-stories|rail|tags|share|social",
    "ad": "ad|ads|advert|advertisement|sponsor|sponsored|promo|banner-ad|adbox|promotion",
    "notice": "cookie|notice|alert|consent|gdpr|cookie-banner|popup|newsletter|subscribe|paywall|warning|message|notification",
    "form": "form|search|search-form|login|signup|contact-form|subscribe-form|poll",
    "comments": "comments|comment-list|commentlist|discussion|replies|responses|reader-comments|thread|respond|reviews",
}
_ELEMENTS = {"main": "article main div section div td", "menu": "nav nav div ul div", "header": "header header div", "footer": "footer footer div section", "side": "aside aside div section", "ad": "div div aside section ins", "notice": "div div section aside dialog", "form": "form", "comments": "section div ol div"}
_SEMANTIC = frozenset("article main nav header footer aside form dialog".split())


class Dresser:
    """Writes labelled pages: texts in a layout whose parts are known."""

    def __init__(self, texts: list[str], rng: np.random.Generator):
        self.texts, self.rng = texts, rng

    def pick(self, options: str | list[str]) -> str:
        options = options.split() if isinstance(options, str) else options
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def text(self, words: int | None = None) -> str:
        found = self.pick(self.texts)
        return entities.escape(" ".join(found.split()[:words]))

    def wrap(self, part: str, inside: str, told: int) -> str:
        tag = self.pick(_ELEMENTS[part])
        # an element that says nothing by itself nearly always bears a telling name
        named = "" if self.chance(0.5 if tag in _SEMANTIC else 0.04) else f' {self.pick("class class id role")}="{self.pick(NAMES[part].split("|"))}"'
        if part == "main" and tag == "td":
            return f"<table><tr><td data-told={told}{named}>{inside}</td></tr></table>"
        return f"<{tag} data-told={told}{named}>{inside}</{tag}>"

    def link(self, words: int = 4) -> str:
        return f'<a href="/{int(self.rng.integers(99))}">{self.text(1 + int(self.rng.integers(words)))}</a>'

    def paragraphs(self, n: int) -> str:
        return "".join(f"<p>{self.text()}</p>" for _ in range(n))

    def part(self, part: str) -> str:
        n = 1 + int(self.rng.integers(6))
        if part == "menu":
            inside = "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>" if self.chance(0.6) else " ".join(self.link() for _ in range(n))
        elif part == "header":
            inside = f"<{(h := self.pick('div h1 h2 p'))}>{self.text(4)}</{h}>" + (f"<p>{self.text(8)}</p>" if self.chance(0.4) else "") + (self.part("menu") if self.chance(0.3) else "")
        elif part == "footer":
            inside = ("&copy; " if self.chance(0.6) else "") + self.text(12 if self.chance(0.7) else None) + (f" <p>{self.text()}</p>" if self.chance(0.3) else "")
        elif part == "form":
            inside = f"<label>{self.text(3)}</label><input name=q>" + (f"<select><option>{self.text(1)}<option>{self.text(1)}</select>" if self.chance(0.3) else "") + (f"<p>{self.text()}</p>" if self.chance(0.3) else "") + f"<button>{self.text(2)}</button>"
        elif part == "comments":
            inner = self.pick("div li article")
            inside = f"<h3>{self.text(2)}</h3>" + "".join(f'<{inner} class="{self.pick("comment reply review comment-body")}">{self.paragraphs(1 + int(self.rng.integers(2)))}</{inner}>' for _ in range(n))
        else:
            inside = (f"<h3>{self.text(3)}</h3>" if self.chance(0.3) else "") + (self.paragraphs(1 + int(self.rng.integers(3))) if self.chance(0.6) else self.text())
            if self.chance(0.3):
                inside += "<ul>" + "".join(f"<li>{self.link(8)}</li>" for _ in range(n)) + "</ul>"
        return self.wrap(part, inside, 0)

    def article(self) -> str:
        head = f"<h1>{self.text(10)}</h1>" if self.chance(0.8) else ""
        if head and self.chance(0.2):
            head = f"<header>{head}</header>"
        out = [head]
        for _ in range(1 if self.chance(0.15) else 1 + int(self.rng.integers(8))):
            kind = self.rng.random()
            out.append(
                f"<p>{self.text()}</p>" if kind < 0.6 else f"<p><b>{self.text()}.<br>" if kind < 0.66 else f"<h2>{self.text(6)}</h2>" if kind < 0.74 else f"<ul><li>{self.text()}</li><li>{self.text(6)}</li></ul>" if kind < 0.8
                else f"<blockquote>{self.text()}</blockquote>" if kind < 0.85 else f"<p>{self.text()} {self.link()} {self.text()}</p>" if kind < 0.92 else f"<div>{self.text()}</div>" if kind < 0.96 else f"<table><tr><td>{self.text(3)}<td>{self.text(3)}</table>"
            )
            if self.chance(0.15):
                out.append(self.part(self.pick("ad side notice form ad")))
        if self.chance(0.12):
            out.append(self.part("comments"))
        return self.wrap("main", "".join(out), 1)

    def page(self) -> str:
        bare = self.chance(0.15)
        before = [p for p, c in (("notice", 0.3), ("header", 0.7), ("menu", 0.8), ("ad", 0.5), ("form", 0.25), ("side", 0.2)) if not bare and self.chance(c)]
        after = [p for p, c in (("side", 0.4), ("comments", 0.5), ("ad", 0.4), ("form", 0.25), ("notice", 0.2), ("footer", 0.85)) if not bare and self.chance(c)]
        body = "".join(self.part(p) for p in before) + self.article() + "".join(self.part(p) for p in after)
        wrapped = f'<div id="{self.pick("page wrapper container site root")}">{body}</div>' if self.chance(0.4) else body
        return f"<html><head><title>{self.text(5)}</title></head><body>{wrapped}</body></html>"


def told(page: list[Block]) -> list[int]:
    """What a dressed page tells of its blocks: the innermost mark counts."""
    return [next((f.told for f in reversed(b.path) if f.told is not None), 0) for b in page]


def by_markup(page: list[Block]) -> list[int] | None:
    """Labels of a page whose markup tells them: its only article, or else main, without nested menus and the like; None for others."""
    for tag in ("article", "main"):
        tops = {b.path[: [f.tag for f in b.path].index(tag) + 1] for b in page if any(f.tag == tag for f in b.path)}
        if len(tops) == 1:
            around = len(next(iter(tops)))
            other = _SEMANTIC - {"article", "main", "header"}
            return [int(any(f.tag == tag for f in b.path) and not any(f.tag in other or set(f.words) & {"ad", "ads", "comment", "comments"} for f in b.path[around:])) for b in page]
    return None


def train(pages: list[str], dressed: int = DRESSED) -> Field:
    """A field from sample pages; where they hold too few texts to dress, made-up words stand in."""
    rng = np.random.default_rng(SEED)
    read = [b for b in map(blocks, pages) if b]
    texts = sorted({x.text[:2000] for page in read for x in page if x.linked < 0.5})
    if len(texts) < 20:
        texts += [" ".join("".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(rng.integers(4, 60))) + "." for _ in range(100)]
    dresser = Dresser(texts, rng)
    known = [(page, labels) for page in read if (labels := by_markup(page)) is not None]
    made = [blocks(dresser.page()) for _ in range(dressed * max(TRAIN_PAGES, len(read)))]
    known += [(page, told(page)) for page in made if page]
    return learn([p for p, _ in known], [k for _, k in known])


# Over a table -------------------------------------------------------------------------------------

_ROW = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def _extracted(model: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts, n, kept = [], [], []
                for page in part.column("html").to_pylist():
                    found = blocks(page or "")
                    own = [b.text for b, keep in zip(found, model.decode(found), strict=True) if keep]
                    texts.append(" ".join(own))
                    n.append(len(found))
                    kept.append(len(own))
                longs = [pa.array(x, pa.int64()) for x in (list(map(len, texts)), n, kept)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), *longs], [f.split()[0] for f in _ROW.split(", ")])

    return run


def sample(pages: DataFrame, size: int = TRAIN_PAGES) -> list[str]:
    """About ``size`` pages of at most LONGEST_TRAINED characters, drawn by a hash of their content, in an order of their own."""
    some = pages.select("html").where(F.char_length("html").between(1, LONGEST_TRAINED))
    share = min(1.0, size / max(1, some.count()))
    rows = some.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < F.lit(share * (1 << 30))).distinct().limit(4 * size).collect()
    return sorted(r["html"] for r in rows)[: 2 * size]


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of each row of ``pages`` (page_id, url, html): the article's blocks by one blank.

    Null and empty pages, and pages without an article, give empty text; null ids and urls stay; repeated rows are answered
    each; pages of any length are read whole; other columns, whatever their names, are not looked at. Ties between labelings
    go to the other label. An empty table gives no rows. ``model`` is trained on a sample of ``pages`` (see :func:`sample`) if not given."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(model or train(sample(rows))), _ROW)


def op13_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
