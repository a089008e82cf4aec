"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks at block-level tags; each block knows the tags, classes and ids above it. Two
labels, main text or not, form a chain along the page. Weights are learned from a bounded sample of
pages whose own landmarks (an article or main element) label their blocks, but for menus, forms,
comments and adverts in them, each page also being re-dressed in other layouts: the same blocks in other
containers, with menus, notices, forms, comments and adverts around and inside the article. Where a
table has fewer than ``FEWEST_PAGES`` such pages, made-up pages fill up. A page is decoded by Viterbi.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.common import table, tidy

#: Pages that the model is fitted on (on average), layouts made of each, and passes over them.
SAMPLE_PAGES, LAYOUTS, PASSES = 200, 3, 6
#: Made-up pages that a model is fitted on too, so that it does not depend on how many of a table's pages have landmarks.
MADE_PAGES = 120
SEED = 11

#: Elements whose inside is no text of the page: those that run to the page's end if they are not closed, and those that hide
#: nothing then.
_RAW = "script|style|textarea|title"
_HIDDEN = "noscript|template|svg|iframe|select|canvas"
_ATTRS = r"(?>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)"
_OPAQUE = re.compile(rf"<!--|<(/?)({_RAW}|{_HIDDEN})(?=[\s/>])({_ATTRS}|[^>]*+)>", re.IGNORECASE)
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in _RAW.split("|")}
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_TOKEN = re.compile(rf"<!---->|<(/?)([a-z][^\s/>]*)({_ATTRS})>|<[!?/][^>]*>", re.IGNORECASE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr object canvas iframe noscript select svg template "
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow "
    "ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Names of containers, to dress training pages in.
_MAIN = (
    "article", "main", "div", "div", "div.content", "div.post", "div.entry", "div.article", "div.story", "div.main-content", "section.article",
    "div.entry-content", "div.post-body", "div.article-body", "div#content", "div#main", "div.text", "div.body",
)
_AROUND = (
    "nav", "header", "footer", "aside", "form", "div.menu", "div.nav", "div.navigation", "div.navbar", "div.breadcrumb", "div.header",
    "div.footer", "div.sidebar", "div.side", "div.notice", "div.cookie", "div.cookie-notice", "div.consent", "div.banner", "div.ad",
    "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.related", "div.share", "div.social",
    "div.comments", "section.comments", "div.comment", "div.comment-list", "div.reply", "div.widget", "div.newsletter",
    "div.subscribe", "div.login", "div.search", "div.popup", "div.modal", "div.copyright", "div.legal", "div.pagination",
    "div.toolbar", "div.topbar", "div#comments", "div#sidebar", "div#footer", "div#header", "div#menu", "div#nav", "ol.commentlist",
    "div.disclaimer", "div.alert", "div.recommended", "div.responses", "div.discussion", "div.gdpr", "div.masthead", "div.site-header",
)
#: Elements, and words of classes and ids, of boxes in an article that are not its text; words that make such a name tell something else.
_BOX_TAGS = frozenset("nav aside form footer dialog".split())
_BOX_WORDS = frozenset(
    "comment comments commentlist replies respond disqus ad ads advert adverts advertisement sponsor sponsored promo related recommended "
    "share sharing social newsletter subscribe signup login nav navigation navbar menu breadcrumb breadcrumbs sidebar toolbar pagination "
    "pager widget cookie consent popup modal complementary".split()
)
_NO_BOX = frozenset("no has with without open closed enabled disabled".split())
#: Whether a page has a landmark outside its comments and scripts.
_NOT_READ = r"(?is)<!--.*?-->|<(script|style|textarea|noscript|template)[\s/>].*?</\1\s*>"
_LANDMARK = r"(?i)<(article|main)[\s/>]"


@dataclass
class Block:
    """``main`` tells a block in a landmark and in no box of other matter there."""

    text: str
    tag: str
    path: tuple[str, ...]
    linked: int
    main: bool = False
    features: list[str] = field(default_factory=list)


def _place(tag: str, found: list[str], above: int, quoted: bool) -> int:
    """Where an element is: 0 outside landmarks, 1 in one, 2 in a box of other matter in one."""
    mark = tag in ("article", "main")
    if above == 2 or not (above or mark):
        return above
    if tag in _BOX_TAGS:
        return 1 if tag == "footer" and quoted else 2
    for name in " ".join(found).split():
        parts = {p.lower() for p in _PART.findall(name)}
        if parts & _BOX_WORDS and not parts & _NO_BOX:
            return 2
    return 1


def shown(html: str) -> str:
    """A page with an empty comment in the place of each comment and each element whose inside is no text."""
    spans: list[tuple[int, int]] = []
    opened: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    at = 0
    while m := _OPAQUE.search(html, at):
        at = m.end()
        if m[2] is None:
            end = _COMMENT_END.search(html, at)
            at = end.end() if end else len(html)
            spans.append((m.start(), at))
            continue
        tag, closed = m[2].lower(), _SELF_CLOSED.search(m[3])
        if tag in _RAW_END:
            if m[1] or (closed and opened.get("svg")):
                continue
            end = None if tag in unclosed else _RAW_END[tag].search(html, at)
            if end is None:
                unclosed.add(tag)
                if opened.get("svg"):
                    continue
            at = end.end() if end else len(html)
            spans.append((m.start(), at))
        elif m[1]:
            if opened.get(tag):
                spans.append((opened[tag].pop(), at))
        elif tag == "svg" and closed:
            spans.append((m.start(), at))
        else:
            opened.setdefault(tag, []).append(m.start())
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += (html[at:start], "<!---->")
        at = max(at, end)
    return "".join([*out, html[at:]]) if spans else html


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page that have text, white space folded and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    open_tags: dict[str, int] = {}
    buffer: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                path = tuple(x for tag, names, _ in stack for x in (f"<{tag}", *names))
                out.append(Block(text, stack[-1][0] if stack else "", path, linked, bool(stack) and stack[-1][2] == 1))
            buffer.clear()
        linked = 0

    def pop() -> None:
        tag = stack.pop()[0]
        open_tags[tag] -= 1

    html, at = shown(html or ""), 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            part = html[at : m.start()]
            buffer.append(part)
            if in_link:
                linked += len(part)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1]
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag in ("br", "wbr", "mtd"):
                buffer.append(" ")
            continue
        flush()
        if closing:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if stack and stack[-1][0] in ("p", "li", "dt", "dd", "option") and (stack[-1][0] == "p" or stack[-1][0] == tag):
            pop()
        if tag in _VOID or m[3].endswith("/"):
            continue
        names, found = (), []
        if m[3]:
            found = [x for y in _NAMES.findall(m[3]) for x in y if x]
            names = tuple("." + p.lower() for x in found for p in _PART.findall(x))
        stack.append((tag, names, _place(tag, found, stack[-1][2] if stack else 0, open_tags.get("blockquote", 0) > 0)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    buffer.append(html[at:])
    flush()
    return out


def featured(page: list[Block]) -> list[Block]:
    """Adds to each block its ancestors and the look of its text."""
    n = len(page)
    for k, b in enumerate(page):
        size, share = len(b.text), b.linked / max(1, len(b.text))
        tags = dict.fromkeys(b.path)
        near = [x for x in b.path if x[0] == "."][-1:] or ["none"]
        b.features = [
            *tags,
            f"near {near[0]}",
            f"tag {b.tag}",
            f"size {min(10, size.bit_length())}",
            f"linked {math.ceil(3 * min(1, share))}",
            f"stops {min(4, b.text.count('. ') + b.text.endswith(('.', '!', '?')))}",
            f"commas {min(3, b.text.count(','))}",
            f"sign {'©' in b.text or '|' in b.text}",
            f"place {4 * k // n}",
        ]
    return page


@dataclass
class Model:
    """Weights of features for the label "main text", and of transitions (from, to)."""

    weights: dict[str, float]
    moves: list[list[float]]


def viterbi(page: list[Block], model: Model) -> list[bool]:
    """The likeliest labels of a page."""
    get, t = model.weights.get, model.moves
    a, b, back = 0.0, 0.0, []
    for k, block in enumerate(page):
        s = sum([get(f, 0.0) for f in block.features])
        if k:
            from_a = (a + t[0][0] >= b + t[1][0], a + t[0][1] > b + t[1][1])
            a, b = max(a + t[0][0], b + t[1][0]), max(a + t[0][1], b + t[1][1]) + s
            back.append(from_a)
        else:
            a, b = 0.0, s
    if not page:
        return []
    label = b > a
    out = [label]
    for from_a in reversed(back):
        label = not from_a[label]
        out.append(label)
    return out[::-1]


def _gradient(page: list[Block], truth: list[bool], model: Model) -> tuple[list[float], np.ndarray]:
    """What the log-likelihood's gradient is at each block's score, and at the moves (forward-backward)."""
    get, n = model.weights.get, len(page)
    s = np.array([sum([get(f, 0.0) for f in b.features]) for b in page])
    t = np.array(model.moves)
    fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
    fw[0, 1] = s[0]
    for k in range(1, n):
        fw[k] = np.logaddexp(fw[k - 1, 0] + t[0], fw[k - 1, 1] + t[1])
        fw[k, 1] += s[k]
    for k in range(n - 2, -1, -1):
        bw[k] = np.logaddexp(t[:, 0] + bw[k + 1, 0], t[:, 1] + s[k + 1] + bw[k + 1, 1])
    total = np.logaddexp(*fw[-1])
    up = [float(y) - float(np.exp(fw[k, 1] + bw[k, 1] - total)) for k, y in enumerate(truth)]
    moves = np.zeros((2, 2))
    for k in range(1, n):
        moves[int(truth[k - 1]), int(truth[k])] += 1
        score = np.array([0.0, s[k]])
        moves -= np.exp(fw[k - 1][:, None] + t + score[None, :] + bw[k][None, :] - total)
    return up, moves


def train(pages: list[tuple[list[Block], list[bool]]], passes: int = PASSES, rate: float = 0.5, seed: int = SEED) -> Model:
    """Stochastic gradient ascent with a step that shrinks for each weight as it is used."""
    model, used, moved = Model({}, [[0.0, 0.0], [0.0, 0.0]]), {}, np.full((2, 2), 1.0)
    order = random.Random(seed)
    pages = [p for p in pages if p[0]]
    for _ in range(passes):
        order.shuffle(pages)
        for page, truth in pages:
            up, moves = _gradient(page, truth, model)
            for b, u in zip(page, up, strict=True):
                if abs(u) > 1e-3:
                    for f in b.features:
                        used[f] = used.get(f, 1.0) + u * u
                        model.weights[f] = model.weights.get(f, 0.0) * (1 - 1e-4) + rate * u / math.sqrt(used[f])
            moved += moves**2
            model.moves = (np.array(model.moves) + rate * moves / np.sqrt(moved)).tolist()
    return model


def _dressed(main: list[str], around: list[str], rng: random.Random) -> list[tuple[str, bool]]:
    """Another layout of the same texts, as (html, is main text) pieces."""
    out: list[tuple[str, bool]] = []

    def open_close(kind: str) -> tuple[str, str]:
        tag, mark, name = re.match(r"(\w+)([.#]?)(.*)", kind).groups()
        attr = f' {"id" if mark == "#" else "class"}="{name}"' if mark else ""
        return f"<{tag}{attr}>", f"</{tag}>"

    def aside() -> None:
        kind = rng.choice(_AROUND)
        a, b = open_close(kind)
        out.append((a, False))
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(main if rng.random() < 0.4 else around) if main and around else rng.choice(main or around or ["text"])
            if len(text) > 300 and rng.random() < 0.6:
                text = text[: rng.randint(20, 300)]
            tag = rng.choice(["p", "li", "div", "span", "h3", "a"])
            out.append((f"<{tag}>{text}</{tag}>" if tag != "a" else f'<p><a href="#">{text[:40]}</a></p>', False))
        out.append((b, False))

    wrap = [open_close(rng.choice(["div.page", "div.wrapper", "div.container", "div#page", "body", "div.row"])) for _ in range(rng.randint(0, 2))]
    out += [(a, False) for a, _ in wrap]
    for _ in range(rng.randint(1, 4)):
        aside()
    a, b = open_close(rng.choice(_MAIN))
    out.append((a, False))
    for k, text in enumerate(main):
        tag = "h1" if k == 0 else rng.choice(["p"] * 8 + ["h2", "li", "blockquote", "div", "td", "pre"])
        out.append((f"<{tag}>{text}</{tag}>", True))
        if rng.random() < 0.06:
            aside()
    if rng.random() < 0.4:
        aside()
    out.append((b, False))
    for _ in range(rng.randint(1, 4)):
        aside()
    out += [(b, False) for _, b in reversed(wrap)]
    return out


def labelled(html: str, rng: random.Random, layouts: int = LAYOUTS) -> list[tuple[list[Block], list[bool]]]:
    """Training pages from one page whose landmarks tell its main text; none if it has no landmark."""
    from html import escape

    page = blocks(html)
    truth = [b.main for b in page]
    if not any(truth):
        return []
    out = [(featured(page), truth)]
    main = [escape(b.text) for b, y in zip(page, truth, strict=True) if y]
    around = [escape(b.text) for b, y in zip(page, truth, strict=True) if not y]
    for _ in range(layouts):
        made, labels = [], []
        for piece, y in _dressed(main, around, rng):
            made.append(piece)
            labels += [y] * (len(blocks(piece)) > 0)
        got = blocks("".join(made))
        if len(got) == len(labels):
            out.append((featured(got), labels))
    return out


def made_up(rng: random.Random) -> str:
    """A page of made-up words in an article with other texts around it.

    Texts of an article are of all kinds that pages have: paragraphs, short sentences, headings, single
    words one after another, lists of terms, words with signs on them. What is around an article has short
    texts of the same kinds, but in boxes and links.
    """
    word = lambda: "x" * rng.randint(1, 11)
    words = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    sentence = lambda: words(4, 12) + rng.choice(["", ", " + words(3, 9)]) + rng.choice("...!?")
    signs = lambda: " ".join(word() + rng.choice("%$&*#|+=") * rng.randint(0, 3) for _ in range(rng.randint(3, 40)))
    kinds = (
        lambda: [" ".join(sentence() for _ in range(rng.randint(1, 7)))],
        lambda: [words(1, 5) + rng.choice([".", "", ":"])],
        lambda: [word() + rng.choice(["", ",", "."]) for _ in range(rng.randint(2, 9))],
        lambda: [signs() + rng.choice(["", "."])],
        lambda: [", ".join(words(1, 2) for _ in range(rng.randint(2, 8)))],
    )
    texts = [words(2, 9)]
    odd = rng.random()  # some articles are all of one kind, most are paragraphs with a few others
    for _ in range(rng.randint(2, 9)):
        kind = rng.choice(kinds) if rng.random() < 0.4 else kinds[0] if odd < 0.7 else kinds[int(odd * 100) % len(kinds)]
        texts += kind()
    links = "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 9)))
    note = lambda: rng.choice([words(2, 12), sentence(), words(1, 3), signs()[:80]]) + rng.choice(["", ".", " | " + words(1, 2)])
    notes = "".join(f"<div>{note()}</div>" for _ in range(rng.randint(1, 6)))
    article = "".join(f"<p>{t}</p>" for t in texts)
    return f"<nav><ul>{links}</ul></nav><article>{article}</article><div class=\"{rng.choice(['notice', 'ad', 'sidebar', 'promo', 'comments'])}\">{notes}</div><footer>© {words(2, 6)}</footer>"


def fit(pages: DataFrame, key: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES, seed: int = SEED) -> Model:
    """A model from about ``sample`` pages with landmarks, those of the lowest share of their key's hash; more are never read.

    ``MADE_PAGES`` made-up pages are always among them, for texts and layouts that the drawn ones lack.
    """
    known = pages.where(F.col(html_col).isNotNull()).select(html_col, F.xxhash64(F.col(key).cast("string"), html_col).alias("h"))
    landmark = F.col(html_col).rlike(_LANDMARK) & F.regexp_replace(html_col, _NOT_READ, " ").rlike(_LANDMARK)
    n = known.where(landmark).count()
    drawn = known.where(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(1, n))).where(landmark)
    rows = drawn.orderBy("h", html_col).limit(4 * sample).collect()
    rng = random.Random(seed)
    found = [made for r in rows if (made := labelled(r[html_col], rng))]
    found += [labelled(made_up(rng), rng) for _ in range(MADE_PAGES)]
    return train([x for made in found for x in made])


def extract(df: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """``df`` without ``html_col``, with ``text`` and ``n_chars``, replacing columns so named.

    A null or empty page, and one without main text, gives an empty text. Repeated rows get equal
    texts, an empty table gives an empty one, and pages of any length are read whole.
    """
    kept = [f for f in df.schema.fields if f.name not in ("text", "n_chars", html_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string", "n_chars long"])
    model_b = df.sparkSession.sparkContext.broadcast(model)

    def main_text(html: str | None) -> str:
        page = featured(blocks(html))
        labels = viterbi(page, model_b.value)
        return "\n\n".join([b.text for b, y in zip(page, labels, strict=True) if y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(html_col).to_pylist()]
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "text", "n_chars"])

    return df.select(*[f.name for f in kept], html_col).mapInArrow(tidy(run), schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))


QUERIES = {"op2_html": op2_html}
