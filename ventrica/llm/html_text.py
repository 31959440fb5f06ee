"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its
ancestors. A block's features are its ancestor tags, the words in their class, id and role,
and a few facts of the text. The chain has two states, main and other; weights are learned
by gradient ascent on the likelihood of labelled pages, and a page is decoded by Viterbi.
The labelled pages are made from layouts whose containers carry the label.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import cache, cached_property
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 400
EPOCHS = 6
RATE = 0.3
#: Tags that end a block, tags without content, tags whose content is not text, inline tags that close implicitly.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea select iframe object svg title".split())
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
#: The rest of a tag; quotes count after an equals sign only.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|))*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RIGHTS = re.compile(r"©|copyright|all rights reserved", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Tags that an opening tag closes if they are open.
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
#: Of the tags without text, those that run to the end of the page if they are not closed.
_TO_END = frozenset("script style textarea title iframe".split())


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def leaf_blocks(page: str, vocabulary: frozenset[str] | None = None) -> list[tuple[str, tuple[str, ...], str, float]]:
    """(text, distinct ancestor marks, tag of the block, share of the text in links) of every non-empty block in order.

    One scan forward. Of marks only those in ``vocabulary`` are kept, if it is given, so that the
    work for a block does not grow with its depth. A tag that never ends is text; an attribute
    whose quote never ends is taken without it.
    """
    out: list[tuple[str, tuple[str, ...], str, float]] = []
    stack: list[tuple[str, list[str]]] = []
    open_tags: Counter = Counter()
    active: dict[str, int] = {}
    parts: list[str] = []
    linked, at, in_link, quotes = 0, 0, 0, True
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, tuple(active), stack[-1][0] if stack else "none", min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            linked += len(text) if in_link else 0

    def leave(size: int) -> None:
        while len(stack) > size:
            tag, marks = stack.pop()
            open_tags[tag] -= 1
            for m in marks:
                active[m] -= 1
                if not active[m]:
                    del active[m]

    start = page.find("<")
    while start >= 0:
        if page.startswith("<!--", start):
            add(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            start = page.find("<", at)
            continue
        named = _NAME.match(page, start + 1)
        if not named and page[start + 1 : start + 2] not in ("!", "?", "/"):
            start = page.find("<", start + 1)
            continue
        rest = _REST.match(page, named.end()) if named and quotes else None
        if rest:
            end, inside = rest.end(), rest[1]
        else:  # no end that quotes allow, so from here on quotes don't count
            quotes = quotes and not named
            end = page.find(">", start) + 1
            if not end:
                break
            inside = page[named.end() : end - 1] if named else ""
        add(page[at:start])
        at, closing = end, page[start + 1] == "/"
        start = page.find("<", at)
        if not named:
            continue
        tag = named[1].lower()
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK_TAGS:
                flush()
                if open_tags[tag]:
                    leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW_TAGS:
            if tag not in endless and (not inside.rstrip().endswith("/") or tag not in ("svg", "object")):
                found = _end_of(tag).search(page, at)
                if found or tag in _TO_END:
                    at = found.end() if found else len(page)
                    start = page.find("<", at)
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link += 1
        elif tag in BLOCK_TAGS:
            flush()
            if tag in VOID_TAGS:
                continue
            if stack and stack[-1][0] == "p":
                leave(len(stack) - 1)
            closes = _CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1) if any(open_tags[c] for c in closes) else ():
                if stack[k][0] in closes:
                    leave(k)
                    if stack and stack[-1][0] in closes and tag == "tr":
                        continue
                    break
                if stack[k][0] not in ("p", "address"):
                    break
            marks = [tag]
            for a in _ATTRIBUTE.finditer(inside) if inside else ():
                marks += [f".{w}" for w in _PART.findall((a[2] or a[3] or a[4] or "").lower())]
            marks = [m for m in dict.fromkeys(marks) if vocabulary is None or m in vocabulary]
            stack.append((tag, marks))
            open_tags[tag] += 1
            for m in marks:
                active[m] = active.get(m, 0) + 1
    add(page[at:])
    flush()
    return out


#: Marks that tell of a container of main text; a page without them is known by its text alone.
_TELLING = frozenset("article main .article .main .content .post .entry .story".split())


def features(text: str, marks: tuple[str, ...], own: str, links: float) -> tuple[str, ...]:
    n = text.count(" ") + 1
    size = "words<3" if n < 3 else "words<8" if n < 8 else "words<20" if n < 20 else "words<50" if n < 50 else "words50+"
    link = "links0" if links < 0.05 else "links<half" if links < 0.5 else "links+"
    ends = "stops" if text[-1] in ".!?:;\"')»”" else "runs on"
    told = "named" if any(m in _TELLING for m in marks) else "unnamed"
    return ("bias", size, link, ends, f"own {own}", f"{told} {size}", f"{told} {link}", f"{told} {own}", *(["copyright"] if "©" in text[:40] else []), *(["unnamed rights"] if told == "unnamed" and _RIGHTS.search(text[:60]) else []), *sorted(set(marks) - {"html", "body"}))


_ASIDE_TEXT = ("Copyright © all rights reserved", "We use cookies on this site. Accept all", "Share this", "Related posts", "Sign up for our newsletter", "Sponsored", "Log in", "Reply", "Search")


def _plain_page(rnd: random.Random, main: str, links, note) -> str:
    """A page of bare containers or a table, without tags or names that tell what they hold."""
    bare = lambda x: f"<div>{x}</div>"
    before, after = [rnd.choice((links, lambda: bare(links()), lambda: links() + note()))() for _ in range(rnd.randint(0, 2))], [rnd.choice((links, lambda: f"<p>{rnd.choice(_ASIDE_TEXT)}</p>"))() for _ in range(rnd.randint(0, 2))]
    if rnd.random() < 0.5:
        main = main.replace("<p>", "<div>").replace("</p>", "</div>")
    if rnd.random() < 0.4:
        cells = [f"<td>{links()}</td>", f"<td>{main}</td>"]
        inner = ("<table><tr><td colspan=2>" + rnd.choice(_ASIDE_TEXT) + "</td></tr>" if rnd.random() < 0.4 else "<table>") + "<tr>" + "".join(cells) + "</tr></table>" + "".join(after)
    else:
        inner = "".join(map(bare, [*before, main, *after]))
    return f"<html><body>{inner if rnd.random() < 0.5 else bare(inner)}</body></html>"


def _training_page(rnd: random.Random) -> str:
    """A page whose main containers are marked by data-main; every other block is not main."""
    word = lambda: "".join(rnd.choice(("ka", "lo", "mi", "ren", "sta", "tor", "ne", "ul")) for _ in range(rnd.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    sentence = lambda: words(1, 25).capitalize() + rnd.choice((".", ".", ".", "", "!"))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rnd.randint(2, 8))) + "</ul>"
    note = lambda: rnd.choice((rnd.choice(_ASIDE_TEXT), sentence(), sentence() + " " + sentence()))

    def side(tag: str, names: tuple[str, ...]) -> str:
        attribute = rnd.choice((f' class="{rnd.choice(names)}"', f' id="{rnd.choice(names)}"')) if names and rnd.random() < 0.9 else ""
        if tag == "div" and not attribute:
            attribute = f' class="{names[0]}"'
        return f"<{tag}{attribute}>{rnd.choice((links, note, lambda: f'<p>{note()}</p>', lambda: f'<h3>{words(1, 3)}</h3><p>{note()}</p>'))()}</{tag}>"

    menus = lambda: side(rnd.choice(("nav", "nav", "div")), ("menu", "nav", "navbar", "breadcrumb", "navigation", "topbar"))
    others = (
        lambda: side("aside", ("sidebar", "related", "widget")),
        lambda: side("div", ("sidebar", "side", "rail", "widget", "related")),
        lambda: side("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")),
        lambda: side("div", ("cookie", "notice", "consent", "alert", "popup", "modal", "cookie-notice")),
        lambda: side("form", ("search", "newsletter", "subscribe", "login", "signup")),
        lambda: side("div", ("share", "social", "newsletter", "subscribe", "tags")),
    )
    comments = lambda: rnd.choice(
        (
            f'<section class="{rnd.choice(("comments", "comment-list", "responses", "discussion"))}"><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{sentence()} {sentence()}</p></div>' for _ in range(rnd.randint(1, 5))) + "</section>",
            f'<div id="{rnd.choice(("comments", "disqus", "replies"))}">' + "".join(f"<p>{sentence()}</p>" for _ in range(rnd.randint(1, 5))) + "</div>",
            "<section class='comments'>" + "".join(f'<article class="comment"><p>{sentence()}</p></article>' for _ in range(rnd.randint(1, 4))) + "</section>",
        )
    )
    body = [f"<h1>{words(1, 12)}</h1>"] if rnd.random() < 0.85 else []
    for _ in range(rnd.randint(1, 14)):
        body.append(
            rnd.choices(
                (f"<p>{' '.join(sentence() for _ in range(rnd.randint(1, 5)))}</p>", f"<p>{words(1, 6)}</p>", f"<h2>{words(1, 8)}</h2>", "<ul>" + "".join(f"<li>{words(1, 14)}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>", f"<blockquote>{sentence()}</blockquote>", f"<pre>{words(1, 30)}</pre>", f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>", f'<p>{sentence()} <a href="/{word()}">{words(1, 4)}</a> {sentence()}</p>'),
                (10, 3, 2, 1, 1, 1, 1, 2),
            )[0]
        )
        if rnd.random() < 0.08:
            body.append(f"<data-off>{rnd.choice(others)()}</data-off>")
    main = "<data-main>" + "".join(body) + "</data-main>"
    if rnd.random() < 0.15:
        main += comments()
    kind = rnd.random()
    if kind > 0.72:
        return _plain_page(rnd, main, links, note)
    if kind < 0.5:
        main = f"<article>{main}</article>"
    elif kind < 0.6:
        main = f"<main>{main}</main>"
    else:
        main = f'<div class="{rnd.choice(("content", "post", "entry", "article", "main", "story", "post-content", "article-body"))}">{main}</div>'
    if rnd.random() < 0.3 and kind < 0.5:
        main = f"<main>{main}</main>"
    page = []
    if rnd.random() < 0.5:
        page.append(f"<header>{rnd.choice((note, menus, lambda: f'<h1>{words(1, 3)}</h1>'))()}</header>")
    if rnd.random() < 0.8:
        page.append(menus())
    page += [rnd.choice(others)() for _ in range(rnd.randint(0, 3))]
    page.append(main)
    if rnd.random() < 0.35:
        page.append(comments())
    page += [rnd.choice(others)() for _ in range(rnd.randint(0, 2))]
    if rnd.random() < 0.85:
        page.append(rnd.choice((f"<footer>{note()}</footer>", f"<footer><p>{note()}</p></footer>", f'<div class="footer">{note()}</div>', f"<footer>{links()}</footer>")))
    if rnd.random() < 0.2:
        page = [f'<div class="{rnd.choice(("wrapper", "container", "page"))}">', *page, "</div>"]
    return "<html><head><title>x</title></head><body>" + "".join(page) + "</body></html>"


def labelled_pages(count: int, seed: int) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Features and labels (1 main) of the blocks of ``count`` pages."""
    rnd, out = random.Random(seed), []
    for _ in range(count):
        page = _training_page(rnd)
        marked = page.replace("<data-main>", "<section class='zzmain'>").replace("</data-main>", "</section>").replace("<data-off>", "<section class='zzoff'>").replace("</data-off>", "</section>")
        plain = re.sub(r"</?data-(?:main|off)>", "", page)
        labels = [int(".zzmain" in m and ".zzoff" not in m) for _, m, _, _ in leaf_blocks(marked)]
        blocks = [features(*b) for b in leaf_blocks(plain)]
        if len(blocks) == len(labels):  # else the labelling containers have moved a block border
            out.append((blocks, labels))
    return out


def _sum_logs(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


class ChainField:
    """Two states; a weight per feature for "main" against "other", and one per transition."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]
        self.known: dict[tuple[str, ...], float] = {}

    @cached_property
    def vocabulary(self) -> frozenset[str]:
        """The features that count; made once, after training."""
        return frozenset(self.weights) | _TELLING

    def energy(self, block: tuple[str, ...]) -> float:
        if block not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[block] = sum(self.weights.get(f, 0.0) for f in block)
        return self.known[block]

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int, rate: float) -> ChainField:
        squares: Counter = Counter()
        for _ in range(epochs):
            for blocks, labels in pages:
                if not blocks:
                    continue
                e = [sum(self.weights.get(f, 0.0) for f in b) for b in blocks]
                n, m = len(e), self.moves
                forward, backward = [[0.0, e[0]]], [[0.0, 0.0]] * n
                for k in range(1, n):
                    forward.append([_sum_logs(forward[-1][0] + m[0][s], forward[-1][1] + m[1][s]) + s * e[k] for s in (0, 1)])
                for k in range(n - 2, -1, -1):
                    backward[k] = [_sum_logs(m[s][0] + backward[k + 1][0], m[s][1] + e[k + 1] + backward[k + 1][1]) for s in (0, 1)]
                whole = _sum_logs(*forward[-1])
                slope: Counter = Counter()
                for k in range(n):
                    off = labels[k] - exp(forward[k][1] + backward[k][1] - whole)
                    for f in blocks[k]:
                        slope[f] += off
                    if k:
                        for a in (0, 1):
                            for b in (0, 1):
                                slope[(a, b)] += ((labels[k - 1], labels[k]) == (a, b)) - exp(forward[k - 1][a] + m[a][b] + b * e[k] + backward[k][b] - whole)
                for f, g in slope.items():
                    squares[f] += g * g
                    step = rate * g / (squares[f] ** 0.5 + 1e-6)
                    if isinstance(f, tuple):
                        m[f[0]][f[1]] += step
                    else:
                        self.weights[f] = 0.9998 * self.weights.get(f, 0.0) + step
        return self

    def decode(self, blocks: list[tuple[str, ...]]) -> list[int]:
        """The likeliest labels of a page, by Viterbi."""
        if not blocks:
            return []
        m, best, back = self.moves, [0.0, self.energy(blocks[0])], []
        for block in blocks[1:]:
            e, fresh, from_ = self.energy(block), [], []
            for s in (0, 1):
                a, b = best[0] + m[0][s], best[1] + m[1][s]
                fresh.append(max(a, b) + s * e)
                from_.append(int(b > a))
            best = fresh
            back.append(from_)
        out = [int(best[1] > best[0])]
        for from_ in reversed(back):
            out.append(from_[out[-1]])
        return out[::-1]


@cache
def trained_field() -> ChainField:
    return ChainField().fit(labelled_pages(TRAINING_PAGES, seed=5), EPOCHS, RATE)


def main_text(field: ChainField, page: str | None) -> str:
    blocks = leaf_blocks(page or "", field.vocabulary)
    return "\n".join(b[0] for b, y in zip(blocks, field.decode([features(*b) for b in blocks]), strict=True) if y)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page. No shuffle.

    Null or empty pages, and pages without a main block, have an empty text. Null ids and
    urls stay null; repeated rows get equal results. Equal scores fall to "other". Broken
    markup is read as far as tags can be told. Pages of any length and depth are read whole, in time
    that goes with their length. Other columns are not read. Empty input gives
    no rows.
    """
    field = trained_field()

    def run(batches):
        for batch in batches:
            texts = [main_text(field, p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
