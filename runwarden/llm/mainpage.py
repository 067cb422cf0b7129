"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is the text between two borders of block elements. Its features are the tags and class words of
its ancestors, the innermost of them that tells something, and the shape of its text. Two labels (main text or
not) with one transition table; trained on labelled pages that are laid out here in many ways, decoded by
Viterbi. Nothing depends on the language of a page.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.tables import slices

# Elements of HTML.
_BLOCK = frozenset(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
# what may stand in a head; anything else ends it, as any text does
_HEAD = frozenset("html head title base basefont bgsound link meta noframes script style noscript template".split())
# elements of HTML that end an open svg, and elements of svg that may hold HTML
_ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_SVG_HTML = frozenset("foreignobject desc title".split())
_HOLDERS = frozenset("ul ol dl table tbody thead tfoot tr select menu".split())
_CHOICES = frozenset("select optgroup option datalist".split())
_TOKEN = re.compile(
    # a comment also ends at <!--> and <!--->, and at --!>
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|noscript|template|iframe|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?[a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*>"
    r"|([^<]+|<)",
    re.S | re.I,
)
_OPENING = re.compile(r"<(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_TITLE_END = re.compile(r"</title\s*>", re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Class words in the labelled pages, by the part of a page that they mark.
_PARTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "header": "header masthead topbar branding logo",
    "footer": "footer copyright legal colophon bottom imprint",
    "sidebar": "sidebar aside widget widgets related recommended trending popular teaser tags archive complementary",
    "notice": "notice cookie cookies consent banner alert gdpr privacy popup modal overlay message paywall",
    "advert": "ad ads advert adverts advertisement promo promotion sponsor sponsored adsense commercial",
    "form": "form search login signup newsletter subscribe contact",
    "comments": "comment comments commentlist disqus discussion reply replies respond responses",
    "share": "share sharing social follow",
}
_CONTENT = "content post entry story body text main article page prose single"
_TAG_PARTS = ("nav", "header", "footer", "aside", "form", "article", "main", "dialog", "menu", "search")
_TELLING = frozenset(" ".join(_PARTS.values()).split()) | frozenset(_CONTENT.split()) | frozenset(_TAG_PARTS)

MAIN, OTHER = 1, 0
_MARK = "\ue000"


@dataclass
class Block:
    """One leaf block: its text, its ancestors' tags and class words from the outermost, its linked characters."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def _class_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for m in _NAMED.finditer(attributes):
        found += [w.lower() for w in _WORD.findall(m[1] or m[2] or m[3] or "")]
    return tuple(w for w in dict.fromkeys(found) if w in _TELLING)


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order; scripts, styles, comments, drawings and the head give none."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0
    in_head, title_ends = False, True
    # open svg elements, and how many elements with HTML are open inside them
    svg = svg_html = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    def close(tags: tuple[str, ...], within: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    tokens = _TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        text = m[4]
        if text is not None:
            if svg or (in_head and not text.strip()):
                continue
            # what a list offers to choose from is a form's
            if stack and stack[-1][0] in _CHOICES:
                continue
            in_head = False
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if m[2] is None:
            # in a drawing, a script or style may be closed by its own tag
            if svg and m[1] and (opening := _OPENING.match(page, m.start()))[0].endswith("/>"):
                tokens = _TOKEN.finditer(page, opening.end())
            continue
        tag = m[2].lower()
        if svg:
            name, closing, empty = tag.lstrip("/"), tag[0] == "/", m[3].endswith("/")
            if name == "svg":
                svg += -1 if closing else 0 if empty else 1
                svg_html = svg_html if svg else 0
                continue
            if name in _SVG_HTML:
                svg_html = max(0, svg_html - 1) if closing else svg_html if empty else svg_html + 1
                continue
            if svg_html or not (any(name == x for x, _ in stack) if closing else name in _ENDS_SVG):
                continue
            svg = 0
        if in_head:
            if tag == "title":
                end = _TITLE_END.search(page, m.end()) if title_ends else None
                title_ends = end is not None
                # a title that is left open ends with the text up to the next tag
                after = page.find("<", m.end())
                tokens = _TOKEN.finditer(page, end.end() if end else after if after >= 0 else len(page))
                continue
            if tag == "/head":
                in_head = False
                continue
            if tag in _HEAD or (tag[0] == "/" and tag not in ("/body", "/html")):
                continue
            in_head = False
        if tag == "head":
            close_block()
            in_head = True
            continue
        if tag == "svg":
            svg = 0 if m[3].endswith("/") else 1
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag == "/a":
            links = max(0, links - 1)
        elif tag[0] == "/":
            if tag[1:] in _BLOCK:
                close_block()
                close((tag[1:],), frozenset())
        elif tag in _BLOCK:
            close_block()
            # an open paragraph ends where any block starts
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _CLOSED_BY:
                close(_CLOSED_BY[tag], _HOLDERS - {"tr"} if tag in ("td", "th", "tr") else _HOLDERS)
            if tag not in _VOID:
                stack.append((tag, _class_words(m[3])))
    close_block()
    return found


@lru_cache(maxsize=4096)
def _path_features(path: tuple) -> tuple[str, ...]:
    names: list[str] = []
    for tag, words in path:
        names += [tag, *words] if tag in _TELLING else words
    inner = names[-1] if names else "none"
    tag = path[-1][0] if path else "none"
    known = [f"any:{x}" for x in dict.fromkeys(names)]
    return ("bias", f"inner:{inner}", f"tag:{tag}", f"tag+inner:{tag}+{inner}", *known)


def _text_features(block: Block) -> tuple[str, ...]:
    text = block.text
    words = text.count(" ") + 1
    size = 0 if words <= 2 else 1 if words <= 6 else 2 if words <= 15 else 3 if words <= 40 else 4
    share = 3 * block.linked // max(1, len(text))
    return (
        f"words:{size}",
        f"links:{min(share, 3)}",
        f"ends:{text[-1] in '.!?…:;”»'}",
        f"sign:{'©' in text}",
        f"words+links:{size}+{min(share, 3)}",
    )


def features(block: Block) -> tuple[str, ...]:
    return _path_features(block.path) + _text_features(block)


@dataclass(frozen=True)
class Chain:
    """Weight of each feature for main text (against other), and transition weights [from][to]."""

    weights: dict[str, float]
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest label sequence, by Viterbi."""
        if not found:
            return []
        weight = self.weights.get
        (t00, t01), (t10, t11) = self.transitions
        best0 = best1 = 0.0
        back: list[tuple[int, int]] = []
        for i, block in enumerate(found):
            score = sum(weight(f, 0.0) for f in features(block))
            if i:
                from0 = 0 if best0 + t00 >= best1 + t10 else 1
                from1 = 0 if best0 + t01 > best1 + t11 else 1
                back.append((from0, from1))
                best0, best1 = max(best0 + t00, best1 + t10), max(best0 + t01, best1 + t11)
            best1 += score
        labels = [1 if best1 > best0 else 0]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit(pages: list[list[tuple[tuple[str, ...], int]]], rounds: int = 250, l2: float = 2e-3) -> Chain:
    """Weights of least penalised negative log likelihood; pages are lists of (features, label)."""
    names = sorted({f for page in pages for fs, _ in page for f in fs})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(map(len, pages))
    gold, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    rows, columns = [], []
    for i, page in enumerate(pages):
        for k, (fs, label) in enumerate(page):
            gold[i, k], there[i, k] = label, True
            rows += [i * longest + k] * len(fs)
            columns += [number[f] for f in fs]
    rows, columns = np.array(rows), np.array(columns)
    at = np.arange(n)
    last = there.sum(1) - 1
    theta = np.zeros(len(names) + 4)
    first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[..., 1] = np.bincount(rows, weights[columns], minlength=n * longest).reshape(n, longest)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for k in range(1, longest):
            forward[:, k] = emit[:, k] + np.logaddexp(
                forward[:, k - 1, :1] + moves[0], forward[:, k - 1, 1:] + moves[1]
            )
        for k in range(longest - 2, -1, -1):
            after = (emit[:, k + 1] + backward[:, k + 1])[:, None, :] + moves
            backward[:, k] = np.where(there[:, k + 1, None], np.logaddexp(after[..., 0], after[..., 1]), 0.0)
        total = np.logaddexp(*forward[at, last].T)
        single = np.where(there, np.exp(np.minimum(forward[..., 1] + backward[..., 1] - total[:, None], 0)), 0.0)
        pair = np.exp(
            np.minimum(
                forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None], 0
            )
        )
        pair = np.where(there[:, 1:, None, None], pair, 0.0).sum((0, 1))
        wanted = np.zeros((2, 2))
        np.add.at(wanted, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
        residual = (single - gold * there).ravel()
        slope = np.concatenate(
            (np.bincount(columns, residual[rows], minlength=len(names)), (pair - wanted).ravel())
        ) / n + l2 * theta
        first_moment = 0.9 * first_moment + 0.1 * slope
        second_moment = 0.99 * second_moment + 0.01 * slope**2
        theta -= 0.1 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-9)
    moves = theta[-4:].reshape(2, 2).tolist()
    return Chain(dict(zip(names, theta[:-4].tolist(), strict=True)), (tuple(moves[0]), tuple(moves[1])))


class _Author:
    """Lays out labelled pages: a list of (html of one block, label) inside containers."""

    def __init__(self, seed: int) -> None:
        self.pick = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        pick = self.pick
        n = pick.randint(low, high)
        return " ".join("".join(pick.choice("abdeghilmnorstu") for _ in range(pick.randint(1, 9))) for _ in range(n))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.pick.choice([".", ".", ".", "!", "?", ""])

    def wrapped(self, tag: str, inner: str, names: str = "") -> str:
        label = f' {self.pick.choice(["class", "id"])}="{names}"' if names else ""
        return f"<{tag}{label}>{inner}</{tag}>"

    def other(self, part: str) -> str:
        """One part that is not main text."""
        pick = self.pick
        link = lambda low=1, high=4: f'<a href="/x">{self.words(low, high)}</a>'
        if part in ("menu", "share"):
            inner = self.wrapped("ul", "".join(f"<li>{link()}</li>" for _ in range(pick.randint(2, 9))))
        elif part == "footer":
            inner = pick.choice(["&copy; ", "", "<p>"]) + self.sentence(3, 30) + pick.choice(["", link(), "<br>" + link()])
        elif part == "sidebar":
            inner = f"<h3>{self.words(1, 4)}</h3>" + "".join(
                pick.choice([f"<li>{link(2, 9)}</li>", f"<p>{self.sentence(4, 30)}</p>"]) for _ in range(pick.randint(1, 5))
            )
        elif part == "comments":
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(
                f"<{t}>{self.sentence(2, 60)}</{t}>" for t in pick.choices(["p", "li", "div"], k=pick.randint(1, 5))
            )
        elif part == "form":
            inner = f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>" + pick.choice(
                ["", f"<p>{self.sentence(3, 20)}</p>"]
            )
        else:
            inner = pick.choice([self.sentence(2, 40), f"<p>{self.sentence(2, 40)}</p>", f"<p>{self.sentence(2, 25)}{link()}</p>"])
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(part)
        named = pick.choice(_PARTS[part].split())
        if tag and pick.random() < 0.5:
            return self.wrapped(tag, inner, pick.choice(["", named]))
        return self.wrapped(pick.choice(["div", "section", "div"]), inner, named)

    def page(self) -> list[tuple[str, int]]:
        """(html, label) pieces; joined they are the page."""
        pick = self.pick
        parts = list(_PARTS)
        out: list[tuple[str, int]] = [("<html><body>", OTHER)]
        out += [(self.other(p), OTHER) for p in pick.choices(["menu", "header", "notice", "advert", "form", "share"], k=pick.randint(0, 4))]
        # where there is no main mark at all, long plain text is the article
        shell = pick.choice([("article", ""), ("article", ""), ("main", ""), ("div", pick.choice(_CONTENT.split())), ("div", "")])
        label = f' class="{shell[1]}"' if shell[1] else ""
        bare = shell == ("div", "")
        out.append((f"<{shell[0]}{label}>", OTHER))
        head = f"<h1>{self.words(1, 12)}</h1>"
        out.append((f"<header>{head}</header>" if pick.random() < 0.1 and not bare else head, MAIN))
        for _ in range(pick.randint(1, 9)):
            if pick.random() < 0.12:
                inside = pick.choice(["comments", "advert", "share", "sidebar", "form", "notice"])
                out.append((self.other(inside), OTHER))
            low, high = pick.choice([(1, 6), (5, 30), (20, 120)]) if not bare else (12, 120)
            link = pick.choice(["", "", f' <a href="/y">{self.words(1, 5)}</a>.'])
            tag = pick.choice(["p"] * 6 + ["h2", "blockquote", "li", "pre", "td"]) if not bare else "p"
            body = f"<{tag}>{self.sentence(low, high)}{link}"
            body += "" if tag == "p" and pick.random() < 0.2 else f"</{tag}>"
            body = {"li": f"<ul>{body}</ul>", "td": f"<table><tr>{body}</tr></table>"}.get(tag, body)
            out.append((body, MAIN))
        if pick.random() < 0.2:
            out.append((self.other("comments"), OTHER))
        out.append((f"</{shell[0]}>", OTHER))
        out += [(self.other(p), OTHER) for p in pick.choices(parts, k=pick.randint(0, 4))]
        return [*out, ("</body></html>", OTHER)]


def labelled_pages(n: int, seed: int = 7) -> list[list[tuple[Block, int]]]:
    """Pages with the right label of each block: those inside a piece of main text are main."""
    author, pages = _Author(seed), []
    for _ in range(n):
        pieces = author.page()
        # a block's label follows from a mark in the piece's text
        marked = "".join(re.sub(r">(?=[^<])", f">{_MARK}", piece) if label else piece for piece, label in pieces)
        page = []
        for block in blocks(marked):
            main = _MARK in block.text
            page.append((Block(block.text.replace(_MARK, ""), block.path, block.linked), MAIN if main else OTHER))
        if page:
            pages.append(page)
    return pages


TRAINING_PAGES = 600


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The chain fitted on the labelled pages; the same on every run."""
    return fit([[(features(b), label) for b, label in page] for page in labelled_pages(TRAINING_PAGES)])


def extract(page: str, chain: Chain) -> str:
    """Main blocks in page order, joined by one space."""
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, chain.decode(found), strict=True) if label == MAIN)


def main_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Columns page_id, url, text, n_chars: one row per page, nothing shuffled; a null html gives an empty text."""
    chain = chain or trained()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = [extract(page or "", chain) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
