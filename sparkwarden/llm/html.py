"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwarden.llm.common import texts_of

#: Pages that training takes from the table, in expectation, and their largest size in characters.
SAMPLE, SAMPLE_CHARS = 400, 50_000

#: Blocks of a training page at most; longer ones are left out of training.
LONGEST = 60

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+)|<",
    re.S,
)
_TAG = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul option select legend caption search".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg head object canvas".split())
#: What an opening tag closes, if it is the innermost open block of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block:
    __slots__ = ("above", "tag", "text", "linked")

    def __init__(self, above: frozenset, tag: str, text: str, linked: int):
        self.above, self.tag, self.text, self.linked = above, tag, text, linked


def _marks(tag: str, attributes: str) -> frozenset[str]:
    """Features that an element gives to all blocks inside it."""
    out = {"in:" + tag}
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("hidden", "aria-hidden"):
                out.add("hidden" if (a or b or c).lower() != "false" else "shown")
            for word in _WORD.findall((a or b or c).lower()):
                out.add("as:" + word)
    return frozenset(out)


class Ends:
    """Whether a tag whose name ends at a place has an end, for all places of a page by one pass from its end.

    Only needed from the first tag without end on: trying each such tag anew would read the rest of the page each time.
    """

    def __init__(self, page: str):
        self.at = [m.start() for m in re.finditer("[>\"']", page)]
        ends = [False] * (len(self.at) + 1)
        later = {"\"": len(self.at), "'": len(self.at)}
        for k in range(len(self.at) - 1, -1, -1):
            c = page[self.at[k]]
            if c == ">":
                ends[k] = True
            else:
                # Right after the quote's other end the tag goes on.
                ends[k], later[c] = later[c] < len(self.at) and ends[later[c] + 1], k
        self.ends = ends

    def after(self, place: int) -> bool:
        return self.ends[bisect_left(self.at, place)]


def blocks(page: str, known: dict[str, int] | None = None, memo: dict | None = None) -> Iterator[Block]:
    """Leaf blocks of a page in order: their text with white space made single, and the features of what they are in.

    Reads any text: unclosed, unopened and misnested tags, unfinished comments. ``known`` leaves out features that a
    model doesn't have, which also bounds the work at great depth.
    """
    memo = {} if memo is None else memo
    stack: list[tuple[str, frozenset]] = []
    above: frozenset = frozenset()
    tag, parts, linked, in_link, at = "", [], 0, 0, 0
    size = len(page)
    ends: Ends | None = None
    unended: set[str] = set()
    opened: Counter = Counter()

    def done() -> Block | None:
        nonlocal parts, linked
        if not parts:
            return None
        text = " ".join(entities.unescape("".join(parts)).split())
        block = Block(above, tag, text, linked) if text else None
        parts, linked = [], 0
        return block

    while at < size:
        if ends is not None and page[at] == "<":
            tag_at = _TAG.match(page, at)
            if tag_at is not None and not ends.after(tag_at.end()):
                parts.append("<")
                at += 1
                continue
        m = _TOKEN.match(page, at)
        at = m.end()
        text, name = m[4], m[2]
        if text is not None:
            parts.append(text)
            linked += len(text) * (in_link > 0)
            continue
        if name is None:
            if m[0] == "<":
                parts.append("<")
                if ends is None and _TAG.match(page, at - 1) is not None:
                    ends = Ends(page)
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
            continue
        if name in _RAW:
            if not m[1] and not m[3].endswith("/") and name not in unended:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else (at if name == "head" else size)
                if end is None:
                    unended.add(name)
            continue
        if name not in _BLOCK:
            continue
        block = done()
        if block is not None:
            yield block
        in_link = 0
        if m[1]:
            while opened[name]:
                gone = stack.pop()[0]
                opened[gone] -= 1
                if gone == name:
                    break
        elif name not in _VOID:
            if stack and (stack[-1][0] == "p" or stack[-1][0] in _CLOSES.get(name, ())):
                opened[stack.pop()[0]] -= 1
                if name == "tr" and stack and stack[-1][0] == "tr":
                    opened[stack.pop()[0]] -= 1
            outer = stack[-1][1] if stack else frozenset()
            key = (outer, name, m[3])
            inner = memo.get(key)
            if inner is None:
                new = _marks(name, m[3])
                inner = outer | (new if known is None else new.intersection(known))
                if len(memo) > 20_000:
                    memo.clear()
                memo[key] = inner
            stack.append((name, inner))
            opened[name] += 1
        tag, above = stack[-1] if stack else ("", frozenset())
    block = done()
    if block is not None:
        yield block


_LENGTHS = (3, 6, 11, 21, 51, 101)


def features(block: Block, place: int, last: int) -> list[str]:
    """Features of a block's own tag, text and place; what it is in comes from ``above``."""
    text, out = block.text, ["tag:" + block.tag]
    n = text.count(" ") + 1
    out.append(f"words:{sum(n >= x for x in _LENGTHS)}")
    share = block.linked / max(1, len(text))
    out.append(f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
    out.append("end:" + ("stop" if text[-1] in ".!?…。\"”»" else "other"))
    if text[0].isupper():
        out.append("upper")
    if "©" in text:
        out.append("copyright")
    if place == 0:
        out.append("first")
    if place == last:
        out.append("last")
    if n <= 12:
        out += {"w:" + w for w in _WORD.findall(text.lower())}
    return out


class Chain:
    """Two labels, main text (1) or not (0): weights of features for label 1, and of label pairs."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.known, self.pairs = known, pairs.tolist()
        self.weight = {f: float(weights[i]) for f, i in known.items()}

    def labels(self, scores: list[float]) -> list[int]:
        """Viterbi: the labels of greatest total weight."""
        if not scores:
            return []
        (aa, ab), (ba, bb) = self.pairs
        off, on, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_off, from_on = off + ab, on + bb
            stay, fall = off + aa, on + ba
            back.append((fall > stay, from_on >= from_off))
            off, on = max(stay, fall), s + max(from_off, from_on)
        at = int(on >= off)
        out = [at]
        for step in reversed(back):
            at = int(step[at])
            out.append(at)
        return out[::-1]

    def text(self, page: str, memo: dict) -> str:
        found = list(blocks(page, self.known, memo.setdefault("above", {})))
        sums, weight = memo.setdefault("sums", {}), self.weight
        scores = []
        for i, b in enumerate(found):
            score = sums.get(b.above)
            if score is None:
                if len(sums) > 20_000:
                    sums.clear()
                score = sums[b.above] = weight["bias"] + sum(weight[f] for f in b.above)
            scores.append(score + sum(weight.get(f, 0.0) for f in features(b, i, len(found) - 1)))
        return "\n".join(b.text for b, y in zip(found, self.labels(scores)) if y)


# Labelled pages ------------------------------------------------------------------------------------------------------

#: What is not main text, by the marks around it.
_OFF = frozenset(
    "in:nav in:header in:footer in:aside in:form in:menu in:dialog in:select hidden as:ad as:ads as:advert as:promo as:nav "
    "as:menu as:sidebar as:footer as:header as:cookie as:notice as:banner as:comments as:comment as:share as:related".split()
)
#: Marks of things beside the text, as templates write them: (element, class or id words, whether it lists links).
_BESIDE = {
    "nav": (("nav", "", True), ("div", "nav", True), ("ul", "menu", True), ("div", "navbar navigation", True), ("div", "breadcrumb breadcrumbs", True), ("div", "topbar", True), ("menu", "", True)),
    "header": (("header", "", False), ("div", "header", False), ("div", "site-header masthead", False), ("div", "logo branding", False)),
    "footer": (("footer", "", False), ("div", "footer", False), ("div", "site-footer", False), ("div", "copyright legal", False)),
    "aside": (("aside", "", False), ("div", "sidebar", False), ("div", "widget related", True), ("section", "related recommended", True), ("div", "side rail", False), ("aside", "sidebar", True)),
    "notice": (("div", "cookie notice", False), ("div", "banner consent", False), ("div", "popup modal newsletter", False), ("div", "alert notice", False), ("dialog", "", False), ("div", "gdpr privacy", False)),
    "advert": (("div", "ad", False), ("div", "ads advert", False), ("div", "promo sponsored", False), ("section", "advertisement", False), ("div", "banner-ad adsense", False), ("ins", "", False)),
    "form": (("form", "", False), ("form", "search", False), ("form", "subscribe newsletter", False), ("fieldset", "login", False)),
    "comments": (("section", "comments", False), ("div", "comments", False), ("ol", "comment-list", False), ("div", "disqus thread", False), ("div", "replies discussion", False), ("section", "reader-comments responses", False)),
    "share": (("div", "share social", True), ("ul", "tags", True), ("div", "meta byline", False), ("div", "author bio", False)),
}
_MAIN = (
    ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post entry"),
    ("section", "story text"), ("div", "main"), ("div", ""), ("td", "content"), ("div", "entry-content"),
)
_SAID = {
    "nav": "Home|News|About us|Contact|Archive|Sport|Politics|Start|Impressum|Kontakt|Accueil|Inicio|Next|Previous",
    "header": "The Daily Page|Welcome to our site|Your source for news|Site name",
    "footer": "© 2024 All rights reserved.|Copyright Example Ltd|Terms of use · Privacy|Powered by Example|Imprint and contact",
    "aside": "Most read|Related stories|You may also like|Popular this week|Latest posts|Tags",
    "notice": "We use cookies to improve your experience.|Accept all cookies|This site uses cookies. Learn more.|Sign up to our newsletter|Please disable your ad blocker.",
    "advert": "Advertisement|Sponsored content|Buy now and save 50%|Limited offer, order today!|Click here",
    "form": "Search|Subscribe|Your email|Password|Log in|Submit|Send",
    "comments": "Leave a comment|Great post, thanks!|Reply|I totally agree with this.|anonymous wrote:|3 comments|Log in to reply",
    "share": "Share on social media|Tweet|Email this|By the editors|Posted on May 5|Filed under news",
}


def _labelled(lines: list[str], draw: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page from a drawn template around given lines, with the label of every block."""
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    out: list[tuple[str, int]] = []

    def beside(kind: str) -> str:
        tag, words, links = pick(_BESIDE[kind])
        said = _SAID[kind].split("|")
        items = [pick(said) for _ in range(int(draw.integers(1, 5)))]
        if draw.random() < 0.6:  # any text may stand there, also that of other pages
            items = [pick(lines)[: int(draw.integers(10, 400))] for _ in items] if draw.random() < 0.7 else items + [pick(lines)[:200]]
        attribute = f' {pick(("class", "id"))}="{words}"' if words and draw.random() < 0.93 else ""
        if links or draw.random() < 0.15:
            inner = "<ul>" + "".join(f'<li><a href="/x">{_safe(" ".join(i.split()[:3]) or "x")}</a></li>' for i in items) + "</ul>"
        else:
            form = pick(("p", "div", "plain", "li", "h3"))
            inner = "".join(f"<{form}>{_safe(i)}</{form}>" if form != "plain" else _safe(i) + " " for i in items)
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def maybe(kind: str, share: float) -> None:
        if draw.random() < share:
            out.append((beside(kind), 0))

    tag, words = pick(_MAIN)
    maybe("notice", 0.3)
    maybe("header", 0.5)
    maybe("nav", 0.8)
    maybe("advert", 0.5)
    maybe("aside", 0.25)
    wrap = draw.random() < 0.3
    opened = '<div class="wrapper page">' * wrap + f'<{tag}{" class=" + chr(34) + words + chr(34) if words else ""}>'
    out.append((opened, 0))
    text = [pick(lines) for _ in range(int(draw.integers(1, 12)))]
    if draw.random() < 0.8:
        out.append((f"<{pick(('h1', 'h1', 'h2'))}>{_safe(pick(lines)[:60])}</h1>", 1))
    inside = draw.random()
    for i, line in enumerate(text):
        form = pick(("p", "p", "p", "p", "pb", "li", "blockquote", "h2", "div"))
        if form == "h2":
            line = line[:40]
        cut = int(draw.integers(1, 60)) if draw.random() < 0.1 else len(line)
        line = _safe(line[:cut])
        if draw.random() < 0.15:
            line = f'<a href="/y">{line[:12]}</a>{line[12:]}' if "&" not in line else line
        out.append((f"<p><b>{line}<br>" if form == "pb" else f"<{form}>{line}</{form}>", 1))
        if inside < 0.35 and draw.random() < 0.15:
            out.append((beside(pick(("advert", "share", "aside", "form", "notice"))), 0))
    if draw.random() < 0.2:
        out.append((beside("share"), 0))
    if draw.random() < 0.25:
        out.append((beside("comments"), 0))
    out.append((f"</{tag}>", 0))
    maybe("comments", 0.3)
    maybe("aside", 0.4)
    maybe("advert", 0.25)
    maybe("form", 0.35)
    out.append(("</div>" * wrap, 0))
    maybe("footer", 0.85)
    # The label of a block is that of the part in which its text begins.
    page = '<!DOCTYPE html><html><head><title>t</title></head><body>' + "".join(f"{p}\x01" if y else f"{p}\x02" for p, y in out)
    return _with_labels(page)


def _safe(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("\x01", "").replace("\x02", "")


def _with_labels(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a page whose parts end in \\x01 (main text) or \\x02, and their labels."""
    found, labels, waiting = [], [], []
    # A mark may open the next block's text, so that blocks wait for the mark that follows them.
    for b in blocks(page):
        for piece in re.split("([\x01\x02])", b.text):
            if piece in ("\x01", "\x02"):
                labels += [int(piece == "\x01")] * len(waiting)
                found += waiting
                waiting = []
            elif piece.strip():
                waiting.append(Block(b.above, b.tag, piece.strip(), min(b.linked, len(piece))))
    return found, labels


def _weak(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page whose main text is marked up as such, else None."""
    found = list(blocks(page))
    main = [("in:article" in b.above or "in:main" in b.above) and not (_OFF & b.above) for b in found]
    return (found, [int(y) for y in main]) if any(main) and not all(main) else None


#: Lines for templates where the table has none.
_LINES = (
    "The council met on Tuesday to discuss the plan for the new bridge, and voted for it.", "A short line.",
    "Nobody had expected the river to rise so quickly, said one of the people who live nearby. It took two hours.",
    "What happens next is not clear", "In the morning the market opens early and closes when everything has been sold.",
)


def train(pages: list[str], drawn: int = 900, rounds: int = 80, seed: int = 5) -> Chain:
    """A chain from ``drawn`` template pages around lines of the given pages, and from given pages with marked main text.

    Maximises the conditional likelihood of the labels, less a quadratic penalty, by Adam on all pages at once.
    """
    draw = np.random.default_rng(seed)
    weak = [w for w in map(_weak, pages) if w]
    lines = [b.text for found, ys in weak for b, y in zip(found, ys) if y][:20_000] or list(_LINES)
    data = weak + [_labelled(lines, draw) for _ in range(drawn)]
    data = [(f, y) for f, y in data if 0 < len(f) <= LONGEST]
    named = [[["bias", *b.above, *features(b, i, len(f) - 1)] for i, b in enumerate(f)] for f, _ in data]
    count = Counter(x for page in named for block in page for x in set(block))
    known = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 6 or f == "bias"))}
    longest = max(map(len, named))
    n = len(data)
    cells, columns = [], []
    gold = np.zeros((n, longest), np.int8)
    real = np.zeros((n, longest), bool)
    for p, page in enumerate(named):
        for t, block in enumerate(page):
            ids = [known[f] for f in dict.fromkeys(block) if f in known]
            cells += [p * longest + t] * len(ids)
            columns += ids
            gold[p, t], real[p, t] = data[p][1][t], True
    cells, columns = np.array(cells), np.array(columns)
    # Each round hides some features, so that marks, text and neighbours all carry weight.
    x, pairs = np.zeros(len(known)), np.zeros((2, 2))
    state = [np.zeros(len(known) + 4) for _ in range(2)]
    both = real[:, 1:]
    wanted = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, rounds + 1):
        kept = draw.random(len(cells)) > 0.1
        on = np.bincount(cells[kept], x[columns[kept]], minlength=n * longest).reshape(n, longest)
        emit = np.stack([np.zeros_like(on), on], 2)
        # Forward and backward sums of all pages side by side; past a page's end nothing changes.
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(pairs + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], new, backward[:, t + 1])
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
        edge = forward[:, :-1, :, None] + pairs + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        expected = np.where(both[:, :, None, None], np.exp(np.minimum(edge, 0)), 0).sum((0, 1))
        error = np.where(real, gold - chance, 0).ravel()
        slope = np.r_[
            np.bincount(columns[kept], error[cells[kept]], minlength=len(known)) - 1.0 * x, (wanted - expected).ravel() - pairs.ravel()
        ]
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        move = 0.2 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        x += move[:-4]
        pairs += move[-4:].reshape(2, 2)
    return Chain(known, x, pairs)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html") -> Chain:
    """Trains on about ``SAMPLE`` pages of at most ``SAMPLE_CHARS`` characters, drawn evenly by a hash of key and page."""
    size = F.length(pages[html])
    known = pages.where((size > 0) & (size <= SAMPLE_CHARS)).select(F.xxhash64(pages[key], pages[html]).alias("h"), pages[html].alias("html"))
    total = known.count()
    share = min(1.0, SAMPLE / total) if total else 0.0
    drawn = known.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).distinct().limit(2 * SAMPLE)
    return train([r.html for r in sorted(drawn.collect(), key=lambda r: (r.h, r.html))])


def main_text(pages: DataFrame, chain: Chain, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page: its main blocks in order, joined by one line feed.

    Null and empty pages, and pages without main text, have the empty text. Rows are independent: repeated rows and
    further columns change nothing. Pages are read whole, and in time proportional to their length.
    """

    def run(batches):
        memo: dict = {}
        for b in batches:
            texts = [chain.text(p, memo) if p else "" for _, part in texts_of(b.column(2)) for p in part]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["key", "url", "text", "n_chars"],
            )

    picked = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
