"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; the weights are log odds of
being inside an article, counted over a bounded sample of labelled pages, which are those that mark their article
themselves (an article or main element). Words of navigation, forms, adverts, comments and the like score
negative. One linear scan finds the contiguous region with the best sum; where most of its words stand in a marked
article it is extended to the whole of that. Its live blocks are the text.

Edge cases: a null or empty page, or one without words, gives an empty text; unclosed elements end where an outer
one ends; a tag that the page's end cuts counts as text; repeated pages give a row each; other columns are ignored. A class such as
"has-sidebar" on a page's frame says nothing of its content: html, body, main and an outermost article heed no hints,
nor does an element that holds most of the page's words, unless an article stands outside it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.common import hash_below, map_arrow, read

#: Labelled pages that the weights are counted over, in expectation.
SAMPLE = 2000
#: Attributes as a browser takes them: quotes count after an equals sign only, and one that is not closed ends with the tag.
#: Nothing is taken back once it is read, so that a page is read once.
ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>"'][^\s>]*+|(?=>)))?+|=)*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|[^<]++|<", re.S)
OPENS = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is no markup, that are blocks, that have no end, that hold no article text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DEAD = RAW | {"nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "menu", "dialog", "svg", "math", "canvas", "object", "audio", "video", "map", "head"}
#: Words of class, id and role that mark what is not the article.
HINT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "side", "aside", "complementary", "header", "masthead", "footer", "contentinfo", "comment", "comments", "reply", "replies", "discussion", "disqus",
    "respond", "share", "sharing", "social", "related", "recommended", "cookie", "cookies", "consent", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "signup", "login", "search", "form", "widget", "widgets", "pagination", "pager", "skip", "toolbar", "copyright", "legal", "disclaimer",
}
MARKED = ("article", "main")
FRAME = {"html", "body", "main"}
#: The end of an element whose content is no markup; names are ASCII, whatever the page holds.
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}

#: Characters of a name that gets a weight of its own; longer ones are made up, and count as any other.
LONGEST = 100
#: Weights where the labelled pages say nothing, and bounds.
WORD, OUTSIDE, TAG, BLOCK_TAG, LEAST_TAG, MOST = 1.0, -0.3, -0.2, -0.5, -0.01, 4.0


def hinted(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        if HINT & set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


Token = tuple[str, str, bool, bool, str]


def mostly_words(out: list[Token], killed: dict[int, int]) -> frozenset[int]:
    """Those of the killed elements, given by first token and end, with most of the words and no article outside."""
    words = list(accumulate((len(t[1].split()) for t in out), initial=0))
    marked = [i for i, t in enumerate(out) if t[4]]
    return frozenset(a for a, b in killed.items() if 2 * (words[b] - words[a]) > words[-1] and not (marked and (marked[0] < a or marked[-1] >= b)))


def tokens(page: str, spared: frozenset[int] = frozenset()) -> list[Token]:
    """(feature, text, starts a block, live, mark) in page order.

    A tag's feature is its name, a text's is "w:" and the element it stands in; the text is empty for tags. mark
    names the article-like element that stands around it, or nothing. A page where a hint kills an element with most
    of the words is read again; spared are the first tokens of such elements."""
    out: list[Token] = []
    # name, live, mark, whether a hint kills it or what is around it, and its first token if its own hint does
    stack: list[tuple[str, bool, str, bool, int]] = [("", True, "", False, -1)]
    killed: dict[int, int] = {}

    def leave(i: int) -> None:
        killed.update((e[4], len(out)) for e in stack[i:] if e[4] >= 0)
        del stack[i:]

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        whole = m[0]
        if whole == "<" and OPENS.match(page, at - 1):
            # a tag that is still open where the page ends; all that is left is its text
            whole, at = page[at - 1 :], len(page)
        if m[2] is None:
            if whole[:2] not in ("<!", "<?"):
                name, live, mark = stack[-1][:3]
                out.append((f"w:{name}", html.unescape(whole), False, live, mark))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            out.append((f"/{name}", "", name in BLOCK, False, stack[-1][2]))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
            continue
        if name == "p" and stack[-1][0] == "p":
            leave(len(stack) - 1)
        outer = stack[-1]
        marks = name in MARKED
        heeds = name not in FRAME and (name != "article" or outer[2] or outer[3])
        kills = bool(heeds) and len(out) not in spared and hinted(m[3])
        live = (outer[1] or marks) and name not in DEAD and not kills
        out.append((name, "", name in BLOCK or name == "br", live, outer[2]))
        if name in RAW:
            end = RAW_END[name].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif name not in VOID and not m[3].endswith("/"):
            stack.append((name, live, f"{name} {len(out)}" if marks and live else outer[2], outer[3] or kills, len(out) - 1 if kills else -1))
    leave(1)
    more = mostly_words(out, killed) if killed else None
    return tokens(page, spared | more) if more else out


def count(page: str | None) -> Counter | None:
    """(feature, inside) counts of a labelled page; None if it marks no article."""
    got = tokens(page or "")
    if not any(t[4] for t in got):
        return None
    out: Counter = Counter()
    for feature, text, _, live, mark in got:
        out[feature, bool(mark) and (live or not feature.startswith("w:"))] += len(text.split()) if feature.startswith("w:") else 1
    return out


def train(pages: DataFrame, size: int = SAMPLE) -> dict[str, float]:
    """Weight of each feature, from about size pages chosen by a hash of page_id."""
    n = pages.count()

    def run(cols: dict[str, list]) -> dict[str, list]:
        total: Counter = Counter()
        for page in cols["html"]:
            total.update(count(page) or {})
        known = [k for k in total if len(k[0]) <= LONGEST]
        return {"feature": [k[0] for k in known], "inside": [k[1] for k in known], "n": [total[k] for k in known]}

    chosen = pages.where(hash_below(F.xxhash64("page_id", F.lit("html")), size, n)).select("html")
    rows = map_arrow(chosen, run, "feature string, inside boolean, n long").groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")).collect()
    weights = {}
    for feature, a, b in rows:
        odds = max(-MOST, min(MOST, math.log((a + 0.5) / (b + 0.5))))
        weights[feature] = odds if feature.startswith("w:") else min(LEAST_TAG, odds)
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the largest positive sum; the first and longest of equals."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best > 0 and region[0] == start:
            best, region = total, (start, i + 1)
    return region


def whole_article(got: list[Token], first: int, last: int) -> tuple[int, int, bool]:
    """The region, extended to the whole of the article element that holds most of its words, and whether there is one."""
    held: Counter = Counter()
    for feature, text, _, live, mark in got[first:last]:
        if live and feature.startswith("w:"):
            held[mark] += len(text.split())
    best = max(held, key=held.get, default="")
    if not best:
        return first, last, False
    own = [i for i, t in enumerate(got) if t[4] == best]
    return min(first, own[0]), max(last, own[-1] + 1), True


def main_text(page: str | None, weights: dict[str, float]) -> str:
    got = tokens(page or "")
    scores = []
    for feature, text, block, live, _ in got:
        if feature.startswith("w:"):
            words = len(text.split())
            scores.append(words * (max(weights.get(feature, WORD), 0.1) if live else OUTSIDE))
        else:
            scores.append(weights.get(feature, BLOCK_TAG if block else TAG))
    first, last, marked = whole_article(got, *best_region(scores))
    blocks, held = [], []
    for feature, text, block, live, mark in got[first:last]:
        if feature.startswith("w:"):
            # where articles are marked, words between them are none of theirs
            if live and (mark or not marked):
                held.append(text)
        elif feature == "br":
            held.append(" ")
        elif block:
            blocks.append(held)
            held = []
    lines = (" ".join("".join(b).split()) for b in [*blocks, held])
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. The weights hold one number a tag or context of the sample."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [main_text(p, sent.value) for p in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, train(pages))
