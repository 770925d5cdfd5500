"""Main text of web pages by tag-path ratios.

A page is a sequence of blocks, each with the path of tags from the root that leads to it. For every path the lengths of
text and the numbers of punctuation marks of its blocks are summed; their logarithms per block are smoothed over
neighbouring paths, fused by their product and held against a share of the page's mean, on every page alike. Further
features enter the fusion as factors: the share of text outside links, ``article`` and ``main`` by their share of the
page's text, and signs of boilerplate (``nav``, ``footer``, ``form``, classes such as ``comments``), which count for the
less the more of the page they hold. Headings, lists, tables and short blocks come with the content around them.

Defined results: null or empty html has empty text. Cut-off tags and unclosed comments or scripts at the end are dropped;
unclosed tags end with their parents; a paragraph, item or cell ends where the next begins. References that are no
references stay as they are. Repeated page_ids are pages of their own. Other columns are not returned.
"""

from __future__ import annotations

import html
import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by kind, and the words that mark boilerplate in roles, classes and ids.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"iframe", "noembed", "noframes", "script", "style", "textarea", "title", "xmp"}
HIDDEN = {"button", "canvas", "datalist", "dialog", "head", "math", "noscript", "object", "select", "svg", "template", "video", "audio", *RAW}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
UNMARKED = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th"}
NEGATED = {"has", "is", "no", "non", "not", "with", "without"}
#: Signs of boilerplate, by tag, by class that is such a word (x) or holds one (w): the greater, the more text they outweigh.
SIGNS = {"nav": 8, "footer": 8, "aside": 8, "menu": 8, "header": 8, "form": 2}
STRENGTH = {"x": 4, "w": 2}
SIGN = 0.01
#: Elements that are parts of the text of the element around them.
PARTS = {"address", "blockquote", "caption", "dd", "details", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Which open elements a start tag closes first, up to one of the elements after the bar.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
IN_PARAGRAPH = INLINE | VOID - {"hr"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</?\Z", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…]")


def _mark(name: str, attributes: str) -> str:
    """'.x' where a role, class or id is a word of ``MARKS``, '.w' where it only holds one."""
    found = ""
    if name in UNMARKED:
        return found
    for m in _NAMES.finditer(attributes):
        # Ids of sections are made of their headings.
        slug = name == "section" and m[0][:2].lower() == "id"
        for token in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if not MARKS.isdisjoint(words) and NEGATED.isdisjoint(words):
                if len([w for w in words if not w.isdigit()]) == 1:
                    return ".x"
                found = found if slug else ".w"
    return found


class Block(NamedTuple):
    path: str
    text: str
    inside: tuple[int, ...]  # one number for each element of the path
    linked: int  # characters in links


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out, stack, parts, at, length = [], [], [], 0, len(page)
    here, linked, number = ["", ()], [0], 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(here[0], text, here[1], min(linked[0], len(text))))
        parts.clear()
        linked[0] = 0

    def add(piece: str) -> None:
        if piece:
            if not parts:
                opened = [x for x in stack if x[0] not in INLINE]
                here[:] = "/".join(name for name, _ in opened), tuple(i for _, i in opened)
            parts.append(piece)
            if any(name == "a" for name, _ in stack):
                linked[0] += len(html.unescape(piece).strip())

    while at < length:
        tag = _TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            add(" ")
        if tag[1] or tag[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0].split(".")[0] == name:
                    del stack[i:]
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if name not in IN_PARAGRAPH:
            _close(stack, {"p"}, {"article", "aside", "body", "button", "div", "main", "section", "td", "th"})
        if name in CLOSES:
            _close(stack, *CLOSES[name])
        number += 1
        stack.append((name if name in INLINE else name + _mark(name, tag[3] or tag[6] or ""), number))
    flush()
    return out


def _close(stack: list, names: set, until: set) -> None:
    for i in range(len(stack) - 1, -1, -1):
        name = stack[i][0].split(".")[0]
        if name in names:
            del stack[i:]
            return
        if name in until:
            return


def content_paths(found: list[Block], share: float = 0.5) -> set[str]:
    """The paths whose blocks are content."""
    sums: dict[str, list[int]] = {}
    prose: dict[str, int] = {}
    for b in found:
        if _hidden(b.path):
            continue
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(_MARKS.findall(b.text))
        s[2] += 1
        s[3] += b.linked
    for path, s in sums.items():
        for top in _tops(path):
            prose[top] = prose.get(top, 0) + s[0] - s[3]
    paths, total = list(sums), sum(s[0] - s[3] for s in sums.values())
    signs = [_sign(p, prose, total) for p in paths]
    # Neighbours smooth each other as far as they are no boilerplate.
    logs = [(e * math.log1p(sums[p][0] / sums[p][2]), e * math.log1p(sums[p][1] / sums[p][2])) for p, e in zip(paths, signs)]
    smooth = []
    for i in range(len(logs)):
        near = [(w * (signs[j] if d else 1.0), logs[j], signs[j]) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)) for j in (min(max(i + d, 0), len(logs) - 1),)]
        weight = sum(w for w, _, _ in near)
        smooth.append([sum(w * x[k] / e for w, x, e in near) / weight for k in (0, 1)])
    fused = []
    for p, x, s, e in zip(paths, logs, smooth, signs):
        unlinked = 1 - sums[p][3] / sums[p][0]
        framed = max((prose[t] for t in _tops(p) if t.rsplit("/", 1)[-1] in ("article", "main")), default=0) / (total or 1)
        fused.append((x[0] / e + s[0]) / 2 * (0.2 + (x[1] / e + s[1]) / 2) * e * (0.1 + 0.9 * unlinked) * (1 + framed))
    weights = [sums[p][0] * e for p, e in zip(paths, signs)]
    mean = sum(f * w for f, w in zip(fused, weights)) / sum(weights) if paths else 0
    return {p for f, p in zip(fused, paths) if f >= share * mean}


def _tops(path: str) -> list[str]:
    """The path and all paths above it."""
    return [path[: m.start()] for m in re.finditer("/", path)] + [path]


def _hidden(path: str) -> bool:
    return any(n.split(".")[0] in HIDDEN for n in path.split("/"))


def _power(name: str, framed: bool) -> int | None:
    base, _, mark = name.partition(".")
    return STRENGTH.get(mark) or (None if base == "header" and framed else SIGNS.get(base))


def _sign(path: str, prose: dict[str, int], total: int) -> float:
    """1 without signs of boilerplate, down to ``SIGN`` with them."""
    out, framed = 1.0, False
    for top in _tops(path):
        name = top.rsplit("/", 1)[-1]
        framed |= name in ("article", "main")
        power = _power(name, framed)
        if power:
            out = min(out, SIGN ** (1 - (prose[top] / (total or 1)) ** power))
    return out


def _carried(found: list[Block], kept: set[int]) -> set[int]:
    """Blocks that come with the kept ones: unsigned parts of the elements that hold these."""
    first, last, chars, links, homes = {}, {}, {}, {}, set()
    for i, b in enumerate(found):
        for e in b.inside:
            chars[e] = chars.get(e, 0) + len(b.text)
            links[e] = links.get(e, 0) + b.linked
            if i in kept:
                first.setdefault(e, i)
                last[e] = i
        if i in kept:
            homes.add(next((e for n, e in zip(reversed(b.path.split("/")), reversed(b.inside)) if n.split(".")[0] not in PARTS), 0))
    out = set()
    for i, b in enumerate(found):
        if i in kept or _hidden(b.path):
            continue
        names = [n.split(".")[0] for n in b.path.split("/")] if b.path else []
        depth = next((d for d in range(len(names), 0, -1) if b.inside[d - 1] in first), 0)
        around = b.inside[depth - 1] if depth else 0
        framed = bool({"article", "main"} & set(names))
        if any(_power(n, framed) for n in b.path.split("/")[depth:]):
            continue
        start, end = (first[around], last[around]) if depth else (min(kept), max(kept))
        child = b.inside[depth] if depth < len(names) else None
        listed = 2 * (links[child] if child else b.linked) > (chars[child] if child else len(b.text))
        home = around in homes
        if start < i < end:
            out.add(i)
        elif listed:
            if home and i > end and names[depth - 1 : depth] != ["body"]:
                out.add(i)
        elif i < start and "h1" in names:
            out.add(i)
        elif home and (all(n in PARTS for n in names[depth:]) or names[-1] in PARTS - {"p", "section"}):
            out.add(i)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    paths = content_paths(found)
    kept = {i for i, b in enumerate(found) if b.path in paths}
    kept |= _carried(found, kept) if kept else set()
    return "\n".join(b.text for i, b in enumerate(found) if i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(main_text)

    out = pages.select("page_id", "url", text_of(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
