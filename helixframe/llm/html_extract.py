"""Main text of web pages by tree scoring.

A page becomes a light tree of its block elements and links. Blocks of text
pass points for length and commas to the elements around them, fewer the
farther away; an element's points are discounted by its share of link text.
The best element (or the article that it stands in) and the siblings that score
like text are kept, without the parts that are menus, notices, adverts, forms,
comments and the like.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import common

#: A quote opens a value only behind ``=``; in names and bare values it is a character like others.
#: What a value has taken is never given back, so a quote left open costs one pass.
_ATTRS = r"(?P<attrs>(?>=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)|=(?=\s*>)|[^=>])*+)"
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)" + _ATTRS + r">|</[^>]*>|(?P<text>[^<]+|<(?![a-zA-Z/!?]))", re.S)
#: A tag with a quote that never closes, taken up to the next ``>``.
_LOOSE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>(?P<cdata>(?!))?(?P<text>(?!))?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
#: Elements whose content is not markup.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol option p pre search section select summary svg table tbody td template tfoot th thead tr ul button canvas object audio video head".split())
_DROP = set("nav footer aside script style noscript iframe svg template button select option textarea dialog canvas object audio video menu search head".split())
#: Left out, unless what the page has to say stands in them.
_FORMS = {"form", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of class and id names. A name of such words alone marks a part to leave out ...
_BOILER = set("comment comments disqus respond replies ad ads advert adverts advertisement advertisements advertising adslot adsense sponsor sponsors sponsored promo promos cookie cookies consent gdpr popup modal overlay newsletter subscribe nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead banner notice notices alert alerts related recommended recommendations pagination pager toolbar outbrain taboola topbar".split())
#: ... or, for these, one that holds no paragraph of its own or mostly links;
_MAYBE = set("promotion promotions social share sharing reply paywall subscription widget login signup search skip hidden rail".split())
#: they may stand beside words of place and kind; an article's own header stays.
_BESIDE = set("box bar wrap wrapper container list item items section block area inner outer top bottom left right main button buttons link links icon icons panel group row col column unit slot holder site page global primary secondary sticky fixed mobile desktop large small policy message form thread content contents article articles post posts story stories entry reading block blocks tools count".split())
_OWN = {"article", "articles", "post", "posts", "story", "entry", "content", "section"}
_PLACE = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMAS = re.compile("[,，、،]")


_KEEP, _MAYBE_OUT, _FORM, _OUT = range(4)


def _left_out(tag: str, attrs: str, in_article: bool) -> int:
    """What an element's tag, role and names say: kept, left out, or left to what it holds."""
    if tag in _DROP or (tag == "header" and not in_article):
        return _OUT
    kind = _FORM if tag in _FORMS else _KEEP
    if not attrs.strip():
        return kind
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in _ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return _OUT
    if tag in ("main", "body", "html"):
        return kind
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = set(_PLACE.findall(_CAMEL.sub(" ", name).lower()))
        if tag == "article" and not words <= {"comment", "comments"}:
            continue
        told = words & (_BOILER | _MAYBE)
        if not told or words - told - _BESIDE - {w for w in words if len(w) < 3} or (told <= {"header", "banner"} and words & _OWN):
            continue
        if told & _BOILER:
            return _OUT
        kind = max(kind, _MAYBE_OUT)
    return max(kind, _FORM) if role == "form" else kind


def main_text(page: str | None) -> str:
    """Main text of a page: blocks in page order joined by two newlines, white space inside a block as one space; empty if there is none."""
    if not page:
        return ""
    tag_of, parent, told = ["#root"], [-1], [_KEEP]
    stack = [0]
    blocks: list[tuple[int, str, int, int]] = []  # element, text, link characters, links
    pieces: list[str] = []
    linked = links = 0
    running: Counter[str] = Counter()  # open elements by name: what is not open is not looked for

    def element() -> int:
        for node in reversed(stack):
            if tag_of[node] != "a":
                return node
        return 0

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            if text := " ".join("".join(pieces).split()):
                blocks.append((element(), text, min(linked, len(text)), links))
            pieces.clear()
            linked = links = 0

    def close(to: int) -> None:
        """Close the elements from place ``to`` of the stack on."""
        if any(tag_of[n] != "a" for n in stack[to:]):
            flush()
        running.subtract(tag_of[n] for n in stack[to:])
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at) or _LOOSE.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            text = _html.unescape(m["text"]) if m["text"] is not None else m["cdata"]
            pieces.append(text)
            if any(tag_of[n] == "a" for n in stack[-3:]):
                linked += len(text.strip())
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if not running[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if tag_of[stack[i]] == tag:
                    close(i)
                    break
                if tag == "a" or (tag == "p" and tag_of[stack[i]] not in ("a", "p")):
                    break
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in _RAW:
            if (found := re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)) is None:
                found_at = size
            else:
                found_at = found.end()
            at = found_at
            continue
        if tag == "a":
            if tag_of[stack[-1]] == "a":
                stack.pop()
                running["a"] -= 1
            links += 1
        elif tag not in _BLOCK:
            if tag == "hr":
                flush()
            continue
        else:
            i = len(stack)
            while tag_of[stack[i - 1]] in ("a", "p"):
                i -= 1
                if tag_of[stack[i]] == "p":
                    close(i)
                    break
            ends = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "body": ("head", ("html",))}.get(tag)
            if ends and any(running[t] for t in ends[0].split()):
                for i in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[i]] in ends[1]:
                        break
                    if tag_of[stack[i]] in ends[0].split():
                        close(i)
                        break
            flush()
        node = len(tag_of)
        above = stack[-1]
        tag_of.append(tag)
        parent.append(above)
        in_article = tag == "header" and bool(running["article"] or running["main"])
        told.append(_KEEP if tag == "a" else _left_out(tag, m["attrs"], in_article))
        if not m["attrs"].endswith("/") or tag not in ("svg", "canvas", "object"):
            stack.append(node)
            running[tag] += 1
    flush()

    count = len(tag_of)
    holds = [t in ("article", "main") for t in tag_of]  # what holds an article is not left out: its end tag is missing
    for node in range(count - 1, 0, -1):
        holds[parent[node]] = holds[parent[node]] or (holds[node] and told[node] == _KEEP)
    worth, length, link = [0.0] * count, [0] * count, [0] * count
    for node, text, in_links, _ in blocks:
        length[node] += len(text)
        link[node] += in_links
        worth[node] += len(text) >= 25
    for node in range(count - 1, 0, -1):
        for sums in (worth, length, link):
            sums[parent[node]] += sums[node]

    def unwanted(forms: bool) -> list[bool]:
        out = [False] * count
        for node in range(1, count):
            leave = told[node] == _OUT or (told[node] == _FORM and not forms) or (told[node] == _MAYBE_OUT and (not worth[node] or 3 * link[node] >= length[node]))
            out[node] = (leave and not (holds[node] and tag_of[node] != "article")) or out[parent[node]]
        return out

    out = unwanted(False)
    best, score, density, many = _scored(blocks, tag_of, parent, out)
    if _FORM in told:
        wrapped = unwanted(True)
        inside = _scored(blocks, tag_of, parent, wrapped)
        if inside[1][inside[0]] > 3 * max(score[best], 0.0):  # the form is the page
            out, (best, score, density, many) = wrapped, inside
    if score[best] <= 0:
        best = next((n for n in range(1, count) if tag_of[n] in ("article", "main") and not out[n] and length[n]), 0)
    whole = best
    while whole > 0 and tag_of[whole] not in ("article", "main"):
        whole = parent[whole]
    best = whole if whole > 0 else best
    least = max(10.0, 0.2 * score[best])
    kept = [False] * count
    for node in range(count):
        beside = best > 0 and parent[node] == parent[best] and node != best
        if beside and tag_of[node] != "a":
            kept[node] = score[node] >= least or tag_of[node] in _HEADINGS or (tag_of[node] == "p" and density[node] < 0.25 and length[node] > 80)
        kept[node] = kept[node] or node == best or (node > 0 and kept[parent[node]])
    # a list that is nearly all links, before any text and in no article, is a menu
    menu = [whole <= 0 and tag_of[n] in ("ul", "ol", "dl") and many[n] >= 3 and density[n] >= 0.8 for n in range(count)]
    for node in range(1, count):
        menu[node] = menu[node] or menu[parent[node]]
    first = next((i for i, (node, text, _, _) in enumerate(blocks) if kept[node] and not out[node] and not menu[node] and (len(text) >= 25 or tag_of[node] in _HEADINGS)), 0)
    return "\n\n".join(text for i, (node, text, _, _) in enumerate(blocks) if kept[node] and not out[node] and not (menu[node] and i < first))


def _scored(blocks: list[tuple[int, str, int, int]], tag_of: list[str], parent: list[int], out: list[bool]) -> tuple[int, list[float], list[float], list[int]]:
    """The best element, and per element its score, link density and links. A block's points go to the element around it, half of them to the next and so on."""
    count = len(tag_of)
    length, link, points, many = [0] * count, [0] * count, [0.0] * count, [0] * count
    for node, text, in_links, n in blocks:
        if out[node]:
            continue
        length[node] += len(text)
        link[node] += in_links
        many[node] += n
        if len(text) >= 25:
            above = parent[node] if node and tag_of[node] in ("p", "pre", "blockquote", "td", "li", "dd", *_HEADINGS) else node
            points[above] += 1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3)
    for node in range(count - 1, 0, -1):
        length[parent[node]] += length[node]
        link[parent[node]] += link[node]
        many[parent[node]] += many[node]
        points[parent[node]] += points[node] / 2
    density = [link[i] / length[i] if length[i] else 0.0 for i in range(count)]
    score = [points[i] * (1 - density[i]) for i in range(count)]
    return max(range(count), key=lambda i: (score[i], -i)), score, density, many


@arrow_udf(T.StringType())
def _extracted(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every row; a null or empty page gives an empty text. Repeated rows stay; other columns are ignored, and a kept column named text or n_chars gives way."""
    common.tune(pages.sparkSession)
    text = pages.select(*[c for c in keep if c not in ("text", "n_chars")], _extracted(F.col(html)).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
