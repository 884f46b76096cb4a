"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is read as a token stream of block tags and text slots. The streams of a host are aligned
one after another: equal tokens merge, a mismatch becomes an optional item, a tag that comes back
becomes a repeated item, or closes a repeated group around what lies between. Every name occurs once
in a list of items, so that alignment is linear. The result, the host's wrapper, is a nested expression
of tags, slots, `?` and `+`; every slot also counts its text. Slots are then judged once per host, by their
paths: those under an article element, those under another article container, and elsewhere those
under the element that holds most running text, unless a page part such as a menu, footer, advert or
comment lies around them. html, body and what wraps the content are no page parts. A page takes the
first of the three kinds that it has; a page of a template that its host's paths don't cover is judged
by its own slots.

All pages take part. Alignment starts inside each task, so a host with a third of all pages sends
one small wrapper per task to the merge; pages meet their host's wrapper in a join that adaptive
execution can split.

Defined results: null or empty html gives an empty text; a null url is a host of its own; broken
markup is read as far as it goes, in time linear in its length; elements beyond MAX_DEPTH levels
belong to the element at that level; repeated rows are read row by row; an empty table gives none.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML language by their role here.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table tbody thead article section div body html nav main aside form footer header".split())
# Page parts that aren't the article, as elements and as words of class, id or role.
PART_TAGS = frozenset("nav header footer aside form button menu dialog label legend fieldset option".split())
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus discussion footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promotion promoted related remark remarks replies reply respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets complementary "
    "contentinfo alert gdpr recommended recommendations".split())
ARTICLE_TAGS = ("article", "main")
ARTICLE_WORDS = frozenset("article main".split())

#: Elements nested deeper than this belong to the element at this depth, as in browsers: no text is lost.
MAX_DEPTH = 200
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_DELIMITER = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: Elements of running text: they are no menu, even if they consist of links.
PARAGRAPHS = frozenset("p blockquote pre".split())
TEXT_TAGS = PARAGRAPHS | frozenset("td dd figcaption h1 h2 h3 h4 h5 h6".split())
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Names that tell what an element has or lacks, not what it is.
_STATE = re.compile(r"(?:no|has|have|with|without|not|hide|show)[-_]")


def _signature(tag: str, attributes: str) -> str:
    """Tag with the words of its class, id and role, without numbers."""
    if "=" not in attributes:
        return tag
    words = {w for m in _NAMES.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").lower().split()
             if not _STATE.match(name) for w in _WORD.findall(name)}
    return " ".join([tag, *sorted(words)])


def _tokens(page: str):
    """(start, end, end tag?, tag, attributes) of markup; comments, declarations and raw elements have no tag.

    Linear in the page: every search either consumes what it has read or, once it has failed, isn't
    made again. A quote that leaves a tag without an end makes quotes ordinary from there on.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        if start >= last:  # an unfinished tag at the end is no text
            if _TAG.match(page, start + 1):
                yield start, len(page), False, "", ""
                return
            at = start + 1
            continue
        if page[start + 1] in "!?":
            at = page.index(">", start) + 1
            yield start, at, False, "", ""
            continue
        name = _TAG.match(page, start + 1)
        if not name:
            at = start + 1
            continue
        end = -1
        if quotes:
            here = name.end()
            while mark := _DELIMITER.search(page, here):
                if mark[0] == ">":
                    end = mark.start()
                    break
                close = page.find(mark[0], mark.end())
                if close < 0:
                    break
                here = close + 1
            quotes = end >= 0
        if end < 0:
            end = page.index(">", name.end())
        tag, at = name[2].lower(), end + 1
        if tag in _RAW_END and not name[1]:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
            yield start, at, False, "", ""
        else:
            yield start, at, bool(name[1]), tag, page[name.end():end]


def blocks(page: str | None):
    """(path of signatures, text, characters inside links) of every block with text, in page order."""
    page = page or ""
    stack: list[str] = []
    tags: list[str] = []
    path: tuple = ()
    too_deep = 0
    text: list[str] = []
    linked = 0
    links = 0
    head = False  # whatever text stands there is none of the page; any block ends it
    out = []
    at = 0

    def flush():
        nonlocal text, linked
        nonlocal path
        joined = " ".join(html.unescape("".join(text)).split()) if text else ""
        if joined:
            path = path or tuple(stack)  # blocks of one place share their path
            out.append((path, joined, linked))
        text, linked = [], 0

    for start, end, closes, tag, attributes in _tokens(page):
        if start > at and not head:
            piece = page[at:start]
            text.append(piece)
            if links:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if tag == "head" or (head and tag in BLOCK):
            head = tag == "head" and not closes
        if tag not in BLOCK:
            if tag == "br" or tag == "img":
                text.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if closes else links + 1
            continue
        flush()
        links = 0
        if closes:
            if too_deep:
                too_deep -= 1
            elif tag in tags:
                path = ()
                while tags.pop() != tag:
                    stack.pop()
                stack.pop()
            continue
        if "p" in tags:  # a new block ends an open paragraph
            k = len(tags) - 1 - tags[::-1].index("p")
            if not LIMITS & set(tags[k + 1:]):
                path = ()
                del tags[k:], stack[k:]
        for twin in CLOSED_BY.get(tag, ()):
            if twin in tags:
                k = len(tags) - 1 - tags[::-1].index(twin)
                if not {"ul", "ol", "dl", "table"} & set(tags[k + 1:]):
                    path = ()
                    del tags[k:], stack[k:]
        if tag in VOID:
            continue
        if len(tags) < MAX_DEPTH:
            tags.append(tag)
            stack.append(_signature(tag, attributes))
            path = ()
        else:
            too_deep += 1
    if at < len(page) and not head:
        text.append(page[at:])
    flush()
    return out


# --- wrappers: an item is [name, repeated, optional, children, stats, group]; a slot has the name "#".
# A name occurs once in a list of items. Items of one list with the same group number (not 0) are repeated
# together, in their order: what comes back after other items closes a loop around them. ---

def _slot(chars: int, linked: int) -> list:
    return ["#", False, False, [], [1, chars, linked], 0]


def page_expression(found) -> list:
    """The items of one page: blocks by their common paths, repeats folded."""
    root: list = []
    open_items: list[tuple[str, list]] = []
    before: tuple = ()
    for path, text, linked in found:
        keep = len(path) - 1 if path is before and path else 0
        before = path
        while keep < len(open_items) and keep < len(path) and open_items[keep][0] == path[keep] and keep < len(path) - 1:
            keep += 1
        del open_items[keep:]
        level = open_items[-1][1][3] if open_items else root
        for name in path[keep:]:
            item = [name, False, False, [], [0, 0, 0], 0]
            level.append(item)
            open_items.append((name, item))
            level = item[3]
        level.append(_slot(len(text), linked))
    return _fold(root)


def _grouped(items: list, loops: list[tuple[int, int]]) -> list:
    """Items with loops (first and last place) as groups; loops that share items become one."""
    for item in items:
        item[5] = 0
    last, group = -1, 0
    for first, end in sorted(loops):
        if first > last:
            group += 1
        last = max(last, end)
        for k in range(first, end + 1):
            if items[k][5] != group:
                items[k][5] = group
    return items


def _fold(items: list) -> list:
    """Items with the same name become one: a neighbour repeats it, a later one repeats all between, too."""
    if len(items) < 2:
        for item in items:
            item[3] = _fold(item[3])
        return items
    out: list = []
    place: dict[str, int] = {}
    loops: list[tuple[int, int]] = []  # disjoint, in order: a loop always reaches to the last item
    for item in items:
        item[3] = _fold(item[3])
        k = place.get(item[0])
        if k is None:
            place[item[0]] = len(out)
            out.append(item)
            continue
        out[k] = _merge(out[k], item)
        out[k][1] = True
        if k < len(out) - 1:
            while loops and loops[-1][1] >= k:
                k = min(k, loops.pop()[0])
            loops.append((k, len(out) - 1))
    return _grouped(out, loops)


def _merge(a: list, b: list) -> list:
    below = align(a[3], b[3]) if a[3] or b[3] else []
    (n, chars, linked), (m, more, also) = a[4], b[4]
    return [a[0], a[1] or b[1], a[2] or b[2], below, [n + m, chars + more, linked + also], 0]


def _loops(items: list, place: dict[str, int]) -> list[tuple[int, int]]:
    """Each group's first and last place in another list that holds all its names."""
    found: dict[int, tuple[int, int]] = {}
    for item in items:
        if item[5]:
            k = place[item[0]]
            first, last = found.get(item[5], (k, k))
            found[item[5]] = min(first, k), max(last, k)
    return list(found.values())


def align(a: list, b: list) -> list:
    """Two item lists as one: equal names merge, what only one has becomes optional and follows its neighbour.

    Names in another order in b than in a close a loop, as they do inside one page.
    """
    if len(a) == len(b) == 1 and a[0][0] == b[0][0]:
        return [_merge(a[0], b[0])]
    own = {item[0]: item for item in b}
    at = {item[0]: k for k, item in enumerate(a)}
    after: dict[int, list] = {}
    crossed: list[tuple[str, str]] = []
    behind, far = -1, None
    for item in b:
        k = at.get(item[0])
        if k is None:
            after.setdefault(behind, []).append(item)
            continue
        if k < behind:
            crossed.append((item[0], far))
        else:
            behind, far = k, item[0]
    out: list = []
    for k in range(-1, len(a)):
        if k >= 0:
            twin = own.get(a[k][0])
            out.append(_merge(a[k], twin) if twin else [a[k][0], a[k][1], True, *a[k][3:]])
        out += [[x[0], x[1], True, *x[3:]] for x in after.get(k, ())]
    place = {item[0]: k for k, item in enumerate(out)}
    loops = _loops(a, place) + _loops(b, place) + [tuple(sorted((place[x], place[y]))) for x, y in crossed]
    return _grouped(out, loops)


def show(items: list) -> str:
    """A wrapper as a regular expression over tags and slots."""
    parts: list[tuple[int, str]] = []
    for name, repeated, optional, children, _, group in items:
        body = "#TEXT" if name == "#" else f"<{name}>{show(children)}</{name.split(' ')[0]}>"
        own = f"({body}){'+' if repeated and not group else ''}{'?' if optional else ''}" if (
            repeated and not group) or optional else body
        if group and parts and parts[-1][0] == group:
            parts[-1] = group, parts[-1][1] + own
        else:
            parts.append((group, own))
    return "".join(f"({text})+" if group else text for group, text in parts)


def _slots(items: list, path: tuple = ()):
    for name, _, _, children, stats, _ in items:
        if name == "#":
            yield path, stats
        else:
            yield from _slots(children, (*path, name))


def _is_part(name: str) -> bool:
    tag, *words = name.split(" ")
    return tag not in ("html", "body") and (tag in PART_TAGS or any(w in PART_WORDS for w in words))


def _is_article(name: str) -> bool:
    tag, *words = name.split(" ")
    return tag in ARTICLE_TAGS or (tag not in ("body", "html") and any(w in ARTICLE_WORDS for w in words))


def _free(total: dict[tuple, list]) -> list[tuple]:
    """Paths without a page part around them. An element around most of the text is none if an article lies
    in it, or if nothing were left otherwise."""
    whole = sum(s[1] for s in total.values())
    below: dict[tuple, list] = {}
    for p, s in total.items():
        inner = False  # whether an article lies further inside
        outer = next((k for k, x in enumerate(p) if x.split(" ")[0] in ARTICLE_TAGS), len(p))
        for k in range(len(p), 0, -1):
            # a header inside an article is its own, with the headline
            if _is_part(p[k - 1]) and not (k - 1 > outer and p[k - 1].split(" ")[0] == "header"):
                kept = below.setdefault(p[:k], [0, False])
                kept[0] += s[1]
                kept[1] |= inner
            else:
                inner |= p[k - 1].split(" ")[0] in ARTICLE_TAGS

    def without(wraps):
        return [p for p in total if not any(p[:k] in below and p[:k] not in wraps for k in range(1, len(p) + 1))]

    found = without({p for p, (n, article) in below.items() if article and 2 * n > whole})
    return found or without({p for p, (n, _) in below.items() if 10 * n > 8 * whole})


def content_paths(items: list) -> list[list[tuple]]:
    """Paths of the slots that hold main text: under article elements, under other containers, elsewhere."""
    total: dict[tuple, list] = {}
    for path, stats in _slots(items):
        kept = total.setdefault(path, [0, 0, 0])
        for k in range(3):
            kept[k] += stats[k]
    free = _free(total)
    articles = [p for p in free if any(x.split(" ")[0] == "article" for x in p)]
    named = [p for p in free if p not in set(articles) and any(_is_article(x) for x in p)]
    rest = set(free) - set(articles) - set(named)
    return [articles, named, _heaviest({p: total[p] for p in free if p in rest})]


def _heaviest(free: dict[tuple, list]) -> list[tuple]:
    """Paths under the deepest element that still holds most of the running text, and paragraphs and headline beside it.

    Elements of running text stay there even if they are links; other links are lists of them.
    """
    prose = {p: s for p, s in free.items() if 2 * s[2] <= s[1]}
    weight = sum(s[1] for s in prose.values())
    root: tuple = ()
    while True:
        below: dict[tuple, int] = {}
        for p, s in prose.items():
            if len(p) > len(root) + 1 and p[:len(root)] == root:
                below[p[:len(root) + 1]] = below.get(p[:len(root) + 1], 0) + s[1]
        heavy = [p for p, n in below.items() if 10 * n > 8 * weight]
        if not heavy:
            break
        root = heavy[0]
    tag = {p: p[-1].split(" ")[0] if p else "" for p in free}
    found = [p for p in free if p[:len(root)] == root and (p in prose or (len(p) > 1 and tag[p] in TEXT_TAGS))]
    beside = PARAGRAPHS if any(tag[p] == "h1" for p in found) else PARAGRAPHS | {"h1"}
    return found + [p for p in prose if tag[p] in beside and p[:len(root)] != root]


def main_text(page: str | None, content: list[frozenset]) -> str:
    """The page's main text by its host's paths (joined by line ends), or by its own slots where they don't cover it."""
    found = blocks(page)
    spelled = {p: "\n".join(p) for p in {p for p, _, _ in found}}
    paths = [spelled[p] for p, _, _ in found]

    def pick(kinds) -> tuple[int, list[str]]:
        for k, own in enumerate(kinds):
            texts = [t for p, (_, t, _) in zip(paths, found) if p in own]
            if texts:
                return k, texts
        return len(kinds), []

    kind, texts = pick(content)
    if kind < 2 or not found:
        return "\n".join(texts)
    own, mine = pick([{"\n".join(p) for p in x} for x in content_paths(page_expression(found))])
    # the host's heaviest element may be another template's, of which this page has a small piece only
    return "\n".join(mine if own < 2 or sum(map(len, mine)) > 5 * sum(map(len, texts)) else texts)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame, held_hosts: int = 2000) -> DataFrame:
    """host, wrapper (JSON items), content (paths, JSON). A task holds `held_hosts` wrappers at a time."""
    def local(batches):
        held: dict[str, list] = {}

        def give():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                names=["host", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                items = page_expression(blocks(page))
                held[name] = align(held[name], items) if name in held else items
            if len(held) >= held_hosts:
                yield give()
        yield give()

    def merged(rows) -> list:
        whole = None
        for text in sorted(rows["wrapper"]):
            items = json.loads(text)
            whole = items if whole is None else align(whole, items)
        return whole

    def some(key, rows):
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(merged(rows))]})

    def merge(key, rows):
        whole = merged(rows)
        paths = [["\n".join(p) for p in kind] for kind in content_paths(whole)]
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(whole)], "content": [json.dumps(paths)]})

    # a host with a third of all pages has a wrapper of every task: these are merged in two rounds
    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(local, "host string, wrapper string")
    parts = parts.withColumn("part", F.spark_partition_id() % 32).groupBy("host", "part").applyInPandas(
        some, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(merge, "host string, wrapper string, content string")


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars: each page read through its host's wrapper."""
    wrappers = host_wrappers(pages) if wrappers is None else wrappers

    def kernel(batches):
        known: dict[str, list[frozenset]] = {}
        for batch in batches:
            texts = []
            for page, content in zip(batch.column("html").to_pylist(), batch.column("content").to_pylist()):
                paths = known.get(content)
                if paths is None:
                    if len(known) > 5000:
                        known.clear()
                    paths = known[content] = [frozenset(kind) for kind in json.loads(content or "[]")]
                texts.append(main_text(page, paths))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return (rows.join(wrappers.select("host", "content"), "host", "left").select("page_id", "url", "html", "content")
            .mapInArrow(kernel, f"page_id {kind}, url string, text string, n_chars long"))
