"""Main text of web pages, by wrappers inferred from the pages of each host.

A wrapper is a union-free regular expression over a host's token streams: tags,
text slots, optional groups (...)? and repeated groups (...)+. Tags are read
tolerantly into balanced groups; equal neighbours fold into repeated groups. Then
each page is aligned with the wrapper so far: equal texts stay as the template's text, different ones become a slot,
groups found on one side only become optional, a group against its repetition
becomes repeated. Each partition aligns its own pages and what partitions found
is aligned in turn, first in salted parts of a host, so that no task holds a
host's pages. Every page takes part; none is sampled.

The wrapper's slots tell how much text stands where on a host's pages, and so
which group holds the article: the deepest that holds all text, so that nothing
beside it is lost. On pages with marked groups (article, main) these do, all of
them. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts and comments, known by tag, role, class or id, don't
count. What only its name sets apart stays where it holds most of the page's text.
Text that stands alike on all pages of a host (TEMPLATE different ones or more, whose slots hold more than such text) is the template's
and doesn't count either, unless a page has no other. The rules (a path of groups and the template's texts
for each host) are joined to the pages, broadcast only where their measured size is small.

Nulls: null html is empty and gives the empty text; pages without a host in their
url share one wrapper; a null page_id is kept. Repeated rows repeat. Empty tables
give empty tables. A page is read whole and in linear time, whatever its length.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, small_batches, texts_of, written

#: Bytes of rules up to which they are broadcast.
BROADCAST = 8 << 20
#: Parts of a host that partitions' wrappers are aligned in first, and hosts that a partition holds at once.
SALTS, HELD_HOSTS = 32, 2000

#: Pages of a host from which on what is alike on all of them is its template.
TEMPLATE = 8

#: How deep a wrapper's groups nest; the text of groups that lie deeper counts for the group around them.
DEPTH = 150

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|([^<]+|<)""", re.S | re.I)
NAMING = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LANDMARKS = frozenset("article content main post story entry".split())
PARTS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"[0-9]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
APART = frozenset("nav header footer aside form menu dialog button select option input label fieldset object audio video canvas head".split())
#: Elements that are never apart by name.
WHOLE = frozenset("html body main article".split())
#: Classes, ids and roles of what isn't the article.
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer form header login masthead menu menus modal nav navbar navigation newsletter notice notices popup promo promotion "
    "related reply replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets complementary search".split()
)
#: Words that such a class may have besides, since they only say what kind of box it is or where: share-box, main-nav; not no-sidebar.
FRAMES = frozenset("area bar block bottom box button buttons container global icon icons inner item items left link links list main outer panel primary right secondary section site slot top unit wrap wrapper".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What a start tag closes, up to the element that bounds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
BLOCKS_OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())


class Group:
    """A balanced group of tokens: an element, its label and what it holds."""

    __slots__ = ("tag", "label", "apart", "children")

    def __init__(self, tag: str, label: str, apart: bool):
        self.tag, self.label, self.apart = tag, label, apart
        self.children: list[Group | str] = []


def named_apart(name: str) -> bool:
    """Whether a token of a class, id or role is one of APART_NAMES, but for FRAMES."""
    for token in name.lower().split():
        parts = PARTS.findall(token)
        if not APART_NAMES.isdisjoint(parts) and all(p in APART_NAMES or p in FRAMES for p in parts):
            return True
    return False


def label_of(tag: str, names: list[str]) -> str:
    """The tag and what names its kind: of a class, id or role the first token without digits, or a landmark. Names made for one page would let wrappers grow with the pages."""
    out = tag
    for name in names:
        tokens = name.split()
        kinds = [x for x in tokens if x.lower() in LANDMARKS] or [x for x in tokens if not DIGITS.search(x) and x.count("-") + x.count("_") < 3]
        out += "." + kinds[0] if kinds else ""
    return out


def keep_most(root: Group, made: list[tuple[Group, Group]], named: list[Group]) -> None:
    """Of the groups that are apart by name those with more than half of the page's text aren't. made: all groups with those around them, in page order."""
    size = {id(g): 0 for g, _ in made} | {id(root): 0}
    for group, around in [*reversed(made), (root, None)]:
        size[id(group)] += sum(len(c.strip()) for c in group.children if isinstance(c, str))
        if around and group.tag not in APART:
            size[id(around)] += size[id(group)]
    for group in named:
        group.apart = 2 * size[id(group)] <= size[id(root)]


def parsed(html: str) -> Group:
    """The page's groups. Inline tags vanish, a line break is a space; scripts, styles and comments are left out."""
    root = Group("", "", False)
    stack = [root]
    made: list[tuple[Group, Group]] = []
    named: list[Group] = []
    # where each tag, and what isn't inline, stands in the stack
    at: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []

    def close(k: int) -> None:
        while len(stack) > k:
            at[tag_of := stack.pop().tag].pop()
            if tag_of not in INLINE:
                blocks.pop()

    # without a > to come nothing more is a tag: looking for it from each < would take quadratic time
    end = html.rfind(">") + 1
    rest, last = html[end:], None
    for m in TOKEN.finditer(html[:end]):
        last = m
        text = m.group(8)
        if text is not None:
            top = stack[-1].children
            if top and isinstance(top[-1], str):
                top[-1] += text
            else:
                top.append(text)
            continue
        tag = m.group(3) or m.group(6)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2) or m.group(5):
            if at[tag]:
                close(at[tag][-1])
            continue
        naming = m.group(4) or m.group(7) or ""
        names = [x.group(2).strip("\"'") for x in NAMING.finditer(naming)] if "=" in naming else []
        apart = tag in APART or tag not in WHOLE and any(map(named_apart, names))
        if tag in INLINE and not apart:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].children.append(" ")
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in CLOSES:
            closed, bound = ([at[x][-1] for x in tags if at[x]] for tags in CLOSES[tag])
            if closed and max(closed) > max(bound, default=0):
                close(max(closed))
        group = Group(tag, label_of(tag, names), apart)
        made.append((group, stack[-1]))
        stack[-1].children.append(group)
        at[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(group)
        if apart and tag not in APART:
            named.append(group)
    if not (last and last.end() == end and left_open(last)):
        stack[-1].children.append(rest.split("<!--", 1)[0])
    if named:
        keep_most(root, made, named)
    return root


def left_open(m: re.Match) -> bool:
    """Whether a comment, or an element whose content isn't markup, has no end, so that the rest of the page is its own."""
    own = m.group()
    return not own.endswith("-->") if own.startswith("<!--") else m.group(1) is not None and not re.search(r"</" + re.escape(m.group(1)) + r"\s*>\Z", own, re.I)


# A wrapper's items, as lists, so that they can be JSON: ["#", optional, characters, text's hash] is a text, with null for the hash a slot,
# ["e", optional, label, apart, tag, items] an element, ["+", optional, items] a repeated group.


def key(item: list) -> str:
    if item[0] == "#":
        return "#"
    if item[0] == "e":
        return item[2]
    return key(item[2][0]) if len(item[2]) == 1 else "(" + " ".join(map(key, item[2])) + ")+"


def below(group: Group) -> list[str]:
    """All text in a group outside of what is apart in it."""
    out: list[str] = []
    todo: list[Group | str] = [group]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.apart:
            todo.extend(reversed(x.children))
    return out


def pieces_of(children: list[Group | str]) -> Iterator[Group | list[int]]:
    """The groups among children, and the places of texts that stand together."""
    run: list[int] = []
    for k, c in enumerate(children):
        if isinstance(c, str):
            run.append(k)
            continue
        if run:
            yield run
            run = []
        yield c
    if run:
        yield run


def text_key(children: list[Group | str], run: list[int]) -> str:
    return xxhash.xxh64_hexdigest(" ".join(" ".join(children[k] for k in run).split()))


def items_of(group: Group, depth: int = 1) -> list[list]:
    out: list[list] = []
    children = group.children if depth < DEPTH else below(group)
    for c in pieces_of(children):
        if isinstance(c, Group):
            out.append(["e", 0, c.label, c.apart, c.tag, items_of(c, depth + 1)])
        elif n := sum(len(children[k].strip()) for k in c):
            out.append(["#", 0, n, text_key(children, c)])
    return folded(out)


def folded(items: list[list]) -> list[list]:
    """Equal neighbours, or runs of up to three that follow each other, become a repeated group."""
    for size in (1, 2, 3):
        if len(items) < 2 * size:
            break
        keys = [key(x) for x in items]
        if len(set(keys)) == len(keys):
            break
        out: list[list] = []
        k = 0
        while k < len(items):
            last = k + size
            while last + size <= len(items) and keys[last : last + size] == keys[k : k + size]:
                last += size
            if last > k + size and "#" not in keys[k : k + size]:
                group = items[k : k + size]
                for j in range(k + size, last, size):
                    group = aligned(group, items[j : j + size])
                out.append(["+", 0, group[0][2] if len(group) == 1 and group[0][0] == "+" else group])
                k = last
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The items that match what either side matches: the longest common run of keys, the rest optional."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        return [one(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(one(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 1, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 1, *b[j][2:]])
            j += 1
    return out


def one(x: list, y: list) -> list:
    maybe = x[1] | y[1]
    if x[0] == "#":
        return ["#", maybe, x[2] + y[2], x[3] if x[3] == y[3] else None]
    if x[0] == y[0] == "e":
        return ["e", maybe, x[2], x[3] and y[3], x[4], aligned(x[5], y[5])]
    return ["+", maybe, aligned(x[2] if x[0] == "+" else [x], y[2] if y[0] == "+" else [y])]


def expression(items: list[list]) -> str:
    """The wrapper as a regular expression."""
    out = []
    for x in items:
        text = (f"text:{x[3]}" if x[3] else "#text") if x[0] == "#" else f"<{x[2]}>{expression(x[5])}</{x[4]}>" if x[0] == "e" else f"({expression(x[2])})+"
        out.append(f"({text})?" if x[1] else text)
    return "".join(out)


def mass(items: list[list]) -> int:
    """Characters in slots outside of what is apart."""
    return sum(x[2] if x[0] == "#" else mass(x[2]) if x[0] == "+" else 0 if x[3] else mass(x[5]) for x in items)


def template(items: list[list], label: str = "") -> Iterator[tuple[str, int]]:
    """The texts that all pages have alike outside of what is apart, each with the label around it; and their characters."""
    for x in items:
        if x[1]:
            continue
        if x[0] == "#":
            if x[3]:
                yield f"{label}|{x[3]}", x[2]
        elif x[0] == "+":
            yield from template(x[2], label)
        elif not x[3]:
            yield from template(x[5], x[2])


def rule(pages: int, items: list[list]) -> str:
    """What extraction needs of a wrapper of so many different pages (TEMPLATE or more are told as that), as JSON: the article's path and the template's texts."""
    alike = dict(template(items)) if pages >= TEMPLATE else {}
    if 2 * sum(alike.values()) > mass(items):  # pages that hardly differ
        alike = {}
    return json.dumps([article(items), sorted(alike)])


def without_template(root: Group, alike: frozenset[str]) -> None:
    """Empties the texts that are the template's."""
    todo = [root]
    while todo:
        group = todo.pop()
        for c in list(pieces_of(group.children)):
            if isinstance(c, Group):
                todo.append(c)
            elif f"{group.label}|{text_key(group.children, c)}" in alike:
                for k in c:
                    group.children[k] = " "


def elements(items: list[list]) -> Iterator[list]:
    for x in items:
        if x[0] == "+":
            yield from elements(x[2])
        elif x[0] == "e" and not x[3]:
            yield x


def article(items: list[list]) -> list[str]:
    """The path of labels to the deepest group that holds all text outside of what is apart."""
    path: list[str] = []
    while total := mass(items):
        inner = max(elements(items), key=lambda x: mass(x[5]), default=None)
        if inner is None or inner[4] in BLOCKS_OF_TEXT or mass(inner[5]) < total:
            break
        path.append(inner[2])
        items = inner[5]
    return path


def marked(root: Group) -> list[Group]:
    """The outermost groups that are marked as articles, in page order."""
    found: list[Group] = []
    todo = [root]
    while todo:
        group = todo.pop()
        if group.tag in ("article", "main") or ".main" in group.label:
            found.append(group)
        else:
            todo.extend(c for c in reversed(group.children) if isinstance(c, Group) and not c.apart)
    return found


def at_path(root: Group, path: list[str], apart: bool = False) -> list[Group]:
    found = [root]
    for label in path:
        found = [c for g in found for c in g.children if isinstance(c, Group) and c.label == label and (apart or not c.apart)]
    return found


def text_of(groups: list[Group]) -> str:
    """The groups' text in page order, without what is apart in them: references decoded, each run of white space and each block's edge one space."""
    out: list[str] = []
    todo: list[Group | str] = [c for g in reversed(groups) for c in ("\n", *reversed(g.children), "\n")]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.apart:
            out.append("\n")
            todo.append("\n")
            todo.extend(reversed(x.children))
    return " ".join(entities.unescape("".join(out)).split())


def main_text(html: str, path: list[str] | None, alike: frozenset[str] = frozenset()) -> str:
    """The text of all marked groups, or without text in these that at the path, by which nothing is lost; the template's left out where there is other text."""
    root = parsed(html)
    if alike:
        without_template(root, alike)
        return whole_text(root, path) or main_text(html, path)
    return whole_text(root, path)


def whole_text(root: Group, path: list[str] | None) -> str:
    if text := text_of(marked(root)):
        return text
    # what is apart by name here may hold most of the text of the host's other pages
    found = (at_path(root, path) or at_path(root, path, True)) if path else []
    return text_of(found or at_path(root, article(items_of(root))))


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's wrapper of each host, and the smallest TEMPLATE hashes of its pages: copies count once."""
    wrappers: dict[str, list[list]] = {}
    pages: dict[str, set[str]] = defaultdict(set)

    def out() -> pa.RecordBatch:
        rows = pa.record_batch({"host": pa.array(list(wrappers), pa.string()), "pages": pa.array([sorted(pages[h]) for h in wrappers], pa.list_(pa.string())), "wrapper": pa.array([json.dumps(w) for w in wrappers.values()], pa.string())})
        wrappers.clear()
        pages.clear()
        return rows

    for batch in sliced(batches, 512, (1,)):
        for host, page in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            own = items_of(parsed(page))
            wrappers[host] = aligned(wrappers[host], own) if host in wrappers else own
            pages[host].add(xxhash.xxh64_hexdigest(page))
            if len(pages[host]) > TEMPLATE:
                pages[host].remove(max(pages[host]))
            if len(wrappers) >= HELD_HOSTS:
                yield out()
    if wrappers:
        yield out()


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    wrappers = [json.loads(x) for x in sorted(rows["wrapper"])]
    whole = wrappers[0]
    for w in wrappers[1:]:
        whole = aligned(whole, w)
    return pd.DataFrame({"host": rows["host"].iloc[:1], "pages": [sorted({h for own in rows["pages"] for h in own})[:TEMPLATE]], "wrapper": [json.dumps(whole)]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages and wrapper (JSON) of all pages (url, html)."""
    parts = pages.select(_host().alias("host"), "html").mapInArrow(_found, "host string, pages array<string>, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(SALTS)))
    first = salted.groupBy("host", "salt").applyInPandas(_merged, "host string, pages array<string>, wrapper string")
    return first.groupBy("host").applyInPandas(_merged, "host string, pages array<string>, wrapper string")


def extract(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url and text of every page."""

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [rule(len(n), json.loads(w)) for n, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch({"host": batch.column(0), "path": pa.array(paths, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512, (2,)):
            rules = {p: (path, frozenset(alike)) for p in set(batch.column(3).to_pylist()) if p for path, alike in [json.loads(p)]}
            texts = [main_text(h, *rules.get(p, (None,))) for h, p in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string())})

    small_batches(pages.sparkSession)
    rules, _ = written(wrappers(pages).mapInArrow(ruled, "host string, path string"), "wrappers")
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    joined = rows.join(F.broadcast(rules) if size <= broadcast else rules, "host", "left").select("page_id", "url", "html", "path")
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
