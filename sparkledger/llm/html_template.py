"""Operator 1: main text of web pages, by equivalence classes of tokens over pages of one host.

Tokens are elements (by their path of tags, classes and ids), words (by path and word) and blocks (by path and whole text). A token's occurrence vector
counts it on each page; tokens with equal vectors form a class. Classes that are large and frequent enough and whose elements and blocks keep one order on
every page are valid. Valid classes are nested: the widest class whose tokens occur once a page is the root, and a class belongs into another if it lies in
the same gap between that one's tokens on all of its pages; what fits nowhere is no part of the template. Elements of the nested classes are the template's
frame, and what lies between them are slots.
The main slot is the frame's article or main element if it holds half of the words that are not template themselves, or else the innermost container
that holds nearly all of them; navigation and the like is left out by the meaning of tags, roles and class names. The slot's text is kept, block by block,
but for template blocks: those of `LEAST_WORDS` words or more that are in nested classes of at least `BLOCK_SUPPORT` of the host's pages, such as a notice
or an advert under a neutral class name. Pages with equal html are one page of evidence, and pages with hardly any text of their own (copies of an
article) are none, so that copies don't make an article a template. With fewer than `LEAST_PAGES` pages of evidence no block is left out.

Pages of a host are dealt by hash into groups of bounded number and bytes, each with a template of its own, so no host is one task's work.
A group of one page is its own evidence. Null and empty html give an empty text; a null url is a host of its own; repeated rows are pages like any others;
an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PAGES, BYTES, HOT_HOSTS = 200, 16_000_000, 200_000
SUPPORT, SHARE, ARTICLE_SHARE = 0.5, 0.95, 0.5
BLOCK_SUPPORT, OWN_SHARE, LEAST_PAGES, LEAST_WORDS = 0.8, 0.3, 4, 4

# Names of HTML, and words that class names use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot li dd dt legend summary body html head".split())
DROPPED = frozenset("head nav footer aside form button select option datalist dialog svg canvas object audio video map menu script style textarea title noscript template iframe xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
CONTAINERS = frozenset("html body div main article section table tbody tr td center".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Za-z]+")
#: End tags that an opening tag implies, up to the element that bounds the search.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass
class Page:
    """Elements in page order, and pieces of text with the element they are in."""

    path: list[str] = field(default_factory=lambda: [""])
    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    dropped: list[bool] = field(default_factory=lambda: [False])
    texts: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, number of its block


def _marks(attributes: str) -> tuple[str, bool]:
    """What an element's class and id add to its path, and whether they or its role say that it's no article."""
    name, out = "", False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role":
            out |= value in ROLES
        elif key == "hidden" or key == "aria-hidden":
            out |= key == "hidden" or value == "true"
        else:
            name += ("." if key == "class" else "#") + re.sub(r"\d+", "0", value)
            out |= any(w in NOT_ARTICLE for w in _NAME.findall(value))
    return name, out


def parse(source: str) -> Page:
    """Reads any text as HTML: unclosed, misnested and cut-off elements end where a browser would end them, near enough."""
    page, stack, block, at = Page(), [0], 0, 0
    n = len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        if not m:  # a tag that never ends
            end = source.find("<", at + 1)
            at = n if end < 0 else end
            continue
        at = m.end()
        close, tag, attributes, text = m.groups()
        if text is not None:
            page.texts.append((stack[-1], text, block))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "br":
            page.texts.append((stack[-1], " ", block))
            continue
        if tag in VOID:
            continue
        ends, bounds = ({"p"}, {"td", "th", "table", "button"}) if tag in CLOSES_P else _ENDS.get(tag, ((), ()))
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                t = page.tag[stack[k]]
                if t in ends:
                    del stack[k:]
                    break
                if t in bounds:
                    break
        up = stack[-1]
        marks, out = _marks(attributes) if attributes and not attributes.isspace() else ("", False)
        inside = tag in ("html", "body", "article", "main")
        header = tag == "header" and not re.search(r"/(article|main)\b", page.path[up])
        page.path.append(f"{page.path[up]}/{tag}{marks}")
        page.tag.append(tag)
        page.parent.append(up)
        page.dropped.append(page.dropped[up] or tag in DROPPED or header or out and not inside)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = end.start() if end else n
            if end:
                gt = source.find(">", at)
                at = n if gt < 0 else gt + 1
            continue
        stack.append(len(page.tag) - 1)
    return page


def blocks_of(page: Page) -> list[tuple[int, tuple[str, str, str]]]:
    """Block tokens of the page's text outside navigation and the like: the element that a block begins in, and the token."""
    pieces: dict[int, list] = {}
    for element, text, block in page.texts:
        if not page.dropped[element]:
            pieces.setdefault(block, []).append((element, text))
    joined = ((b[0][0], plain("".join(t for _, t in b))) for b in pieces.values())
    return [(element, ("block", page.path[element], text)) for element, text in joined if text]


def plain(source: str) -> str:
    """Text of a block: character references decoded, white space as single spaces."""
    return " ".join(html.unescape(source).split())


def equivalence_classes(pages: list[Page], blocks: list[list] | None = None, support: float = SUPPORT) -> list[tuple[tuple, list]]:
    """Valid classes: (occurrence vector, tokens). A vector is a tuple of (page, count) over the pages that have the token. With blocks (of each page) these are tokens, otherwise words are."""
    seen: dict[object, list] = defaultdict(list)
    for i, p in enumerate(pages):
        for path, n in Counter(p.path[1:]).items():
            seen[path].append((i, n))
        if blocks is not None:
            for token, n in Counter(t for _, t in blocks[i]).items():
                seen[token].append((i, n))
            continue
        words: dict[str, list] = defaultdict(list)
        for element, text, _ in p.texts:
            words[p.path[element]] += text.split()
        for path, ws in words.items():
            for w, n in Counter(ws).items():
                seen[path, w].append((i, n))
    least = max(1, support * len(pages))
    classes: dict[tuple, list] = defaultdict(list)
    for token, occurrences in seen.items():
        if len(occurrences) >= least:
            classes[tuple(occurrences)].append(token)
    return [(v, tokens) for v, tokens in classes.items() if len(tokens) > 1]


@dataclass
class Node:
    """A class of the template: its tokens, its places on each of its pages, and the classes in its gaps."""

    tokens: list
    places: dict[int, list]
    once: bool
    inner: dict[int, list["Node"]] = field(default_factory=dict)

    def gap(self, other: "Node") -> int | None:
        """The gap between this class's places that holds all of the other's on all of its pages; None if there is no such gap."""
        found = None
        for i, at in other.places.items():
            mine = self.places.get(i)
            if mine is None:
                return None
            g = bisect_left(mine, at[0])
            if g != (g if found is None else found) or g < len(mine) and mine[g] <= at[-1]:
                return None
            found = g
        return found

    def add(self, other: "Node") -> bool:
        """Nests the other class here, as deep as it goes; False if it lies in no gap."""
        here = self
        g = self.gap(other) if self.once else None
        if g is None:
            return False
        while True:
            inner = here.inner.setdefault(g, [])
            for node in inner:
                deeper = node.gap(other) if node.once else None
                if deeper is not None and 0 < deeper < len(node.tokens):
                    here, g = node, deeper
                    break
            else:
                inner.append(other)
                return True

    def nodes(self):
        yield self
        for inner in self.inner.values():
            for node in inner:
                yield from node.nodes()


def template(pages: list[Page], classes: list[tuple[tuple, list]], blocks: list[list] | None = None) -> Node | None:
    """The valid classes, nested below the widest one whose tokens occur once a page."""
    owner = {t: k for k, (_, tokens) in enumerate(classes) for t in tokens if isinstance(t, str) or t[0] == "block"}
    places: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    order: dict[int, list] = {}
    valid = dict.fromkeys(owner.values(), True)
    for i, p in enumerate(pages):
        found = [((e, 0, 0), path) for e, path in enumerate(p.path) if path in owner]
        if blocks is not None:
            found += [((e, 1, n), t) for n, (e, t) in enumerate(blocks[i]) if t in owner]
        here: dict[int, dict] = defaultdict(dict)
        for at, t in sorted(found):
            k = owner[t]
            here[k].setdefault(t)
            places[k][i].append(at)
        for k, tokens in here.items():
            valid[k] &= order.setdefault(k, list(tokens)) == list(tokens)
    nodes = [Node(order[k], places[k], all(n == 1 for _, n in classes[k][0])) for k in order if valid[k]]
    nodes.sort(key=lambda n: (-len(n.places), not n.once, -len(n.tokens)))
    root = next((n for n in nodes if n.once), None)
    if root:
        for node in nodes:
            if node is not root:
                root.add(node)
    return root


def template_blocks(pages: list[Page]) -> set[tuple]:
    """Block tokens of the template of a host's pages, by the pages that have text of their own."""
    blocks = [blocks_of(p) for p in pages]
    evidence = list(range(len(pages)))
    while len(evidence) >= LEAST_PAGES:
        some, theirs = [pages[i] for i in evidence], [blocks[i] for i in evidence]
        root = template(some, equivalence_classes(some, theirs, BLOCK_SUPPORT), theirs)
        fixed = {t for node in root.nodes() if node.once for t in node.tokens if not isinstance(t, str) and len(t[2].split()) >= LEAST_WORDS} if root else set()
        if not fixed:
            return fixed
        own = [i for i in evidence if sum(len(t[2]) for _, t in blocks[i] if t not in fixed) >= OWN_SHARE * max(1, sum(len(t[2]) for _, t in blocks[i]))]
        if len(own) == len(evidence):
            return fixed
        evidence = own
    return set()


def _words_inside(pages: list[Page], frame: set[str], fixed: set[tuple]) -> Counter:
    """Words outside navigation and the like that are not fixed, by the frame elements around them, over the pages that have a fair share of such words."""
    mass: Counter = Counter()
    for p in pages:
        here: Counter = Counter()
        total = 0
        for element, text, _ in p.texts:
            if p.dropped[element]:
                continue
            path, words = p.path[element], text.split()
            total += len(words)
            n = sum((path, w) not in fixed for w in words) if fixed else len(words)
            if n:
                here[element] += n
        if sum(here.values()) < OWN_SHARE * total:
            continue
        for element, n in here.items():
            while element > 0:
                if p.path[element] in frame:
                    mass[p.path[element]] += n
                element = p.parent[element]
    return mass


def main_paths(pages: list[Page]) -> list[str]:
    """Paths of frame elements that may be the main slot, best first."""
    classes = equivalence_classes(pages)
    root = template(pages, classes)
    frame = {t for node in root.nodes() if node.once for t in node.tokens} if root else set()
    fixed = {t for _, tokens in classes for t in tokens if isinstance(t, tuple)} if len(pages) > 1 else set()
    mass = _words_inside(pages, frame, fixed) or _words_inside(pages, frame, set())
    if not mass:
        return []
    tag = {m: re.split(r"[.#]", m.rpartition("/")[2])[0] for m in mass}
    top = max(mass.values())
    named = [m for m in mass if tag[m] in ("article", "main") and mass[m] >= ARTICLE_SHARE * top]
    if named:
        return sorted(named, key=lambda m: (m.count("/"), -mass[m], m))
    return sorted((m for m in mass if tag[m] in CONTAINERS and mass[m] >= SHARE * top), key=lambda m: (-m.count("/"), -mass[m], m))


def text_of(page: Page, paths: list[str], fixed: set[tuple] = frozenset()) -> str:
    """The blocks inside the first of paths that the page has, without template blocks, joined by blank lines; all of the page's if it has none."""
    have = set(page.path)
    wanted = next((p for p in paths if p in have), None)
    inside = [wanted is None] * len(page.path)
    for i in range(1, len(page.path)):
        inside[i] = inside[page.parent[i]] or page.path[i] == wanted
    blocks: dict[int, list] = {}
    for element, text, block in page.texts:
        if inside[element] and not page.dropped[element]:
            blocks.setdefault(block, [page.path[element]]).append(text)
    joined = (("block", b[0], plain("".join(b[1:]))) for b in blocks.values())
    return "\n\n".join(b[2] for b in joined if b[2] and b not in fixed)


def extract(sources: list[str | None]) -> list[str]:
    """Main text of each of some pages of one host."""
    pages = [parse(s or "") for s in sources]
    paths = main_paths(pages)
    frame = set(paths)
    first = {s: p for s, p in zip(sources, pages) if s}
    fixed = template_blocks(list(first.values())) if len(first) >= LEAST_PAGES else set()
    return [text_of(p, paths if frame & set(p.path) else main_paths([p]), fixed) for p in pages]


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html", most: int = PAGES, most_bytes: int = BYTES, hot_hosts: int = HOT_HOSTS) -> DataFrame:
    """id_col, url, text, n_chars for each page. most, most_bytes: pages and bytes of a group; hot_hosts: how many hosts of several groups are broadcast; if there are more they are joined by a shuffle."""
    host = F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(source).alias("_html"), host.alias("_host"))
    hosts = slim.groupBy("_host").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_html")), F.lit(0)).alias("b"))
    hosts = C.stored(hosts.withColumn("_groups", F.ceil(F.greatest(F.col("n") / most, F.col("b") / most_bytes))), "hosts")
    many = hosts.where("_groups > 1").select("_host", "_groups")
    many = F.broadcast(many) if many.count() <= hot_hosts else many.hint("merge")
    dealt = slim.join(many, "_host", "left").withColumn("_group", F.pmod(F.xxhash64("_id", "_url"), F.coalesce("_groups", F.lit(1)))).drop("_groups")
    # groups can't be split by adaptive execution, so there are as many partitions as keep tasks of one size
    wide = -(-int(hosts.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]) // most_bytes)
    dealt = dealt.repartition(max(wide, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_host", "_group")
    id_type, url_type = pages.schema[id_col].dataType.simpleString(), pages.schema[url].dataType.simpleString()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        text = extract([None if pd.isna(h) else h for h in pdf["_html"]])
        return pd.DataFrame({id_col: pdf["_id"], url: pdf["_url"], "text": text, "n_chars": [len(t) for t in text]})

    return dealt.groupBy("_host", "_group").applyInPandas(group, f"`{id_col}` {id_type}, `{url}` {url_type}, text string, n_chars long")
