"""Main text of web pages by wrappers inferred for each host.

A page becomes a tree of blocks. A wrapper is a union-free regular expression
over such trees: every block has a sequence of items, each of them a block, or a
group of blocks, that stands once, optionally or repeatedly, and a text that is
a literal or, once two pages differ in it, a slot. Aligning a page with a
wrapper resolves mismatches: items that only one side has become optional,
neighbours that repeat become a repeated item or group, differing literals
become slots. Every page takes part: each task aligns its pages host by host,
and a host's wrappers from all tasks are aligned with each other, so a host
with a third of the pages sends one wrapper per task.

From a host's wrapper follows what its pages' main text is: an article or main
block if there is one, else the innermost block that holds all content;
without blocks for menus, adverts, forms and the like, and without literals that
most of the host's pages have, which are the host's own words. A host with too
few distinct pages has no such literals. Inside an article a class that is also
used otherwise (search-results, related-work) is a hint only: its block goes if
the wrapper has it as the host's own words or as a list of links.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import stored

RAW = "script|style|noscript|template|iframe|svg|canvas|textarea|select"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s "
                   "samp small span strike strong sub sup time tt u var wbr audio video object math mi mn mo ms mtext mrow "
                   "mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mfenced semantics annotation".split())
#: Blocks that a link may hold.
LINKED = frozenset("div figure figcaption h1 h2 h3 h4 h5 h6 p section".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("nav footer aside form button head dialog menu input link meta".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promotion related recommended replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget widgets".split())
HEADER_WORDS = frozenset("header masthead".split())
#: Words that say nothing more of a container's use beside one of those.
PLAIN_WORDS = frozenset("area bar block box buttons container group holder icons inner item items links list panel posts row "
                        "section slot unit wrap wrapper".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption li dt dd td th caption".split())
CLOSES_P = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr li main nav ol p pre section table tbody td th thead tr ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Longest repeated group of neighbouring blocks.
GROUP = 4
#: Groups that a host's wrappers are aligned in before those of the groups are.
SHARES = 64
#: Distinct pages of a host before its literals count as the host's own words.
LITERAL_PAGES = 3
#: Least share of link text in a list of links.
LINK_SHARE = 0.8

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NUMBER = re.compile(r"\d+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    """A block of a page: its label, child blocks and texts in order, and the characters of its links."""

    __slots__ = ("label", "children", "links")

    def __init__(self, label: str):
        self.label = label
        self.children: list[Block | str] = []
        self.links = 0

    def text(self) -> str:
        return " ".join("".join(c for c in self.children if isinstance(c, str)).split())


def label_of(tag: str, attributes: str) -> str:
    """Tag, then the words of class, id and role without their numbers."""
    found = _ATTRIBUTE.findall(attributes) if "=" in attributes else ()
    names = {re.sub(r"\d+", "0", name) for _, value in found for name in html.unescape(value.strip("\"'")).split()}
    return f"{tag} {' '.join(sorted(names))}" if names else tag


@lru_cache(maxsize=1 << 14)
def label_kind(label: str) -> tuple[bool, bool, bool]:
    """Whether blocks of the label are skipped anywhere; outside an article; inside one if the wrapper agrees."""
    tag, _, names = label.partition(" ")
    found = {w.lower() for w in _WORD.findall(names)}
    named = bool(found & SKIPPED_WORDS)
    only = named and found <= (SKIPPED_WORDS if tag in TEXT_TAGS else SKIPPED_WORDS | PLAIN_WORDS)
    skipped = tag in SKIPPED_TAGS or only
    return skipped, skipped or named or tag == "header" or bool(found & HEADER_WORDS), named and not skipped


def is_article(label: str) -> bool:
    tag, _, names = label.partition(" ")
    return tag in ("article", "main") and not label_kind(label)[0]


def parse(page: str) -> Block:
    """The tree of a page; missing end tags are supplied, stray ones dropped."""
    root = Block("page")
    stack, tags, at = [root], ["page"], 0
    link = False

    def close(upto: int) -> None:
        del stack[upto:], tags[upto:]

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            stack[-1].children.append(page[at:token.start()])
            if link:
                stack[-1].links += len(" ".join(page[at:token.start()].split()))
        at = token.end()
        if token[3] is None:
            continue
        tag = token[3].lower()
        if tag == "a":
            link = not token[2]
        elif tag not in INLINE and tag != "br" and tag not in LINKED:  # a link left open
            link = False
        if token[2]:
            if tag in INLINE and tag not in tags:
                continue
            if tag in tags:
                close(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tag == "br":
            stack[-1].children.append(Block("br"))
            continue
        label = label_of(tag, token[4])
        if tag in INLINE and not label_kind(label)[0]:
            continue
        if tag in CLOSES_P and "p" in tags:
            close(tags.index("p"))
        if tag in SAME_CLOSES:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in STOPS.get(tag, ()):
                    break
                if tags[k] in SAME_CLOSES[tag]:
                    close(k)
                    break
        if is_article(label):  # does not belong to a menu or advert left open
            for k in range(1, len(stack)):
                if label_kind(stack[k].label)[1]:
                    close(k)
                    break
        if tag in ("html", "body"):
            continue
        block = Block(label)
        stack[-1].children.append(block)
        if tag not in VOID and not token[4].endswith("/"):
            stack.append(block)
            tags.append(tag)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


# -- wrappers -------------------------------------------------------------------
# A wrapper is {"l": label, "n": pages, "t": text, "d": text, "m": characters, "k": those of links, "c": items}; text is
# "" (none), a literal's digest or None (a slot), "d" the same of the text without its numbers. An item is [fewest (0 or 1), repeated, wrapper]; a group has the label "( .. )" of its members.

def wrapper_of(block: Block) -> dict:
    """The wrapper of a single page."""
    text = block.text()
    digest = hashlib.md5(text.encode()).hexdigest()[:12] if text else ""
    shape = _NUMBER.sub("0", text)
    return {"l": block.label, "n": 1, "t": digest, "m": len(text), "k": block.links,
            "d": digest if shape == text else hashlib.md5(shape.encode()).hexdigest()[:12],
            "c": fold([[1, False, wrapper_of(c)] for c in block.children
                       if not isinstance(c, str) and c.label != "br"])}


def _one(left: list, right: list) -> list:
    """Two items as one repeated item."""
    merged = merge(left[2], right[2])
    merged["n"] = max(left[2]["n"], right[2]["n"])
    return [max(left[0], right[0]), True, merged]


def _group(items: list) -> dict:
    return {"l": "(" + ",".join(i[2]["l"] for i in items) + ")", "n": max(i[2]["n"] for i in items), "t": "", "d": "", "m": 0,
            "k": 0, "c": items}


def fold(items: list, known: frozenset = frozenset()) -> list:
    """Neighbours that repeat become one repeated item; groups in ``known`` do so when they stand once."""
    out: list = []
    for item in items:
        if out and out[-1][2]["l"] == item[2]["l"]:
            out[-1] = _one(out[-1], item)
        else:
            out.append(item)
    for size in range(2, GROUP + 1):
        k = 0
        while k + size <= len(out):
            unit = [i[2]["l"] for i in out[k:k + size]]
            again = 1
            while [i[2]["l"] for i in out[k + again * size:k + (again + 1) * size]] == unit:
                again += 1
            if again > 1 or ("(" + ",".join(unit) + ")") in known:
                new = [1, again > 1, _group(out[k:k + size])]
                for r in range(1, again):
                    new = _one(new, [1, True, _group(out[k + r * size:k + (r + 1) * size])])
                out[k:k + again * size] = [new]
            k += 1
    return out


def align(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two label sequences."""
    if left == right:
        return [(k, k) for k in range(len(left))]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            best[i][j] = (best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1]))
    i = j = 0
    out = []
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def merge(one: dict, two: dict) -> dict:
    """The wrapper that fits what either fits."""
    left, right = one["c"], two["c"]
    groups = [frozenset(i[2]["l"] for i in side if i[2]["l"].startswith("(")) for side in (left, right)]
    if groups[0] - groups[1]:
        right = fold(right, groups[0])
    if groups[1] - groups[0]:
        left = fold(left, groups[1])
    items: list = []
    i = j = 0
    for a, b in [*align([x[2]["l"] for x in left], [x[2]["l"] for x in right]), (len(left), len(right))]:
        items += [[0, many, w] for _, many, w in left[i:a]] + [[0, many, w] for _, many, w in right[j:b]]
        if a < len(left):
            items.append([min(left[a][0], right[b][0]), left[a][1] or right[b][1], merge(left[a][2], right[b][2])])
        i, j = a + 1, b + 1
    return {"l": one["l"], "n": one["n"] + two["n"], "m": one["m"] + two["m"],
            "k": one["k"] + two["k"], "t": one["t"] if one["t"] == two["t"] else None,
            "d": one["d"] if one["d"] == two["d"] else None, "c": items}


# -- main text ------------------------------------------------------------------

def slots(wrapper: dict) -> int:
    """Characters in the slots of a wrapper, without those of skipped blocks."""
    if label_kind(wrapper["l"])[1]:
        return 0
    return (wrapper["m"] if wrapper["t"] is None else 0) + sum(slots(w) for _, _, w in wrapper["c"])


def articles(wrapper: dict) -> bool:
    """Whether the wrapper has an article that is not part of something skipped."""
    return not label_kind(wrapper["l"])[1] and (is_article(wrapper["l"]) or any(articles(w) for _, _, w in wrapper["c"]))


def only_links(wrapper: dict) -> bool:
    """Whether nearly all text of the wrapper is that of links."""
    def sums(w: dict) -> tuple[int, int]:
        inner = [sums(x) for _, _, x in w["c"]]
        return w["k"] + sum(k for k, _ in inner), w["m"] + sum(m for _, m in inner)

    links, every = sums(wrapper)
    return every > 0 and links >= LINK_SHARE * every


def is_content(wrapper: dict, own: frozenset) -> bool:
    """Whether the wrapper has text that is neither skipped nor the host's own.

    Not content are lists of links, and unnamed blocks without inner ones whose
    text changes in its numbers only, such as counters.
    """
    if not has_text(wrapper, own) or only_links(wrapper):
        return False
    counter = wrapper["t"] is None and wrapper["d"] is not None
    return not counter or bool(wrapper["c"]) or wrapper["l"] not in ("div", "center")


def agrees(wrapper: dict | None, own: frozenset) -> bool:
    """Whether the host's wrapper has a block as a list of links, or with the host's own words only."""
    def varies(w: dict) -> bool:
        return (w["t"] is None or bool(w["t"]) and w.get("i") not in own) or any(varies(x) for _, _, x in w["c"])

    return wrapper is not None and (only_links(wrapper) or not varies(wrapper))


def has_text(wrapper: dict, own: frozenset) -> bool:
    if label_kind(wrapper["l"])[1]:
        return False
    return (wrapper["t"] is None or "i" in wrapper and wrapper["i"] not in own
            or any(has_text(w, own) for _, _, w in wrapper["c"]))


def main_path(wrapper: dict, own: frozenset) -> list[str]:
    """Labels from the page to the innermost block that holds all content."""
    path: list[str] = []
    while not (wrapper["t"] is None or "i" in wrapper and wrapper["i"] not in own):
        content = [w for _, _, w in wrapper["c"] if is_content(w, own)]
        if len(content) != 1 or not any(has_text(w, own) for _, _, w in content[0]["c"]):
            break
        wrapper = content[0]
        path.append(wrapper["l"])
    return path


def number(wrapper: dict, first: int = 0) -> int:
    """Gives every literal outside skipped blocks a number "i"; returns the next one."""
    if label_kind(wrapper["l"])[0]:
        return first
    if wrapper["t"]:
        wrapper["i"] = first
        first += 1
    for _, _, inner in wrapper["c"]:
        first = number(inner, first)
    return first


def inner_wrappers(wrapper: dict | None) -> dict[str, dict]:
    """The wrappers of a block's children by label, those in groups too."""
    known: dict[str, dict] = {}
    for _, _, w in wrapper["c"] if wrapper is not None else ():
        for x in [w, *(inner for _, _, inner in w["c"])] if w["l"].startswith("(") else [w]:
            known.setdefault(x["l"], x)
    return known


def literals(block: Block, wrapper: dict, found: set[int]) -> set[int]:
    """Adds the numbers of the wrapper's literals that the page has."""
    if "i" in wrapper and any(isinstance(c, str) and not c.isspace() for c in block.children):
        found.add(wrapper["i"])
    known = inner_wrappers(wrapper)
    for child in block.children:
        if not isinstance(child, str) and child.label in known:
            literals(child, known[child.label], found)
    return found


class Extractor:
    """Takes the main text out of a host's pages.

    ``own`` has the numbers of the literals that are the host's words;
    ``aligned`` says whether the host has enough distinct pages.
    """

    def __init__(self, wrapper: dict, own: frozenset, aligned: bool):
        self.wrapper = wrapper
        self.article = articles(wrapper)
        self.own = own if slots(wrapper) > 0 else frozenset()
        self.path = [] if self.article or not aligned else main_path(wrapper, self.own)

    def text(self, page: str) -> str:
        root = parse(page)
        blocks: list[str] = []
        if self.article and (own := _articles(root, self.wrapper)):
            for block, wrapper in own:
                # the host's words go from an article that has others
                self._walk(block, wrapper if wrapper and has_text(wrapper, self.own) else None, True, blocks)
            return "\n".join(blocks)
        node, wrapper = root, self.wrapper
        for label in self.path:
            inner = [c for c in node.children if not isinstance(c, str) and c.label == label]
            if len(inner) != 1:
                break
            node, wrapper = inner[0], next(w for _, _, w in wrapper["c"] if w["l"] == label)
        self._walk(node, wrapper, False, blocks)
        return "\n".join(blocks)

    def _walk(self, block: Block, wrapper: dict | None, inside: bool, out: list[str]) -> None:
        """Adds the block's texts; a text ends where a block begins or ends."""
        literal = wrapper is not None and wrapper.get("i") in self.own
        known = inner_wrappers(wrapper)
        text: list[str] = []

        def flush() -> None:
            found = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if found and not literal:
                out.append(found)

        for child in block.children:
            if isinstance(child, str):
                text.append(child)
                continue
            if child.label.partition(" ")[0] not in INLINE:  # a skipped inline part does not cut a text
                flush()
            always, outside, hint = label_kind(child.label)
            if (child.label == "br" or always or outside and not inside
                    or hint and agrees(known.get(child.label), self.own)):
                continue
            self._walk(child, known.get(child.label), inside, out)
        flush()


def _articles(block: Block, wrapper: dict | None) -> list[tuple[Block, dict | None]]:
    """The outermost articles, in page order, each with its part of the host's wrapper."""
    if label_kind(block.label)[1]:
        return []
    if is_article(block.label):
        return [(block, wrapper)]
    known = inner_wrappers(wrapper)
    return [a for c in block.children if not isinstance(c, str) for a in _articles(c, known.get(c.label))]


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)),
                      F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (as JSON)."""
    def per_task(batches):
        found: dict[str, dict] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                own = wrapper_of(parse(page or ""))
                found[host] = merge(found[host], own) if host in found else own
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                          pa.array([json.dumps(w) for w in found.values()], pa.string())],
                                         ["host", "wrapper"])

    def per_host(table: pa.Table) -> pa.Table:
        whole = None
        for own in sorted(table.column("wrapper").to_pylist()):
            own = json.loads(own)
            whole = own if whole is None else merge(whole, own)
        number(whole)
        return pa.table([table.column("host").slice(0, 1), pa.array([json.dumps(whole)], pa.string())],
                        names=["host", "wrapper"])

    schema = "host string, wrapper string"
    found = pages.select("host", "html").mapInArrow(per_task, schema)
    # in two steps: a host's wrappers from all tasks would be one group otherwise
    some = (found.withColumn("share", F.spark_partition_id() % SHARES).groupBy("host", "share")
            .applyInArrow(per_host, schema))
    return some.groupBy("host").applyInArrow(per_host, schema)


def own_words(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row per host: host, pages (distinct ones), own (numbers of the literals that are the host's own words).

    The latter stand in most of the host's distinct pages, ``LITERAL_PAGES`` at least.
    Every page is looked at, but only its hash and literals are grouped.
    """
    def run(batches):
        held: dict[str, dict] = {}
        for batch in batches:
            found = []
            for wrapper, page in zip(batch.column("wrapper").to_pylist(), batch.column("html").to_pylist()):
                if wrapper not in held:
                    if len(held) >= 1000:
                        held.clear()
                    held[wrapper] = json.loads(wrapper)
                found.append([-1, *sorted(literals(parse(page or ""), held[wrapper], set()))])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page_hash"),
                                              pa.array(found, pa.list_(pa.int32()))], ["host", "page_hash", "found"])

    seen = (pages.select("host", "html", F.xxhash64("html").alias("page_hash")).join(wrappers, "host")
            .select("host", "page_hash", "html", "wrapper")
            .mapInArrow(run, "host string, page_hash long, found array<int>"))
    counts = (seen.groupBy("host", "page_hash").agg(F.first("found").alias("found"))
              .select("host", F.explode("found").alias("i")).groupBy("host", "i").agg(F.count("*").alias("n")))
    whole = F.max(F.when(F.col("i") == -1, F.col("n")))  # the page itself
    many = F.filter(F.collect_list(F.struct("i", "n")), lambda x: (x["i"] >= 0))
    return (counts.groupBy("host").agg(whole.alias("pages"), many.alias("found"))
            .select("host", "pages", F.expr(f"transform(filter(found, x -> x.n >= {LITERAL_PAGES} AND 2 * x.n > pages), x -> x.i)")
                    .alias("own")))


def extract(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, text, n_chars for every row of ``pages``.

    NULL and empty pages, and pages without main text, have an empty text. Rows
    whose URL has no host (NULL too) share one wrapper. Repeated rows stay
    repeated; other columns are left out.
    """
    pages = pages.select(F.col("page_id").alias("page_id"), "url", "html").withColumn("host", host_of("url"))
    wrappers = stored(infer(pages), "wrappers")
    wrappers = stored(wrappers.join(own_words(pages, wrappers), "host"), "own-words")

    def run(batches):
        held: dict[str, Extractor] = {}
        for batch in batches:
            texts = []
            for host, wrapper, own, many, page in zip(
                    *(batch.column(c).to_pylist() for c in ("host", "wrapper", "own", "pages", "html"))):
                if host not in held:
                    if len(held) >= 1000:
                        held.clear()
                    held[host] = Extractor(json.loads(wrapper), frozenset(own), many >= LITERAL_PAGES)
                texts.append(held[host].text(page or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    return pages.join(wrappers, "host").select("page_id", "url", "html", "host", "wrapper", "own", "pages").mapInArrow(
        run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
