"""Main text of web pages with wrappers inferred per host.

A page is a stream of tags and texts. Inside a page, neighbouring copies of a token group
become one repeated group. The streams of one host are then aligned with each other: equal
tokens stay, texts that differ become slots, what only some pages have becomes an optional
group. The result is a union-free regular expression, the host's wrapper. Its fixed texts
are template if pages that differ have them (copies of a page count as one); the region whose repeated groups and slots hold most of the changing text
is where the host keeps its articles.

Extraction reads each whole page with its host's wrapper: it takes the blocks of the
article region, leaves out elements that are menus, notices, adverts, forms, comments and
the like by tag, role or class word, and, where a host marks no article region, the
template texts.

Inference uses every page. Tasks reduce pages to wrappers (one per host and shape), which are
then merged, first within (host, part), then within the host, so a host that owns a
third of the pages costs no task more than its share of small wrappers.

Nulls and odd input: a null or empty page has the empty text; a null url belongs to the host
of unnamed pages; repeated rows are extracted one by one; unclosed and unopened tags
are tolerated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark.llm.common import Scratch, texts

# HTML elements and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas", "title")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
ARTICLE = ("article", "main")
LEFT_OUT = frozenset("nav footer aside form button dialog menu head".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: A class name that starts so tells what an element has, not what it is.
DESCRIBING = frozenset("has with without no is".split())
CONTENT_WORDS = frozenset("article content entry main post story text body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Longest group of tokens looked for as a repeated one.
PERIOD = 16
#: Wrappers a task holds before it sends them on, and parts a host's wrappers are merged in first.
FLUSH, PARTS = 20_000, 64
TEXT = "#"


#: Whether an element is left out: no, only outside an article (headers), always.
KEPT, HEADING, OUT = range(3)


def _by_words(value: str) -> int:
    """What class names or an id say: the first or last word of a name tells its purpose ("ad-slot", "top-menu")."""
    found = KEPT
    for name in value.split():
        words = _WORDS.findall(name)
        if words and words[0] not in DESCRIBING:
            for word in {words[0], words[-1]} & LEFT_OUT_WORDS:
                found = max(found, HEADING if word == "header" else OUT)
    return found


def _symbol(tag: str, attributes: str) -> tuple[str, int]:
    """(tag with its first class or id, whether the element is left out)."""
    tag = tag.lower()
    label, out = "", HEADING if tag == "header" else OUT if tag in LEFT_OUT else KEPT
    if attributes and not attributes.isspace():
        for name, *values in _NAMED.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                out = max(out, OUT if value in LEFT_OUT_ROLES else KEPT)
                tag = "main" if value == "main" else tag
                continue
            first = value.split(" ")[0]
            # Of an article only the first name counts: the others often tell what it has.
            out = max(out, _by_words(first if tag in ARTICLE else value))
            label = label or first
    return (f"{tag}.{label}" if label else tag), KEPT if tag in ("html", "body") else out


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, left out): kind ``<`` opens the element ``value``, ``>`` closes, ``#`` is text."""
    for match in _TOKEN.finditer(page):
        tag = match["tag"]
        if tag:
            if match["close"]:
                yield ">", tag.lower(), KEPT
            else:
                symbol, out = _symbol(tag, match["attributes"])
                yield "<", symbol, out
                if match["attributes"].endswith("/") and tag.lower() not in VOID and symbol.split(".")[0] in ("svg", "math"):
                    yield ">", tag.lower(), KEPT
        elif match["text"]:
            yield TEXT, match["text"], KEPT


def squeezed(text: str) -> str:
    return " ".join(references.unescape(text).split())


# -- wrappers ---------------------------------------------------------------------------
# A node is [symbol, value] or [kind, nodes]; the kinds of groups are "+" (repeated) and "?" (optional). A text
# node has the symbol "#", as value the checksum of its text, or None for a slot, and the page it is of, by the
# checksum of that page's nodes, or "" if pages that differ have it.


def _key(node: list) -> str:
    return node[0] if node[0] not in "+?" else f"{node[0]}({' '.join(map(_key, node[1]))})"


def _unified(a: list, b: list) -> list:
    """Two nodes with equal keys as one; texts that differ become a slot."""
    if a[0] in "+?":
        return [a[0], [_unified(x, y) for x, y in zip(a[1], b[1], strict=True)]]
    if a[0] != TEXT:
        return a
    if a[1] != b[1]:
        return [TEXT, None, ""]
    return a if a[2] == b[2] else [TEXT, a[1], ""]


def collapsed(nodes: list[list]) -> list[list]:
    """``nodes`` with neighbouring copies of a group made one repeated group, short groups first, until nothing changes."""
    keys = [_key(n) for n in nodes]
    changed = True
    while changed:
        changed = False
        for period in range(1, PERIOD + 1):
            if not any(map(str.__eq__, keys, keys[period:])) and not any(k[0] == "+" for k in keys):
                continue
            out: list[list] = []
            out_keys: list[str] = []
            size, i = len(nodes), 0
            last: list[str] = []  # keys of the body of the repeated group that ``out`` ends with
            while i < size:
                key, end = keys[i], i + period
                if last and key == last[0] and keys[i:end] == last:
                    out[-1] = ["+", [_unified(x, y) for x, y in zip(out[-1][1], nodes[i:end], strict=True)]]
                    i, changed = end, True
                    continue
                if end < size and keys[end] == key and key != TEXT and keys[end : end + period] == keys[i:end]:
                    group, body = keys[i:end], nodes[i:end]
                    while keys[end : end + period] == group:
                        body = [_unified(x, y) for x, y in zip(body, nodes[end : end + period], strict=True)]
                        end += period
                    whole = period == 1 and key[0] == "+"
                    out.append(body[0] if whole else ["+", body])
                    out_keys.append(key if whole else f"+({' '.join(group)})")
                    last = [] if whole else group
                    i, changed = end, True
                    continue
                out.append(nodes[i])
                out_keys.append(key)
                last = [_key(x) for x in nodes[i][1]] if key[0] == "+" and len(nodes[i][1]) == period else []
                i += 1
            nodes, keys = out, out_keys
    return nodes


def stream(page: str) -> list[list]:
    """The nodes of a page."""
    nodes = []
    for kind, value, _ in tokens(page):
        if kind != TEXT:
            nodes.append([kind + value, None])
        elif not value.isspace():
            nodes.append([TEXT, md5(squeezed(value).encode()).hexdigest()[:12]])
    page = md5(" ".join(n[1] or n[0] for n in nodes).encode()).hexdigest()[:12]
    return collapsed([[*n, page] if n[0] == TEXT else n for n in nodes])


def _opened(nodes: list[list], optional: bool = False) -> list[tuple[list, bool]]:
    """Nodes outside optional groups, each with whether it was in one."""
    out = []
    for node in nodes:
        out += _opened(node[1], True) if node[0] == "?" else [(node, optional)]
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of what two wrappers describe: common nodes unified, runs of other nodes optional."""
    left, right = _opened(a), _opened(b)
    out: list[tuple[list, bool]] = []
    keys = [[_key(n) for n, _ in side] for side in (left, right)]
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(_unified(x, y), p or q) for (x, p), (y, q) in zip(left[a0:a1], right[b0:b1], strict=True)]
        else:
            out += [(n, True) for n, _ in left[a0:a1] + right[b0:b1]]
    grouped: list[list] = []
    for node, optional in out:
        if not optional:
            grouped.append(node)
        elif grouped and grouped[-1][0] == "?":
            grouped[-1][1].append(node)
        else:
            grouped.append(["?", [node]])
    return grouped


def merged(shapes: dict[str, list[list]], more: list[list]) -> None:
    """Adds a wrapper to wrappers by shape."""
    shape = md5(" ".join(map(_key, more)).encode()).hexdigest()
    held = shapes.get(shape)
    shapes[shape] = more if held is None else [_unified(x, y) for x, y in zip(held, more, strict=True)]


def one(shapes: dict[str, list[list]]) -> list[list]:
    """The wrapper of all shapes, aligned one after the other in a fixed order, repeated groups found again."""
    found: list[list] = []
    for i, shape in enumerate(sorted(shapes)):
        found = collapsed(aligned(found, shapes[shape])) if i else shapes[shape]
    return found


def _symbols(name: str, nodes: list[list], weight: int, state: dict) -> None:
    """Counts slots and fixed texts by open element. ``state``: open elements, slots by element, fixed texts."""
    for node in nodes:
        symbol = node[0]
        if symbol in "+?":
            _symbols(name, node[1], weight * (4 if symbol == "+" else 1), state)
        elif symbol == TEXT:
            if node[1] is None:
                for element in set(state["open"]):
                    state["slots"][element] = state["slots"].get(element, 0) + weight
            elif not node[2]:  # what one page alone has may be its article
                state["fixed"].append(node[1])
        elif symbol[0] == "<":
            if symbol[1:].split(".")[0] not in VOID:
                state["open"].append(symbol[1:])
        else:
            tags = [x.split(".")[0] for x in state["open"]]
            if symbol[1:] in tags:
                del state["open"][len(tags) - 1 - tags[::-1].index(symbol[1:]) :]


def described(nodes: list[list]) -> tuple[str, list[str]]:
    """(article region, fixed texts) of a wrapper. The region is an element symbol, or empty if the host marks none."""
    state: dict = {"open": [], "slots": {}, "fixed": []}
    _symbols("", nodes, 1, state)
    regions = {}
    for element, slots in state["slots"].items():
        tag, _, label = element.partition(".")
        words = set(_WORDS.findall(label))
        if words & LEFT_OUT_WORDS:
            continue
        if tag in ARTICLE:
            regions[element] = (2, slots)
        elif tag in ("div", "section", "td") and words & CONTENT_WORDS:
            regions[element] = (1, slots)
    best = max(regions, key=lambda e: (regions[e], e), default="")
    # Without any slot outside the fixed texts (copies of one page) nothing is known to be template.
    return best, sorted(set(state["fixed"])) if state["slots"] else []


def _reduce_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) -> (host, part, pages, wrapper), one per host and shape of this task."""
    part = TaskContext.get().partitionId() % PARTS
    held: dict[str, dict[str, list[list]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(host, part, json.dumps(w)) for host, shapes in held.items() for w in shapes.values()]
        kinds = (pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "part", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if page:
                shapes = held.setdefault(host, {})
                size -= len(shapes)
                merged(shapes, stream(page.decode("utf-8", "replace")))
                size += len(shapes)
                if size >= FLUSH:
                    yield out()
                    held.clear()
                    size = 0
    if held:
        yield out()


def _merge_part(group: pd.DataFrame) -> pd.DataFrame:
    """All wrappers of (host, part) as one."""
    shapes: dict[str, list[list]] = {}
    for wrapper in group["wrapper"]:
        merged(shapes, json.loads(wrapper))
    return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(one(shapes))]})


def _merge_host(group: pd.DataFrame) -> pd.DataFrame:
    shapes: dict[str, list[list]] = {}
    for wrapper in group["wrapper"]:
        merged(shapes, json.loads(wrapper))
    wrapper = one(shapes)
    region, fixed = described(wrapper)
    return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(wrapper)], "region": [region], "fixed": [fixed]})


def host_of(url: str) -> Column:
    """The host of a url, lower-cased; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, region, fixed): one wrapper per host, as JSON, and what extraction needs of it."""
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))
    parts = rows.mapInArrow(_reduce_pages, "host string, part int, wrapper string")
    halves = parts.groupBy("host", "part").applyInPandas(_merge_part, "host string, wrapper string")
    return halves.groupBy("host").applyInPandas(_merge_host, "host string, wrapper string, region string, fixed array<string>")


# -- extraction -------------------------------------------------------------------------


def main_text(page: str, region: str = "", fixed: frozenset[str] = frozenset()) -> str:
    """The blocks of the article region, joined by line ends."""
    found = _blocks(page, lambda symbol: symbol == region) if region else []
    found = found or _blocks(page, lambda symbol: symbol.split(".")[0] in ARTICLE)
    if not found:
        found = [b for b in _blocks(page, None) if md5(b.encode()).hexdigest()[:12] not in fixed]
    return "\n".join(found)


def _blocks(page: str, wanted) -> list[str]:
    """Blocks inside elements that ``wanted`` accepts (anywhere, if None) and outside elements that are left out."""
    blocks: list[str] = []
    piece: list[str] = []
    # Open elements: tag, and what was the case outside: whether left out, how many wanted ones are open.
    open_: list[tuple[str, bool, int]] = []
    out, inside = False, 0

    def flush() -> None:
        if piece:
            block = squeezed("".join(piece))
            if block:
                blocks.append(block)
            piece.clear()

    for kind, value, left_out in tokens(page):
        if kind == TEXT:
            if not out and (inside or wanted is None):
                piece.append(value)
            continue
        tag = value.split(".")[0]
        if tag == "br":
            piece.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if kind == "<":
            if tag in VOID:
                continue
            if tag == "p" and open_ and open_[-1][0] == "p":
                _, out, inside = open_.pop()
            open_.append((tag, out, inside))
            if wanted is not None and wanted(value) and not left_out:
                # An article does not stand inside an advert: an element left out was not closed.
                inside, out = inside + 1, False
            elif left_out == OUT or left_out == HEADING and not inside:
                out = True
        else:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    _, out, inside = open_[k]
                    del open_[k:]
                    break
    flush()
    return blocks


@F.arrow_udf(T.StringType())
def _extracted(html: pa.Array, region: pa.Array, fixed: pa.Array) -> pa.Array:
    rows = zip(texts(html), region, fixed, strict=True)
    return pa.array([main_text(page.decode("utf-8", "replace"), r.as_py() or "", frozenset(f.as_py() or ())) for page, r, f in rows], pa.string())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(``key``, ``url``, text, n_chars) for every row.

    The table of hosts is written first, so Spark knows its size: a small one is sent whole
    and no page is shuffled; beside a large one, pages are joined by host.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    found = scratch.put(wrappers(pages, url, html).select(F.col("host").alias("of"), "region", "fixed"), "hosts")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    return (
        rows.join(found, rows["host"] == found["of"], "left")
        .select("key", "url", _extracted("html", "region", "fixed").alias("text"))
        .select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
    )
