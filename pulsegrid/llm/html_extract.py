"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its element paths (tag, class and id from the root down). Over all pages of a host each token has an
occurrence vector, the counts page by page; tokens with equal vectors form an equivalence class. Vectors are compared by
an order-free fingerprint (sums of hashes), so they never meet in one place and a host may hold any share of the pages. A class is valid
when it occurs on at least ``LEAST_PAGES`` different pages (copies of a page count once); a class whose tokens all lie inside one other valid class nests in
it, and the classes that nest down from the root's are the host's template. Tokens
whose text never varies are the template's own text. What remains are its slots; a content slot is a token of a valid
class that occurs once a page and holds most of the varying unlinked text of the pages that have it, so that each layout
of a host has its own.

``extract`` takes the varying text of the deepest content slot of a page. Article elements (else main elements) only
break ties: where they hold about the slot's text too, theirs is taken, without the template's own. On hosts with too few
different pages the page's article elements decide, else its main element, else the body. Parts that are no article never
count: menus, sidebars, adverts, notices, forms, comments, and scripts and styles. Blocks are joined by one space.

Of slots at equal depth the one of the least path hash is taken. Null and empty pages give empty texts; an empty table gives no rows; broken markup is read to its end; a null url is a host of its own; repeated rows
each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut

LEAST_PAGES = 3
#: Share of the varying text of its pages that a content slot must hold, and of a slot's text that an article element must.
SHARE = 0.6
#: Most paths of all templates that are sent to all executors; beyond it pages and templates are shuffled by host.
BROADCAST_PATHS = 2_000_000

# a quote parts a value only behind the equals sign; elsewhere it is a character like any other
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe svg math object canvas audio video select noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body html div article section main nav aside".split())
# Elements and class, id or role words of what is no article.
BARRED = frozenset("nav aside form button dialog menu head fieldset label input footer".split())
BARRED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup popup modal overlay "
    "sidebar aside related recommended share sharing social breadcrumb breadcrumbs menu nav navigation navbar topnav pagination pager comment comments commentlist disqus reply replies respond reviews widget footer "
    "masthead toolbar login search skip complementary contentinfo".split()
)
#: Of those, words that say so at the end of a name only behind a word of place: a labour notice is a story, a site notice is none.
WEAK_WORDS = frozenset("notice notification alert reply replies respond reviews search skip share sharing social related recommended signup login widget banner overlay aside promotion".split())
PLACE_WORDS = frozenset("site page top bottom left right side inline sticky float floating global user primary secondary header legal post article entry block box js container wrapper".split())
#: A name of its own of this kind marks content, whatever other names an element has.
CONTENT_WORDS = frozenset("content article post entry story main body text".split())
NEVER_BARRED = frozenset("html body main".split())
NEGATIONS = frozenset("has no not with without is".split())
#: Pieces of an article, which are no slots for the whole of it.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl li dt dd blockquote pre figure figcaption".split())
CLOSED_EARLY = frozenset("p li dt dd td th tr option".split())


class Node:
    """An open element; its flags hold for all that is inside it."""

    __slots__ = ("article", "barred", "link", "main", "parent", "path", "slots", "tag")

    def __init__(self, tag: str, path: int, parent: int, barred: bool = False, article: bool = False, main: bool = False, link: bool = False, slots: tuple[int, ...] = ()):
        self.tag, self.path, self.parent, self.barred, self.article, self.main, self.link, self.slots = tag, path, parent, barred, article, main, link, slots


def _hash(parent: int, label: str) -> int:
    h = (parent * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)
    for c in label.encode():
        h = ((h ^ c) * 0x100000001B3) & (2**64 - 1)
    h ^= h >> 29
    return h - 2**64 if h >= 2**63 else h


ROOT = _hash(0, "#page")


def _barring(words: str) -> bool:
    """Whether a class, id or role names what is no article: as a whole, or by its first or last part."""
    names = [[x.lower() for x in PARTS.findall(name)] for name in words.split()]
    if any(parts and all(x in CONTENT_WORDS for x in parts) for parts in names):
        return False
    for parts in names:
        if not parts or parts[0] in NEGATIONS:
            continue
        last = parts[-1] in BARRED_WORDS and (parts[-1] not in WEAK_WORDS or all(x in PLACE_WORDS or x in BARRED_WORDS for x in parts[:-1]))
        if "".join(parts) in BARRED_WORDS or parts[0] in BARRED_WORDS or last:
            return True
    return False


def walk(page: str, slots: frozenset[int] = frozenset()) -> Iterator[tuple[str | None, Node, bool]]:
    """Texts in page order with their element, which knows the slots around it, outermost first.

    A None text is the edge of a block; the flag is set where an element starts.
    """
    stack = [Node("#page", ROOT, 0, slots=(ROOT,) if ROOT in slots else ())]
    known: dict[tuple[int, str, str], tuple[int, bool, bool, bool]] = {}
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            yield html_lib.unescape(text), stack[-1], False
        if not m:
            return
        at = m.end()
        if m["cdata"]:
            yield m["cdata"], stack[-1], False
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        inline = tag in INLINE
        if not inline:
            yield None, stack[-1], False
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if inline and stack[k].tag not in INLINE or tag in CLOSED_EARLY and stack[k].tag in SCOPES:
                    break
            continue
        if not inline and tag not in VOID:  # a block ends an open paragraph, and an item the item before it
            ends = CLOSES.get(tag, frozenset()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        top = stack[-1]
        raw = m["attrs"]
        key = (top.path, tag, raw)
        made = known.get(key)
        if made is None:
            attrs = {k.lower(): (x or y or z) for k, x, y, z in ATTRIBUTE.findall(raw)} if raw.strip() else {}
            name = " ".join(x for x in (attrs.get("class"), attrs.get("id")) if x)
            role = (attrs.get("role") or "").lower()
            path = top.path if inline else _hash(top.path, f"{tag} {DIGITS.sub('0', name)}" if name else tag)
            barring = tag in BARRED or "hidden" in attrs or tag not in NEVER_BARRED and _barring(f"{name} {role}")
            made = known[key] = (path, barring, tag == "main" or role == "main", "header" in role or tag == "header")
        path, barring, main, header = made
        article = top.article or tag == "article" and not barring
        node = Node(tag, path, top.path, top.barred or barring or header and not article, article, top.main or main, top.link or tag == "a", (*top.slots, path) if path in slots and not inline and tag not in PIECES else top.slots)
        yield "", node, not inline
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not raw.rstrip().endswith("/"):
            stack.append(node)


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def host_of(url: str | None) -> str:
    """Host of an address in lower case; empty where there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def observed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page and path, with the page's fingerprint and its share of the path's occurrence vector.

    Pages of one host with equal fingerprints are copies of one page, whatever their menus and adverts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(a, 64).to_pylist():
                    host, page = host_of(r["url"]), r["html"] or ""
                    found = structure(page)
                    seed, whole = fingerprint(found), sum(row[2] for row in found.values())
                    for path, (parent, n, chars, linked, text) in found.items():
                        rows.append((host, seed, path, parent, n, _hash(seed, str(n)), chars, linked, text, whole))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["host", "page", "path", "parent", "n", "vector", "chars", "linked", "text", "whole"])

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, "host string, page bigint, path bigint, parent bigint, n bigint, vector bigint, chars bigint, linked bigint, text bigint, whole bigint")


def structure(page: str) -> dict[int, list]:
    """Of each path: its parent's path, occurrences, length of its text, of its linked or barred text, and a hash of both."""
    found: dict[int, list] = {ROOT: [0, 1, 0, 0, 0]}
    for text, node, starts in walk(page):
        if starts:
            row = found.setdefault(node.path, [node.parent, 0, 0, 0, 0])
            row[1] += 1
        elif text and (words := " ".join(text.split())):
            row = found.setdefault(node.path, [node.parent, 0, 0, 0, 0])
            row[3 if node.link or node.barred else 2] += len(words)
            row[4] = zlib.crc32(words.encode("utf-8", "replace"), row[4])
    return found


def fingerprint(found: dict[int, list]) -> int:
    """Of the places and texts of a page that are neither linked nor barred."""
    own = hashlib.blake2b(repr(sorted((path, chars, text) for path, (_, _, chars, _, text) in found.items() if chars)).encode(), digest_size=8)
    return int.from_bytes(own.digest(), "big", signed=True)


def _ancestry(path: int, parent: dict[int, int]) -> list[int]:
    """The path and those around it, innermost first."""
    steps: list[int] = []
    while path in parent and path not in steps:
        steps.append(path)
        path = parent[path]
    return steps


def _nested(parent: dict[int, int], vector: dict[int, int]) -> set[int]:
    """Vectors of the classes that nest, each in one other, down from the root's class."""
    outer: dict[int, set[int]] = {}
    for path, own in vector.items():
        around = next((vector[up] for up in _ancestry(path, parent) if vector[up] != own), None)
        if around is not None:
            outer.setdefault(own, set()).add(around)
    nested = {vector[ROOT]}
    while more := {own for own, around in outer.items() if own not in nested and len(around) == 1 and around <= nested}:
        nested |= more
    return nested


TEMPLATE = "host string, slots array<bigint>, fixed array<bigint>"


def templates(seen: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """One row for each host: its content slots, and the paths whose text is the template's own."""
    once = seen.groupBy("host", "page", "path").agg(F.min("parent").alias("parent"), *[F.max(c).alias(c) for c in ("n", "vector", "chars", "linked", "text", "whole")])
    tokens = once.groupBy("host", "path").agg(
        F.min("parent").alias("parent"), F.count("*").alias("pages"), F.max("n").alias("most"), F.sum(F.shiftright("vector", 32)).alias("_high"), F.sum(F.col("vector").bitwiseAND(F.lit(2**32 - 1))).alias("_low"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("whole").alias("whole"), F.min("text").alias("low"), F.max("text").alias("high")
    )
    # sums of hashes: equal for equal vectors in any order of the pages
    valid = tokens.where(F.col("pages") >= least).withColumn("vector", F.xxhash64("_high", "_low")).drop("_high", "_low")

    def deduce(table: pa.Table) -> pa.Table:
        t = table.to_pandas()
        host = t["host"].iloc[0]
        own = (t["chars"] + t["linked"] > 0) & (t["low"] == t["high"])
        slots: list[int] = []
        if (t["path"] == ROOT).any():
            parent = dict(zip(t["path"], t["parent"], strict=True))
            vector = dict(zip(t["path"], t["vector"], strict=True))
            nested = _nested(parent, vector)
            held: dict[int, float] = {}
            for path, chars in zip(t["path"], np.where(own, 0, t["chars"]), strict=True):
                for up in _ancestry(path, parent):
                    held[up] = held.get(up, 0) + chars
            pages = t["pages"].max()
            everywhere = t.loc[own & (t["pages"] == pages), "chars"].sum() / pages  # the template's own text on each page
            for path, n, most, whole in zip(t["path"], t["pages"], t["most"], t["whole"], strict=True):
                if most == 1 and vector[path] in nested and held[path] >= share * (whole - n * everywhere) and held[path] > 0:
                    slots.append(path)
        return pa.table({"host": pa.array([host]), "slots": pa.array([slots], pa.list_(pa.int64())), "fixed": pa.array([t.loc[own, "path"].tolist()], pa.list_(pa.int64()))})

    return valid.groupBy("host").applyInArrow(deduce, TEMPLATE)


def main_text(page: str, slots: frozenset[int] = frozenset(), fixed: frozenset[int] = frozenset(), share: float = SHARE) -> str:
    """Text of the article of one page, by the content slots and the fixed paths of its host's template."""
    article: list[str] = []
    main: list[str] = []
    body: list[str] = []
    slot: dict[int, list[str]] = {}
    depth: dict[int, int] = {}
    for text, node, _ in walk(page, slots):
        for k, own in enumerate(node.slots):
            slot.setdefault(own, [])
            depth[own] = k
        if text is None:
            for part in (article, main, body, *slot.values()):
                part.append(" ")
        elif text and not node.barred and node.path not in fixed:
            body.append(text)
            if node.article:
                article.append(text)
            if node.main:
                main.append(text)
            for own in node.slots:
                slot[own].append(text)
    marked = squeezed(article) or squeezed(main)
    for own in sorted(slot, key=lambda k: (-depth[k], k)):
        if got := squeezed(slot[own]):
            return marked if len(marked) >= share * len(got) else got
    return marked or squeezed(body)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = cut(templates(observed(pages, url, html)))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint"

    def texts(rows: list[dict], of_host) -> pa.RecordBatch:
        out = [main_text(r["html"] or "", *of_host(r)) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], own_type), pa.array([r["url"] for r in rows], pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own_type = pa.int64() if kind in ("bigint", "int") else pa.string()
    held = found.agg(F.coalesce(F.sum(F.size("slots") + F.size("fixed") + 8), F.lit(0))).first()[0]
    if held <= BROADCAST_PATHS:
        known = {r["host"]: (frozenset(r["slots"]), frozenset(r["fixed"])) for r in found.toLocalIterator()}
        sent = pages.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            templates_of = sent.value
            for batch in batches:
                for a in range(0, batch.num_rows, 64):
                    yield texts(batch.slice(a, 64).to_pylist(), lambda r: templates_of.get(host_of(r["url"]), (frozenset(), frozenset())))

        return own.mapInArrow(run, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("host", pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string()))

    joined = own.mapInArrow(named, f"page_id {kind}, url string, html string, host string").join(found, "host", "left").drop("host")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                yield texts(batch.slice(a, 64).to_pylist(), lambda r: (frozenset(r["slots"] or ()), frozenset(r["fixed"] or ())))

    return joined.mapInArrow(run_joined, schema)
