"""Main text of web pages by equivalence-class template deduction.

1. Every page is read as a sequence of tokens: tags told apart by their path, and whole text blocks.
2. A token's occurrence vector says how often it occurs on each page of the host. Vectors are kept as
   a hash, summed over pages with map-side combine, so that no host is gathered anywhere.
3. Tokens of one host with the same vector are an equivalence class. Classes of ``least_tokens`` tokens
   on at least ``least_support`` pages, and a hundredth of the host's, are valid; they nest by the paths
   of their tags, from the root class, once on every page, down to the classes inside its slots, such
   as those of one language or section. Text blocks in a valid class are template, inside an article
   as well; text at any other place fills a slot.
4. Of the slots, the main text is what is left: slots in menus, headers, footers, forms and the like
   (by element, role, class and id) go; names and forms go only where they fit what they hold. Where pages mark no article, the classes on
   at least ``least_share`` of the host's pages say where it is: from the root down to the class that
   holds most of the slots' text outside links.

Pages of a host that show the same text are one page of steps 2 and 3, whatever their addresses: what
they share is not yet a template. Hosts with fewer than ``least_pages`` such pages have no template, only
step 4 applies to them. If template texts hold more than half of a page's main text, they
are its own content (a mirror or an error page with another date) and stay. Null html is empty and has
an empty text; a null url has no host. Repeated rows get their text each; extra columns are ignored. Unclosed elements and comments end where an HTML parser would end them, or with the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import mixed, slices
from lexloom.llm.url_filter import host_of
from lexloom.session import cut_lineage

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MAY_TELL = re.compile(r"class|id|role|hidden|style", re.I).search
_TELLING = frozenset("class id role hidden aria-hidden style".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template svg xmp".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these ends an open paragraph; the others end an open element of their kind.
_ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div footer form header html main nav ol section table ul dl".split())
_NEVER_MAIN = frozenset("head nav aside footer button select dialog menu object canvas video audio".split()) | _RAW
_NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_NEVER_NAME = frozenset(
    """ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent
    gdpr notice notices alert sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead
    comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter
    subscribe subscription signup popup modal overlay toolbar pagination pager login search""".split()
)
_PAGE_HEAD = frozenset({"header"})
#: Words that hold readers' or sellers' text whatever its length, if a name says nothing else.
_FOREIGN = frozenset("ad ads adv advert adverts advertisement adsense sponsor sponsored cookie cookies consent gdpr comment comments commentlist reply replies respond disqus".split())
_PLACES = frozenset("area block box container content inner list main section thread wrap wrapper".split())
#: An element named so holds at most this share of the text that it stands in.
SMALL = 0.1
_STATS = "host string, token string, vector long, pages long, chars long, links long"
_TEMPLATE = "host string, texts array<string>, main string"


@dataclass
class Block:
    path: str
    text: str
    links: int
    out: bool
    article: bool
    named: tuple[int, ...] = ()


@dataclass
class _Element:
    tag: str
    path: str
    out: bool
    article: bool
    named: tuple[int, ...] = ()


@dataclass
class _Named:
    """A form, or an element whose name says that it is not main text."""

    path: str
    foreign: bool
    inside: tuple[int, ...]
    article: bool
    holds_article: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    tags: dict[str, int] = field(default_factory=dict)
    named: list[_Named] = field(default_factory=list)


def _named(tag: str, attributes: str, article: bool) -> tuple[str, bool, bool, bool]:
    """A name for the path, whether the attributes say that this is not main text, whether its name does,
    and whether its name says nothing but that it is others' text."""
    name, out, named, foreign = tag, False, False, False
    if attributes and _MAY_TELL(attributes):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key not in _TELLING:
                continue
            if key in ("class", "id"):
                for one in value.split():
                    words = {w.lower() for w in _PARTS.findall(one)}
                    named |= bool(words & _NEVER_NAME) or (not article and bool(words & _PAGE_HEAD))
                    foreign |= bool(words & _FOREIGN) and words <= _NEVER_NAME | _PLACES
                name += ("." if key == "class" else "#") + re.sub(r"\d+", "0", value)
            elif key == "role":
                out |= value.lower() in _NEVER_ROLE
                name += f"[{value}]" if value in ("main", "article") else ""
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out = True
            elif key == "style":
                out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return name, out, named, foreign


def _judge_names(page: _Page, main: str) -> None:
    """Names and forms decide only where they fit what they hold.

    A named element is no main text if it is small in what it stands in, or if its name says that the
    text is others'. It does not count where it holds the page's only article or the template's main
    path, or, whatever its name, nearly all text of the page.
    """
    if not page.named:
        return
    free = any(b.article and not b.out and not b.named for b in page.blocks)
    free = free or any(b.article and not b.out and not any(page.named[k].holds_article for k in b.named) for b in page.blocks)
    total, article, held = 0, 0, [0] * len(page.named)
    for b in page.blocks:
        if not b.out:
            total += len(b.text)
            article += len(b.text) * b.article
            for k in b.named:
                held[k] += len(b.text)
    stands: list[bool] = []
    for k, one in enumerate(page.named):
        whole = article if one.article else total
        wins = one.holds_article and not free or main and (main == one.path or main.startswith(one.path + "/"))
        if one.foreign:
            stands.append(not wins and held[k] <= (1 - SMALL) * whole)
        elif one.holds_article:
            stands.append(not wins)
        else:
            stands.append(not wins and held[k] <= max(SMALL * whole, _links_most(page, k)))
    for b in page.blocks:
        if b.named:
            b.out |= any(stands[k] for k in b.named)


def _links_most(page: _Page, k: int) -> float:
    """Infinite for an element that is mostly links, as menus and lists of related pages are."""
    mine = [b for b in page.blocks if not b.out and k in b.named]
    return math.inf if 2 * sum(min(b.links, len(b.text)) for b in mine) > sum(len(b.text) for b in mine) else 0


def read_page(source: str, main: str = "") -> _Page:
    page = _Page()
    stack = [_Element("", "", False, False)]
    pieces: list[str] = []
    links = 0

    def close_block() -> None:
        nonlocal links
        text = "".join(pieces)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            block = next((e for e in reversed(stack) if e.tag not in _INLINE), stack[0])
            page.blocks.append(Block(block.path, text, links, block.out, block.article, block.named))
        pieces.clear()
        links = 0

    def pop(position: int) -> None:
        if any(e.tag not in _INLINE for e in stack[position:]):
            close_block()
        del stack[position:]

    def end(tags, stop) -> None:
        for position in range(len(stack) - 1, 0, -1):
            if stack[position].tag in tags:
                pop(position)
                return
            if stack[position].tag in stop:
                return

    at = 0
    while True:
        found = _MARKUP.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            pieces.append(text)
            if any(e.tag == "a" for e in stack):
                links += len(text)
        if not found:
            break
        at = found.end()
        if not found[1]:
            continue
        tag = found[1].lower()
        if found[0][1] == "/":
            end({tag}, () if tag in ("body", "html", "article", "main") else {"article", "main", "body"} - {tag})
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in _INLINE:
            if tag in _ENDS_PARAGRAPH:
                end({"p"}, _SCOPE)
            if tag in _ENDS:
                end(_ENDS[tag], _SCOPE)
            close_block()
        up = stack[-1]
        name, out, named, foreign = _named(tag, found[2], up.article)
        if tag in ("html", "body", "article", "main"):
            out, named = out and tag == "article", named and tag == "article"
        marked = tag in ("article", "main") or name is not tag and ("[main]" in name or "[article]" in name)
        article = up.article or marked
        out = up.out or out or tag in _NEVER_MAIN or (tag == "header" and not up.article)
        path = up.path if tag in _INLINE else f"{up.path}/{name}"
        page.tags[path] = page.tags.get(path, 0) + (tag not in _INLINE)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else len(source)
            continue
        if tag in _VOID or found[2].endswith("/") and tag in ("path", "rect", "circle", "use"):
            continue
        inside = up.named
        if marked and not out:
            for k in inside:
                page.named[k].holds_article = True
        if (named or tag == "form") and not out and tag not in _INLINE:
            page.named.append(_Named(path, foreign, inside, up.article, marked))
            inside = (*inside, len(page.named) - 1)
        elif named:
            out = True
        stack.append(_Element(tag, path, out, article, inside))
    close_block()
    _judge_names(page, main)
    return page


def _text_token(block: Block) -> str:
    return f"{block.path}|{crc32(block.text.encode('utf-8', 'surrogatepass')):08x}{len(block.text)}"


def _counted(batches):
    """Occurrence statistics of the tokens, summed over the pages of a slice."""
    for batch in slices(batches, "html", 16 << 20):
        found: dict[tuple[str, str], list[int]] = {}
        for host, page_code, source in zip(batch.column("host").to_pylist(), batch.column("code").to_pylist(), batch.column("html")):
            page = read_page(source.as_py() or "")
            counts = dict(page.tags)
            for block in page.blocks:
                counts[_text_token(block)] = counts.get(_text_token(block), 0) + 1
            keys = list(counts)
            codes = mixed(np.full(len(keys), page_code).view(np.uint64) + np.fromiter(counts.values(), np.uint64, len(keys)))
            for key, code in zip(keys, codes.view(np.int64).tolist()):
                mine = found.setdefault((host, key), [0, 0, 0, 0])
                mine[0] ^= code
                mine[1] += 1
            for block in page.blocks:
                if not block.out:
                    mine = found.setdefault((host, block.path), [0, 0, 0, 0])
                    mine[2] += len(block.text)
                    mine[3] += min(block.links, len(block.text))
        rows = [(*key, *value) for key, value in found.items()]
        if rows:
            types = [pa.string(), pa.string(), *[pa.int64()] * 4]
            names = [c.split()[0] for c in _STATS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def template_of(tokens: list[tuple[str, int, int, int]], least_tokens: int, most: float = 0.7, partial: frozenset[int] = frozenset()) -> tuple[list[str], str]:
    """Template texts and main path from a host's frequent tokens (token, vector, chars, links).

    Tags of valid classes are the nodes of the template, under the node of the longest path before theirs.
    The vectors in ``partial`` are of classes on a part of the pages: they are valid if they lie under a
    tag of another valid class, and do not say where the main text is.
    """
    classes: dict[int, list[str]] = {}
    for token, vector, _, _ in tokens:
        classes.setdefault(vector, []).append(token)
    valid = {t for v, members in classes.items() if v not in partial and len(members) >= least_tokens for t in members}
    whole = set(valid)
    tops = {v: min((t.partition("|")[0] for t in classes[v]), key=lambda p: p.count("/")) for v in classes.keys() & partial}
    for v in sorted(tops, key=lambda v: tops[v].count("/")):
        up = [tops[v]] if any(t.startswith(tops[v] + "|") for t in classes[v]) else []
        while (rest := (up[-1] if up else tops[v]).rpartition("/")[0]):
            up.append(rest)
        if len(classes[v]) >= least_tokens and any(p in valid for p in up):
            valid |= set(classes[v])
    texts = sorted(t for t in valid if "|" in t)
    valid = whole
    nodes = {t: c - n for t, v, c, n in tokens if "|" not in t and v not in partial}
    inside: dict[str, int] = {}
    children: dict[str, list[str]] = {}
    for path in sorted(nodes, key=lambda p: -p.count("/")):
        inside[path] = inside.get(path, 0) + nodes[path]
        up = path.rpartition("/")[0]
        while up and up not in nodes:
            up = up.rpartition("/")[0]
        children.setdefault(up, []).append(path)
        inside[up] = inside.get(up, 0) + inside[path]
    main = ""
    while True:
        below = [c for c in children.get(main, ()) if c in valid and inside[c] > most * inside[main]]
        if not below or not inside[main] or nodes.get(main, 0) > (1 - most) * inside[main]:
            return texts, main
        main = max(below, key=lambda c: inside[c])


def _templates(least_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(k).to_pylist() for k in ("token", "vector", "chars", "links"))))
        part = pc.invert(table.column("wide"))
        texts, main = template_of(sorted(rows), least_tokens, partial=frozenset(table.column("vector").filter(part).to_pylist()))
        return pa.table(
            {"host": pa.array([table.column("host")[0].as_py()], pa.string()), "texts": pa.array([texts], pa.list_(pa.string())), "main": pa.array([main], pa.string())}
        )

    return run


def main_text(source: str, texts: frozenset[str], main: str) -> str:
    """The slots of a page that hold its article, one block to a line."""
    shown = [b for b in read_page(source, main).blocks if not b.out]
    below = [b for b in shown if b.article]
    if not below and main:
        below = [b for b in shown if b.path == main or b.path.startswith(main + "/")]
    shown = below or shown
    blocks = [b for b in shown if _text_token(b) not in texts] if texts else shown
    if 2 * sum(len(b.text) for b in blocks) < sum(len(b.text) for b in shown):
        blocks = shown
    return "\n".join(b.text for b in blocks)


def _extracted(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 8 << 20):
        known: dict[str, frozenset[str]] = {}
        out = []
        for host, source, texts, main in zip(
            batch.column("host").to_pylist(), batch.column("html"), batch.column("texts"), batch.column("main").to_pylist()
        ):
            if host not in known:
                known[host] = frozenset(texts.as_py() or ())
            out.append(main_text(source.as_py() or "", known[host], main or ""))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


#: What a page does not show: comments, scripts, styles and tags.
_NOT_SHOWN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>"


def _distinct_pages(rows: DataFrame) -> DataFrame:
    """One row for each text that a host shows, with ``code``, which follows from the text.

    Digests and ids meet; html is moved only for rows that repeat page_id and url as well.
    """
    shown = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), _NOT_SHOWN, " "), r"\s+", " "))
    rows = rows.filter("host <> ''").withColumn("digest", F.md5(shown))
    first = F.struct("page_id", "url", "html_code", "rows")
    kinds = (
        rows.groupBy("host", "digest", "page_id", "url", F.xxhash64("html").alias("html_code")).agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("host", "digest").agg(F.min(first).alias("first"), F.sum("rows").alias("copies")).filter("copies > 1")
    )
    kinds = cut_lineage(kinds.select("host", "digest", "first"))
    same = [F.col(f"first.{c}").eqNullSafe(F.col(c)) for c in ("page_id", "url")] + [F.col("first.html_code") == F.xxhash64("html")]
    ours = rows.join(kinds, ["host", "digest"], "left").filter(F.col("first").isNull() | (same[0] & same[1] & same[2]))
    alone = F.coalesce(F.col("first.rows"), F.lit(1)) == 1
    kept = ours.filter(alone).drop("first").unionByName(ours.filter(~alone).drop("first").dropDuplicates(["host", "digest"]))
    return kept.select("host", F.xxhash64("digest").alias("code"), "html")


def page_texts(pages: DataFrame, least_pages: int = 10, least_share: float = 0.6, least_tokens: int = 3, least_support: int = 10) -> DataFrame:
    """For each row of ``pages``: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host_of(F.col("url").cast("string")).alias("host"),
    )
    distinct = _distinct_pages(rows)
    counts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") >= least_pages)
    stats = (
        distinct.mapInArrow(_counted, _STATS)
        .groupBy("host", "token")
        .agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    )
    supported = stats.join(counts, "host").filter(F.col("pages") >= F.greatest(F.lit(least_support), F.col("all") / 100))
    # Classes are as large as a page at most. Of those on a part of the pages only valid ones go on.
    wide = F.col("pages") >= F.col("all") * least_share
    members = F.count(F.lit(1)).over(Window.partitionBy("host", "vector"))
    frequent = supported.withColumns({"wide": wide, "members": members}).filter(F.col("wide") | (F.col("members") >= least_tokens))
    # A host's frequent tokens are its template: as each is on a hundredth of the pages, their number does not grow with them.
    templates = cut_lineage(
        frequent.select("host", "token", "vector", "chars", "links", "wide").groupBy("host").applyInArrow(_templates(least_tokens), _TEMPLATE)
    )
    return rows.join(templates, "host", "left").select("page_id", "url", "host", "html", "texts", "main").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long"
    )
