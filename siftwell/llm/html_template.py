"""Main text of pages by template deduction from equivalence classes (after Arasu and Garcia-Molina, 2003).

A token is a tag or a run of text, told apart by the path of block tags it stands in. Its occurrence
vector says how often each page of a host has it; tokens with equal vectors form a class. Vectors are
never gathered: pages add a hash of page and count to each token, so equal sums mean equal vectors, and
sums combine before the shuffle. Classes of at least two tokens on enough of the host's pages are
valid; ordered by place they nest into the host's template, which is bounded by the length of a page.
Extraction removes the template's text, drops the slots whose surroundings say that they are menus,
headers, footers, side bars, notices, adverts, forms or comments, and joins what is left. Text inside
an ``article`` counts as template only under stricter limits, and only where the template makes up the
lesser part of the article, so that near copies of one article stay whole on a host of any size.

Results for odd input: a null page counts as empty and has the empty text; pages without a host share
one; repeated rows are all returned, and count as pages of their host; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# What tags and names of surroundings mean.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style textarea title iframe xmp noembed noframes".split()
BLOCKS = ("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
          "header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead tr ul").split()
SIDE_TAGS = "nav footer aside form noscript template svg button select dialog menu head object canvas label".split()
SIDE_NAMES = ("ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
              "footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination "
              "popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola "
              "toolbar widget alert").split()
MAIN_NAMES = "article articlebody".split()
LAYOUT_NAMES = "with has no without layout".split()
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_VOID, _RAW, _BLOCKS, _SIDE_TAGS, _SIDE_NAMES, _MAIN_NAMES, _ABOUT_LAYOUT = map(
    frozenset, (VOID, RAW, BLOCKS, SIDE_TAGS, SIDE_NAMES, MAIN_NAMES, LAYOUT_NAMES))
_ENDS_P = _BLOCKS - {"body", "html", "head", "option", "template", "noscript", "select"}
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class Run(NamedTuple):
    """A run of text with its surroundings; ``place`` is its number among the page's tokens."""

    token: int
    place: int
    text: str
    side: bool
    main: int
    block: int
    link: bool


class Open(NamedTuple):
    name: str
    path: str
    side: bool
    main: int
    link: bool


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts))


def _surroundings(name: str, attributes: str, above: Open) -> tuple[bool, int, str]:
    """Whether the element is beside the main text, its rank as main text (2 article, 1 main), its class."""
    side, main, label = above.side, above.main, ""
    role = ""
    names: set[str] = set()
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                label += f" {value}" if key == "class" else ""
                for one in value.split():
                    parts = {n.lower() for n in _NAME.findall(one)}
                    if not parts & _ABOUT_LAYOUT:  # "has-sidebar" says how a page is laid out, not what is in the element
                        names |= parts
            elif key in ("role", "itemprop"):
                role = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                side = True
    if name == "header" or "header" in names or "masthead" in names:
        side = side or not main
    if name in _SIDE_TAGS or (names & _SIDE_NAMES) - {"header"} or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"):
        side = side or name not in ("html", "body", "main") and not (name == "article" and not names & {"comment", "comments", "reply", "related", "ad", "promo"})
    if not side:
        if name == "article" or role in ("article", "articlebody") or names & _MAIN_NAMES:
            main = 2
        elif name == "main" or role == "main":
            main = max(main, 1)
    return side, main, label


def parse(page: str) -> tuple[list[Run], list[int]]:
    """The runs of text of a page and the hashes of all its tokens in order."""
    stack = [Open("", "", False, 0, False)]
    runs: list[Run] = []
    tokens: list[int] = []
    block = at = 0
    while at < len(page):
        m = _PART.match(page, at)
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            text = m.group()
            if text.startswith("<![CDATA["):
                text = text[9:-3] if text.endswith("]]>") else text[9:]
            elif len(text) > 1 and text[0] == "<":
                continue
            top = stack[-1]
            plain = entities.unescape(text)
            key = " ".join(plain.split())
            token = _hash(top.path, "text", key) if key else 0
            runs.append(Run(token, len(tokens), plain, top.side, top.main, block, top.link))
            if key:
                tokens.append(token)
            continue
        if m.group(1) or m.group(4):
            if name in _BLOCKS:
                block += 1
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    tokens.append(_hash(stack[k].path, "end"))
                    del stack[k:]
                    break
            continue
        if name in _BLOCKS:
            block += 1
        elif name == "br":
            runs.append(Run(0, len(tokens), " ", stack[-1].side, stack[-1].main, block, False))
        closes = ({"p"} if name in _ENDS_P else set()) | CLOSES.get(name, set())
        for k in range(len(stack) - 1, 0, -1) if closes else ():
            if stack[k].name in closes:
                del stack[k:]
                break
            if stack[k].name in ("article", "main", "section", "div", "table", "ul", "ol", "nav", "aside", "body", "td"):
                break
        top, attributes = stack[-1], m.group(3) or m.group(6) or ""
        if name in _RAW:
            end = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        side, main, label = _surroundings(name, attributes, top)
        path = f"{top.path}/{name}{label}" if name in _BLOCKS else top.path
        tokens.append(_hash(path, "start", name))
        if not attributes.endswith("/"):
            stack.append(Open(name, path, side, main, top.link or name == "a"))
    return runs, tokens


class Known(NamedTuple):
    """A token of a host's template: mean place, whether it is text, whether it repeats within a page, and
    whether it is common enough to be removed inside an article as well."""

    place: float
    is_text: bool
    repeats: bool
    strict: bool


def main_text(page: str, template: dict[int, Known]) -> str:
    """The text of the page's slots, without those beside the main text.

    Template tokens are followed in their order; what lies between two of them is a slot. If most of the
    text inside an article is on most pages of the host, the page is a near copy of others, and all of its
    article stays: only a lesser part of an article counts as template. Where a page marks no article, slots that consist of links are taken for menus, whatever they are called.
    """
    runs, tokens = parse(page)
    slot_of, fixed, slot, reached = [0] * (len(tokens) + 1), set(), 0, -1.0
    for place, token in enumerate(tokens):
        known = template.get(token)
        if known is not None and (known.repeats or known.place >= reached):
            if known.is_text:
                fixed.add(place)
            if not known.repeats:
                reached, slot = known.place, slot + 1
        slot_of[place] = slot
    slot_of[len(tokens)] = slot
    for rank in (2, 1, 0):
        inside = [run for run in runs if not run.side and run.main >= rank]
        if not any(run.token for run in inside):
            continue
        varies = {run.block for run in inside if run.token and not (run.place in fixed and (not rank or template[run.token].strict))}
        own = [run for run in inside if run.block in varies]  # a block goes if all of its text is the template's
        if rank and 2 * sum(len(run.text.strip()) for run in own) < sum(len(run.text.strip()) for run in inside):
            own = inside
        if not rank:
            linked: dict[tuple, bool] = {}
            for run in own:
                if run.token:
                    where = (slot_of[run.place], run.block if not template else 0)
                    linked[where] = linked.get(where, True) and run.link
            own = [run for run in own if not linked.get((slot_of[run.place], run.block if not template else 0), False)]
        pieces, block = [], None
        for run in own:
            if block is not None and run.block != block:
                pieces.append(" ")
            pieces.append(run.text)
            block = run.block
        return " ".join("".join(pieces).split())
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def token_sums(pages: DataFrame) -> DataFrame:
    """``(host, token, is_text, pages, occurrences, places, vector)`` from ``(host, url, html)``; token 0 stands for the page."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sums: dict[tuple[str, int], list] = {}
            for host, url, page in zip(part["host"], part["url"], part["html"]):
                runs, tokens = parse(page)
                texts = {r.token for r in runs if r.token}
                own = _hash(url, page)
                seen: dict[int, list[int]] = {0: [1, 0]}
                for place, token in enumerate(tokens):
                    entry = seen.setdefault(token, [0, 0])
                    entry[0] += 1
                    entry[1] += place
                for token, (count, places) in seen.items():
                    total = sums.setdefault((host, token), [token in texts, 0, 0, 0, 0])
                    total[1] += 1
                    total[2] += count
                    total[3] += places
                    total[4] ^= (own + count * ODD) * ODD & MASK
            rows = [(h, _signed(t), v[0], v[1], v[2], v[3], _signed(v[4])) for (h, t), v in sums.items()]
            yield pd.DataFrame(rows, columns=["host", "token", "is_text", "pages", "occurrences", "places", "vector"])

    found = pages.mapInPandas(add, "host string, token long, is_text boolean, pages long, occurrences long, places long, vector long")
    return found.groupBy("host", "token").agg(
        F.max("is_text").alias("is_text"), F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"),
        F.sum("places").alias("places"), F.bit_xor("vector").alias("vector"))


def templates(pages: DataFrame, least_pages: int = 3, share: float = 0.5, strict_pages: int = 10, strict_share: float = 0.9) -> DataFrame:
    """``(host, template)``: the tokens of each host's valid classes.

    At most ``1 / share`` times the mean number of tokens of a page are on enough pages, so a host's
    template does not grow with the number of its pages.
    """
    sums = stored(token_sums(pages), "tokens")
    hosts = sums.filter("token = 0").select("host", F.col("pages").alias("host_pages"))
    often = sums.filter((F.col("token") != 0) & (F.col("pages") >= least_pages)).join(hosts, "host").filter(F.col("pages") >= share * F.col("host_pages"))
    strict = (F.col("pages") >= strict_pages) & (F.col("pages") >= strict_share * F.col("host_pages"))
    member = F.struct((F.col("places") / F.col("occurrences")).alias("place"), "token", "is_text", (F.col("occurrences") > F.col("pages")).alias("repeats"), strict.alias("strict"))
    classes = often.groupBy("host", "vector", "pages", "occurrences").agg(F.collect_list(member).alias("members")).filter(F.size("members") >= 2)
    members = classes.select("host", F.explode("members").alias("m")).select("host", "m.*")
    return members.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", *Known._fields))).alias("template"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **limits: float) -> DataFrame:
    """``(page_id, url, text)`` of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    known = stored(templates(rows.select("host", F.coalesce("url", F.lit("")).alias("url"), "html"), **limits), "templates")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached: dict[str, dict] = {}
        for part in parts:
            texts = []
            for host, page, template in zip(part["host"], part["html"], part["template"]):
                if host not in cached:
                    if len(cached) > 1000:
                        cached.clear()
                    cached[host] = {t["token"] & MASK: Known(*[t[f] for f in Known._fields]) for t in template} if template is not None else {}
                texts.append(main_text(page, cached[host]))
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts})

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.join(known, "host", "left").mapInPandas(read, f"page_id {kind}, url string, text string")
