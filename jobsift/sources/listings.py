"""Listing items of HTML pages (S13): an element scanner on built-in functions.

A page is cut into tokens (comments, scripts and styles, tags, text), and one
fold over them keeps the stack of open elements.  An element that a selector
matches gathers its text while it is open; when it ends, the item nearest around it
takes the field if it has none yet, and an item that ends is put out.
Elements that a browser closes by itself (``li``, ``p``, table and definition
cells, options) are closed by the tags that do so; other unclosed ones end with
the element around them; closing tags of nothing are passed over.  No step looks
back over the page, so the work follows its length.

A selector is ``tag``, ``.class``, ``#id``, ``[attribute]`` or several of these
joined (``div.job-item``); alternatives are joined by commas; ``:scope`` as a
field is the item itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import unescape

# --- fixed values: HTML's void elements, and which open elements a tag closes, up to the elements that stop it
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
_BLOCKS = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
           "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"]
CLOSES = {"li": (["li"], ["ul", "ol"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]), "option": (["option"], ["select"]),
          "tr": (["tr"], ["table"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"])}
P_STOPS = ["button", "td", "th", "table"]
# --- end of fixed values --------------------------------------------------

# Possessive repeats of groups loop; plain ones would nest a call for each sign of a long tag.
_TAG = r"</?[a-zA-Z][^\s/>]*+(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"
_PAIR = r"""(?<=[\s"'/])([^\s"'>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)"""
#: Comments, scripts and styles (to the end of the page where they are not closed), declarations, tags, text, lone signs.
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<[!?][^>]*>|{_TAG}|[^<]+|<"

LIST, ITEM = 1, 2
#: Bit of the first field; the others follow.
FIELD = 4


@dataclass(frozen=True)
class Selectors:
    """What to look for: the list (optional), its items, and the fields inside an item (None: the field stays null)."""

    item: str
    job_list: str | None = None
    title: str | None = None
    company: str | None = None
    location: str | None = None
    description: str | None = None
    url: str | None = None
    salary: str | None = None
    posted_date: str | None = None


FIELDS = [f.name for f in fields(Selectors) if f.name not in ("item", "job_list")]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value (quoted either way or bare), null where the tag has none."""
    names = F.regexp_extract_all(tag, F.lit(_PAIR), F.lit(1))
    at = F.array_position(F.transform(names, F.lower), name)
    value = F.get(F.regexp_extract_all(tag, F.lit(_PAIR), F.lit(2)), (at - 1).cast("int"))
    return F.when(at > 0, unescape(F.regexp_replace(value, r"""^["']|["']$""", "")))


def matches(tag: Column, selector: str) -> Column:
    """Whether an opening tag matches a selector."""
    hit = F.lit(False)
    for simple in selector.split(","):
        parts = re.findall(r"^[a-zA-Z][\w-]*|[.#][\w-]+|\[[\w-]+\]", simple.strip())
        if not parts or "".join(parts) != simple.strip():
            raise ValueError(f"not a simple selector: {simple!r}")
        both = F.lit(True)
        for part in parts:
            if part[0] == ".":
                both &= F.coalesce(F.array_contains(F.split(attribute(tag, "class"), r"\s+"), part[1:]), F.lit(False))
            elif part[0] == "#":
                both &= F.coalesce(attribute(tag, "id") == part[1:], F.lit(False))
            elif part[0] == "[":
                bare = F.regexp_replace(tag, r"""=\s*(?:"[^"]*"|'[^']*')""", "= ")
                both &= bare.rlike(rf"""(?i)[\s/]{re.escape(part[1:-1])}[\s=/>]""")
            else:
                both &= F.lower(F.regexp_extract(tag, r"^<([^\s/>]+)", 1)) == part.lower()
        hit |= both
    return hit


def _last(stack: Column, test) -> Column:
    """Place (from 1) of the innermost open element that passes, 0 for none."""
    return F.coalesce(F.array_max(F.transform(stack, lambda x, i: F.when(test(x), i + 1).otherwise(0))), F.lit(0))


def _events(tokens: Column, bits: list[tuple[str, int]]) -> Column:
    """Tags and text in order: pos, text, name, closing, alone (void or closed at once), mask of the selectors matched, href, closes, stops."""
    closes = F.create_map(*[x for n, (c, _) in CLOSES.items() for x in (F.lit(n), F.array(*map(F.lit, c)))],
                          *[x for n in _BLOCKS for x in (F.lit(n), F.array(F.lit("p")))])
    stops = F.create_map(*[x for n, (_, s) in CLOSES.items() for x in (F.lit(n), F.array(*map(F.lit, s)))],
                         *[x for n in _BLOCKS for x in (F.lit(n), F.array(*map(F.lit, P_STOPS)))])

    def event(t: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        opening = t.rlike("^<[a-zA-Z]")
        mask = F.lit(0)
        for selector, bit in bits:
            mask = mask + F.when(matches(t, selector), bit).otherwise(0)
        return F.struct(i.alias("pos"), F.when(~t.rlike("^<[a-zA-Z/!?]"), t).alias("text"), name.alias("name"), t.startswith("</").alias("closing"),
                        (name.isin(VOID) | t.rlike(r"/\s*>$")).alias("alone"), F.when(opening, mask).otherwise(0).cast("int").alias("mask"),
                        F.when(opening, attribute(t, "href")).alias("href"),
                        F.when(opening, F.try_element_at(closes, name)).alias("closes"), F.when(opening, F.try_element_at(stops, name)).alias("stops"))

    return F.filter(F.transform(tokens, event), lambda e: e["text"].isNotNull() | ((e["name"] != "") & ~e["name"].isin("script", "style")))


_STACK = "array<struct<name:string,mask:int,pos:int,buf:string,href:string,fields:array<string>>>"
_ITEMS = "array<struct<begin:int,fields:array<string>>>"
URL = FIELDS.index("url")


def _element(x, **changed: Column) -> Column:
    return F.struct(*[changed.get(c, x[c] if x is not None else None).alias(c) for c in ("name", "mask", "pos", "buf", "href", "fields")])


def _filled(values: Column, x: Column, bits_of: Column) -> Column:
    """Field values, those still null taken from the element x where its mask (``bits_of``) says so."""
    return F.transform(values, lambda v, k: F.coalesce(v, F.when(F.getbit(bits_of, k + 2) == 1, F.when(k == URL, x["href"]).otherwise(x["buf"]))))


def _popped(acc: Column, scope: int) -> Column:
    """The innermost open element ended: the item nearest around it takes what it is, and an item goes out."""
    size = F.size(acc["stack"])

    def end(x: Column) -> Column:
        rest = F.slice(acc["stack"], 1, size - 1)
        is_field = x["mask"] >= FIELD
        at = _last(acc["stack"], lambda y: (y["mask"].bitwiseAND(ITEM) > 0) & (y["pos"] < x["pos"]))
        rest = F.when(~is_field | (at == 0), rest).otherwise(_let(at, lambda a: F.transform(rest, lambda y, i: F.when(
            i + 1 == a, _element(y, fields=_filled(y["fields"], x, x["mask"]))).otherwise(y))))
        out = F.struct(x["pos"].alias("begin"), _filled(x["fields"], x, F.lit(scope)).alias("fields"))
        return F.struct(rest.alias("stack"), F.when(x["mask"].bitwiseAND(ITEM) > 0, F.array_append(acc["items"], out)).otherwise(acc["items"]).alias("items"))

    return _let(F.get(acc["stack"], size - 1), end)


def items_of(events: Column, scope: int, in_list: bool) -> Column:
    """The items of a page (begin, fields), as they end; ``scope``: the bits of the fields that are the item itself."""
    gathers = FIELD - 1

    def pop(acc: Column, n: Column) -> Column:
        return F.when(n < 1, acc).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), acc, lambda a, _: _popped(a, scope)))

    def step(acc: Column, e: Column) -> Column:
        stack = acc["stack"]
        with_text = F.transform(stack, lambda x: F.when((x["mask"] > gathers) | ((x["mask"].bitwiseAND(ITEM) > 0) & F.lit(scope > 0)),
                                                        _element(x, buf=F.concat_ws(" ", x["buf"], e["text"]))).otherwise(x))
        inner = _last(stack, lambda x: F.when(e["closing"], x["name"] == e["name"]).otherwise(F.coalesce(F.array_contains(e["closes"], x["name"]), F.lit(False))))
        stop = _last(stack, lambda x: F.coalesce(F.array_contains(e["stops"], x["name"]), F.lit(False)))
        n = _let(F.struct(inner.alias("i"), stop.alias("s")), lambda c: F.when(c["i"] > c["s"], F.size(stack) + 1 - c["i"]).otherwise(0))

        def opened(a: Column) -> Column:
            mask = e["mask"]
            if in_list:  # an item counts inside a list only
                mask = F.when(F.exists(a["stack"], lambda x: x["mask"].bitwiseAND(LIST) > 0), mask).otherwise(mask.bitwiseAND(~ITEM))
            linked = F.transform(a["stack"], lambda x: F.when((x["mask"] > 0) & x["href"].isNull(), _element(x, href=e["href"])).otherwise(x))
            new = F.struct(e["name"].alias("name"), mask.cast("int").alias("mask"), e["pos"].alias("pos"), F.lit(None).cast("string").alias("buf"), e["href"].alias("href"),
                           F.array_repeat(F.lit(None).cast("string"), len(FIELDS)).alias("fields"))
            pushed = F.struct(F.array_append(F.when(e["href"].isNull(), a["stack"]).otherwise(linked), new).alias("stack"), a["items"].alias("items"))
            return F.when(e["closing"], a).when(e["alone"], F.when(mask > 0, _let(pushed, lambda p: _popped(p, scope))).otherwise(a)).otherwise(pushed)

        return F.when(e["text"].isNotNull(), F.struct(with_text.alias("stack"), acc["items"].alias("items"))).otherwise(
            _let(_let(n, lambda k: pop(acc, k)), opened))

    start = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(_ITEMS).alias("items"))
    return F.aggregate(events, start, step, lambda acc: pop(acc, F.size(acc["stack"]))["items"])


def extract_listing_items(pages: DataFrame, selectors: Selectors, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row per listing item: the ``keep`` columns, position in the page (from 0) and the seven fields.

    A field is the text of the first element to end inside the item that its
    selector matches (``url``: the ``href`` of that element or of the first tag
    inside it that has one), white space collapsed and entities decoded; null
    where there is none.  A null page has no items.
    """
    wanted = [getattr(selectors, name) for name in FIELDS]
    bits = [(s, FIELD << k) for k, s in enumerate(wanted) if s and s != ":scope"]
    bits += [(s, bit) for s, bit in ((selectors.job_list, LIST), (selectors.item, ITEM)) if s]
    scope = sum(FIELD << k for k, s in enumerate(wanted) if s == ":scope")
    tokens = F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0))
    found = items_of(_events(tokens, bits), scope, selectors.job_list is not None)
    rows = pages.where(F.col(html).isNotNull()).select(*keep, F.posexplode(F.array_sort(found)).alias("position", "_item"))

    def value(k: int, name: str) -> Column:
        raw = F.get(F.col("_item.fields"), k)
        return (raw if name == "url" else F.trim(F.regexp_replace(unescape(raw), r"[\s\x{A0}]+", " "))).alias(name)

    return rows.select(*keep, "position", *[value(k, name) for k, name in enumerate(FIELDS)])
