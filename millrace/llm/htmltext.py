"""Main-text extraction by template deduction over the pages of a host.

A page is a sequence of tokens: its tags and its blocks of text, each under its path of open elements. Tokens that
occur on the same pages, as often on each, have the same occurrence vector and form an equivalence class. A class is
valid when it is large, when nearly all different pages of the host have it, and when enough of them support it; valid
classes are nested by the stretch of the page that they span, and make the host's template. The template's own text is
no page's. Between its tokens are the slots, whose text differs from page to page: each belongs to the innermost
template element around it. The main text of a host is what fills the slots of one of these: of those that occur once
on a page, in classes that no repeated class spans, and hold most of the host's slot text, it is the outermost article
or main element, or else the innermost of all. On a host with too few pages for a template, and on pages without that
element, the main text is the blocks in article or main elements, or all blocks where there are none.

Of either, what is left out by the contract goes: elements that are no text (menus, footers, forms, scripts), page
headers but for headings, and elements whose class, id or role name adverts, notices, comments and the like.

Occurrence vectors are never built: a class is named by sums of hashes of (page, count), which are added up where the
pages are, so a host with a third of all pages is counted like any other.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.linededup import fixed_filter, maybe_in
from millrace.llm.workspace import Workspace

# Elements of HTML by their role.
INLINE = frozenset(
    "a abbr acronym b basefont bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta link q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noembed".split())
NEVER = frozenset(
    "head script style noscript template nav footer aside button select option textarea iframe svg canvas object "
    "dialog menu audio video map datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of a class, id or role that name what is not main text.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar aside nav navigation navbar menu "
    "breadcrumb breadcrumbs footer share sharing social related recommended comment comments commentlist disqus respond "
    "reply replies login signup search widget toolbar pagination pager skip navigation contentinfo complementary "
    "dialog alert form".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
# Words that may stand beside those in a name ("sidebar-left", "site-footer") without changing what it means. A name
# with any other word ("has-sidebar", "no-sidebar", "long-form") names something else.
NEUTRAL_WORDS = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer fixed sticky mobile desktop "
    "container wrapper box block list item area section bar panel group row col column slot unit title link button icon "
    "post entry article blog widgets".split()
)
KNOWN_WORDS = CHROME_WORDS | HEADER_WORDS | NEUTRAL_WORDS
# Words of names whose articles are not the page's own, even where it has no others.
OTHERS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion related recommended comment "
    "comments commentlist disqus respond reply replies".split()
)
MAIN_WORDS = frozenset(("main", "article"))

#: Blocks that are pieces of a text, not places that hold one.
PIECES = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th thead tbody tfoot caption pre blockquote figure figcaption hr address "
    "summary header hgroup".split()
)
COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
TAG = re.compile(COMMENT + r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: For the rest of a page in which a quotation mark is never closed.
LENIENT_TAG = re.compile(COMMENT + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: One attribute after the other, so that what stands in a value is never taken for a name.
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
NAME_WORDS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    tag: str
    path: int  # a hash of the labels of all open elements
    chrome: bool
    main: bool
    header: bool
    parent: Element | None = None
    always: tuple[bool, bool] = (False, False)  # chrome and header by itself, whatever is in it
    named: tuple[bool, bool] = (False, False)  # chrome and header by the words of its names
    others: bool = False  # it or one around it holds articles that are not the page's own
    holds_main: bool = False  # is or has an article or main element that is in no other
    place: bool = False  # can hold a main text
    form: Element | None = None  # the innermost form around it, or itself
    bare: bool = False  # chrome for another reason than forms


@dataclass(slots=True)
class Block:
    path: int
    text: str
    heading: bool
    main: bool
    chrome: bool
    header: bool
    element: Element


@lru_cache(maxsize=65_536)
def _named(value: str) -> tuple[bool, bool, bool]:
    """(chrome, header, others) by the names in a class, id or role: each counts as a whole."""
    chrome = header = others = False
    for name in value.split():
        words = NAME_WORDS.findall(CAMEL.sub(" ", name).lower())
        words = {w[:-1] if w not in KNOWN_WORDS and w[:-1] in KNOWN_WORDS and w[-1] == "s" else w for w in words if not w.isdigit()}
        if words <= KNOWN_WORDS:
            chrome |= bool(words & CHROME_WORDS)
            header |= bool(words & HEADER_WORDS)
            others |= bool(words & OTHERS_WORDS)
    return chrome, header, others


def _roles(tag: str, attributes: str, parent: Element) -> Element:
    names: list[str] = []
    read: dict[str, str] = {}
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "hidden", "itemprop") and name not in read:
                read[name] = htmllib.unescape(a or b or c)
                if name in ("class", "id", "role"):
                    names.append(read[name])
    hidden = "hidden" in read
    words = {w for n in names for w in NAME_WORDS.findall(CAMEL.sub(" ", n).lower())}
    if read.get("itemprop", "").lower() == "articlebody":
        words.add("article")
    is_main = tag in MAIN_WORDS or "main" in words and tag != "div" or "article" in words and "articlebody" in words
    is_main = is_main or (tag in ("div", "section") and bool(MAIN_WORDS & set(NAME_WORDS.findall(read.get("role", "").lower()))))
    by_name = (False, False, False)
    if names and tag not in ("body", "html"):
        by_id, by_class = _named(read.get("id", "")), _named(f"{read.get('class', '')} {read.get('role', '')}")
        if parent.main:
            # in an article ids are often made of its text, and pieces of it are text; only adverts and comments go
            if tag in HEADINGS:
                by_id = by_class = (False, False, False)
            elif tag in PIECES:
                by_class = (by_class[2], False, by_class[2])
            by_id = (by_id[2], False, by_id[2])
        by_name = tuple(x or y for x, y in zip(by_id, by_class))
    always = (tag in NEVER or (hidden and tag not in ("body", "html")), tag == "header")
    named = (by_name[0], by_name[1] and tag not in HEADINGS)
    label = f"{tag}.{'.'.join(sorted(names))}" if names else tag
    bare = parent.bare or always[0] or named[0]
    e = Element(
        tag, xxhash.xxh64_intdigest(f"{parent.path}/{label}", 1), parent.chrome or bare or tag == "form",
        parent.main or is_main, parent.header or always[1] or named[1], parent, always, named,
        parent.others or always[0] or by_name[2], False, tag not in PIECES and tag not in INLINE, parent.form, bare,
    )
    if tag == "form":
        e.form = e
    return e


def _settle(elements: list[Element], blocks: list[tuple[Element, str, bool]]) -> None:
    """What takes the whole page to know: which forms are no chrome, and which names of chrome mean nothing.

    A form is chrome unless it holds an article of the page's own, or at least half of the text that is left without
    forms. Where all articles of a page are in elements with names of chrome, the names are lifted off those that hold
    one. Articles named as comments, adverts or pages related to this one stay out.
    """
    forms = [e for e in elements if e.tag == "form"]
    own = [e for e in elements if e.main and not e.parent.main]
    lifted: set[int] = set()
    if forms:
        inside = {id(f): 0 for f in forms}
        whole = 0
        for e, text, _ in blocks:
            if not e.bare:
                whole += len(text)
                if e.form is not None:
                    inside[id(e.form)] += len(text)
        for f in reversed(forms):  # inner forms before those around them
            if inside[id(f)] and 2 * inside[id(f)] >= whole:
                lifted.add(id(f))
            if f.parent.form is not None:
                inside[id(f.parent.form)] += inside[id(f)]
        for e in own:
            f = e.form if not e.others else None
            while f is not None and id(f) not in lifted:
                lifted.add(id(f))
                f = f.parent.form
    _inherit(elements, lifted)
    if not own or any(not e.chrome and not e.header for e in own):
        return
    for e in own:
        above = e
        while not e.others and above.parent is not None and not above.holds_main:
            above.holds_main = True
            above = above.parent
    _inherit(elements, lifted)


def _inherit(elements: list[Element], lifted: set[int]) -> None:
    for e in elements:  # parents come first
        by_name = (False, False) if e.holds_main else e.named
        form = e.tag == "form" and id(e) not in lifted
        e.chrome = e.parent.chrome or e.always[0] or by_name[0] or form
        e.header = e.parent.header or e.always[1] or by_name[1]


def tokenize(source: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, and all block-level elements; in time linear in the page."""
    stack = [Element("", 0, False, False, False)]
    elements: list[Element] = []
    blocks: list[tuple[Element, str, bool]] = []
    tags: list[Element] = []
    held: list[str] = []
    is_open: dict[str, int] = {}
    heading = False
    pattern = TAG

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", htmllib.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((stack[-1], text, heading))

    def push(e: Element) -> None:
        stack.append(e)
        is_open[e.tag] = is_open.get(e.tag, 0) + 1

    def pop() -> str:
        tag = stack.pop().tag
        is_open[tag] -= 1
        return tag

    at, n, last = 0, len(source), source.rfind(">")
    while at < n:
        m = pattern.search(source, at) if at <= last or source.find("<!", at) >= 0 or source.find("<?", at) >= 0 else None
        if m is None and pattern is TAG and at <= last:  # a quotation mark that is not closed before the end
            pattern = LENIENT_TAG
            continue
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m.group(1)), m.group(3) or ""
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif not closing and tag == "span" and attributes:
                e = _roles(tag, attributes, stack[-1])
                if e.always[0] or e.named[0] or stack[-1].tag == "span":
                    flush()
                    push(e)
                    elements.append(e)
            elif closing and tag == "span" and stack[-1].tag == "span":
                flush()
                pop()
            continue
        flush()
        if closing:
            if is_open.get(tag):
                while pop() != tag:
                    pass
            heading = heading and tag not in HEADINGS
            continue
        if tag in HEADINGS:
            heading = True
        if tag not in NEVER and stack[-1].tag == "p":
            pop()
        for item in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)):
            if tag in item and stack[-1].tag in item:
                pop()
        element = _roles(tag, attributes, stack[-1])
        tags.append(element)
        elements.append(element)
        if tag not in VOID:
            push(element)
    flush()
    _settle(elements, blocks)
    return [Block(e.path, text, heading, e.main, e.chrome, e.header, e) for e, text, heading in blocks], tags


def token_hash(path: int, text: str | None = None) -> int:
    """Of a tag, or of a block of text, as a signed 64-bit number."""
    digest = path if text is None else xxhash.xxh64_intdigest(f"{path}\x01{text}", 1)
    return digest - (1 << 64) if digest >> 63 else digest


def main_text(source: str | None, template: set[int], place: int | None = None) -> tuple[str, bool]:
    """(blocks of the main text, joined by two line ends; whether the template decided on them).

    ``template`` has the tokens of the template's text, and ``place`` is the token of the element whose slots have the
    main text.
    """
    blocks, tags = tokenize(source or "")
    inside: set[int] = set()
    for e in tags:  # parents come first
        if token_hash(e.path) == place or id(e.parent) in inside:
            inside.add(id(e))
    if inside:
        chosen = [b for b in blocks if id(b.element) in inside or (b.element.tag == "span" and _in_span(b.element, inside))]
    else:
        any_main = any(b.main and not b.chrome for b in blocks)
        chosen = [b for b in blocks if b.main or not any_main]
    kept = [
        b.text
        for b in chosen
        if not b.chrome and (not b.header or ((b.main or inside) and b.heading)) and token_hash(b.path, b.text) not in template
    ]
    return "\n\n".join(kept), bool(inside)


def _in_span(element: Element, inside: set[int]) -> bool:
    while element.tag == "span" and element.parent is not None:
        element = element.parent
    return id(element) in inside


@dataclass(frozen=True)
class TemplateParams:
    least_pages: int = 5  # different pages that must support a class
    share: float = 0.9  # of the host's different pages that must have the class
    least_tokens: int = 2  # of a class
    place_share: float = 0.5  # of the slot text of a host that the element with the main text holds at least


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Kinds of tokens: text, elements that are pieces of a text, that can hold a main text, and article or main elements.
TEXT, PIECE, PLACE, MAIN = 0, 1, 2, 3
#: Sums over pages of a token's numbers, and what is the same wherever it occurs.
ADDED = ("a", "b", "pages", "times", "place", "chars")
OWN = ("kind", "level", "parent")


def tokens_of(source: str | None) -> dict[int, list[int]]:
    """(occurrences, place in thousandths of the page, characters, kind, level, parent) of each token of a page.

    The characters of an element are those of the text in it that could be main text; of a text, its own.
    """
    blocks, tags = tokenize(source or "")
    order: dict[int, int] = {}
    level, below = {0: 0}, {}
    for e in tags:
        level[e.path] = level.get(e.parent.path, 0) + 1
        below[id(e)] = 0
    for blk in blocks:
        if not blk.chrome:
            e = blk.element
            while e.parent is not None and id(e) not in below:
                e = e.parent
            if id(e) in below:
                below[id(e)] += len(blk.text)
    for e in reversed(tags):  # children before parents
        if id(e.parent) in below:
            below[id(e.parent)] += below[id(e)]
    found: dict[int, list[int]] = {}
    size = max(1, len(blocks) + len(tags))
    for e in tags:
        token = token_hash(e.path)
        kind = PIECE if not e.place or e.chrome else MAIN if e.main and not e.parent.main else PLACE
        got = found.setdefault(token, [0, len(order) * 1000 // size, 0, kind, level[e.path], token_hash(e.parent.path)])
        order[token] = 1
        got[0] += 1
        got[2] += below[id(e)]
    for k, blk in enumerate(blocks):
        token = token_hash(blk.path, blk.text)
        got = found.setdefault(token, [0, (len(tags) + k) * 1000 // size, 0, TEXT, 0, token_hash(blk.path)])
        got[0] += 1
        got[2] += 0 if blk.chrome else len(blk.text)
    return found


def page_tokens(ws: Workspace, pages: DataFrame) -> DataFrame:
    """(host, token, kind, level, parent, a, b, pages, times, place, chars) over the different pages of each host of
    ``pages(host, html)``.

    ``a`` and ``b`` are sums over pages of a hash of (page, occurrences): equal sums, equal vectors. ``place`` is the
    sum of the token's first places, in thousandths of the page. A page is its html, and copies on a host count once:
    tokens are added up within each batch, but those of pages that may have copies go out by page, to meet these.
    """
    keyed = pages.select("host", "html", F.xxhash64("host", F.coalesce("html", F.lit(""))).alias("page"))
    copied = keyed.groupBy("page").agg(F.count("*").alias("n")).where("n > 1")
    keyed = maybe_in(keyed, ws.table(fixed_filter(copied, "page"), "copied"), "page").select("host", "html", "page", "maybe")
    names = ["host", "token", "page", *OWN, *ADDED]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            met: set[int] = set()
            for host, source, page, maybe in zip(batch["host"], batch["html"], batch["page"], batch["maybe"]):
                if maybe:
                    if page in met:
                        continue
                    met.add(page)
                of = page if maybe else 0
                for token, (times, place, chars, kind, level, parent) in tokens_of(source).items():
                    mixed = xxhash.xxh64_intdigest(f"{page}:{times}", 5)
                    got = sums.setdefault((host, token, of), [kind, level, parent, 0, 0, 0, 0, 0, 0])
                    for k, x in enumerate((mixed & 0x3FFFFFFF, mixed >> 34, 1, times, place, chars), 3):
                        got[k] += x
            yield pd.DataFrame([(*key, *x) for key, x in sums.items()], columns=names)

    kinds = "host string, token long, page long, kind int, level int, parent long, " + ", ".join(f"{c} long" for c in ADDED)
    found = keyed.mapInPandas(run, kinds)
    # page 0 stands for pages without copies; the rows of another page are copies of each other
    once = found.groupBy("host", "token", "page").agg(
        *[F.when(F.col("page") == 0, F.sum(c)).otherwise(F.max(c)).alias(c) for c in ADDED], *[F.max(c).alias(c) for c in OWN]
    )
    return once.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ADDED], *[F.max(c).alias(c) for c in OWN])


def choose_place(tokens: pd.DataFrame, params: TemplateParams) -> int | None:
    """The token of the element whose slots have the main text, of a host's frequent tokens; ``valid`` marks the
    template's, ``pages``, ``times`` and ``chars`` are sums over pages, and ``outer`` tells that no repeated class spans
    the token's."""
    by = {t: (k, p, c, v) for t, k, p, c, v in zip(tokens["token"], tokens["kind"], tokens["parent"], tokens["chars"], tokens["valid"])}
    slot = {t: c for t, (k, _, c, _) in by.items() if k != TEXT}
    for kind, parent, chars, valid in by.values():
        if kind == TEXT and valid:  # what the template says itself fills no slot
            at, seen = parent, set()
            while at in by and at not in seen:
                seen.add(at)
                slot[at] -= chars
                at = by[at][1]
    whole = max(slot.values(), default=0)
    places = [
        (t, k, level)
        for t, k, level, valid, outer, times, pages in zip(*(tokens[c] for c in ("token", "kind", "level", "valid", "outer", "times", "pages")))
        if valid and outer and k in (PLACE, MAIN) and times == pages and slot[t] > 0 and slot[t] >= params.place_share * whole
    ]
    mains = [(level, t) for t, k, level in places if k == MAIN]
    if mains:
        return int(min(mains)[1])
    return int(max((level, t) for t, _, level in places)[1]) if places else None


def deduce_templates(ws: Workspace, pages: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(host, template, place) of each host with a template, for ``pages(host, html)``: the tokens of its text, and the
    token of the element whose slots have the main text.

    Support and shares are counted in different pages. A host has as few frequent tokens as its pages have, whatever
    their number, so each host's template is made in one task.
    """
    html = F.xxhash64(F.coalesce("html", F.lit("")))
    hosts = pages.select("host", html.alias("h")).distinct().groupBy("host").agg(F.count("*").alias("different"))
    tokens = page_tokens(ws, pages).where(F.col("pages") >= params.least_pages)
    common = (
        tokens.join(hosts.where(F.col("different") >= params.least_pages), "host")
        .where(F.col("pages") >= params.share * F.col("different")).drop("different")
    )

    def template(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("token").reset_index(drop=True)
        group["at"] = group["place"] / group["pages"]
        key = [group["a"], group["b"]]
        of_class = group.groupby(key)["at"]
        group["valid"] = of_class.transform("size") >= params.least_tokens
        group["begin"], group["end"] = of_class.transform("min"), of_class.transform("max")
        valid = group[group["valid"]]
        repeated = valid[valid["times"] > valid["pages"]].drop_duplicates(["a", "b"])[["begin", "end"]].to_numpy()
        # a class is nested in another that spans it; what repeats spans entries of lists, not a page's text
        spans = (repeated[:, 0][None] < group["begin"].to_numpy()[:, None]) & (group["end"].to_numpy()[:, None] < repeated[:, 1][None])
        group["outer"] = ~spans.any(1)
        texts = group["token"][group["valid"] & (group["kind"] == TEXT)]
        return pd.DataFrame({
            "host": [group["host"].iat[0]], "template": [texts.tolist()],
            "place": pd.array([choose_place(group, params)], "Int64"),
        })

    found = common.groupBy("host").applyInPandas(template, "host string, template array<long>, place long")
    return ws.table(found, "templates")


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    params: TemplateParams = TemplateParams(),
) -> DataFrame:
    """(id, url, text, n_chars) of each row, from the whole html.

    Null and empty html give an empty text; a null or odd url belongs to the host without a name; rows with repeated
    or null ids give a row each; a host with too few different pages has no template; an empty table gives no rows.
    """
    return extracted(pages, id_col, url_col, html_col, params).select(id_col, url_col, "text", "n_chars")


#: Tasks that the pages of a host are dealt over where templates are too many to be sent to all tasks.
SALTS = 32


def extracted(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    params: TemplateParams = TemplateParams(),
) -> DataFrame:
    """The rows of ``extract_main_text`` with ``by_template``: whether the host's template decided on the text."""
    ws = Workspace(pages.sparkSession, "htmltext")
    source = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
        _host(F.col(url_col).cast("string")).alias("host"),
    )
    templates = deduce_templates(ws, source, params)

    @F.pandas_udf("text string, by_template boolean")
    def extract(sources: pd.Series, templates: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = [
            main_text(s, set() if t is None else set(np.asarray(t).tolist()), int(p) if has else None)
            for s, t, p, has in zip(sources, templates, places, places.notna())
        ]
        return pd.DataFrame(rows, columns=["text", "by_template"])

    salted = source.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    every = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the token of a place is a full 64-bit number: as text, since pandas would make it a float beside a null
    joined = salted.join(every, ["host", "salt"], "left").withColumn("place", F.col("place").cast("string"))
    done = joined.select("id", "url", extract("html", "template", "place").alias("x")).select("id", "url", "x.*")
    return done.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "by_template"
    )


_ARTICLE = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
_BLOCKS = f"regexp_split_to_array(regexp_replace(replace({_ARTICLE}, '<br>', ' '), '</?b>', '', 'g'), '</?(?:h1|p)>')"
_TEXT = "replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
#: For pages of the shape that the test tables have: one article of a heading and paragraphs, some left open.
ORACLE_SQL = rf"""
WITH t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform({_BLOCKS}, lambda x: trim(regexp_replace({_TEXT}, '\s+', ' ', 'g'))),
    lambda x: x <> ''), chr(10) || chr(10)) AS text FROM pages
)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
