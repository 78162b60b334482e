"""Main text of web pages by equivalence classes of template tokens.

1. A page becomes tokens: each element under its path of names, and each text under its path. Over all pages of a site a token has an
occurrence vector; its hash is a sum of page hashes times counts, so vectors are compared without being gathered, and a site of any
size is summed before its rows move. Tokens of a site with one vector form an equivalence class.
2. Every page is read against its site's classes. A class is valid if its tokens come in one order (again and again, where they repeat)
on nearly all of its pages, and no class that occurs less often lies inside one of its rounds: so valid classes nest. Elements of
classes that occur once a page are the template's frame; for each, the text is summed that lies in it, is not of the template itself
and not linked.
3. The frame's lowest element that holds most of that text, raised to where its heading is, is the region. A page's slots in the region,
between the template's texts and its blocks of links, are the text.

Names decide what the template leaves open alone: elements that HTML defines as no text (scripts, navigation, forms and the like) hold
none; an article or main element around the region is the region; parts of the region with classes such as comments or ads are left
out, and parts with classes of more than one meaning if they recur on the site. A page that lacks its site's region is read by its article or main element.
Hosts of fewer than PAGES different pages make one site together; without a template the whole page is one slot.

Defined cases: a null or empty page, or one without visible text, has an empty text; repeated rows are extracted each and
do not make a template by themselves; a page cut off anywhere keeps what stands before the cut; a null or odd url is of
the joint site; extra columns are not read; no rows give no rows.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import per_batch, table, written

#: A token belongs to the template if it is on this share of a site's pages, and on so many.
SHARE, PAGES = 0.5, 4
#: A class is valid if its tokens are in order and nested on this share of its pages; the region holds this share of a site's text; a block of
#: links has this share of its text in links.
VALID, MOST, LINKED = 0.9, 0.5, 0.6
#: Parts with a class of more than one meaning recur if they are on this share of a site's pages, and on two.
RECURRING = 0.02

#: Elements by what they do to the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav aside footer form button select menu dialog svg canvas object audio video map datalist fieldset search label".split()) | RAW
WHOLE = frozenset("html body main article".split())
#: Words in a class, id or role that tell what is not the article.
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright dialog discussion disqus footer foot form gdpr header hidden login masthead menu menus modal nav navbar navigation navigationbar newsletter notice notices notification overlay pager pagination popup promo promotion promotions promoted recommend recommended recommendations related reply replies respond response responses search share sharing shares sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets alert cta teaser outbrain taboola complementary contentinfo".split()
)
#: Those of them that an article's own parts may have too.
OPEN = frozenset("related reply replies respond response responses notice notices share sharing shares social alert promo teaser form header".split())
JUNK_RUNS = ("sidebar", "advert", "cookie", "comment", "navbar", "newsletter", "popup", "breadcrumb", "sponsor", "footer", "masthead")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node(NamedTuple):
    name: str
    path: str
    junk: str  #: "": none; "element": by what it is; "named": by a class, id or role; "open": by a class of more than one meaning
    main: bool


def _judged(name: str, attributes: str) -> tuple[str, bool]:
    """Why an element is no part of the text, if it is none, and whether it holds the article."""
    dropped, junk, unsure, main = name in DROPPED, False, False, name in ("article", "main")
    if attributes and name not in ("html", "body"):
        for key, *values in _NAMES.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                dropped = dropped or key == "hidden"
            elif key == "itemprop":
                main = main or value.lower() == "articlebody"
            elif key == "role":
                main = main or value.lower() in ("main", "article")
                junk = junk or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar")
            elif name not in WHOLE:
                parts = {x.lower() for x in _PART.findall(value)}
                junk = junk or bool(parts & (JUNK - OPEN)) or any(r in value.lower() for r in JUNK_RUNS)
                unsure = unsure or bool(parts & OPEN)
    return "" if main else "element" if dropped else "named" if junk else "open" if unsure else "", main


def walk(page: str) -> Iterator[tuple[str, tuple[Node, ...], str]]:
    """("open", elements, name), ("text", elements, text) and ("break", elements, name) in page order."""
    stack: list[Node] = []
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            text = page[at:stop]
            if not found and "<" in text:  # a tag that the page's end cuts off
                cut = text.rfind("<")
                if re.match(r"<[/!a-zA-Z]", text[cut:]) and ">" not in text[cut:] or text[cut:] == "<":
                    text = text[:cut]
            if text:
                yield "text", tuple(stack), text
        if not found:
            return
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                yield "text", tuple(stack), found[0][9:].removesuffix("]]>")
            continue
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in ("article", "main", "table") and name in ("b", "i", "a", "span", "em", "strong", "p"):
                    break  # such an end belongs to nothing that is open in here
            if name in BLOCKS:
                yield "break", tuple(stack), name
            continue
        if name in BLOCKS:
            while stack and (stack[-1].name not in BLOCKS or stack[-1].name == "p"):
                if stack[-1].name == "p":
                    stack.pop()
                    break
                if not any(n.name == "p" for n in stack):
                    break
                stack.pop()
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].name == name:
                stack.pop()
        junk, main = _judged(name, found[3])
        kind = ".".join(sorted("".join(v).lower() for k, *v in _NAMES.findall(found[3]) if k.lower() in ("class", "role"))) if found[3] else ""
        node = Node(name, f"{stack[-1].path if stack else ''}/{name}{'.' + kind if kind else ''}", junk, main)
        yield "open", (*stack, node), name
        if name in BLOCKS:
            yield "break", (*stack, node), name
        closed = found[3].rstrip().endswith("/") and name not in BLOCKS
        if name in RAW and not closed:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not closed:
            stack.append(node)


def _hash(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}".encode("utf-8", "surrogatepass")) >> 1


def _spaced(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Token(NamedTuple):
    n: int
    at: int  #: the first place
    text: bool
    open: bool  #: an element with a class of more than one meaning


def tokens(page: str) -> dict[int, Token]:
    """The page's elements under their paths and its texts under theirs, by hash."""
    found: dict[int, Token] = {}
    for at, (kind, stack, what) in enumerate(walk(page)):
        if kind == "open":
            name, text, unsure = _hash("e", stack[-1].path), False, stack[-1].junk == "open"
        elif kind == "text" and (spaced := _spaced(what)):
            name, text, unsure = _hash("t", stack[-1].path if stack else "", spaced), True, False
        else:
            continue
        old = found.get(name)
        found[name] = Token(old.n + 1, old.at, text, unsure) if old else Token(1, at, text, unsure)
    return found


class Candidates:
    """A site's classes as found by their vectors: tokens with one vector, in the order of their mean places."""

    def __init__(self, rows: list[dict]) -> None:
        by: dict[tuple, list[dict]] = {}
        for x in sorted(rows, key=lambda x: (x["place"], x["token"])):
            by.setdefault((x["pages"], x["vector"]), []).append(x)
        #: per class: its tokens, and whether they are once on nearly each of its pages
        self.classes = [([x["token"] for x in c], sum(x["once"] for x in c) >= VALID * sum(x["pages"] for x in c)) for _, c in sorted(by.items())]
        self.classes = [(c, once) for c, once in self.classes if once or len(c) > 1]
        self.of = {t: (i, k) for i, (c, _) in enumerate(self.classes) for k, t in enumerate(c)}
        self.texts = {x["token"] for x in rows if x["is_text"] and x["token"] in self.of}


def judge(places: list[tuple[int, int]], classes: list[tuple[list[int], bool]]) -> dict[int, bool]:
    """places: class and number in it of a page's template tokens, in page order. For each class met: whether it is in order and nested."""
    seen: dict[int, list[tuple[int, int]]] = {}
    for at, (c, k) in enumerate(places):
        seen.setdefault(c, []).append((at, k))
    out = {}
    for c, met in seen.items():
        m = len(classes[c][0])
        good = len(met) % m == 0 and all(k == i % m for i, (_, k) in enumerate(met))
        if good and len(met) > m:  # rounds: nothing that occurs less often lies in one
            for i in range(0, len(met), m):
                inside = {x for x, _ in places[met[i][0] + 1 : met[i + m - 1][0]]} - {c}
                if any(len(seen[x]) // len(classes[x][0]) * m < len(met) for x in inside):
                    good = False
                    break
        out[c] = good
    return out


def measure(page: str, site: Candidates) -> list[tuple[str, int, int, int, int]]:
    """("class", number, good, 1, 0) and ("part", token, characters, of them linked, with a heading) of a page against its site's classes."""
    places, parts = [], {}
    for kind, stack, what in walk(page):
        if kind == "open":
            if (place := site.of.get(_hash("e", stack[-1].path))) is not None:
                places.append(place)
        elif kind == "text" and (text := _spaced(what)):
            path = stack[-1].path if stack else ""
            if (name := _hash("t", path, text)) in site.texts:
                places.append(site.of[name])
            if name not in site.texts and not any(n.junk in ("element", "named") for n in stack):
                linked, heading = len(text) if any(n.name == "a" for n in stack) else 0, any(n.name == "h1" for n in stack)
                for n in stack:
                    if n.name in BLOCKS and (token := _hash("e", n.path)) in site.of:
                        old = parts.get(token, (0, 0, 0))
                        parts[token] = (old[0] + len(text), old[1] + linked, old[2] or int(heading))
    return [("class", c, int(good), 1, 0) for c, good in judge(places, site.classes).items()] + [("part", t, *x) for t, x in parts.items()]


class Template(NamedTuple):
    region: int | None
    texts: frozenset[int]
    links: frozenset[int]  #: elements of the template that are blocks of links
    recurring: frozenset[int]  #: elements with a class of more than one meaning


def decide(rows: list[dict], measured: list[dict], recurring: list[int]) -> Template:
    """The template from a site's candidates and the sums of what its pages measured. `depth` of a token: its mean place, as an element comes before what it holds."""
    site = Candidates(rows)
    valid = {x["token"] for x in measured if x["kind"] == "class" and x["a"] >= VALID * x["b"]}
    known = {t for i, (c, _) in enumerate(site.classes) if i in valid for t in c}
    frame = {t for i, (c, once) in enumerate(site.classes) if i in valid and once for t in c} - site.texts
    parts = {x["token"]: x for x in measured if x["kind"] == "part"}
    free = {t: parts[t]["a"] - parts[t]["b"] for t in parts}
    pages = {x["token"]: x["pages"] for x in rows}
    order = [x["token"] for x in sorted(rows, key=lambda x: (x["place"], x["token"])) if x["token"] in frame and x["token"] in parts]
    most = max((free[t] for t in order), default=0)
    region = None
    if most:
        holding = [t for t in order if free[t] >= MOST * most]  # a chain: two that hold most of the text share some, so one lies in the other
        region = holding[-1]
        headed = [t for t in holding if parts[t]["c"] >= MOST * pages[t]]
        if headed and parts[region]["c"] < MOST * pages[region]:
            region = headed[-1]
    links = {t for t in known & parts.keys() if parts[t]["b"] >= LINKED * parts[t]["a"] and t != region}
    return Template(region, frozenset(site.texts & known), frozenset(links), frozenset(recurring))


EMPTY = Template(None, frozenset(), frozenset(), frozenset())


def extract(page: str, template: Template = EMPTY) -> str:
    """The text of the slots in the template's region; of the whole page where there is no template."""
    blocks: list[tuple[bool, bool, str]] = []  # in the region, in an article or main element, text
    held: list[str] = []
    place = (False, False)

    def end() -> None:
        if held:
            if text := _spaced("".join(held)):
                blocks.append((*place, text))
            held.clear()

    has_region, named = False, template.region is not None
    hashes: dict[str, int] = {}
    for kind, stack, what in walk(page):
        if kind == "break":
            end()
        elif kind == "open":
            if what == "br" and held:
                held.append(" ")
            if named and not has_region:
                has_region = _hash("e", stack[-1].path) == template.region
        else:
            inside, article, out = False, False, False
            for n in stack:
                token = hashes.get(n.path)
                if token is None:
                    token = hashes[n.path] = _hash("e", n.path)
                if n.main:
                    article = True
                if named and token == template.region:
                    inside = True
                elif n.junk == "element" or n.name == "header" and not article and not inside:
                    out = True
                elif named and (n.junk == "named" or n.junk == "open" and (token in template.recurring or not (inside or article)) or token in template.links and not n.main):
                    out = True
            if out or named and not article and _hash("t", stack[-1].path if stack else "", _spaced(what)) in template.texts:
                continue
            if not held:
                place = inside, article
            held.append(what)
    end()
    if not named:
        return "\n".join(x[2] for x in blocks)
    whole = any(article for _, article, _ in blocks)
    if not has_region:
        return "\n".join(text for _, article, text in blocks if article or not whole)
    around = any(inside and article for inside, article, _ in blocks)
    return "\n".join(text for inside, article, text in blocks if inside or around and article)


def sites(pages: DataFrame) -> DataFrame:
    """pages (host, html) with site: the host, or "" for hosts with fewer than PAGES different pages."""
    different = pages.groupBy("host", F.xxhash64("html").alias("page")).agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("n"))
    few = written(different.where(F.col("n") < PAGES).select("host", F.lit(True).alias("few")), "hosts")  # its size is known where it is joined
    return pages.join(few, "host", "left").withColumn("site", F.when(F.col("few"), "").otherwise(F.col("host"))).drop("few")


def templates(pages: DataFrame) -> DataFrame:
    """pages (site, html) to site, rows (its candidates), template (JSON).

    The number of tokens on at least SHARE of a site's pages is at most the tokens of a page over SHARE, whatever the site's size.
    """

    def of(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("site", "token", "page", "n", "place", "is_text", "open")}
        for h, body in zip(batch.column("site").to_pylist(), batch.column("html").to_pylist()):
            found = tokens(body)
            found[0] = Token(1, 0, False, False)  # on every page: counts them
            out["site"] += [h] * len(found)
            out["token"] += found.keys()
            out["page"] += [xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) >> 24] * len(found)
            for k, x in zip(("n", "place", "is_text", "open"), zip(*found.values())):
                out[k] += x
        return out

    met = per_batch(pages.select("site", "html"), "site string, token long, page long, n int, place int, is_text boolean, open boolean", of)
    vector = F.sum(F.col("page") * F.col("n") % (1 << 40)).alias("vector")
    sums = (F.count("*").alias("pages"), F.sum((F.col("n") == 1).cast("long")).alias("once"), vector, (F.min("page") != F.max("page")).alias("several"), F.sum("place").alias("places"), F.max("is_text").alias("is_text"), F.max("open").alias("open"))
    counted = met.groupBy("site", "token").agg(*sums)
    counted = written(counted.where("several or token = 0"), "tokens")  # texts of one page alone are no template
    sizes = counted.where("token = 0").select("site", F.col("pages").alias("of"))
    joined = counted.where("token <> 0").join(sizes, "site")
    frequent = (F.col("pages") >= PAGES) & (F.col("pages") >= SHARE * F.col("of"))
    again = F.col("open") & (F.col("pages") >= RECURRING * F.col("of"))
    row = F.struct("token", "pages", "once", "vector", (F.col("places") / F.col("pages")).alias("place"), "is_text")
    found = joined.where(frequent | again).groupBy("site").agg(F.collect_list(F.when(frequent, row)).alias("rows"), F.collect_list(F.when(again, F.col("token"))).alias("recurring"))
    found = written(found, "candidates")

    def read(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("site", "kind", "token", "a", "b", "c")}
        known: dict[str, Candidates] = {}
        for h, body, rows in zip(*(batch.column(c) for c in ("site", "html", "rows"))):
            h = h.as_py()
            if h not in known:
                known[h] = Candidates(rows.as_py())
            for x in measure(body.as_py(), known[h]):
                out["site"].append(h)
                for k, v in zip(("kind", "token", "a", "b", "c"), x):
                    out[k].append(v)
        return out

    measured = per_batch(pages.join(found, "site").select("site", "html", "rows"), "site string, kind string, token long, a long, b long, c long", read)
    summed = measured.groupBy("site", "kind", "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    summed = summed.groupBy("site").agg(F.collect_list(F.struct("kind", "token", "a", "b", "c")).alias("measured"))

    def settle(batch: pa.RecordBatch) -> dict:
        made = [decide(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("rows", "measured", "recurring")))]
        return {"site": batch.column("site"), "template": [json.dumps([t.region, *(sorted(x) for x in t[1:])]) for t in made]}

    return per_batch(found.join(summed, "site"), "site string, template string", settle)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    with_host = source.withColumn("host", F.substring(F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")), 1, 255))
    with_site = sites(with_host)
    found = with_site.join(written(templates(with_site), "templates"), "site", "left")

    def of(batch: pa.RecordBatch) -> dict:
        known: dict[str, Template] = {}
        texts = []
        for h, body, t in zip(*(batch.column(c) for c in ("site", "html", "template"))):
            h = h.as_py()
            if h not in known:
                region, *sets = json.loads(t.as_py() or "[null, [], [], []]")
                known[h] = Template(region, *map(frozenset, sets))
            texts.append(extract(body.as_py(), known[h]))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts}

    return per_batch(found.select("page_id", "url", "site", "html", "template"), "page_id long, url string, text string", of)


def op5_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
