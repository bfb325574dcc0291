"""Main text of web pages by equivalence-class template deduction.

A page is read into structural tokens (paths of open elements with their classes) and text tokens (a path and
the text of a block).  Over the distinct pages of a host, tokens with the same occurrence vector - the same count
on every page - form an equivalence class.  A class is valid if it holds structure and spans enough pages; the
valid classes are the template, nested as their paths are, and what lies between their tokens are the slots.

- Text tokens in a valid class are the template's own wording and no page's text, inside an article too.
- The slots that a page's text is in: of the elements that the template has once a page, the innermost with at
  least half of all prose (text that is no link) of the host's pages that have it - or the article or main
  element around that.

Names are left what no occurrence tells: elements of HTML that by their meaning hold no article text (menus,
forms, scripts, ...), and class or id names that as a whole name a notice, an advert and the like.  Where a host
has too few pages to deduce a template, the article or main element is the region.

Vectors are compared by a linear sketch - the sum of count times a random number of the page - which partial
aggregates combine, so a host of any size is never gathered in one place.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, tidy
from .url_filter import url_host

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Za-z]+")

# Names of HTML elements and of conventional class or id words; fixed vocabularies, in natural order.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
CHROME_TAGS = set("head title script style noscript template nav menu footer aside form iframe object embed applet svg canvas video audio map button select option input textarea fieldset label dialog noframes noembed".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_WORDS = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promotion recommended related replies respond share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription teaser toast toolbar topbar widget".split())
#: Words that say nothing by themselves: a name made of these and at least one of the above is as that one.
PLAIN_WORDS = set("article articles area bar block body bottom box btn button buttons container content footer form global group header holder icons inner item items left link links list main media news outer panel posts right section site slot stories text top unit user wrap wrapper zone".split())


@dataclass
class Block:
    path: int  # number of the structural path
    text: str
    inside: bool  # in an article or main element
    linked: bool  # all of it is link text


@dataclass
class Paths:
    """Structural paths of a page: their names, enclosing paths, counts, and whether they are an article's."""

    names: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [-1])
    count: list[int] = field(default_factory=lambda: [1])
    whole: list[bool] = field(default_factory=lambda: [False])
    number: dict[str, int] = field(default_factory=lambda: {"": 0})

    def enter(self, above: int, name: str, whole: bool) -> int:
        path = f"{self.names[above]}>{name}"
        k = self.number.get(path)
        if k is None:
            k = self.number[path] = len(self.names)
            self.names.append(path)
            self.above.append(above)
            self.count.append(0)
            self.whole.append(whole)
        self.count[k] += 1
        return k

    def upwards(self, k: int) -> Iterator[int]:
        while k >= 0:
            yield k
            k = self.above[k]


def _names(attributes: dict[str, str]) -> str:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()


def _is_chrome(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in CHROME_TAGS or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in CHROME_ROLES:
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "article", "main"):
        return tag == "article" and bool({"comment", "comments", "teaser"} & set(_WORDS.findall(_names(attributes))))
    return any(_names_chrome(name) for name in _names(attributes).split())


def _names_chrome(name: str) -> bool:
    """A class or id name that as a whole is one of, or made of, such words: ad, share-buttons, but not
    share-price."""
    words = _WORDS.findall(name)
    return not CHROME_WORDS.isdisjoint(words) and all(w in CHROME_WORDS or w in PLAIN_WORDS for w in words) or name in ("header", "site-header", "page-header", "site_header", "page_header", "top-header", "global-header", "header-bar", "discussion")


def read(page: str | None) -> tuple[list[Block], Paths]:
    """Visible blocks that no name marks as chrome, in page order, and the structural paths."""
    blocks: list[Block] = []
    paths = Paths()
    if not page:
        return blocks, paths
    stack: list[tuple[str, int, bool, bool]] = []  # tag, path, chrome, inside
    text: list[str] = []
    plain = False
    path, chrome, inside, links = 0, False, False, 0

    def flush() -> None:
        nonlocal plain
        if text:
            words = " ".join(_html.unescape("".join(text)).split())
            if words:
                blocks.append(Block(path, words, inside, not plain))
            text.clear()
        plain = False

    def reset() -> None:
        nonlocal path, chrome, inside, links
        _, path, chrome, inside = stack[-1] if stack else ("", 0, False, False)
        links = sum(x[0] == "a" for x in stack)

    def pop_to(depth: int) -> None:
        if any(x[0] in BLOCK or x[2] for x in stack[depth:]):
            flush()
        del stack[depth:]
        reset()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else size
        if upto > at and not chrome:
            piece = page[at:upto]
            text.append(piece)
            plain = plain or (not links and not piece.isspace())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag), -1)
            if depth >= 0:
                pop_to(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in CLOSES_P:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == "p"), -1)
            if depth >= 0 and not any(x[0] in ("table", "td", "button", "object", "caption") for x in stack[depth:]):
                pop_to(depth)
        if tag in SIBLINGS:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in SCOPE[tag]:
                    break
                if stack[d][0] in SIBLINGS[tag]:
                    pop_to(d)
        if tag in BLOCK:
            flush()
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        if tag in RAW:  # its content is no markup
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        hidden = chrome or _is_chrome(tag, attributes, inside)
        if hidden and not chrome:
            flush()
        article = tag in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        here = path
        if tag in BLOCK and not hidden:
            names = "".join(f".{w}" for w in sorted(set(re.sub(r"\d+", "#", attributes["class"]).lower().replace(">", "_").split()))) if attributes.get("class") else ""
            here = paths.enter(path, tag + names, article)
        stack.append((tag, here, hidden, inside or article))
        reset()
    flush()
    return blocks, paths


def _token(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) >> 1


_PROSE = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")


def main_text(page: str | None, regions: set[int] | frozenset[int] = frozenset(), wording: set[int] | frozenset[int] = frozenset()) -> str:
    """Blocks of the region joined by newlines.  ``regions``: tokens of the host's paths that may be the region, the
    innermost that the page has counts; ``wording``: tokens of the template's texts."""
    blocks, paths = read(page)
    if not blocks:
        return ""
    region = max((k for k in range(1, len(paths.names)) if paths.count[k] == 1 and regions and _token(paths.names[k], "") in regions), key=lambda k: paths.names[k].count(">"), default=None)
    if region is not None:
        region = next((k for k in paths.upwards(region) if paths.whole[k]), region)
        narrow = not paths.names[region].rpartition(">")[2].startswith(("html", "body"))
        chosen = [b for b in blocks if region in paths.upwards(b.path)] if narrow else None
    else:
        chosen = [b for b in blocks if b.inside]
    if not chosen:  # the whole body, less lists of links
        chosen = [b for b in blocks if not b.linked or paths.names[b.path].rpartition(">")[2].startswith(_PROSE)]
    own = [b for b in chosen if _token(paths.names[b.path], b.text) not in wording] if wording else chosen
    return "\n".join(b.text for b in own or chosen)  # a page of the template's wording alone is not explained by it


def page_tokens(page: str | None) -> list[tuple[int, bool, int, int, int]]:
    """(token, is structure, count, prose inside, prose of the page) of each token; the page as a whole is token 0."""
    blocks, paths = read(page)
    prose = [0] * len(paths.names)
    seen: dict[int, int] = {}
    for b in blocks:
        token = _token(paths.names[b.path], b.text)
        seen[token] = seen.get(token, 0) + 1
        if not b.linked:
            for k in paths.upwards(b.path):
                prose[k] += len(b.text)
    out = [(0, True, 1, prose[0], prose[0])]
    out += [(_token(paths.names[k], ""), True, paths.count[k], prose[k], prose[0]) for k in range(1, len(paths.names))]
    return out + [(token, False, n, 0, 0) for token, n in seen.items()]


def host_templates(pages: DataFrame, min_pages: int = 4, min_share: float = 0.5) -> DataFrame:
    """(host, regions array<long>, wording array<long>).  pages: host (long), page (a random-like long, the same for
    equal pages), html.  A class must span min_pages distinct pages and min_share of its host's, so a template
    holds at most 1 / min_share times what the host's pages hold on average."""

    def tokens(batches):
        for batch in batches:
            rows = [(host, page, *t) for host, page, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for t in page_tokens(html)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "page", "token", "structure", "n", "prose", "total"])

    each = pages.select("host", "page", "html").mapInArrow(tidy(tokens, 256), "host long, page long, token long, structure boolean, n int, prose long, total long")
    distinct = each.groupBy("host", "token", "structure", "page").agg(F.max("n").alias("n"), F.max("prose").alias("prose"), F.max("total").alias("total"))
    sums = [F.sum(F.col("page").cast("decimal(38,0)") * F.col("n")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("times"), F.sum("prose").alias("prose"), F.sum("total").alias("total")]
    vectors = checkpoint(distinct.groupBy("host", "token", "structure").agg(*sums).where(F.col("pages") >= min_pages))  # used twice
    spans = vectors.where("token = 0").select(F.col("host").alias("h"), F.col("pages").alias("of"))
    frequent = vectors.join(spans, F.col("host") == F.col("h")).where(F.col("pages") >= F.col("of") * min_share)
    region = F.when(F.col("structure") & (F.col("token") != 0) & (F.col("times") == F.col("pages")) & (F.col("prose") * 2 >= F.col("total")), F.col("token"))
    classes = frequent.groupBy("host", "vector").agg(F.max("structure").alias("valid"), F.collect_list(region).alias("regions"), F.collect_list(F.when(~F.col("structure"), F.col("token"))).alias("wording")).where("valid")
    return classes.groupBy("host").agg(F.flatten(F.collect_list("regions")).alias("regions"), F.flatten(F.collect_list("wording")).alias("wording"))


#: Bytes of templates up to which they are sent to all executors, so that pages need not move.
_SENT = 32 << 20


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 4) -> DataFrame:
    """id, url, text, n_chars (code points) of every row.

    Null or empty html gives an empty text.  Pages without a host share no template, and equal pages of a host
    count once when it is deduced; repeated rows stay repeated; other columns are ignored.  Empty input: no rows.
    """
    host = url_host(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.when(host != "", F.xxhash64(host)).alias("_host"), F.col(f"`{html_col}`").alias(free_name([id_col, url_col], "_html")))
    html = rows.columns[3]
    hosted = rows.where(F.col("_host").isNotNull() & F.col(html).isNotNull())
    templates = host_templates(hosted.select(F.col("_host").alias("host"), F.shiftrightunsigned(F.xxhash64(html), 2).alias("page"), F.col(html).alias("html")), min_pages)
    # Checkpointed, so that the join has a plain exchange on either side and a hot host can be split.
    templates = checkpoint(templates.select(F.col("host").alias("_of"), F.col("regions").alias("_regions"), F.col("wording").alias("_wording")))
    size = templates.agg(F.coalesce(F.sum(64 + 8 * (F.size("_regions") + F.size("_wording"))), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(templates) if size <= _SENT else templates, F.col("_host") == F.col("_of"), "left").select(id_col, url_col, html, "_regions", "_wording")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, frozenset(r or ()), frozenset(w or ())) for h, r, w in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(tidy(run, 256), f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
