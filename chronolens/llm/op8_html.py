"""Main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path (names of
elements, and of classes for elements that are no running text).  For every path
the text length and the punctuation of its blocks are aggregated into two ratios;
both are smoothed over the page's order, fused, weighed by weak evidence, and held
against a threshold: paths above it hold content.

Weak evidence multiplies a ratio by WEAK: for text outside article and main where
a page has them, inside an element that seldom holds article text (menus, forms,
footers and the like), and inside one whose whole class, id or role names such a
thing.  The threshold goes by the page's own ratios, so evidence that holds for
everything decides nothing.

A block that is mostly links needs the ratio by itself.  Headings and running text
below the threshold (paragraphs, items, cells that aren't made of links) stay where
their parent holds content.  Blocks are joined in page order.

Defined results
  * null or empty html, or a page without content: empty text;
  * unclosed, crossed and stray tags are read as browsers do for the elements
    whose end may be left out; a page cut off anywhere is read to its end;
  * very long and deeply nested pages are read whole, in time and memory linear in
    their length;
  * white space (Unicode's) in a block becomes one space, blocks are joined by
    two line feeds; ``<br>`` is white space;
  * repeated rows are extracted one by one; extra columns are kept, columns with
    the result's names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import bound_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'<>]+)", re.S)
_WORDS = re.compile(r"[a-z0-9]+")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video noembed noframes textarea title xmp".split())
_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr label output".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search table ul".split()
)
SELDOM = frozenset("nav footer aside form button select option menu dialog head search fieldset datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre".split())
GROUPS = frozenset("ul ol dl li table thead tbody tfoot tr figure blockquote hgroup header".split())

#: Names of class, id or role that are evidence against article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices banner popup modal "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars related recommended "
    "footer masthead header comment comments replies disqus newsletter subscribe share sharing social contentinfo complementary".split()
)
#: Words that may stand beside a mark in one name.
PLACES = frozenset("site left right wrapper container box".split())
#: What a piece of evidence leaves of a ratio.
WEAK = 0.02

PUNCTUATION = frozenset(".,;:!?…。，、；：！？¿¡")

#: Fused ratio of whole sentences (100 characters, two marks): content, however long other blocks are.
SENTENCE = 100 * math.log(3.1)

_GAUSS = [math.exp(-0.5 * k * k) for k in (-1, 0, 1)]
_GAUSS = [g / sum(_GAUSS) for g in _GAUSS]


class Element:
    """An open or closed element; what it inherits is fixed when it opens."""

    __slots__ = ("tag", "parent", "label", "path", "marked", "against", "hidden", "holds", "inside", "link")

    def __init__(self, tag: str, parent: "Element | None", attrs: str = "", paths: dict | None = None):
        self.tag, self.parent, self.holds = tag, parent, False
        self.link = tag == "a" or tag in INLINE and parent is not None and parent.link
        if parent is None:
            self.path, self.against, self.hidden, self.inside, self.marked, self.label = 0, (), False, None, False, ""
            return
        self.hidden, self.marked, self.label = _read(tag, attrs, parent) if attrs else (False, False, "")
        self.hidden |= parent.hidden
        self.inside = parent.inside or (self if tag in ("article", "main") else None)
        key = (parent.path, tag if tag in RUNNING or tag in INLINE or not self.label else f"{tag}.{self.label}")
        self.path = paths.setdefault(key, len(paths) + 1)
        odd = self.marked or tag in SELDOM or tag == "header" and self.inside is None
        self.against = (self, parent.against) if odd else parent.against  # elements around that are evidence


def _names(value: str) -> set[str]:
    """The marks among whole names: names all of whose words are marks or places."""
    found: set[str] = set()
    for name in value.lower().split():
        words = {w for w in _WORDS.findall(name) if not w.isdigit()}
        if words <= MARKS | PLACES:
            found |= words & MARKS
    return found


def _read(tag: str, attrs: str, parent: Element) -> tuple[bool, bool, str]:
    """(hidden, named like something other than article text, class) of an element."""
    hidden, marked, label = False, False, ""
    for m in _ATTRIBUTE.finditer(attrs):
        name = (m[1] or m[5]).lower()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            if name == "class":
                label = value
            names = _names(value)
            if tag in ("html", "body", "article", "main"):
                names &= {"comment", "comments"} if tag == "article" else set()
            if parent.inside is not None:
                names.discard("header")
            marked |= bool(names) and tag not in RUNNING
    return hidden, marked, label


def blocks(page: str) -> list[tuple[Element, str, bool]]:
    """(element, text, whether most of it is links) of each block of text in page order."""
    out: list[tuple[Element, str, bool]] = []
    top = Element("", None)
    stack = [top]
    open_: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}
    words: list[str] = []
    linked = 0
    holder = top

    def flush():
        nonlocal words, linked
        if words:
            text = " ".join(_html.unescape("".join(words)).split())
            if text and not holder.hidden:
                out.append((holder, text, 2 * linked > sum(len(w) for w in words if not w.isspace())))
            words, linked = [], 0

    def push(tag: str, attrs: str) -> Element:
        e = Element(tag, stack[-1], attrs, paths)
        stack.append(e)
        open_[tag] = open_.get(tag, 0) + 1
        return e

    def pop_to(k: int):
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    def block_holder() -> Element:
        for e in reversed(stack):
            if e.tag not in INLINE:
                return e
        return top

    at, n = 0, len(page)
    endless: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not words:
                holder = block_holder()
            words.append(page[at:lt])
            if stack[-1].link and not words[-1].isspace():
                linked += lt - at
        if lt == n:
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            if not words:
                holder = block_holder()
            words.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if page.startswith("<![CDATA[", lt):
                words.append(_html.escape(page[lt + 9 : at].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if not m["end"]:
            if tag in INLINE:
                e = push(tag, m["attrs"])
                if e.marked or e.hidden and not e.parent.hidden:
                    flush()
                    holder = e
                continue
            if tag == "br":
                words.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if m["attrs"].endswith("/") and tag in ("svg", "math", "iframe"):
                    continue
                end = None if tag in endless else _END[tag].search(page, at)
                if end is None:
                    endless.add(tag)
                    at = n if tag in ("script", "style") else at
                else:
                    gt = page.find(">", end.end())
                    at = n if gt < 0 else gt + 1
                continue
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        pop_to(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            closes, stop = {
                "li": (("li",), ("ul", "ol", "menu")),
                "dt": (("dt", "dd"), ("dl",)),
                "dd": (("dt", "dd"), ("dl",)),
                "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
                "td": (("td", "th"), ("tr", "table")),
                "th": (("td", "th"), ("tr", "table")),
                "option": (("option",), ("select",)),
                "body": (("head",), ("html",)),
            }.get(tag, ((), ()))
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closes:
                        pop_to(k)
                        if tag != "tr":
                            break
                    elif stack[k].tag in stop:
                        break
            e = push(tag, m["attrs"])
            if tag in ("article", "main"):
                up = e.parent
                while up is not None and not up.holds:
                    up.holds = True
                    up = up.parent
        else:
            if tag in RAW or tag in VOID or not open_.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag not in INLINE or stack[k].marked or stack[k].hidden:
                        flush()
                    pop_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
    flush()
    return out


def bounded(found: list[tuple[Element, str, bool]]) -> bool:
    """Whether the page has an article or main element without evidence against it."""
    return any(e.inside is not None and not _against(e.against) for e, _, _ in found)


def evidence(found: list[tuple[Element, str, bool]]) -> list[float]:
    """What weak evidence leaves of each block's ratio."""
    bound = bounded(found)
    return [(WEAK if bound and e.inside is None else 1.0) * (WEAK if _against(e.against) else 1.0) for e, _, _ in found]


def _against(chain: tuple) -> bool:
    """Whether an element around is evidence; one that holds the page's article or main is none."""
    while chain:
        if not chain[0].holds:
            return True
        chain = chain[1]
    return False


def ratios(found: list[tuple[Element, str, bool]]) -> list[tuple[float, float]]:
    """Of each block's path: characters and punctuation marks for each block."""
    sums: dict[int, list[int]] = {}
    for e, text, _ in found:
        s = sums.setdefault(e.path, [0, 0, 0])
        s[0] += len(text)
        s[1] += sum(map(text.count, PUNCTUATION))
        s[2] += 1
    return [(s[0] / s[2], s[1] / s[2]) for s in (sums[e.path] for e, _, _ in found)]


def smooth(v: list[float]) -> list[float]:
    """Gaussian means over neighbours; the ends are repeated."""
    wide = [v[0], *v, v[-1]]
    return [sum(g * x for g, x in zip(_GAUSS, wide[i : i + 3])) for i in range(len(v))]


def fuse(length: float, marks: float) -> float:
    """One ratio of two; text without any punctuation keeps a little of its length."""
    return length * math.log(1.1 + marks)


def scores(found: list[tuple[Element, str, bool]]) -> list[float]:
    """Fused, smoothed path ratio of each block, weighed by evidence.

    Neighbours pull a block down, not up: text beside an advert doesn't lift it.
    """
    raw = ratios(found)
    smoothed = zip(*(smooth([r[j] for r in raw]) for j in (0, 1)))
    return [w * min(fuse(*a), fuse(*b)) for w, a, b in zip(evidence(found), smoothed, raw)]


def threshold_of(fused: list[float], found: list[tuple[Element, str, bool]]) -> float:
    """Mean less spread over the page's text, half the spread at least; no more than a
    sentence's ratio.  Blocks count by their length, so many short ones don't pull it down.
    """
    total = sum(len(t) for _, t, _ in found)
    mean = sum(f * len(t) for f, (_, t, _) in zip(fused, found)) / total
    spread = math.sqrt(sum(len(t) * (f - mean) ** 2 for f, (_, t, _) in zip(fused, found)) / total)
    return min(max(fused), SENTENCE, max(0.5 * spread, mean - spread))


def _around(e: Element) -> Element | None:
    """The element that e's list, table or figure stands in, or e's parent."""
    up = e.parent
    while up is not None and up.tag in GROUPS:
        up = up.parent
    return up


def extract(page: str | None) -> str:
    """Main text of a page."""
    found = blocks(page) if page else []
    if not found:
        return ""
    fused = scores(found)
    threshold = threshold_of(fused, found)
    paths: dict[int, float] = {}
    for (e, _, _), f in zip(found, fused):
        paths[e.path] = max(paths.get(e.path, 0.0), f)

    def alone(text: str) -> bool:
        return fuse(len(text), sum(map(text.count, PUNCTUATION))) >= threshold

    kept = {i for i, (e, t, linked) in enumerate(found) if paths[e.path] >= threshold and (not linked or alone(t))}
    held: set[Element] = set()
    for i in kept:
        e: Element | None = found[i][0]
        while e is not None and e not in held:
            held.add(e)
            e = e.parent

    def running(e: Element, linked: bool) -> bool:
        return e.tag in RUNNING and (e.tag in HEADINGS or not linked)

    # wrappers of a title and running text only
    titled = {_around(e) for e, _, _ in found if e.tag in ("h1", "h2")} - held
    passed: set[Element] = set()
    for i, (e, _, linked) in enumerate(found):
        if titled and i not in kept and not running(e, linked):
            up = e.parent
            while up is not None and up not in passed:
                passed.add(up)
                titled.discard(up)
                up = up.parent

    bound = bounded(found)

    def beside(e: Element, linked: bool) -> bool:
        """Whether e is running text or a heading where content stands."""
        if not running(e, linked) or bound and e.inside is None:
            return False
        up = _around(e)
        if up in titled:
            return up.parent in held and not _against(up.against)
        return up in held and (not e.against or e.against is up.against)

    return "\n\n".join(t for i, (e, t, linked) in enumerate(found) if i in kept or beside(e, linked))


def extract_text(df: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """``df`` with ``text``, the main text; without ``html`` unless kept."""
    bound_batches(df.sparkSession)
    carried = [f for f in df.schema.fields if f.name != "text" and (keep_html or f.name != html)]
    schema = T.StructType([*carried, T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(html)
            step = 500
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = [extract(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(f.name)) for f in carried], pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


ORACLE = None
