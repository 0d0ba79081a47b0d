"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, menus, notices and
footers included. A line weighs its characters outside links, times the share of
its place: the text of the element that holds it (and of that element's parent)
against the page's heaviest. A lone notice or footer thus weighs little beside
an article, whatever it is called. Weights are summed over sliding windows of
lines. Where the sums surge to SURGE or more from nothing the main text begins,
where they dive to nothing for the last time it ends, and all text between the
two points is kept: short paragraphs and lists of links too. Lines at either
end whose place has less than half of the heaviest place's text are left out;
where no sum surges that far, the highest run of sums is the main text.

Names break ties. Lines that element, class or role names mark as menus,
headers, footers, side bars, notices, adverts, forms or reader comments, and
lines outside an <article> or <main> that holds at least half of the page's
text, have a tenth of their weight; between surge and dive they are left out
unless their own windows surge even so.

Each page is worked on alone, in time linear in its length whatever its markup,
so a job has no shuffle and any number of rows. Null or empty html gives the
empty text; unclosed and crossed tags are closed where their parent ends; a
quote that never closes ends at the tag's end; a page without text lines gives
the empty text. Repeated rows give repeated results, other columns pass
through, and a column of the same name as the output is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import slices, table, text_array

#: Lines on either side of one whose lengths are summed with its own.
REACH = 1
#: Weight in a window at which the sums surge.
SURGE = 60
#: What is left of a line's weight where names speak against it, and the share of the heaviest place that a line at either end needs.
NAMED_WEIGHT, EDGE_SHARE = 0.1, 0.5

# Element names and the words of class, id and role that mark what is not the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
PARAGRAPHS = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li option p pre summary td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
UNSEEN = RAW | frozenset("head noscript template svg math object".split())
DROPPED = UNSEEN | frozenset("nav header footer aside form button select menu dialog label input".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation topnav breadcrumb breadcrumbs header masthead topbar footer colophon sidebar aside rail notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup comment comments commentlist disqus respond replies".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog".split())
MAIN = frozenset(("article", "main"))

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s{0,9}=\s{0,9}("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
LONG = re.compile(r"&#(?:([xX])0*([0-9a-fA-F]+)|0*([0-9]+))(;?)")


def boilerplate(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for kind, value in NAMED.findall(attributes):
        words = PARTS.split(value.lower())
        if not (ROLES if kind.lower() == "role" else MARKED).isdisjoint(words):
            return True
    return False


def tag_end(html: str, at: int) -> int:
    """Where the tag's attributes, which begin at `at`, end: at its `>` outside quotes, or after a quote that never closes; -1 if nowhere."""
    while stop := STOP.search(html, at):
        if stop[0] == ">":
            return stop.start()
        closing = html.find(stop[0], stop.end())
        if closing < 0:
            return html.find(">", stop.end())
        at = closing + 1
    return -1


def clean(raw: str) -> str:
    """Character references decoded and white space made one blank; a number beyond all characters is the replacement character."""
    if "&#" in raw:
        raw = LONG.sub(lambda m: f"&#{m[1] or ''}{m[2] or m[3]}{m[4]}" if len(m[2] or m[3]) < 9 else "\ufffd", raw)
    return " ".join(unescape(raw).split())


class Line:
    """A block's text, its length outside links, whether it is inside the marked article, whether names speak against it, and the places (numbers of elements) that hold it."""

    __slots__ = ("text", "plain", "inside", "named", "place", "parent")

    def __init__(self, text: str, plain: int, inside: bool, named: bool, place: int, parent: int):
        self.text, self.plain, self.inside, self.named, self.place, self.parent = text, min(plain, len(text)), inside, named, place, parent


def lines_of(html: str) -> list[Line]:
    """The lines of a page, one for each block that has text, in page order."""
    lines: list[Line] = []
    held: list[str] = []
    plain = 0
    stack: list[str] = []
    places: list[int] = [0]  # the elements that hold paragraphs, from the page inward
    depths: list[int] = [0]
    opened = 0
    open_: Counter[str] = Counter()
    named_at = unseen = 0  # the depths from which names speak against text, and from which it is no line

    def flush() -> None:
        nonlocal plain
        if held:
            text = clean("".join(held))
            if text:
                lines.append(Line(text, plain, open_["article"] + open_["main"] > 0, named_at > 0, places[-1], places[-2] if len(places) > 1 else 0))
            held.clear()
        plain = 0

    def text(a: int, b: int) -> None:
        nonlocal plain
        if a < b and not unseen:
            held.append(html[a:b])
            if not open_["a"]:
                plain += b - a

    def pop() -> None:
        nonlocal named_at, unseen
        if named_at == len(stack):
            flush()
            named_at = 0
        if unseen == len(stack):
            unseen = 0
        if depths[-1] == len(stack):
            flush()
            places.pop()
            depths.pop()
        open_[stack.pop()] -= 1

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            text(at, end)
            break
        if html.startswith("<!--", lt):
            text(at, lt)
            close = html.find("-->", lt + 2)
            at = close + 3 if close >= 0 else end
            continue
        if html.startswith("<![CDATA[", lt):
            text(at, lt)
            close = html.find("]]>", lt)
            text(lt + 9, close if close >= 0 else end)
            at = close + 3 if close >= 0 else end
            continue
        tag = NAME.match(html, lt + 1)
        if not tag:
            if html.startswith(("<!", "<?"), lt):
                text(at, lt)
                close = html.find(">", lt)
                at = close + 1 if close >= 0 else end
            else:
                text(at, lt + 1)
                at = lt + 1
            continue
        text(at, lt)
        to = tag_end(html, tag.end())
        if to < 0:
            break
        attributes = html[tag.end() : to]
        at = to + 1
        name = tag[1].lower()
        if name in BLOCKS and not unseen:
            flush()
        if html[lt + 1] == "/":
            if open_[name]:
                while stack[-1] != name:
                    pop()
                pop()
            continue
        if name == "br" and not unseen:
            held.append(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if stack and (name in BLOCKS and stack[-1] == "p" or name == stack[-1] in ("li", "option", "dt", "dd", "tr", "td", "th")):
            pop()
        if not named_at and not unseen and boilerplate(name, attributes):
            if name in BLOCKS and name not in UNSEEN:
                flush()
                named_at = len(stack) + 1
            else:  # within a block, which goes on after it
                unseen = len(stack) + 1
        elif not unseen and name in UNSEEN:
            unseen = len(stack) + 1
        stack.append(name)
        open_[name] += 1
        if name in BLOCKS and name not in PARAGRAPHS and not unseen:
            opened += 1
            places.append(opened)
            depths.append(len(stack))
        if name in RAW:
            close_tag = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = close_tag.start() if close_tag else end
    flush()
    return lines


def windowed(weights: list[float], reach: int = REACH) -> list[float]:
    """Of each line the weights summed over the lines within reach."""
    n = len(weights)
    return [sum(weights[max(0, i - reach) : i + reach + 1]) for i in range(n)]


def weighed(lines: list[Line]) -> tuple[list[float], list[float], list[bool]]:
    """Of each line its weight, the share of its place, and whether names speak against it."""
    inside = sum(x.plain for x in lines if x.inside)
    heeded = inside > 0 and 2 * inside >= sum(x.plain for x in lines)
    against = [x.named or heeded and not x.inside for x in lines]
    own: Counter[int] = Counter()
    for x, bad in zip(lines, against, strict=True):
        own[x.place] += x.plain * (NAMED_WEIGHT if bad else 1)
    held = [own[x.place] + (own[x.parent] if x.parent != x.place else 0) for x in lines]
    most = max(held, default=0) or 1
    share = [1.0 if heeded and x.inside else h / most for x, h in zip(lines, held, strict=True)]
    # Within marks, links are text as any other.
    plain = [len(x.text) if heeded and x.inside else x.plain for x in lines]
    return [n * s * (NAMED_WEIGHT if bad else 1) for n, s, bad in zip(plain, share, against, strict=True)], share, against


def between(lines: list[Line], reach: int = REACH) -> list[str]:
    """The text from the first surge of the windowed sums to the last dive."""
    weights, share, against = weighed(lines)
    sums = windowed(weights, reach)
    runs: list[tuple[int, int, float]] = []  # surge, dive, highest sum
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive]:
            dive += 1
        text = [k for k in range(i, dive) if weights[k] and share[k] >= EDGE_SHARE and not against[k]] or [k for k in range(i, dive) if weights[k]]
        runs.append((text[0], text[-1] + 1, max(sums[i:dive])))
        i = dive
    if not runs:
        return []
    surged = [x for x in runs if x[2] >= SURGE] or [max(runs, key=lambda x: (x[2], -x[0]))]
    alone = windowed([w if bad else 0 for w, bad in zip(weights, against, strict=True)], reach)
    return [lines[k].text for k in range(surged[0][0], surged[-1][1]) if not against[k] or alone[k] >= SURGE]


def main_text(html: str) -> str:
    return "\n".join(between(lines_of(html)))


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df without its html, with the main text of each page."""
    df = df.drop(out) if out != html else df
    kept = [x for x in df.columns if x != html]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = pa.array([main_text(x) for x in text_array(part, html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), texts], names=[*kept, out])

    return df.mapInArrow(extract, T.StructType([*(df.schema[x] for x in kept), T.StructField(out, T.StringType())]))


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_line_blocks": op9_line_blocks}
