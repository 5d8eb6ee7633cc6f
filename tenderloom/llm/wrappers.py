"""HTML extraction by wrappers: union-free regular expressions that pages of one host share.

A page's tags and text slots form a token stream; repeated stretches are folded into groups ``(...)+``. The
distinct folded streams of a host are aligned one after the other: what one has and the other lacks becomes
an optional group, texts become slots, and neighbours that are alike become repeated groups. The result is
the host's wrapper. Its text slots lie in regions (chains of sectioning elements); the wrapper decides which
container holds the host's articles, and with that which regions are content. A page that has nothing in
its host's container is read by its own.

Alignment runs over distinct streams only, in chunks of at most about ``chunk`` streams a task, whose
wrappers are aligned again until a host has one; a host with a third of all pages is no hot key. The
wrappers are written, and joined to the pages by host: Spark broadcasts them only below its size threshold,
and splits a hot host otherwise.

The article is what lies in ``article``, else in ``main`` or a content block, else in the body, without
navigation, headers outside articles, footers, asides, forms, scripts, styles, controls, drawings, and elements of any name
whose class, id or role says menu, advert, notice, sidebar, comments and the like; a heading of such words goes with the
marked element that it stands before. A plain word counts where all of the name are such words (``related-posts``, not
``related-work``), names of ``has-`` and the like never, nothing inside code. Where that leaves a page empty, the marks
of elements that frame most of the page do not count. Character references are decoded, white
space inside a block becomes one space, blocks are joined by one line feed. Broken markup is read
leniently: a paragraph ends the one before, an end tag closes what is open above its start, a missing end
tag ends with its parent.

A null or empty html, and a page without content, give an empty text. A null url or one without a host
belongs to the empty host. Repeated rows get equal results. Empty tables give no rows. Columns besides
page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .urlrules import host_of

# HTML elements, and words in class, id or role that mark what is no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe".split())
#: Elements without article text; like others they end with their parent.
SILENT = set("noscript template svg select button object label datalist".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
REGIONS = set("article aside body details dialog div fieldset footer form header main menu nav section table".split())
PLACES = REGIONS | SILENT
OUTSIDE = set("aside dialog fieldset footer form menu nav".split())
#: Parts of a page: what holds one and most of the text is the frame of the page.
PARTS = set("article aside footer header main nav".split())
#: Words that mark an element wherever they stand in a name.
CLEAR = set(
    "ad ads advert advertisement advertisements adverts advertising adsbygoogle breadcrumb breadcrumbs commentlist complementary consent contentinfo cookie cookies "
    "disqus masthead nav navbar newsletter pagination popup promo sidebar sponsor sponsored sponsors toolbar".split()
)
MARKS = CLEAR | set(
    "banner comment comments footer header login menu modal navigation notice notices promotion related replies respond search share sharing skip social subscribe widget".split()
)
#: Words that may stand beside a plain mark in a name.
BESIDE = set(
    "area articles bar block body bottom box button buttons container count footer global group header icons inline inner items left link links list main more of outer page panel post posts "
    "primary right secondary section site stories tags the thread to top us wrap wrapper".split()
)
#: First words of names that speak of a layout or state, not of what the element holds.
STATES = set("has is no not with without".split())
#: Marks that say nothing on an element that is no region, such as a heading or a cell.
OF_REGIONS = {"banner", "header", "search"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTENT = set("article content entry main maincontent post story".split())
#: An opening tag of the key ends an open tag of the set first.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Ends of the search for an open tag: what is open outside of them stays open.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z0-9]+")
#: Letters outside ASCII do not match, so that no other letter ends an element.
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I | re.A) for name in RAW}
#: A slash at the end that is not part of a value without quotes.
SELF_CLOSED = re.compile(r"(?<![^\s\"'])/\Z|^[^=]*/\Z")
SLOT = "#"
LONGEST_REPEAT = 16


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("text", raw), ("open", name or name.mark) and ("close", name); contents of raw elements are skipped."""
    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:]
            return
        if found.start() > at:
            yield "text", page[at : found.start()]
        at = found.end()
        if found[1]:
            yield "close", found[1].lower()
        elif found[2]:
            name = found[2].lower()
            if name in RAW:
                end = RAW_ENDS[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in SILENT and SELF_CLOSED.search(found[3]):
                continue
            yield "open", name + (marks_of(found[3], name in REGIONS) if found[3] and name not in VOID else "")


def marks_of(attributes: str, region: bool) -> str:
    """``.boilerplate``, or for a region ``.content``, if class, id or role has such a name."""
    names = [WORDS.findall(name) for groups in NAMED.findall(attributes) for name in "".join(groups).lower().split()]
    if any(is_mark(words, region) for words in names):
        return ".boilerplate"
    return ".content" if region and any(CONTENT.intersection(words) for words in names) else ""


def is_mark(words: list[str], region: bool) -> bool:
    """Whether the words of a name say that its element is no article."""
    if not words or words[0] in STATES:
        return False
    if CLEAR.intersection(words):
        return True
    own = MARKS.intersection(words) if region else MARKS.intersection(words) - OF_REGIONS
    return bool(own) and all(w in MARKS or w in BESIDE or w.isdigit() for w in words)


class Walk:
    """The open elements while tokens pass, and the region of the place reached."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.region = ""

    def _cut(self, at: int) -> None:
        del self.open[at:]
        self.region = ">".join(x for x in self.open if x.endswith(".boilerplate") or x.partition(".")[0] in PLACES)

    def _last(self, names: set[str], fences: set[str]) -> int | None:
        for at in range(len(self.open) - 1, -1, -1):
            own = self.open[at].partition(".")[0]
            if own in names:
                return at
            if own in fences:
                return None
        return None

    def start(self, tag: str) -> None:
        name = tag.partition(".")[0]
        if name in VOID:
            return
        at = None
        if name in ENDS:
            at = self._last(ENDS[name], FENCES[name])
        elif name in BLOCKS:
            at = self._last({"p"}, REGIONS | {"noscript", "template", "object", "li", "td", "th", "blockquote", "dd"})
        if name in BLOCKS and name != "option":
            # Blocks in a drawing end it, as in browsers.
            drawn = self._last({"svg"}, {"foreignobject"})
            at = drawn if drawn is not None and (at is None or drawn < at) else at
        if name in ("article", "main"):
            # An article is not part of a menu, header, footer or control: that one was not closed.
            above = self._last(OUTSIDE | {"header", "button", "select"}, {"article", "main", "body"})
            at = above if above is not None and (at is None or above < at) else at
        if at is not None:
            self._cut(at)
        if tag != name and name not in REGIONS and self._last({"code", "pre"}, REGIONS) is not None:
            tag = name
        self.open.append(tag)
        if name in PLACES or tag.endswith(".boilerplate"):
            self._cut(len(self.open))

    def end(self, name: str) -> None:
        inline = name not in BLOCKS and name not in SILENT
        at = self._last({name}, BLOCKS if inline else set())
        if at is not None:
            self._cut(at)


# An expression is a list of items (body, optional, repeated); a body is a tuple of tags, slots and items.


def plain(body: tuple) -> str:
    """What a body matches when every item in it occurs once; items alike in this are aligned."""
    return "".join(x if isinstance(x, str) and x == SLOT else f"<{x}>" if isinstance(x, str) else plain(x[0]) for x in body)


def merged(a: tuple, b: tuple, repeated: bool = False) -> tuple:
    """One item for two that are alike."""
    bodies, left, right = a[0], _spread(a[0]), _spread(b[0])
    if a[0] != b[0] and len(left) == len(right):
        bodies = tuple(x if isinstance(x, str) or isinstance(y, str) else merged(x, y) for x, y in zip(left, right, strict=True))
    return (bodies, a[1] or b[1], a[2] or b[2] or repeated)


def _spread(body: tuple) -> list:
    """The parts of a body down to a level where alike bodies have equal numbers of them."""
    return [y for x in body for y in (x[0] if not isinstance(x, str) and len(x[0]) == 1 and not x[1] and not x[2] else (x,))]


def folded(items: list) -> list:
    """Adjacent stretches that are alike become one repeated item."""
    out: list = []
    names: list[str] = []
    for item in items:
        out.append(item)
        names.append(plain(item[0]))
        n = 1
        while n <= min(LONGEST_REPEAT, len(out) - 1):
            whole = "".join(names[-n:])
            if names[-n - 1] == whole and whole != SLOT:
                # One stretch more of the item before.
                one = out[-1] if n == 1 else (tuple(out[-n:]), False, False)
                both = merged(out[-n - 1], one, True) if n == 1 else (out[-n - 1][0], out[-n - 1][1], True)
                del out[-n:], names[-n:]
                out[-1] = both
                n = 1
            elif n > 1 and len(out) >= 2 * n and names[-2 * n : -n] == names[-n:]:
                group = tuple(merged(x, y) for x, y in zip(out[-2 * n : -n], out[-n:], strict=True))
                del out[-2 * n :], names[-2 * n :]
                out.append((group, False, True))
                names.append(whole)
                n = 1
            else:
                n += 1
    return out


def skeleton(page: str) -> list:
    """The folded expression of one page: tags, and slots for text that is not white space.

    An element that holds nothing or one item is an item of its own.
    """
    out: list = []
    for kind, value in tokens(page):
        if kind == "text":
            if value.strip() and (not out or out[-1][0] != (SLOT,)):
                out.append(((SLOT,), False, False))
            continue
        if kind == "close":
            opened = ((value,), False, False)
            for n in (1, 2):
                if len(out) >= n and out[-n][0][0].__class__ is str and out[-n][0][0].partition(".")[0] == value and len(out[-n][0]) == 1:
                    inner = tuple(x if x[1] or x[2] or len(x[0]) > 1 else x[0][0] for x in out[len(out) - n + 1 :])
                    opened = ((out[-n][0][0], *inner, f"/{value}"), False, False)
                    del out[-n:]
                    break
            else:
                opened = ((f"/{value}",), False, False)
            out.append(opened)
        else:
            out.append(((value,), False, False))
        out[-3:] = folded(out[-3:])
    return folded(out)


def aligned(a: list, b: list) -> list:
    """An expression for what either matches: items that one side lacks become optional."""
    out: list = []
    for op, i, k, j, m in SequenceMatcher(None, [plain(x[0]) for x in a], [plain(x[0]) for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [merged(x, y) for x, y in zip(a[i:k], b[j:m], strict=True)]
        else:
            out += [(body, True, repeated) for body, _, repeated in (*a[i:k], *b[j:m])]
    return folded(out)


def shown(expression: list | tuple) -> str:
    """The wrapper as text: ``<tag>``, ``#``, ``(...)+``, ``(...)?`` and ``(...)*``."""
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}
    one = lambda x: x if x == SLOT else f"<{x}>" if isinstance(x, str) else f"({shown(x[0])}){m}" if (m := mark[x[1], x[2]]) else shown(x[0])
    return "".join(map(one, expression))


def packed(expression: list) -> str:
    return json.dumps(expression, separators=(",", ":"))


def unpacked(text: str) -> list:
    frozen = lambda x: tuple(map(frozen, x)) if isinstance(x, list) else x
    return [frozen(x) for x in json.loads(text)]


def flat(expression: list | tuple) -> Iterator[str]:
    for x in expression:
        if isinstance(x, str):
            yield x
        else:
            yield from flat(x[0])


def container(expression: list) -> str:
    """Where a host's wrapper has its articles: article, main, content or body."""
    walk, found = Walk(), set()
    for item in flat(expression):
        if item == SLOT:
            parts = walk.region.split(">")
            if not any(outside(p, parts[:i]) for i, p in enumerate(parts)):
                found |= {p.partition(".")[0] for p in parts} | {"content" for p in parts if p.endswith(".content")}
        elif item[0] == "/":
            walk.end(item[1:])
        else:
            walk.start(item)
    return next((c for c in ("article", "main", "content") if c in found), "body")


def outside(part: str, above: list[str]) -> bool:
    """Whether an element with what it holds is no article."""
    name, _, mark = part.partition(".")
    if name in OUTSIDE or name in SILENT or mark == "boilerplate" and name != "body":
        return True
    return name == "header" and not any(x.partition(".")[0] in ("article", "main") for x in above)


def page_frames(page: str) -> set[str]:
    """Regions that hold most of a page's text and a part of a page each, such as its menu or article: a mark says nothing there."""
    walk, sizes, framing = Walk(), {}, set()
    for kind, value in tokens(page):
        if kind == "text":
            sizes[walk.region] = sizes.get(walk.region, 0) + len(value.strip())
        elif kind == "open":
            walk.start(value)
            parts = walk.region.split(">")
            if parts[-1].partition(".")[0] in PARTS:
                framing |= {">".join(parts[:k]) for k in range(1, len(parts))}
        else:
            walk.end(value)
    named = {r: n for r, n in sizes.items() if not any(outside(p.partition(".")[0], r.split(">")[:i]) for i, p in enumerate(r.split(">")))}
    inside = lambda frame: sum(n for r, n in named.items() if f"{r}>".startswith(f"{frame}>"))
    return {frame for frame in framing if frame.endswith(".boilerplate") and 2 * inside(frame) > sum(named.values())}


def is_content(region: str, where: str, frames: set[str] | frozenset[str] = frozenset()) -> bool:
    parts = region.split(">")
    if any(outside(p.partition(".")[0] if ">".join(parts[: i + 1]) in frames else p, parts[:i]) for i, p in enumerate(parts)):
        return False
    if where == "body":
        return True
    return any(p.endswith(".content") if where == "content" else p.partition(".")[0] == where for p in parts)


def article(page: str, where: str) -> str:
    """The text of a page by its host's container, by its own if it has nothing there, or else without the marks of its frames."""
    text = extracted(page, where)
    own = where if text else container(skeleton(page))
    text = text if own == where else extracted(page, own)
    if not text and (frames := page_frames(page)):
        text = next((t for c in ("article", "main", "content", "body") if (t := extracted(page, c, frames))), "")
    return text


def extracted(page: str, where: str, frames: set[str] | frozenset[str] = frozenset()) -> str:
    """The article of a page whose articles lie in ``where``; marks of ``frames`` do not count."""
    walk, blocks, own = Walk(), [], []
    known: dict[str, bool] = {}
    heading = False

    def close() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(own)).split())
        if text:
            blocks.append(text)
            heading = False
        own.clear()

    for kind, value in tokens(page):
        if kind == "text":
            region = walk.region
            if region not in known:
                known[region] = is_content(region, where, frames)
            if known[region]:
                own.append(value)
            continue
        name, _, mark = value.partition(".")
        if name in BLOCKS:
            close()
            if kind == "close" and name in HEADINGS and blocks:
                heading = all(w in MARKS or w in BESIDE or w.isdigit() for w in WORDS.findall(blocks[-1].lower())) and not MARKS.isdisjoint(WORDS.findall(blocks[-1].lower()))
        elif name == "br":
            own.append(" ")
        if kind == "open":
            if heading and mark == "boilerplate" and name in BLOCKS:
                # The heading of what is left out.
                blocks.pop()
                heading = False
            walk.start(value)
        else:
            walk.end(value)
    close()
    return "\n".join(blocks)


def infer_wrappers(pages: DataFrame, chunk: int = 200) -> DataFrame:
    """host, wrapper (as text), container and n_pages for every host of pages with host and html."""

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = pa.array([packed(skeleton(h or "")) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("host"), streams], ["host", "stream"])

    def align(group: pd.DataFrame) -> pd.DataFrame:
        # The commonest streams first, so that rare ones are read as variants of them.
        ordered = group.sort_values(["n", "stream"], ascending=[False, True])
        wrapper: list = []
        for k, stream in enumerate(ordered["stream"]):
            wrapper = aligned(wrapper, unpacked(stream)) if k else unpacked(stream)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "stream": [packed(wrapper)], "n": [int(group["n"].sum())]})

    streams = pages.select("host", "html").mapInArrow(skeletons, "host string, stream string").groupBy("host", "stream").agg(F.count("*").alias("n"))
    streams = written(streams, "streams")
    while True:
        sizes = streams.groupBy("host").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
        most = sizes.agg(F.max("chunks")).first()[0] or 1
        dealt = streams.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.col("chunks")))
        streams = written(dealt.groupBy("host", "part").applyInPandas(align, "host string, stream string, n bigint"), "streams")
        if most == 1:
            break

    @F.pandas_udf("wrapper string, container string")
    def described(wrappers: pd.Series) -> pd.DataFrame:
        read = wrappers.map(unpacked)
        return pd.DataFrame({"wrapper": read.map(shown), "container": read.map(container)})

    return streams.select("host", described("stream").alias("d"), F.col("n").alias("n_pages")).select("host", "d.wrapper", "d.container", "n_pages")


def extract_pages(pages: DataFrame, chunk: int = 200) -> DataFrame:
    """page_id, url, text, n_chars and container for every row with page_id, url and html."""
    kind = dict(pages.dtypes)["page_id"]
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = written(infer_wrappers(hosted, chunk).select("host", "container"), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(h, c) if h else "" for h, c in zip(batch.column("html").to_pylist(), batch.column("container").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("container")]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "container"])

    joined = hosted.join(wrappers, "host").select("page_id", "url", "html", "container")
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars bigint, container string")
