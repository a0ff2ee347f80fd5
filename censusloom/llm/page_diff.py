"""Main text of web pages: difference each page with the pages of nearest URL on its host.

Pages are cut into blocks (lines). The pages of a host are sorted by URL path, each page is
aligned with its ``REACH`` neighbours on either side by a longest common subsequence of lines,
and lines in common count as shared. Shared lines vote on their *place* (the chain of elements
and classes around them): a place most of whose lines are shared is template, with all its
lines; the votes of a host decide, those of all hosts where a host has too few.

Which lines go, in this order:

* what markup names for certain (menus, headers, footers, sidebars, forms, scripts, styles,
  and containers whose class or id says advert, notice, comments and the like);
* on pages that mark their article (``article``, ``main``), all outside of it, and inside it
  the containers that are template by vote; repeated passages in plain paragraphs stay;
* on all other pages, template places, and lines shared with at least a quarter of the
  neighbours that are not copies of the page.

No host is one group: sorted pages are dealt in runs of ``RUN`` positions, with ``REACH``
pages of the next runs as context. Only hashes of lines are shuffled; texts stay in the scan.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.llm.common import map_batches, stored

REACH = 4
RUN = 256
_EVIDENCE = 8  # compared lines from which a host decides about a place by itself
_BROADCAST_BYTES = 32 << 20

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike "
    "strong sub sup time tt u var wbr img br nobr blink center picture source rp rt".split()
)
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object select canvas audio video".split())
_NEVER = frozenset("head nav footer aside form button dialog menu fieldset legend option datalist".split())
_PLAIN = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption "
    "div section hgroup header address details summary article main center".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre section table ul".split()
)
# What a new element of the first kind ends, within the nearest of the second.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
# Words in class, id and role that name what is not the article.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars complementary contentinfo footer masthead comment comments disqus respond replies reply share "
    "sharing social related recommended newsletter subscribe signup login search pagination pager toolbar widget widgets skip".split()
)
_HINTS_OUTSIDE = frozenset("banner header topbar".split())  # inside an article these may hold its title
_HINTS_OF_ARTICLES = frozenset("comment comments ad ads advert advertisement sponsored related promo reply teaser".split())
_NOT_A_HINT = frozenset("no has with without not".split())

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)|</>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>])*?)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])[0-9]*|[A-Z][a-z0-9]*")
_URL = re.compile(r"\A\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?")
_SPACES = re.compile(r"\s+")

OUT, MAIN, INNER, OPEN = 0, 1, 2, 3  # named by markup; in the article; there, in a container with a name; anything else


class _Element:
    __slots__ = ("article", "inner", "name", "out", "place")

    def __init__(self, name: str, place: str, out: bool, article: int, inner: bool):
        self.name, self.place, self.out, self.article, self.inner = name, place, out, article, inner


def _opened(name: str, attributes: str, parent: _Element) -> _Element:
    words: set[str] = set()
    named, article = "", {"main": 1, "article": 2}.get(name, 0)
    out = parent.out or name in _NEVER or (name == "header" and not parent.article)
    if attributes.strip(" /\t\r\n"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out = True
            elif key == "itemprop":
                article = max(article, 2 if "articlebody" in value.lower() else 0)
            elif key == "role" and value.lower() in ("main", "article"):
                article = max(article, 1 if value.lower() == "main" else 2)
            else:
                named += "." + ".".join(sorted(value.split()))
                for token in value.split():
                    found = {w.lower() for w in _WORDS.findall(token)}
                    if not found & _NOT_A_HINT:
                        words |= found
        if name in ("article", "main") or article:
            out = out or bool(words & _HINTS_OF_ARTICLES)
        elif name not in ("html", "body"):
            out = out or bool(words & _HINTS) or (not parent.article and bool(words & _HINTS_OUTSIDE))
    within = max(parent.article, article)
    inner = (parent.inner or bool(named) or name not in _PLAIN) if parent.article and not article else False
    return _Element(name, f"{parent.place}/{name}{named}", out, within, inner)


def blocks_of(page: str) -> list[tuple[str, str, int]]:
    """(text, place, kind) of each block with text, in page order; see the constants for kinds."""
    stack = [_Element("", "", False, 0, False)]
    found: list[tuple[str, str, bool, int, bool]] = []
    runs: list[str] = []

    def end_block() -> None:
        if runs:
            text = _SPACES.sub(" ", "".join(runs)).strip()
            runs.clear()
            if text:
                top = stack[-1]
                found.append((text, top.place, top.out, top.article, top.inner))

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in within:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        run = page[at : m.start() if m else size]
        if run:
            runs.append(html.unescape(run) if "&" in run else run)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            if name in _INLINE:
                if name == "br":
                    runs.append(" ")
                elif stack[-1].name == name:
                    end_block()
                    stack.pop()
                continue
            end_block()
            if any(e.name == name for e in stack):
                while stack.pop().name != name:
                    pass
            continue
        if name in _RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            runs.append(" ")
            continue
        if name in _INLINE:
            if name in _VOID:
                runs.append(" " if name == "br" else "")
                continue
            if m[3] or stack[-1].name == name:
                element = _opened(name, m[3], stack[-1])
                if element.out and (not stack[-1].out or stack[-1].name == name):  # an advert in a line
                    end_block()
                    stack.append(element)
            continue
        end_block()
        if name in _VOID:
            continue
        if name in _CLOSES_P:
            close(("p",), ("article", "main", "section", "td", "th", "body", "button", "object"))
        if name in _ENDS:
            close(*_ENDS[name])
        if name == "body":
            close(("head",), ())
        stack.append(_opened(name, m[3], stack[-1]))
    end_block()
    level = max((a for _, _, out, a, _ in found if not out), default=0)
    return [
        (text, place, OUT if out else OPEN if not level else OUT if article < level else INNER if inner else MAIN)
        for text, place, out, article, inner in found
    ]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def address(url: str | None) -> tuple[str, str]:
    """(host, sort key of path and query); pages without a URL are on the host ''."""
    m = _URL.match(url or "")
    path = re.sub(r"(?:/|/?index\.\w+|\.x?html?|\.php)\Z", "", m[2], flags=re.I)
    return (m[1] or "").lower(), path + (m[3] or "")


# ---- alignment


def _row_lengths(a: list[int], b: list[int]) -> int:
    """Bits over ``b``: bit j is unset where one more line of b[:j + 1] is common with all of ``a``."""
    where: dict[int, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        hit = row & where.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (i, j) of a longest common subsequence, in linear space.

    Equal ends are matched first; the rest, without lines that only one side has, is halved at
    the place where the bit-parallel lengths of both halves sum up to the most.
    """
    pairs: list[tuple[int, int]] = []

    def go(xs: list[int], ys: list[int]) -> None:  # positions
        head = 0
        while head < len(xs) and head < len(ys) and a[xs[head]] == b[ys[head]]:
            pairs.append((xs[head], ys[head]))
            head += 1
        xs, ys = xs[head:], ys[head:]
        tail = 0
        while tail < len(xs) and tail < len(ys) and a[xs[-1 - tail]] == b[ys[-1 - tail]]:
            pairs.append((xs[-1 - tail], ys[-1 - tail]))
            tail += 1
        if tail:
            xs, ys = xs[:-tail], ys[:-tail]
        left, right = {a[x] for x in xs}, {b[y] for y in ys}
        xs, ys = [x for x in xs if a[x] in right], [y for y in ys if b[y] in left]
        if not xs or not ys:
            return
        if len(xs) == 1:
            pairs.append((xs[0], next(y for y in ys if b[y] == a[xs[0]])))
            return
        middle = len(xs) // 2
        upper = _row_lengths([a[x] for x in xs[:middle]], [b[y] for y in ys])
        lower = _row_lengths([a[x] for x in reversed(xs[middle:])], [b[y] for y in reversed(ys)])
        size = len(ys)
        bits_up, bits_low = (f"{v:0{size}b}" for v in (upper, lower))  # most significant first
        rest = bits_low.count("0")  # common with ys[0:]
        best, cut, so_far = rest, 0, 0
        for k in range(1, size + 1):
            so_far += bits_up[size - k] == "0"
            rest -= bits_low[k - 1] == "0"
            if so_far + rest > best:
                best, cut = so_far + rest, k
        go(xs[:middle], ys[:cut])
        go(xs[middle:], ys[cut:])

    go(list(range(len(a))), list(range(len(b))))
    return sorted(pairs)


_THIN = "host string, path string, ident string, lines array<bigint>, places array<bigint>, kinds array<int>"
_SHARED = "host string, ident string, partners int, places array<bigint>, kinds array<int>, shared array<int>"


def _thin(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {n.split()[0]: [] for n in _THIN.split(", ")}
        for url, ident, page in zip(batch["url"].to_pylist(), batch["ident"].to_pylist(), batch["html"], strict=True):
            blocks = blocks_of(page.as_py())
            host, path = address(url)
            row = (host, path, ident, [_hash(b[0]) for b in blocks], [_hash(b[1]) for b in blocks], [b[2] for b in blocks])
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield out


def _compare(run: pa.Table) -> pa.Table:
    """Each page of a run with its neighbours; pages of other runs are context only."""
    pages = sorted(run.to_pylist(), key=lambda r: r["position"])
    counts = [[0] * len(p["lines"]) for p in pages]
    partners = [0] * len(pages)
    for i, page in enumerate(pages):
        for j in range(i + 1, min(i + 1 + REACH, len(pages))):
            other = pages[j]
            if other["host"] != page["host"]:
                break
            if not (page["own"] or other["own"]):
                continue
            pairs = common_lines(page["lines"], other["lines"])
            if len(pairs) >= 0.95 * max(len(page["lines"]), len(other["lines"]), 1):
                continue  # a copy tells nothing about the template
            partners[i] += 1
            partners[j] += 1
            for x, y in pairs:
                counts[i][x] += 1
                counts[j][y] += 1
    own = [i for i, p in enumerate(pages) if p["own"]]
    columns = {
        "host": [pages[i]["host"] for i in own], "ident": [pages[i]["ident"] for i in own],
        "partners": [partners[i] for i in own], "places": [pages[i]["places"] for i in own],
        "kinds": [pages[i]["kinds"] for i in own], "shared": [counts[i] for i in own],
    }
    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.table({n: pa.array(v, type=k) for (n, v), k in zip(columns.items(), kinds, strict=True)})


def shared_lines(pages: DataFrame) -> DataFrame:
    """For each different page: its neighbours that are no copies, and with how many it shares each block."""
    thin = map_batches(pages, _thin, _THIN)
    order = ["host", "path", "ident"]
    ranged = thin.dropDuplicates(order).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "pages")
    part = F.shiftright("at", 33)
    sizes = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    starts = pages.sparkSession.createDataFrame(offsets, "part bigint, start bigint")
    placed = ranged.withColumn("part", part).join(F.broadcast(starts), "part")
    placed = placed.withColumn("position", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "start")
    run = F.floor(F.col("position") / RUN)
    near = F.array_distinct(F.array(run, F.floor((F.col("position") - REACH) / RUN), F.floor((F.col("position") + REACH) / RUN)))
    dealt = placed.withColumn("run", F.explode(near)).withColumn("own", F.col("run") == run)
    return dealt.groupBy("run").applyInArrow(_compare, _SHARED)


def template_places(shared: DataFrame) -> DataFrame:
    """(host, places): the undecided places of each host that are template, by vote."""
    lines = shared.select(
        "host", F.expr("bigint(partners > 0)").alias("seen"), F.explode(F.arrays_zip("places", "kinds", "shared")).alias("line")
    )
    lines = lines.where(F.col("line.kinds").isin(INNER, OPEN))
    votes = lines.groupBy("host", F.col("line.places").alias("place")).agg(
        F.sum("seen").alias("n"), F.sum((F.col("line.shared") > 0).cast("bigint")).alias("yes")
    )
    everywhere = votes.groupBy("place").agg(F.sum("n").alias("all_n"), F.sum("yes").alias("all_yes"))
    voted = votes.join(everywhere, "place")
    ours = F.col("n") >= _EVIDENCE
    known = F.col("all_n") > 0
    template = F.when(ours, 2 * F.col("yes") >= F.col("n")).otherwise(known & (2 * F.col("all_yes") >= F.col("all_n")))
    return voted.where(template).groupBy("host").agg(F.collect_set("place").alias("template"))


_TEXTS = (
    "page_id bigint, url string, host string, ident string, "
    "texts array<string>, places array<bigint>, kinds array<int>, ats array<int>"
)


def _texts(batches: Iterator[dict]) -> Iterator[dict]:
    """Each page with its blocks, but for those that markup names for certain."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("host", "texts", "places", "kinds", "ats")}
        for url, page in zip(batch["url"].to_pylist(), batch["html"], strict=True):
            kept = [(*b, i) for i, b in enumerate(blocks_of(page.as_py())) if b[2] != OUT]
            out["host"].append(address(url)[0])
            out["texts"].append([b[0] for b in kept])
            out["places"].append([_hash(b[1]) for b in kept])
            out["kinds"].append([b[2] for b in kept])
            out["ats"].append([b[3] for b in kept])
        yield out | {n: batch[n] for n in ("page_id", "url", "ident")}


def _few(df: DataFrame, size) -> DataFrame:
    """``df`` marked for a broadcast if it is measured to be small; else Spark joins by shuffles."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if total <= _BROADCAST_BYTES else df


def main_texts(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """The main text of each row, blocks joined by an empty line: key, url, text, n_chars.

    Null sources are empty pages, and pages without text give an empty text; rows with null
    URLs share one host; repeated rows are compared once and returned each; no row is dropped.
    An empty table gives no rows. Other columns are not read.
    """
    rows = pages.select(
        F.col(key).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("ident", F.md5(F.encode(F.concat_ws("\x00", F.coalesce("url", F.lit("")), "html"), "UTF-8")))
    shared = stored(shared_lines(rows), "shared")
    places = template_places(shared)
    # A page without a marked article: its blocks that at least a quarter of its neighbours have.
    single = shared.where((F.col("partners") > 0) & F.array_contains("kinds", OPEN)).select(
        "ident",
        F.expr(f"transform(arrays_zip(kinds, shared), b -> b.kinds = {OPEN} AND b.shared > 0 AND 4 * b.shared >= partners)").alias("gone"),
    )
    texts = map_batches(rows, _texts, _TEXTS)
    texts = texts.join(_few(places, 8 * F.size("template") + F.length("host") + 16), "host", "left")
    texts = texts.join(_few(single, F.size("gone") + 64), "ident", "left")
    kept = F.expr(
        "filter(arrays_zip(texts, places, kinds, ats), b -> "
        f"b.kinds = {MAIN} OR NOT (coalesce(array_contains(template, b.places), false) OR coalesce(gone[b.ats], false)))"
    )
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), "\n\n")
    return texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
