"""Main text of pages by wrappers that are inferred from the pages of a host.

A page becomes a balanced stream of tags (with the words of their class, id and
role) and text slots. A host's wrapper is a union-free regular expression over
such streams: inside each element, what repeats side by side is a repeated group,
and pages are aligned one after the other, so that what only one side has becomes
optional and what one side repeats becomes repeated. Each page is then matched
against its host's expression, and every text falls into a slot of it. Slots
carry over all pages how much text and linked text they hold and which texts
stand fixed there. They are labelled for the host as a whole: slots below
navigation, adverts, forms and the like are out; of the rest, the article's are
in, or else those of the container that holds most unlinked, changing text. The
main text of a page is what it has in these slots, without the texts that FIXED
of the pages with the slot repeat; below FIXED_PAGES pages of a slot nothing is
told apart so, and a page all of whose texts are fixed keeps them. Texts that
fall into no slot are judged by the page's own expression.

Wrappers are folded within tasks first and meet in two steps, so that a host with
many pages costs few rows; the joins that bring them to the pages split large
hosts. A wrapper grows with the different structures of a host, not its pages,
and matching takes time in proportion to a page.

Defined cases: null and empty html give the empty text; an unclosed tag at the
end is dropped; elements nested deeper than DEEP count as part of the one there,
but for what marks them as out; a null url has the empty host; rows that repeat a
page repeat its text; of equal containers the last by name is taken; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, discard, join_uneven, table

# Kinds of elements and the words in class, id and role that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul"
    " caption option optgroup select".split()
)
OUT_TAGS = frozenset("head nav aside footer form script style noscript template select button iframe svg dialog menu search input object canvas audio video map fieldset".split()) | RAW
OUT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer masthead banner cookie cookies consent gdpr notice notices alert popup"
    " modal overlay ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion share sharing social related recommended"
    " recommendations more comment comments reply replies respond discussion disqus newsletter subscribe subscription signup login signin search pagination"
    " pager widget widgets toolbar skip complementary contentinfo legal copyright disclaimer dialog form tags hidden".split()
)
HEADER_WORDS = frozenset("header topbar site-header".split())
MAIN_WORDS = ("main", "article", "content", "post", "entry", "story", "body", "text")

#: A slot's text is fixed if this share of the pages that have the slot repeat it; fewer pages than FIXED_PAGES do not tell.
FIXED, FIXED_PAGES = 0.75, 16
#: Of so many pages a slot with a fixed text counts little for its container.
FEW_PAGES = 4
#: Levels of elements that are told apart, longest body that folds, and the size of two lists up to which they are aligned by longest runs.
DEEP, BODY, CAREFUL = 150, 8, 10_000
#: Hosts, and structures of a host, that a task holds before it passes their expressions on; parts in which a host's expressions meet first.
HOSTS, STRUCTURES, PARTS = 200, 5_000, 256
ENDS = ("li", "dt", "dd", "tr", "option")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*\Z", re.S)
MARKS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDE = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): open, close and text tokens; text in elements that hold no markup is skipped."""
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            yield "text", "", html[at:]
            return
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            yield "close", name, ""


def element(name: str, attributes: str) -> str:
    """The tag and the words of its class, id and role, without numbers."""
    words: list[str] = []
    if "=" in attributes:
        for m in MARKS.finditer(attributes):
            words += [w.lower() for w in WORDS.findall(m[2] or m[3] or m[4] or "")]
    if attributes and HIDE.search(attributes):
        words.append("hidden")
    return ".".join([name, *dict.fromkeys(words)])


class Page:
    """pieces: (path, text, linked, block) of each text; stream: the tags and text slots, balanced; slot_at: where in the stream each block has its text."""

    def __init__(self, html: str):
        # Of each open element its name, its path and whether it is in the stream: elements below DEEP levels are part of the one there.
        names: list[str] = []
        paths: list[str] = [""]
        shown: list[bool] = []
        is_open: Counter[str] = Counter()
        self.pieces: list[tuple[str, str, bool, int]] = []
        self.slot_at: dict[int, int] = {}
        block, links, stream, levels = 0, 0, [], 0

        def push(name: str, key: str) -> None:
            nonlocal levels
            show = levels < DEEP or levels < 2 * DEEP and outside(key)
            names.append(name)
            is_open[name] += 1
            shown.append(show)
            paths.append(f"{paths[-1]} {key}" if show and paths[-1] else key if show else paths[-1])
            if show:
                levels += 1
                stream.append(f"<{key}")

        def pop(down_to: int) -> None:
            nonlocal block, levels
            while len(names) > down_to:
                is_open[names.pop()] -= 1
                paths.pop()
                if shown.pop():
                    levels -= 1
                    stream.append(">")
                block += 1

        def last(name: str) -> int:
            return next(i for i in range(len(names) - 1, -1, -1) if names[i] == name)

        for kind, name, rest in scan(html):
            if kind == "text":
                if names and names[-1] in RAW:
                    continue
                text = entities.unescape(rest)
                self.pieces.append((paths[-1], text, links > 0, block))
                if text.strip():
                    if not stream or stream[-1] != "#":
                        stream.append("#")
                    self.slot_at.setdefault(block, len(stream) - 1)
            elif name == "a":
                links = 1 if kind == "open" else 0
            elif name not in BLOCKS and name not in OUT_TAGS:
                if kind == "open" and name in ("br", "td", "th"):
                    self.pieces.append((paths[-1], " ", links > 0, block))
                elif kind == "open" and name == "span" and (e := element(name, rest)) != "span" and outside(e):
                    push("span", e)  # an inline advert
                elif kind == "close" and name == "span" and names and names[-1] == "span":
                    pop(len(names) - 1)
            elif kind == "open":
                block += 1
                if name in BLOCKS and "p" in names[-3:]:
                    pop(last("p"))
                elif name in ENDS and names and names[-1] in ENDS:
                    pop(len(names) - 1)
                if name == "body":
                    pop(names.index("head") if is_open["head"] else len(names))
                if name not in VOID and not rest.endswith("/"):
                    push(name, element(name, rest))
            else:
                if is_open[name]:
                    pop(last(name))
                links = 0 if name in BLOCKS else links
        self.stream = tuple(stream)

    def texts(self) -> dict[tuple[int, str], str]:
        """The text of each block and path, white space folded."""
        parts: dict[tuple[int, str], list[str]] = {}
        for path, text, _, block in self.pieces:
            parts.setdefault((block, path), []).append(text)
        return {k: t for k, ts in parts.items() if (t := SPACE.sub(" ", "".join(ts)).strip())}


# An item of an expression is (key, optional, repeated, items inside): # is a text slot, <key an element, ( a group.


def tree(stream: tuple) -> tuple:
    """A stream's items, with what stands side by side folded."""
    open_: list[tuple[str, list]] = [("", [])]
    for token in stream:
        if token == ">":
            key, inside = open_.pop()
            open_[-1][1].append((key, False, False, folded(inside)))
        elif token == "#":
            open_[-1][1].append(("#", False, False, ()))
        else:
            open_.append((token, []))
    while len(open_) > 1:
        key, inside = open_.pop()
        open_[-1][1].append((key, False, False, folded(inside)))
    return folded(open_[0][1])


def folded(items: list) -> tuple:
    """Side-by-side repeats as one repeated item, short bodies first, until nothing repeats."""
    while True:
        n = len(items)
        for size in range(1, BODY + 1):
            out, i, keys = [], 0, [x[0] for x in items]
            while i < len(items):
                end = i + size
                while size <= len(keys) - end and keys[end : end + size] == keys[i : i + size]:
                    end += size
                if end == i + size:
                    out.append(items[i])
                    i += 1
                    continue
                body = tuple(items[i : i + size])
                for at in range(i + size, end, size):
                    body = tuple(map(merged, body, items[at : at + size]))
                out.append((*body[0][:2], True, body[0][3]) if size == 1 else ("(" + " ".join(x[0] for x in body), False, True, body))
                i = end
            items = out
        if len(items) == n:
            return tuple(items)


def merged(a: tuple, b: tuple) -> tuple:
    return a if a == b else (a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3]))


def meeting(a: list, b: list) -> Iterator[tuple[int, int]]:
    """Places of equal keys, in order on both sides: of the longest runs first or, in long lists, each at the next place."""
    if len(a) * len(b) <= CAREFUL:
        for i, j, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            yield from zip(range(i, i + n), range(j, j + n), strict=True)
        return
    places: dict[str, list[int]] = {}
    for j, key in enumerate(b):
        places.setdefault(key, []).append(j)
    at = 0
    for i, key in enumerate(a):
        of = places.get(key, ())
        if (k := bisect_left(of, at)) < len(of):
            yield i, of[k]
            at = of[k] + 1


def gathered(items: tuple, other: tuple) -> tuple:
    """The items, with what the other side repeats as a group of several made such groups here too."""
    for body in {tuple(y[0] for y in x[3]) for x in other if x[0][0] == "("}:
        out, i, keys, size = [], 0, tuple(x[0] for x in items), len(body)
        while i < len(items):
            if keys[i : i + size] != body:
                out.append(items[i])
                i += 1
                continue
            group = ("(" + " ".join(body), False, False, tuple(items[i : i + size]))
            if out and out[-1][0] == group[0]:
                group = (group[0], False, True, tuple(map(merged, out.pop()[3], group[3])))
            out.append(group)
            i += size
        items = tuple(out)
    return items


def aligned(a: tuple, b: tuple) -> tuple:
    """One expression for both sides: what either lacks is optional, what either repeats is repeated."""
    if a == b:
        return a
    a, b = gathered(a, b), gathered(b, a)
    out, i, j = [], 0, 0
    for x, y in [*meeting([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [(v[0], True, *v[2:]) for v in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return tuple(out)


def expression(items) -> str:
    """The wrapper as a regular expression: (...)? optional, (...)+ repeated, (...)* both, # a text slot."""
    out = []
    for key, optional, repeated, inside in items:
        text = "#" if key == "#" else expression(inside) if key[0] == "(" else f"{key}>{expression(inside)}</{key[1:].split('.')[0]}>"
        out.append(f"({text})" + ("*" if optional and repeated else "?" if optional else "+") if optional or repeated else text)
    return "".join(out)


class Level:
    """The items inside one element, to match what stands there: places of each key, and the bounds of the group of each place."""

    def __init__(self, items):
        self.places: dict[str, list[int]] = {}
        self.items, self.group = [], []
        self.inside: dict[int, Level] = {}
        for x in items:
            lo = len(self.items)
            held = x[3] if x[0][0] == "(" else [x]
            for y in held:
                self.places.setdefault(y[0], []).append(len(self.items))
                self.items.append(y)
            self.group.extend([(lo, len(self.items)) if len(held) > 1 else None] * len(held))

    def after(self, key: str, at: int) -> int:
        """Where a key stands next, from here on: first in the group that we are in, which may begin anew; -1 if nowhere."""
        of = self.places.get(key)
        if not of:
            return -1
        group = self.group[at] if 0 <= at < len(self.items) else None
        if group and (k := bisect_left(of, at + (self.items[at][0] != key))) < len(of) and of[k] < group[1]:
            return of[k]
        if group and (k := bisect_left(of, group[0])) < len(of) and of[k] < group[1]:
            return of[k]
        k = bisect_left(of, at + (0 <= at < len(self.items) and not self.items[at][2]))
        return of[min(k, len(of) - 1)]

    def below(self, at: int) -> Level:
        if at not in self.inside:
            self.inside[at] = Level(self.items[at][3])
        return self.inside[at]


class Matcher:
    """A host's expression, to match pages against; what each structure gives is kept."""

    def __init__(self, items: str | None):
        self.top = Level(json.loads(items or "null") or ())
        self.held: dict[tuple, list] = {}

    def matched(self, stream: tuple) -> list[str | None]:
        """Of each token of a stream the place in the expression that it matches."""
        out: list[str | None] = []
        open_: list[list] = [[self.top, -1, ""]]
        for token in stream:
            if token == ">":
                open_.pop()
                out.append(None)
                continue
            level, at, place = open_[-1]
            at = level.after(token, at) if level else -1
            out.append(f"{place}.{at}" if at >= 0 else None)
            if at >= 0:
                open_[-1][1] = at
            if token != "#":
                open_.append([level.below(at), -1, out[-1]] if at >= 0 else [None, -1, ""])
        return out

    def slots(self, page: Page) -> dict[tuple[int, str], str]:
        """The slot (place in the expression, path) of each block and path of the page; texts that no slot matches are missing."""
        if page.stream not in self.held:
            if len(self.held) > 1_000:
                self.held.clear()
            self.held[page.stream] = self.matched(page.stream)
        to = self.held[page.stream]
        found = {(block, path): to[at] for path, _, _, block in page.pieces if (at := page.slot_at.get(block)) is not None}
        return {k: f"{place} {k[1]}" for k, place in found.items() if place is not None}


def outside(key: str) -> bool:
    name, *words = key.split(".")
    return name in OUT_TAGS or any(w in OUT_WORDS for w in words)


def region(path: str) -> tuple[str, str] | None:
    """What a slot belongs to: (rank and container), or null for what is never main text."""
    keys, best = path.split(), None
    inside = False
    for i, key in enumerate(keys):
        name, *words = key.split(".")
        inside = inside or name in ("article", "main")
        if outside(key) and name not in ("html", "body", "article", "main") or not inside and (name == "header" or HEADER_WORDS & set(words)):
            return None
        rank = "0" if name == "article" else "1" if name == "main" or "main" in words else "2" if set(words) & set(MAIN_WORDS) and name not in ("html", "body") else None
        if rank and (best is None or rank < best[0]):
            best = rank, " ".join(keys[: i + 1])
    # Without a marked container, the one around the block.
    return best or ("3", " ".join(k for k in keys if k.split(".")[0] in ("html", "body", "div", "section", "td", "table")))


def main_slots(slots: list[tuple[str, int, int, bool]]) -> set[str]:
    """Of (slot, characters, linked characters, whether its text stands fixed) the slots that hold main text."""
    of = {x[0]: r for x in slots if (r := region(x[0].partition(" ")[2]))}
    if not of:
        return set()
    best = min(r[0] for r in of.values())
    # A container that only links, or whose slots say the same on all pages, is none.
    weight: dict[str, float] = {}
    for slot, n, linked, fixed in slots:
        if slot in of:
            weight[of[slot][1]] = weight.get(of[slot][1], 0) + (n - linked) * (0.01 if fixed else 1)
    if best in "01":
        return {x for x, r in of.items() if r[0] == best}
    named = {r[1] for r in of.values() if r[0] == best}
    top = max(named, key=lambda c: (weight[c], c))
    return {x for x, r in of.items() if r[1] == top or r[1].startswith(top + " ")}


def measured(page: Page, slots: dict[tuple[int, str], str]) -> dict[str, list[int]]:
    """Of each slot of a page its characters and linked characters."""
    own: dict[str, list[int]] = {}
    for path, text, linked, block in page.pieces:
        if (slot := slots.get((block, path))) and (text := text.strip()):
            held = own.setdefault(slot, [0, 0])
            held[0] += len(text)
            held[1] += len(text) * linked
    return own


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def main_text(html: str | None, matcher: Matcher | None = None, main: set[str] = frozenset(), fixed: set[tuple[str, int]] = frozenset()) -> str:
    """A page's main text: the texts in the main slots of its host's expression that are not fixed there."""
    if not html:
        return ""
    page = Page(html)
    texts, slots = page.texts(), matcher.slots(page) if matcher else {}
    wanted = {k for k in texts if slots.get(k) in main}
    if not wanted or any(k not in slots for k in texts):  # no main slot, or texts without a slot: the page is judged by itself
        alone = Matcher(json.dumps(tree(page.stream)))
        own = alone.slots(page)
        ours = main_slots([(s, *n, False) for s, n in measured(page, own).items()])
        wanted |= {k for k in texts if own.get(k) in ours and (not wanted or k not in slots)}
    left = {k for k in wanted if (slots.get(k), digest(texts[k])) not in fixed} if fixed else wanted
    lines: dict[int, list[str]] = {}
    for path, text, _, block in page.pieces:
        if (block, path) in (left or wanted):
            lines.setdefault(block, []).append(text)
    folded_lines = (SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(lines.items()))
    return "\n".join(x for x in folded_lines if x)


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, items (the expression, as JSON) and pages (their number) from page_id, url, html, host."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list] = {}  # items, structures seen, pages

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(h[0]) for h in held.values()], pa.string()), pa.array([h[2] for h in held.values()], pa.int64())], names=["host", "items", "pages"])
            held.clear()
            return out

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if html.is_valid:
                    own = held.setdefault(host, [(), set(), 0])
                    own[2] += 1
                    stream = Page(html.as_py()).stream
                    if (mark := hash(stream)) not in own[1]:
                        own[0] = aligned(own[0], tree(stream)) if own[1] else tree(stream)
                        own[1].add(mark)
                    if len(held) > HOSTS or len(own[1]) > STRUCTURES:
                        yield flush()
        yield flush()

    def merge(key, rows):
        import pyarrow as pa

        items = None
        for part in sorted(rows.column("items").to_pylist()):
            new = frozen(json.loads(part))
            items = new if items is None else aligned(items, new)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "items": [json.dumps(items)], "pages": pa.array([sum(rows.column("pages").to_pylist())], pa.int64())})

    made = "host string, items string, pages bigint"
    parts = pages.select("host", "html").mapInArrow(fold, made).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    # The parts of a host with many meet in two steps.
    return parts.groupBy("host", "_part").applyInArrow(lambda key, rows: merge(key[:1], rows), made).groupBy("host").applyInArrow(merge, made)


def frozen(items) -> tuple:
    return tuple((k, o, r, frozen(inside)) for k, o, r, inside in items)


def slot_rows(pages: DataFrame, made: DataFrame, total: int) -> DataFrame:
    """host, slot, text, n, size, linked: of each slot that may be main, its pages and characters (text null), and of each text in it its digest and pages."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matchers: dict[str, Matcher] = {}
        for b in batches:
            rows = []
            for host, html, items in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if html:
                    if host not in matchers and len(matchers) > HOSTS:
                        matchers.clear()
                    page = Page(html)
                    slots = matchers.setdefault(host, Matcher(items)).slots(page)
                    may = {s: r for s, r in measured(page, slots).items() if region(s.partition(" ")[2])}
                    rows += [(host, s, None, *r) for s, r in may.items()]
                    rows += {(host, slots[k], digest(t), 0, 0) for k, t in page.texts().items() if slots.get(k) in may}
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "slot", "text", "size", "linked"])

    seen = join_uneven(pages, made, ["host"], "pages", total).select("host", "html", "items").mapInArrow(run, "host string, slot string, text bigint, size bigint, linked bigint")
    return seen.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))


def decided(rows: DataFrame) -> DataFrame:
    """host, main (slots of main text) and fixed (slot and digest of each text that FIXED of the pages with the slot repeat), from slot_rows()."""
    rows = cut(rows.where(F.col("text").isNull() | (F.col("n") >= FIXED * FEW_PAGES)), "slot-texts")
    slots = rows.where("text is null").select("host", "slot", F.col("n").alias("of"), "size", "linked")
    same = rows.where("text is not null").select("host", "slot", "text", "n").join(slots.where(F.col("of") >= FEW_PAGES).select("host", "slot", "of"), ["host", "slot"])
    same = same.where(F.col("n") >= FIXED * F.col("of")).groupBy("host", "slot").agg(F.collect_list("text").alias("texts"))

    def decide(key, rows):
        import pyarrow as pa

        got = sorted(rows.select(["slot", "size", "linked", "of", "texts"]).to_pylist(), key=lambda r: r["slot"])
        main = main_slots([(r["slot"], r["size"], r["linked"], bool(r["texts"])) for r in got])
        fixed = [{"slot": r["slot"], "text": t} for r in got if r["slot"] in main and r["of"] >= FIXED_PAGES for t in sorted(r["texts"] or ())]
        kind = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.int64())]))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "main": pa.array([sorted(main)], pa.list_(pa.string())), "fixed": pa.array([fixed], kind)})

    # A row a slot of the host's expression.
    return slots.join(same, ["host", "slot"], "left").groupBy("host").applyInArrow(decide, "host string, main array<string>, fixed array<struct<slot:string,text:bigint>>")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    rows = with_host(pages, id_col, url_col, html_col)
    kind = rows.schema["page_id"].dataType.simpleString()
    # As tables of known size: broadcast if that is small, else joined in a way that splits a large host.
    parts = cut(wrappers(rows), "wrappers")
    total = parts.agg(F.sum("pages")).first()[0] or 0
    made = cut(parts.join(decided(slot_rows(rows, parts, total)), "host", "left"), "wrappers")
    discard(parts)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for html, host, items, main, fixed in zip(*[b.column(i) for i in range(2, 7)], strict=True):
                if (h := host.as_py()) not in held:
                    if len(held) > HOSTS:
                        held.clear()
                    held[h] = Matcher(items.as_py()), set(main.as_py() or ()), {(f["slot"], f["text"]) for f in fixed.as_py() or ()}
                texts.append(main_text(html.as_py(), *held[h]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # Pages without html may be of hosts without an expression.
    joined = join_uneven(rows, made, ["host"], "pages", total, "left").select("page_id", "url", "html", "host", "items", "main", "fixed")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
