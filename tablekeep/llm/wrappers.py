"""HTML extraction by union-free regular-expression inference.

Each page is a stream of tags and text slots. Adjacent repetitions of any length become repeated groups, which leaves
few different streams per host; they are counted in the shuffle and aligned one after the other: equal parts stay,
what only one side has becomes an optional group, and repetitions that appear by alignment are folded again. Two
streams are aligned on what stands in each of them once, in the same order, and between such places on the rest, so
the work grows little faster than the pages. The streams of a host are aligned in a tree of groups of FAN. The
resulting wrapper, a regular expression without unions, names the element that holds the main text of the host's
pages. Extraction then reads every page once and takes the text blocks of that element, without menus and the like.
"""

import difflib
import html
import json
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import ship_package, staged, text_columns

#: Streams of a host that one task aligns; their wrappers are aligned again, until a host has one.
FAN = 32
#: Groups of up to so many tokens are tried everywhere; longer repetitions are found by the next places of a token.
SHORT_GROUP = 12
NEXT_PLACES = 8
#: Parts of two streams without a common unique token are compared node by node up to this product of their lengths.
SMALL = 250_000

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>|/?[A-Za-z](?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>)",
    re.DOTALL,
)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr",
}
#: Elements that never belong to the main text, and words of an id or class that mark such an element.
NOISE = RAW | {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "input", "dialog", "menu", "object",
    "fieldset", "video", "audio", "canvas", "map",
}
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "reader",
    "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}
MAIN_WORDS = {"article", "content", "entry", "main", "post", "story", "text", "body"}
_WORDS = re.compile(r"[a-z]+")


# --- tokens ------------------------------------------------------------------------------------


def tokens(page: str):
    """(kind, name, signature, text) of tags and texts; kind is open, close, void or text.

    Scripts and the like, comments and declarations are left out. A signature is the tag with its id, class and role.
    """
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", "", "", page[at : m.start()]
        at = m.end()
        tag = m[0]
        found = _NAME.match(tag)
        if found is None:
            if tag.startswith("<![CDATA["):
                yield "text", "", "", html.escape(tag[9:].removesuffix("]]>"))
            continue
        name = found[1].lower()
        if tag[1] == "/":
            yield "close", name, "", ""
            continue
        marks = sorted((a.lower(), b or c or d) for a, b, c, d in _ATTRIBUTE.findall(tag, found.end()))
        signature = " ".join([name, *[f"{a}={' '.join(b.split())}" for a, b in marks]])
        if name in RAW and not tag.endswith("/>"):
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif name in VOID or tag.endswith("/>"):
            yield "void", name, signature, ""
        else:
            yield "open", name, signature, ""
    if at < len(page):
        yield "text", "", "", page[at:]


def is_noise(name: str, signature: str) -> bool:
    if name in NOISE:
        return True
    marks = signature[len(name) :]
    return bool(marks) and name not in ("body", "html", "article", "main") and not NOISE_WORDS.isdisjoint(
        _WORDS.findall(re.sub(r"\b(?:id|class|role)=", " ", marks).lower())
    )


# --- wrappers ----------------------------------------------------------------------------------
# A wrapper is a list of tokens (texts) and groups: ["+", [...]] repeated, ["?", [...]] optional.


def _key(node) -> str:
    """Nodes with equal keys are aligned: equal tokens, and repeated groups that begin alike."""
    repeated = ""
    while isinstance(node, list):
        repeated = repeated or node[0].strip("?")
        node = node[1][0]
    return repeated + node


def _regroup(nodes: list, other: list) -> list:
    """Single occurrences of what the other wrapper repeats, as groups."""
    bodies = sorted((n[1] for n in other if isinstance(n, list) and n[0] == "+"), key=len, reverse=True)
    changed = False
    for body in bodies:
        first, size = body[0], len(body)
        if first not in nodes:
            continue
        out, i = [], 0
        while i < len(nodes):
            if nodes[i] == first and nodes[i : i + size] == body:
                out.append(["+", body])
                i += size
                changed = True
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return fold(nodes) if changed else nodes


def fold(nodes: list) -> list:
    """Adjacent repetitions as repeated groups, the shortest groups first."""
    for size in range(1, SHORT_GROUP + 1):
        out, i = [], 0
        while i < len(nodes):
            group = nodes[i : i + size]
            j = i + size
            if size == 1 and isinstance(group[0], list) and group[0][0] == "+":
                # what a repeated group already says
                body = group[0][1]
                while nodes[j : j + len(body)] == body or nodes[j : j + 1] == group:
                    j += 1 if nodes[j : j + 1] == group else len(body)
                out.append(group[0])
                i = j
                continue
            while len(group) == size and nodes[j : j + size] == group:
                j += size
            if j > i + size and group != ["#"]:
                out.append(["+", group])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return _fold_long(nodes)


def _fold_long(nodes: list) -> list:
    """Repetitions longer than SHORT_GROUP: a group starts again where its first token stands next.

    Nodes are numbers and stretches are compared by the hash of their numbers, so a place costs NEXT_PLACES looks.
    """
    if len(nodes) <= 2 * SHORT_GROUP:
        return nodes
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(n if isinstance(n, str) else json.dumps(n), len(numbers) + 1) for n in nodes]
    places: dict[int, list[int]] = {}
    for i, number in enumerate(ids):
        places.setdefault(number, []).append(i)
    prime, base = (1 << 61) - 1, 1_000_003
    hashes, powers = [0], [1]
    for number in ids:
        hashes.append((hashes[-1] * base + number) % prime)
        powers.append(powers[-1] * base % prime)

    def same(i: int, j: int, size: int) -> bool:
        if j + size > len(ids):
            return False
        one = (hashes[i + size] - hashes[i] * powers[size]) % prime
        return one == (hashes[j + size] - hashes[j] * powers[size]) % prime and nodes[i : i + size] == nodes[j : j + size]

    out, i = [], 0
    while i < len(nodes):
        own = places[ids[i]]
        at = bisect_left(own, i)
        for j in own[at + 1 : at + 1 + NEXT_PLACES]:
            size = j - i
            if size > SHORT_GROUP and same(i, j, size):
                while same(i, j, size):
                    j += size
                out.append(["+", nodes[i : i + size]])
                i = j
                break
        else:
            out.append(nodes[i])
            i += 1
    return out if len(out) < len(nodes) else nodes


def stream(page: str) -> list:
    """Tags and text slots of a page, folded."""
    out: list = []
    for kind, name, signature, text in tokens(page):
        if kind == "text":
            if text.strip() and out[-1:] != ["#"]:
                out.append("#")
        else:
            out.append({"open": f"<{signature}>", "close": f"</{name}>", "void": f"<{signature}/>"}[kind])
    return fold(out)


def align(a: list, b: list) -> list:
    """The wrapper that both wrappers match."""
    if a == b:
        return a
    out: list = []

    def optional(nodes: list) -> None:
        for node in nodes:
            if isinstance(node, list) and node[0] == "?":
                out.append(node)
            elif out and isinstance(out[-1], list) and out[-1][0] == "?" and out[-1] in fresh:
                out[-1][1].append(node)
            else:
                out.append(["?", [node]])
                fresh.append(out[-1])

    a, b = _regroup(a, b), _regroup(b, a)
    fresh: list = []
    i = k = 0
    for j, m in [*matches([_key(n) for n in a], [_key(n) for n in b]), (len(a), len(b))]:
        fresh = []
        optional(a[i:j])
        fresh = []
        optional(b[k:m])
        if j < len(a) and m < len(b):
            out.append(_same(a[j], b[m]))
        i, k = j + 1, m + 1
    return fold(out)


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal keys that go up in both rows.

    Equal ends are matched first, then the longest rising row of keys that stand once on both sides, and so on
    between these. A part that has none is compared node by node if it is small; of larger parts only the keys that
    are as frequent on both sides are matched, each with the one of its turn.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        mine, theirs = Counter(a[i:j]), Counter(b[k:m])
        if (j - i) * (m - k) <= SMALL:
            blocks = difflib.SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks()
            out += [(i + x + d, k + y + d) for x, y, n in blocks for d in range(n)]
            continue
        once = {key for key, n in mine.items() if n == 1 and theirs[key] == 1}
        turns = once or {key for key, n in mine.items() if theirs[key] == n}
        place: dict[tuple[str, int], int] = {}
        seen: Counter = Counter()
        for y in range(k, m):
            if b[y] in turns:
                place[b[y], seen[b[y]]] = y
                seen[b[y]] += 1
        seen.clear()
        pairs = []
        for x in range(i, j):
            if a[x] in turns:
                pairs.append((x, place[a[x], seen[a[x]]]))
                seen[a[x]] += 1
        chain = _rising(pairs)
        if not chain:
            continue
        out += chain
        if once:
            ends = [(i - 1, k - 1), *chain, (j, m)]
            work += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest row of pairs that goes up on both sides; ``pairs`` goes up on the first."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int | None] = []
    for number, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(last[at - 1] if at else None)
        tops[at : at + 1] = [y]
        last[at : at + 1] = [number]
    out, at = [], last[-1] if last else None
    while at is not None:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def _same(x, y):
    if x == y:
        return x
    marks = {n[0] for n in (x, y) if isinstance(n, list)}
    bodies = [n[1] if isinstance(n, list) else [n] for n in (x, y)]
    body = align(*bodies)
    if "?" in marks and "+" in marks:
        return ["?", [["+", body]]]
    return [marks.pop(), body] if marks else body[0]


def infer(wrappers: list[list]) -> list:
    """Align streams or wrappers one after the other, the longest first."""
    ordered = sorted(wrappers, key=lambda w: (-len(json.dumps(w)), json.dumps(w)))
    out = ordered[0]
    for other in ordered[1:]:
        out = align(out, other)
    return out


def main_element(wrapper: list) -> str:
    """Signature of the element that holds the main text: an article or main element, else the one with content
    words in its marks, else the one with most text slots of its own paragraphs; empty if there is none."""
    best: dict[str, list[float]] = {}
    stack: list[tuple[str, str]] = []

    def walk(nodes: list, weight: float) -> None:
        for node in nodes:
            if isinstance(node, list):
                walk(node[1], weight * (3 if node[0] == "+" else 1))
            elif node == "#":
                if any(is_noise(n, s) for n, s in stack):
                    continue
                links = any(n == "a" for n, _ in stack)
                for depth, (name, signature) in enumerate(reversed(stack)):
                    if name not in INLINE:
                        best.setdefault(signature, [0.0, 0.0])[0] += 0 if links else weight / (1 + 0.1 * depth)
            elif node.startswith("</"):
                name = node[2:-1]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif not node.endswith("/>"):
                signature = node[1:-1]
                stack.append((signature.split(" ", 1)[0], signature))

    walk(wrapper, 1.0)

    def rank(item: tuple[str, list[float]]) -> tuple:
        signature, (weight, _) = item
        name = signature.split(" ", 1)[0]
        marks = set(_WORDS.findall(signature[len(name) :].lower()))
        level = 3 if name == "article" else 2 if name == "main" or "role=main" in signature else 1 if marks & MAIN_WORDS else 0
        return level, name not in ("p", "li", "h1", "h2", "h3", "h4", "td", "tr", "ul", "ol"), weight, signature

    holders = [x for x in best.items() if x[1][0] > 0]
    return max(holders, key=rank)[0] if holders else ""


# --- extraction --------------------------------------------------------------------------------


def main_text(page: str, element: str) -> str:
    """Text blocks of every element with that signature, or of the body if the page has none."""
    blocks = _blocks(page, element)
    if blocks is None:
        blocks = _blocks(page, "") or []
    return "\n".join(blocks)


def _blocks(page: str, element: str) -> list[str] | None:
    """None if the element never opens; an empty name stands for the whole page."""
    blocks: list[str] = []
    parts: list[str] = []
    stack: list[str] = []
    inside = 0 if not element else None  # depth of the stack at which the element stands
    noise: int | None = None
    seen = not element

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for kind, name, signature, text in tokens(page):
        if kind == "text":
            if inside is not None and noise is None:
                parts.append(text)
            continue
        if name not in INLINE and noise is None:
            flush()
        if kind == "void":
            continue
        if kind == "open":
            if name not in INLINE:
                _close_implied(stack, name)
            if inside is not None and noise is None and is_noise(name, signature):
                noise = len(stack)
            stack.append(name)
            if inside is None and signature == element:
                inside, seen = len(stack), True
        elif name in stack:
            while stack.pop() != name:
                pass
        if noise is not None and len(stack) <= noise:
            noise = None
        if element and inside is not None and len(stack) < inside:
            inside, noise = None, None
            flush()
    flush()
    return blocks if seen else None


def _close_implied(stack: list[str], name: str) -> None:
    """A new block ends an open paragraph, a new item its open sibling."""
    closes = {"p"} | ({name} if name in ("li", "tr", "td", "th", "dt", "dd", "option") else set())
    for i in range(len(stack) - 1, -1, -1):
        if stack[i] in closes:
            del stack[i:]
            return
        if stack[i] not in INLINE:
            return


# --- Spark -------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    """Host of a URL in lower case; empty for a null or odd URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), element and pages for every host, from all its pages.

    Different streams are counted per task first. Groups of FAN streams of a host are aligned in a task each, then
    their wrappers, until every host has one, so no group holds all of a large site.
    """

    def make():
        return lambda texts: [[json.dumps(stream(t or "")) for t in texts]]

    streams = text_columns(pages.select(host(F.col("url")).alias("host"), "html"), "stream string", make, "html", ("html",))
    schema = "host string, stream string, pages bigint"
    found = staged(streams.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages")), "streams")
    ship_package(pages.sparkSession)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = infer([json.loads(s) for s in group["stream"]])
        return pd.DataFrame(
            {"host": [group["host"].iloc[0]], "stream": [json.dumps(wrapper)], "pages": [int(group["pages"].sum())]}
        )

    def most() -> int:
        return found.groupBy("host").count().agg(F.max("count")).first()[0] or 0

    left = most()
    while left > 1:
        sizes = found.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("stream"), F.col("parts"))
        dealt = found.join(sizes, "host").withColumn("part", F.when(F.lit(left <= FAN), F.lit(0)).otherwise(part))
        found = staged(dealt.groupBy("host", "part").applyInPandas(merge, schema), "wrapped")
        before, left = left, most()
        if left == before:  # one stream a part, by chance
            break

    def finish(batches):
        for batch in batches:
            batch["element"] = [main_element(json.loads(s)) for s in batch["stream"]]
            yield batch[["host", "stream", "element", "pages"]]

    if left > 1:
        found = found.groupBy("host").applyInPandas(merge, schema)
    return found.mapInPandas(finish, "host string, stream string, element string, pages bigint").withColumnRenamed("stream", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html and with ``text``: the blocks of the main text, joined by line feeds.

    A null or empty page has an empty text. Pages without a host share one wrapper, as do hosts that differ in case
    only. Repeated pages are extracted each, an empty table gives no rows. Existing columns named text or host are
    replaced; all others, whatever their names, are passed on.
    """
    elements = staged(infer_wrappers(pages).select("host", "element"), "wrappers")
    kept = [c for c in pages.columns if c.lower() not in ("host", "text", "html")]
    # columns go by numbers inside, so no name of theirs can meet one of these
    numbered = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(kept)]
    page = F.struct(F.col("html"), F.coalesce("element", F.lit("")).alias("element"))
    joined = (
        pages.select(*numbered, "html", host(F.col("url")).alias("host"))
        .join(elements, "host", "left")
        .select(*[f"c{i}" for i in range(len(kept))], page.alias("page"))
    )

    def make():
        return lambda rows: [[main_text(r["html"] or "", r["element"]) for r in rows]]

    found = text_columns(joined, "text string", make, "page", ("page",))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "text")
