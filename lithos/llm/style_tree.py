"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: nodes at the same path of elements (tag,
classes, role) are one node of the host's tree. A node's presentation matters
as far as its sequences of children differ between pages (entropy to the base
of the number of pages), its content as far as the same runs of words do not
come back on other pages. Menus and notices look alike and say the same on many
pages, an article does not. Each leaf's importance joins its parent's
presentation and its own content, and branches of low importance are removed
from every page.

Hosts of few pages have no entropy to speak of, so there the tree of all hosts
together decides. What elements say of themselves comes first: navigation,
footers, forms, scripts and the like, by tag, role or class, are never content.
An id says so only of containers, as on headings, paragraphs and sections it is
an anchor; within an ``article`` or ``main`` names that may be a topic say nothing,
and a branch is removed there only if the tree of all hosts agrees. What stands
beside an article goes only if the page's articles hold the most of its text.

All runs of words of every block count. Counting is by (host, path, run of
words) with sums made before the shuffle, and what is counted is dealt to
``GROUPS`` by its hash alone, many records packed in one row, so a large host is
no bottleneck. A host is known by a hash of 63 bits, a run by one of 50. The
branches that go are sent to the executors if they are at most ``SENT_ROWS``;
else pages meet them by host and salt, with the same result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import U64, mix, shingles, slices, trim

#: Branches below this importance go; hosts of fewer pages use the tree of all hosts.
LEAST, FEW_PAGES = 0.35, 8
#: Share of the parent's presentation in a leaf's importance: 1 - 0.9, the method's weight for one level.
PRESENTATION = 0.1
#: Words of a run; groups that counted features are dealt to; features that a task holds, and nodes with sums, before it sends them on.
RUN, GROUPS, HELD, HELD_SUMS = 4, 1 << 10, 1 << 21, 1 << 18
#: Most rows of (host, path) that are sent to every executor: some 20 MB.
SENT_ROWS, SALTS = 400_000, 32

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no markup, and elements within a line whose content is no text of the page.
_RAW = frozenset("script style iframe textarea title noframes noembed xmp".split())
_MUTE = frozenset("noscript template svg canvas select button datalist map".split())
_NOISE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert "
    "sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs topbar footer foot header masthead copyright legal share sharing social comment comments reply replies respond disqus discussion "
    "related recommended recommendations popular trending widget popup modal overlay newsletter subscribe subscription signup login register search pagination pager toolbar skip toc".split()
)
#: Words that may stand beside those in a name; with any other word a name tells a topic, and the trees decide.
_NEUTRAL_WORDS = frozenset("area bar block body bottom box btn button buttons card center column container content fixed form group header inner item items left link links list main module outer overlay panel right section slot space text title top unit widget wrap wrapper zone".split())
#: Of the first, those that inside an article may as well name its parts or its topic.
_TOPIC_WORDS = frozenset("banner copyright discussion header legal masthead notice notices notification alert popular promotion register related rail reply search side sponsored skip title toc trending".split())
#: Elements that are named by their id as containers; elsewhere an id is an anchor.
_NAMED_BY_ID = frozenset("div aside ul ol table".split())
_HOLDS_TEXT = frozenset(("html", "body", "main", "article"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
_SCOPE = frozenset("ul ol menu dl table select html body article section div".split())

_tag = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_in_tag = re.compile(r"[>\"']")
_attribute = re.compile(r"(?<![a-zA-Z-])(?:([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|hidden(?![a-zA-Z-]))")
_word = re.compile(r"[a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}


class _Tags:
    """A page's markup in order, each found in time that follows what it passes over.

    A tag ends at the first > outside quotes. Where quotes do not close, it ends
    at its first >, and so do all behind it; a tag without one is text.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True
        self.final = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place of the > of a tag that starts before ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        place = at
        while self.quoted:
            m = _in_tag.search(self.page, place)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            elif m.start() >= self.final[m[0]]:
                self.quoted = False
            else:
                place = self.page.index(m[0], m.end()) + 1
        return self.page.index(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(text before, name or /name or nothing, attributes); the last has the text behind all tags."""
        page, size = self.page, len(self.page)
        begin = at = 0
        while True:
            at = page.find("<", at)
            if at < 0:
                break
            m = _tag.match(page, at + 1)
            if m:
                end = self.end(m.end())
                if end < 0:
                    at += 1
                    continue
                yield page[begin:at], m[0].lower(), page[m.end() : end]
                at = begin = end + 1
                if m[0].lower() in _RAW and not page[:end].endswith("/", m.end(), end):
                    close = _ends[m[0].lower()].search(page, begin)
                    end = page.find(">", close.end()) if close else -1
                    at = begin = end + 1 if end >= 0 else size
            elif page.startswith("!--", at + 1):
                end = page.find("-->", at + 4)
                yield page[begin:at], "", ""
                at = begin = end + 3 if end >= 0 else size
            elif page[at + 1 : at + 2] in ("!", "?", "/") and at < self.last:
                end = page.index(">", at)
                yield page[begin:at], "", ""
                at = begin = end + 1
            else:
                at += 1
        yield page[begin:], "", ""


def _noisy_name(value: str, inside: bool = False) -> bool:
    """Whether one of the names says by all its words that this is no content; ``inside`` an article one word must leave no doubt."""
    for name in value.split():
        words = _word.findall(_camel.sub(" ", name).lower())
        if not (_NOISE_WORDS - _TOPIC_WORDS if inside else _NOISE_WORDS).isdisjoint(words) and all(w in _NOISE_WORDS or w in _NEUTRAL_WORDS for w in words):
            return True
    return False


class Block:
    """A run of text in one block-level element."""

    __slots__ = ("path", "parent", "text", "noise", "inside")

    def __init__(self, path: int, parent: int, text: str, noise: bool, inside: bool):
        self.path, self.parent, self.text, self.noise, self.inside = path, parent, text, noise, inside


def parse(page: str) -> tuple[list[Block], dict[int, int]]:
    """A page's blocks in order, and the hash of each element path's sequence of children.

    Never fails: stray markup is passed over. Time follows the page's length.
    """
    blocks: list[Block] = []
    children: dict[int, int] = {}
    # open elements: tag, path, noise, inside an article, mute
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: Counter = Counter()
    muted: Counter = Counter()  # blocks open inside the innermost mute elements
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                i = len(stack) - 1
                while stack[i][4]:
                    i -= 1
                _, path, noise, inside, _ = stack[i]
                blocks.append(Block(path, stack[i - 1][1] if i else 0, joined, noise, inside))

    def cut(i: int) -> None:
        opened.subtract(e[0] for e in stack[i:])
        del stack[i:]

    for before, name, attributes in _Tags(page):
        if before and not stack[-1][4]:
            text.append(before)
        if not name:
            continue
        closing, tag = name[0] == "/", name.lstrip("/")
        if tag in _RAW:
            text.append(" ")
            continue
        if tag in _MUTE:
            if closing and opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                cut(i)
                if not stack[-1][4]:
                    muted.clear()
            elif not closing and not attributes.endswith("/"):
                if not stack[-1][4]:
                    text.append(" ")
                stack.append((tag, stack[-1][1], True, stack[-1][3], True))
                opened[tag] += 1
            continue
        if tag not in _BLOCKS:
            if tag in ("br", "img", "input") and not stack[-1][4]:
                text.append(" ")
            continue
        if stack[-1][4] and (not closing or muted[tag]):
            muted[tag] += -1 if closing else tag != "hr"
            continue
        if closing:
            muted.clear()
            if opened[tag]:
                flush()
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                cut(i)
            else:
                flush()
            continue
        flush()
        if stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in _CLOSES and any(opened[c] for c in _CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _CLOSES[tag]:
                    cut(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        if tag[0] == "h" and stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit():
            cut(len(stack) - 1)
        _, path, noise, inside, _ = stack[-1]
        sign, noisy, holds = tag, tag in _NOISE_TAGS or tag == "header" and not inside, tag in ("article", "main")
        if attributes.strip():
            for a in _attribute.finditer(attributes):
                key, value = (a[1] or "hidden").lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    sign += "." + re.sub(r"[0-9]{3,}", "", value) if key == "class" else ""
                    noisy |= tag not in _HOLDS_TEXT and (key == "class" or tag in _NAMED_BY_ID or tag == "section" and not inside) and _noisy_name(value, inside)
                elif key == "role":
                    sign += "@" + value
                    noisy |= value.lower() in _NOISE_ROLES
                    holds |= value.lower() in ("main", "article")
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
                    noisy = True
        own = crc32(sign.encode("utf-8", "surrogatepass"), path)
        own |= crc32(sign.encode("utf-8", "surrogatepass"), path ^ 0x5BD1E995) << 31  # 63 bits, not signed
        children[path] = crc32(b"%d" % (own & 0xFFFFFFFF), children.get(path, 0))
        if tag != "hr":
            stack.append((tag, own & 0x7FFFFFFFFFFFFFFF, noise or noisy, inside or holds, False))
            opened[tag] += 1
    flush()
    return blocks, children


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def host_key(url: str | None) -> int:
    """A hash of the url's host, of 63 bits."""
    host = host_of(url).encode("utf-8", "surrogatepass")
    return crc32(host) | (crc32(host, 0x5BD1E995) & 0x7FFFFFFF) << 32


#: A node of a host's tree with one kind of feature: what 0 is pages with that leaf, 1 runs of words, 2 sequences of children.
_NODE = np.dtype([("host", np.int64), ("path", np.int64), ("parent", np.int64), ("what", np.int64)])


def _packed(features: np.ndarray, nodes: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """How often each feature occurs at each node, a row for each group of features."""
    place = (features >> U64(40)).astype(np.int64) << 32 | nodes
    order = np.lexsort((features, place))
    features, place = features[order], place[order]
    first = np.flatnonzero(np.r_[True, (features[1:] != features[:-1]) | (place[1:] != place[:-1])])
    n = np.diff(np.r_[first, len(place)]).astype(np.uint32)
    features, place = features[first], place[first]
    low = features.view(np.uint8).reshape(-1, 8)[:, :5]
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # of a node within a group
    sizes = np.diff(np.r_[start, len(place)]).astype(np.uint32)
    group = place[start] >> 32
    edge = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
    rows = []
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        a, b = int(start[i]), int(start[j]) if j < len(start) else len(place)
        own = known[place[start[i:j]] & 0xFFFFFFFF]
        head = b"".join([own[k].tobytes() for k in _NODE.names] + [sizes[i:j].tobytes(), n[a:b].tobytes()])
        rows.append((int(group[i]), j - i, b - a, pa.compress(head, "zstd", asbytes=True), low[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["group", "nodes", "features", "head", "low"])


def _unpacked(nodes: int, features: int, head: bytes, low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row's nodes, how many features each has, the features and their counts."""
    head = pa.decompress(head, (8 * len(_NODE.names) + 4) * nodes + 4 * features, "zstd", asbytes=True)
    known = np.zeros(nodes, _NODE)
    for i, k in enumerate(_NODE.names):
        known[k] = np.frombuffer(head, np.int64, nodes, 8 * nodes * i)
    at = 8 * nodes * len(_NODE.names)
    wide = np.zeros((features, 8), np.uint8)
    wide[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    return known, np.frombuffer(head, np.uint32, nodes, at), wide.view(np.int64).ravel(), np.frombuffer(head, np.uint32, features, at + 4 * nodes)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages hold, packed; a page counts once for each node and feature."""
    known: dict[tuple[int, int, int, int], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        out = _packed(np.concatenate([f for f, _ in held]), np.concatenate([n for _, n in held]), np.array(list(known), _NODE))
        known.clear()
        held.clear()
        return out

    for batch in slices(batches, "html"):
        single: list[tuple[int, int]] = []  # features that are not runs, and their nodes
        texts: list[str] = []
        places: list[int] = []
        for page_no, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            host = host_key(url)
            blocks, children = parse(page or "")
            leaves = set()
            for b in blocks:
                if b.noise:
                    continue  # its elements say already that it is none
                leaves.add((b.path, b.parent))
                texts.append(b.text)
                places.append(page_no << 32 | known.setdefault((host, b.path, 0, 1), len(known)))
            single.extend((path, known.setdefault((host, path, parent, 0), len(known))) for path, parent in leaves)
            single.extend((c, known.setdefault((host, p, 0, 2), len(known))) for p, c in children.items())
        if single:
            f, n = zip(*single, strict=True)
            held.append((mix(np.array(f, U64)) >> U64(14), np.array(n, np.int64)))
        if texts:
            h, off = shingles(pa.array(texts, pa.string()), RUN, fold=False)
            h, place = h >> U64(14), np.repeat(np.array(places, np.int64), np.diff(off))
            order = np.lexsort((h, place))
            h, place = h[order], place[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (place[1:] != place[:-1])
            held.append((h[keep], place[keep] & 0xFFFFFFFF))
        if sum(len(f) for f, _ in held) >= HELD:
            yield sent()
    if held:
        yield sent()


def _keys(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), U64)
    for c in columns:
        h = mix(h + c.astype(U64))
    return h


def _sums(known: np.ndarray, count: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same sums with a row for each node; host -1 is all hosts."""
    _, first, at = np.unique(_keys(known["host"], known["path"], known["what"]), return_index=True, return_inverse=True)
    return known[first], np.bincount(at, count, len(first)), np.bincount(at, logs, len(first))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of their groups: of each node the sums of n and of n * log(n) over a task's features, of its host (not null) and of all hosts (null)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def close(parts: list[tuple]) -> None:
        known = np.concatenate([p[0] for p in parts])
        feature, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64)
        sizes = np.concatenate([p[1] for p in parts])
        for all_hosts in (False, True):
            if all_hosts:
                known["host"] = -1
            _, first, at = np.unique(_keys(known["host"], known["path"], known["what"]), return_index=True, return_inverse=True)
            node = np.repeat(at, sizes)
            order = np.lexsort((feature, node))
            f, d = feature[order], node[order]
            start = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (d[1:] != d[:-1])])
            total = np.add.reduceat(n[order], start)
            held.append((known[first], np.bincount(d[start], total, len(first)), np.bincount(d[start], total * np.log(total), len(first))))

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = _sums(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held[:] = [out]
        return out

    def sent() -> pa.RecordBatch:
        known, count, logs = joined()
        held.clear()
        host = pa.array(known["host"], mask=known["host"] == -1)
        return pa.RecordBatch.from_arrays([host, pa.array(known["path"]), pa.array(known["parent"]), pa.array(known["what"].astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(logs)], names=["host", "path", "parent", "what", "n", "nlog"])

    group, parts = None, []
    for batch in batches:
        for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group and parts:
                close(parts)
                parts = []
                if sum(len(k) for k, _, _ in held) > HELD_SUMS and len(joined()[0]) > HELD_SUMS // 2:
                    yield sent()
            group = g
            parts.append(_unpacked(*row))
    if parts:
        close(parts)
    if held:
        yield sent()
    trim()


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, site, all): a leaf's importance in its host's tree (null on hosts of few pages) and in that of all hosts. Hosts are their keys."""
    from .shared import materialize

    seen = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(_observe, "group int, nodes int, features int, head binary, low binary")
    seen = seen.repartition("group").sortWithinPartitions("group").mapInArrow(_counted, "host long, path long, parent long, what int, n long, nlog double")
    seen = materialize(seen, "style-counts")

    def tree(rows: DataFrame, by: list[str]) -> DataFrame:
        """Pages, mean of 1 - log_m(k) over runs, and the entropy of children, for each node."""
        of = lambda w, c: F.sum(F.when(F.col("what") == w, F.col(c)))
        sums = rows.groupBy(*by, "path").agg(
            F.max(F.when(F.col("what") == 0, F.col("parent"))).alias("parent"), of(0, "n").alias("m"),
            of(1, "n").alias("k"), of(1, "nlog").alias("klog"), of(2, "n").alias("c"), of(2, "nlog").alias("clog"),
        )
        leaves = sums.where("m is not null").select(*by, "path", "parent", "m", F.when(F.col("m") > 1, 1 - F.least(F.lit(1.0), F.col("klog") / F.col("k") / F.log("m"))).otherwise(1.0).alias("content"))
        inner = sums.where("c is not null").select(*by, F.col("path").alias("parent"), F.when(F.col("c") > 1, (F.log("c") - F.col("clog") / F.col("c")) / F.log("c")).otherwise(1.0).alias("style"))
        return leaves.join(inner, [*by, "parent"], "left").select(*by, "path", "m", (PRESENTATION * F.coalesce("style", F.lit(0.0)) + (1 - PRESENTATION) * F.col("content")).alias("importance"))

    site = tree(seen.where("host is not null"), ["host"]).select("host", "path", F.when(F.col("m") >= FEW_PAGES, F.col("importance")).alias("site"))
    every = tree(seen.where("host is null"), []).select("path", F.col("importance").alias("every"))
    return site.join(every, "path").select("host", "path", "site", F.col("every").alias("all"))


def main_text(page: str | None, gone: dict[int, int]) -> str:
    """The page's text without noise and branches of low importance: ``gone`` has 1 for paths that go, 2 for those that go within an article too."""
    blocks, _ = parse(page or "")
    kept = [b for b in blocks if not b.noise and gone.get(b.path, 0) <= b.inside]
    if 2 * sum(len(b.text) for b in kept if b.inside) > sum(len(b.text) for b in kept):
        kept = [b for b in kept if b.inside]
    return "\n".join(b.text for b in kept)


def low_branches(trees: DataFrame) -> DataFrame:
    """(host, path, gone) of the paths whose importance is low: 1 outside of articles, 2 everywhere."""
    low = F.coalesce("site", "all") < LEAST
    return trees.select("host", "path", F.when(low & (F.greatest("site", "all") < LEAST), 2).when(low, 1).alias("gone")).where("gone is not null")


def _extract(known: dict[int, dict[int, int]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """known: what goes, by host; else rows bring that of their host as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            urls, pages = batch.column("url"), batch.column("html").to_pylist()
            if known is not None:
                trees = [known.get(host_key(u), {}) for u in urls.to_pylist()]
            else:
                trees = [{r["path"]: r["gone"] for r in x or ()} for x in batch.column("tree").to_pylist()]
            texts = [main_text(p, t) for p, t in zip(pages, trees, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent_rows: int = SENT_ROWS) -> DataFrame:
    """Each page's page_id, url, text (main text, blocks joined by a line end; empty if none) and n_chars (code points).

    Null and empty html give the empty text; null urls share the host ''.
    Repeated pages count in the trees as often as they stand there, which is
    what marks a notice, and each gets its row. Null or repeated ids are no
    matter; an empty table gives no rows; other columns are ignored.
    """
    from .shared import materialize

    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long"
    trees = materialize(low_branches(importances(rows)), "style-trees")
    if trees.count() <= sent_rows:
        known: dict[int, dict[int, int]] = {}
        for r in trees.collect():
            known.setdefault(r.host, {})[r.path] = r.gone
        return rows.mapInArrow(_extract(known), schema)
    by_host = trees.groupBy("host").agg(F.collect_list(F.struct("path", "gone")).alias("tree"))  # a host's own paths
    by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    host = F.pandas_udf(lambda urls: urls.map(host_key).astype("int64"), "long")
    salted = rows.withColumn("host", host("url")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(by_host, ["host", "salt"], "left").select("page_id", "url", "html", "tree").mapInArrow(_extract(None), schema)
