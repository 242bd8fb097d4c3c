"""9. HTML extraction by site style trees.

The DOMs of one host's pages are merged. An element node is known by its parent, the parent's style (the sequence of its
children's labels, repeats merged) and its own label (tag, class, id). Over the m pages that have an element:
presentation importance is the entropy to base m of its styles; content importance of a text node is one less the mean
over its distinct texts of log(n)/log(m), n being the pages that have the text there; texts without any letter or digit
don't count. Composite importance is (1 - g^l) * presentation + g^l * mean of the children's, l being the number of styles.
An element is noise when it and all below it are of low composite importance; such branches are removed from every page,
but for inline ones beside a text that stays, which are words of its sentence. What is left of the body is the page's text.

Plan: one pass tells pages of a host apart by a hash of their DOM, and one shuffle of the pages leaves one of each. A second
emits (host, element, style or text hash, pages) rows, pre-added by batch; two aggregations bring them to a row per element
that at least two pages have, in which styles of a single page are no more than counted, and a host's tree is folded in one
group of those. A last pass prunes every row.
Pages are joined with the noise of their host, by broadcast up to BROADCAST_ELEMENTS elements and by sort-merge beyond it.

Defined results: null html gives null text, empty html the empty text. A page without a host belongs to no site: nothing
but scripts, styles, heads and comments goes. So it is on a host's only page. Repeated rows, and pages of a host that are
alike but for scripts, styles, heads, comments, white space and attributes other than class and id, count as one page and
each get its text: else a text that stands on a page and its copy would be taken for a template. Broken markup: an end tag without its start is passed over; open elements end with their parent, and p, li, tr, td, th, dt, dd,
option before the next of their kind. Other columns aren't looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from phonoflow.plans.register import source
from phonoflow.session import bound_batches, cut_lineage

DAMPING = 0.9
THRESHOLD = 0.95
BROADCAST_ELEMENTS = 1_000_000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTRS = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = frozenset("p li tr td th dt dd option".split())
_SCOPE = frozenset("ul ol table dl select div article section body td th".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data em font i kbd mark q s small span strong sub sup time tt u var".split())
_HIDDEN = frozenset(("head", "title"))
_SPACE = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W_]")


class Node:
    """An element (label, children) or a text (label "#text"); gap tells of white space alone in front of it."""

    __slots__ = ("label", "children", "text", "gap")

    def __init__(self, label: str, text: str | None = None, gap: bool = False) -> None:
        self.label, self.text, self.children, self.gap = label, text, [], gap


def parse(source: str) -> Node:
    """The DOM of a page; scripts, styles and comments aren't in it."""
    root = Node("#root")
    stack, tags = [root], ["#root"]
    at, gap = 0, False

    def text(s: str) -> bool:
        if s.isspace():
            return True
        stack[-1].children.append(Node("#text", entities.unescape(s), gap))
        return False

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            gap = text(source[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in tags:
                k = len(tags) - 1 - tags[::-1].index(tag)
                del stack[k:], tags[k:]
            continue
        if tag in _SELF_CLOSING:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == tag:
                    del stack[k:], tags[k:]
                    break
                if tags[k] in _SCOPE:
                    break
        attrs = m.group(4)
        label = tag
        if attrs and "=" in attrs:
            named = sorted((a[0].lower(), a[1] or a[2] or a[3]) for a in _ATTRS.findall(attrs))
            label += "".join(f" {k}={v}" for k, v in named)
        node, gap = Node(label, None, gap), False
        stack[-1].children.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(node)
            tags.append(tag)
    if at < len(source):
        text(source[at:])
    return root


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def walk(root: Node) -> Iterator[tuple[int, Node, int, list[int]]]:
    """(element key, node, style hash, the keys of its distinct children) from the root down; heads are left out."""
    todo = [(_hash("#root"), root)]
    while todo:
        key, node = todo.pop()
        kept = [c for c in node.children if c.label.split(" ", 1)[0] not in _HIDDEN]
        labels = [c.label for i, c in enumerate(kept) if not i or kept[i - 1].label != c.label]
        style = _hash(*labels)
        keys = {c: _hash(key, style, c) for c in set(labels)}
        yield key, node, style, sorted(keys.values())
        todo += [(keys[c.label], c) for c in kept]


def fingerprint(source: str) -> int:
    """A hash of all of the DOM that statistics are made of: pages of one host with the same have the same statistics."""
    parts: list[str] = []
    todo: list[Node | None] = [parse(source)]
    while todo:
        node = todo.pop()
        if node is None:
            parts.append("\x02")
        elif node.text is not None:
            parts.append("\x01" + _SPACE.sub(" ", node.text).strip())
        elif node.label.split(" ", 1)[0] not in _HIDDEN:
            parts.append(node.label)
            todo.append(None)
            todo += reversed(node.children)
    return _hash(*parts)


@F.arrow_udf(LongType())
def _fingerprints(source: pa.Array) -> pa.Array:
    return pa.array([fingerprint(s) for s in source.to_pylist()], pa.int64())


_STAT_SCHEMA = "host string, element long, kind int, key long, pages long, children array<long>"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (host, html) to statistics, added up over up to 500 pages: kind 0 pages of the element, 1 of a style, 2 of a text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            seen: dict[tuple, int] = defaultdict(int)
            children: dict[tuple, list[int]] = {}
            for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                mine = set()
                for key, node, style, keys in walk(parse(source)):
                    mine.add((host, key, 0, 0))
                    if node.text is not None:
                        if _LETTER.search(node.text):
                            mine.add((host, key, 2, _hash(_SPACE.sub(" ", node.text).strip())))
                    else:
                        mine.add((host, key, 1, style))
                        children[(host, key, 1, style)] = keys
                for x in mine:
                    seen[x] += 1
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([seen[r] for r in rows], pa.int64()), pa.array([children.get(r) for r in rows], pa.list_(pa.int64()))], ["host", "element", "kind", "key", "pages", "children"])


#: pages, [(pages, children) of each style that two pages or more share], styles of one page with and without children, content importance of a text
Element = tuple[int, list[tuple[int, list[int]]], int, int, float | None]


def composite_importance(elements: dict[int, Element], damping: float = DAMPING) -> dict[int, float]:
    """element -> importance. ``elements`` has those that two pages or more share. What is below a style of one page is on that page alone, so it is important."""
    done: dict[int, float] = {}
    for start in elements:
        todo = [start]
        while todo:
            e = todo[-1]
            if e in done:
                todo.pop()
                continue
            pages, styles, lone, bare, content = elements[e]
            if content is not None:
                done[e] = content
                todo.pop()
                continue
            missing = [c for _, kids in styles for c in kids if c in elements and c not in done]
            if missing:
                todo += missing
                continue
            total = sum(n for n, _ in styles) + lone + bare
            if not total:
                done[e] = 0.0  # texts without a letter
                continue
            node = (-sum(n / total * math.log(n / total) for n, _ in styles) + (lone + bare) / total * math.log(total)) / math.log(pages)
            inner = [(n, kids) for n, kids in styles if kids]
            above = sum(n for n, _ in inner) + lone
            below = (sum(n * sum(done.get(c, 1.0) for c in kids) / len(kids) for n, kids in inner) + lone) / above if above else 0.0
            g = damping ** (len(styles) + lone + bare)
            done[e] = (1 - g) * min(1.0, node) + g * below
            todo.pop()
    return done


def noisy_elements(elements: dict[int, Element], threshold: float = THRESHOLD) -> list[int]:
    """The elements that are, with all below them, of an importance up to the threshold. One that no two pages share is important."""
    importance = composite_importance(elements)
    parents: dict[int, list[int]] = defaultdict(list)
    good = [e for e, x in importance.items() if x > threshold]
    for e, (_, styles, lone, _, _) in elements.items():
        if lone:
            good.append(e)
        for _, kids in styles:
            for c in kids:
                parents[c].append(e)
                if c not in elements:
                    good.append(e)
    keep = set()
    while good:
        e = good.pop()
        if e not in keep:
            keep.add(e)
            good += parents[e]
    return sorted(importance.keys() - keep)


def _noise_of_host(threshold: float):
    def noise(t: pa.Table) -> pa.Table:
        elements = {}
        for e, pages, styles, lone, bare, logs, texts in zip(*(t[c].to_pylist() for c in ("element", "pages", "styles", "lone", "bare", "logs", "texts")), strict=True):
            content = max(0.0, 1 - logs / texts / math.log(pages)) if texts else None
            elements[e] = (pages, [(s["pages"], s["children"] or []) for s in sorted(styles, key=lambda s: s["key"])], lone, bare, content)
        return pa.table({"host": pa.array([t["host"][0].as_py()], pa.string()), "noise": pa.array([noisy_elements(elements, threshold)], pa.list_(pa.int64()))})

    return noise


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.when(host != "", host)


def site_noise(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, noise): the element keys of low importance of every host."""
    bound_batches(pages.sparkSession)
    rows = pages.select(host_of(pages["url"]).alias("host"), pages["html"].alias("html")).where("host is not null and html is not null")
    distinct = rows.withColumn("page", _fingerprints("html")).groupBy("host", "page").agg(F.min("html").alias("html"))
    counts = distinct.select("host", "html").mapInArrow(_statistics, _STAT_SCHEMA).groupBy("host", "element", "kind", "key").agg(F.sum("pages").alias("pages"), F.min("children").alias("children"))
    is_ = lambda k: F.col("kind") == k
    elements = counts.groupBy("host", "element").agg(
        F.coalesce(F.sum(F.when(is_(0), F.col("pages"))), F.lit(0)).alias("pages"),
        # styles of one page, of which the root of a large host may have one for each of its pages, are counted, not collected
        F.collect_list(F.when(is_(1) & (F.col("pages") > 1), F.struct("key", "pages", "children"))).alias("styles"),
        F.count(F.when(is_(1) & (F.col("pages") == 1) & (F.size("children") > 0), 1)).alias("lone"),
        F.count(F.when(is_(1) & (F.col("pages") == 1) & (F.coalesce(F.size("children"), F.lit(0)) <= 0), 1)).alias("bare"),
        F.coalesce(F.sum(F.when(is_(2), F.log("pages"))), F.lit(0.0)).alias("logs"),
        F.count(F.when(is_(2), 1)).alias("texts"),
    )
    return elements.where("pages > 1").groupBy("host").applyInArrow(_noise_of_host(threshold), "host string, noise array<long>")


def clean_text(source: str, noise: set[int] | frozenset[int]) -> str:
    """The text of the page without the branches in ``noise``, a line for each block."""
    root = parse(source)
    gone, keys = set(), {}
    for key, node, style, _ in walk(root):
        keys[id(node)] = key
        if key in noise:
            gone.add(id(node))
    lines, line = [], []
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, closing, stays = todo.pop()
        tag = node.label.split(" ", 1)[0]
        if id(node) not in keys or id(node) in gone and not stays:
            continue
        if node.gap and not closing:
            line.append(" ")
        if node.text is not None:
            line.append(node.text)
            continue
        if tag not in _INLINE:
            lines.append("".join(line))
            line = []
        if not closing:
            todo.append((node, True, stays))
            sentence = stays or any(c.text is not None and id(c) not in gone for c in node.children)
            todo += [(c, False, stays or sentence and c.label.split(" ", 1)[0] in _INLINE) for c in reversed(node.children)]
    lines.append("".join(line))
    return "\n".join(x for x in (_SPACE.sub(" ", s).strip() for s in lines) if x)


def extracted(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, text) of every row of ``pages``."""
    noise = cut_lineage(site_noise(pages, threshold).withColumnRenamed("host", "_host"))
    total = noise.agg(F.sum(F.size("noise") + 1)).first()[0] or 0

    @F.arrow_udf("string")
    def text(source: pa.Array, host: pa.Array, bad: pa.Array) -> pa.Array:
        sets: dict[str | None, frozenset[int]] = {None: frozenset()}
        out = []
        for i, (s, h) in enumerate(zip(source.to_pylist(), host.to_pylist(), strict=True)):
            if h not in sets:
                sets[h] = frozenset(bad[i].as_py() or ())
            out.append(None if s is None else clean_text(s, sets[h]))
        return pa.array(out, pa.string())

    side = F.broadcast(noise) if total <= BROADCAST_ELEMENTS else noise
    rows = pages.select(pages["page_id"].alias("page_id"), pages["html"].alias("html"), host_of(pages["url"]).alias("host"))
    return rows.join(side, F.col("host") == F.col("_host"), "left").select("page_id", text("html", "host", "noise").alias("text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return extracted(source(spark, sf_dir, "pages"))
