"""Operator 3, HTML extraction: nearest-URL page differencing.

A page is cut into blocks of text: markup, comments, scripts, styles and form
controls go, character references are decoded, white space inside a block
becomes one space. A block is one of three kinds:

* main: inside <article> or <main>, and kept;
* furniture: inside menus, headers, footers, sidebars, notices, adverts, forms
  or reader comments, by element, role, or the name of a class or id. A class
  name counts if all of its words say furniture or a part of a page ("site-nav",
  not "social-history" or "has-sidebar"). An article inside furniture (a teaser,
  a comment, or what follows an element that was never closed) is main only if
  the page has no other main text;
* open: everything else, settled by differencing.

Pages of a host are ordered by URL path and query. A page is compared with the
nearer of the paths before and after its own (longer common beginning, else
the one before), of which the page of least page_id stands for all. The lines
of the two pages, of all kinds, are aligned by longest common subsequence, and
open lines that both share are deleted. A page that would lose all its text is
a mirror of the other; the farther neighbour is tried then, and without one
nothing is deleted.

Texts don't move. Paths and 64-bit hashes of lines, some bytes a line, are
sorted, paired with the neighbouring paths (ranges lend each other their
border paths, so the result doesn't depend on partitions) and joined, a path
of many pages spread by a salt. The places to delete come back to their pages,
broadcast if they are few (counted), else in a join; the page is cut into
blocks again.

Null or empty html gives an empty text; pages with a null or odd URL have no
neighbour. Rows repeated with one page_id are extracted each.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlight.operators.skew import spread_join

from .common import arrow_map, cut

#: Places to delete are broadcast up to this size.
SMALL_MB = 8
FURNITURE, OPEN, MAIN, CLAIMED = 0, 1, 2, 3
TAG = re.compile(
    r"<!--(?>.*?(?:-->|\Z))"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select)\b[^>]*+>(?>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?>[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>",
    re.S | re.I,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: HTML element names and attribute words by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
SPACES = frozenset("br td th wbr option".split())
FURNITURE_TAGS = frozenset("nav header footer aside form button head title menu dialog fieldset search".split())
MAIN_TAGS = frozenset(["article", "main"])
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that only say which part of a page, or how it is laid out.
PART_WORDS = frozenset(
    "area article articles author bar block body bottom box button buttons card cards center column container content count desktop entry fixed form global group heading holder icons inner item items left link links list main mobile overlay outer page panel post posts primary reader readers region reply replies right row secondary section site slot sticky stories story text thread title top unit user wrap wrapper zone".split()
)
#: Elements that hold what the page is about are kept whatever their class says.
NEVER = frozenset(["html", "body", "article", "main"])
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+").findall


def says_furniture(name: str, inside_main: bool) -> bool:
    """Whether a class or id names furniture and nothing else; the header of an article is part of it."""
    words = {w.lower() for w in NAME_WORDS(name)}
    told = words & FURNITURE_WORDS
    if not told or inside_main and told == {"header"}:
        return False
    return all(w.isdigit() or w in PART_WORDS for w in words - told)


def is_furniture(name: str, attrs: str, inside_main: bool) -> bool:
    if name in FURNITURE_TAGS and not (inside_main and name == "header"):
        return True
    if not attrs or name in NEVER:
        return False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            if any(says_furniture(own, inside_main) for own in value.split()):
                return True
            continue
        value = value.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in FURNITURE_ROLES:
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order; empty ones are left out."""
    out: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = []  # elements that are open, and the kind of text inside
    kind, parts, at = OPEN, [], 0

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((kind, text))
        parts.clear()

    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in SPACES:
            parts.append(" ")
        if name in BLOCKS:
            end_block()
        if m["close"]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if name not in BLOCKS and any(open_[j][1] != open_[-1][1] for j in range(k, len(open_))):
                        end_block()
                    del open_[k:]
                    break
        elif name not in VOID:
            if name in BLOCKS and open_ and open_[-1][0] == "p":
                open_.pop()
            now = open_[-1][1] if open_ else OPEN
            if name in MAIN_TAGS:
                now = CLAIMED if now in (FURNITURE, CLAIMED) else MAIN
            elif now != FURNITURE and is_furniture(name, m["attrs"], now in (MAIN, CLAIMED)):
                if name not in BLOCKS:
                    end_block()
                now = FURNITURE
            open_.append((name, now))
        kind = open_[-1][1] if open_ else OPEN
    if at < len(page):
        parts.append(page[at:].partition("<")[0] if re.match(r"[^<]*<[a-z/!]", page[at:], re.I) else page[at:])
    end_block()
    claimed = FURNITURE if any(k == MAIN for k, _ in out) else MAIN
    return [(claimed if k == CLAIMED else k, t) for k, t in out]


def place(url: str | None) -> tuple[str, str]:
    """(host, path with its query) of a URL; both empty if it has none."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname, f"{parts.path or '/'}?{parts.query}") if parts.hostname else ("", "")
    except ValueError:
        return "", ""


def common_lines(a: list, b: list) -> list[int]:
    """Positions in a of one longest common subsequence with b, by bit-parallel rows."""
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in at], [x for x in b if x in both]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _common(a[head : len(a) - tail], b[head : len(b) - tail])
    return [at[i] for i in (*range(head), *(head + i for i in inner), *range(len(a) - tail, len(a)))]


def _rows(a: list, b: list) -> Iterator[int]:
    """After each line of a: bit j is 0 where the best length with b[:j + 1] exceeds that with b[:j]."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _common(a: list, b: list, most_bits: int = 1 << 27) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > most_bits and len(a) > 1:  # divide, so that memory is bounded: Hirschberg
        half = len(a) // 2
        lengths = []
        for x, y in ((a[:half], b), (a[:half:-1] + [a[half]], b[::-1])):
            for v in _rows(x, y):
                pass
            bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
            lengths.append(np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))]))
        cut = int((lengths[0] + lengths[1][::-1]).argmax())
        return _common(a[:half], b[:cut], most_bits) + [half + i for i in _common(a[half:], b[cut:], most_bits)]
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def removed(kinds: bytes, own: list[int], nearer: list[int] | None, farther: list[int] | None) -> list[int]:
    """The open lines to delete: those shared with the nearer page, or with the farther if the nearer is a mirror."""
    for other in (nearer, farther):
        gone = {i for i in common_lines(own, other) if kinds[i] == OPEN} if other else set()
        if gone and any(k == MAIN or k == OPEN and i not in gone for i, k in enumerate(kinds)):
            return sorted(gone)
        if other and not gone:
            return []
    return []


OUTLINE = "page_id long, digest long, host string, path string, kinds binary, lines binary"
SCHEMA = "page_id long, url string, text string, n_chars long, n_lines long, n_removed long"


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, digest (of url and html), and url and html; a row is known by the first two."""
    return pages.select("page_id", F.xxhash64("url", "html").alias("digest"), "url", "html")


def outlines(pages: DataFrame) -> DataFrame:
    """(page_id, digest, host, path, kinds, lines): a byte and a 64-bit hash for each block of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [place(u) for u in b.column(2).to_pylist()]
            found = [blocks(h or "") for h in b.column(3).to_pylist()]
            lines = [np.array([xxhash.xxh64_intdigest(t) for _, t in f], np.uint64).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), pa.array([bytes(k for k, _ in f) for f in found], pa.binary()), pa.array(lines, pa.binary())],
                [c.split()[0] for c in OUTLINE.split(", ")],
            )

    return arrow_map(with_digest(pages), run, OUTLINE)


def neighbours(paths: DataFrame) -> DataFrame:
    """(host, path, before, after): each distinct path with the (path, lines) next to it on its host, null at the ends."""
    keys = ["host", "path"]
    spread = cut(paths.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    ends = sorted((r.part, tuple(r.low), tuple(r.high)) for r in spread.groupBy("part").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high")).collect())
    lent = [(*b[1], a[0]) for a, b in zip(ends, ends[1:])] + [(*a[2], b[0]) for a, b in zip(ends, ends[1:])]  # two for each partition
    borders = paths.sparkSession.createDataFrame(lent, "host string, path string, to int")
    copies = spread.join(F.broadcast(borders), keys).drop("part").withColumnRenamed("to", "part")
    rows = spread.withColumn("own", F.lit(True)).unionByName(copies.withColumn("own", F.lit(False)))
    order = Window.partitionBy("part").orderBy(*keys)
    near = lambda side: F.when(side("host").over(order) == F.col("host"), side(F.struct("path", "lines")).over(order))
    return rows.select(*keys, "own", near(F.lag).alias("before"), near(F.lead).alias("after")).filter("own").drop("own")


def removals(pages: DataFrame) -> DataFrame:
    """(page_id, digest, gone): the positions of blocks that differencing deletes, for pages that lose any."""
    seen = cut(outlines(pages)).filter("host <> ''")
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "digest"), F.lit(64)))
    first = F.min(F.struct(F.col("page_id").isNull().alias("bare"), "page_id", "digest", "lines")).alias("first")
    part = salted.groupBy("host", "path", "salt").agg(first)
    paths = part.groupBy("host", "path").agg(F.min("first").alias("first")).select("host", "path", "first.lines")
    unsettled = seen.filter(F.hex("kinds").rlike("^(..)*01"))  # with an open line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = lambda raw: np.frombuffer(raw, np.uint64).tolist()
        for b in batches:
            out = []
            for page_id, digest, path, kinds, lines, before, after in zip(*(b.column(k).to_pylist() for k in range(7))):
                nearer, farther = before, after
                if before and after and prefix(after["path"], path) > prefix(before["path"], path):
                    nearer, farther = after, before
                if nearer is None:
                    nearer, farther = farther, None
                gone = removed(kinds, ints(lines), nearer and ints(nearer["lines"]), farther and ints(farther["lines"]))
                if gone:
                    out.append((page_id, digest, gone))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["page_id", "digest", "gone"])

    met = spread_join(unsettled, neighbours(paths), ["host", "path"], F.struct("page_id", "digest")).select("page_id", "digest", "path", "kinds", "lines", "before", "after")
    return arrow_map(met, run, "page_id long, digest long, gone array<int>").dropDuplicates(["page_id", "digest"])


def extract(pages: DataFrame, small_mb: int = SMALL_MB) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by two line feeds), n_chars, n_lines (blocks of all kinds), n_removed (open blocks that differencing deleted)."""
    gone = cut(removals(pages))
    size = gone.agg(F.sum(F.size("gone") * 4 + 64)).first()[0] or 0
    told = gone.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "gone")
    told = F.broadcast(told) if size <= small_mb << 20 else told.hint("shuffle_hash")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    rows = with_digest(pages).join(told, same, "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, page, gone in zip(*(b.column(k).to_pylist() for k in range(4))):
                found, less = blocks(page or ""), set(gone or ())
                text = "\n\n".join(t for i, (k, t) in enumerate(found) if k == MAIN or k == OPEN and i not in less)
                out.append((page_id, url, text, len(text), len(found), len(less)))
            if out:
                yield batch_of(out)

    return arrow_map(rows, run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in SCHEMA.split(", ")])
