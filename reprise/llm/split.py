"""Splitting oversized texts at natural boundaries by packing their structure tree.

A text is parsed into a tree: sections by the depth of their headings, in these blocks between blank
lines, in blocks list items nested by their indentation and lines, then sentences and words, which
are only parsed where they are needed. Packing goes bottom-up: a node within the limit is one piece,
only larger ones are descended into, and sibling subtrees that fit are merged, the smallest
neighbours first, up to the limit. Characters are cut only where a single word exceeds the limit. The
pieces' cores partition the text, so nothing is lost, and every piece after the first starts with the
last `overlap` characters before its core.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = r"(?:\r\n|\r(?!\n)|\n)"
_BLANK = re.compile(rf"[^\S\r\n]*{_BREAK}[^\S\r\n]*{_BREAK}\s*")
_LINE = re.compile(rf"{_BREAK}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_WORD = re.compile(r"\s+")
#: A heading and its depth: marks before it, a tag, marks around it, or a short line on its own.
_MARKED = re.compile(r"[^\S\r\n]*(#{1,6})\s")
_TAGGED = re.compile(r"[^\S\r\n]*<h([1-6])\b", re.IGNORECASE)
_FRAMED = re.compile(r"[^\S\r\n]*(={1,6})[^=\r\n]+=+\s*$", re.MULTILINE)
_TITLE = re.compile(r"[^\W\d_a-z][^\r\n.!?。！？]{0,78}:?\s*\Z|\d[^\r\n.!?。！？]{0,78}:?\s*\Z")
_TITLE_DEPTH = 7
#: A list item: its indentation is that of the mark.
_ITEM = re.compile(r"([^\S\r\n]*)(?:[-*+•–]|\d{1,4}[.)]|[a-zA-Z][.)])[^\S\r\n]+\S")
#: Lists nested deeper than this are read as of this depth.
_NESTING = 40

#: Boundaries that pieces may be parted at, outermost first.
LEVELS = (_BLANK, _LINE, _SENTENCE, _WORD)

OVERLAP_TOO_LARGE = "overlap_not_below_limit"
PIECES_SCHEMA = "source_id string, piece_no int, n_pieces int, core_start int, core_end int, overlap int, piece string, n_chars int, cut_level string, error string"


def _spans(at: re.Pattern, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a span; the white space of a boundary belongs to the part before it."""
    cuts = [start]
    for m in at.finditer(text, start, end):
        if cuts[-1] < m.end() < end:
            cuts.append(m.end())
    return list(zip(cuts, [*cuts[1:], end]))


class Node:
    """A span of the text; its children, which partition it, are parsed when asked for."""

    __slots__ = ("start", "end", "kind", "inner")

    def __init__(self, start: int, end: int, kind: str, inner: list[Node] | None = None):
        self.start, self.end, self.kind, self.inner = start, end, kind, inner

    def children(self, text: str) -> list[Node]:
        if self.inner is None:
            self.inner = [self]
            for kind in {"block": ("line", "sentence", "word"), "line": ("sentence", "word"), "sentence": ("word",)}.get(self.kind, ()):
                if kind == "line":
                    self.inner = _lines(text, self.start, self.end)
                else:
                    self.inner = [Node(a, b, kind) for a, b in _spans(_SENTENCE if kind == "sentence" else _WORD, text, self.start, self.end)]
                if len(self.inner) > 1:
                    break
        return self.inner


def _lines(text: str, start: int, end: int) -> list[Node]:
    """Lines of a block as a tree: an item holds its own line, the deeper items after it and lines indented further."""
    root: list[Node] = []
    open_: list[tuple[int, Node]] = []  # indentation and node of the items that are open, outermost first
    for a, b in _spans(_LINE, text, start, end):
        item = _ITEM.match(text, a, b)
        indent = len(item[1]) if item else next((k for k in range(b - a) if not text[a + k].isspace()), b - a)
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        for _, node in open_:
            node.end = b
        siblings = open_[-1][1].inner if open_ else root
        line = Node(a, b, "line")
        if item and len(open_) < _NESTING:
            node = Node(a, b, "item", [line])
            siblings.append(node)
            open_.append((indent, node))
        else:
            siblings.append(line)
    return root


def _heading(text: str, start: int, end: int) -> int | None:
    for at in (_MARKED, _FRAMED):
        if m := at.match(text, start, end):
            return len(m[1])
    if m := _TAGGED.match(text, start, end):
        return int(m[1])
    return _TITLE_DEPTH if _TITLE.match(text[start : min(end, start + 200)].lstrip()) and end - start < 200 else None


def parse(text: str) -> Node:
    """The tree of a text down to its blocks."""
    root = Node(0, len(text), "section", [])
    open_: list[tuple[int, Node]] = [(0, root)]
    for a, b in _spans(_BLANK, text, 0, len(text)):
        depth = _heading(text, a, b)
        if depth is not None:
            while open_[-1][0] >= depth:
                open_.pop()
            section = Node(a, b, "section", [])
            open_[-1][1].inner.append(section)
            open_.append((depth, section))
        open_[-1][1].inner.append(Node(a, b, "block"))
        for _, node in open_:
            node.end = max(node.end, b)
    return root


def _hard(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Runs of at most `limit` characters that don't part what is written as one character."""
    out = []
    while end - start > limit:
        cut = start + limit
        for back in range(min(8, limit - 1)):
            x, y = text[cut - back - 1], text[cut - back]
            if not (unicodedata.combining(y) or y in "‍️\n" and (y != "\n" or x == "\r") or x == "‍" or 0x1F3FB <= ord(y) <= 0x1F3FF):
                cut -= back
                break
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def _merged(spans: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Neighbours merged while they fit the limit, those that make the smallest whole first."""
    n = len(spans)
    start, end = [a for a, _ in spans], [b for _, b in spans]
    before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(end[i + 1] - start[i], i, i + 1) for i in range(n - 1) if end[i + 1] - start[i] <= limit]
    heapq.heapify(heap)
    while heap:
        size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] >= 0:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and end[y] - start[x] <= limit:
                heapq.heappush(heap, (end[y] - start[x], x, y))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def _pack(text: str, node: Node, limit: int, opened: list[Node]) -> list[tuple[int, int]]:
    """Spans within the limit that cover a node, in order; blocks that had to be descended into are noted."""
    if node.end - node.start <= limit:
        return [(node.start, node.end)]
    if node.kind == "block":
        opened.append(node)
    children = node.children(text)
    if len(children) == 1:
        return _hard(text, node.start, node.end, limit) if children[0] is node or node.kind == "word" else _pack(text, children[0], limit, opened)
    out: list[tuple[int, int]] = []
    whole: list[tuple[int, int]] = []  # siblings that fit, not yet merged
    for child in children:
        if child.end - child.start <= limit:
            whole.append((child.start, child.end))
        else:
            out += _merged(whole, limit) + _pack(text, child, limit, opened)
            whole = []
    return out + _merged(whole, limit)


#: Characters around the places in question that a boundary's white space is looked for in.
_MARGIN = 200


def _boundary(text: str, start: int, end: int, low: int, high: int, target: int) -> int:
    """A place from low to high within a span: at the outermost level that has one there, nearest the target."""
    for at in LEVELS:
        found = [m.end() for m in at.finditer(text, max(start, low - _MARGIN), min(end, high + _MARGIN)) if low <= m.end() <= high]
        if found:
            return min(found, key=lambda x: abs(x - target))
    return min(max(target, low), high)


def _recut(text: str, start: int, end: int, limit: int, first: int, least: int) -> list[tuple[int, int]] | None:
    """A span parted anew in pieces from `least`, the first from `first`, to `limit` characters; None if there are none such."""
    n = -(-(end - start) // limit)
    if first + (n - 1) * least > end - start:
        return None
    out = []
    for k in range(n, 1, -1):
        own = least if out else first
        low, high = max(start + own, end - (k - 1) * limit), min(start + limit, end - (k - 1) * least)
        cut = _boundary(text, start, end, low, high, start + (end - start) // k)
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def cores(text: str, limit: int, first: int, least: int, opened: list[Node] | None = None) -> list[tuple[int, int]]:
    """Spans that partition `text`, each within `limit`, none under `least` (`first` for the first) where that can be avoided.

    A span that is too short is merged with a neighbour, or parted anew together with as few
    neighbours as it takes.
    """
    spans = _pack(text, parse(text), limit, [] if opened is None else opened)
    i = 0
    while i < len(spans) and len(spans) > 1:
        a, b = spans[i]
        if b - a >= (least if i else first):
            i += 1
            continue
        for j in sorted((j for j in (i - 1, i + 1) if 0 <= j < len(spans)), key=lambda j: spans[j][1] - spans[j][0]):
            low, high = min(i, j), max(i, j)
            if spans[high][1] - spans[low][0] <= limit:
                spans[low : high + 1] = [(spans[low][0], spans[high][1])]
                i = low
                break
        else:
            # Pieces of exactly the limit can only be had of the whole text.
            low, high = (i, i) if least < limit else (0, len(spans) - 2) if i < len(spans) - 1 else (1, i)
            while low > 0 or high < len(spans) - 1:
                if low > 0 and (high == len(spans) - 1 or i - low <= high - i):
                    low -= 1
                else:
                    high += 1
                if new := _recut(text, spans[low][0], spans[high][1], limit, least if low else first, least):
                    spans[low : high + 1] = new
                    i = low + len(new)
                    break
            else:
                i += 1
    return spans


def _cut_level(text: str, opened: list[Node], limit: int) -> str:
    """First of blank_line, sentence, word at which all parts of the opened blocks fit, else hard."""
    parts = [p for x in opened if len(p := text[x.start : x.end].strip()) > limit]
    for name, at in (("blank_line", None), ("sentence", _SENTENCE), ("word", _WORD)):
        if at:
            parts = [p for part in parts for x in at.split(part) if len(p := x.strip()) > limit]
        if not parts:
            return name
    return "hard"


def split_text(text: str, limit: int | None, least: int | None, overlap: int | None) -> tuple[list[tuple[int, int, int]], str | None]:
    """((start of piece, start of core, end) of each piece of `text`, level at which it is cut).

    Pieces have at most `limit` characters, overlap included. A text within the limit is one piece,
    as is any text when the limit is null or below 1; its level is null. An overlap that leaves no
    room for new text can't be kept: there are no pieces then, only a level.
    """
    if not limit or limit < 1 or len(text) <= limit:
        return [(0, 0, len(text))], None
    over = max(overlap or 0, 0)
    opened: list[Node] = []
    if over >= limit:
        _pack(text, parse(text), limit, opened)
        return [], _cut_level(text, opened, limit)
    room, low = limit - over, max(least or 0, 1)
    spans = cores(text, room, min(low, room), min(max(low - over, 1), room), opened)
    return [(max(0, a - over), a, b) for a, b in spans], _cut_level(text, opened, limit)


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.strip().split(" ")[0] for x in PIECES_SCHEMA.split(",")]
    for batch in batches:
        out = []
        for source_id, text, limit, least, overlap in batch[["source_id", "context", "max_segment_chars", "min_segment_chars", "overlap_chars"]].itertuples(index=False):
            if text is None:
                continue
            size, low, over = (None if pd.isna(x) else int(x) for x in (limit, least, overlap))
            spans, level = split_text(text, size, low, over)
            out += [(source_id, n, len(spans), a, b, a - p, text[p:b], b - p, level, None) for n, (p, a, b) in enumerate(spans)]
            if not spans:
                out.append((source_id, 0, 0, 0, len(text), 0, None, len(text), level, OVERLAP_TOO_LARGE))
        yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in names if c in ("piece_no", "n_pieces", "core_start", "core_end", "overlap", "n_chars")})


def split_records(records: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of each distinct record's context under the limits of its dataset's configuration.

    Repeated rows of a `source_id` count once. A null context has no pieces; an empty one has one
    empty piece. A record whose dataset has no configuration, or one without a limit, comes out as
    one piece, `cut_level` being null as for every text within the limit. More pieces than the
    configuration's max_segments are made where the text needs them. A record whose overlap is not
    below the limit comes out as one row with `error` and without a piece. Other columns are ignored.
    """
    once = records.select("source_id", "dataset", "context").dropDuplicates(["source_id"])
    limits = configs.select("dataset", "max_segment_chars", "min_segment_chars", "overlap_chars").dropDuplicates(["dataset"])
    return once.join(limits, "dataset", "left").mapInPandas(_split_batches, PIECES_SCHEMA)


def oversized(pieces: DataFrame) -> DataFrame:
    """Records that had to be cut, with the level at which their parts fit."""
    return pieces.where((F.col("piece_no") == 0) & F.col("cut_level").isNotNull()).select("source_id", "cut_level")


def rebuilt(pieces: DataFrame, records: DataFrame, configs: DataFrame) -> DataFrame:
    """Per record: the digest and length of its pieces' cores one after the other, and whether limit and overlap hold.

    (source_id, text_digest, n_chars, within_limit, overlap_kept). A record's pieces are brought
    together, which is as much as its text.
    """
    limits = records.select("source_id", "dataset").dropDuplicates(["source_id"]).join(configs.select("dataset", "max_segment_chars", "overlap_chars").dropDuplicates(["dataset"]), "dataset", "left").drop("dataset")
    p = F.array_sort(F.collect_list(F.struct("piece_no", "core_start", "overlap", "piece")))
    whole = pieces.where("error IS NULL").groupBy("source_id").agg(p.alias("p"), F.max("n_chars").alias("longest"))
    texts = whole.withColumn("t", F.array_join(F.transform("p", lambda x: F.substring(x.piece, x.overlap + 1, F.length(x.piece))), ""))
    over = F.coalesce("overlap_chars", F.lit(0))
    repeats = lambda x: (x.overlap == F.least(x.core_start, over)) & (F.substring("t", x.core_start - x.overlap + 1, x.overlap) == F.substring(x.piece, F.lit(1), x.overlap))
    kept = F.forall("p", lambda x: (x.piece_no == 0) | repeats(x))
    within = F.coalesce(F.col("longest") <= F.col("max_segment_chars"), F.lit(True))
    return texts.join(limits, "source_id").select("source_id", F.md5("t").alias("text_digest"), F.length("t").alias("n_chars"), within.alias("within_limit"), kept.alias("overlap_kept"))
