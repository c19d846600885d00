from hypothesis import given, settings
from hypothesis import strategies as st

import re

from reprise.llm.split import OVERLAP_TOO_LARGE, oversized, parse, split_records, split_text

TEXT = st.text(st.sampled_from("ab c.\n!。 \r\t-#é😀‍1=T"), max_size=400)


def ladder(text, limit):
    """The definition of cut levels, on the whole text."""
    parts = [text]
    line = r"(?:\r\n|\r(?!\n)|\n)"
    for name, at in (("blank_line", rf"[^\S\r\n]*{line}[^\S\r\n]*{line}\s*"), ("sentence", r"(?<=[.!?])\s+|(?<=[。！？])\s*"), ("word", r"\s+")):
        parts = [x.strip() for p in parts for x in re.split(at, p)]
        if all(len(p) <= limit for p in parts):
            return name
    return "hard"


def check_tree(text, node):
    if node.inner is not None and node.inner != [node]:
        assert [node.start, *(x.end for x in node.inner)] == [*(x.start for x in node.inner), node.end]
        for x in node.inner:
            check_tree(text, x)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 60), st.integers(0, 70))
def test_pieces_keep_the_text_the_limit_and_the_overlap(text, limit, least, overlap):
    pieces, level = split_text(text, limit, least, overlap)
    assert level == (ladder(text, limit) if len(text) > limit else None)
    if len(text) > limit and overlap >= limit:
        assert pieces == []
        return
    assert "".join(text[a:b] for _, a, b in pieces) == text
    assert all(b - p <= limit for p, _, b in pieces)
    assert all(a - p == min(overlap, a) for p, a, _ in pieces[1:])
    assert len(pieces) == 1 or all(b > a for _, a, b in pieces)
    # No short piece where any parting of the whole text has none.
    room, low = limit - overlap, max(least - overlap, 1)
    n = -(-len(text) // room) if room > 0 else 0
    if len(pieces) > 1 and least <= room and least + (n - 1) * low <= len(text):
        assert all(b - p >= min(least, b) for p, _, b in pieces)
    tree = parse(text)
    for x in (tree, *tree.inner):
        x.children(text)
    check_tree(text, tree)


def kept(text, *limits):
    return [text[a:b] for _, a, b in split_text(text, *limits)[0]]


def test_short_pieces_are_avoided():
    text = "\n\n".join(["word " * 50, "tail.", "more " * 60])
    got = split_text(text, 300, 100, 20)[0]
    assert len(got) >= 2 and all(b - a >= 100 for _, a, b in got)
    # More than half the limit: three pieces are parted anew.
    got = split_text("x" * 100 + " " + "y" * 99 + " " + "z" * 59, 100, 80, 0)[0]
    assert [b - a >= 80 for _, a, b in got] == [True] * 3


def test_overlap_is_kept():
    text = "alpha beta gamma delta. " * 20
    pieces, _ = split_text(text, 100, 0, 80)
    assert all(a - p == min(80, a) for p, a, _ in pieces[1:]) and all(b - p <= 100 for p, _, b in pieces)


def test_cuts_fall_on_natural_boundaries():
    text = "# One\n\n" + "alpha beta. " * 10 + "\n\n# Two\n\n" + "gamma delta. " * 10
    assert [x.lstrip()[:5] for x in kept(text, 150, 0, 0)] == ["# One", "# Two"]
    assert all(x.rstrip().endswith(".") for x in kept("One two three. " * 40, 100, 0, 0))


def test_sections_and_lists_are_nested():
    text = "# A\n\nintro\n\n## B\n\nbody one\n\n## C\n\nbody two\n\n# D\n\nlast"
    a, d = parse(text).inner
    assert [x.kind for x in a.inner] == ["block", "block", "section", "section"] and text[d.start :].startswith("# D")
    # The subsections go whole into pieces; the last section is not torn off its heading.
    assert kept(text, 30, 0, 0) == ["# A\n\nintro\n\n## B\n\nbody one\n\n", "## C\n\nbody two\n\n", "# D\n\nlast"]
    items = "- one\n  - inner a\n  - inner b\n- two\n  more of two\n- three"
    block = parse(items).inner[0]
    assert [items[x.start : x.end] for x in block.children(items)] == ["- one\n  - inner a\n  - inner b\n", "- two\n  more of two\n", "- three"]
    assert [items[x.start : x.end] for x in block.children(items)[0].inner] == ["- one\n", "  - inner a\n", "  - inner b\n"]
    assert kept(items, 35, 0, 0) == ["- one\n  - inner a\n  - inner b\n", "- two\n  more of two\n- three"]
    deep = "\n".join("  " * k + "- x" for k in range(200))
    assert "".join(kept(deep, 500, 10, 0)) == deep


def test_cut_levels():
    level = lambda *x: split_text(*x, 0, 0)[1]
    assert level("aaaa\n \nbbbb", 4) == "blank_line"
    assert level("aaaa\r\nbbbb", 8) == "word"
    assert level("aa. bb。cc", 3) == "sentence"
    assert level("aa bb", 2) == "word"
    assert level("aaa bb", 2) == "hard"
    assert level("aaa", 3) is None


def test_records(spark):
    rows = [("a", "d", "x " * 100, 1), ("a", "d", "x " * 100, 2), ("b", "d", "", 1), ("c", "d", None, 1), ("e", "none", "y" * 500, 1), (None, "d", "z", 1), ("f", "d", "w" * 300_000, 1)]
    records = spark.createDataFrame(rows, "source_id string, dataset string, context string, piece int")
    configs = spark.createDataFrame([("d", 50, 10, 5, "x")], "dataset string, max_segment_chars int, min_segment_chars int, overlap_chars int, context string")
    got = split_records(records, configs).collect()
    by = {}
    for r in got:
        by.setdefault(r.source_id, []).append(r)
    assert set(by) == {"a", "b", "e", "f", None}
    assert "".join(r.piece[r.overlap :] for r in sorted(by["a"], key=lambda r: r.piece_no)) == "x " * 100
    assert [r.piece for r in by["b"]] == [""] and len(by["e"]) == 1 and len(by["f"]) > 6000
    assert sorted(map(tuple, oversized(split_records(records, configs)).collect())) == [("a", "word"), ("f", "hard")]
    assert split_records(records.limit(0), configs).collect() == []
    (bad,) = split_records(records.where("source_id = 'a'"), configs.selectExpr("dataset", "max_segment_chars", "min_segment_chars", "50 AS overlap_chars")).collect()
    assert (bad.error, bad.piece, bad.cut_level, bad.n_chars) == (OVERLAP_TOO_LARGE, None, "word", 200)
