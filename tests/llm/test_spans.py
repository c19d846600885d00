import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reprise.llm.spans import SharedSpans, codes, line_units, stretches, units

LEAST = 24


def shared(a: str, b: str, least: int) -> bool:
    return any(a[k : k + least] in b for k in range(len(a) - least + 1))


@settings(max_examples=150, deadline=None)
@given(st.text("ab\n😀", max_size=90), st.text("ab\n", max_size=90), st.text("ab😀", min_size=LEAST, max_size=60), st.text("abc", max_size=90))
def test_every_shared_stretch_has_a_common_unit(x, y, common, z):
    a, b = x + common + y, z + common + x
    (da, pa), (db, pb) = units(a, LEAST), units(b, LEAST)
    shifts = {int(q - p) for d, p in zip(da, pa) for e, q in zip(db, pb) if d == e}
    found = [s for k in shifts for s in stretches(codes(a), codes(b), k, LEAST)]
    assert found and all(a[i : i + n] == b[j : j + n] and n >= LEAST for i, j, n in found)


def test_units_are_few():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefgh ", k=20_000))
    assert len(units(text)[0]) < 20_000 / 40
    assert len(units("=" * 50_000)[0]) <= 4 and len(units("x" * 239)[0]) == 0


def records():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    common = [text(rng.randint(15, 80)) for _ in range(12)]
    rows = []
    for r in range(40):
        for p in range(rng.randint(1, 3)):
            x = text(rng.randint(0, 50)) + (rng.choice(common) if rng.random() < 0.6 else "") + text(rng.randint(0, 50))
            rows.append((f"r{r:02}", f"p{p}", x))
    rows += [("r90", "p0", common[0] * 3), ("r91", "p0", common[0] * 3), ("r91", "p1", common[0] * 3), ("r92", "p0", "z" * 100), ("r92", "p1", "z" * 90)]
    rows += [("r93", "p0", "head" + "=" * 90 + "tail" + "-" * 50), ("r94", "p0", "=" * 30 + "a-b"), ("r94", "p1", "-" * 60)]
    return rows


def test_agrees_with_brute_force(spark):
    rows = records()
    odd = [("n", "p0", None), (None, "p0", "z" * 100), ("e", "p0", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "record_id string, part string, text string, digest int")
    found = SharedSpans(df, LEAST)
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and shared(a[2], b[2], LEAST)}
    got = [tuple(r) for r in found.record_pairs().collect()]
    assert len(wanted) > 30 and len(got) == len(set(got)) and set(got) == wanted
    cover = {(r.record_id, r.part): r.shared_chars for r in found.coverage().collect()}
    for rid, part, x in rows:
        marks = np.zeros(len(x), bool)
        for k in range(len(x) - LEAST + 1):
            if any(o[0] != rid and x[k : k + LEAST] in o[2] for o in rows):
                marks[k : k + LEAST] = True
        assert cover[rid, part] == marks.sum()
    assert cover["e", "p0"] == 0 and len(cover) == len(rows) + 1
    none = SharedSpans(df.limit(0), LEAST)
    assert none.record_pairs().collect() == [] and none.coverage().collect() == []


def test_lines(spark):
    rows = [("a", "p", "Title\r\nBody  text\nTitle"), ("b", "p", "title\n\nbody text "), ("c", "q", None), ("d", "p", "")]
    df = spark.createDataFrame(rows, "record_id string, part string, text string")
    got = line_units(df).collect()
    kept = {(r.record_id, r.start): r.kept for r in got}
    assert kept == {("a", 0): True, ("a", 7): True, ("a", 18): False, ("b", 0): False, ("b", 6): True, ("b", 7): False, ("d", 0): True}
    for rid, _, text in rows:
        if text:
            mine = sorted((r.start, r.length) for r in got if r.record_id == rid)
            assert sum(n for _, n in mine) == len(text) and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    assert {r.start for r in line_units(df, "paragraph").where("record_id = 'b'").collect()} == {0, 7}
    assert all(r.kept for r in line_units(df, least=100).collect())
