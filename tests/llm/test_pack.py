import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reprise.llm.pack import fill, fill_report, oversized, pack_documents, token_count


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 50).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, c), max_size=80))))
def test_no_container_overflows(case):
    capacity, sizes = case
    at = fill(sizes, capacity)
    load = {}
    for s, b in zip(sizes, at):
        load[b] = load.get(b, 0) + s
    assert all(v <= capacity for v in load.values())
    assert sorted(load) == list(range(len(load)))
    used = [v for v in load.values()]
    assert sum(v <= capacity / 2 for v in used) <= 1 or capacity < 2


def test_fill_is_tight():
    rng = random.Random(1)
    sizes = [min(1000, int(rng.paretovariate(0.9) * 20)) for _ in range(5000)]
    n = max(fill(sizes, 1000)) + 1
    assert n <= 1.02 * sum(sizes) / 1000 + 2


def test_token_count_matches_the_pattern(spark):
    texts = ["a_b c1,d", "über-Maß ½ x²", "根据RUN-7的记录。", "", "\x1c\x85  a​b", "é é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(token_count("text").alias("n")).collect()] == [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]


def test_documents_come_out_whole(spark):
    rows = [(i, "w " * (i % 37)) for i in range(300)] + [(1000, "x " * 1234), (1001, None), (1002, ""), (5, "w " * 5), (None, "a b")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, tokens int")
    budgets = spark.createDataFrame([(1, 50), (2, 400), (2, 400), (3, None), (4, 0)], "budget_id int, capacity_tokens int")
    got = pack_documents(docs, budgets, bucket=100).collect()
    assert {r.budget_id for r in got} == {1, 2}
    for budget, capacity in ((1, 50), (2, 400)):
        mine = [r for r in got if r.budget_id == budget]
        assert {r.doc_id for r in mine} == {r[0] for r in rows}
        assert sum(r.tokens for r in mine) == sum(len((t or "").split()) for _, t in rows)
        load = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        assert max(load.values()) <= capacity
        whole = sorted((r.piece_no, r.token_start, r.tokens) for r in mine if r.doc_id == 1000)
        assert [s for _, s, _ in whole] == [i * capacity for i in range(len(whole))] and sum(t for *_, t in whole) == 1234
        assert all(r.n_pieces == 1 for r in mine if r.doc_id != 1000)
    packed = pack_documents(docs, budgets)
    assert sorted(map(tuple, oversized(packed).collect())) == [(1, 1000), (2, 1000)]
    assert all(r.n_containers >= r.least_containers and r.fill > 0.9 for r in fill_report(packed, budgets).collect())
    assert pack_documents(docs.limit(0), budgets).collect() == [] and pack_documents(docs, budgets.limit(0)).collect() == []


def test_many_budgets(spark, monkeypatch):
    """However many budgets a pass takes, all are packed alike."""
    docs = spark.createDataFrame([(n, "w " * (n % 9)) for n in range(40)], "doc_id bigint, text string")
    budgets = spark.createDataFrame([(n, 5 + n) for n in range(5)], "budget_id int, capacity_tokens int")
    at_once = sorted(map(tuple, pack_documents(docs, budgets).collect()))
    monkeypatch.setattr("reprise.llm.pack.BUDGETS_AT_ONCE", 2)
    assert sorted(map(tuple, pack_documents(docs, budgets).collect())) == at_once and {r[0] for r in at_once} == set(range(5))
