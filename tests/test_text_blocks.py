import hashlib
import re

import pytest
from pyspark.sql import functions as F

from reprise.functions import rouge
from reprise.functions import text as T
from reprise.operators import blocks, dedupe

ODD = ["Alpha beta, GAMMA_1!", "Über-maß ½ x² é é", "根据RUN-7的记录。", "", "a\x1c\x85  b​c", "日本 10,000 units; it's", "\r\n\t"]


def ids(text):
    return [int.from_bytes(hashlib.sha256(t.lower().encode()).digest()[:4], "little") & 0x7FFFFFFF for t in re.findall(r"\w+|[^\w\s]", text)]


def digest(tokens):
    return hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in tokens)).hexdigest()[:32]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'array<bigint>' if isinstance(v, tuple) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_tokens_and_digests(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", T.token_ids(F.col("t")).alias("i")).select("t", "i", T.ids_digest(F.col("i")).alias("d"))
    for r in df.collect():
        assert r.i == ids(r.t) and r.d == (digest(ids(r.t)) if r.i else "")


def test_windows_and_blocks(spark):
    df = spark.createDataFrame([(list(range(1, 12)),), ([1, 2],)], "i array<bigint>")
    rows = df.select(T.blocks(F.col("i"), 4).alias("b"), T.windows(F.col("i"), 9).alias("w")).collect()
    assert rows[0].b == [[1, 2, 3, 4], [5, 6, 7, 8]] and len(rows[0].w) == 3 and rows[1].b == [] and rows[1].w == []


@pytest.mark.parametrize(("output", "answer", "f1"), [("alpha beta", "alpha beta", 1.0), ("alpha beta", "alpha gamma", 0.5), ("a b", "c d", 0.0), ("Alpha, BETA!", "alpha beta", 1.0), ("x x y", "x x x", 2 / 3), ("", "a", 0.0)])
def test_token_f1(spark, output, answer, f1):
    assert one(spark, T.token_f1(F.col("o"), F.col("a")), o=output, a=answer) == pytest.approx(f1)


def test_best_answers(spark):
    best = T.best_of(F.col("a"), lambda a: T.token_f1(F.col("o"), a))
    assert one(spark, best, o="alpha beta", a=["gamma", "alpha beta"]) == 1.0
    assert one(spark, best, o="alpha", a=[]) is None and one(spark, best, o="alpha", a=["", None]) == 0.0
    recall = T.best_of(F.col("a"), lambda a: T.answer_recall(F.col("o"), a))
    assert one(spark, recall, o="The servers were restarting", a=["restarted the server"]) == 1.0


@pytest.mark.parametrize(("a", "b", "score"), [("a b c d", "a b c d", 1.0), ("a b c d", "a c b d", 0.75), ("a b", "c d", 0.0), ("", "a", 0.0), ("A, b!", "a B", 1.0)])
def test_rouge(spark, a, b, score):
    assert rouge.rouge_l_score(a, b) == pytest.approx(score)
    assert one(spark, rouge.rouge_l(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(score)


def test_longest_common_against_the_plain_program():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = (tuple(rng.choices("abcd", k=rng.randint(0, 14))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row, last = [0], row
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        assert rouge.longest_common(a, b) == row[-1]


@pytest.mark.parametrize(("text", "letter"), [("Answer: B", "B"), ("final answer - (c)", "C"), ("x\n(D).\n", "D"), ("Either A or B", "A"), ("none here", None), ("", None)])
def test_letters(spark, text, letter):
    assert one(spark, T.answer_letter(F.col("t")), t=text) == letter


def test_names_and_sentences(spark):
    assert one(spark, T.stable_id(F.col("a"), F.col("b")), a="x", b="y") == hashlib.sha256(b"x\x1fy").hexdigest()[:16]
    assert one(spark, T.id_token(F.col("a")), a="--Run 7/É--") == "run-7" and one(spark, T.id_token(F.col("a")), a="//") == "x"
    assert one(spark, T.sentences(F.col("a")), a=" One.\nTwo!  三。四 x") == ["One.", "Two!", "三。", "四 x"]
    assert one(spark, T.inject_sentence(F.col("a"), F.lit("New.")), a="One. Two. Three.") == "One. New. Two. Three."


def item(i, source, recipient, donors, negative=False, meta=None):
    return (i, "d", source, "t", [(f"{i}-{n}", t, "l", meta or {}) for n, t in enumerate(donors)], recipient, negative)


SCHEMA = "item_id string, dataset string, source_id string, transform string, donor_prompts array<struct<donor_id string, text string, label string, metadata map<string,string>>>, recipient_prompt string, negative_control boolean"
words = lambda x, n=64: " ".join(f"{x}{i}" for i in range(n))


def test_exact_hits(spark):
    rows = [item("a", "s1", words("q") + " " + words("x"), [words("x")]), item("b", "s2", words("z", 10), ["q"]), item("c", "s3", words("y"), [])]
    got = {r.item_id: (r.total_blocks, r.hit_blocks) for r in blocks.exact_hits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": (8, 4), "b": (0, 0), "c": (4, 0)}
    rates = {r.transform: r.exact_block_hit_rate for r in blocks.hit_rates(blocks.exact_hits(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert rates == {"t": 4 / 12, None: 4 / 12}


def violations(spark, rows):
    return {(r.kind, r.item_id) for r in blocks.collisions(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_collisions(spark):
    a, b, c = words("alpha"), words("beta"), words("gamma")
    assert violations(spark, [item("a1", "a", a, [a]), item("b1", "b", b, [b])]) == set()
    assert violations(spark, [item("a1", "a", a, [a]), item("b1", "b", a, [b])]) == {("phantom_cross_source", "b1")}
    assert violations(spark, [item("a1", "a", a, [a]), item("b1", "b", b, [a], meta={"negative_source_id": "a"})]) == set()
    assert violations(spark, [item("a1", "a", a, [a]), item("b1", "b", c, [c], negative=True, meta={"negative_source_id": "z"})]) == {("negative_control_overlap", "b1")}
    pre = words("pre", 32) + " "
    shared = [item(f"{x}1", x, pre + t, [pre + t]) for x, t in (("a", a), ("b", b), ("c", c))]
    report = blocks.collision_report(spark.createDataFrame(shared, SCHEMA)).first()
    assert report.passed and report.boilerplate_blocks == 2 and report.items_checked == 3
    dots = [item("a1", "a", ". " * 64, [". " * 64]), item("b1", "b", ". " * 64, [b])]
    assert violations(spark, dots) == set()


def test_eligible_blocks(spark):
    rows = [("i", n, t, d, "x") for n, (t, d) in enumerate([(0, 8), (1, 9), (2, 10), (3, 11), (4, 20), (5, 22), (6, 23), (7, 24)])]
    actions = spark.createDataFrame(rows, "item_id string, ordinal int, target_pos int, donor_pos int, donor_id string")
    assert blocks.eligible_blocks(actions, 4).first().eligible_blocks == 1
    fixed = actions.union(spark.createDataFrame([("i", 9, 4, 21, "x")], actions.schema))
    assert blocks.eligible_blocks(fixed, 4).first().eligible_blocks == 2
    assert spark.range(1).select(blocks.full_reuse_blocks(F.array(*map(F.lit, range(7))), F.lit(8), 4).alias("n")).first().n == 1


def kept(spark, texts):
    df = spark.createDataFrame([(f"s{n}", t) for n, t in enumerate(texts)], "source_id string, text string")
    windows = dedupe.shared_windows(df, "source_id", "text")
    return [r.kept for r in sorted(dedupe.greedy_keep(df, windows, "source_id").collect(), key=lambda r: r.source_id)]


def test_greedy_dedupe(spark):
    shared = words("s", 32)
    assert kept(spark, [words("a") + " " + shared, words("b"), shared + " " + words("c", 48)]) == [True, True, False]
    assert kept(spark, [words("a") + " " + shared, words("b", 7) + " " + shared]) == [True, False]
    assert kept(spark, ["x y", "x y"]) == [True, True]
    # The second is dropped and so doesn't block the third.
    assert kept(spark, [words("a", 20), words("a", 20) + " " + words("b", 20), words("b", 20)]) == [True, False, True]
    assert kept(spark, []) == []
    # A window that every source holds.
    assert kept(spark, [shared + " " + words(x, 9) for x in "abcdefgh"]) == [True] + [False] * 7


def test_cap(spark):
    df = spark.createDataFrame([(d, f"{d}{n}") for d in "xy" for n in range(4)], "dataset string, source_id string")
    assert sorted(r.source_id for r in dedupe.cap_per_dataset(df, "source_id", 2).collect()) == ["x0", "x1", "y0", "y1"]
