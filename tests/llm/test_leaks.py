import random

import numpy as np

from reprise.llm.leaks import MASKS, RUN, best_chain, in_runs, leaked_documents, leaked_passages, runs_on, seed_gain, seeds, word_hashes, words


def longest_in_runs(d: list[str], p: list[str], least: int) -> int:
    """Most words common to both in order, in runs of at least `least`."""
    best = [[0] * (len(p) + 1) for _ in range(len(d) + 1)]
    run = [[0] * (len(p) + 1) for _ in range(len(d) + 1)]
    for i in range(1, len(d) + 1):
        for j in range(1, len(p) + 1):
            run[i][j] = run[i - 1][j - 1] + 1 if d[i - 1] == p[j - 1] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], *(best[i - t][j - t] + t for t in range(least, run[i][j] + 1)))
    return best[-1][-1]


def brute(doc: str, passage: str) -> bool:
    """Definition, by trying every stretch of the document."""
    d, p = words(doc), words(passage)
    size = int(len(p) * 1.5)
    return bool(p) and any(longest_in_runs(d[s : s + size], p, RUN) >= max(len(p) / 2, RUN) for s in range(max(1, len(d) - size + 1)))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(30, 60))) + ".") for i in range(12)]
    docs = []
    for n in range(160):
        noise = lambda k: rng.choices(vocabulary, k=k)
        text = noise(rng.randint(0, 60))
        if n % 2:
            p = words(rng.choice(passages)[1])
            a = rng.randrange(len(p) // 2)
            p = p[a : a + rng.randint(len(p) // 3, len(p))]
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], ["xx"], [p[k].upper(), "yy"]])
                p = p or ["z"]
            text += p
        docs.append((n, ("\r\n" if n % 3 else ", ").join(text + noise(rng.randint(0, 40)))))
    return docs, passages


def test_agrees_with_brute_force(spark):
    docs, passages = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, passage string")
    items = spark.createDataFrame([(*p, "x") for p in passages], "eval_id bigint, passage string, text string")
    found = leaked_passages(df, items).cache()
    got = {(r.doc_id, r.eval_id) for r in in_runs(found).collect()}
    wanted = {(d, e) for d, text in docs for e, p in passages if brute(text, p)}
    assert len(wanted) > 20 and got == wanted
    assert sum(len(r.eval_ids) for r in leaked_documents(found).collect()) == found.count()


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, text.upper()), (3, text), (3, text), (4, "filler " * 200_000 + text), (5, "one two three four")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text), (7, text), (8, None), (9, ""), (10, "one two three four"), (None, text)], "eval_id bigint, passage string")
    got = sorted(((r.doc_id or 0), (r.eval_id or 0)) for r in leaked_passages(docs, items).collect())
    assert got == sorted((d, e) for d in (0, 3, 3, 4) for e in (0, 7))
    assert leaked_passages(docs, items.limit(0)).collect() == [] and leaked_passages(docs.limit(0), items).collect() == []


def test_chains():
    assert best_chain([(0, 0, 10), (11, 12, 8)], 100) == (18, 0, 19)
    assert best_chain([(0, 0, 10), (8, 9, 8)], 100)[0] == 16
    assert best_chain([(0, 20, 10), (30, 0, 8)], 100)[0] == 10
    assert best_chain([(0, 0, 10), (50, 12, 8)], 40)[0] == 10
    # The stretch begins within the first run.
    assert best_chain([(0, 0, 17), (57, 17, 12)], 60) == (20, 2, 62)
    assert best_chain([], 10) == (0, 0, 0) and best_chain([(0, 0, 4)], 10) == (0, 0, 0) and best_chain([(0, 0, 9)], 4) == (0, 0, 0)


def test_chains_agree_with_brute_force():
    rng = random.Random(3)
    for n in range(150):
        kinds, least = rng.choice([2, 3, 8, 30]), rng.choice([2, 3, 5])
        p = [str(rng.randrange(kinds)) for _ in range(rng.randint(1, 25))]
        d = [str(rng.randrange(kinds)) for _ in range(rng.randint(0, 15))]
        for _ in range(rng.randint(1, 3)):
            a = rng.randrange(len(p))
            d += p[a : a + rng.randint(1, 15)] + [str(rng.randrange(kinds)) for _ in range(rng.randint(0, 4))]
        ids, text = np.array(list(map(int, d)), np.uint64), np.array(list(map(int, p)), np.uint64)
        size = rng.choice([len(p) // 2, len(p), int(len(p) * 1.5)])
        runs = [r for s in range(-len(p), len(d)) for r in runs_on(ids, text, s, least)]
        wanted = max(longest_in_runs(d[s : s + size], p, least) for s in range(len(d)))
        got, first, end = best_chain(runs, size, least)
        assert got == wanted and end - first <= size, (d, p, least, size)


def test_seeds_and_altered_text(spark):
    assert min(map(len, MASKS)) <= RUN and max(map(len, MASKS)) > RUN
    assert len(seeds(*word_hashes(["a b c d", "", "e f g"]))[0]) == 0 and len(seeds(*word_hashes([]))[0]) == 0
    # Seeds don't reach from one text into the next, and their hashes depend on the picked words only.
    code, text, place = seeds(*word_hashes(["x", "a b c d e f", "A B - d e f"]), masks=("11011",))
    assert list(zip(text, place)) == [(1, 0), (1, 1), (2, 0)] and len(set(code)) == 3
    (one,), (other,) = (seeds(*word_hashes([t]), masks=("11011",))[0] for t in ("a b c d e", "A B, z d e"))
    assert one == other
    # Every third word is another one: no run of five, but two of three words stand.
    passage = [f"p{i}" for i in range(60)]
    altered = [w if i % 3 else "x" + w for i, w in enumerate(passage)]
    scattered = [w if i % 2 else "x" + w for i, w in enumerate(passage)]
    docs = spark.createDataFrame([(1, " ".join(["so"] * 9 + altered)), (2, " ".join(scattered)), (3, " ".join(passage[:31]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(passage))], "eval_id bigint, passage string")
    found = leaked_passages(docs, items)
    got = {r.doc_id: (r.words_found, r.words_similar, r.first_word, r.last_word) for r in found.collect()}
    assert got == {1: (0, 40, 10, 69), 3: (31, 0, 0, 31)}
    assert tuple(seed_gain(found).first()) == (1, 1, 1)


def test_hot_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"'{text}' AS text")
    items = spark.range(3).selectExpr("id AS eval_id", f"'{text}' AS passage")
    assert leaked_passages(docs, items).count() == 9000
