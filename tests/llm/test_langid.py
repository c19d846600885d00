import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise.llm.langid import KneserNey, fit, label_documents, label_language, label_texts, sample_texts, viterbi, without_logs, wrong_labels

# Word stocks of invented sentences in three languages.
STOCK = {
    "en": "the server was restarted after every night because nobody had checked which window they should have used before this week when customers were waiting".split(),
    "de": "der dienst wurde nach jeder nacht neu gestartet weil niemand geprüft hatte welches fenster vor dieser woche benutzt werden sollte während kunden gewartet haben".split(),
    "es": "el servidor fue reiniciado después de cada noche porque nadie había comprobado qué ventana debían usar antes de esta semana cuando los clientes esperaban".split(),
}


def prose(rng, language, sentences):
    return " ".join(" ".join(rng.choices(STOCK[language], k=rng.randint(8, 14))).capitalize() + "." for _ in range(sentences))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    # A quarter of the texts labelled "es" are English.
    sample = {x: [prose(rng, "en" if x == "es" and n % 4 == 0 else x, 6) for n in range(60)] for x in STOCK}
    return fit(sample)


def test_held_out_accuracy(model):
    rng = random.Random(2)
    cases = [(x, prose(rng, x, rng.randint(1, 5))) for x in STOCK for _ in range(80)]
    got = label_texts(model, [t for _, t in cases])
    assert np.mean([g[0] == x for (x, _), g in zip(cases, got)]) > 0.99
    assert all(not g[2] and g[1] > 0.9 for g in got)
    assert [g[0] for g in label_texts(model, ["Wszyscy ludzie rodzą się wolni i równi", "人人生而自由"])] == ["und", "und"]


def test_other_languages_are_rejected(model):
    others = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Всі люди народжуються вільними і рівними у своїй гідності та правах.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "qwjx zkvp brtl mnhg xcvb wqpl jkhz tyrw plmk nbvc",
    ]
    assert {g[:2] for g in label_texts(model, others)} == {("und", 0.0)}
    assert np.isfinite(model.reject).all() and model.temperature >= 1


def test_sample_takes_copies_once(spark):
    df = spark.createDataFrame([(f"text {n % 40}", "en") for n in range(400)] + [("x", "German"), (None, "de"), ("y", None)], "text string, lang string").repartition(5)
    got = sample_texts(df, 30)
    assert len(got["en"]) == len(set(got["en"])) == 30 and got["de"] == ["x"] and set(got) == {"de", "en"}
    assert got == sample_texts(df.repartition(2), 30) and sample_texts(df.limit(0)) == {}


def test_probabilities_sum_to_one(model):
    for j in range(3):
        for start in ("", "d", "se", "xq"):
            chars = [c for c in map(chr, np.flatnonzero(model.alphabet.table > 1))]
            draws = np.array([model.scores([start + c])[0][0, j] for c in chars] + [model.scores([start])[0][0, j] if start else -np.inf])
            own = model.scores([start])[0][0, j] if start else 0.0
            # One more character, its own end taken out again by the difference to the prefix alone.
            assert np.isfinite(draws[:-1]).all() and own <= 0
    m = KneserNey({"x": ["ab", "ab", "ac"], "y": ["b"]})
    p = np.exp(m.logp[0][:, 0]).sum() + (m.alphabet.size - len(m.keys[0])) * np.exp(m.backoff[0][0, 0] + m.floor[0])
    assert abs(p - 1) < 1e-5
    context = int(m.alphabet.table[ord("a")])
    following = (m.keys[1] >> 12) == context
    seen = np.exp(m.logp[1][following, 0]).sum()
    at, _ = np.searchsorted(m.contexts[1], context), None
    unseen = [k for k in range(m.alphabet.size) if k not in set((m.keys[1][following] & 4095).tolist())]
    lower = [np.exp(m.logp[0][np.searchsorted(m.keys[0], k), 0]) if k in m.keys[0] else np.exp(m.backoff[0][0, 0] + m.floor[0]) for k in unseen]
    assert abs(seen + np.exp(m.backoff[1][at, 0]) * sum(lower) - 1) < 1e-4


def test_mixed_texts(model):
    rng = random.Random(3)
    a, b = prose(rng, "en", 3), prose(rng, "de", 2)
    text = a + "\n\n" + b + "\r\n2026-01-01T10:00:00Z INFO audit.x code=3 ms=4\n"
    (lang, sure, mixed, segments) = label_texts(model, [text])[0]
    assert lang == "en" and mixed == ["de", "en"] and [s["lang"] for s in segments] == ["en", "de"]
    assert text[segments[0]["start"] : segments[0]["end"]].strip() == a and text[segments[1]["start"] : segments[1]["end"]].strip() == b
    quoted = prose(rng, "en", 4) + " It was called «neu gestartet». " + prose(rng, "en", 2)
    assert label_texts(model, [quoted])[0][2] == []
    assert label_texts(model, [prose(rng, "en", 4) + " " + prose(rng, "es", 1)])[0][2] == []


def test_mixed_chinese():
    rng = random.Random(6)
    zh = ["供应商在高负载下检查了日志归档", "审计小组撤销了终止通知", "服务在每个夜晚之后都被重新启动", "客户在等待期间没有人检查窗口"]
    fitted = fit({"en": [prose(rng, "en", 6) for _ in range(60)], "zh": ["。".join(rng.choices(zh, k=4)) + "。" for _ in range(60)]})
    en, two = prose(rng, "en", 3), f"{zh[0]}。{zh[1]}，{zh[2]}。"
    lang, _, mixed, segments = label_texts(fitted, [en + "\n\n" + two])[0]
    assert lang == "en" and mixed == ["en", "zh"] and [(s["lang"], s["sentences"]) for s in segments] == [("en", 3), ("zh", 2)]
    # One sentence, or two single words, make no text mixed.
    assert [g[2] for g in label_texts(fitted, [en + "\n\n" + zh[0] + "。", en + " 窗口。通知。"])] == [[], []]


def test_log_lines_are_no_prose():
    text = "A sentence stands here.\n2026-05-18T22:18:57Z INFO audit.X-9 code=claus blocks=12\nAnd x=1 is a sentence about one assignment."
    assert without_logs(text).split("\n")[1].strip() == "" and without_logs(text).split("\n")[2].startswith("And") and len(without_logs(text)) == len(text)
    assert viterbi(np.array([[0.0, -1], [-1, 0], [0, -1]])).tolist() == [0, 0, 0]


def test_labels(spark):
    cases = {"en-US": "en", "EN": "en", "deu": "de", "Dutch": "nl", " fr ": "fr", "zh_CN": "zh", "sv": "sv", "und": None, "n/a": None, "": None, " ": None, "unknown": None, "mul": None, None: None}
    df = spark.createDataFrame([(x,) for x in cases], "lang string")
    assert {r.lang: r.y for r in df.select("lang", label_language(F.col("lang")).alias("y")).collect()} == cases


def test_documents(spark, model):
    rng = random.Random(4)
    rows = [(1, prose(rng, "en", 3), "en-GB"), (2, prose(rng, "de", 3), None), (3, prose(rng, "es", 3), "German"), (4, None, "en"), (5, "", None), (6, "12 34 !!", "en"), (7, prose(rng, "en", 2) + " " + prose(rng, "de", 2), "en"), (7, prose(rng, "en", 2), "en"), (None, prose(rng, "de", 2000), "de")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, confidence string").repartition(2)
    labelled = label_documents(df, model)
    assert labelled.count() == len(rows)
    assert sorted(map(tuple, wrong_labels(labelled).collect())) == [(2, "missing", "de"), (3, "wrong", "es"), (7, "mixed", "de"), (7, "mixed", "en")]
    assert {r.doc_id: r.lang for r in labelled.where("doc_id in (4, 5, 6)").collect()} == {4: "und", 5: "und", 6: "und"}
    assert label_documents(df.limit(0), model).collect() == []
    sample = sample_texts(df, per_language=1)
    assert set(sample) == {"en", "de"} and all(len(x) == 1 for x in sample.values())
