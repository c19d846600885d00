import random

import numpy as np
import pytest

from reprise.llm.langid import fit
from reprise.llm.pairs import NaiveBayes, copies, ends, ends_in_marker, is_empty, other_language, pair_defects, refuses, shape

STOCK = {
    "en": "the server was restarted after every night because nobody had checked which window they should have used before this week".split(),
    "de": "der dienst wurde nach jeder nacht neu gestartet weil niemand geprüft hatte welches fenster vor dieser woche benutzt wurde".split(),
}


def prose(rng, language, n):
    return " ".join(" ".join(rng.choices(STOCK[language], k=12)).capitalize() + "." for _ in range(n))


def sample():
    rng = random.Random(1)
    return {x: [prose(rng, x, 5) for _ in range(40)] for x in STOCK}


def test_empty():
    assert all(map(is_empty, [None, "", " \n", "—", "...", "N/A", "none.", "(null)", "<NULL>", "_"]))
    assert not any(map(is_empty, ["0", "no", "none of them", "x"]))


def test_copies():
    q = "Who moved the window listed under run 9.13?"
    for text in (q, q.upper(), q[:-1] + " ...", f"Q: {q}", f"User request: {q}", f"{q}\n{q}", f"Question: {q} Question: {q}", f'"{q}"', q.replace(" ", "\n")):
        assert copies(text, q), text
    for text in (q + " The owner moved it.", "The owner moved it.", "run 9.13", q[:20], f"We answer who {q}"):
        assert not copies(text, q), text
    # Questions whose first word stands within the label.
    for label, q in (("Question", "Qu'est-ce que la fenêtre ?"), ("Question", "On which day was it moved?"), ("Input", "In which window was it?"), ("Frage", "A oder B?"), ("Anfrage", "An wem lag es?")):
        assert copies(f"{label}: {q}", q) and copies(f"{label} - {q}", q) and not copies(f"{label} {q}", q), q
    # The words before it are no label, but each repetition has one.
    assert copies("Question on day one Question on day one", "on day one")
    assert not copies("anything", None) and not copies("anything", "?!")


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that request.", "I have to refuse. Please rephrase.", "My guidelines prevent me from sharing this information.", "Sorry, this falls outside of what I may comment on.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Je suis désolé, mais je ne peux pas vous aider.", "Lo siento, pero no puedo ayudar con esa petición.", "Infelizmente não consigo responder a esta pergunta.", "Mi dispiace, ma non posso rispondere.", "Daar kan ik helaas niets over zeggen.", "К сожалению, я не могу ответить на этот вопрос.", "抱歉，我无法回答这个问题。"])
def test_refusals(text):
    assert refuses(text)


@pytest.mark.parametrize("text", ["The vendor said it could not help, so the service was restarted.", "Ops replied 'sorry, I can not help', and the window was moved.", "The owner declined the change: nothing explains why.", "The answer was refused at first, yet it was given later.", "Presso la rete sono stati contati 846 guasti, anche se la richiesta non era nota.", "It took 5 minutes."])
def test_reports_of_refusals_are_sound(text):
    assert not refuses(text)


def test_languages():
    model, rng = fit(sample(), model=NaiveBayes), random.Random(5)
    cases = [(a, b) for a in STOCK for b in STOCK for _ in range(40)]
    got = [other_language(model, prose(rng, a, 1), prose(rng, b, 1), {}) for a, b in cases]
    assert np.mean([g == (a != b) for g, (a, b) in zip(got, cases)]) > 0.98
    assert not other_language(model, "clause 11.6", prose(rng, "de", 1), {})
    one, two = model.scores(["nacht", "the"])[0], np.concatenate([model.scores([w])[0] for w in ("nacht", "the")])
    assert np.allclose(one, two, atol=1e-4)


def test_ends():
    assert ends("It took 5 minutes (timeout).") == (["took", "#", "minutes"], True)
    assert ends("owner of Kel-9") == (["owner", "of", "N"], False)
    assert ends("它在备用") == (["在", "备", "用"], False)
    assert ends("nach dem Fenster, dann,") == ([",", "dann", ","], False)
    assert [shape(x) for x in (",", ":", "-", "/", "9", "1,5", "-3", "9/10")] == [",", ":", "-", "/", "#", "#", "#", "#"]


def test_list_markers():
    for text in ("With:\n1. Mouwes relay\n2.", "With:\n1) Mouwes\n2)\n", "With:\n1.", "With:\r\n1. Mouwes\r\n2. Marn\r\n3.", "With:\n- Mouwes\n-", "* Mouwes\n* "):
        assert ends_in_marker(text), text
    for text in ("2.", "It took\n2.", "With:\n1. Mouwes relay\n2. Marn hub", "With:\n1. Mouwes relay.", "Version 1. Mouwes\n2.", "With:\n- Mouwes\n- 3."):
        assert not ends_in_marker(text), text


def test_cut_lists(spark):
    rng = random.Random(11)
    sound = [prose(rng, "en", 2) for _ in range(100)]
    # Figures that often end a sentence don't make a trailing comma, colon, dash or slash sound.
    sound += [f"The window was {n}. The server was {n}." for n in range(100)]
    rows = [(f"s{i}", "Who?", t, None) for i, t in enumerate(sound)]
    rows += [(f"m{i}", "Who?", "The server was restarted with:\n1. Mouwes relay\n" + m, None) for i, m in enumerate(("2.", "2)"))]
    rows += [(f"c{i}", "Who?", "The server was restarted after every night" + c, None) for i, c in enumerate((",", ":", "-", "/", " -"))]
    df = spark.createDataFrame(rows, "record_id string, prompt string, response string, context_id string")
    none = spark.createDataFrame([], "context_id string, context string")
    got = {r.record_id: r.defect for r in pair_defects(df, sample(), none).collect()}
    assert got == {x: "truncated" for x in ("m0", "m1", "c0", "c1", "c2", "c3", "c4")}


def test_pairs(spark):
    rng = random.Random(9)
    sound = [prose(rng, "en", 2) for _ in range(200)]
    q = "Which window was checked before this week?"
    rows = [(f"s{i}", q, t, None) for i, t in enumerate(sound)] + [(f"o{i}", q, t[:-1], None) for i, t in enumerate(sound[:20])]
    rows += [("e1", q, None, None), ("e2", None, "n/a", None), ("c", q, "Q: " + q, None), ("r", q, "I cannot answer this question.", None)]
    rows += [("l", q, prose(rng, "de", 1), None), ("t1", q, "The server was restarted after every night beca", None), ("t2", q, "The server was restarted (Kelda,", None), ("t3", q, sound[0] + " The server was restarted after zzq", None)]
    rows += [("n", "Who?", "Kelda-5, Marn hub", None), ("k", None, sound[3], None), ("s1", q, sound[1], None), ("e1", q, None, None), ("x", q, "window " * 100_000 + ".", None)]
    rows += [(None, q, "", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "record_id string, prompt string, response string, context_id string, defect string")
    none = spark.createDataFrame([], "context_id string, context string")
    got = {r.record_id: r.defect for r in pair_defects(df, sample(), none).collect()}
    assert got == {"e1": "empty", "e2": "empty", "c": "copies_question", "r": "refusal", "l": "other_language", "t1": "truncated", "t2": "truncated", "t3": "truncated", None: "empty"}
    assert pair_defects(df.limit(0), sample(), none).collect() == []


def test_cut_names(spark):
    rows = [(f"s{i}", "Who?", f"The owner of the window was {name}-{i}.", None) for i, name in enumerate(["Kelda", "Marn"] * 40)]
    rows += [("cut", "Who owned the window of Beaquend?", "The owner of the window was Beaq", None), ("whole", "Who owned the window of Beaquend?", "The owner of the window was Beaquend", "w")]
    df = spark.createDataFrame(rows, "record_id string, prompt string, response string, context_id string")
    contexts = spark.createDataFrame([("w", "The text of Marnhold and Beaquend's"), ("v", None)], "context_id string, context string")
    assert [tuple(r) for r in pair_defects(df, sample(), contexts).collect()] == [("cut", "truncated")]


def test_what_was_not_done_is_no_refusal():
    told = ["I did not receive the information in the report.", "We could not find the answer in the log, so we restarted the node.", "The supplier declined to answer our question.", "My team has not answered the ticket yet."]
    assert not any(map(refuses, told))
    assert all(map(refuses, ["My internal guidelines do not allow an answer.", "I did look, but I cannot answer that.", "Prefiero no contestar a eso.", "Prefiro não responder a isso.", "Preferisco non rispondere."]))


def test_names_are_looked_up_in_every_context(spark):
    rng = np.random.default_rng(0)
    labelled = {x: [" ".join(rng.choice(ws.split(), 40)) + "." for _ in range(10)] for x, ws in {"en": "the server was down and nobody had seen it before", "de": "der dienst war weg und niemand hatte ihn zuvor gesehen"}.items()}
    said = "the report was sent to Lem"
    rows = [("a", "Who got it?", said, "c1"), ("b", "Who got it?", said, "c2"), ("c", "Who got it?", said, None), ("d", "Who got it, Lemest?", said, None)]
    pairs_ = spark.createDataFrame(rows, "record_id string, prompt string, response string, context_id string")
    filler = " ".join("the report was sent to Lem. nobody had seen it" for _ in range(60))
    contexts = spark.createDataFrame([("c1", "It went to Lemest broker. " + filler.replace("Lem.", "Abc.")), ("c2", "It went to Lem today.")], "context_id string, context string")
    got = {r.record_id for r in pair_defects(pairs_, labelled, contexts).where("defect = 'truncated'").collect()}
    assert got == {"a", "d"}
