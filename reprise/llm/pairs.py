"""Defects of prompt and response pairs.

Five kinds, at most one per record, in this order: `empty`, `copies_question`, `refusal`,
`other_language`, `truncated`. Emptiness, copies and refusals are rules on words. The languages of
prompt and response are compared by the posteriors of a character n-gram naive Bayes model. A text
counts as truncated if its last words hardly ever end a text: the likelihood of an end after an
n-gram is estimated from all responses and contexts, interpolated from one word to three, in
distributed counts. So does one whose last line is only the marker of a list's next item.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.llm.langid import Alphabet, _find, _grams, fit
from reprise.operators.skew import grid_join
from reprise.session import materialise

# Texts that stand for the lack of one.
PLACEHOLDERS = frozenset({"none", "null", "nil", "n a", "na", "nan", "undefined", "no answer", "no response", "not available", "not applicable", "unknown", "empty", "tbd", "todo", "pending", "missing", "leer", "keine", "vide", "aucun", "aucune", "vacío", "ninguno", "ninguna", "vazio", "nenhum", "nenhuma", "vuoto", "nessuno", "nessuna", "leeg", "geen", "нет", "пусто", "无", "空", "暂无"})

# Fixed values, by language: words of a speaker about himself, of denial, and of what an answer does.
# A sentence that has one of each declines; others' refusals, being reported, lack the first, and what
# the speaker did not or could not do, being told, is no denial.
REFUSALS = {
    "en": (r"i|i'm|i'd|me|we|we're|us|(?:my|our) (?:\w+ )?(?:guidelines|instructions|polic\w+|rules|role|programming)", r"(?<!\bdid )(?<!\bcould )(?<!\bhave )(?<!\bhas )(?<!\bhad )(?<!\bwas )(?<!\bwere )not|no|can't|won't|cannot|don't|unable|declin\w+|refus\w+|prevent\w*|prohibit\w*|forbid\w*|restrict\w*|rather not|outside|beyond|sorry|unfortunately|apolog\w+", r"answer\w*|help\w*|assist\w*|respond\w*|response|discuss\w*|shar\w+|provid\w*|comment\w*|comply|request\w*|question\w*|information|topic|subject|speak|say|tell|give|fulfil\w*|declin\w+|refus\w+"),
    "de": (r"ich|mir|mich|mein\w*|wir|uns", r"nicht|keine?\w*|nichts|ablehn\w*|verweiger\w*|verbiete\w*|untersag\w*", r"antwort\w*|beantwort\w*|helfen|hilfe|weiterhelfen|auskunft|auskünfte|anfrage\w*|frage\w*|sagen|geben|behilflich|dabei|unterstütz\w*|äußern|mitteil\w*|ablehn\w*|verweiger\w*|informationen|thema"),
    "fr": (r"je|j'\w+|me|m'\w+|moi|mes|mon|nous", r"ne|n'\w+|pas|impossible|déclin\w*|refus\w*|interdi\w*|empêch\w*", r"répon\w*|aide\w*|aider|assist\w*|demande|question|fournir|partager|discuter|dire|donner|commenter|renseign\w*|information\w*|sujet|déclin\w*|refus\w*"),
    "es": (r"yo|me|mí|mis?|prefiero|puedo|podré|debo|podemos|siento|lamento|tengo", r"no|declin\w*|rechaz\w*|negar\w*|impid\w*|prohíb\w*|imposible", r"ayud\w*|respond\w*|respuesta|contest\w*|petición|solicitud|pregunta|compart\w*|facilit\w*|decir|dar|hablar|información|tema|asist\w*|declin\w*|rechaz\w*|negarme"),
    "pt": (r"eu|me|mim|meus?|minhas?|prefiro|posso|consigo|poderei|devo|podemos|sinto|lamento|tenho", r"não|declin\w*|recus\w*|imped\w*|proíb\w*|impossível", r"ajud\w*|respond\w*|resposta|pedido|pergunta|solicitação|partilh\w*|compartilh\w*|fornecer|dizer|dar|falar|informaç\w*|assunto|tema|auxili\w*|declin\w*|recus\w*"),
    "it": (r"io|mi|mie|miei|me|preferisco|posso|potrò|devo|riesco|sono (?:autorizzat\w*|in grado|spiacente)|possiamo", r"non|declin\w*|rifiut\w*|impedisc\w*|viet\w*|impossibile", r"aiut\w*|rispond\w*|risposta|richiesta|domanda|condivid\w*|fornire|dire|dare|parlare|informazion\w*|argomento|assist\w*|declin\w*|rifiut\w*"),
    "nl": (r"ik|mij|me|mijn|wij|we|ons", r"niet|geen|niets|weiger\w*|afwijz\w*|verbied\w*", r"help\w*|beantwoord\w*|antwoord\w*|vraag|verzoek|delen|geven|zeggen|verstrekken|informatie|onderwerp|bespreken|weiger\w*|afwijz\w*"),
    "ru": (r"я|мне|меня|мой|мои|моим|мы|нам|могу|смогу|вынужден\w*|извините|простите", r"не|нет|нельзя|отказ\w*|отклон\w*|запре\w*|невозможно", r"помо\w*|ответ\w*|отвеч\w*|вопрос\w*|запрос\w*|просьб\w*|обсужд\w*|сообщ\w*|предостав\w*|сказать|информаци\w*|тем[аеуы]|говорить|отказ\w*|отклон\w*"),
    "zh": (r"我|抱歉|对不起|很遗憾|不好意思", r"无法|不能|不便|拒绝|不可以|不允许|禁止|没办法|没法|不予|不会", r"回答|回复|帮|协助|提供|讨论|处理|透露|请求|问题|答复|说明|满足|分享|话题|内容|信息|要求"),
}
_REFUSAL = [tuple(re.compile(p if x == "zh" else rf"(?<![\w'])(?:{p})(?!\w)", re.IGNORECASE) for p in parts) for x, parts in REFUSALS.items()]
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_QUOTED = re.compile(r"(?<!\w)'[^']{0,200}'(?!\w)|\"[^\"]{0,200}\"|“[^”]{0,200}”|«[^»]{0,200}»|„[^“”]{0,200}[“”]")
_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words that a copy's label may have before the question.
LABEL_WORDS = 3
#: Words that a response must have for its language to be judged.
LANGUAGE_WORDS = 4
#: Log odds (nats) by which another language must be likelier.
LANGUAGE_ODDS = 8.0
#: Likelihood of a sentence's end after the last words under which a text is truncated. It is
#: interpolated from one word to three; a shorter n-gram's estimate counts like `END_WEIGHT` sightings.
END_SHARE, END_WEIGHT, END_PRIOR = 0.01, 10, 0.05
#: A word is broken if longer words that begin with it are so many times as frequent.
WHOLE_WORD = 100
#: A response with fewer plain words than this may be names, codes or figures on their own.
PLAIN_WORDS = 3


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    plain = " ".join(_WORD.findall(text.lower())).replace("_", " ").strip()
    return not plain or plain in PLACEHOLDERS


def copies(text: str, question: str | None) -> bool:
    """Nothing but the question, once or repeated, perhaps under a label."""
    asked = _WORD.findall((question or "").lower())
    found = list(_WORD.finditer(text.lower()))
    words = [m[0] for m in found]
    if not asked or len(words) < len(asked):
        return False
    extra = len(words) % len(asked)
    for skip in {0, extra} | ({len(words) - len(asked)} if len(words) < 2 * len(asked) else set()):
        rest = words[skip:]
        if skip <= LABEL_WORDS and rest and len(rest) % len(asked) == 0 and rest == asked * (len(rest) // len(asked)):
            # The label is what stands before the question's first word; a separator must be in it.
            if skip == 0 or re.search(r"[:>\])\-–—=\n]", text.lower()[: found[skip].start()]):
                return True
    # A label before each repetition.
    for k in range(1, LABEL_WORDS + 1):
        size = len(asked) + k
        if len(words) % size == 0 and len(words) > size and all(words[i + k : i + size] == asked for i in range(0, len(words), size)):
            return True
    return False


def refuses(text: str) -> bool:
    """Whether a sentence of the text, quotations aside, declines in the speaker's own name."""
    plain = _QUOTED.sub(" ", text.replace("’", "'"))
    about = [parts for parts in _REFUSAL if parts[0].search(plain)]
    return bool(about) and any(all(p.search(s) for p in parts) for s in _SENTENCE.split(plain) for parts in about)


class NaiveBayes:
    """Character n-gram naive Bayes: multinomial over the n-grams of padded words, add-one smoothed."""

    ORDERS = (1, 2, 3)

    def __init__(self, words: dict[str, list[str]]):
        self.languages = sorted(words)
        self.alphabet = Alphabet(w for ws in words.values() for w in ws)
        self.tables = []
        for n in self.ORDERS:
            counts = [np.unique(_grams(self.alphabet.ids(words[x]), n), return_counts=True) for x in self.languages]
            keys = np.unique(np.concatenate([k for k, _ in counts]))
            table = np.ones((len(keys), len(self.languages)))
            for j, (k, c) in enumerate(counts):
                table[np.searchsorted(keys, k), j] += c
            total = table.sum(axis=0) + 1
            self.tables.append((keys, np.log(table / total).astype(np.float32), -np.log(total).astype(np.float32)))
        self.reject, self.temperature = np.full(len(self.languages), np.inf), 1.0

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each word under each language, its length with its end)."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        if not len(words):
            return np.zeros((0, len(self.languages)), np.float32), sizes
        ids = self.alphabet.ids(words)
        out = np.zeros((len(ids) - 1, len(self.languages)), np.float32)
        for n, (keys, logs, unseen) in zip(self.ORDERS, self.tables):
            key, place = _grams(ids, n, places=True)
            at, ok = _find(keys, key)
            out[place[ok]] += logs[at[ok]]
            out[place[~ok]] += unseen
        # Overlapping n-grams count each character once for every order.
        return np.add.reduceat(out, np.cumsum(sizes) - sizes, axis=0) / len(self.ORDERS), sizes


def other_language(model: NaiveBayes, text: str, question: str, known: dict[str, np.ndarray]) -> bool:
    """Whether the languages that text and question are likeliest in differ, both being clear."""

    def posterior(x: str) -> np.ndarray | None:
        words = [w for w in _LETTERS.findall(x) if w.islower() or not w.isascii()] or _LETTERS.findall(x)
        han = sum("一" <= c <= "鿿" for c in x)
        if len(words) < LANGUAGE_WORDS and han < 2 * LANGUAGE_WORDS:
            return None
        total = np.zeros(len(model.languages), np.float32)
        for w in words:
            w = w.lower()
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = model.scores([w])[0][0]
            total += known[w]
        return total

    a, b = posterior(text), posterior(question)
    if a is None or b is None:
        return False
    i, j = int(a.argmax()), int(b.argmax())
    return i != j and a[i] - a[j] > LANGUAGE_ODDS and b[j] - b[i] > LANGUAGE_ODDS / 2


# --- ends of texts -----------------------------------------------------------------------------

_TAIL_NOTE = re.compile(r"\s*\([^()]{0,40}\)\s*\.?\s*$")
#: A last line that is nothing but the marker of a list's next item; a figure alone is an answer.
_MARKER = re.compile(r"\n[^\S\n]*(?:(\d+)[.)]|[-*•–])\s*$")
_CLOSED = re.compile(r"[.!?。！？]['\"”’»)\]]*\s*$")
_HAN = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_PIECE = re.compile(rf"[{_HAN}]|[^\W{_HAN}]+(?:[-.'’:/][^\W{_HAN}]+)*|[^\w\s]")


def shape(word: str) -> str:
    """A word as the model sees it: figures and names are one kind each."""
    if word.isdigit() or re.fullmatch(r"[.:,/-]*\d[\d.:,/-]*", word):
        return "#"
    if any(c.isdigit() for c in word) or (word[:1].isupper() and not word.isupper()) or (len(word) > 1 and word.isupper()):
        return "N"
    return word.lower()


def ends_in_marker(text: str) -> bool:
    """Whether a list stops right after the marker of an item: a bullet, 1 under a colon, or the number after an item's."""
    m = _MARKER.search(text)
    if not m:
        return False
    if m[1] is None or (int(m[1]) == 1 and text[: m.start()].rstrip().endswith((":", "："))):
        return True
    return bool(re.search(rf"(?m)^[^\S\n]*{int(m[1]) - 1}[.)](?:\s+\S|[^\s\d])", text[: m.start()]))


def ends(text: str) -> tuple[list[str], bool]:
    """(shapes of the last three pieces before a final stop, whether there is one)."""
    bare = _TAIL_NOTE.sub(".", text) if _TAIL_NOTE.search(text) else text
    closed = bool(_CLOSED.search(bare))
    pieces = _PIECE.findall(bare)
    while pieces and pieces[-1] in ".!?。！？\"'”’»)]…":
        pieces.pop()
    return [shape(p) for p in pieces[-3:]], closed


def _features(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for key, text, question in zip(batch["pair"], batch["response"], batch["prompt"]):
                defect, tail, last, doubt = None, None, None, False
                if is_empty(text):
                    defect = "empty"
                elif copies(text, question):
                    defect = "copies_question"
                elif refuses(text):
                    defect = "refusal"
                elif question and other_language(model, text, question, known):
                    defect = "other_language"
                elif ends_in_marker(text):
                    defect = "truncated"
                else:
                    shapes, closed = ends(text)
                    words = _PIECE.findall(text)
                    if not closed and shapes:
                        if shapes[-1] in ",;:([{-–—&/、，；：（" or text.count("(") > text.count(")"):
                            defect = "truncated"
                        else:
                            doubt = sum(w[0].isalpha() and shape(w) not in "#N" for w in words) >= PLAIN_WORDS
                            tail, last = shapes, words[-1]
                out.append((key, defect, tail, last, doubt))
            yield pd.DataFrame(out, columns=["pair", "defect", "tail", "last_word", "doubt"])

    return run


def _grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, within a batch, of the n-grams of one to three shapes, and how often each ends a sentence."""
    for batch in batches:
        counts: dict[tuple[str, ...], list[int]] = {}
        for text in batch["response"]:
            pieces = [shape(p) if p[0].isalnum() or p[0] == "_" else p for p in _PIECE.findall(text or "")]
            for i, p in enumerate(pieces):
                nxt = pieces[i + 1] if i + 1 < len(pieces) else None
                if nxt is None or not (p[0].isalnum() or p == "#"):
                    continue  # the last word of a text is what is judged
                end = nxt in ".!?。！？"
                for n in (1, 2, 3):
                    if i + 1 >= n:
                        c = counts.setdefault(tuple(pieces[i + 1 - n : i + 1]), [0, 0])
                        c[0] += 1
                        c[1] += end
        yield pd.DataFrame([(" ".join(k), a, b) for k, (a, b) in counts.items()], columns=["gram", "n", "n_end"])


def pair_defects(pairs: DataFrame, labelled: dict[str, list[str]], contexts: DataFrame) -> DataFrame:
    """(record_id, defect) of each defective pair of `pairs` (record_id, prompt, response, context_id).

    `labelled` holds a bounded sample of texts by language, for the language model. `contexts`
    is (context_id, context), one row per id: text in which the full form of a name that a response
    ends with may stand, looked up for such responses only; it may be null or missing. Null
    responses are empty; a null prompt is neither copied nor in another language. A record_id that
    comes several times with equal texts is reported once; null record_ids are kept like any other.
    Equal pairs are judged once, so a pair that a third of all records share is one row of work.
    """
    key = F.md5(F.to_json(F.struct("prompt", "response"), {"ignoreNullFields": "false"}))
    keyed = pairs.select("record_id", key.alias("pair"), "prompt", "response", "context_id")
    records = materialise(keyed.select("record_id", "pair", "context_id").distinct())
    once = materialise(keyed.groupBy("pair").agg(F.first("prompt").alias("prompt"), F.first("response").alias("response")))
    shared = pairs.sparkSession.sparkContext.broadcast(fit(labelled, model=NaiveBayes))  # bounded by the sample
    features = materialise(once.select("pair", "prompt", "response").mapInPandas(_features(shared), "pair string, defect string, tail array<string>, last_word string, doubt boolean"))
    sure = features.where("defect IS NOT NULL").select("pair", "defect")
    open_ = features.where("doubt").select("pair", "tail", "last_word")
    # How words end sentences is counted over all responses and contexts.
    texts = once.select("response").union(contexts.select("context")).where("response IS NOT NULL").distinct()
    counts = materialise(texts.mapInPandas(_grams_of, "gram string, n bigint, n_end bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")))
    size = F.size("tail")
    grams = [F.concat_ws(" ", F.slice("tail", F.greatest(size - n + 1, F.lit(1)), F.lit(n))) for n in (1, 2, 3)]
    asked = open_.select("pair", F.posexplode(F.array_distinct(F.array(*grams))).alias("k", "gram"))
    of = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    # Pairs that end in a name or a figure share a gram, so the join is on a grid.
    met = grid_join(asked.select("pair", "k", "gram"), counts, "gram", "pair", "n")
    found = met.groupBy("pair").agg(*(of(c, k).alias(f"{c}_{k}") for k in range(3) for c in ("n", "n_end")))
    seen = open_.select("pair", "last_word").join(found, "pair", "left")
    likelihood = F.lit(END_PRIOR)
    for k in range(3):
        n, n_end = (F.coalesce(f"{c}_{k}", F.lit(0)) for c in ("n", "n_end"))
        likelihood = (n_end + END_WEIGHT * likelihood) / (n + END_WEIGHT)
    # Longer words that begin with a last word: those of a plain word that was cut are far more frequent.
    words = counts.where(~F.col("gram").contains(" ") & (F.length("gram") > 1)).select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("m"))
    longer = words.groupBy(F.substring("gram", F.lit(1), F.col("m")).alias("last")).agg(F.sum("n").alias("n_longer"))
    seen = seen.withColumn("last", F.lower("last_word")).join(longer, "last", "left")
    plain = F.regexp_like("last_word", F.lit(r"^\p{Ll}+$"))
    broken = plain & (F.col("n_longer") >= WHOLE_WORD) & (F.col("n_0") * WHOLE_WORD < F.col("n_longer"))
    # A word never met but at the end of a text, a broken one, or words that next to never end a sentence.
    unlikely = F.col("n_0").isNull() | F.coalesce(broken, F.lit(False)) | (likelihood < END_SHARE)
    judged = materialise(seen.select("pair", "last_word", unlikely.alias("unlikely")))
    cut = judged.where("unlikely").select("pair", F.lit("truncated").alias("defect"))
    # A name may be cut for one context and whole for another, so it is looked up in each of a pair's contexts.
    names = judged.where(~F.col("unlikely") & F.regexp_like("last_word", F.lit(_NAME))).select("pair", "last_word")
    asked_for = names.join(records.select("pair", "context_id").distinct(), "pair").join(once.select("pair", "prompt"), "pair")
    about = asked_for.join(contexts.select("context_id", "context"), "context_id", "left")
    cut_names = about.where(_is_cut_name(F.col("last_word"), F.concat_ws(" ", "prompt", "context"))).select(F.col("pair").alias("_pair"), F.col("context_id").alias("_c"))
    of_context = records.join(cut_names, (F.col("pair") == F.col("_pair")) & F.col("context_id").eqNullSafe(F.col("_c"))).select("record_id", F.lit("truncated").alias("defect"))
    return records.join(sure.union(cut), "pair").select("record_id", "defect").union(of_context).distinct()


#: What a last word must hold to be a name or a code.
_NAME = r"[\p{Lu}\p{N}]"


def _is_cut_name(word: Column, text: Column) -> Column:
    """Whether `text` knows a name or code only as the beginning of longer ones."""
    plain = F.regexp_replace(word, r"([^\p{L}\p{N}_])", r"\\$1")
    begins = F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_-])"), plain, F.lit(r"[\p{L}\p{N}_-]")))
    stands = F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_-])"), plain, F.lit(r"(?![\p{L}\p{N}_-])")))
    return F.coalesce(F.regexp_like(word, F.lit(_NAME)) & begins & ~stands, F.lit(False))
