"""Languages of documents and of the stretches of mixed ones.

Each language has an interpolated Kneser-Ney model of characters within words, smoothed from five
characters down. The models of all languages share one sorted array of n-gram keys per order, with a
row of log probabilities per key, so one search scores a character under every language. A text's
language is the one of lowest cross-entropy per character; a text whose cross-entropy lies beyond
what held-out texts of the language show is rejected as "und". Confidence is a posterior whose
temperature is fitted on held-out sentences.

The models are fitted on a bounded sample of labelled documents: at most `SAMPLE_DOCUMENTS` of each
language, and of these at most `SAMPLE_CHARS` characters. Everything else covers whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCUMENTS = 400
SAMPLE_CHARS = 150_000
ORDER = 5
_BITS = 12
_MASK = (1 << _BITS) - 1
#: Nats that changing the language between two sentences costs.
SWITCH = 12.0
#: Nats by which a sentence must prefer its stretch's language to count as prose of it.
CLEAR = 3.0
#: Posterior temperatures that are tried: evidence of neighbouring characters is far from independent.
TEMPERATURES = tuple(2.0 ** (k / 2) for k in range(15))
#: A text is of none of the models' languages if its cross-entropy per character is so many nats beyond
#: the one that this share of held-out texts of the language stays within.
REJECT_SHARE, REJECT_SLACK = 0.99, 2.0
#: Sentences that a stretch of prose needs, and words that each of them needs.
SENTENCES, SENTENCE_WORDS = 2, 3
#: Han characters that count as a word: Chinese has no spaces, so a whole clause is one token.
HAN_WORD = 2

# Two-letter codes of ISO 639-1.
ISO_CODES = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
# Three-letter codes and names of the languages that are told apart.
LANGUAGE_NAMES = {
    "eng": "en", "english": "en",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castilian": "es",
    "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
    "ita": "it", "italian": "it", "italiano": "it",
    "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl", "flemish": "nl",
    "rus": "ru", "russian": "ru", "русский": "ru",
    "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "mandarin": "zh", "中文": "zh",
}
LANGUAGES = tuple(sorted(set(LANGUAGE_NAMES.values())))


def label_language(label: Column) -> Column:
    """Two-letter code that a label names in any spelling; null if it names no language."""
    plain = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)(?:[-_ (].*)?$", 1)
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.when(plain.isin(*sorted(ISO_CODES)), plain).otherwise(names[plain])


_TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=[\s\"'”’»)]|\Z)|[。！？]|[\r\n]+")
_LETTER = re.compile(r"[^\W\d_]")
_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]")
_PROSE = re.compile(r"[(\"'“„«¿¡]*[^\W\d_][^\W\d_'’-]*[,.;:!?)\"'”“»]*\Z")
_LOGGED = re.compile(r"\d:\d\d:\d\d|\w=\S")


def without_logs(text: str) -> str:
    """The text with lines blanked that are mostly codes, times and key=value pairs."""
    if not _LOGGED.search(text):
        return text
    out = []
    for line in re.split(r"(\r\n|\r|\n)", text):
        if _LOGGED.search(line):
            parts = line.split()
            if sum(bool(_PROSE.match(p)) for p in parts) * 2 < len(parts):
                line = " " * len(line)
        out.append(line)
    return "".join(out)


class Alphabet:
    """Numbers of the characters that models know: 0 is the word boundary, 1 any other character."""

    def __init__(self, texts: Iterable[str]):
        seen: dict[str, int] = {}
        for t in texts:
            for c in t:
                seen[c] = seen.get(c, 0) + 1
        kept = sorted(seen, key=lambda c: (-seen[c], c))[: _MASK - 2]
        self.size = len(kept) + 2
        self.table = np.ones(0x110000, np.uint16)
        self.table[[ord(c) for c in kept]] = np.arange(2, self.size)
        self.table[ord(" ")] = 0

    def ids(self, words: Iterable[str]) -> np.ndarray:
        """Words with a boundary before, between and after them."""
        return self.table[np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)].astype(np.int64)


def _grams(ids: np.ndarray, order: int, places: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams within words, and if wanted where they start; a boundary stands at an n-gram's first or last place only."""
    n = len(ids) - order + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 if places else np.zeros(0, np.int64)
    key, inner = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(order):
        x = ids[k : k + n]
        key = (key << _BITS) | x
        if 0 < k < order - 1:
            inner &= x > 0
    if order > 1:
        inner &= ~((ids[:n] == 0) & (ids[order - 1 :] == 0)) | (order > 2)
    else:
        inner[0] = False  # the boundary before the first word is given, not drawn
    if places:
        # A single character is placed in its word; the boundary after a word, at its last character.
        at = np.flatnonzero(inner)
        return key[inner], np.maximum(at - 1, 0) if order == 1 else np.minimum(at, len(ids) - 2)
    return key[inner]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class KneserNey:
    """Character models of several languages over shared sorted keys."""

    def __init__(self, words: dict[str, list[str]]):
        self.languages = sorted(words)
        self.alphabet = Alphabet(w for ws in words.values() for w in ws)
        counts = {x: [np.unique(_grams(self.alphabet.ids(words[x]), n), return_counts=True) for n in range(1, ORDER + 1)] for x in self.languages}
        m = len(self.languages)
        floor = np.full(m, -np.log(self.alphabet.size))
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([counts[x][n - 1][0] for x in self.languages]))
            contexts = np.unique(keys >> _BITS)
            weight = np.zeros((len(contexts), m))
            own = np.zeros((len(keys), m))  # discounted share of the n-gram itself
            for j, x in enumerate(self.languages):
                key, count = counts[x][n - 1]
                if not len(key):
                    continue
                adjusted = count.astype(float)
                if n < ORDER:  # in how many contexts it occurs, but for n-grams that begin a word
                    longer, several = np.unique(counts[x][n][0] & ((1 << _BITS * n) - 1), return_counts=True)
                    at, ok = _find(longer, key)
                    adjusted = np.where(ok & ((key >> _BITS * (n - 1)) > 0), several[at] if len(longer) else 0, adjusted)
                ones, twos = (adjusted == 1).sum(), (adjusted == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                context, start = np.unique(key >> _BITS, return_index=True)
                total = np.add.reduceat(adjusted, start)
                kinds = np.diff(np.append(start, len(key)))
                at, _ = _find(contexts, context)
                weight[at, j] = np.log(discount * kinds / total)
                of = np.repeat(np.arange(len(context)), kinds)
                at, _ = _find(keys, key)
                own[at, j] = np.maximum(adjusted - discount, 0) / total[of]
            at, _ = _find(contexts, keys >> _BITS)
            if n == 1:
                lower = np.broadcast_to(floor, own.shape)
            else:
                below, _ = _find(self.keys[-1], keys & ((1 << _BITS * (n - 1)) - 1))
                lower = self.logp[-1][below].astype(float)
            self.keys.append(keys)
            self.logp.append(np.log(own + np.exp(weight[at] + lower)).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(weight.astype(np.float32))
        self.floor = floor.astype(np.float32)
        self.reject = np.full(m, np.inf)  # highest cross-entropy of a text of each language
        self.temperature = 1.0

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word under each language, characters drawn: its own and its end)."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        if not len(words):
            return np.zeros((0, len(self.languages)), np.float32), sizes
        ids = self.alphabet.ids(words)
        start = np.cumsum(sizes) - sizes  # place of the boundary before each word
        place = np.arange(1, len(ids))
        most = np.minimum(ORDER, place - np.repeat(start, sizes) + 1)
        key = np.zeros(len(place), np.int64)
        for k in range(ORDER - 1, -1, -1):
            back = np.maximum(place - k, 0)
            key = (key << _BITS) | np.where(k < most, ids[back], 0)
        out = np.zeros((len(place), len(self.languages)), np.float32)
        todo = np.arange(len(place))
        for n in range(ORDER, 0, -1):
            able = most[todo] >= n
            here = todo[able]
            k = key[here] & ((1 << _BITS * n) - 1)
            at, ok = _find(self.keys[n - 1], k)
            out[here[ok]] += self.logp[n - 1][at[ok]]
            missed, k = here[~ok], k[~ok]
            at, known = _find(self.contexts[n - 1], k >> _BITS)
            out[missed[known]] += self.backoff[n - 1][at[known]]
            todo = np.concatenate([todo[~able], missed])
        out[todo] += self.floor
        return np.add.reduceat(out, start, axis=0), sizes


def _words(texts: list[str]) -> list[list[str]]:
    return [[t.lower() for t in _TOKEN.findall(without_logs(x)) if _LETTER.match(t)] for x in texts]


def _unseen_best(parts: dict[str, list[list[list[str]]]], model: Callable) -> dict[str, list[np.ndarray]]:
    """Scores of each text's sentences under models that were fitted without that text.

    Two folds by turns; a model that has seen a wrongly labelled text would explain it well.
    """
    folds = [model({x: [w for t in texts[k::2] for s in t for w in s] or ["-"] for x, texts in parts.items()}) for k in (0, 1)]
    out = {}
    for x, texts in parts.items():
        out[x] = [np.zeros((0, len(parts)))] * len(texts)
        for k in (0, 1):
            own = texts[k::2]
            flat = [w for t in own for s in t for w in s]
            if not flat:
                continue
            score, _ = folds[1 - k].scores(flat)
            sizes = np.array([len(s) for t in own for s in t])
            per = np.add.reduceat(score, np.cumsum(sizes) - sizes, axis=0)
            at = np.cumsum([0, *(len(t) for t in own)])
            for n, (i, j) in enumerate(zip(at[:-1], at[1:])):
                out[x][2 * n + k] = per[i:j]
    return out


def fit(sample: dict[str, list[str]], rounds: int = 3, model: Callable = KneserNey) -> KneserNey:
    """Models of labelled texts, some of them wrongly labelled or mixed.

    Texts, and in the last round sentences, that another language's models explain better are left
    out; both are judged by models that have not seen them.
    """
    parts: dict[str, list[list[list[str]]]] = {}
    for language, texts in sample.items():
        own, chars = [], 0
        for x in texts:
            if chars > SAMPLE_CHARS:
                break
            if t := [w for s in re.split(r"(?<=[.!?。！？])|[\r\n]+", without_logs(x)) if (w := _words([s])[0])]:
                own.append(t)
                chars += len(x)
        if own:
            parts[language] = own
    for r in range(rounds):
        scores = _unseen_best(parts, model)
        for j, x in enumerate(sorted(parts)):
            if r < rounds - 1:
                kept = [t for t, s in zip(parts[x], scores[x]) if s.sum(axis=0).argmax() == j]
            else:
                kept = [k for t, s in zip(parts[x], scores[x]) if (k := [w for w, b in zip(t, s.argmax(axis=1)) if b == j])]
            parts[x] = kept or parts[x]
    made = model({x: [w for t in texts for s in t for w in s] for x, texts in parts.items()})
    _calibrate(made, parts, _unseen_best(parts, model))
    return made


def _calibrate(made: KneserNey, parts: dict[str, list[list[list[str]]]], scores: dict[str, list[np.ndarray]]) -> None:
    """Sets a model's rejection and temperature by the scores of texts under models that have not seen them."""
    losses = np.zeros(len(TEMPERATURES))
    for j, x in enumerate(sorted(parts)):
        chars = [sum(len(w) + 1 for s in t for w in s) for t in parts[x]]
        beyond = [-s.max(axis=1).sum() / n for s, n in zip(scores[x], chars) if len(s)]
        if beyond:
            made.reject[j] = np.quantile(beyond, REJECT_SHARE) + REJECT_SLACK
        each = np.concatenate([s for s in scores[x] if len(s)] or [np.zeros((0, len(parts)))]).astype(float)
        for k, t in enumerate(TEMPERATURES):
            z = (each - each.max(axis=1, keepdims=True, initial=-np.inf)) / t
            losses[k] += (np.log(np.exp(z).sum(axis=1)) - z[:, j]).sum() / max(1, len(each))
    made.temperature = TEMPERATURES[int(losses.argmin())]


def _least(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The `most` least different hashes of each language in a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, own in batch.groupby("language")["h"]:
                held[language] = np.unique(np.concatenate([held.get(language, np.zeros(0, np.int64)), own.to_numpy()]))[:most]
        for language, own in held.items():
            yield pd.DataFrame({"language": language, "h": own})

    return run


def sample_texts(documents: DataFrame, per_language: int = SAMPLE_DOCUMENTS) -> dict[str, list[str]]:
    """At most `per_language` different documents of each language, by label, in an order of hashes.

    Hashes are chosen first, within every partition before anything moves; whole texts are read for
    the chosen ones only.
    """
    named = documents.where("text IS NOT NULL").select("text", label_language(F.col("lang")).alias("language")).where(F.col("language").isin(*LANGUAGES)).withColumn("h", F.xxhash64("text"))
    least = named.select("language", "h").mapInPandas(_least(per_language), "language string, h bigint").distinct()
    first = F.row_number().over(Window.partitionBy("language").orderBy("h"))
    last = {r.language: r.h for r in least.withColumn("r", first).where(F.col("r") <= per_language).groupBy("language").agg(F.max("h").alias("h")).collect()}
    if not last:
        return {}
    limits = F.create_map(*(F.lit(x) for pair in sorted(last.items()) for x in pair))
    out: dict[str, list[tuple[int, str]]] = {}
    for r in named.where(F.col("h") <= limits[F.col("language")]).dropDuplicates(["language", "h"]).toLocalIterator():
        out.setdefault(r.language, []).append((r.h, r.text))
    return {x: [t for _, t in sorted(rows)] for x, rows in sorted(out.items())}


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each sentence of the likeliest sequence."""
    n, m = scores.shape
    back = np.zeros((n, m), np.int32)
    at = scores[0].astype(float)
    for i in range(1, n):
        best = int(at.argmax())
        stay = at >= at[best] - switch
        back[i] = np.where(stay, np.arange(m), best)
        at = np.where(stay, at, at[best] - switch) + scores[i]
    path = np.zeros(n, np.int32)
    path[-1] = at.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def posterior(scores: np.ndarray, temperature: float) -> np.ndarray:
    x = (scores - scores.max()) / temperature
    p = np.exp(x)
    return p / p.sum()


_SEGMENT = "struct<start:int,end:int,lang:string,confidence:double,sentences:int>"
LABELLED_SCHEMA = f"doc_id bigint, label_lang string, lang string, confidence double, mixed array<string>, segments array<{_SEGMENT}>"


def _stretches(text: str, scores: np.ndarray, lengths: np.ndarray, languages: list[str], temperature: float) -> tuple[list[dict], list[str]]:
    """Segments of a text, whose sentences have `lengths` words, and the languages that it holds at least `SENTENCES` sentences of prose in."""
    path = viterbi(scores)
    spans = _sentence_spans(text)
    segments, prose = [], {}
    edge = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(path)]):
        j = path[a]
        others = np.delete(scores[a:b], j, axis=1).max(axis=1, initial=-np.inf)
        n = int(((scores[a:b, j] - others > CLEAR) & (lengths[a:b] >= SENTENCE_WORDS)).sum())
        segments.append({"start": spans[a][0], "end": spans[b - 1][1], "lang": languages[j], "confidence": float(posterior(scores[a:b].sum(axis=0), temperature)[j]), "sentences": n})
        if n >= SENTENCES:
            prose[j] = True
    return segments, [languages[j] for j in sorted(prose)]


def _length(word: str) -> int:
    """Words that a token counts as: one, but for Han characters one for each `HAN_WORD` of them."""
    han = len(_HAN.findall(word))
    return -(-han // HAN_WORD) + (han < len(word))


def _sentences(tokens: list[str]) -> tuple[list[str], list[int]]:
    """(words, words per sentence) of a token sequence; sentences without words don't count."""
    words, sizes, n = [], [], 0
    for t in tokens:
        if _LETTER.match(t):
            words.append(t)
            n += 1
        elif n:
            sizes.append(n)
            n = 0
    if n:
        sizes.append(n)
    return words, sizes


def _sentence_spans(text: str) -> list[tuple[int, int]]:
    spans, first, last = [], None, 0
    for m in _TOKEN.finditer(without_logs(text)):
        if _LETTER.match(m[0]):
            first = m.start() if first is None else first
            last = m.end()
        elif first is not None:
            spans.append((first, m.end() if m[0] not in "\r\n" else last))
            first = None
    if first is not None:
        spans.append((first, last))
    return spans


def label_texts(model: KneserNey, texts: list[str]) -> list[tuple]:
    """(language, confidence, languages of a mixed text, segments) of each text."""
    split = [_sentences(_TOKEN.findall(without_logs(t))) for t in texts]
    flat = [w.lower() for words, _ in split for w in words]
    codes, kinds = pd.factorize(np.array(flat, object))
    by_kind, drawn = model.scores([w.replace(" ", "") for w in kinds])
    sizes = np.array([n for _, ns in split for n in ns], np.int64)
    start = np.cumsum(sizes) - sizes
    scores = np.add.reduceat(by_kind[codes], start, axis=0) if len(sizes) else np.zeros((0, len(model.languages)), np.float32)
    chars = np.add.reduceat(drawn[codes], start) if len(sizes) else sizes
    lengths = np.add.reduceat(np.array([_length(w) for w in kinds], np.int64)[codes], start) if len(sizes) else sizes
    per_text = np.array([len(ns) for _, ns in split], np.int64)
    upto = np.cumsum(per_text)
    best = scores.argmax(axis=1) if len(scores) else sizes
    out = []
    for text, n, end in zip(texts, per_text.tolist(), upto.tolist()):
        if not n:
            out.append(("und", 0.0, [], []))
            continue
        own = scores[end - n : end]
        total = own.sum(axis=0)
        j = int(total.argmax())
        if -own.max(axis=1).sum() > model.reject[j] * chars[end - n : end].sum():
            out.append(("und", 0.0, [], []))
            continue
        segments, prose = [], []
        if n > 1 and (best[end - n : end] != best[end - n]).any():
            segments, prose = _stretches(text, own, lengths[end - n : end], model.languages, model.temperature)
        language, sure = model.languages[j], float(posterior(total, model.temperature)[j])
        if len(prose) > 1:
            out.append((language, sure, prose, segments))
        else:
            out.append((language, sure, [], [{"start": 0, "end": len(text), "lang": language, "confidence": sure, "sentences": n}]))
    return out


def _labeller(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                got = label_texts(model, [t or "" for t in part["text"]])
                lang, sure, mixed, segments = zip(*got) if got else ((), (), (), ())
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "label_lang": part["label_lang"].array, "lang": lang, "confidence": sure, "mixed": mixed, "segments": segments})

    return run


def label_documents(documents: DataFrame, model: KneserNey) -> DataFrame:
    """Every document's language with a confidence, and its segments.

    `mixed` names the languages of a text that holds at least two sentences of prose in each of
    several; its segments are the stretches, with offsets in the text. Any other text is one
    segment. Log lines are no prose. Null, empty and wordless texts, and such that no model
    explains, come out as "und" with confidence 0 and no segments. Repeated rows come out as often
    as they stand. `label_lang` is the two-letter code that the label names, or null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    rows = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label_lang"))
    return rows.mapInPandas(_labeller(shared), LABELLED_SCHEMA)


def wrong_labels(labelled: DataFrame) -> DataFrame:
    """(doc_id, kind, lang): mixed texts, one row per language; else missing and wrong labels."""
    known = F.col("lang") != "und"
    kind = F.when(F.size("mixed") > 1, "mixed").when(known & F.col("label_lang").isNull(), "missing").when(known & (F.col("label_lang") != F.col("lang")), "wrong")
    named = labelled.select("doc_id", kind.alias("kind"), F.when(F.size("mixed") > 1, F.col("mixed")).otherwise(F.array("lang")).alias("langs")).where("kind IS NOT NULL")
    return named.select("doc_id", "kind", F.explode("langs").alias("lang"))
