"""Personal information in free text: a CRF over word shapes and detector marks, trained from a small labelled table."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.llm.address_parts import DIRECTION_OF, TYPE_OF, UNIT_OF
from geoweft.llm.crf import Crf
from geoweft.llm.pii_labels import labelled_table
from geoweft.session import cut, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Rows of the labelled table (the bound of the training sample) and its seed.
TRAINING_ROWS, SEED, EPOCHS = 7000, 11, 6
#: Least share of all words, and least number, from which on a word of the corpus is usual. At most 1 / WORD_SHARE words are.
WORD_SHARE, LEAST_SEEN = 2e-6, 3
#: Share of a word's occurrences that must stand beside words of a kind for its usage to say so.
MOSTLY = 0.3
#: Given names that may come to the driver as a feature; more raise an error.
MAX_GIVEN_NAMES = 200_000

# numbers, words of Latin, Greek or Cyrillic letters, and all else one by one: scripts without spaces have no words to see
_TOKEN = re.compile(r"\d+|(?:[A-Za-zªºÀ-ÖØ-öø-ʯͰ-ҁҊ-ԯḀ-ỿ][̀-ͯ]*)+|\S")
# Lexicons of the features.
TITLES = frozenset("mr mrs ms dr prof herr frau mme m sr sra señor señora don doña pan pani monsieur madame miss".split())
PARTICLES = frozenset("van der den de la dé lá al von du da di le el bin ibn".split())
STREET_WORDS = frozenset("rue place boulevard avenue allée quai chemin route calle avenida plaza paseo camino c carrer straße strasse str weg platz allee gasse ring ulica ul aleja plac".split())
ID_WORDS = frozenset("ssn social security passport licence license dl tax national id identity card citizen personal travel document driver number no".split())
PHONE_WORDS = frozenset("phone tel telefon telefono teléfono fax call mobile line number appeler 電話".split())
TRADES = frozenset("apartments auto bakery bank bar barber books bookstore brake brewery burger cafe car care catering center centre child church cinema clinic clothing club co coffee college community construction credit ctr dental dentist diner drug electronics elem elementary eye farm fire fitness florist flowers foods fuel furniture garage garden gmbh grill grocery group gym hair hardware heating hospital hotel inc inn insurance kitchen laundry law library llc ltd market mart medical mobile motors museum nail office offices optics paints pet pharmacy pizza plumbing pub public realty repair restaurant roofing salon school service shoes shop sons spa sports station storage store studio supply tavern taxi tire tours toys travel union university vet veterinary winery".split())
FOREIGN_TRADES = frozenset("café château bistró bistro pâtisserie boulangerie taquería panadería bäckerei gasthof konditorei trattoria osteria pizzeria hôtel librería farmacia apotheke brauhaus kawiarnia sklep phở crème".split())
GERMAN = re.compile(r"(?:straße|strasse|str|weg|platz|allee|gasse)$")

_NAME = r"(?:[^\W\d_]|[’'](?=[^\W\d_])|-(?=[^\W\d_]))+"
_NUM = r"\d{1,5}[A-Za-z]?(?:\s?1/2)?"
_TYPES = "|".join(sorted(TYPE_OF, key=len, reverse=True))
_DIRS = "|".join(sorted(DIRECTION_OF, key=len, reverse=True))
_UNIT = r"(?:,?\s+(?:apt|apartment|unit|suite|ste|room|rm)\b\.?\s*#?\s*\w{1,4}\b|,?\s*#\s?\d+\w?\b)"
_DIGIT = r"[0-9０-９]"
_LOCAL = r"(?<![a-z0-9.+\-_])[a-z0-9ß-öø-ÿ][a-z0-9ß-öø-ÿ.+\-_'’]*"
_LABEL = r"[a-z0-9ß-öø-ÿ](?:[a-z0-9ß-öø-ÿ\-]*[a-z0-9ß-öø-ÿ])?"
_SEP = r"[\s.\-‐‑–]?"
#: Detectors: patterns that mark the tokens of a stretch of text. They decide nothing; their marks are features.
DETECTORS = {
    "mail": re.compile(rf"{_LOCAL}\s?@\s?{_LABEL}(?:\.{_LABEL})*\.[a-z]{{2,}}(?![a-z0-9])", re.I),
    "mail_words": re.compile(rf"{_LOCAL}\s?(?:\[at\]|\(at\)|\{{at\}}|\bat\b)\s?{_LABEL}(?:(?:\s?(?:\[dot\]|\(dot\)|\{{dot\}}|\bdot\b)\s?|\.){_LABEL})+", re.I),
    "phone_plus": re.compile(rf"[+＋]{_DIGIT}{{1,3}}(?:{_SEP}[(（]?{_DIGIT}{{1,5}}[)）]?){{1,6}}"),
    "phone_brackets": re.compile(rf"(?<!\w)(?:{_DIGIT}{_SEP})?[(（]{_DIGIT}{{2,5}}[)）]{_SEP}{_DIGIT}{{3,5}}(?:{_SEP}{_DIGIT}{{3,5}})?"),
    "phone_zero": re.compile(rf"(?<![\w.\-/])(?:[0０]{_DIGIT}{{1,4}}(?:{_SEP}{_DIGIT}{{2,5}}){{1,5}})(?![\w/\-])"),
    "phone_us": re.compile(rf"(?<![\w.\-/])(?:{_DIGIT}{{3}}{_SEP})?{_DIGIT}{{3}}{_SEP}{_DIGIT}{{4}}(?![\w\-/])"),
    "ssn": re.compile(r"(?<![\w\-])\d{3}([ \-]?)\d{2}\1\d{4}(?![\w\-])"),
    "licence": re.compile(r"(?<![\w\-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w\-])"),
    "passport": re.compile(r"(?<![\w\-@])[A-Z]{1,2}\d{7,8}(?![\w\-@])"),
    "id_slash": re.compile(r"(?<![\w\-/.])\d{6}/\d{3,4}(?![\w/])"),
    "id_check": re.compile(r"(?<![\w\-.])\d{1,2}\.?\d{3}\.?\d{3}-[A-Z](?!\w)"),
    "id_blocks": re.compile(r"(?<![\w\-.])\d{4} \d{4} \d{4}(?![\w\-])"),
    "begin": re.compile(r"(?:^|[.!?:;]\s+|[|/\t–—…]\s*)([\w(\"]+)"),
    "stop": re.compile(r"(?<=[^\W_]{2})[.!?](?=\s|$)"),
    "parcel": re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{3}(?![\w\-])"),
    "ticket": re.compile(r"(?<!\w)[A-Z]{3}-\d{3,6}(?!\w)"),
    "uuid": re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I),
    "element": re.compile(r"(?<!\w)[nwr]\d{5,}(?:@\d+)?(?!\w)"),
    "date": re.compile(r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w])"),
    "nick": re.compile(r"(?m)^\s*\[\d\d:\d\d\] \w+:"),
    "us_address": re.compile(rf"(?<![\w.\-#/@])(?:no\.?\s+)?{_NUM}\s+(?:(?:{_DIRS})\b\.?\s+)?(?:[^\W\d_][\w’']*|\d{{1,3}}(?:st|nd|rd|th))(?:\s+[^\W\d_][\w’']*){{0,2}}?\s+(?:{_TYPES})\b(?!\s+(?:street|st)\b)(?:\.(?=\s*,?\s*(?:apt|unit|suite|ste|#)))?{_UNIT}?", re.I),
    "de_address": re.compile(r"(?<!\w)(?-i:[AI]m\s+|An der\s+)?[^\W\d_]+(?:straße|strasse|str\.?|weg|platz|allee|gasse)\s+\d{1,4}\s?[a-z]?(?!\w)", re.I),
    "fr_address": re.compile(r"(?<![\w.\-])\d{1,4}(?:\s(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|allée|quai|chemin)\s+(?:(?:du|de|des)\s+(?:la\s+)?|de l[’'])?[^\W\d_][\w’'\-]*", re.I),
    "es_address": re.compile(r"(?<!\w)(?:calle|avenida|plaza|paseo|c/)\s*(?:(?:de|del)\s+(?:la\s+)?)?[^\W\d_][\w’'\-]*,?\s+(?:n\.?º\s*)?\d{1,4}(?!\w)", re.I),
    "full_name": re.compile(rf"(?<![\w’'@.\-])[^\W\d_a-zß-öø-ÿ]{_NAME}\s+(?:[^\W\d_]\.\s*)?(?:(?:van\s+der|van|de\s+la|d[eé]\s+l[aá]|von|al)[\s\-]+)?(?:[^\W\d_a-zß-öø-ÿ]{_NAME})"),
    "initial_name": re.compile(rf"(?<![\w’'@.\-])[A-Z]\.\s*(?:(?:van\s+der|van|de\s+la|d[eé]\s+l[aá]|von|al)[\s\-]+)?[^\W\d_a-zß-öø-ÿ]{_NAME}"),
    "link": re.compile(r"\b(?:https?://|www\.)\S+", re.I),
    "hours": re.compile(r"\b\d{1,2}:\d\d(?::\d\d)?(?:-\d{1,2}:\d\d)?\b"),
    # found at every word, as the word before a name may look like a family name
    "last_first": re.compile(rf"(?<![\w’'@.\-])(?=((?:(?:van\s+der|van|de\s+la|d[eé]\s+l[aá]|von|al)[\s\-]+)?[^\W\d_a-zß-öø-ÿ]{_NAME},\s[^\W\d_a-zß-öø-ÿ]{_NAME}))"),
    "ten_digits": re.compile(r"(?<![\w.\-/@])[2-9]\d{2}[2-9]\d{6}(?![\w@])"),
}
# Scripts without spaces write next to numbers and Latin words, so only these are word characters at the ends of a stretch.
_W = "0-9A-Za-zÀ-ɏΑ-ωА-я_０-９"


def _bounded(pattern: re.Pattern) -> re.Pattern:
    text = pattern.pattern
    for ahead in ("(?<!", "(?!"):
        text = text.replace(ahead + "[\\w", ahead + "[" + _W).replace(ahead + "\\w)", f"{ahead}[{_W}])")
    return re.compile(text.replace(f"(?:{_TYPES})\\b", f"(?:{_TYPES})(?![{_W}])").replace("\\w{1,4}\\b", f"[{_W}]{{1,4}}(?![{_W}])").replace("\\d+\\w?\\b", f"\\d+[A-Za-z]?(?![{_W}])"), pattern.flags)


DETECTORS = {name: _bounded(pattern) for name, pattern in DETECTORS.items()}
# What a text must hold for a detector to match, in small letters; without i, k and s, which match more than their small letters.
_NEED = {
    "mail": ("@",), "mail_words": ("at",), "element": ("n", "w", "r"), "de_address": ("tr", "weg", "platz", "allee", "ga"), "fr_address": ("rue", "aven", "boulevard", "place", "allée", "qua", "chem"),
    "es_address": ("calle", "aven", "plaza", "pa", "c/"), "last_first": (",",), "initial_name": (".",),
}
_NEED_DIGITS = frozenset(DETECTORS) - {"mail", "mail_words", "full_name", "initial_name", "last_first", "begin", "stop", "uuid", "link"}


def may_match(name: str, low: str, digits: bool) -> bool:
    """False only if the detector can't match a text whose lower() is low and which has digits or not."""
    return (digits or name not in _NEED_DIGITS) and (name not in _NEED or any(n in low for n in _NEED[name]))


def tokenize(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 6)}"
    if not w[0].isalpha():
        return "p" + w
    if len(w) == 1:
        return "X" if w.isupper() else "x"
    if w.isupper():
        return "XX"
    if w[0].isupper():
        return "Xx" if w[1:].islower() else "XxX"
    return "xx" if w.islower() else "xX"


def usage(n: int, small: int, after_given: int, before_type: int, before_trade: int, before_family: int) -> tuple[str, ...]:
    """What the corpus says of a word: how it is mostly written, and whether it mostly stands behind given
    names, before street types, before trades, or before words that stand behind given names."""
    out = ["u=small" if small >= 0.6 * n else "u=mixed" if small >= 0.1 * n else "u=capital"]
    out += ["u=" + name for name, k in (("family", after_given), ("street", before_type), ("trade", before_trade), ("given", before_family)) if k >= MOSTLY * n]
    return tuple(out)


#: Tokens of the counts of usage: words, and other characters one by one.
_USAGE_TOKEN = r"(\p{L}+|[^\s\p{L}])"


def usual_words(documents: DataFrame, given: DataFrame) -> dict[str, tuple[str, ...]]:
    """The usage of each usual word of all texts. Words and their neighbours are counted over the whole corpus; only words with
    a share of at least WORD_SHARE come to the driver, so at most 1 / WORD_SHARE."""
    tokens = documents.select(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(_USAGE_TOKEN), F.lit(1)), F.array(F.lit(""))).alias("t"))
    each = F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda i: F.struct(F.get("t", i - 1).alias("before"), F.get("t", i).alias("w"), F.get("t", i + 1).alias("after")))
    words = tokens.where(F.size("t") > 2).select(F.explode(each).alias("e")).select("e.*").where(F.col("w").rlike(r"^\p{L}"))
    words = words.select(F.lower("w").alias("word"), (F.col("w") == F.lower("w")).cast("long").alias("small"), F.lower("before").alias("before"), F.lower("after").alias("after"))
    names = given.where("given_name is not null").select(F.lower(F.trim("given_name")).alias("before"), F.lit(1).alias("g")).distinct()
    # neighbours that say something are few, so pairs are counted first
    pairs = words.groupBy("word", "before", "after").agg(F.count("*").alias("n"), F.sum("small").alias("small")).join(names, "before", "left")
    pairs = cut(pairs)
    capital = F.col("n") - F.col("small")
    told = lambda when: F.sum(F.when(when, capital).otherwise(0))
    counted = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("small").alias("small"), told(F.col("g") == 1).alias("after_given"), told(F.col("after").isin(sorted(TYPE_OF))).alias("before_type"), told(F.col("after").isin(sorted(TRADES))).alias("before_trade"))
    counted = cut(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    usual = counted.where((F.col("n") >= LEAST_SEEN) & (F.col("n") >= WORD_SHARE * total))
    family = usual.where(F.col("after_given") >= MOSTLY * F.col("n")).select(F.col("word").alias("after"))
    before = pairs.join(family, "after", "left_semi").groupBy("word").agg(F.sum(capital).alias("before_family"))
    rows = usual.join(before, "word", "left").collect()
    return {r.word: usage(r.n, r.small, r.after_given, r.before_type, r.before_trade, r.before_family or 0) for r in rows}


def _usual_in(texts: list[str], given: frozenset[str]) -> dict[str, tuple[str, ...]]:
    """usual_words of a list of texts."""
    counts: dict[str, list[int]] = {}
    capitals: Counter = Counter()
    for text in texts:
        tokens = ["", *regex.findall(_USAGE_TOKEN, text), ""]
        for before, w, after in zip(tokens, tokens[1:], tokens[2:], strict=False):
            if w[:1].isalpha():
                low, small, before, after = w.lower(), w == w.lower(), before.lower(), after.lower()
                c = counts.setdefault(low, [0, 0, 0, 0, 0])
                c[0] += 1
                c[1] += small
                if not small:
                    capitals[low, after] += 1
                    c[2] += before in given
                    c[3] += after in TYPE_OF
                    c[4] += after in TRADES
    total = sum(c[0] for c in counts.values())
    usual = {w: c for w, c in counts.items() if c[0] >= LEAST_SEEN and c[0] >= WORD_SHARE * total}
    family = {w for w, c in usual.items() if c[2] >= MOSTLY * c[0]}
    before_family: Counter = Counter()
    for (w, after), n in capitals.items():
        if after in family:
            before_family[w] += n
    return {w: usage(*c, before_family[w]) for w, c in usual.items()}


def word_features(given: frozenset[str], usual: dict[str, tuple[str, ...]]):
    """Features of a word by itself. usual: usage of the usual words of the corpus."""

    @lru_cache(200_000)
    def features(w: str) -> tuple[str, ...]:
        low = w.lower()
        shape = _shape(w)
        out = ["b", "s=" + shape]
        if w[0].isalpha():
            known = usual.get(low, ("u=rare",))
            out += ["w=" + low, "e=" + low[-3:], "a=" + low[:3], "l=" + str(min(len(w), 10)), *known, *[f"{k} {shape}" for k in known]]
            for name, lexicon in (("given", given), ("title", TITLES), ("particle", PARTICLES), ("type", TYPE_OF), ("direction", DIRECTION_OF), ("unit", UNIT_OF), ("street", STREET_WORDS), ("idword", ID_WORDS), ("phoneword", PHONE_WORDS), ("trade", TRADES), ("trade abroad", FOREIGN_TRADES)):
                if low in lexicon:
                    out.append("in=" + name)
                    if name in ("given", "trade"):
                        out.append(f"in={name} {known[0]} {shape}")
            if GERMAN.search(low) and len(low) > 5:
                out.append("in=german")
        elif w.isdigit() and len(w) <= 4:
            out.append("n=" + (w if len(w) <= 2 else w[:1]))
        return tuple(out)

    return features


def detector_marks(text: str, tokens: list[tuple[str, int, int]]) -> list[tuple[str, ...]]:
    """Per token the marks of the detectors whose stretches hold it: begin, inside or last."""
    marks: list[list[str]] = [[] for _ in tokens]
    starts = [s for _, s, _ in tokens]
    digits, low = any(c.isdigit() for c in text), text.lower()
    for name, pattern in DETECTORS.items():
        if not may_match(name, low, digits):
            continue
        for m in pattern.finditer(text):
            begin, end = m.span(m.lastindex or 0) if name in ("last_first", "begin") else m.span()
            lo, hi = bisect_left(starts, begin), bisect_left(starts, end)
            for i in range(lo, hi):
                marks[i].append(f"{name}:B" if i == lo else f"{name}:I")
            if hi > lo:
                marks[hi - 1].append(f"{name}:E")
    for i, (word, _, _) in enumerate(tokens):
        kind = "street_name" if word.lower() in TYPE_OF else "trade_name" if word.lower() in TRADES else None
        if kind:  # up to three words with a capital, or an ordinal number, before a street type or a trade
            first = i
            while first > 0 and i - first < 3 and (tokens[first - 1][0][0].isupper() or tokens[first - 1][0] in ("&", "and") or (tokens[first - 1][0].isdigit() and tokens[first - 1][2] == tokens[first][1])):
                first -= 1
            for j in range(first, i + 1):
                marks[j].append(f"{kind}:{'B' if j == first else 'I'}")
            marks[i].append(f"{kind}:E")
    return [tuple(m) for m in marks]


@lru_cache(2)
def trained(given: frozenset[str], rows: int = TRAINING_ROWS, seed: int = SEED, held: bool | None = None) -> Crf:
    """The model, trained from the labelled table (or from the part that isn't held out); the same weights for the same arguments."""
    sentences, table = [], labelled_table(sorted(given), rows, seed, held)
    for text, spans in table:
        tokens = tokenize(text)
        labels = []
        for _, s, e in tokens:
            inside = next(((k, a) for k, a, b in spans if a <= s and e <= b), None)
            labels.append(0 if inside is None else LABELS.index(("B-" if s == inside[1] else "I-") + inside[0]))
        sentences.append(([w for w, _, _ in tokens], detector_marks(text, tokens), labels))
    usual = _usual_in([t for t, _ in table], given)
    # half of the sentences know the usage of half of the words, as a corpus of another size does
    some = random.Random(seed)
    fewer = {w: u for w, u in usual.items() if some.random() < 0.5}
    crf = Crf(LABELS, word_features(given, usual)).fit(sentences, epochs=EPOCHS, other_features=word_features(given, fewer))
    crf.usual = usual
    return crf


def fitted(model: Crf, given: frozenset[str], usual: dict[str, tuple[str, ...]]) -> Crf:
    """The model with the words of a corpus: what the corpus says of its usual words goes before what the labelled table says."""
    crf = Crf(LABELS, word_features(given, model.usual | usual))
    crf.index, crf.weights, crf.transitions, crf.start = model.index, model.weights, model.transitions, model.start
    return crf


_LINE = re.compile(r"[^\n\r]+")


def find(model: Crf, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every place of each text, in code points. Lines are decoded apart, whole texts line by line, and
    equal lines once."""
    lines: dict[str, list[tuple[int, int]]] = {}
    for i, text in enumerate(texts):
        for m in _LINE.finditer(text or ""):
            lines.setdefault(m.group(), []).append((i, m.start()))
    tokenized = [(where, tokens, text) for text, where in lines.items() if (tokens := tokenize(text))]
    sequences = [([w for w, _, _ in tokens], detector_marks(text, tokens)) for _, tokens, text in tokenized]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (where, tokens, _), path in zip(tokenized, model.decode(model.emissions(sequences)), strict=True):
        kind, start, end = None, 0, 0
        for (w, s, e), y in zip([*tokens, ("", -1, -1)], [*path, 0], strict=True):
            label = LABELS[y]
            if kind and label == "I-" + kind:
                end = e
                continue
            if kind:
                for i, at in where:
                    out[i].append((kind, at + start, at + end))
                kind = None
            if label != "O":
                kind, start, end = label[2:], s, e
    return [sorted(found, key=lambda f: f[1]) for found in out]


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pii_kind", T.StringType()), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType())])


def _given(names: DataFrame) -> frozenset[str]:
    rows = names.where("given_name is not null").select(F.lower(F.trim("given_name")).alias("g")).where("g != ''").distinct().limit(MAX_GIVEN_NAMES + 1).collect()
    if len(rows) > MAX_GIVEN_NAMES:
        raise ValueError(f"more than {MAX_GIVEN_NAMES} given names")
    return frozenset(r.g for r in rows)


def _broadcast_model(names: DataFrame, documents: DataFrame):
    """Trains on the driver and sends weights and usual words to the tasks: the labelled table and WORD_SHARE bound their size."""
    given = _given(names)
    model = trained(given)
    weights = (model.index, model.weights.astype(np.float32), model.transitions, model.start)
    return names.sparkSession.sparkContext.broadcast((given, model.usual | usual_words(documents, names), weights))


_restored: dict[int, Crf] = {}


def _restore(sent) -> Crf:
    """The model in a Python worker, built once from the broadcast weights."""
    key = sent.id if hasattr(sent, "id") else id(sent)
    if key not in _restored:
        given, usual, (index, weights, transitions, start) = sent.value
        crf = Crf(LABELS, word_features(given, usual))
        crf.index, crf.weights, crf.transitions, crf.start = index, weights.astype(float), transitions, start
        _restored.clear()
        _restored[key] = crf
    return _restored[key]


def pii_places(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, char_start, char_end), one row per place in a text.

    Null, empty and white texts hold none. Texts of any length are read whole. Rows of documents that share a doc_id are
    read one by one. An empty table of given names takes a feature away and nothing else.
    """
    sent = _broadcast_model(given_names, documents)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _restore(sent)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                rows = [(d, k, s, e) for d, found in zip(part["doc_id"], find(model, list(part["text"])), strict=True) for k, s, e in found]
                yield pd.DataFrame(rows, columns=["doc_id", "pii_kind", "char_start", "char_end"])

    return spread(documents.select("doc_id", "text").where(F.col("text").isNotNull())).mapInPandas(places, FOUND)


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda f: f[1]):
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """doc_id and the text with a typed placeholder for each place; null for null. All else stays as it is."""
    sent = _broadcast_model(given_names, documents)

    @F.pandas_udf(T.StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _restore(sent)
        for texts in batches:
            parts = []
            for lo in range(0, len(texts), 1000):
                some = list(texts.iloc[lo : lo + 1000])
                parts += [redact(t, f) for t, f in zip(some, find(model, some), strict=True)]
            yield pd.Series(parts, dtype=object)

    return spread(documents.select("doc_id", "text")).select("doc_id", clean("text").alias("text"))
