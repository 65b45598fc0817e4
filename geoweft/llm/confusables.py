"""Text that looks alike but differs in its characters: skeletons, plain forms and groups of equal skeleton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters and their Latin prototypes, by script, in the order of the prototypes.
LOOKALIKES = {
    "CYRILLIC": {
        "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
        "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    },
    "GREEK": {
        "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
        "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ω": "w", "χ": "x", "γ": "y",
    },
    "ARMENIAN": {"Տ": "S", "Օ": "O", "Ս": "U", "Լ": "L", "ց": "g", "հ": "h", "ո": "n", "օ": "o", "զ": "q", "ս": "u"},
    "CHEROKEE": {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭵ": "i", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"},
    "LATIN": {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ʏ": "y", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z"},
}
# Invisible characters that are no format characters of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵⠀ㅤﾠ"

_INVISIBLE = frozenset(INVISIBLE)
#: Text of these characters alone is in plain form; it isn't sent to Python.
PLAIN_PATTERN = r"^[\x20-\x7e]*$"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SMALL_CAPITAL = re.compile(r"LATIN LETTER SMALL CAPITAL ([A-Z])$")


def _hidden(c: str) -> bool:
    return c in _INVISIBLE or unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"


def public_prototypes(spark: SparkSession) -> dict[str, str]:
    """Character -> prototype of the public Unicode table of confusable characters, from the ICU library that comes with Spark;
    a prototype may have several characters. Only characters that aren't their own prototype."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    every = [chr(i) for i in range(0x21, 0x110000) if unicodedata.category(chr(i))[0] in "LNPSM" and not 0xAC00 <= i <= 0xD7A3]
    skeletons = checker.getSkeleton("\n".join(every)).split("\n")
    if len(skeletons) != len(every):
        raise ValueError("the library's skeletons don't belong to the characters")
    return {c: p for c, p in zip(every, skeletons, strict=True) if p and p != unicodedata.normalize("NFD", c)}


@lru_cache(100_000)
def _script(c: str) -> str | None:
    """Script of a letter by its Unicode name; None for what belongs to no script. The scripts of Japanese, Chinese and
    Korean writing are one, as they share words."""
    if not c.isalpha():
        return None
    first = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return "EAST ASIAN" if first in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC") else first or None


_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def _letters(word: str) -> list[str]:
    return [c for c in unicodedata.normalize("NFD", word) if c.isalpha()]


class LookAlikes:
    """Skeletons and plain forms by a table of prototypes.

    Two characters look alike if they have one prototype. A letter's Latin twin is the basic letter of its prototype and case.
    Beside the given public prototypes there are the fixed LOOKALIKES, which go first, and the small capitals by their names.
    """

    def __init__(self, public: dict[str, str] | None = None) -> None:
        public = public or {}
        fixed = {c: p for table in LOOKALIKES.values() for c, p in table.items()}
        self.prototype = public | {c: public.get(p, p) for c, p in fixed.items()}
        of: dict[tuple[str, bool], str] = {}
        for a in reversed(_LETTERS):
            of[public.get(a, a), a.isupper()] = a
        #: script -> letter -> its Latin twin
        self.twin: dict[str, dict[str, str]] = {script: dict(table) for script, table in LOOKALIKES.items()}
        for c in public:
            script = _script(c)
            if script is None or c in fixed or c in _LETTERS or script in ("CYRILLIC", "GREEK", "ARMENIAN"):  # of these the fixed list is whole
                continue
            latin = of.get((public[c], not c.islower()))
            if latin and (script != "LATIN" or not unicodedata.name(c).startswith("LATIN SMALL LETTER") and not unicodedata.name(c).startswith("LATIN CAPITAL LETTER")):
                self.twin.setdefault(script, {})[c] = latin
        for i in range(0x250, 0x2C80 + 0x8000):
            if m := _SMALL_CAPITAL.match(unicodedata.name(chr(i), "")):
                self.twin["LATIN"].setdefault(chr(i), m.group(1).lower())
                self.prototype[chr(i)] = public.get(m.group(1).lower(), m.group(1).lower())
        self.latin_of = {c: p for table in self.twin.values() for c, p in table.items()}
        # the way back: from a Latin letter to the letter of a script
        self.back = {script: {p: c for c, p in reversed(table.items())} for script, table in self.twin.items() if script != "LATIN"}
        self.taken = {p for table in self.back.values() for p in table}

    def skeleton(self, text: str) -> str:
        """Decompose, drop what can't be seen, replace every character by its prototype, decompose again."""
        seen = "".join(c for c in unicodedata.normalize("NFKD", text) if not _hidden(c))
        spaced = "".join(" " if c.isspace() else self.prototype.get(c, c) for c in seen)
        return unicodedata.normalize("NFKD", spaced)

    def _own_letters(self, word: str, script: str) -> int:
        """Letters of the script that look like no letter of another one, so tell that the word is really in it."""
        if script == "LATIN":
            return sum(_script(c) == "LATIN" and c not in self.taken and c not in self.twin["LATIN"] for c in _letters(word))
        table = self.twin.get(script, {})
        return sum(_script(c) == script and c not in table for c in _letters(word))

    def _rewrite(self, word: str, script: str) -> str:
        """The word with its look-alike letters of other scripts in the letters of script, accents kept."""
        out = []
        for c in unicodedata.normalize("NFD", word):
            s = _script(c)
            if s is None or (s == script and not (script == "LATIN" and c in self.twin["LATIN"])):
                out.append(c)
                continue
            latin = self.latin_of.get(c, c)
            out.append(latin if script == "LATIN" else self.back.get(script, {}).get(latin, c))
        return unicodedata.normalize("NFC", "".join(out))

    def _twins(self, word: str, script: str) -> bool:
        """Every letter of the word can be written in the script."""
        if script == "LATIN":
            return all(_script(c) == "LATIN" or c in self.latin_of for c in _letters(word))
        back = self.back.get(script, {})
        return all(_script(c) == script or self.latin_of.get(c, c) in back for c in _letters(word))

    def plain_form(self, text: str | None) -> str | None:
        """Composed accents, ordinary shape, width and spaces, nothing invisible, every letter in the script of its word.

        Of the writings with the text's skeleton it is the one in which each word is in one script: that of its letters
        which have no twin; a word of twins alone takes the script that the rest of the text is plainly written in, Latin
        if there is none or if it has Latin words. A word plainly of another script is kept. Null gives null, the empty text
        itself; runs of spaces, letter case and typographic quotes stay as they are.
        """
        if text is None or (text.isascii() and text.isprintable()):
            return text
        base = unicodedata.normalize("NFKC", "".join(c for c in text if not _hidden(c)))
        # what only shows after composition (e.g. Hangul fillers) is dropped as well
        base = "".join(" " if c.isspace() else c for c in base if not _hidden(c) and (c.isspace() or unicodedata.category(c) != "Cc"))
        words = _WORD.findall(base)
        scripts_of = [{s for c in _letters(w) if (s := _script(c))} for w in words]
        if all(s <= {"LATIN"} for s in scripts_of) and not any(c in self.twin["LATIN"] for c in base):
            return base
        sure: dict[str, int] = {}
        for w, scripts in zip(words, scripts_of, strict=True):
            for s in scripts:
                if n := self._own_letters(w, s):
                    sure[s] = sure.get(s, 0) + n
        others = {s: n for s, n in sure.items() if s != "LATIN" and s in self.back}
        default = "LATIN" if sure.get("LATIN") or not others else max(others, key=lambda s: (others[s], s))

        def home(word: str) -> str:
            scripts = {s for c in _letters(word) if (s := _script(c))}
            if not scripts & (self.back.keys() | {"LATIN"}):
                return word
            own = {s: n for s in scripts | {"LATIN"} if (n := self._own_letters(word, s))}
            if scripts == {"LATIN"} and (own or default == "LATIN" or not self._twins(word, default)):
                target = "LATIN"
            elif own:
                target = max(own, key=lambda s: (own[s], s == "LATIN", s))
            elif len(scripts) == 1 and scripts != {"LATIN"} and default == next(iter(scripts)):
                target = default
            else:
                target = default if self._twins(word, default) else "LATIN"
            return self._rewrite(word, target)

        return unicodedata.normalize("NFC", _WORD.sub(lambda m: home(m.group()), base))

    def forms(self, text: str) -> tuple[str, str]:
        return self.plain_form(text), self.skeleton(text)


#: By the fixed look-alikes alone, for use without a session.
FIXED = LookAlikes()
plain_form, skeleton = FIXED.plain_form, FIXED.skeleton
_sent: dict[str, Broadcast] = {}
_made: dict[int, LookAlikes] = {}


def _broadcast_table(spark: SparkSession) -> Broadcast:
    """The public table, once per application; its size is that of the Unicode standard's table, some ten thousand characters."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.clear()
        _sent[app] = spark.sparkContext.broadcast(public_prototypes(spark))
    return _sent[app]


FORMS = T.StructType([T.StructField("plain", T.StringType()), T.StructField("skeleton", T.StringType())])


def _forms(texts: Column, spark: SparkSession) -> Column:
    sent = _broadcast_table(spark)

    @F.pandas_udf(FORMS)
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = hash(sent.id) if hasattr(sent, "id") else id(sent)
        if key not in _made:
            _made.clear()
            _made[key] = LookAlikes(sent.value)
        of = lru_cache(50_000)(_made[key].forms)
        for batch in batches:
            yield pd.DataFrame([(None, None) if t is None else of(t) for t in batch], columns=["plain", "skeleton"], dtype=object)

    return forms(texts)


def unify_text(df: DataFrame, text: str) -> DataFrame:
    """df with ``plain`` and ``skeleton`` of the text column (null for null). ASCII text never leaves the JVM: it is in plain form,
    and its skeleton comes from the few basic characters that have another prototype. Output columns of these names in df
    are replaced."""
    df = df.drop("plain", "skeleton")
    ascii_text = F.col(text).rlike(PLAIN_PATTERN) | F.col(text).isNull()
    basic = F.col(text)
    changed = {c: unicodedata.normalize("NFKD", p) for c, p in _broadcast_table(df.sparkSession).value.items() if c.isascii()}
    one = {c: p for c, p in changed.items() if len(p) == 1}
    basic = F.translate(basic, "".join(one), "".join(one.values())) if one else basic
    for c, p in sorted((c, p) for c, p in changed.items() if c not in one):
        basic = F.replace(basic, F.lit(c), F.lit(p))
    as_is = df.where(ascii_text).withColumn("plain", F.col(text)).withColumn("skeleton", basic)
    odd = df.where(~ascii_text).withColumn("_f", _forms(F.col(text), df.sparkSession)).select(*df.columns, "_f.plain", "_f.skeleton")
    return as_is.unionByName(odd)


def not_plain(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text differs from the plain form of its skeleton's writings, with both forms."""
    odd = df.where(~F.col(text).rlike(PLAIN_PATTERN))
    return unify_text(odd, text).where(F.col("plain") != F.col(text))


def skeleton_groups(df: DataFrame, text: str) -> DataFrame:
    """(skeleton, n_rows, n_originals, plain): one row per skeleton. Distinct texts are counted first, so copies are
    folded before the shuffle; plain is the most frequent plain form (ties by code points). Nulls are in no group."""
    counted = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_t")).agg(F.count("*").alias("_n"))
    forms = unify_text(counted, "_t").groupBy("skeleton", "plain").agg(F.sum("_n").alias("_n"), F.count("*").alias("_o"))
    return forms.groupBy("skeleton").agg(F.sum("_n").alias("n_rows"), F.sum("_o").alias("n_originals"), F.min_by("plain", F.struct(-F.col("_n"), F.col("plain"))).alias("plain"))
