"""Analysers: how text becomes tokens."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[\\\\p{L}\\\\p{N}]+"

# The Snowball project's English stop words.
ENGLISH_STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)


def tokens(column: str) -> Column:
    """Simple analyser: runs of letters or digits, lower case, in order. NULL text has no tokens."""
    return F.expr(f"coalesce(regexp_extract_all(lower(`{column}`), '{TOKEN}', 0), array())")


def postings(df: DataFrame, id_col: str, text_col: str, analyser: str = "simple") -> DataFrame:
    """(id, token, position) of every token occurrence, positions from 1."""
    every = df.select(F.col(id_col).alias("id"), F.posexplode(analysed(text_col, analyser)).alias("p", "token")).where("token is not null")
    return every.select("id", "token", (F.col("p") + 1).alias("position"))


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf)."""
    return postings(df, id_col, text_col).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")


def english_lexemes(text: str | None, gaps: bool = False) -> list[str | None]:
    """English analyser: accents folded, identifiers (with a digit or an inner stop) kept whole, stop words dropped, the rest stemmed. With ``gaps`` a dropped word leaves None, so positions are those of the text."""
    out: list[str | None] = []
    for w in _WORD.findall(fold(text or "")):
        if any(c.isdigit() for c in w):
            out.append(w)
            continue
        for part in re.split(r"[.\-/]", w) if "." not in w else [w]:
            if "." in part:
                out.append(part)
            elif part not in ENGLISH_STOP:
                out.append(stem(part))
            elif gaps:
                out.append(None)
    return out


def _english(texts: pd.Series) -> pd.Series:
    return texts.map(english_lexemes)


def _english_gaps(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: english_lexemes(t, True))


def english(column: str, gaps: bool = False) -> Column:
    """``english_lexemes`` over a column: array<string>."""
    return F.pandas_udf(_english_gaps if gaps else _english, "array<string>")(column)


def analysed(column: str, analyser: str = "simple") -> Column:
    """The tokens of a text column in order, NULL where the analyser drops a word: 'simple' or 'english'."""
    if analyser not in ("simple", "english"):
        raise ValueError(f"unknown analyser {analyser!r}")
    return english(column, True) if analyser == "english" else tokens(column)


def is_identifier(token: Column) -> Column:
    """The lexeme carries a digit or an inner full stop."""
    return token.rlike("\\p{Nd}") | F.contains(token, F.lit("."))


# -- Porter2, after the published description at snowballstem.org ------------
_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Words the algorithm treats on their own.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWEL and w[i - 1] in _VOWEL:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-1] not in _VOWEL + "wxY" and w[-2] in _VOWEL and w[-3] not in _VOWEL


def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWEL) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in _VOWEL for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif _short_end(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and not (s == "ogi" and w[at - 1 : at] != "l") and not (s == "li" and w[at - 1 : at] not in tuple(_LI)):
                w = w[:at] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and not (s == "ative" and at < r2):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and not (s == "ion" and w[at - 1 : at] not in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def squashed(column: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(column), "[^\\p{L}\\p{N}]+", "")


def spaced(column: Column) -> Column:
    """White space runs as one blank, lower case, trimmed."""
    return F.trim(F.regexp_replace(F.lower(column), "\\s+", " "))


def anchor_found(text: Column, anchor: Column) -> Column:
    """The anchor occurs in the text up to case and white space; one without digits also up to punctuation."""
    plain = F.contains(spaced(text), spaced(anchor))
    loose = ~anchor.rlike("\\p{Nd}") & F.contains(squashed(text), squashed(anchor))
    return F.coalesce((F.length(spaced(anchor)) > 0) & (plain | loose), F.lit(False))


def _fold_series(words: pd.Series) -> pd.Series:
    return words.map(fold, na_action="ignore")


def accented_vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """(folded, forms, plain): words with accented forms, by their form without accents: distinct forms, and whether the plain one occurs.

    Words are made distinct before they are folded, so Python sees the vocabulary, not the corpus.
    """
    words = df.select(F.explode(F.expr(f"regexp_extract_all(`{text_col}`, '[\\\\p{{L}}]+', 0)")).alias("w")).select(F.lower("w").alias("w")).distinct()
    f = words.withColumn("folded", F.pandas_udf(_fold_series, "string")("w"))
    g = f.groupBy("folded").agg(F.count(F.lit(1)).alias("forms"), F.count_if(F.col("w") == F.col("folded")).alias("plain"), F.count_if(F.col("w") != F.col("folded")).alias("accented"))
    return g.where("accented > 0").drop("accented")
