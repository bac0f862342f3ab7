"""Full text: analyzers, the AND match, and cover density.

A cover is a shortest stretch of positions that holds all query terms (Clarke, Cormack and
Tudhope, 2000). Each counts ``1 / (1 + its length - number of terms)``. Everything is computed
within the row from its token array, so ranking needs no shuffle until the top k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = (
    "a about after all also am an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it "
    "its just me more most my no nor not of on only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with you your"
).split()


def tokens(text: Column) -> Column:
    """Analyzer ``simple``: runs of letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# Suffix rules of Porter's stemmer (1980), steps 2 to 4, in the order they are tried.
_STEP_2 = (
    "ational ate", "tional tion", "enci ence", "anci ance", "izer ize", "abli able", "alli al", "entli ent", "eli e", "ousli ous", "ization ize", "ation ate", "ator ate",
    "alism al", "iveness ive", "fulness ful", "ousness ous", "aliti al", "iviti ive", "biliti ble",
)
_STEP_3 = ("icate ic", "ative ", "alize al", "iciti ic", "ical ic", "ful ", "ness ")
_STEP_4 = ("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize").split()


def _kinds(word: str) -> str:
    """Each letter as c(onsonant) or v(owel); y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _kinds(word).count("vc")


def _short_end(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and len(word) > 2 and word[-1] not in "wxy"


def _replaced(word: str, rules: tuple[str, ...]) -> str:
    """The word after the rule of its longest listed suffix, if its stem has a measure."""
    fits = [r.split(" ") for r in rules if word.endswith(r.split(" ")[0])]
    if not fits:
        return word
    suffix, new = max(fits, key=lambda r: len(r[0]))
    rest = word[: -len(suffix)]
    return rest + new if _measure(rest) > 0 else word


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words with other than a-z stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = next((x for x in ("eed", "ed", "ing") if word.endswith(x)), None)
    if cut == "eed":
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif cut and "v" in _kinds(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short_end(word)):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2), _STEP_3)
    fits = [x for x in _STEP_4 if word.endswith(x)]
    if fits:
        rest = word[: -len(max(fits, key=len))]
        if _measure(rest) > 1 and (max(fits, key=len) != "ion" or rest[-1:] in ("s", "t")):
            word = rest
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def _english(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    stop, known = set(STOP_WORDS), {}
    for series in texts:
        out = []
        for text in series:
            row = re.findall(r"[^\W_]+", (text or "").lower())
            for w in row:
                if w not in known:
                    known[w] = "" if w in stop else stem(w)
            out.append([known[w] for w in row])
            if len(known) > 500_000:
                known.clear()
        yield pd.Series(out)


def english_tokens(text: Column) -> Column:
    """Analyzer ``english``: stop words become empty (they keep their position), others are stemmed."""
    return F.pandas_udf(_english, "array<string>")(text)


def query_terms(query: str, analyzer: str = "simple") -> list[str]:
    """The query's distinct terms in order; empty if it has nothing but stop words."""
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if analyzer == "english":
        words = list(dict.fromkeys(stem(w) for w in words if w not in STOP_WORDS))
    return words


def matches(token_array: Column, terms: list[str]) -> Column:
    """Whether all terms occur; a query without terms matches nothing."""
    if not terms:
        return F.lit(False)
    found = F.array_contains(token_array, terms[0])
    for t in terms[1:]:
        found = found & F.array_contains(token_array, t)
    return found


def cover_density(token_array: Column, terms: list[str], digits: int = 9) -> Column:
    """The sum over covers; 0 if a term is missing."""
    if not terms:
        return F.lit(0.0)
    index = F.array(*map(F.lit, terms))
    hits = F.filter(F.transform(token_array, lambda t, i: F.struct(F.array_position(index, t).cast("int").alias("term"), i.alias("at"))), lambda h: h["term"] > 0)
    return density_of_hits(hits, len(terms), digits)


def density_of_hits(hits: Column, n: int, digits: int = 9) -> Column:
    """The sum over covers of ``n`` terms from their places: structs (term from 1, at) by ``at``."""
    start = F.struct(F.array(*[F.lit(-1)] * n).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda p, i: F.when(i + 1 == h["term"], h["at"]).otherwise(p))
        begin = F.array_min(last)
        # the first end for each begin is its shortest cover
        new = begin > s["begin"]
        return F.struct(last.alias("last"), F.when(new, begin).otherwise(s["begin"]).alias("begin"), (s["score"] + F.when(new, 1.0 / (1 + (h["at"] - begin + 1) - n)).otherwise(0.0)).alias("score"))

    return F.round(F.aggregate(hits, start, step, lambda s: s["score"]), digits)
