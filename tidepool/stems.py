"""Words as a full-text index sees them: without marks, and as their stems.

A word is folded and stemmed once for each Arrow batch it occurs in, however
often it occurs: the batch's words are dictionary-encoded, the dictionary is
worked on, and the codes are put in place again.  Stems are those of Porter's
algorithm (1980).
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOWELS = frozenset("aeiou")
# Porter's suffixes of steps 2 to 4 with what they become.
_STEP_2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP_3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    """Pairs, longest suffix first."""
    return sorted(((a, b) for a, _, b in (x.partition(" ") for x in text.split(","))), key=lambda r: -len(r[0]))


_TWO, _THREE, _FOUR = _rules(_STEP_2), _rules(_STEP_3), sorted(_STEP_4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """v and c for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in _VOWELS or (letter == "y" and i > 0 and out[i - 1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def porter(word: str) -> str:
    """The stem of a word in small ASCII letters; shorter than three or longer than 64 characters it stays as it is."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    # 1a: plurals.
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: -eed, -ed, -ing.
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (found := re.search("(ed|ing)$", word)) and "v" in _shape(word[: found.start()]):
        word = word[: found.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    # 1c: -y behind a vowel.
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_TWO, _THREE):
        for suffix, other in rules:
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + other
                break
    for suffix in _FOUR:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    # 5: a last -e, and -ll.
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def plain(text: str) -> str:
    """Without marks: decomposed, and what only marks other letters left out."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))


def indexed(word: str) -> str:
    """A small-letter word as the index holds it."""
    return porter(plain(word))


def _replaced(values: pa.Array, change: Callable[[str], str]) -> pa.Array:
    coded = values.dictionary_encode()
    made = pa.array([None if w is None else change(w) for w in coded.dictionary.to_pylist()], pa.string())
    return made.take(coded.indices)


def _mapped(batches: Iterable[pa.RecordBatch], at: int, change: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    change = functools.lru_cache(maxsize=1 << 16)(change)
    for batch in batches:
        column = batch.column(at)
        if pa.types.is_list(column.type):
            made = pa.ListArray.from_arrays(column.offsets, _replaced(column.values, change), mask=column.is_null() if column.null_count else None)
        else:
            made = _replaced(column, change)
        yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def changed(df: DataFrame, column: str, change: Callable[[str], str]) -> DataFrame:
    """The frame with ``change`` made to the strings of a column (texts, or lists of them); nulls stay."""
    at = df.columns.index(column)
    # Names travel by place, so any name will do.
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return numbered.mapInArrow(lambda it: _mapped(it, at, change), numbered.schema).toDF(*df.columns)


def indexed_words(df: DataFrame, column: str) -> DataFrame:
    """The frame with a list of small-letter words as the index holds them."""
    return changed(df, column, indexed)


def folded_names(df: DataFrame, column: str) -> DataFrame:
    """IDN-7: the frame with a column of names in small letters without marks; what is no letter, digit, blank, quote or hyphen goes."""
    bare = changed(df.withColumn(column, F.lower(column)), column, plain)
    return bare.withColumn(column, F.trim(F.regexp_replace(column, "[^a-z0-9 '-]", "")))
