"""Words, tokens and BM25 arithmetic."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{Nd}]+"
#: Stop words, as fixed values.
STOPWORDS = "a an and are as at be by for from in is it of on or that the this to was with".split()
#: BM25 constants, as fixed values.
K1 = 1.2
B = 0.75


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Words without stop words."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda x: (x != "") & ~x.isin(STOPWORDS))


def query_words(text: str) -> list[str]:
    """The same words of a literal."""
    solid = lambda c: unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"
    return "".join(c if solid(c) else " " for c in text.lower()).split()


def query_tokens(text: str) -> list[str]:
    """Distinct tokens of a query in order."""
    return list(dict.fromkeys(w for w in query_words(text) if w not in STOPWORDS))


def idf(documents: Column, frequency: Column) -> Column:
    return F.log(1 + (documents - frequency + 0.5) / (frequency + 0.5))


def bm25_term(tf: Column, length: Column, mean_length: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
