"""Keyword retrieval: BM25 over text and cosine over sparse term weights.

Statistics are those of the whole collection (all namespaces, unfiltered): documents with a token, their mean length, and in
how many each query token stands. They are one row, read before the plan is made, so that scores are plain expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

KEY = ("namespace", "id")


def tokenized(records: DataFrame, *more: str) -> DataFrame:
    """(namespace, id, *more, tokens, length) of records with at least one token. Tokens come out of a generator, below which
    no later predicate or projection is moved: a text is cut once."""
    held = records.where("text is not null and text <> ''")
    out = held.select(*KEY, *more, F.explode(F.array(T.tokens(F.col("text")))).alias("tokens"))
    return out.withColumn("length", F.size("tokens")).where("length > 0")


def postings(records: DataFrame) -> DataFrame:
    """The inverted index: (namespace, id, token, tf, length)."""
    each = tokenized(records).select(*KEY, "length", F.explode("tokens").alias("token"))
    return each.groupBy(*KEY, "token", "length").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row: documents, mean_length; from (namespace, id, length)."""
    return docs.agg(F.count("*").cast("double").alias("documents"), F.avg("length").alias("mean_length"))


@dataclass(frozen=True)
class Corpus:
    """What BM25 needs to know of a whole collection for one query."""

    documents: float
    mean_length: float
    frequency: dict[str, float]

    @property
    def tokens(self) -> list[str]:
        """The query's tokens that any document holds."""
        return [t for t, n in self.frequency.items() if n]

    def term(self, tf: Column, length: Column, token: str) -> Column:
        return T.bm25_term(tf.cast("double"), length, F.lit(self.mean_length), T.idf(F.lit(self.documents), F.lit(self.frequency[token])))

    def score(self, tokens: Column, length: Column) -> Column:
        count = lambda token: F.size(F.filter(tokens, lambda x: x == token))
        counts = {t: count(t) for t in self.tokens}
        return reduce(lambda a, b: a + b, [F.when(n > 0, self.term(n, length, t)).otherwise(0.0) for t, n in counts.items()], F.lit(0.0))


def corpus(records: DataFrame, query: str) -> Corpus:
    """Statistics for a query by one pass over all texts."""
    wanted = T.query_tokens(query)
    holds = [F.count_if(F.array_contains("tokens", t)).cast("double").alias(f"df{i}") for i, t in enumerate(wanted)]
    row = tokenized(records).agg(F.count("*").cast("double").alias("documents"), F.avg("length").alias("mean_length"), *holds).first()
    return Corpus(row["documents"], row["mean_length"] or 1.0, {t: row[f"df{i}"] for i, t in enumerate(wanted)})


def corpus_of_postings(index: DataFrame, query: str, totals: DataFrame | None = None) -> Corpus:
    """Statistics from a stored inverted index; `totals` is its stored row of `statistics`, else worked out."""
    wanted = T.query_tokens(query)
    row = (statistics(index.select(*KEY, "length").distinct()) if totals is None else totals).first()
    found = index.where(F.col("token").isin(wanted) if wanted else F.lit(False)).groupBy("token").agg(F.count("*").cast("double").alias("df"))
    known = {r["token"]: r["df"] for r in found.collect()}  # the query's tokens
    return Corpus(row["documents"], row["mean_length"] or 1.0, {t: known.get(t, 0.0) for t in wanted})


def bm25(records: DataFrame, query: str, everything: DataFrame | None = None, known: Corpus | None = None) -> DataFrame:
    """(namespace, id, score) of the records that hold a query token; statistics from `everything` if given, or known.

    One scan; texts without any of the tokens as a substring are not cut.
    """
    known = known or corpus(records if everything is None else everything, query)
    if not known.tokens:
        return records.select(*KEY, F.lit(0.0).alias("score")).limit(0)
    low = F.lower("text")
    near = records.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in known.tokens]))
    held = tokenized(near).where(F.arrays_overlap("tokens", F.array(*map(F.lit, known.tokens))))
    return held.select(*KEY, known.score(F.col("tokens"), F.col("length")).alias("score"))


def bm25_from_postings(index: DataFrame, query: str, allowed: DataFrame | None = None, known: Corpus | None = None) -> DataFrame:
    """The same from a stored inverted index: only the query tokens' postings are read, and of these the allowed keys'."""
    known = known or corpus_of_postings(index, query)
    hits = index.where(F.col("token").isin(known.tokens) if known.tokens else F.lit(False))
    if allowed is not None:
        hits = hits.join(allowed.select(*KEY), list(KEY), "left_semi")
    cases = [F.when(F.col("token") == t, known.term(F.col("tf"), F.col("length"), t)) for t in known.tokens]
    return hits.groupBy(*KEY).agg(F.sum(F.coalesce(*cases) if cases else F.lit(0.0)).alias("score"))


def sparse(records: DataFrame, query: dict[str, float]) -> DataFrame:
    """(namespace, id, score) of records that share a non-zero query term."""
    held = [F.coalesce(F.col("sparse_vector")[t], F.lit(0.0)) != 0 for t, w in sorted(query.items()) if w]
    shares = reduce(lambda a, b: a | b, held) if held else F.lit(False)
    return records.where(F.col("sparse_vector").isNotNull()).where(shares).select(*KEY, V.sparse_cosine(F.col("sparse_vector"), query).alias("score"))


def site_terms(query: str) -> list[str]:
    """Up to eight terms of a site search."""
    trimmed = (w.strip("\"'.,;:!?()[]{}") for w in query.lower().split())
    return [w for w in trimmed if len(w.encode()) >= 2][:8]


def _occurrences(c: Column, term: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def site_search(pages: DataFrame, query: str, path: str = "path", title: str = "title", body: str = "body", limit: int = 20, radius: int = 90) -> DataFrame:
    """Pages that hold every term as a substring: title hits count five times, body hits up to 20; with a snippet."""
    terms = site_terms(query)
    low_title, low_body = F.lower(F.coalesce(F.col(title), F.lit(""))), F.lower(F.coalesce(F.col(body), F.lit("")))
    if not terms:
        return pages.select(F.col(path).alias("path"), F.lit(0).alias("score"), F.lit("").alias("snippet")).limit(0)
    counts = [(_occurrences(low_title, t), _occurrences(low_body, t)) for t in terms]
    all_there = reduce(lambda a, b: a & b, [(x + y) > 0 for x, y in counts])
    score = reduce(lambda a, b: a + b, [x * 5 + F.least(y, F.lit(20)) for x, y in counts])
    at = F.greatest(F.instr(low_body, terms[0]) - 1, F.lit(0))
    start = F.greatest(at - radius, F.lit(0))
    cut = F.substr(F.col(body), start + 1, (at - start) + len(terms[0]) + radius)
    plain = F.trim(F.regexp_replace(F.translate(cut, "|#`*", " "), r"\s+", " "))
    tail = at + len(terms[0]) + radius
    snippet = F.concat(F.when(start > 0, "…").otherwise(""), plain, F.when(tail < F.length(F.col(body)), "…").otherwise(""))
    return pages.where(all_there).select(F.col(path).alias("path"), score.alias("score"), snippet.alias("snippet")).orderBy(F.desc("score"), "path").limit(limit)
