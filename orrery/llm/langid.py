"""Language identification by fusing evidence.

For each language the log posterior is the sum of the text's likelihood under byte-trigram counts, the likelihood of what
the markup declares, that of the address suffix, and a host prior. Host priors are smoothed along a hierarchy: all rows,
then the rows of an address suffix, then those of a host; their counts are one grouped aggregation of the text posteriors.
A background language with uniform trigrams takes what is no language at all; rows that it wins are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, slices, with_heavy

BUCKETS = 1 << 15
PER_LANGUAGE = 2000
MOST_LANGUAGES = 200
LEAST_ROWS = 5
BACKGROUND = "und"
#: Address suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams that lie within a text and hold a letter or high byte and no digit, and how many precede
    each text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    low = _LOWER[data].astype(np.uint32)
    key = low[:-2] | low[1:-1] << 8 | low[2:] << 16
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    digit = (low >= 48) & (low <= 57)  # numbers and codes are of no language
    keep = (letter[:-2] | letter[1:-1] | letter[2:]) & ~(digit[:-2] | digit[1:-1] | digit[2:])
    edge = at[1:-1]
    for back in (1, 2):
        cut = edge - back
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    place = np.flatnonzero(keep)
    return ((key[place] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64), np.searchsorted(place, at)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood [bucket, language]) from about `per_language` rows of each declared language.

    A row is in the sample if the hash of its id and text falls below its language's share: a filter, so no row travels to
    be ranked and the sample stays of one size however many rows there are. A language that fewer than LEAST_ROWS declare is
    none. The last language is the background.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("lang")).where("text is not null and lang is not null and lang <> ''")
    frequent = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().where(F.col("count") >= LEAST_ROWS).orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}  # bounded
    languages = sorted(frequent)
    if not languages:
        return [BACKGROUND], np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / frequent[lang]))])
    sample = rows.where(F.col("lang").isin(languages)).where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)).select("text", "lang")

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for batch, data, at in slices(batches, "text"):
            keys, before = trigrams(data, at)
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            np.add.at(total, (np.repeat(lang, np.diff(before)), keys), 1)
        i, j = np.nonzero(total)
        yield pa.record_batch({"lang": pa.array(i, pa.int32()), "bucket": pa.array(j, pa.int32()), "n": pa.array(total[i, j])})

    counted = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS at most
    table = np.zeros((BUCKETS, len(languages) + 1))
    table[counted.column("bucket").to_numpy(), counted.column("lang").to_numpy()] = counted.column("n").to_numpy()
    smooth = 0.05
    out = np.log((table + smooth) / (table.sum(0) + smooth * BUCKETS))
    out[:, -1] = -np.log(BUCKETS)
    return [*languages, BACKGROUND], out.astype(np.float32)


def _text_scores(df: DataFrame, model: tuple[list[str], np.ndarray], weight: float) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model[1])

    def score(batches):
        table = shared.value
        for batch, data, at in slices(batches, "text", 1 << 18):  # a row of numbers a trigram
            keys, before = trigrams(data, at)
            total = np.zeros((len(keys) + 1, table.shape[1]))
            np.cumsum(table[keys], axis=0, dtype=np.float64, out=total[1:])
            n = np.diff(before)
            ll = (total[before[1:]] - total[before[:-1]]) * (np.minimum(n, weight) / np.maximum(n, 1))[:, None]
            yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names if c != "text"}, "ll": pa.array(list(ll), pa.list_(pa.float64()))})

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in df.columns if c != "text")
    return df.mapInArrow(score, f"{fields}, ll array<double>")


def _softmax(df: DataFrame, logs: str, out: str) -> DataFrame:
    """Adds an array of probabilities for an array of logarithms."""
    raised = df.withColumn("_e", F.transform(logs, lambda x: F.exp(x - F.array_max(logs))))
    summed = raised.withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return summed.withColumn(out, F.transform("_e", lambda x: x / F.col("_t"))).drop("_e", "_t")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, labelled: DataFrame | None = None, per_language: int = PER_LANGUAGE, weight: float = 60.0, trust: float = 0.9, certain: float = 0.5) -> DataFrame:
    """Per row: doc_id, lang, posterior, text_lang, host_prior (of lang), accepted.

    `labelled` (the id, text, lang; df itself with its `lang` column if None) fits the likelihoods. `weight` is how many trigrams
    a text counts for at most, as neighbours are not independent. A row is rejected if the background is likeliest or no
    language reaches `certain`. Null or empty texts, and texts without letters, have no language of their own and are
    rejected whatever is declared. Null or unknown declarations, suffixes and hosts say nothing: the next level's prior
    holds. Without any labelled text every row is rejected. Repeated rows each come back; other columns are not read; an
    empty table gives an empty result.
    """
    nothing = F.lit(None).cast("string")
    own = lambda c: nothing if c is None else F.lower(c.cast("string"))
    model = fit(df if labelled is None else labelled, id_col, "text" if labelled is not None else text_col, "lang", per_language)
    names = model[0]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.substring_index(F.substring_index(own(declared), "-", 1), "_", 1).alias("declared"), own(suffix).alias("suffix"), own(host).alias("host"))
    scored = settled(_text_scores(rows, model, weight))
    soft = _softmax(scored, "ll", "p").select("host", "suffix", *[F.col("p")[i].alias(f"p{i}") for i in range(len(names))])
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(len(names))]
    per_host = settled(soft.groupBy("host", "suffix").agg(F.count("*").alias("n"), *sums))  # map-side sums: a hot host is one row a task
    per_suffix = per_host.groupBy("suffix").agg(F.sum("n").alias("sn"), *[F.sum(f"p{i}").alias(f"s{i}") for i in range(len(names))])
    every = per_host.agg(F.sum("n").alias("n"), *sums).first()
    base = [((every[f"p{i}"] or 0.0) + 1) / ((every["n"] or 0) + len(names)) for i in range(len(names))]
    joined = per_host.where("host is not null").join(per_suffix.withColumnRenamed("suffix", "sfx"), F.col("suffix").eqNullSafe(F.col("sfx")))
    at_suffix = [(F.col(f"s{i}") + 20 * F.lit(base[i])) / (F.col("sn") + 20) for i in range(len(names))]
    prior = joined.select(F.struct("host", "suffix").alias("place"), "n", F.array(*[(F.col(f"p{i}") + 5 * at_suffix[i]) / (F.col("n") + 5) for i in range(len(names))]).alias("prior"))
    priors = with_heavy(scored.withColumn("place", F.when(F.col("host").isNotNull(), F.struct("host", "suffix"))), prior, "place", "n")
    speaks = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    spoken = F.coalesce(speaks[F.substring_index("suffix", ".", -1)], F.when(F.col("suffix").isin(names[:-1]), F.col("suffix")))
    others = max(1, len(names) - 1)
    says = lambda heard, i, sure: F.when(heard.isNull() | ~heard.isin(names[:-1]), 0.0).when(heard == names[i], float(np.log(sure))).otherwise(float(np.log((1 - sure) / others)))
    prior_of = [F.coalesce(F.col("prior")[i], F.lit(base[i])) for i in range(len(names))]
    fused = [F.col("ll")[i] + says(F.col("declared"), i, trust) + says(F.col("spoken"), i, 0.7) + F.log(F.col("fair")[i]) for i in range(len(names))]
    fair = priors.select("id", "ll", "declared", spoken.alias("spoken"), F.array(*prior_of).alias("fair"))
    post = _softmax(fair.select("id", "ll", F.col("fair").alias("prior"), F.array(*fused).alias("fused")), "fused", "post")
    best = lambda c: F.array_position(F.col(c), F.array_max(c)).cast("int")
    named = post.withColumn("best", best("post")).withColumn("text_best", best("ll"))
    empty = F.forall("ll", lambda x: x == 0)
    name = F.array(*[F.lit(x) for x in names])
    return named.select(
        F.col("id").alias("doc_id"),
        F.when(empty, BACKGROUND).otherwise(F.element_at(name, F.col("best"))).alias("lang"),
        F.element_at("post", F.col("best")).alias("posterior"),
        F.when(empty, BACKGROUND).otherwise(F.element_at(name, F.col("text_best"))).alias("text_lang"),
        F.element_at("prior", F.col("best")).alias("host_prior"),
        (~empty & (F.element_at(name, F.col("best")) != BACKGROUND) & (F.element_at("post", F.col("best")) >= certain)).alias("accepted"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> doc_id, text without tags, declared, suffix, host."""
    html = F.coalesce(F.col("html"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    lang = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), F.nullif(lang, F.lit("")).alias("declared"), F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))
