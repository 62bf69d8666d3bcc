"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, so that a question with other values keeps its template. Windows of
template words are hash-joined with those of the benchmark; the words are then compared, and each value of the item must stand for one
value of the text: a question with new values passes, a chance meeting of templates does not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

WORDS = 8
LITERALS = 5
COVERAGE = 0.2
MOST_BROADCAST = 500_000
_NAME = "\ue000"  # stands before a word taken for a name
#: Units of measure, as fixed values.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces pound pounds ton tons tonne tonnes "
    "ml cl l litre litres liter liters gallon gallons s sec second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years hz khz mhz ghz w kw mw j kj v a pa kpa c f k mph kmh kph usd eur gbp dollar dollars cent cents euro euros percent pct "
    "degree degrees byte bytes kb mb gb tb"
).split()


def template(text: Column) -> tuple[Column, Column]:
    """(raw words, template words) of a text, of equal length and order. Only texts with digits pay for numbers and units."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    digits = text.rlike(r"\d")

    def words(t: Column) -> Column:
        t = F.regexp_replace(t, r" (?=\p{Lu}[\p{Ll}'-])(?<=[^.!?\s] )", f" {_NAME}")  # a capital within a sentence
        return F.trim(F.regexp_replace(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{_NAME}]+", " "))

    def shape(t: Column) -> Column:
        return F.lower(F.regexp_replace(words(t), rf"{_NAME}[^ ]+", "<name>"))

    apart = F.regexp_replace(F.regexp_replace(text, r"(\d)[.,](?=\d)", "$1"), r"(\d)(?=\p{L})", "$1 ")
    numbers = F.regexp_replace(shape(apart), r"(?<![^ ])\p{N}+(?![^ ])", "<num>")
    units = F.regexp_replace(numbers, rf"(?<=<num> )(?:{'|'.join(UNITS)})(?![^ ])", "<unit>")
    cut = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return cut(F.when(digits, words(apart)).otherwise(words(text))), cut(F.when(digits, units).otherwise(shape(text)))


def _windows(shaped: DataFrame, width: int, column: str = "shape") -> DataFrame:
    """(*, column) -> (*, pos from 1, hash) of each window of `width` words. Hashes of 1, 2, 4, ... words are doubled up."""
    keys = [c for c in shaped.columns if c != column]
    at = shaped.where(F.size(column) >= width).select(*keys, F.transform(column, lambda x: F.xxhash64(x)).alias("h"))
    span = 1
    while span < width:
        step = min(span, width - span)  # the halves may overlap
        at = at.select(*keys, F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + step))).alias("h"))
        span += step
    return at.select(*keys, F.posexplode(F.slice("h", F.lit(1), F.size("h") - (width - 1))).alias("pos", "hash")).withColumn("pos", F.col("pos") + 1)


def _values(raw: Column, shape: Column) -> Column:
    """The words of a text, lowered, each with its template word: windows of few literals are looked up by these."""
    return F.zip_with(raw, shape, lambda r, s: F.concat_ws(" ", s, F.lower(r)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, literals: int = LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """A row per document and benchmark item that it holds: doc_id, item_id, windows, coverage, slots, verbatim.

    Every window of `words` template words of the whole text is looked up; an item of fewer words is one window of its
    length. Templates with under `literals` words outside placeholders say nothing by themselves: such windows, and so short
    items, count where their slots hold the item's own values. A pair is a leak if one alignment of text and item covers
    at least `coverage` of the item's windows, of all or of those that need not agree in values, and no value of the item
    stands for two of the text; two of the item's may have become equal. `verbatim` tells that every slot holds the item's own value. Null or empty texts
    hold nothing; rows with a null id are reported with it; repeated rows are one document; other columns are not read;
    an empty table on either side gives an empty result. The benchmark's windows are broadcast only below
    MOST_BROADCAST rows, and shuffled beyond.
    """
    raw, shape = template(F.col("t"))
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).where("t is not null and item is not null").distinct()
    items = settled(items.select("item", raw.alias("item_raw"), shape.alias("item_shape")).where(F.size("item_shape") > 0))
    literal = F.filter("piece", lambda x: ~F.startswith(x, F.lit("<")))
    short = {r["n"] for r in items.select(F.size("item_shape").alias("n")).where(F.col("n") < words).distinct().collect()}  # under `words` values
    widths = sorted({words, *short})
    parts = []
    for n in widths:
        fits = items.where(F.size("item_shape") >= words if n == words else F.size("item_shape") == n)
        values = _windows(fits.select("item", _values(F.col("item_raw"), F.col("item_shape")).alias("values")), n, "values").select("item", F.col("pos").alias("at"), F.col("hash").alias("exact"))
        hashed = _windows(fits.select("item", F.col("item_shape").alias("shape")), n).withColumnRenamed("pos", "at").join(values, ["item", "at"])
        placed = hashed.join(items.select("item", "item_shape"), "item").withColumn("piece", F.slice("item_shape", F.col("at"), F.lit(n)))
        few = F.size(literal) < literals
        parts.append(placed.select("item", F.lit(n).alias("width"), "at", few.alias("few"), F.when(few, F.col("exact")).otherwise(F.col("hash")).alias("hash")))
    spots = settled(reduce(DataFrame.unionAll, parts))
    dense = {r["width"] for r in spots.where("few").select("width").distinct().collect()}  # under `words` values
    wanted = spots.groupBy("hash", "width", "few").agg(F.collect_list(F.struct("item", "at")).alias("spots"))
    count = spots.count()
    side = F.broadcast(wanted) if count <= MOST_BROADCAST else wanted
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    shaped = rows.select("id", shape.alias("shape"))  # a column of its own: worked out once a text
    tables = [(shaped, n, "shape", False) for n in widths]
    if dense:  # only texts with enough placeholders in them have long windows of few literals
        slotted = rows.select("id", raw.alias("raw"), shape.alias("shape")).where(F.size(F.filter("shape", lambda x: F.startswith(x, F.lit("<")))) > min(dense) - literals)
        valued = slotted.select("id", _values(F.col("raw"), F.col("shape")).alias("values"))
        tables += [(valued, n, "values", True) for n in sorted(dense)]
    found = reduce(DataFrame.unionAll, [_windows(t, n, c).select("id", "hash", F.lit(n).alias("width"), F.lit(few).alias("few"), "pos") for t, n, c, few in tables])
    hits = found.join(side, ["hash", "width", "few"]).select("id", "width", "pos", "few", F.explode("spots").alias("s")).select("id", F.col("s.item").alias("item"), F.struct("width", "pos", F.col("s.at").alias("at"), "few").alias("m"))
    pairs = settled(hits.groupBy("id", "item").agg(F.collect_set("m").alias("ms")))  # at most a text's words times an item's
    ids = pairs.select(F.col("id").alias("pid")).distinct()
    texts = rows.join(ids, F.col("id").eqNullSafe(F.col("pid")), "left_semi").select("id", raw.alias("raw"), shape.alias("shape"))
    joined = texts.join(pairs.withColumnRenamed("id", "pid"), F.col("id").eqNullSafe(F.col("pid"))).join(items, "item")
    same = F.filter("ms", lambda m: F.slice("shape", m["pos"], m["width"]) == F.slice("item_shape", m["at"], m["width"]))

    def slots(m: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), m["width"] - 1), lambda j: F.struct((m["at"] + j).alias("at"), F.get("item_shape", m["at"] + j - 1).alias("kind"), F.lower(F.get("item_raw", m["at"] + j - 1)).alias("theirs"), F.lower(F.get("raw", m["pos"] + j - 1)).alias("ours")))
        return F.filter(each, lambda s: F.startswith(s["kind"], F.lit("<")))

    per = joined.select("id", "item", F.explode(F.transform(same, lambda m: F.struct((m["pos"] - m["at"]).alias("shift"), m["at"].alias("at"), m["few"].alias("few"), slots(m).alias("slots")))).alias("w")).select("id", "item", "w.*")
    per = per.where(~F.col("few") | F.forall("slots", lambda s: s["theirs"] == s["ours"]))
    lined = per.groupBy("id", "item", "shift").agg(F.countDistinct("at").alias("windows"), F.countDistinct(F.when(~F.col("few"), F.col("at"))).alias("wide"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    distinct = lambda f: F.size(F.array_distinct(F.transform("slots", f)))
    pair = lambda s: F.struct(s["kind"], s["theirs"], s["ours"])
    one = distinct(pair) == distinct(lambda s: F.struct(s["kind"], s["theirs"]))
    total = spots.groupBy("item").agg(F.count("*").alias("all"), F.count_if(~F.col("few")).alias("wides"))
    share = F.greatest(F.col("windows") / F.col("all"), F.when(F.col("wides") > 0, F.col("wide") / F.col("wides")))
    good = lined.where(one).join(total, "item").withColumn("coverage", share).where(F.col("coverage") >= coverage)
    best = good.groupBy("id", "item").agg(F.max(F.struct("windows", "coverage", F.size("slots").alias("slots"), F.forall("slots", lambda s: s["theirs"] == s["ours"]).alias("verbatim"))).alias("b"))
    return best.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "b.windows", "b.coverage", "b.slots", "b.verbatim")
