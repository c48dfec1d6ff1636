"""Text values cut off by a field limit or a broken transfer, and how often each source truncates.

Lengths: for every source and measure (characters, UTF-8 bytes) the discrete hazard h(L) = values of length L
/ values of length L or more is tested against the pooled hazard of the neighbouring lengths (binomial tail),
with the false-discovery rate controlled over all lengths (Benjamini-Hochberg). Endings: for a value's last
characters and its last word the corpus tells how often they end a value and how they go on: within a word
or a fixed phrase, or after a word that never ends a value. At a significant length most values are cut, so
a weaker sign suffices there; elsewhere only clearly incomplete endings count. A replacement character or a joiner at the
very end is a broken character.

Everything is counted over all values (one value per key); only hazards (one row per source and length) are
tested in Python. Defined results: NULL and blank values are not judged; a mark ('...' or an ellipsis) is
taken off before the ending is judged, and alone is no sign; equal values are counted once per key.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplake.llm.unify import LOOK_ALIKES
from cliplake.session import written
from cliplake.sources.tables import table

GRAMS = (12, 8, 5, 3)
FEW_SOURCES = 10_000
PIECE = 240
NEIGHBOURS, FALSE_DISCOVERY, MIN_EXCESS = 8, 0.01, 3.0
#: A limit ends a good share of all values that get as far; a length at which titles of one pattern meet does not.
MIN_HAZARD = 0.2
#: At a significant length, an ending that ends fewer of its other occurrences is taken for a cut one.
NATURAL_AT_LIMIT = 0.25
#: Elsewhere an ending is incomplete only if it (nearly) never ends a value and (nearly) always goes on in one way.
RARE_END, MOSTLY, NEVER = 0.04, 0.95, 0.008
MARK = r"(?:\.{2,}|…)\s*$"
_TO_LATIN = {ord(o): latin for latin, others in LOOK_ALIKES.items() for o in others}


def folded(text: str | None) -> str | None:
    """Same look, same letters: compatibility form, lower case, digits as 0, no invisible characters."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text)
    t = "".join(c for c in t if unicodedata.category(c) != "Cf" or c == "‍")
    words = [w.translate(_TO_LATIN) if re.search("[a-zA-Z]", w) else w for w in re.split(r"(\s+)", t)]
    return re.sub(r"\d", "0", "".join(words).lower())


_fold = F.pandas_udf(lambda s: s.map(folded), T.StringType())


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz); few terms where x < (a + 1) / (a + b + 2)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 100_000):
        for f in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + f * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + f / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return h


def _tail(n: int, k: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p): the regularised incomplete beta function I_p(k, n - k + 1), in a time that hardly grows with n."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = float(k), float(n - k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p))
    if p < (a + 1) / (a + b + 2):
        return min(1.0, front * _fraction(a, b, p) / a)
    return max(0.0, min(1.0, 1 - front * _fraction(b, a, 1 - p) / b))


@F.pandas_udf(T.DoubleType())
def _p_value(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([_tail(int(a), int(b), float(c)) for a, b, c in zip(n, k, p)])


def hazards(values: DataFrame) -> DataFrame:
    """source, measure, length, n, at_risk, hazard, near, p_value, significant; of (source, value)."""
    sizes = F.array(
        F.struct(F.lit("chars").alias("measure"), F.length("value").alias("length")),
        F.struct(F.lit("bytes").alias("measure"), F.octet_length(F.regexp_replace("value", "�+$", "")).alias("length")),
    )
    counts = values.select("source", F.explode(sizes).alias("x")).groupBy("source", "x.measure", "x.length").agg(F.count("*").alias("n"))
    own = Window.partitionBy("source", "measure")
    down = own.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("at_risk", F.sum("n").over(down)).withColumn("hazard", F.col("n") / F.col("at_risk"))
    around = own.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    # Neighbouring lengths without values have no row but the same values at risk as the next longer one.
    risk = (F.sum("at_risk").over(around) - F.col("at_risk")) * (2.0 * NEIGHBOURS) / F.greatest(F.count("*").over(around) - 1, F.lit(1))
    near = (F.sum("n").over(around) - F.col("n") + 0.5) / (risk + 1.0)
    counts = counts.withColumn("near", F.least(near, F.lit(0.999)))
    counts = counts.withColumn("p_value", _p_value("at_risk", "n", "near"))
    ranked = counts.withColumn("rank", F.row_number().over(own.orderBy("p_value", "length"))).withColumn("m", F.count("*").over(own))
    passes = F.col("p_value") <= F.col("rank") / F.col("m") * FALSE_DISCOVERY
    last = F.max(F.when(passes, F.col("rank"))).over(own)
    significant = (F.col("rank") <= last) & (F.col("hazard") >= MIN_EXCESS * F.col("near")) & (F.col("hazard") >= MIN_HAZARD)
    return ranked.withColumn("significant", F.coalesce(significant, F.lit(False))).drop("rank", "m")


def _limits(values: DataFrame) -> DataFrame:
    """source, chars, bytes: the significant lengths of the measure that explains more values of the source."""
    found = hazards(values).where("significant").groupBy("source", "measure").agg(F.max("n").alias("most"), F.collect_set("length").alias("lengths"))
    best = Window.partitionBy("source").orderBy(F.desc("most"), F.desc("measure"))
    found = found.withColumn("r", F.row_number().over(best)).where("r = 1")
    pick = lambda m: F.when(F.col("measure") == m, F.col("lengths")).alias(m)
    return found.select("source", pick("chars"), pick("bytes"))


def _continuations(rows: DataFrame, position: Column, keys: list[str]) -> DataFrame:
    """keys, total, ends, letters, top: how often a string occurs, ends a value, goes on with a letter, its commonest next.

    rows: text, suspect; position: array of structs with ``keys`` and ``nxt`` ('' at the end of the value).
    Values that may be cut themselves count as neither going on nor ending where they end.
    """
    seen = rows.select("suspect", F.explode(position).alias("x")).select("suspect", "x.*").where((F.col("nxt") != "") | ~F.col("suspect"))
    seen = seen.groupBy(*keys, "nxt").agg(F.count("*").alias("c"))
    on = F.col("nxt") != ""
    return seen.groupBy(*keys).agg(
        F.sum("c").alias("total"),
        F.sum(F.when(~on, F.col("c")).otherwise(0)).alias("ends"),
        F.sum(F.when(F.col("nxt").rlike(r"^[\p{L}\p{M}]"), F.col("c")).otherwise(0)).alias("letters"),
        F.max(F.when(on, F.col("c")).otherwise(0)).alias("top"),
    )


def truncated(values: DataFrame) -> DataFrame:
    """key, source, value, at_limit, marked, natural, cut; of (key, source, value), one row per key."""
    v = values.where("value IS NOT NULL AND trim(value) != ''")
    limits = _limits(v)
    few = limits.limit(FEW_SOURCES + 1).collect()
    if len(few) <= FEW_SOURCES:  # one row per source: sent to all tasks if they are few, else joined like any table
        limits = F.broadcast(v.sparkSession.createDataFrame(few, limits.schema))
    v = v.join(limits, "source", "left")
    at = F.coalesce(F.array_contains("chars", F.length("value")), F.lit(False)) | F.coalesce(F.array_contains("bytes", F.octet_length(F.regexp_replace("value", "\ufffd+$", ""))), F.lit(False))
    v = v.withColumn("at_limit", at).drop("chars", "bytes")
    v = v.withColumn("marked", F.col("value").rlike(MARK)).withColumn("broken", F.col("value").rlike("[\ufffd\u200d]$"))
    v = v.withColumn("suspect", F.col("at_limit") | F.col("broken"))
    v = v.withColumn("text", F.rtrim(F.regexp_replace(F.regexp_replace(_fold("value"), MARK, ""), "[\ufffd\u200d]+$", "")))
    v = written(v, "endings")  # it is read five times below
    rows = v.select("text", "suspect")

    # Every position of every value: what follows its last n characters, and what follows each word. Long
    # values are read in pieces, as a position of a long string is only found by counting from its start.
    lead = F.least(F.col("c"), F.lit(max(GRAMS) - 1))
    pieces = rows.where("text != ''").select("suspect", "text", F.length("text").alias("size"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(PIECE))).alias("c"))
    pieces = pieces.select("suspect", lead.alias("lead"), F.least(F.lit(PIECE), F.col("size") - F.col("c")).alias("ends"), F.substring(F.col("text"), F.col("c") - lead + 1, lead + PIECE + 1).alias("piece"))

    def windows(n: int) -> Column:
        def one(j: Column) -> Column:
            return F.struct(F.lit(n).alias("n"), F.substring(F.col("piece"), j - n + 1, F.lit(n)).alias("gram"), F.substring(F.col("piece"), j + 1, F.lit(1)).alias("nxt"))

        first, last = F.greatest(F.col("lead") + 1, F.lit(n)), F.col("lead") + F.col("ends")
        return F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(F.array()), one)

    after = _continuations(pieces, F.flatten(F.array(*[windows(n) for n in GRAMS])), ["n", "gram"])
    words = F.split("text", r"\s+")
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get("words", i + 1), F.lit("")).alias("nxt")))
    after_word = _continuations(rows.select("suspect", words.alias("words")), pairs, ["word"])

    own = (~F.col("suspect")).cast("int").alias("self")
    ends = F.array(*[F.struct(F.lit(n).alias("n"), F.expr(f"right(text, {n})").alias("gram")) for n in GRAMS])
    mine = v.select("key", own, F.explode(ends).alias("x")).select("key", "self", "x.n", "x.gram").join(after, ["n", "gram"])
    # Without the value itself; the longest ending seen often enough elsewhere decides.
    mine = mine.withColumn("total", F.col("total") - F.col("self")).withColumn("ends", F.col("ends") - F.col("self")).where("total >= 4")
    judged = mine.groupBy("key").agg(F.max(F.struct("n", "total", "ends", "letters", "top")).alias("g"))
    last = v.select("key", own, F.element_at(words, -1).alias("word")).join(after_word, "word")
    last = last.select("key", F.struct((F.col("total") - F.col("self")).alias("total"), (F.col("ends") - F.col("self")).alias("ends"), "top").alias("w"))
    v = v.join(judged, "key", "left").join(last, "key", "left")

    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    unspaced = F.col("text").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]$")
    lettered = F.col("text").rlike(r"[\p{L}\p{M}]$") & ~unspaced
    rare_end = share("g.ends", "g.total") <= RARE_END
    tag = F.col("text").rlike(r"#\S*$")  # a tag is free to end anywhere a known one does, so it needs more evidence
    in_word = lettered & rare_end & (share("g.letters", "g.total") >= MOSTLY) & (F.col("g.total") >= F.when(tag, 16).when(F.col("g.n") < 8, 12).otherwise(5))
    in_phrase = unspaced & rare_end & (share("g.top", "g.total") >= MOSTLY)
    open_word = rare_end & (F.col("w.total") >= 100) & (share("w.ends", "w.total") < NEVER)
    half_name = rare_end & (F.col("w.total") >= 12) & (F.col("w.ends") == 0) & (share("w.top", "w.total") >= MOSTLY)
    incomplete = in_word | in_phrase | (lettered & (open_word | half_name))
    natural = F.col("g.ends") / F.col("g.total")
    v = v.withColumn("natural", natural).withColumn("incomplete", F.coalesce(incomplete, F.lit(False)))
    spaced = F.col("value").rlike(r"\s$")
    at_limit_cut = F.when(F.col("marked"), F.coalesce("natural", F.lit(0.0)) < 0.9).otherwise(spaced | (F.coalesce("natural", F.lit(0.0)) < NATURAL_AT_LIMIT))
    cut = F.col("broken") | F.col("incomplete") | (F.col("at_limit") & at_limit_cut)
    return v.select("key", "source", "value", "at_limit", "marked", "natural", "incomplete", cut.alias("cut"))


def titles(videos: DataFrame) -> DataFrame:
    """One title per video (re-crawls never change it; of differing ones the latest counts)."""
    rows = videos.where("id IS NOT NULL AND title IS NOT NULL")
    return rows.groupBy(F.col("id").alias("key")).agg(F.max(F.struct("updated_at", "title", "platform")).alias("r")).select("key", F.coalesce("r.platform", F.lit("")).alias("source"), F.col("r.title").alias("value"))


def p6_truncated(spark, folder: str) -> DataFrame:
    return truncated(titles(table(spark, folder, "videos")))


def p6_found(spark, folder: str) -> DataFrame:
    """Videos whose title was cut off."""
    return p6_truncated(spark, folder).where("cut").select(F.col("key").alias("video_id"))


def p6_rates(spark, folder: str) -> DataFrame:
    """Titles, cut titles and their share for each platform."""
    t = p6_truncated(spark, folder).groupBy(F.col("source").alias("platform"))
    return t.agg(F.count("*").alias("n_titles"), F.count_if("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_titles"))
