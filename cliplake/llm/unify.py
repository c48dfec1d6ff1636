"""One consistent form of text that looks the same: invisible characters, spaces, accents, wide and joined forms, look-alikes.

Values that hold no character the mappings change, and no letters of two scripts, are already consistent and
pass through. Of the others, each distinct value is exploded to positioned code points, which meet three broadcast mappings built from the
Unicode data by rule (their size is fixed by Unicode): decompositions with combining classes, look-alike
letters, and compositions. Combining marks are ordered by class within their cluster, clusters recomposed,
and the string rebuilt by position.

What changes: invisible characters go (joiners and variation selectors stay inside emoji), every kind of
space becomes U+0020, letters with separate accents are composed, wide and joined forms of letters and
digits become the ordinary ones, and a letter of another script that stands in for a look-alike within a
word becomes the letter of the word's own script. A word is changed only if all its foreign letters have such
a look-alike, so none is swapped by halves. Words wholly in one script, wide punctuation, emoji (with their
joiners, selectors and flag tags), signs and symbols stay. Defined results: NULL stays NULL, '' stays ''; a value of only invisible characters
becomes ''; repeated values count once here and come back with every row that has them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliplake.sources.tables import table

#: Look-alike letters (fixed values): Latin, then the Cyrillic and Greek letters of the same look.
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ", "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј",
    "o": "оο", "p": "рρ", "s": "ѕ", "v": "ν", "x": "х", "y": "у", "h": "һ", "d": "ԁ", "q": "ԛ", "w": "ԝ",
}
#: The same for Armenian and Cherokee letters, which only stand in for Latin ones.
RARE_LOOK_ALIKES = {
    "A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "O": "Օ", "P": "Ꮲ", "R": "Ꭱ",
    "S": "ՏᏚ", "T": "Ꭲ", "U": "Ս", "V": "Ꮩ", "W": "Ꮃ", "Z": "Ꮓ", "g": "ց", "h": "հ", "j": "յ", "o": "օ", "q": "զ", "u": "ս",
}
#: Non-ordinary spaces are all of category Zs but U+0020. Invisible: category Cf, and these.
MORE_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f"


def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    for s in ("LATIN", "CYRILLIC", "GREEK"):
        if name.startswith((s, f"FULLWIDTH {s}")):
            return s[0]
    return "O" if name.startswith(("ARMENIAN", "CHEROKEE")) else ""


@lru_cache(1)
def characters() -> list[tuple]:
    """(ch, kind, parts, ccc, script, latin, cyrillic, greek, letter) of every character that is not plain.

    kind: 'invisible', 'space', 'form' (wide or joined letter or digit), 'canon' (decomposes canonically),
    'mark', 'look' (has a look-alike), 'emoji' (what a joiner or selector may follow), '' otherwise.
    """
    twins: dict[str, dict[str, str]] = {}
    for latin, others in LOOK_ALIKES.items():
        family = {"L": latin} | {_script(o): o for o in others}
        for c in family.values():
            twins[c] = family
    for latin, others in RARE_LOOK_ALIKES.items():
        twins |= {o: twins.get(latin, {"L": latin}) for o in others}
        twins.setdefault(latin, {"L": latin})
    out = []
    for cp in (9, 11, 12, *range(0x20, 0x110000)):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat in ("Cn", "Cs", "Co"):
            continue
        kind, parts = "", c
        dec = unicodedata.decomposition(c)
        ccc = unicodedata.combining(c)
        letter = cat[0] in "LN" or cat[0] == "M"
        if cat == "Cf" or c in MORE_INVISIBLE or 0xE0100 <= cp <= 0xE01EF:
            kind = "invisible"
        elif cat == "Zs" and c != " " or c in "\t\x0b\x0c\x85\u2028\u2029":
            kind = "space"
            parts = " "
        elif dec and not dec.startswith("<") and not 0xAC00 <= cp <= 0xD7A3:
            if unicodedata.normalize("NFC", c) == c:
                kind, parts = "canon", unicodedata.normalize("NFD", c)
            else:
                kind, parts = ("form" if cat[0] == "L" else "canon"), unicodedata.normalize("NFD", c)
        elif dec.startswith(("<wide>", "<narrow>")) and cat[0] in "LN":
            kind, parts = "form", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
        elif dec.startswith("<compat>") and 0xFB00 <= cp <= 0xFB17 or 0x1D400 <= cp <= 0x1D7FF:
            kind, parts = "form", unicodedata.normalize("NFKD", c)
        elif ccc:
            kind = "mark"
        elif c in twins:
            kind = "look"
        elif cat in ("So", "Sk", "Sm") and cp > 0x2000:
            kind = "emoji"
        script = _script(c) if cat[0] == "L" else ""
        if not kind and not script and not (letter and cp < 0x80):
            continue
        family = twins.get(parts if len(parts) == 1 else c, {})
        out.append((c, kind, parts, ccc, script, family.get("L"), family.get("C"), family.get("G"), letter))
    return out


@lru_cache(1)
def compositions() -> list[tuple[str, str]]:
    """(decomposed, composed) of every character that normal form C keeps."""
    pairs = []
    for cp in range(0xC0, 0x110000):
        c = chr(cp)
        dec = unicodedata.decomposition(c)
        if dec and not dec.startswith("<") and not 0xAC00 <= cp <= 0xD7A3 and unicodedata.normalize("NFC", c) == c:
            pairs.append((unicodedata.normalize("NFD", c), c))
    return pairs


#: Holds every character that the mappings change (and some more): marks, invisible characters, spaces, forms, letters with a canonical twin, what the JVM doesn't know yet.
SUSPECT = (
    r"[\p{M}\p{Cf}\p{Cn}\t\x0b\x0c\x{85}\x{2028}\x{2029}\x{115f}\x{1160}\x{3164}\x{ff00}-\x{ffef}\x{fb00}-\x{fb4f}\x{f900}-\x{faff}\x{1f00}-\x{1fff}\x{374}\x{37e}\x{387}\x{2000}-\x{200f}"
    r"\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{fb9}\x{1d15e}-\x{1d1c0}\x{1d400}-\x{1d7ff}\x{2f800}-\x{2fa1f}]"
    r"|[\p{Zs}&&[^ ]]"
)
_SCRIPTS = (r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}", r"[\p{IsArmenian}\p{IsCherokee}]")


def plain(c: Column) -> Column:
    """Whether the value is certainly consistent: no character of SUSPECT, and letters of one of the look-alike scripts at most."""
    scripts = reduce(Column.__add__, [c.rlike(s).cast("int") for s in _SCRIPTS])
    return c.rlike(r"^[\x20-\x7e\r\n]*$") | (~c.rlike(SUSPECT) & (scripts < 2))


def unified(values: DataFrame, column: str = "value") -> DataFrame:
    """Distinct non-plain values with ``form`` (the consistent one) and ``found`` (whether it is a true case)."""
    spark = values.sparkSession
    chars = F.broadcast(
        spark.createDataFrame(characters(), "ch string, kind string, parts string, ccc int, script string, latin string, cyr string, grk string, letter boolean")
    )
    comp = F.broadcast(spark.createDataFrame(compositions(), "cluster string, composed string"))
    v = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull() & ~plain(F.col("value")))
    # The characters carry a digest of their value, not the value: a long one would be repeated per character.
    # Grouping by the digest leaves the rows where all windows below want them: the one shuffle of values. Its
    # number of partitions is set, as their bytes say nothing of the characters they hold.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = v.withColumn("vid", F.unhex(F.sha2("value", 256))).repartition(parts, "vid").groupBy("vid").agg(F.first("value").alias("value"))
    at = v.select("vid", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)(.)"), 1)).alias("pos", "ch"))
    at = at.join(chars, "ch", "left").withColumn("kind", F.coalesce("kind", F.lit(""))).withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    by_pos = Window.partitionBy("vid").orderBy("pos")
    # Joiners and selectors belong to an emoji if the visible character before them does, or another part of it.
    joiner = F.col("ch").isin("\u200d", "\ufe0f", "\ufe0e")
    emoji = (F.col("kind") == "emoji") | F.col("ch").rlike(r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}]|[#*0-9]|\x{200D}|\x{FE0F}")
    kept = joiner & F.coalesce(F.lag(emoji).over(by_pos), F.lit(False)) & ((F.col("ch") != "\u200d") | F.coalesce(F.lead(F.col("ch").rlike(r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}]")).over(by_pos), F.lit(False)))
    tag = F.col("ch").rlike(r"[\x{E0020}-\x{E007F}]")  # tags belong to the flag before them
    flag = F.last(F.when(~tag, F.col("ch")), ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)) == "\U0001f3f4"
    kept = kept | (tag & F.coalesce(flag, F.lit(False)))
    at = at.withColumn("kind", F.when(kept, "").otherwise(F.col("kind")))
    at = at.withColumn("parts", F.when(F.col("kind") == "invisible", "").otherwise(F.coalesce("parts", "ch")))
    # Words: letters, digits, marks; invisible characters do not end a word.
    inner = F.coalesce("letter", F.col("ch").rlike(r"[\p{L}\p{N}\p{M}]")) | (F.col("kind") == "invisible")
    at = at.withColumn("word", F.sum(F.when(inner, 0).otherwise(1)).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    in_word = Window.partitionBy("vid", "word")
    twin = F.col("latin").isNotNull()
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(in_word)
    forms = {"L": F.col("latin"), "C": F.col("cyr"), "G": F.col("grk")}
    for s, form in forms.items():
        mine = F.col("script") == s
        at = at.withColumn(f"own{s}", count(mine & ~twin)).withColumn(f"all{s}", count(mine))
        at = at.withColumn(f"bad{s}", count(F.col("script").isin(*forms, "O") & ~mine & form.isNull()))
    at = at.withColumn("allO", count(F.col("script") == "O"))
    # The word's script: one in which every letter has a form; of those the one with most letters of its own
    # look, then with most letters; Latin on ties.
    rank = lambda s, tie: F.struct((F.col(f"bad{s}") == 0).alias("fits"), F.col(f"own{s}").alias("o"), F.col(f"all{s}").alias("a"), F.lit(tie).alias("t"), F.lit(s).alias("s"))
    best = F.greatest(rank("L", 2), rank("C", 1), rank("G", 0))
    at = at.withColumn("main", F.when(best["fits"], best["s"]))
    target = F.when(F.col("main") == "L", F.col("latin")).when(F.col("main") == "C", F.col("cyr")).otherwise(F.col("grk"))
    mixed = reduce(Column.__add__, [F.col(f"all{s}").cast("boolean").cast("int") for s in (*forms, "O")]) > 1
    swapped = twin & mixed & (F.col("script") != F.col("main")) & target.isNotNull()
    at = at.withColumn("swap", swapped).withColumn("parts", F.when(swapped, target).otherwise(F.col("parts")))
    # A case: a changed character of one of the named kinds, or an accent that could have been composed.
    at = at.withColumn("hit", F.coalesce(F.col("swap") | F.col("kind").isin("invisible", "space", "form"), F.lit(False)))
    # Decompose, order marks by class within their cluster, recompose. Characters that go keep a row without a
    # letter, for their flag.
    sub = at.select("vid", "pos", "hit", (F.col("kind") == "mark").alias("mark"), F.posexplode_outer(F.regexp_extract_all("parts", F.lit(r"(?s)(.)"), 1)).alias("sub", "c"))
    marks = chars.select(F.col("ch").alias("c"), F.col("ccc").alias("cls"))
    sub = sub.join(F.broadcast(marks), "c", "left").withColumn("cls", F.coalesce("cls", F.lit(0)))
    by_sub = Window.partitionBy("vid").orderBy("pos", "sub")
    starts = F.when(F.col("c").isNotNull() & (F.col("cls") == 0), 1).otherwise(0)
    sub = sub.withColumn("cluster_no", F.sum(starts).over(by_sub.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("cls", "pos", "sub", "c"))))
    joined = sub.groupBy("vid", "cluster_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("cluster"), F.max("cls").alias("top"), F.count("c").alias("n"), F.bool_or("hit").alias("hit"), F.bool_or("mark").alias("mark")
    )
    joined = joined.join(comp, "cluster", "left")
    # Clusters with further marks than a composed letter holds are composed one by one: exact, and rare.
    rest = F.pandas_udf(lambda s: s.map(lambda x: unicodedata.normalize("NFC", x) if x else x), "string")
    joined = joined.withColumn("composed", F.coalesce("composed", F.when((F.col("top") > 0) & (F.col("n") > 1), rest(F.when((F.col("top") > 0) & (F.col("n") > 1), F.col("cluster")))), "cluster"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cluster_no", "composed"))), lambda x: x["composed"]), "")
    out = joined.groupBy("vid").agg(whole.alias("form"), F.bool_or("hit").alias("hit"), F.bool_or("mark").alias("marks")).join(v, "vid")
    return out.select("value", "form", (F.col("hit") | (F.col("marks") & (F.col("form") != F.col("value")))).alias("found"))


FIELDS = (("videos.title", "videos", "id", "title"), ("videos.uploader", "videos", "id", "uploader"), ("vision_descriptions.text_in_frame", "vision_descriptions", "keyframe_id", "text_in_frame"))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """source_field, record_key, value, form, found of every distinct value of every record."""
    rows = [
        table(spark, folder, t).select(F.lit(f).alias("source_field"), F.col(k).cast("string").alias("record_key"), F.col(c).alias("value")).where("value IS NOT NULL")
        for f, t, k, c in FIELDS
    ]
    rows = reduce(DataFrame.unionByName, rows)
    odd = rows.where(~plain(F.col("value")))
    same = rows.where(plain(F.col("value"))).select("source_field", "record_key", "value", F.col("value").alias("form"), F.lit(False).alias("found"))
    return odd.join(unified(odd), "value").select("source_field", "record_key", "value", "form", "found").unionByName(same).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a value that looks ordinary and is not."""
    return p5_forms(spark, folder).where("found").select("source_field", "record_key").distinct()


_CG = "".join(o for others in LOOK_ALIKES.values() for o in others)
_LT = "".join(LOOK_ALIKES)
_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}]"
_IN = r"[\p{L}\p{N}\p{M}]*"
#: The cases in SQL, by patterns over the text without whole emoji (no forms, only whether a value is a case).
P5_SQL = f"""WITH v AS (SELECT 'videos.title' AS source_field, id AS record_key, title AS t FROM videos UNION ALL SELECT 'videos.uploader', id, uploader FROM videos
  UNION ALL SELECT 'vision_descriptions.text_in_frame', CAST(keyframe_id AS VARCHAR), text_in_frame FROM vision_descriptions),
w AS (SELECT *, regexp_replace(t, '{_EMOJI}(\\x{{FE0F}}|\\x{{200D}}{_EMOJI}\\x{{FE0F}}?)*', '', 'g') AS e FROM v WHERE t IS NOT NULL),
x AS (SELECT *, regexp_replace(e, '[\\p{{Cf}}]', '', 'g') AS b FROM w)
SELECT DISTINCT source_field, record_key FROM x WHERE regexp_matches(e, '[\\p{{Cf}}\\x{{FE0F}}\\x{{FE0E}}]') OR regexp_matches(e, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')
  OR nfc_normalize(t) <> t OR regexp_matches(t, '[０-９Ａ-Ｚａ-ｚﬀ-ﬆ]')
  OR regexp_matches(b, '\\p{{Latin}}{_IN}[{_CG}]|[{_CG}]{_IN}\\p{{Latin}}|[{_LT}]{_IN}[\\p{{Cyrillic}}\\p{{Greek}}]|[\\p{{Cyrillic}}\\p{{Greek}}]{_IN}[{_LT}]')"""
