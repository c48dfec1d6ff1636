import unicodedata

from cliplake.llm.unify import p5_found, unified

CASES = {
    "the ring lig⁠ht": "the ring light",
    "a b　c": "a b c",
    "café": "café",
    "ＡＢｃ １": "ABc 1",
    "ﬁne": "fine",
    "реople": "people",
    "Tихий": "Тихий",
    "​": "",
    "q̣̇": None,
    "q̣̇x": "q̣̇x",
    "ΚΕRΝEL": "KERNEL",
    "THE NЕХТ": "THE NEXT",
    "CΟΝ": "CON",
    "АNО": "ANO",
    "é‍x": "éx",
}
CASES |= {
    "a\U000e0100b": "ab",
    "x\U000e0001y": "xy",
    "a\U000e0061\U000e0062": "a",
    "\U0002f800": "\u4e3d",
    "\u13abve": None,
    "\u13aary": "Ary",
    "g\u0585ld": "gold",
    "tab\there": "tab here",
}
PLAIN = ["\u0442\u0435st", "\u0562\u0561\u0580\u0565\u057e", "\u13e3\u13b3\u13a9", "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f ok", "Тихий двор", "夜市ノート", "次の配信！", "👨‍👩‍👧 ok", "❤️ x", "π ≈ 3", "№ 5 → 20°C", "Señor Müde", "Ελλάδα", "한국어", "½ ™ ²", "THE CHANNEL Π", "", "plain", None]


def forms(spark, values):
    df = spark.createDataFrame([(v, "x", 1) for v in values], "value string, form string, pos int")
    return {r.value: (r.form, r.found) for r in unified(df).collect()}


def test_cases(spark):
    got = forms(spark, list(CASES) + list(CASES))
    for v, want in CASES.items():
        if want is not None:
            assert got[v] == (want, True), (ascii(v), got[v])


def test_ordinary_values_stay(spark):
    got = forms(spark, PLAIN)
    for v, (form, found) in got.items():
        assert form == v and not found, (ascii(v), ascii(form))
    assert "plain" not in got and None not in got and "" not in got


def test_prefilter_holds_every_character_that_changes(spark):
    """A value that passes as plain has none of the characters that the mappings change."""
    from pyspark.sql import functions as F

    from cliplake.llm.unify import characters, plain

    odd = [c for c, kind, *_ in characters() if kind in ("invisible", "space", "form", "mark") or kind == "canon" and unicodedata.normalize("NFC", c) != c]
    assert len(odd) > 2000
    df = spark.createDataFrame([(f"a{c}b",) for c in odd], "v string")
    assert [ascii(r.v) for r in df.where(plain(F.col("v"))).collect()] == []
    assert spark.createDataFrame([("Señor Müde",), ("夜市ノート",), ("Тихий двор 1",)], "v string").where(plain(F.col("v"))).count() == 3


def test_composition_equals_the_standard(spark):
    bases, marks = "aeoAnquz", "̸̧̣́̂̇"
    values = [b + m1 + m2 for b in bases for m1 in marks for m2 in marks]
    got = forms(spark, values)
    for v in values:
        assert got[v][0] == unicodedata.normalize("NFC", v), ascii(v)
        assert got[v][1] == (unicodedata.normalize("NFC", v) != v)


def test_one_form_of_equal_looks(spark):
    got = forms(spark, ["ｃａｆé", "café", "c­afé", "саfé"])
    assert {f for f, _ in got.values()} == {"café"}


def test_long_value(spark):
    v = "é" + "wоrd " * 20_000
    form, found = forms(spark, [v])[v]
    assert found and form == "é" + "word " * 20_000


def test_query(spark):
    df = p5_found(spark, "/root/testdata/sf0.001")
    assert df.columns == ["source_field", "record_key"] and df.count() == df.distinct().count()
