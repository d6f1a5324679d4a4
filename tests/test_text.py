from panelrisk.functions import text


def test_folding_takes_any_latin_letter(spark):
    words = ["Éźïĝ Ñandú", "Ștéfan Čapek", "ẹ̀ Ọ̀", "Zażółć", None]
    got = [r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.fold_accents("w").alias("f")).collect()]
    assert got == ["ezig nandu", "stefan capek", "e o", "zazołc", None]


def test_abbreviations():
    assert [text.expand_abbreviation(t) for t in ("st malo", "ste-anne", "st-lo", "stade", "ste", "ust x")] == ["saint malo", "sainte-anne", "saint-lo", "stade", "ste", "ust x"]
