import pytest
from pyspark.sql import functions as F

from brindle.llm.sentences import sentence_units, unit_ends


def units(text, language=None):
    out, before = [], 0
    for end in unit_ends(text, language):
        out.append(text[before:end].strip())
        before = end
    return out


CASES = [
    ("en", "Dr. Smith paid $3.50. He left at 5 p.m. without a word.", ["Dr. Smith paid $3.50.", "He left at 5 p.m. without a word."]),
    ("en", 'She wrote: "Stop. Go home." and left. Nobody knew.', ['She wrote: "Stop. Go home." and left.', "Nobody knew."]),
    ("en", "It costs 3 (see no. 4. It is big). Fine!", ["It costs 3 (see no. 4. It is big).", "Fine!"]),
    ("en", "One ends here.The next lacks a blank. fooBar comes third.", ["One ends here.", "The next lacks a blank.", "fooBar comes third."]),
    ("de", "Die 3. Zeile braucht ca. 4 ms. Am 3. Mai z. B. nicht.", ["Die 3. Zeile braucht ca. 4 ms.", "Am 3. Mai z. B. nicht."]),
    ("fr", "M. Durand a dit : « Non. Partez. » avant de partir. Voir p. 5.", ["M. Durand a dit : « Non. Partez. » avant de partir.", "Voir p. 5."]),
    ("es", "¿Por qué? El Sr. P. Ruiz llegó.", ["¿Por qué?", "El Sr. P. Ruiz llegó."]),
    ("ru", "Это стр. 5, т. е. конец. Узел упал.", ["Это стр. 5, т. е. конец.", "Узел упал."]),
    ("el", "Γιατί χάνει; Το αρχείο π.χ. αυτό.", ["Γιατί χάνει;", "Το αρχείο π.χ. αυτό."]),
    ("zh", "评审写道：“停。先清空。”然后关闭了。为什么？好……再见。", ["评审写道：“停。先清空。”然后关闭了。", "为什么？", "好……", "再见。"]),
    ("ja", "担当者は「待って。」と書いた。終わり！", ["担当者は「待って。」と書いた。", "終わり！"]),
    ("hi", "दर 0.66 % है। क्यों? ठीक।", ["दर 0.66 % है।", "क्यों?", "ठीक।"]),
    ("th", "ห้ามแก้ไข ทำไมจึงหายไป", ["ห้ามแก้ไข", "ทำไมจึงหายไป"]),
    ("ar", "لماذا؟ لا تعدل!", ["لماذا؟", "لا تعدل!"]),
    ("en", "Do this:\n1. One. two\n2. Three\n3) Four\n\nThe year\n2010. It ended.", ["Do this:", "1. One. two", "2. Three", "3) Four", "The year\n2010.", "It ended."]),
    (None, "# A head. Two\ntext here\ngoes on\n\n* one. two\n* three\n```\nx. y\n\nz\n```\nend", ["# A head. Two", "text here\ngoes on", "* one. two", "* three", "```\nx. y\n\nz\n```", "end"]),
]


@pytest.mark.parametrize("language,text,want", CASES)
def test_units(language, text, want):
    assert units(text, language) == want


def test_positions_are_code_points_and_long_texts_are_whole():
    assert unit_ends("😢 no. Yes.\r\n") == [5, 10]
    assert len(unit_ends("Abc def. " * 20000)) == 20000
    assert unit_ends(None) == unit_ends("") == unit_ends(" \n\t") == []
    assert unit_ends("(" * 3000) and unit_ends("```\nnever closed") == [16]


def test_operator(spark):
    rows = [(1, "One. Two.", "en"), (2, None, None), (3, "", "xx"), (None, "Three.", "EN"), (1, "One. Two.", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit(1) for c in ("unit", "end_pos", "sentence")})
    got = sorted((r.doc_id or 0, r.unit, r.start_pos, r.end_pos, r.sentence) for r in sentence_units(df).collect())
    assert got == [(0, 0, 0, 6, "Three."), (1, 0, 0, 4, "One."), (1, 0, 0, 4, "One."), (1, 1, 5, 9, "Two."), (1, 1, 5, 9, "Two.")]
    assert sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("left,right", ["()", "[]", "「」", "„“", "“”", "«»", '""', ("((", "))")])
def test_quotes_and_brackets_of_any_length(left, right):
    inside = "One more ends here. " * 60 + "Last."
    text = f"They wrote {left}{inside}{right} and left."
    assert units(text + " Nobody knew.", "en") == [text, "Nobody knew."]
