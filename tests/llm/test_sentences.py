import pytest

from docloom.llm.sentences import sentence_units, sentences


def cut(text):
    return [text[a:b] for a, b in sentence_units(text)]


CASES = [
    ["# Title", "One here.", "Two there!"],
    ["Dr. Mardal asked why.", "On Dec. 7 the store moved."],
    ["Keep the logs, dumps, etc.", "Set `x.y` to 3."],
    ["Keep the logs, etc. and the dumps."],
    ["It waits ... and then drops.", "It waits…", "Then it drops."],
    ["He said that “Lease lost? Gate closed!” means nothing.", "It noted: “Gate closed.”", "Next one."],
    ["Die Regel lautet: „Das Kapitel fehlt.“", "Vgl. Nr. 266 bzw. Abs. 10, d. h. z. B. das Paar."],
    ["Am 16. Mai bestätigt er 27,2.", "Der Rest folgt."],
    ["« Rien à faire ! » répond M. Kelmar.", "Le journal indique : « Tout va. »", "Selon l’art. 3, p. ex. `X`."],
    ["Escribe «¿Falta algo? ¡Nada!» y espera.", "La Sra. Orhol pregunta.", "¡Nunca!"],
    ["Пишет: «Где кэш? Нет доступа!», и ждёт.", "«Нет доступа!» — пишет ключ.", "См. рис. 246 и п. 3, т. е. всё, и т. д.", "Значение выросло."],
    ["See v3.7.1.", "The file a_b.json is at https://wiki.Kel.example/p?id=1&v=1.2 now.", "Done?"],
    ["Nev Inc. and Ist Ltd. share one.", "By 9 a.m. at the latest.", "(See Sec. 18.9 for it.)", "K. Or and M. R. Dun own it."],
    ["क्या सूची है?", "मान 8.6 से अधिक है।", "अंत।"],
    ["هل يحفظ؟", "القيمة 39.1 أكبر من 4.1، لذلك يفحص."],
]


@pytest.mark.parametrize("units", CASES)
def test_spaced(units):
    heads = units[0].startswith("#")
    text = (units[0] + "\n\n" + "  ".join(units[1:])) if heads else " ".join(units)
    assert cut(text) == units


@pytest.mark.parametrize(
    "units",
    [
        ["なぜ置き換えるのか？", "「見出しが無い。」とKelは表示する。", "注記：「変更する。」", "担当者は「書いた！」と言う。", "本当に無事なのか！？", "終わり。"],
        ["“章节不存在。”是唯一的提示。", "他写道：“请检查！”", "当标题锁定时，会重算。", "监视循环提示“为空。请记录！”后即退出。"],
        ["鮮度は10．5である．", "次の文．"],
    ],
)
def test_unspaced(units):
    assert cut("".join(units)) == units


def test_missing_space():
    assert cut("It ends silently.The next begins. See gate.Key/x.") == ["It ends silently.", "The next begins.", "See gate.Key/x."]


def test_thai():
    assert cut("ระบบรอ 115 นาทีแล้วบันทึก คิวงานของ Keldal ปฏิเสธ  แคชกลาง") == ["ระบบรอ 115 นาทีแล้วบันทึก", "คิวงานของ Keldal ปฏิเสธ", "แคชกลาง"]


def test_markdown():
    text = "Head\r\n----\r\nPara one\r\nwraps here. Two.\r\n- item. More of it\r\n- second\r\n1. third\r\n\r\n| a | b. c |\r\n| - | - |\r\n```py\r\nx. Y\r\n\r\nz\r\n```\r\n> quoted text\r\n> goes on. Next\r\n\r\n====\r\n## H2\r\nEnd"
    assert cut(text) == ["Head\r\n----", "Para one\r\nwraps here.", "Two.", "- item.", "More of it", "- second", "1. third", "| a | b. c |", "| - | - |", "```py\r\nx. Y\r\n\r\nz\r\n```", "> quoted text\r\n> goes on.", "Next", "====", "## H2", "End"]


@pytest.mark.parametrize(
    "units",
    [
        ["The gap is 5 mm.", "Then we measure."],
        ["Latency was 5 ms.", "The second run was slower."],
        ["We chose plan B.", "Nobody objected."],
        ["He takes vitamin C.", "She does not."],
        ["Он родился в 1990 г.", "Потом уехал."],
        ["See eq. (3)."],
        ["He won. . . then lost."],
        ["See Sec. IV and Fig. S1 for it.", "Ms. Kelmar asked Dr. Mardal."],
        ["MM. Dupont et Durand sont là.", "Elle mesure 5 mm.", "Ils partent."],
        ["It weighs 3 g.", "We asked Mrs. K. Or and J. R. Dun."],
        ["Das gilt z. B. für Prof. Kelmar am 16. Mai.", "Es ist der 5. Versuch."],
    ],
)
def test_languages_units_and_initials(units):
    assert cut(" ".join(units)) == units


def test_abbreviations_are_those_of_the_language():
    # 'mm' is a title in French, and 'abs' an abbreviation in German only
    assert cut("It is wide in mm. Kelmar is not.") == ["It is wide in mm.", "Kelmar is not."]
    assert cut("Selon MM. Kelmar et Dun.") == ["Selon MM. Kelmar et Dun."]
    assert cut("We have strong abs. 5 of them.") == ["We have strong abs.", "5 of them."]
    assert cut("Das ist nach Abs. 5 so.") == ["Das ist nach Abs. 5 so."]


def test_no_window_hides_the_context():
    assert cut("At https://x.example/" + "a" * 300 + "?B is it.") == ["At https://x.example/" + "a" * 300 + "?B is it."]
    assert cut("“((( [ [ Go. Now. ” he said. More.") == ["“((( [ [ Go. Now. ” he said.", "More."]
    assert cut("Am der" + " " * 60 + "5. Versuch.") == ["Am der" + " " * 60 + "5. Versuch."]
    assert cut("A" + "a" * 90 + "b" * 10 + ". Next.") == ["A" + "a" * 90 + "b" * 10 + ".", "Next."]
    assert len(cut("A.B" * 30000 + " End. New.")) == 2


def test_marks_of_the_standard_property():
    # Tibetan, Ethiopic and Armenian end marks; a semicolon and an Armenian comma continue
    assert cut("ሰላም። ደህና።") == ["ሰላም።", "ደህና።"]
    assert cut("Բարեւ։ Այո։") == ["Բարեւ։", "Այո։"]
    assert cut("He said “Stop!”; she went.") == ["He said “Stop!”; she went."]
    assert cut("He left.⟧ She came.") == ["He left.⟧", "She came."]


def test_wrapped_number_is_no_list():
    assert cut("It moved on the\n16. Mai und\nkam.") == ["It moved on the\n16. Mai und\nkam."]
    assert cut("Requests no. 3 to no.\n301 must wait.") == ["Requests no. 3 to no.\n301 must wait."]


def test_dirty_texts():
    assert cut("") == [] and cut(" \n　\t\n") == []
    assert cut("~~~\nopen. Fence") == ["~~~\nopen. Fence"]
    assert cut(">\n> a") == [">\n> a"]
    assert len(cut("Word one. " * 20000)) == 20000
    assert cut("\x07bell\x1b[0m reset") == ["\x07bell\x1b[0m reset"]


def test_table(spark):
    df = spark.createDataFrame([(1, "Ab cd. Cd ef.", 5), (2, None, 5), (3, " ", 5), (1, "Ab cd. Cd ef.", 5)], "doc_id long, text string, sent_start int")
    got = sorted((r.doc_id, r.sent_start, r.sent_end) for r in sentences(df).collect())
    assert got == [(1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13)]
    assert sentences(df.limit(0)).count() == 0
