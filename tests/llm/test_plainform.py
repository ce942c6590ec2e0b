import unicodedata

from gridloom.llm import plainform as P


def test_plain_words():
    assert P.plain_words("Ｗhat, ＩＳ​ it? Nо­!") == ["what", "is", "it", "no"]
    assert P.plain_words("été") == P.plain_words("été") != P.plain_words("ete")
    assert P.plain_words(None) == P.plain_words("") == P.plain_words(" –… ") == []
    assert P.plain_units("第1,2行ですか") == ["第", "1", "2", "行", "で", "す", "か"]
    assert P.plain_cells("A-b\x1f\x1f—\x1fa b\x1fＡＢ") == {"ab"}


def test_repair_goes_to_the_dominant_script():
    assert P.repair_token("Ѕhеаvіароt") == "Sheaviapot"  # most letters are twins, the others are Latin
    assert P.repair_token("Суeячай") == "Суеячай"
    assert P.repair_token("Рижин") == "Рижин"
    assert P.repair_token("οf") == "of"
    assert P.repair_token("Ѕ̌hіаmấn") == "Šhiamấn"
    assert P.repair_token("Μιγuγο") == "Μιγυγο"


def test_visible_form_keeps_what_can_be_seen():
    same = P.visible_form
    assert same("Ａ　b​c") == "A bc"
    assert same("ﾀﾞ") == "ダ"
    assert same("K") == "K"
    for a, b in [("a", "A"), ("é", "e"), ("a.", "a"), ("²", "2"), ("ﬁ", "fi")]:
        assert same(a) != same(b)
    s = "x̣̂"
    assert same(s) == unicodedata.normalize("NFC", s)
