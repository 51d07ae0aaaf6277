import random
import re

import pytest

from conftest import rows
from metaquarry.llm import encoding as E

TEXTS = {
    "de": "Löschläufe sind während der Prüfung nicht zulässig, außer für Größe.",
    "fr": "La vue agrège les écritures à la clôture de l’exercice, déjà créées.",
    "es": "Se añadió la corrección después; la función está aún en tránsito.",
    "pt": "Visão de manutenção; exclusões são lógicas até a próxima versão.",
    "pl": "Ponieważ wiersz miał zły format, zgłoś właścicielowi źródła.",
    "ru": "Представление объединяет остатки и проводки системы.",
    "zh": "本程式每日讀取資料，彙總後寫入異動軌跡。",
    "ja": "夜間バッチが遅れた場合は、前日の値を使用してください。",
}
WRONG = [(k, "utf-8", c) for k in TEXTS for c in ("cp1252", "latin-1")] + [(k, "utf-8", c) for k in ("de", "fr", "es", "pt") for c in ("cp437", "mac_roman", "cp1250")] + [("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("pl", "cp1250", "cp1252"), ("zh", "cp950", "cp1252"), ("ja", "cp932", "cp1252"), ("de", "cp1252", "cp1251"), ("fr", "cp1252", "cp1251"), ("zh", "utf-8", "gb18030"), ("ja", "utf-8", "cp932"), ("pl", "utf-8", "cp1250")]


def garble(text, right, wrong):
    raw = text.encode(right)
    out = ""
    for i in range(len(raw)) if wrong in E.SINGLE else ():
        try:
            out += raw[i : i + 1].decode(wrong)
        except UnicodeError:
            out += chr(raw[i])
    return out or raw.decode(wrong, "replace")


@pytest.mark.parametrize("case", WRONG, ids=str)
def test_garbled_texts_are_found(case):
    k, right, wrong = case
    bad = garble(TEXTS[k], right, wrong)
    fixed, found = E.restore(bad)
    assert found
    if right == "utf-8" and wrong in E.SINGLE:
        assert fixed == TEXTS[k]


@pytest.mark.parametrize("k", list(TEXTS))
def test_twice_garbled_and_mixed(k):
    twice = garble(garble(TEXTS[k], "utf-8", "cp1252").encode("utf-8", "replace").decode("utf-8"), "utf-8", "cp1252") if k in ("de", "es", "pt") else garble(TEXTS[k], "utf-8", "cp1252")
    assert E.restore(TEXTS["de"] + " / " + twice) == (TEXTS["de"] + " / " + TEXTS[k], True)


@pytest.mark.parametrize("k", list(TEXTS))
def test_twice_garbled_in_every_language(k):
    assert E.restore(garble(garble(TEXTS[k], "utf-8", "cp1252"), "utf-8", "cp1252")) == (TEXTS[k], True)
    assert E.restore("IRMÃ\xa0DE") == ("IRMÃ\xa0DE", False)


def test_sound_texts_stay():
    sound = [*TEXTS.values(), "Ï and Ÿ are valid letters (Loÿ, Naïm).", "PAÍS/AÇÃO/IRMÃ: NÃO ALTERAR, Âmbito", "Σ(a_b) ≤ 5, Δ über alle Zonen", "Đơn vị tính là nghìn đồng.", "┌── A.B ──┐ → c", "Prüft ob x ≠ ‹leer› — sonst „trade“.", "ﾃｽﾄ ｶﾅ half-width", "5 µm², 20 °C ± 2 %, £5 or ¥3, § 3, © 2020, ½, n.º 4", "¿Por qué? ¡Sí! «a» “b” …", "a & b < c; 100%", "", "soft\u00adhyphen", "日本語テキストとSQL文"]
    for t in sound:
        assert E.restore(t) == (t, False), t


@pytest.mark.parametrize("n", [50, 130, 1000, 5000])
def test_spots_in_long_unbroken_text(n):
    path, zh = ("/srv/data" * n)[:n], (TEXTS["zh"][:-1] * n)[:n]
    for left, right in ((path + "/", "/x.sql"), ("http://a.b/" + path + "?q=", "&z=1"), (zh, zh), (zh + "。", "。")):
        assert E.restore(left + "crÃ©dit" + right) == (left + "crédit" + right, True)
        assert E.restore(left + "crédit" + right) == (left + "crédit" + right, False)
    for right, wrong in (("utf-8", "cp1252"), ("cp950", "cp1252")):
        assert E.restore(zh + garble(TEXTS["zh"], right, wrong) + zh) == (zh + TEXTS["zh"] + zh, True)


OTHERS = {"ar": "العميل غير موجود في النظام اليوم", "he": "הלקוח אינו קיים במערכת היום", "th": "ไม่พบลูกค้าในระบบวันนี้", "hi": "ग्राहक आज सिस्टम में नहीं मिला", "el": "Ο πελάτης δεν βρέθηκε στο σύστημα", "ko": "고객을 시스템에서 찾을 수 없습니다", "hy": "Հաճախորդը չի գտնվել"}


@pytest.mark.parametrize("k", list(OTHERS))
def test_other_scripts(k):
    assert E.restore(OTHERS[k]) == (OTHERS[k], False)
    for wrong in ("cp1252", "latin-1"):
        assert E.restore(garble(OTHERS[k], "utf-8", wrong)) == (OTHERS[k], True)


def test_the_search_ends_on_any_text():
    r = random.Random(3)
    for _ in range(60):
        w = "".join(chr(r.choice([r.randint(0x80, 0x24F), r.randint(0x400, 0x4FF), r.randint(0x2000, 0x2600), r.randint(0x4E00, 0x9FFF)])) for _ in range(r.choice([5, 20, 60])))
        E.restore(w)


def test_words_that_are_not_searched_cost_nothing():
    r = random.Random(4)
    plain = re.compile(E.PLAIN_WORD)
    words = ["".join(r.choice("aZ9-./_%(éüßñçÉÃÂ¤©ЖДжаеё ёя日あ’…") for _ in range(r.randint(1, 7))).replace(" ", "") for _ in range(20_000)]
    met = [w for w in words if plain.match(w)]
    assert len(met) > 500 and {w for w in met if E.cost(w) > 0 or E.restore_word(w)[2]} == set()


def test_the_table_gives_what_each_text_gives_by_itself(spark):
    r = random.Random(5)
    parts = [*TEXTS.values(), *[garble(TEXTS[k], right, wrong) for k, right, wrong in WRONG], "plain ascii", "a\tb\x0bc\nd", "x\ufffd", "Fran&Atilde;&sect;ais", "&eacute;"]
    data = [(str(i), r.choice([" ", "\n", "\t"]).join(r.choices(parts, k=r.randint(1, 4)))) for i in range(150)]
    df = spark.createDataFrame(data, "k string, t string")
    want = sorted((k, t, E.restore(t)[0]) for k, t in data if E.restore(t)[1])
    assert rows(E.garbled_texts(df, "k", "t", "n").select("record_key", "text", "restored")) == want
    assert rows(E.garbled_keys(df, "k", "t", "n")) == sorted(("n", k) for k, _, _ in want)
    E.BROADCAST_ROWS, old = 0, E.BROADCAST_ROWS
    try:
        assert rows(E.garbled_keys(df, "k", "t", "n")) == sorted(("n", k) for k, _, _ in want)
    finally:
        E.BROADCAST_ROWS = old


def test_lost_characters_and_marks():
    for t in ("pr�ft", "ï¿½", "ï»¿SELECT"):
        assert E.restore(t)[1]
    assert E.restore("pr�ft und fÃ¼r") == ("pr�ft und für", True)


def test_escapes_are_a_step_but_no_garbling():
    assert E.restore("Fran&ccedil;ais &amp; \\u00e9") == ("Fran&ccedil;ais &amp; \\u00e9", False)
    assert E.restore("Fran&Atilde;&sect;ais") == ("Français", True)


def test_very_long_text():
    t = TEXTS["fr"] * 2000
    assert E.restore(t) == (t, False) and E.restore("fÃ¼r " * 20_000) == ("für " * 20_000, True)


def test_tables(spark):
    s = "object_id string, description string, record_key string, text string"
    data = [("a", "fÃ¼r"), ("a", "fÃ¼r"), ("b", None), ("c", ""), (None, "fÃ¼r"), ("d", "für"), ("e", "x�")]
    df = spark.createDataFrame([(*r, "k", "t") for r in data], s)
    got = rows(E.garbled_texts(df, "object_id", "description", "t"))
    assert got == [("t", "a", "fÃ¼r", "für", True), ("t", "e", "x�", "x�", False)]
    assert rows(E.garbled_texts(df.limit(0), "object_id", "description", "t")) == []
