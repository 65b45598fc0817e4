import unicodedata

import pytest

from geoweft.llm.confusables import LOOKALIKES, LookAlikes, not_plain, plain_form, public_prototypes, skeleton, skeleton_groups, unify_text

CHANGED = [
    ("Ｇｒｉｌｌ", "Grill"), ("𝗚𝗿𝗶𝗹𝗹 Bar", "Grill Bar"), ("ｶﾌｪ･ﾙﾓ", "カフェ・ルモ"), ("Café", "Café"), ("Nail\xa0Salon", "Nail Salon"), ("Sal​on", "Salon"), ("﻿Law", "Law"), ("soft\xadware", "software"), ("a͏b", "ab"), ("x᠎y", "xy"),
    ("Griӏӏ", "Grill"), ("Сосо Bar", "Coco Bar"), ("ΝЕYᏚᎢО", "NEYSTO"), ("Tαβέρνα Λίθoς", "Ταβέρνα Λίθος"), ("Аптекa Заря", "Аптека Заря"), ("Lɑw օffice", "Law office"), ("a\tb", "a b"), ("a　b", "a b"),
]
KEPT = ["", "Plain name", "Café Brévan", "Phở Lành Vị", "Кафе Вересень", "КАФЕ ТОРТ ДОМ", "ΤΑΒΕΡΝΑ ΛΙΘΟΣ", "Lumo カフェ", "福來超市", "مطعم النخيل", "מאפיית גלבוע", "솔바람 서점", "Bahmer’s “Grill”", "  two   spaces ", "Фреш café", "Ødegård & Šarvenka"]


@pytest.mark.parametrize(("raw", "want"), CHANGED)
def test_changed(raw, want):
    assert plain_form(raw) == want and plain_form(want) == want


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert plain_form(text) == text


def test_skeletons_agree_for_look_alikes():
    assert skeleton("Griӏӏ") == skeleton("Grill") and skeleton("Ｃａｆé") == skeleton("Café") and skeleton("Bar") != skeleton("Bat")
    assert all(len(c) == 1 and len(p) == 1 for t in LOOKALIKES.values() for c, p in t.items())


def test_frames(spark):
    rows = [("a", "Grill", 1, "x"), ("b", "Griӏӏ", 1, "x"), ("c", None, 1, "x"), ("d", "", 1, "x"), ("e", "Griӏӏ", 1, "x"), ("f", "ä" * 50_000 + "​", 1, "x")]
    df = spark.createDataFrame(rows, "id string, text string, plain int, skeleton string")
    got = {r.id: (r.plain, r.skeleton) for r in unify_text(df, "text").collect()}
    assert got["b"] == ("Grill", got["a"][1]) and got["c"] == (None, None) and got["d"] == ("", "") and got["f"][0] == "ä" * 50_000
    assert sorted(r.id for r in not_plain(df, "text").collect()) == ["b", "e", "f"]
    groups = {r.skeleton: (r.n_rows, r.n_originals, r.plain) for r in skeleton_groups(df, "text").collect()}
    assert groups[got["a"][1]] == (3, 2, "Grill") and len(groups) == 3
    assert unify_text(df.where("false"), "text").count() == 0 and skeleton_groups(df.where("false"), "text").count() == 0


def test_plain_form_is_stable():
    for text in [t for t, _ in CHANGED] + KEPT:
        assert plain_form(plain_form(text)) == plain_form(text) == unicodedata.normalize("NFC", plain_form(text))


@pytest.fixture(scope="module")
def public(spark):
    return LookAlikes(public_prototypes(spark))


@pytest.mark.parametrize(("raw", "want"), [*CHANGED, ("ꓮꓑꓑꓡꓰ", "APPLE"), ("𐐄range", "Orange"), ("ᗪog", "Dog"), ("ᴀʙᴄ", "abc"), ("ꮯafe", "cafe"), ("Ⲟffice", "Office")])
def test_public_table(public, raw, want):
    assert public.plain_form(raw) == want and public.skeleton(raw) == public.skeleton(want)


@pytest.mark.parametrize("text", KEPT)
def test_public_table_keeps(public, text):
    assert public.plain_form(text) == text


def test_prototypes_of_several_characters_and_digits(public):
    assert public.skeleton("modern") == public.skeleton("rnodern") and public.skeleton("O1") == public.skeleton("0l") and len(public.prototype) > 5000


def test_basic_text_has_the_same_skeleton_without_python(spark, public):
    import random

    rng = random.Random(4)
    rows = [("".join(chr(rng.randrange(0x20, 0x7F)) for _ in range(30)),) for _ in range(300)]
    got = unify_text(spark.createDataFrame(rows, "text string"), "text").collect()
    assert all(r.skeleton == public.skeleton(r.text) and r.plain == r.text for r in got)
