import pytest

from fathomline.llm.confusables import canonical_form, canonical_text, scripts_of


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｌａｕｎｃｈ", "Launch"), ("𝘃𝗼𝗹𝘂𝗺𝗲 plan", "volume plan"), ("ﬁrst oﬃce", "first office"), ("café", "café"), ("a​b﻿c­d", "abcd"), ("a b　c d", "a b c d"),
        ("prοmised", "promised"), ("caӏӏ", "call"), ("ԝorkeԁ", "worked"), ("lonɡ prıce", "long price"), ("＄８４４", "$844"), ("⚙️​", "⚙️"), ("시", "시"),
    ],
)
def test_disguised(text, want):
    assert canonical_form(text)[0] == want


@pytest.mark.parametrize(
    "text",
    ["", "plain", "“curly” ‘quotes’ – dash — and…", "naïve São Ångström", "Как мы росли", "Πρώτη κυκλοφορία", "कोड संपादक", "🏳️‍🌈 👩‍💻 ✍🏽 1️⃣", "長い年", "中文，好！", "Δt kΩ µm", "Yıldırımoğlu", "x² ½ ™ ①", "line\nbreak\ttab"],
)
def test_ordinary(text):
    assert canonical_form(text)[0] == text


def test_idempotent_and_flags():
    for t in ("prοmised Ｌ", "a‍", "сосо", "T恤"):
        once = canonical_form(t)[0]
        assert canonical_form(once)[0] == once
    assert canonical_form("prοmised")[1:] == (True, False)
    assert canonical_form("сосо")[1:] == (False, True)
    assert scripts_of("a") == frozenset({"Latn"}) and scripts_of("1") is None
    assert "Jpan" in scripts_of("の") and "Jpan" in scripts_of("開")


def test_a_mixed_token_that_no_script_can_spell_is_reported():
    assert canonical_form("gгeat work") == ("gгeat work", True, False)
    assert canonical_form("T恤")[1] and not canonical_form("Как мы")[1]


def test_mixed_word_keeps_its_own_script():
    assert canonical_form("Зaпуск")[0] == "Запуск"


def test_column(spark):
    long = "plain words " * 20_000 + "prοmised"
    rows = [(1, None), (2, ""), (3, "ok"), (4, "prοmised"), (4, "prοmised"), (5, long)]
    df = spark.createDataFrame(rows, "id int, canon string")
    got = [(r["id"], r["ct_canon"], r["ct_changed"], r["ct_mixed_script"]) for r in canonical_text(df, "canon").collect()]
    assert sorted(got, key=lambda r: r[0])[:5] == [(1, None, False, False), (2, "", False, False), (3, "ok", False, False), (4, "promised", True, True), (4, "promised", True, True)]
    assert got[-1][1].endswith("promised") and got[-1][2]
    assert canonical_text(df.limit(0), "canon").count() == 0
