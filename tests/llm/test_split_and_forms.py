import unicodedata

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm import charforms, split
from quaestor.runtime import table


def pieces_hold(text, limit=400, overlap=40):
    got = split.split_text(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b in got:
        assert round((b - a) / 3.5) <= limit
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and round((b - c) / 3.5) <= overlap
    return got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.\n|-;", min_size=1, max_size=900), st.integers(5, 40))
def test_pieces_cover_any_text(text, limit):
    got = pieces_hold(text, limit, limit // 4)
    whole, done = "", 0
    for a, b in got:
        whole += text[max(a, done) : b]
        done = b
    assert whole == text


def test_cuts_fall_where_the_text_breaks():
    text = " ".join(f"Phrase numéro {i} de ce texte assez long pour être coupé." for i in range(120))
    assert all(text[:b].endswith(". ") for _, b in pieces_hold(text)[:-1])
    lines = "".join(f"| {i} | béton | 12 |\n" for i in range(300))
    assert all(lines[:b].endswith("|\n") for _, b in pieces_hold(lines)[:-1])
    assert pieces_hold("x" * 5000) == [(0, 1401), (1260, 2661), (2520, 3921), (3780, 5000)]
    marks = "é" * 3000
    assert all(unicodedata.combining(marks[b - 1]) for _, b in pieces_hold(marks))


def test_only_oversized_blocks_are_cut(spark, make_root):
    texts = {"null": None, "empty": "", "limit": "a" * 1401, "over": "a" * 1402, "long": "mot " * 30_000}
    given = [dict(doc_id=1, id=k, text=v, section_path=["A"] if k == "over" else None) for k, v in texts.items()]
    got = split.split_oversized(table(spark, make_root(blocks=given + given), "blocks"), ["doc_id", "id"]).collect()
    assert {r.id for r in got} == {"over", "long"}
    assert [r.section_path for r in got if r.id == "over"] == [["A"], ["A"]]
    assert all(r.token_estimate == round(len(r.piece) / 3.5) <= 400 for r in got)
    assert split.split_oversized(table(spark, make_root(), "blocks"), ["doc_id", "id"]).count() == 0


def test_house_form_by_character():
    same = "Éclairage n° 2 : 15 m², 3×2 — « œuvre » d’Ïsselkel Ø 110 … أعمال الصيانة"
    assert charforms.canonical(same) == same
    for bad, good in [("é", "é"), ("ｆｕｌｌ２", "full2"), ("a b c", "a b c"), ("a​b­﻿", "ab"), ("oﬁ", "ofi"), ("𝟐𝟎", "20"), ("ﺕﻝ", "تل"), ("a\tb", "a b")]:
        assert charforms.canonical(bad) == good
    assert [charforms.dominant_script(t) for t in ("Щука", "béton", "analуses", "СОС", "أعمال", "کیک")] == ["other", "Latin", "Latin", None, "Arabic", None]
    assert [charforms.questionable(t) for t in ("Щука", "béton", "analуses", "СОС")] == [False, False, True, True]
    assert [charforms.standard_arabic(t) for t in ("صیانة", "یکون", "béton", "aی")] == ["صيانة", "يكون", "béton", "aی"]
    # any number of letters with two readings, which the word settles
    token, word = "уу" * 30 + "Уx", "yu" * 30 + "yx"
    assert charforms.alike_key(token) == charforms.alike_key(word) and charforms.reading(token, word) == "yu" * 30 + "Yx"
    assert charforms.reading("analуses", "analyses") == "analyses" and charforms.reading("analуses", "analzses") is None


def test_house_form_over_tables(spark, make_root):
    long = "mot " * 20_000
    offers = [
        dict(offer_row=1, objet="Travaux de béton", acheteur_public=None), dict(offer_row=2, objet="Travаux de bétоn", acheteur_public=""), dict(offer_row=3, objet=long, acheteur_public=long + "​"),
        dict(offer_row=4, objet="ΑΒ", acheteur_public="Тахе"), dict(offer_row=None, objet="ok"), dict(offer_row=5, objet="Μοσκ Dοuar"), dict(offer_row=6, objet="Douar"), dict(offer_row=7, objet="Bеnα unique"), dict(offer_row=8, objet="صیانة"),
    ]
    enterprises = [dict(id="e", keywords=["béton", None, "", "bеton‎"])] * 2 + [dict(id="n", keywords=None), dict(id="0", keywords=[])]
    root = make_root(offers=offers, enterprises=enterprises)
    assert rows(charforms.unlike_house_form(spark, root)) == [("enterprises", "e", "keywords"), ("offers", "2", "objet"), ("offers", "3", "acheteur_public"), ("offers", "5", "objet"), ("offers", "8", "objet")]
    got = {(r.record_key, r.field, r.pos): r.normal for r in charforms.house_form(charforms.text_values(spark, root)).collect()}
    assert got["2", "objet", 0] == "Travaux de béton" and got["4", "acheteur_public", 0] == "Тахе" and got["5", "objet", 0] == "Μοσκ Douar" and got["7", "objet", 0] == "Bеnα unique" and got["8", "objet", 0] == "صيانة"
    assert charforms.unlike_house_form(spark, make_root()).count() == 0
