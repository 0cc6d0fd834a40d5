import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm import language, places
from quaestor.runtime import table

PLACES = [dict(place_id=1, name="Talimts-Limsoubâ", name_ar="تاليمتس-ليمسوبا"), dict(place_id=2, name="Oued Soukelouk", name_ar="واد سوكلأوك"), dict(place_id=3, name="Zendracha", name_ar="زندراشا"), dict(place_id=4, name=None)]
letters = st.text(alphabet="abcd", max_size=7)


@settings(max_examples=200, deadline=None)
@given(letters, letters, letters)
def test_distance_is_a_metric(a, b, c):
    assert (places.distance(a, b) == 0) == (a == b)
    assert places.distance(a, b) == places.distance(b, a)
    assert places.distance(a, c) <= places.distance(a, b) + places.distance(b, c)


def test_tree_search_is_exact():
    rng = random.Random(1)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    tree = places.BKTree([(n, k) for k, n in enumerate(names)])
    for _ in range(60):
        q, most = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))), rng.randint(0, 2)
        assert sorted(tree.within(q, most)) == sorted((d, k) for k, n in enumerate(names) if (d := places.distance(q, n)) <= most)
    assert places.distance("zenrdacha", "zendracha") == 1 and places.BKTree([]).within("a", 2) == []


def test_typed_places(spark, make_root):
    typed = ["Zendracha", "ZENRDACHA ", "Prov. de Zendracha, Oued Swkelouk et environs", "Talimts - Limsoubâ (centre)", "زندراشا", "Gatszékel", "Zendracha / Gatszékel", "Maroc", "N/A", None, "  ", "Zendracha, Maroc", "x" * 5000]
    offers = [dict(offer_row=i, lieu_execution=v) for i, v in enumerate(typed)]
    enterprises = [dict(id="e", locations=["Commune de ZENDRACHA", None, "tout le pays"])] * 2 + [dict(id="f", locations=None)]
    root = make_root(offers=offers, enterprises=enterprises, places=PLACES)
    want = [("1", 3), ("2", 2), ("2", 3), ("3", 1), ("4", 3), ("5", 0), ("6", 0), ("6", 3), ("7", 0), ("8", 0), ("11", 3), ("12", 0)]
    assert rows(places.place_cases(spark, root)) == sorted([("offers", k, p) for k, p in want] + [("enterprises", "e", 3), ("enterprises", "e", 0)], key=repr)
    values, listed = places.typed_values(spark, root), table(spark, root, "places")
    columns = ["source_table", "record_key", "pos", "entry", "place_id"]
    assert rows(places.map_places(values, listed, shard_entries=2).select(columns).distinct()) == rows(places.map_places(values, listed).select(columns).distinct())
    assert places.place_cases(spark, make_root(offers=offers[5:6])).collect()[0].place_id == 0
    assert places.place_cases(spark, make_root(places=PLACES)).count() == 0


SENTENCES = {
    "fr": ["Le titulaire désigne un responsable permanent joignable pendant la durée du chantier", "Les offres restent valables après l'ouverture des plis en séance publique", "Toute question relative au dossier est adressée au service avant la date limite"],
    "en": ["The contractor keeps the work programme up to date during the whole warranty period", "Payment is made within thirty days of the receipt of the handover report", "Questions about the bid security must reach the office before the opening"],
    "es": ["El contratista debe presentar el certificado fiscal antes de la apertura de los sobres", "Las ofertas se abrirán en sesión pública en la oficina del órgano de contratación", "El importe de la garantía asciende a la suma fijada en el pliego de condiciones"],
    "ar": ["يلتزم المقاول بتقديم محضر التسلم عند نهاية كل شهر"],
}


def test_pages_and_hints(spark, make_root):
    rng, pages, blocks, want = random.Random(2), [], [], []
    for n in range(90):
        lang = ("fr", "en", "es")[n % 3]
        wrong = n in (10, 20)
        pages.append(dict(doc_id=n, page=1, language_hint="de" if wrong else {"fr": "Français", "en": "en-GB", "es": " SPA "}[lang]))
        blocks += [dict(doc_id=n, id=f"b{k}", page=1, text=rng.choice(SENTENCES[lang]) + f" {n}. " + rng.choice(SENTENCES[lang]) + ".") for k in range(3)]
        want += [(n, 1, lang)] if wrong else []
    extra = {
        200: ([SENTENCES["fr"][0] + ". " + SENTENCES["ar"][0] + "."], "mixed", []), 201: ([SENTENCES["fr"][0] + ". " + SENTENCES["ar"][0] + "."], "fr", ["fr", "ar"]),
        202: ([SENTENCES["ar"][0]], None, ["ar"]), 203: (["12 / 48", "", None], "en", ["fr"]), 204: ([], "und", ["fr"]), 205: ([], "fr", []),
        206: ([" ".join(SENTENCES["en"]) * 200], "?", ["en"]),
    }
    for doc, (texts, hint, langs) in extra.items():
        pages.append(dict(doc_id=doc, page=1, language_hint=hint))
        blocks += [dict(doc_id=doc, id=f"b{k}", page=1, text=t) for k, t in enumerate(texts)] * 2
        want += [(doc, 1, x) for x in langs]
    blocks.append(dict(doc_id=None, id="x", page=None, text="lost"))
    root = make_root(doc_pages=pages, blocks=blocks)
    assert rows(language.wrong_hints(spark, root)) == sorted(want, key=repr)
    found = [r for r in language.page_segments(spark, root).collect() if r.doc_id == 201]
    assert sorted(r.language for r in found) == ["ar", "fr"] and all(0.5 <= r.confidence <= 1 for r in found)
    assert language.wrong_hints(spark, make_root()).count() == 0
    held = language.fit_discriminator({k: [s + "." for s in v[:2]] * 20 for k, v in SENTENCES.items() if k != "ar"})
    assert [held.latin(SENTENCES[k][2])[0] for k in ("fr", "en", "es")] == ["fr", "en", "es"]
