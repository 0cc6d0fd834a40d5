import os
import random

import pytest
from conftest import rows

from quaestor.llm import leakage, residue, tokenizer
from quaestor.runtime import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_ids_equal_a_reference_encoder_and_decode_back(spark, make_root):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenizer.read_ranks(VOCABULARY)
    encoder = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["L'offre n° 12 — 3×2,5 mm²", "  deux  espaces \n\n", "أعمال الصيانة", "<|endoftext|>", "x" * 3000, "ab" * 700 + "é" * 300, "😀🏽 é", "mot " * 40_000]
    texts += ["".join(rng.choice("abc éا1 \n'.") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    given = [dict(doc_id=i, text=t) for i, t in enumerate(texts)] + [dict(doc_id=900, text=None), dict(doc_id=901, text=""), dict(doc_id=None, text="lost")]
    encoded = tokenizer.encode_texts(table(spark, make_root(documents=given), "documents"), VOCABULARY)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    decoded = {r.doc_id: r.text for r in tokenizer.decode_ids(encoded.where("doc_id < 40 OR doc_id >= 900"), VOCABULARY).collect()}
    assert decoded == {d["doc_id"]: d["text"] or "" for d in given if d["doc_id"] is not None and (d["doc_id"] < 40 or d["doc_id"] >= 900)}
    assert got.pop(900) == got.pop(901) == []
    assert got == {i: encoder.encode_ordinary(t) for i, t in enumerate(texts)}
    assert all(encoder.decode(got[i]) == t for i, t in enumerate(texts))
    assert tokenizer.encode_texts(table(spark, make_root(), "documents"), VOCABULARY).count() == 0


def brute(documents, items):
    out = set()
    for d, t in documents:
        w = leakage.words(t or "")
        for i, s in items:
            v = leakage.words(s or "")
            n = min(13, len(v))
            runs = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark, make_root):
    rng = random.Random(6)
    vocabulary = [f"mot{k}" for k in range(60)] + ["de", "la", "Été"] * 10
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 13, 20, 60])))) for i in range(40)] + [(90, None), (91, " ?! ")]
    documents = []
    for d in range(300):
        body = [rng.choice(vocabulary + ["inconnu"] * 10) for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            source = leakage.words(rng.choice(items)[1] or "")
            cut = rng.randint(0, max(0, len(source) - 5))
            body[len(body) // 2 : len(body) // 2] = [x.upper() for x in source[cut : cut + rng.randint(5, 40)]]
        documents.append((d, " , ".join(body).replace("ete", "été")))
    documents += [(900, None), (901, ""), (902, "inconnu " * 50_000 + items[3][1])]
    root = make_root(documents=[dict(doc_id=d, text=t) for d, t in documents], held_out=[dict(item_id=i, text=t) for i, t in items + items[:3]])
    d, h = table(spark, root, "documents"), table(spark, root, "held_out")
    want = sorted(brute(documents, items), key=repr)
    assert len(want) > 30
    assert rows(leakage.find_leaks(d, h)) == want
    assert rows(leakage.find_leaks(d, h, shard_words=100)) == want
    assert leakage.find_leaks(d, h.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), h).count() == 0


RESIDUE = [
    "Objet : {{ titre }}", "Montant : {0} dirhams", "Article 3 <date_limite>", "<< lieu >>", "@@objet@@ du marché", "[à compléter] le lot", "[NOM DE L'ORGANISME]", "TODO : préciser", "le XX/XX/20XX", "Acheteur : undefined",
    "<%= objet %>", "Lorem ipsum dolor sit amet", "Test test test 5", "{{ " + "x" * 200 + " }}",
]
CONTENT = [
    "Voir [annexe B] et le renvoi [12] du bordereau.", "La formule est P = P0 [0,15 + 0,85 (S/S0)].", "Fait à ..........., le ..........", "La page introuvable doit renvoyer un message clair, testé lors de la recette.",
    "Le portail reste utilisable lorsque JavaScript est désactivé dans le navigateur.", "La session de formation expire au bout de 30 jours.", "Le prestataire corrige toute erreur 404 ou 500 signalée sur le site.", "Remise de 5 % ou 10 % selon « le lot »", "un lot autre autre autre lot", None, "",
]
WORDS = "titulaire marché garantie provisoire chantier entrepreneur bordereau montant délai exécution travaux réception commission dossier concurrent offre caution pièces paiement jours service équipement fourniture livraison".split()


def corpus(n=600, seed=1):
    """Rich documents, whose words become the typical terms."""
    rng = random.Random(seed)
    return [f"Avis numéro {k}\n\n" + " ".join(rng.sample(WORDS, len(WORDS))) + "." for k in range(n)]


def documents_of(spark, make_root, texts, **more):
    given = [dict(doc_id=1000 + k, text=t, source="c", org_acronyme=f"O{k % 9}") for k, t in enumerate(corpus())]
    given += [dict(doc_id=i, text=t, source=f"s{i}") for i, t in enumerate(texts)] + more.get("rows", [])
    return table(spark, make_root(documents=given), "documents")


def samples(pattern, rng, n):
    """Texts that match a pattern, drawn from its parsed form, so that every alternative comes up."""
    import re

    plain = re.sub(r"\[([^\]]*)\\p\{L[u}][^\]]*\]", "[A-Za-z]", pattern).replace(r"\p{L}", "[a-z]")
    plain = re.sub(r"\(\?iu?:", "(?:", re.sub(r"^\(\?iu?\)", "", plain))

    def draw(parsed):
        out = ""
        for op, arg in parsed:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                choices = [chr(rng.randint(*a)) if str(o) == "RANGE" else chr(a) if str(o) == "LITERAL" else {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "7"}.get(str(a)) for o, a in arg if str(o) != "NEGATE"]
                out += "q" if str(arg[0][0]) == "NEGATE" else rng.choice(choices)
            elif kind == "BRANCH":
                out += draw(rng.choice(arg[1]))
            elif kind == "SUBPATTERN":
                out += draw(arg[-1])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                out += "".join(draw(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            elif kind not in ("AT", "ASSERT", "ASSERT_NOT"):
                raise ValueError(kind)
        return out

    parsed = re._parser.parse(plain)
    return [draw(parsed) for _ in range(n)]


def test_matches_hold_an_anchor():
    rng, lost = random.Random(9), set()
    for patterns, anchors, form in [*((p, a, str) for a, p in residue.PLACEHOLDERS), (residue._WORDED_FILLER, [*residue.FILLER_TERMS, "bla bla"], str.lower)]:
        for p in patterns:
            lost |= {t for t in samples(p, rng, 4000) if not any(a in form(t) for a in anchors)}
    assert lost == set()


def test_detectors(spark, make_root):
    documents = documents_of(spark, make_root, RESIDUE + [t and f"{corpus(1, 7)[0]} {t}" for t in CONTENT])
    assert sorted(r.doc_id for r in residue.residue_documents(documents).collect()) == [*range(len(RESIDUE))]
    assert residue.residue_documents(table(spark, make_root(), "documents")).count() == 0


def test_messages_of_unseen_wording(spark, make_root):
    """No list knows these sentences; only their hosts tell."""
    said = "Contenu retiré depuis hier"
    given = [dict(doc_id=k, text=f"Cahier spécial {k}\n\n{said} {k}.", source=f"s{k % 4}", doc_type="cps", consultation_id=f"77{k}") for k in range(5)]
    # a piece of content, and a very long one
    given += [dict(doc_id=10, text=corpus(1, 5)[0] + f"\n\n{said} 9."), dict(doc_id=11, text=" ".join(corpus(800, 6)) + f"\n\n{said} 9.")]
    # the body takes up the title, the kind or the reference; one host only; too few; a sentence mainly found in content
    given += [dict(doc_id=20 + k, text=f"Mobilier scolaire\n\nMobilier scolaire livré ici {k}.", source=f"s{k}") for k in range(5)]
    given += [dict(doc_id=30 + k, text="Le présent avis est publié là.", source=f"s{k}", doc_type="avis") for k in range(5)]
    given += [dict(doc_id=40 + k, text=f"Numéro 88{k} remis au guichet.", source=f"s{k}", consultation_id=f"88{k}") for k in range(5)]
    given += [dict(doc_id=50 + k, text="Remise contre reçu.", source="s") for k in range(5)]
    given += [dict(doc_id=60 + k, text="Seulement deux.", source=f"s{k}") for k in range(2)]
    given += [dict(doc_id=70 + k, text=(corpus(1, k)[0] if k > 3 else "") + "\n\nDocument sans valeur.", source=f"s{k}") for k in range(20)]
    documents = documents_of(spark, make_root, [], rows=given + given[:2])
    assert sorted(r.doc_id for r in residue.residue_documents(documents).collect()) == [0, 1, 2, 3, 4, 10, 11]
    assert rows(residue.residue_evidence(documents).where("doc_id = 10")) == [(10, "shared message")]
    kept = {r.doc_id for r in residue.without_residue(documents).collect()}
    assert kept.isdisjoint({0, 10, 11}) and {20, 30, 40, 50, 60, 70, 1000} <= kept


def test_lone_messages_and_copies(spark, make_root):
    lone = ["Erreur 404 : la page demandée est introuvable.", "Veuillez activer JavaScript.", "Notice 4\n\nYour session has expired.", "الصفحة المطلوبة غير موجودة."]
    # a third of the corpus is one error page; its words are not typical for that
    copies = [dict(doc_id=500 + k, text="Le portail revient bientôt", source=f"s{k % 7}") for k in range(80)]
    documents = documents_of(spark, make_root, lone, rows=copies)
    assert sorted(r.doc_id for r in residue.residue_documents(documents).collect()) == [0, 1, 2, 3, *range(500, 580)]


def test_held_out_recall_on_planted_wording(spark, make_root):
    """Messages of random wording, an eighth of them inside content."""
    rng = random.Random(12)
    syllables = ["ka", "mo", "ri", "te", "lu", "zan", "por", "vi"]
    messages = ["".join(rng.choice(syllables) for _ in range(3)) + " " + " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(4)) + "." for _ in range(6)]
    given, want = [], set()
    for k in range(80):
        inside = k % 8 == 0
        text = (corpus(1, k)[0] if inside else f"Note {k}") + "\n\n" + rng.choice(messages)
        given.append(dict(doc_id=k, text=text, source=f"s{k % 11}"))
        want.add(k)
    got = {r.doc_id for r in residue.residue_documents(documents_of(spark, make_root, [], rows=given)).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(got)
