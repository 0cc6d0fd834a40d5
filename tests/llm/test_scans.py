from quaestor.llm import scans

FR = "Le titulaire désigne un responsable permanent pendant la durée du chantier. Les offres restent valables après l'ouverture des plis. Le sous-traitant présente le bordereau des prix et le programme dans le délai fixé."
AR = "يلتزم المقاول بتقديم محضر التسلم عند نهاية كل شهر"


def block(doc, n, text, page=1, type="paragraph", y0=200.0, furniture=None):
    return dict(doc_id=doc, id=f"b{n}", type=type, page=page, ord=n, bbox=(50.0, y0, 500.0, y0 + 20), text=text, is_furniture=furniture)


def _root(make_root):
    pages = [dict(doc_id=1, page=1, height=800.0, is_scanned=False), dict(doc_id=2, page=1, height=800.0, is_scanned=True), dict(doc_id=2, page=2, height=800.0), dict(doc_id=3, page=1), dict(doc_id=4, page=1, is_scanned=True), dict(doc_id=4, page=2)]
    digital = [block(1, k, FR + " " + AR) for k in range(6)] + [block(1, 9, "Page 1 sur 3", y0=790.0), block(1, 10, "une cou- \npure dans un doc†ment")]
    scanned = [
        block(2, 0, "Dossier 12/AB/2025 : travaux", y0=20.0), block(2, 1, "Le titu-\nlaire désigne un respon¬\nsable permanent."), block(2, 2, "Le sous-\ntraitant présente le bordereau."), block(2, 3, "Les offr3s 12 restcnt valab1es pen-\nDossier 13/AB/2025 : travaux\ndant la durée."),
        block(2, 4, "Le sous-\ntraitant présente le program-"), block(2, 5, "2/2\nme dans le délai.", page=2), block(2, 6, "2 / 2", page=2, y0=780.0), block(2, 7, "يلتزم اJمقاول", page=2), block(2, 8, "Le chantier clair\n2/2\net net", page=2),
        block(2, 9, None, page=2), block(2, 10, "", page=2), block(2, 11, "dans le délai " * 5000, page=2), block(None, 12, "x"), block(2, 13, "y", page=None),
        block(4, 0, "Le chantier de la munici-"), block(4, 1, "Section 2", page=2, type="title"), block(4, 2, "palité reste ouvert. Le bor-\nder3au et le bor-\ndcreau du sous-", page=2),
    ]
    return make_root(doc_pages=pages, blocks=digital + scanned + scanned[:4])


def test_noise(spark, make_root):
    want = {("b0", "furniture"), ("b1", "hyphen"), ("b3", "chars"), ("b3", "hyphen"), ("b3", "furniture"), ("b4", "hyphen"), ("b5", "furniture"), ("b6", "furniture"), ("b7", "chars"), ("b8", "furniture")}
    assert {(r.block_id, r.noise) for r in scans.scan_noise(spark, _root(make_root)).collect() if r.doc_id == 2} == want
    assert {(r.block_id, r.noise) for r in scans.scan_noise(spark, _root(make_root)).collect() if r.doc_id == 4} == {("b0", "hyphen"), ("b2", "hyphen"), ("b2", "chars")}
    assert scans.scan_noise(spark, make_root()).count() == 0


def test_paragraphs(spark, make_root):
    got = {r.block_id: r.text for r in scans.scan_paragraphs(spark, _root(make_root)).collect() if r.doc_id == 2}
    assert got["b1"] == "Le titulaire désigne un responsable permanent."
    assert got["b2"] == "Le sous-traitant présente le bordereau."
    assert got["b3"] == "Les offr3s 12 restent valables pendant la durée."
    assert got["b4"] == "Le sous-traitant présente le programme" and got["b5"] == "dans le délai."
    assert got["b7"] == "يلتزم المقاول" and got["b8"] == "Le chantier clair et net"
    assert "b0" not in got and "b6" not in got


def test_running_lines_beside_text():
    running = {"page 0 sur 0", "chambre d'agriculture de x - marché 0/hc/0", "commune de rabat", "page 0"}
    cut = lambda text: scans.without_furniture(text, 2, running)
    assert cut("Page 2 sur 12 L'estimation des coûts") == ("L'estimation des coûts", True)
    assert cut("Chambre d'agriculture de X -  Marché 278/HC/2025 Sauf stipulation\ncontraire. Page 3 sur 12") == ("Sauf stipulation\ncontraire.", True)
    assert cut("Page 2 sur 12\nPage 2 sur 12 يلتزم المقاول") == ("يلتزم المقاول", True)
    for text in ["Commune de Rabat se réserve le droit", "voir page 2 sur 12 du dossier", "il est remis à la commune de Rabat", "Page 2 Les prix", "Page 2 sur 12e lot", "x\ny"]:
        assert cut(text) == (text, False)


def test_running_lines_beside_text_are_found(spark, make_root):
    given = [block(2, 0, "Page 1 sur 12", y0=790.0), block(2, 1, "Page 2 sur 12 Le chantier reste ouvert.", page=2)]
    root = make_root(doc_pages=[dict(doc_id=2, page=p, height=800.0, is_scanned=True) for p in (1, 2)], blocks=given)
    assert {(r.block_id, r.noise) for r in scans.scan_noise(spark, root).collect()} == {("b0", "furniture"), ("b1", "furniture")}
    assert [r.text for r in scans.scan_paragraphs(spark, root).collect()] == ["Le chantier reste ouvert."]


def test_words_with_several_misreadings(spark):
    words = spark.createDataFrame([("responsable", 5), ("permanent", 4), ("chantier", 3), ("lot", 9)], "word string, n long")
    unknown = spark.createDataFrame([("rcsponsab1e",), ("pcrrnancnt",), ("chantjer",), ("rc5p0n5ab1e",), ("1ot",), ("zz",)], "word string")
    got = {(r.word, r.meant): round(r.cost, 6) for r in scans.corrections(unknown, scans.lexicon_index(words)).collect()}
    # an edit outside the confusions is a candidate too, which its neighbours must bear out
    assert got == {("rcsponsab1e", "responsable"): 0.6, ("pcrrnancnt", "permanent"): 0.9, ("1ot", "lot"): 0.3, ("chantjer", "chantier"): 1.0}


def test_candidates_equal_all_pairs(spark):
    import random

    rng = random.Random(8)
    known = sorted({"".join(rng.choice("abcelmnrit") for _ in range(rng.randint(2, 9))) for _ in range(150)} | {"x" * 90 + "lettre"})
    spoilt = set()
    for w in known:
        for a, b in rng.sample(scans.CONFUSIONS, 12):
            if b in w and rng.random() < 0.5:
                spoilt.add(w.replace(b, a, 1))
        at = rng.randrange(len(w))
        spoilt |= {w[:at] + rng.choice("abz") + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "s" + w[at:]}
    spoilt = sorted(x for x in spoilt - set(known) if len(x) > 1)
    words, unknown = spark.createDataFrame([(w, 1) for w in known], "word string, n long"), spark.createDataFrame([(w,) for w in spoilt], "word string")
    distance = {(a, b): scans.weighted_distance(a, b) for a in spoilt for b in known}
    want = {p for p, c in distance.items() if c <= scans.CONFUSED_COST}
    got = {(r.word, r.meant): round(r.cost, 6) for r in scans.corrections(unknown, scans.lexicon_index(words)).collect()}
    assert {p for p, c in got.items() if c <= scans.CONFUSED_COST} == want and len(want) > 100
    # several misreadings, which one key holds but for sequences that run into each other, as they do in words of ten letters
    several = {p for p, c in distance.items() if scans.CONFUSED_COST < c <= scans.MOST_COST}
    assert len(several & set(got)) >= 0.7 * len(several)
    explained = {a for (a, b), c in got.items() if c < 1}
    edits = {(a, b) for a in spoilt for b in known if min(len(a), len(b)) >= scans.SHORTEST_OPEN and plain_distance(a, b) == 1 and a not in explained}
    assert {p for p, c in got.items() if c == 1} == edits and len(edits) > 50


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_counts_equal_brute_force(spark):
    texts = ["l'offre d’un plan A0, n°12 (HA12) : plan A0", "sous-traitant le tra-\nvail un deux", "", "A0"] * 5
    got = {(r["first"], r["second"]): r.n for r in scans.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got["a0", None] == 15 and got["plan", "a0"] == 10 and got["offre", "un"] == 5 and got["sous", "traitant"] == 5
    assert not {k for k in got if "tra" in k or "vail" in k} and ("le", "un") in got


def test_context_and_digits(spark, make_root):
    pages = [dict(doc_id=1, page=1, height=800.0, is_scanned=False), dict(doc_id=2, page=1, height=800.0, is_scanned=True)]
    digital = [block(1, k, FR + " Le plan au format A0 est remis. Les prix unitaires restent fermes. Il note le cas.") for k in range(8)] + [block(1, 20, "le ca5 et le cos zéro")]
    # A0 is a word; an edit of any kind needs both neighbours; a name without neighbours stays
    scanned = [block(2, 0, "Le plan au format A0 est remis."), block(2, 1, "Les prix unitxires restent fermes."), block(2, 2, "Monsieur Unitxires habite ici."), block(2, 3, "Les prix un1taires restent fermes.")]
    # compounds with an elision or a single letter are no cut words
    digital += [block(1, 30, "la main-d'œuvre et un vis-à-vis des main œuvre vis")]
    scanned += [block(2, 4, "la main-\nd'œuvre vis-\nà-vis")]
    root = make_root(doc_pages=pages, blocks=digital + scanned)
    noise = scans.ScanNoise(spark, root)
    assert {(r.block_id, r.noise) for r in noise.found().collect()} == {("b1", "chars"), ("b3", "chars")}
    repaired = {r.block_id: r.text for r in noise.paragraphs().collect()}
    assert repaired["b1"] == "Les prix unitaires restent fermes." and repaired["b4"] == "la main-d'œuvre vis-à-vis"


def test_distance_is_cheap_for_confusions_only():
    assert scans.weighted_distance("traiternent", "traitement") == scans.CONFUSED_COST
    assert scans.weighted_distance("éclairée", "édairée") == scans.CONFUSED_COST
    assert scans.weighted_distance("lot", "lots") == scans.OTHER_COST
    assert scans.is_page_line("- 3 -", 3) and scans.is_page_line("Page 3 sur 12", 3) and not scans.is_page_line("3", 4) and not scans.is_page_line("3 jours", 3)
