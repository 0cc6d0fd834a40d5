"""Accuracy on noise planted into clean text: recall and precision of the operators that no SQL can check."""

import os
import random

import pytest

from quaestor.llm import charforms, places, scans
from quaestor.runtime import table

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


def scores(want, got):
    return len(want & got) / len(want), len(want & got) / max(1, len(got))


def test_scan_noise(spark, make_root):
    rng = random.Random(21)
    scanned = {r.doc_id for r in table(spark, DATA, "doc_pages").where("is_scanned").select("doc_id").distinct().collect()}
    clean = [r for r in table(spark, DATA, "blocks").where("type = 'paragraph' AND length(text) > 60").dropDuplicates(["doc_id", "id"]).collect() if r.doc_id not in scanned and "\n" not in r.text]
    clean.sort(key=lambda r: (r.doc_id, r.id))
    rng.shuffle(clean)
    test, rest = clean[: len(clean) // 4], clean[len(clean) // 4 :]
    box = (50.0, 200.0, 500.0, 300.0)
    blocks = [dict(doc_id=1, id=f"d{k}", type="paragraph", page=1, ord=k, bbox=box, text=r.text) for k, r in enumerate(rest)]
    known = {w.lower() for r in rest for _, _, w in scans.words_of(r.text)}
    want = set()
    for k, r in enumerate(test):
        words, noise = r.text.split(" "), rng.choice(["chars", "hyphen", None])
        usable = [i for i, w in enumerate(words) if len(w) >= 7 and w.isalpha() and w.lower() in known]
        if noise and usable:
            at = rng.choice(usable)
            w = words[at]
            if noise == "chars":
                pairs = [(a, b) for a, b in scans.CONFUSIONS if b in w[1:] and w.replace(b, a, 1).lower() not in known]
                if not pairs:
                    continue
                a, b = rng.choice(pairs)
                words[at] = w[0] + w[1:].replace(b, a, 1)
            else:
                words[at] = w[:3] + "-\n" + w[3:]
            want.add((f"s{k}", noise))
        blocks.append(dict(doc_id=2, id=f"s{k}", type="paragraph", page=1, ord=k, bbox=box, text=" ".join(words)))
    pages = [dict(doc_id=1, page=1, height=800.0, is_scanned=False), dict(doc_id=2, page=1, height=800.0, is_scanned=True)]
    noise = scans.ScanNoise(spark, make_root(doc_pages=pages, blocks=blocks))
    recall, precision = scores(want, {(r.block_id, r.noise) for r in noise.found().collect()})
    repaired = {r.block_id: r.text for r in noise.paragraphs().collect()}
    right = sum(repaired[f"s{k}"] == " ".join(r.text.split()) for k, r in enumerate(test) if f"s{k}" in repaired)
    print(f"scan noise: recall {recall:.3f}, precision {precision:.3f}, repaired {right / len(repaired):.3f} of {len(repaired)}")
    assert recall >= 0.9 and precision >= 0.95 and right >= 0.9 * len(repaired)


def test_places(spark, make_root):
    rng = random.Random(22)
    listed = [(r.place_id, r.name) for r in table(spark, DATA, "places").where("name IS NOT NULL").orderBy("place_id").collect()]
    matcher, want, typed = places.Matcher(listed), {}, []
    for k in range(600):
        place, name = rng.choice(listed)
        at, kind = rng.randrange(1, len(name)), rng.randrange(5)
        edited = [name[:at] + name[at + 1 :], name[:at] + rng.choice("aeiou") + name[at:], name.upper(), f"Commune de {name}", f"{name} et environs"][kind]
        # an edit that makes another listed name, or a name too short for one, proves nothing
        if kind < 2 and (len(places.letters(name)) < 6 or sum(places.distance(places.letters(edited), places.letters(n)) <= 1 for _, n in listed) > 1):
            continue
        typed.append(dict(offer_row=k, lieu_execution=edited))
        want[str(k)] = place
    typed += [dict(offer_row=10_000 + k, lieu_execution=f"Zqxv{k}wkfjq") for k in range(50)]
    assert matcher.kinds
    given = [dict(place_id=i, name=n) for i, n in listed]
    got = {(r.record_key, r.place_id) for r in places.place_cases(spark, make_root(offers=typed, places=given)).collect()}
    truth = {(k, p) for k, p in want.items() if next(o["lieu_execution"] for o in typed if str(o["offer_row"]) == k) not in {n for _, n in listed}} | {(str(10_000 + k), 0) for k in range(50)}
    recall, precision = scores(truth, got)
    print(f"places: recall {recall:.3f}, precision {precision:.3f} of {len(truth)}")
    assert recall >= 0.98 and precision >= 0.98


def test_look_alikes(spark, make_root):
    rng = random.Random(23)
    texts = [r.objet for r in table(spark, DATA, "offers").where("objet IS NOT NULL").orderBy("offer_row").collect()]
    plain = [t for t in texts if charforms.canonical(t) == t and not charforms._POSING.search(t) and t.isprintable()][:300]
    foreign = {b: a for a, bs in charforms.LOOKALIKES.items() for b in bs}
    given, want = [], set()
    for k, t in enumerate(plain):
        spots = [i for i, c in enumerate(t) if c in foreign and (t[i - 1 : i].isalpha() or t[i + 1 : i + 2].isalpha())]
        spoilt = t
        if k % 2 and spots:
            at = rng.choice(spots)
            spoilt = t[:at] + foreign[t[at]] + t[at + 1 :]
            want.add(str(k))
        given.append(dict(offer_row=k, objet=spoilt))
    root = make_root(offers=given)
    got = {r.record_key for r in charforms.unlike_house_form(spark, root).collect()}
    recall, precision = scores(want, got)
    normal = {r.record_key: r.normal for r in charforms.house_form(charforms.text_values(spark, root)).collect()}
    right = sum(normal[str(k)] == t for k, t in enumerate(plain))
    print(f"look-alikes: recall {recall:.3f}, precision {precision:.3f}, restored {right / len(plain):.3f}")
    assert recall >= 0.95 and precision >= 0.98 and right >= 0.95 * len(plain)
