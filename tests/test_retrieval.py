import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows

from quaestor.operators import retrieval as r


def brute(docs, queries, k, encode=None):
    """All scores of all pairs, then the k best of each query, leg and tier."""
    df = Counter(t for d in docs for t in set(d["terms"] or []))
    out = []
    for q in queries:
        for leg in ("lexical", "dense"):
            scored = []
            for d in docs:
                own = d["terms"] or []
                if q["wanted"] and d["category"] not in q["wanted"]:
                    continue
                if leg == "lexical":
                    tf = Counter(own)
                    parts = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(own) / 256)) for t in set(q["terms"] or []) if tf[t]]
                    if not parts:
                        continue
                    score = sum(parts)
                else:
                    a, b = encode(q["terms"] or []), encode(own)
                    if not a.any() or not b.any():
                        continue
                    score = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
                scored.append((-round(score, 6), d["d"], bool(set(d["places"] or []) & set(q["near"] or []))))
            scored.sort()
            tiers = [(0, [x for x in scored if x[2]]), (1, scored)] if q["near"] else [(0, scored)]
            out += [(q["q"], d, leg, tier, -s, n) for tier, own in tiers for n, (s, d, _) in enumerate(own[:k])]
    return sorted(out, key=repr)


DOCS = "d long, terms array<string>, category string, places array<string>"
QUERIES = "q string, terms array<string>, wanted array<string>, near array<string>"


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_search_equals_all_pairs(spark, k, monkeypatch):
    rng = random.Random(k)
    words = [f"mot{x}" for x in range(40)] + ["de"] * 30 + ["la"] * 20
    docs = [dict(d=i, terms=rng.choice([None, []]) if i % 50 == 0 else [rng.choice(words) for _ in range(rng.randint(1, 30))], category=rng.choice(["a", "b", None]), places=rng.choice([None, [], ["x"], ["x", "y"]])) for i in range(400)]
    docs += [dict(d=1000 + i, terms=docs[3]["terms"], category="a", places=["x"]) for i in range(6)]  # ties
    queries = [dict(q=f"q{i}", terms=sorted({rng.choice(words) for _ in range(rng.randint(1, 8))}), wanted=rng.choice([None, [], ["a"], ["a", "b"], ["c"]]), near=rng.choice([None, [], ["y"], ["x", "z"]])) for i in range(25)]
    queries += [dict(q="none", terms=None, wanted=None, near=None), dict(q="unknown", terms=["absent"], wanted=None, near=["x"])]
    monkeypatch.setattr(r, "BLOCK_QUERIES", 10)
    given = spark.createDataFrame([(x["d"], x["terms"], x["category"], x["places"]) for x in docs] + [(None, ["de"], "a", ["x"])], DOCS)
    asked = spark.createDataFrame([(x["q"], x["terms"], x["wanted"], x["near"]) for x in queries], QUERIES)
    # the row without a key is left out everywhere
    assert rows(r.search(given.repartition(5), asked, "d", "q", k, r.hashed_trigrams)) == brute(docs, queries, k, r.hashed_trigrams)
    assert r.search(given.limit(0), asked, "d", "q", k).count() == 0 and r.search(given, asked.limit(0), "d", "q", k).count() == 0


def test_terms_that_cannot_matter_are_not_followed():
    """With a bar above what is left, common terms score only rows already met."""
    batch = r.Batch(np.arange(1000), [["de", "rare"] if k == 7 else ["de"] for k in range(1000)], None, None, None, frozenset(["de", "rare"]))
    q = r.Query("q", {"rare": 6.0, "de": 0.01})
    assert len(batch.lexical(q, -math.inf, None)[0]) == 1000
    found, scores = batch.lexical(q, 1.0, None)
    assert list(found) == [7] and scores[0] > 6


def test_fallback_keeps_strict_hits_first(spark):
    fused = spark.createDataFrame([("e", 0, 1, 0.5, 0), ("e", 1, 2, 0.9, 0), ("e", 1, 1, 0.5, 1), ("e", 1, 3, 0.1, 2), ("f", 0, 2, 0.9, 0)], "q string, tier int, d long, score double, rank int")
    got = r.tiered(fused, "q", "d", k=2).select("q", "position", "d", "tier")
    assert rows(got) == [("e", 1, 1, 0), ("e", 2, 2, 1), ("f", 1, 2, 0)]


def test_nearest_vectors_and_fusion(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.0]), (5, None)], "d long, vector array<float>")
    asked = spark.createDataFrame([(7, [3.0, 0.0])], "q long, vector array<float>")
    near = r.search(vectors, asked, "d", "q", k=3)
    assert rows(near.select("q", "d", "score", "rank")) == [(7, 1, 1.0, 0), (7, 2, 0.707107, 2), (7, 4, 1.0, 1)]  # equal scores go by id
    legs = near.unionByName(spark.createDataFrame([(7, 2, "lexical", 0, 5.0, 0)], "q long, d long, leg string, tier int, score double, rank int"))
    assert [x.d for x in r.fuse(legs, "q", "d").orderBy("rank").collect()] == [2, 1, 4]
