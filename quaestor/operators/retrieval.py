"""Lexical and vector retrieval, rank fusion, tiered fallback and reasons.

A search takes a stated set of queries against all rows. The queries go out in blocks of
bounded size, each block one pass over the rows. A task keeps the best rows of every query
while it reads, so a term or vector that cannot reach them any more is not followed: terms
are taken from the most to the least telling, and once those left cannot lift a row over the
worst kept one, only rows already met are scored to the end. What leaves a task is at most
the wanted number of rows per query, leg and tier; no join on terms takes place, and no hot
term gathers anywhere.

Scores are rounded to six digits and ties are broken by id, so rankings are the same on
every run. Null texts have no terms; queries without terms or vectors get no candidates of
that leg; rows without a key are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import normalize_locations, normalize_text
from quaestor.runtime import written

K1, B, MEAN_LENGTH = 1.2, 0.75, 256.0
CANDIDATES, LIMIT, RRF_K = 50, 10, 2
WORD = r"[\p{L}\p{N}]+"
SEMANTIC = "Semantic similarity with enterprise keywords"
#: Queries of a block, and their terms together: what is broadcast at a time.
BLOCK_QUERIES, BLOCK_TERMS = 2_000, 400_000
#: Rows from which a task of its own pays, as each task sends the k best of every query on.
ROWS_PER_TASK = 10 * CANDIDATES
#: Dimensions of the built-in encoder; other encoders are a parameter.
DIMENSIONS = 256


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, length); counted per document before anything is gathered."""
    tokens = docs.select(key, terms(text).alias("_t")).withColumn("length", F.size("_t"))
    return tokens.select(key, "length", F.explode("_t").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def top(scored: DataFrame, by: list[str], key: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best per group; the rank starts at 0. Planned as a group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.col(key))
    return scored.withColumn(rank, F.row_number().over(w) - 1).where(F.col(rank) < k)


@lru_cache(maxsize=500_000)
def _trigrams(term: str) -> tuple[tuple[int, int], ...]:
    """(dimension, sign) of each trigram of a term with its edges, from their MD5."""
    edged = f"^{term}$"
    digests = [hashlib.md5(edged[i : i + 3].encode()).hexdigest() for i in range(len(edged) - 2)]
    return tuple((int(d[:4], 16) % DIMENSIONS, 1 if d[4] < "8" else -1) for d in digests)


def hashed_trigrams(own: list[str]) -> np.ndarray:
    """Signed counts of the trigrams of a text's distinct terms: a vector that needs no model."""
    out = np.zeros(DIMENSIONS)
    for term in set(own):
        for at, sign in _trigrams(term):
            out[at] += sign
    return out


@dataclass
class Query:
    """One query: weights of its terms, its vector, and what it restricts rows to (None: nothing)."""

    key: object
    weights: dict[str, float] = field(default_factory=dict)
    vector: np.ndarray | None = None
    wanted: frozenset[str] | None = None
    near: frozenset[str] = frozenset()


class Best:
    """The k best (score, key) pairs so far, higher scores and then lower keys first."""

    def __init__(self, k: int):
        self.k, self.scores, self.keys = k, np.empty(0), np.empty(0, dtype="int64")

    def bar(self) -> float:
        """What a row must reach to be kept."""
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        keep = scores >= self.bar()
        if not keep.any():
            return
        scores, keys = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.keys, keys[keep]])
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys = scores[order], keys[order]


class Batch:
    """Rows of one Arrow batch: impacts by term, places, categories, unit vectors."""

    def __init__(self, keys: np.ndarray, texts: list | None, vectors: np.ndarray | None, categories: list | None, places: list | None, known: frozenset[str]):
        self.keys, self.vectors = keys, vectors
        self.postings: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        if texts is not None:
            gathered: dict[str, list[tuple[int, float]]] = {}
            for row, own in enumerate(texts):
                if own is None or not len(own):
                    continue
                norm = K1 * (1 - B + B * len(own) / MEAN_LENGTH)
                for term, tf in Counter(own).items():
                    if term in known:
                        gathered.setdefault(term, []).append((row, tf * (K1 + 1) / (tf + norm)))
            self.postings = {t: (np.array([r for r, _ in x]), np.array([w for _, w in x])) for t, x in gathered.items()}
        self.categories: dict[str, np.ndarray] = {}
        if categories is not None:
            column = np.array([c if c is not None else "" for c in categories], dtype=object)
            self.categories = {c: column == c for c in set(column)}
        self.places: dict[str, list[int]] = {}
        for row, own in enumerate(places if places is not None else []):
            for place in own if own is not None else ():
                self.places.setdefault(place, []).append(row)

    def open_to(self, query: Query) -> np.ndarray | None:
        """Rows of the wanted categories; None for all."""
        if query.wanted is None:
            return None
        out = np.zeros(len(self.keys), dtype=bool)
        for c in query.wanted:
            if c in self.categories:
                out |= self.categories[c]
        return out

    def near_to(self, query: Query) -> np.ndarray:
        out = np.zeros(len(self.keys), dtype=bool)
        for place in query.near:
            out[self.places.get(place, [])] = True
        return out

    def lexical(self, query: Query, bar: float, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of every allowed row that may reach the bar."""
        found = [(self.postings[t][1].max() * w, w, *self.postings[t]) for t, w in query.weights.items() if t in self.postings]
        found.sort(key=lambda x: -x[0])
        rest = np.cumsum([x[0] for x in found][::-1])[::-1] if found else np.empty(0)
        scores, met, at = np.zeros(len(self.keys)), np.zeros(len(self.keys), dtype=bool), 0
        while at < len(found) and rest[at] >= bar - 1e-6:
            _, w, rows, impacts = found[at]
            scores[rows] += w * impacts
            met[rows] = True
            at += 1
        rows = np.flatnonzero(met if allowed is None else met & allowed)
        for k in range(at, len(found)):
            _, w, own, impacts = found[k]
            rows = rows[scores[rows] + rest[k] >= bar - 1e-6]
            if not len(rows):
                break
            spot = np.minimum(np.searchsorted(own, rows), len(own) - 1)
            scores[rows] += np.where(own[spot] == rows, w * impacts[spot], 0.0)
        return rows, np.round(scores[rows], 6)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)


FOUND = "leg string, tier int, score double"


def _search_block(docs: DataFrame, block: list[Query], key: str, query: str, kind: str, k: int, encode: Callable | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_QUERIES queries of BLOCK_TERMS terms
    columns = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        known = frozenset(t for q in own for t in q.weights)
        dense = [q for q in own if q.vector is not None]
        block_vectors = _unit(np.stack([q.vector for q in dense])) if dense else None
        best: dict[tuple[int, str, int], Best] = {}

        def keep(n: int, leg: str, q: Query, batch: Batch, rows: np.ndarray, scores: np.ndarray, near: np.ndarray | None) -> None:
            # tier 0 is the strict one; a query that is near nothing has only that
            best.setdefault((n, leg, 1 if q.near else 0), Best(k)).add(scores, batch.keys[rows])
            if q.near:
                inside = near[rows]
                best.setdefault((n, leg, 0), Best(k)).add(scores[inside], batch.keys[rows[inside]])

        for frame in batches:
            if not len(frame):
                continue
            texts = list(frame["terms"]) if "terms" in columns else None
            vectors = None
            if dense:
                vectors = np.stack(frame["vector"].to_numpy()).astype("float64") if "vector" in columns else np.stack([encode(list(t) if t is not None else []) for t in texts])
                vectors = _unit(vectors)
            batch = Batch(frame[key].to_numpy(), texts, vectors, list(frame["category"]) if "category" in columns else None, list(frame["places"]) if "places" in columns else None, known)
            nothing = np.array([not v.any() for v in vectors]) if dense else None
            place = {id(q): n for n, q in enumerate(dense)}
            for start in range(0, len(own), 200):
                part = [q for q in own[start : start + 200]]
                own_rows = [place[id(q)] for q in part if q.vector is not None]
                cosines = np.round(block_vectors[own_rows] @ vectors.T, 6) if own_rows else None
                row_of = {id(q): n for n, q in enumerate(x for x in part if x.vector is not None)}
                for n, q in enumerate(part, start):
                    allowed = batch.open_to(q)
                    near = batch.near_to(q) if q.near else None
                    if q.weights:
                        bar = min([best[n, "lexical", t].bar() if (n, "lexical", t) in best else -math.inf for t in ((0, 1) if q.near else (0,))])
                        rows, scores = batch.lexical(q, bar, allowed)
                        keep(n, "lexical", q, batch, rows, scores, near)
                    if q.vector is not None:
                        open_ = ~nothing if allowed is None else allowed & ~nothing
                        rows = np.flatnonzero(open_)
                        keep(n, "dense", q, batch, rows, cosines[row_of[id(q)]][rows], near)
        out = [(own[n].key, int(d), leg, tier, float(x)) for (n, leg, tier), b in best.items() for x, d in zip(b.scores, b.keys)]
        yield pd.DataFrame(out, columns=[query, key, "leg", "tier", "score"])

    return docs.mapInPandas(run, f"{query} {kind}, {key} bigint, {FOUND}")


def search(docs: DataFrame, queries: DataFrame, key: str, query: str, k: int = CANDIDATES, encode: Callable | None = None) -> DataFrame:
    """(query, key, leg, tier, score, rank): the k best rows of each query, leg and tier.

    ``docs`` has ``key`` and some of ``terms``, ``vector``, ``category``, ``places``; ``queries``
    has ``query`` and some of ``terms``, ``vector``, ``wanted`` (categories; none means any) and
    ``near`` (places). With ``encode`` vectors are made of terms. Tier 1 are all rows of a
    query that is near some place, tier 0 those that share one; other queries have tier 0 alone.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c in (key, "terms", "vector", "category", "places") if c in docs.columns]).where(F.col(key).isNotNull())
    if "vector" in docs.columns:
        docs = docs.where(F.col("vector").isNotNull())
    kind = queries.schema[query].dataType.simpleString()
    idf: dict[str, float] = {}
    lexical = "terms" in docs.columns and "terms" in queries.columns
    if lexical:
        n = docs.count()
        counts = docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        asked = queries.select(F.explode("terms").alias("term")).distinct()
        counts = written(counts.join(asked, "term", "left_semi"))

    def frequencies(block: list) -> dict[str, int]:
        own = spark.createDataFrame([(t,) for t in {t for r in block for t in r["terms"] or []}], "term string")
        return {r.term: r.df for r in counts.join(own, "term").collect()}

    out = None
    rows = iter(queries.toLocalIterator())
    while block := _block(rows, lexical):
        df = frequencies(block) if lexical else {}
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        made = []
        for r in block:
            given = r.asDict()
            own = given.get("terms") or []
            vector = given.get("vector")
            if vector is None and encode is not None and own:
                vector = encode(list(own))
            vector = None if vector is None else np.asarray(vector, dtype="float64")
            wanted = given.get("wanted")
            made.append(
                Query(given[query], {t: idf[t] for t in dict.fromkeys(own) if t in idf}, vector if vector is not None and vector.any() else None, frozenset(wanted) if wanted else None, frozenset(given.get("near") or ()))
            )
        found = _search_block(docs, made, key, query, kind, k, encode)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"{query} {kind}, {key} bigint, {FOUND}")
    return top(out, [query, "leg", "tier"], key, k)


def _block(rows: Iterator, lexical: bool) -> list:
    """The next queries, as many as may go out together."""
    block, size = [], 0
    for r in islice(rows, BLOCK_QUERIES):
        block.append(r)
        size += len(r["terms"] or []) if lexical else 1
        if size > BLOCK_TERMS:
            break
    return block


def fuse(found: DataFrame, query: str, key: str, k: int = LIMIT) -> DataFrame:
    """(query, tier, key, score, rank): reciprocal-rank fusion of the legs of each tier (ranks from 0)."""
    part = F.lit(1.0) / (RRF_K + F.col("rank"))
    return top(found.groupBy(query, "tier", key).agg(F.round(F.sum(part), 6).alias("score")), [query, "tier"], key, k)


def tiered(fused: DataFrame, query: str, key: str, k: int = LIMIT) -> DataFrame:
    """(query, key, tier, score, position): strict hits first, filled up with relaxed ones; an item keeps its lowest tier."""
    best = fused.groupBy(query, key).agg(F.min(F.struct("tier", "rank", "score")).alias("b")).select(query, key, "b.*")
    w = Window.partitionBy(query).orderBy("tier", "rank")
    return best.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("rank")


def reasons(keywords: Column, categories: Column, locations: Column, objet: Column, category: Column, places: Column) -> Column:
    """Up to three keywords found in the text, the category, the first common place; else similarity."""
    near = F.flatten(F.transform(locations, normalize_locations))
    return reasons_of(keywords, F.transform(keywords, normalize_text), F.transform(categories, normalize_text), near, normalize_text(objet), category, places)


def reasons_of(keywords: Column, plain_keywords: Column, wanted: Column, near: Column, plain_objet: Column, category: Column, places: Column) -> Column:
    """The same from values normalised before, as a profile or an offer is shown many times."""
    words = F.slice(F.filter(F.arrays_zip(keywords.alias("word"), plain_keywords.alias("plain")), lambda k: plain_objet.contains(k["plain"])), 1, 3)
    hits = F.transform(words, lambda k: F.concat(F.lit("Matched keyword: "), k["word"]))
    cat = F.when(F.array_contains(wanted, category), F.array(F.concat(F.lit("Matched category: "), category)))
    shared = F.array_intersect(near, places)
    place = F.when(F.size(shared) > 0, F.array(F.concat(F.lit("Matched location: "), F.array_min(shared))))
    none = F.array().cast("array<string>")
    out = F.concat(F.coalesce(hits, none), F.coalesce(cat, none), F.coalesce(place, none))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(SEMANTIC)))
