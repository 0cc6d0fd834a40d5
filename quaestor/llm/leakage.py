"""Held-out items leaking into a corpus: BM25 index of the items, searched by block-max WAND.

The items are indexed (impact-ordered weights, posting blocks with their maxima) and
broadcast in shards of bounded size. Every document is cut into passages: its stretches of
indexed words (a word no item has cannot be in a shared run), in pieces that overlap by
twelve words, so each run of thirteen lies wholly in one passage; every passage is a query. Each item has its own threshold, the least BM25 score that any of its runs of
thirteen words (or the whole item, if shorter) can reach, so the search loses no case:
a passage that holds such a run scores at least as much. Weights are divided by the item's
threshold, which makes the threshold 1 for all and WAND applicable. Candidates are then
verified word by word.

Defined results: null and empty documents or items give nothing; items without words and
rows without a key are left out; repeated rows count once; texts equal under several ids are each reported; whole
texts of any length; extra columns are never read.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 13
PASSAGE = 64
K1, B = 1.2, 0.75
BLOCK = 16
#: Words per broadcast shard of the index.
SHARD_WORDS = 500_000

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_MARKS = regex.compile(r"\p{M}+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case and accents."""
    flat = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()
    return _WORDS.findall(flat.replace("œ", "oe").replace("æ", "ae"))


class ItemIndex:
    """Inverted index with block maxima over the items of one shard."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int], n_items: int, mean_length: float):
        self.ids = [i for i, _ in items]
        self.runs: dict[tuple[str, ...], list[int]] = defaultdict(list)
        self.short: set[int] = set()
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, ws) in enumerate(items):
            tf = Counter(ws)
            norm = K1 * (1 - B + B * len(ws) / mean_length)
            weight = {
                t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in tf.items()
            }
            span = min(RUN, len(ws))
            windows = {tuple(ws[k : k + span]) for k in range(len(ws) - span + 1)}
            least = min(sum(weight[t] for t in set(w)) for w in windows)
            for w in windows:
                self.runs[w].append(at)
            self.short.add(span)
            for t, x in weight.items():
                postings[t].append((at, x / least))
        self.postings = {t: ([p for p, _ in ps], [x for _, x in ps]) for t, ps in postings.items()}
        self.top = {t: max(xs) for t, (_, xs) in self.postings.items()}
        self.blocks = {
            t: ([at[min(k + BLOCK, len(at)) - 1] for k in range(0, len(at), BLOCK)], [max(xs[k : k + BLOCK]) for k in range(0, len(at), BLOCK)])
            for t, (at, xs) in self.postings.items()
        }

    def search(self, terms: set[str], threshold: float = 1.0 - 1e-9) -> list[int]:
        """All items (positions) scoring at least the threshold for a set of terms."""
        top = self.top
        lists = [t for t in terms if t in top]
        if sum(top[t] for t in lists) < threshold:
            return []
        end = len(self.ids)
        cursors = [[self.postings[t][0][0], 0, t] for t in lists]  # item, position, term
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] == end:
                    break
                bound += top[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # block maxima of the lists up to the pivot at this item
            shallow, horizon = 0.0, end
            for c in cursors[: pivot + 1]:
                last, best = self._block(c[2], c[1], item)
                shallow += best
                horizon = min(horizon, last + 1)
            if shallow >= threshold:
                if cursors[0][0] == item:
                    score = sum(self.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append(item)
                    for c in cursors[: pivot + 1]:
                        self._advance(c, item + 1, end)
                else:
                    for c in cursors[:pivot]:
                        if c[0] < item:
                            self._advance(c, item, end)
            else:
                goal = horizon
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
                for c in cursors[: pivot + 1]:
                    self._advance(c, goal, end)

    def _block(self, term: str, position: int, item: int) -> tuple[int, float]:
        """(last item, maximum) of the block where ``item`` would lie in the list of ``term``."""
        lasts, tops = self.blocks[term]
        k = bisect_left(lasts, item, position // BLOCK)
        return (lasts[k], tops[k]) if k < len(lasts) else (len(self.ids), 0.0)

    def _advance(self, cursor: list, goal: int, end: int) -> None:
        at = self.postings[cursor[2]][0]
        cursor[1] = k = bisect_left(at, goal, cursor[1])
        cursor[0] = at[k] if k < len(at) else end

    def leaks(self, ws: list[str]) -> set[int]:
        """item ids whose runs occur in a document of these words."""
        out: set[int] = set()
        for passage in self.passages(ws):
            candidates = self.search(set(passage))
            fresh = {c for c in candidates if self.ids[c] not in out}
            if not fresh:
                continue
            for span in self.short:
                for k in range(len(passage) - span + 1):
                    for hit in self.runs.get(tuple(passage[k : k + span]), ()):
                        if hit in fresh:
                            out.add(self.ids[hit])
        return out

    def passages(self, ws: list[str]) -> Iterator[list[str]]:
        """Stretches of indexed words, cut into overlapping passages.

        A word that no item has ends a stretch, since no shared run can hold it; stretches
        shorter than the shortest run sought are no passages.
        """
        known, least, step = self.top, min(self.short), PASSAGE - RUN + 1
        start, n = 0, len(ws)
        while start < n:
            if ws[start] not in known:
                start += 1
                continue
            end = start + 1
            while end < n and ws[end] in known:
                end += 1
            if end - start >= least:
                for at in range(start, max(start + 1, end - RUN + 1), step):
                    yield ws[at : min(at + PASSAGE, end)]
            start = end + 1


def build_shards(items: list[tuple[int, str]], shard_words: int = SHARD_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with their words, in groups of at most ``shard_words`` words (one item at least)."""
    group, size = [], 0
    for ident, text in items:
        ws = words(text or "")
        if not ws:
            continue
        if group and size + len(ws) > shard_words:
            yield group
            group, size = [], 0
        group.append((ident, ws))
        size += len(ws)
    if group:
        yield group


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, item_id) of every document that holds a passage of an item.

    The items stream to the driver shard by shard; each shard is one pass over the corpus.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, item_id bigint"
    rows = documents.where((F.length(text) > 0) & F.col(key).isNotNull()).select(key, text)
    local = ((r.item_id, r.text) for r in items.where(F.col("item_id").isNotNull()).dropDuplicates(["item_id"]).orderBy("item_id").select("item_id", "text").toLocalIterator())
    out = None
    for group in build_shards(local, shard_words):
        df = Counter(w for _, ws in group for w in set(ws))
        index = ItemIndex(group, df, len(group), sum(len(ws) for _, ws in group) / len(group))
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            from quaestor.llm.leakage import words as cut

            own = shared.value
            for batch in batches:
                hits = [(k, i) for k, t in zip(batch[key], batch[text]) for i in own.leaks(cut(t))]
                yield pd.DataFrame(hits, columns=[key, "item_id"]).astype({"item_id": "int64"})

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out.distinct()
