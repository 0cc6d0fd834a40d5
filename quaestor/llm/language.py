"""Languages of pages and of their segments, by hierarchical discrimination.

Text is cut into segments (sentences, list items, table cells). A segment's family comes
first: its script, and for Latin letters a linear support vector machine that separates
Romance from Germanic; within the Romance family a one-versus-one machine separates French
from Spanish. Features are words and the character n-grams inside them, so a segment's
score is a sum over its words, which a worker keeps in a cache.

The machines are fitted on pages whose hint names one language: at most
``SAMPLE_PAGES`` pages and ``SAMPLE_SENTENCES`` sentences per language, taken by the order
of a hash of their key, without those that a word model of all of them contradicts, as
hints are sometimes wrong. Every page is then judged; nothing is sampled there.

Segments too short or too close to a border for a verdict take the language of the page's
other Latin segments, else the document's, else their own likeliest.

Defined results: pages without letters (or blocks) are ``fr``, confidence 0; null and empty
texts have no segments; repeated block rows count once; a hint that names no language is
missing; blocks without document or page are left out; whole texts; extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.runtime import spread, table, written

SAMPLE_PAGES = 1500
SAMPLE_SENTENCES = 4000
DIMENSIONS = 1 << 16
EPOCHS, LAMBDA = 3, 1e-4
#: A language counts for a page above this share of its letters.
SHARE = 0.15
#: Below so many Latin letters, or so small a margin, a segment takes its neighbours' language.
FEW_LETTERS, CLEAR_MARGIN = 16, 0.35
#: Text whose words run together (longer than this on average) needs a wider margin.
GLUED_LENGTH, GLUED_MARGIN = 25, 0.8
LANGUAGES = ("fr", "ar", "en", "es")

# Ways to write each language.
HINT_NAMES = {
    "fr": "fr fra fre french francais français francés frances francese franz französisch الفرنسية فرنسية فرنسي",
    "ar": "ar ara arabic arabe árabe arabo arabisch العربية عربية عربي",
    "en": "en eng english anglais inglés ingles inglese englisch الإنجليزية إنجليزية انجليزية",
    "es": "es spa esp spanish espagnol español espanol castellano castillan spagnolo spanisch الإسبانية إسبانية",
    "mixed": "mixed mixte mixto mul multi multiple multilingual multilingue bilingue bilingual plusieurs مختلط",
}

_CELLS = regex.compile(r"[|\n]+")
_ITEMS = regex.compile(r"\n(?=\s*(?:[-•*–]|\d+[.)])\s)|\n\s*\n")
_SENTENCES = regex.compile(r"(?<=[.!?؟…])\s+|(?<=[.؟!?])(?=\p{Lu}\p{Ll})")
_LATIN_WORD = regex.compile(r"[\p{Latin}\p{M}'’]+")
_LATIN, _ARABIC = regex.compile(r"\p{Latin}+"), regex.compile(r"[\p{Arabic}--\p{N}--\p{M}--\p{P}]+", regex.V1)


def hinted_language(hint: Column) -> Column:
    """The language a hint means (or ``mixed``); null if it names none of the known ones."""
    pairs = [F.lit(x) for lang, names in HINT_NAMES.items() for name in names.split() for x in (name, lang)]
    plain = F.lower(F.trim(F.regexp_replace(hint, r"[\s ]+", " ")))
    known = F.create_map(*pairs)
    return F.coalesce(F.element_at(known, plain), F.element_at(known, F.regexp_extract(plain, r"^(\p{L}{2,3})[-_]\p{L}{2,4}", 1)))


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the segments of a block's text."""
    if text.lstrip().startswith("|"):
        cuts = [m.span() for m in _CELLS.finditer(text)]
    else:
        cuts = sorted([m.span() for m in _ITEMS.finditer(text)] + [m.span() for m in _SENTENCES.finditer(text)])
    out, start = [], 0
    for a, b in cuts:
        if a < start:
            continue
        if text[start:a].strip():
            out.append((start, a))
        start = b
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def arabic_letters(text: str) -> int:
    return 0 if text.isascii() else sum(map(len, _ARABIC.findall(text)))


@lru_cache(maxsize=200_000)
def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its n-grams of 1 to 4 with edges."""
    edged = f"^{word}$"
    grams = {edged} | {edged[i : i + n] for n in (2, 3, 4) for i in range(len(edged) - n + 1)} | set(word)
    return sorted({zlib.crc32(g.encode()) % DIMENSIONS for g in grams})


def latin_words(text: str) -> list[str]:
    return [w.lower() for w in _LATIN_WORD.findall(text)]


class LinearSVM:
    """Two-class linear support vector machine, hinge loss, averaged stochastic subgradient."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, samples: list[list[int]], signs: list[int]) -> "LinearSVM":
        """Samples are lists of features (repeats count), each scaled to mean 1."""
        order = np.random.default_rng(7)
        w, total = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        bias = bias_total = 0.0
        scale, t = 1.0, 0
        packed = [np.unique(np.asarray(s), return_counts=True) for s in samples]
        packed = [(i, c / np.sqrt((c * c).sum())) for i, c in packed]
        balance = {s: len(signs) / (2 * max(1, signs.count(s))) for s in (1, -1)}
        for _ in range(EPOCHS):
            for k in order.permutation(len(packed)):
                t += 1
                rate = 1 / (LAMBDA * (t + 1000))
                index, value = packed[k]
                margin = signs[k] * (scale * (w[index] @ value) + bias)
                scale *= 1 - rate * LAMBDA
                if margin < 1:
                    w[index] += rate * balance[signs[k]] * signs[k] * value / scale
                    bias += 0.01 * signs[k]
                if t % 50 == 0:
                    total += scale * w
                    bias_total += bias
        n = max(1, t // 50)
        return cls((total / n).astype("float32"), bias_total / n)


class Discriminator:
    """Family first, then one against one within the Romance family."""

    def __init__(self, family: LinearSVM, romance: LinearSVM):
        self.family, self.romance = family, romance
        self.cache: dict[str, tuple[float, float, int, int]] = {}

    def __getstate__(self):
        return {"family": self.family, "romance": self.romance, "cache": {}}

    def _word(self, word: str) -> tuple[float, float, int, int]:
        if len(self.cache) > 300_000:
            self.cache.clear()
        index = word_features(word.lower())
        known = float(self.family.weights[index].sum()), float(self.romance.weights[index].sum()), len(index), sum(map(len, _LATIN.findall(word)))
        self.cache[word] = known
        return known

    def latin(self, text: str) -> tuple[str | None, float, int]:
        """(language, margin, letters) of the Latin words of a text; words are judged once per worker."""
        family = romance = 0.0
        size, letters, cache = 0, 0, self.cache
        for word in _LATIN_WORD.findall(text):
            f, r, n, own = cache.get(word) or self._word(word)
            family += f
            romance += r
            size += n
            letters += own
        if not letters:
            return None, 0.0, 0
        scale = size**0.5
        f, r = family / scale + self.family.bias, romance / scale + self.romance.bias
        if f < 0:
            return "en", -f, letters
        return ("fr", min(f, r), letters) if r >= 0 else ("es", min(f, -r), letters)


def agreed_examples(examples: dict[str, list[str]], rounds: int = 2) -> dict[str, list[str]]:
    """The sentences whose hinted language a word model of all sentences confirms.

    Hints are wrong often enough that a rare language's sentences are a third foreign. A
    foreign word is still far more frequent under its own label, so a multinomial model of
    words, without class priors, tells them apart; it is fitted again on what it confirmed.
    """
    data = [(lang, text, latin_words(text)) for lang, texts in sorted(examples.items()) for text in texts]
    data = [x for x in data if sum(map(len, x[2])) >= 30]
    kept = data
    for _ in range(rounds):
        counts = {lang: Counter() for lang in examples}
        for lang, _, ws in kept:
            counts[lang].update(ws)
        size = len(set().union(*counts.values())) + 1
        total = {lang: c.total() + 1 + 0.1 * size for lang, c in counts.items()}
        logs = {lang: {w: np.log((n + 0.1) / total[lang]) for w, n in c.items()} for lang, c in counts.items()}
        unseen = {lang: np.log(0.1 / total[lang]) for lang in examples}

        def likeliest(ws: list[str]) -> str:
            return max(logs, key=lambda g: sum(logs[g].get(w, unseen[g]) for w in ws))  # noqa: B023

        kept = [x for x in data if likeliest(x[2]) == x[0]]
    out: dict[str, list[str]] = {}
    for lang, text, _ in kept:
        out.setdefault(lang, []).append(text)
    return out


def fit_discriminator(examples: dict[str, list[str]]) -> Discriminator:
    """Machines from sentences by hinted language."""
    agreed = agreed_examples(examples)
    # every other sentence is learnt without its spaces too, as layout steps lose them
    texts = [(lang, t) for lang, own in sorted(agreed.items()) for t in own]
    texts += [(lang, "".join(t.split())) for k, (lang, t) in enumerate(texts) if k % 2]
    data = [(lang, [i for w in latin_words(t) for i in word_features(w)]) for lang, t in texts]

    def machine(plus: set[str], minus: set[str]) -> LinearSVM:
        chosen = [(f, 1 if lang in plus else -1) for lang, f in data if lang in plus | minus]
        if len({s for _, s in chosen}) < 2:
            # one class only: everything is of that class
            return LinearSVM(np.zeros(DIMENSIONS, "float32"), -1.0 if any(s < 0 for _, s in chosen) else 1.0)
        return LinearSVM.fit([f for f, _ in chosen], [s for _, s in chosen])

    return Discriminator(machine({"fr", "es"}, {"en"}), machine({"fr"}, {"es"}))


def sample_sentences(pages: DataFrame, blocks: DataFrame) -> dict[str, list[str]]:
    """Sentences of at most ``SAMPLE_PAGES`` hinted pages per Latin language (bounded by then)."""
    out: dict[str, list[str]] = {}
    labelled = pages.select("doc_id", "page", hinted_language(F.col("language_hint")).alias("lang")).where(F.col("lang").isin("fr", "en", "es"))
    chosen = None
    for lang in ("fr", "en", "es"):
        part = labelled.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id", "page"), "doc_id", "page").limit(SAMPLE_PAGES)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = blocks.where(F.length("text").between(60, 3000)).select("doc_id", "page", "text").join(F.broadcast(chosen), ["doc_id", "page"])
    # about ten blocks a page at most are read per page chosen, in hash order
    bounded = rows.orderBy(F.xxhash64("text")).limit(3 * SAMPLE_PAGES * 3)
    for row in bounded.toLocalIterator():
        mine = out.setdefault(row.lang, [])
        for a, b in segments(row.text):
            if len(mine) < SAMPLE_SENTENCES:
                mine.append(row.text[a:b])
    return out


def judged_parts(text: str, judge: Discriminator) -> list[tuple]:
    """(seg_no, start, end, ar_letters, latin_letters, latin_language, margin, clear) of a text's segments with letters."""
    out = []
    for n, (a, b) in enumerate(segments(text)):
        part = text[a:b]
        arabic = arabic_letters(part)
        lang, margin, latin = judge.latin(part)
        if not arabic and not latin:
            continue
        clear = latin >= FEW_LETTERS and margin >= (GLUED_MARGIN if len(part) > GLUED_LENGTH * (1 + part.count(" ")) else CLEAR_MARGIN)
        out.append((n, a, b, arabic, latin, lang, margin, clear))
    return out


SEGMENT_ROW = (
    "doc_id bigint, page int, block_id string, seg_no int, start int, end int, "
    "ar_letters int, latin_letters int, latin_language string, margin double, clear boolean"
)
SUMS = ["ar", *[f"{x}_{k}" for x in ("fr", "en", "es") for k in ("clear", "vague")]]
BLOCK_ROW = "doc_id bigint, page int, block_id string, " + ", ".join(f"{c} bigint" for c in SUMS)


def _texts(blocks: DataFrame) -> DataFrame:
    texts = blocks.where((F.length("text") > 0) & F.col("doc_id").isNotNull() & F.col("page").isNotNull()).select("doc_id", "page", F.col("id").alias("block_id"), "text")
    return spread(texts, "doc_id", "block_id")


def judged_segments(blocks: DataFrame, judge: Discriminator) -> DataFrame:
    """One row per segment of every block, see ``SEGMENT_ROW``."""
    shared = blocks.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = [(doc, page, block, *part) for doc, page, block, text in batch.itertuples(index=False) for part in judged_parts(text, own)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT_ROW.split(", ")])

    return _texts(blocks).mapInPandas(run, SEGMENT_ROW)


def block_letters(blocks: DataFrame, judge: Discriminator) -> DataFrame:
    """One row per block with the letters of its segments by language, clear and vague, see ``BLOCK_ROW``.

    What a page needs is summed where the segments are judged, so that no segment is moved.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, place = shared.value, {c: k for k, c in enumerate(SUMS)}
        for batch in batches:
            rows = []
            for doc, page, block, text in batch.itertuples(index=False):
                sums = [0] * len(SUMS)
                for _, _, _, arabic, latin, lang, _, clear in judged_parts(text, own):
                    sums[0] += arabic
                    if latin:
                        sums[place[f"{lang}_{'clear' if clear else 'vague'}"]] += latin
                rows.append((doc, page, block, *sums))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK_ROW.split(", ")])

    return _texts(blocks).mapInPandas(run, BLOCK_ROW)


def segment_letters(found: DataFrame) -> DataFrame:
    """The sums of ``BLOCK_ROW`` per segment of ``SEGMENT_ROW``."""
    mine = lambda c: F.when((F.col("latin_language") == c[:2]) & (F.col("clear") == F.lit(c.endswith("clear"))), F.col("latin_letters")).otherwise(0)
    return found.select("doc_id", "page", "block_id", F.col("ar_letters").alias("ar"), *[mine(c).alias(c) for c in SUMS[1:]])


def page_letters(letters: DataFrame) -> DataFrame:
    """Letters of each language per page, clear segments first; see the module's rule for the rest.

    ``letters`` has the sums of parts of pages, each once; the sums of pages are written to the
    shared folder, as the documents' totals are taken from them.
    """
    latin = ("fr", "en", "es")
    sums = written(letters.groupBy("doc_id", "page").agg(*[F.sum(c).alias(c) for c in SUMS]))
    whole = sums.groupBy("doc_id").agg(*[F.sum(f"{x}_clear").alias(f"{x}_doc") for x in latin])

    def top(suffix: str) -> Column:
        best = F.greatest(*[F.col(f"{x}_{suffix}") for x in latin])
        out = F.lit(None).cast("string")
        for x in reversed(latin):
            out = F.when(F.col(f"{x}_{suffix}") == best, F.lit(x)).otherwise(out)
        return F.when(best > 0, out)

    filler = F.coalesce(top("clear"), top("doc"), top("vague"))
    vague = sum((F.col(f"{x}_vague") for x in latin), F.lit(0))
    joined = sums.join(whole, "doc_id").withColumn("fallback", filler)
    return joined.select(
        "doc_id",
        "page",
        "ar",
        *[(F.col(f"{x}_clear") + F.when(F.col("fallback") == x, vague).otherwise(0)).alias(x) for x in latin],
        "fallback",
    )


def page_languages(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, page, languages, confidence, hint, right_hint) of every page.

    ``confidence`` is the share of the page's letters that its languages cover; 0 without letters.
    """
    pages, blocks = table(spark, root, "doc_pages"), table(spark, root, "blocks")
    judge = fit_discriminator(sample_sentences(pages, blocks))
    letters = page_letters(block_letters(blocks, judge).dropDuplicates(["doc_id", "page", "block_id"]))
    total = sum((F.coalesce(F.col(x), F.lit(0)) for x in LANGUAGES), F.lit(0))
    keys = pages.groupBy("doc_id", "page").agg(F.first("language_hint", ignorenulls=True).alias("hint"))
    joined = keys.join(letters, ["doc_id", "page"], "left").withColumn("total", total)
    languages = F.filter(
        F.array(*[F.when(F.col(x) > SHARE * F.col("total"), F.lit(x)) for x in LANGUAGES]), lambda x: x.isNotNull()
    )
    covered = sum((F.when(F.col(x) > SHARE * F.col("total"), F.col(x)).otherwise(0) for x in LANGUAGES), F.lit(0))
    return joined.select(
        "doc_id",
        "page",
        F.when(F.col("total") > 0, languages).otherwise(F.array(F.lit("fr"))).alias("languages"),
        F.round(F.when(F.col("total") > 0, covered / F.col("total")).otherwise(0.0), 4).alias("confidence"),
        "hint",
    ).withColumn("right_hint", F.when(F.size("languages") > 1, F.lit("mixed")).otherwise(F.element_at("languages", 1)))


def wrong_hints(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, page, language) of the pages whose hint is missing or wrong."""
    found = page_languages(spark, root)
    return found.where(~hinted_language(F.col("hint")).eqNullSafe(F.col("right_hint"))).select(
        "doc_id", F.col("page").cast("bigint").alias("page"), F.explode("languages").alias("language")
    )


def page_segments(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, page, block_id, seg_no, start, end, language, confidence) of every segment.

    ``confidence`` is the logistic of the margin; 1 for Arabic script, 0.5 where the language
    is taken from the neighbours.
    """
    pages, blocks = table(spark, root, "doc_pages"), table(spark, root, "blocks")
    judge = fit_discriminator(sample_sentences(pages, blocks))
    # judged once; the pages' letters and the result are both read from what is written
    found = written(judged_segments(blocks, judge).dropDuplicates(["doc_id", "page", "block_id", "seg_no"]))
    fallback = page_letters(segment_letters(found)).select("doc_id", "page", "fallback")
    arabic = F.col("ar_letters") >= F.col("latin_letters")
    return found.join(fallback, ["doc_id", "page"]).select(
        "doc_id",
        "page",
        "block_id",
        "seg_no",
        "start",
        "end",
        F.when(arabic, F.lit("ar")).when(F.col("clear"), F.col("latin_language")).otherwise(F.col("fallback")).alias("language"),
        F.round(F.when(arabic, 1.0).when(F.col("clear"), 1 / (1 + F.exp(-2 * F.col("margin")))).otherwise(0.5), 4).alias("confidence"),
    )
