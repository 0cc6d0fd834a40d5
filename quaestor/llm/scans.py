"""Repair of text from scanned pages: cut words, misread characters, running furniture.

* Furniture: blocks in the page margins that are short single lines, flagged or typed as
  furniture; and, inside content blocks, lines that repeat a running line of the document
  (digits masked), starts and ends of lines that do, or lines that name the page's own number.
* Cut words: a mark at the end of a line or page that does not belong to the word. Soft
  marks never do; a hyphen does unless the corpus lexicon knows the joined word, or one half
  is no word by itself.
* Misread characters: a symmetric-delete index over the frequency lexicon of the digital
  pages. Every character, and every sequence that scanners confuse, is deleted in turn from
  unknown and from lexicon words; equal remainders make candidates. Words with several
  misreadings meet their original under one more key, in which all confusable sequences are
  alike. A weighted edit distance, cheap for confusion pairs, ranks the candidates. The words
  before and after (bigrams of the digital pages) decide: a confusion of letters needs a
  neighbour that the candidate is seen with, or a candidate so frequent that chance is no
  explanation; any other edit needs both neighbours; a known word is questioned too where a
  far commoner one fits both neighbours and it fits neither.

The blocks' texts are shuffled once, by document and page, so that a document of any size is
spread over its pages, with what is known of each page: whether its document is scanned, its
height, the document's running lines and the block that goes on over the page's end. The
result is a table in the shared folder, split into digital
and scanned text. Words and their bigrams are counted in one pass over the digital text, and
combined in each task before they are shuffled. Only a bounded set of the commonest words is
broadcast, to keep known words from being exploded; every other word is looked up in the
whole lexicon by joins on hashed keys.

Defined results: a document is scanned if any of its pages says so (nulls follow the
others); null and empty texts have no noise; repeated block rows count once; blocks without
document or page are left out; a page without
height is judged by type and flag only; whole texts; extra columns are never read. Words of
more than LONG_WORD letters are compared by start, end and confusable sequences only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.runtime import spread, table, written

#: Commonest lexicon words kept in every worker (a filter; others are joined).
COMMON_WORDS = 20_000
MARGIN = 0.06
#: A running header, footer or page number is one line of at most so many characters.
LONGEST_LINE = 150
#: Longer words get two keys (start and end) instead of one per letter.
LONG_WORD = 64
#: Words shorter than this have too many neighbours for edits that are no known confusion.
SHORTEST_OPEN = 4
#: A candidate this frequent needs no neighbour to vouch for a confusion of letters.
FREQUENT = 5
#: How many times commoner a word must be to question a known one.
FAR_COMMONER = 20
#: A running line beside other text is told from the text's own words by its length.
LEAST_RUNNING = 10
FURNITURE_TYPES = ("header", "footer", "page_number")

# What a sequence read by the scanner may really be.
CONFUSIONS = [
    ("†", "t"), ("!", "i"), ("í", "i"), ("ì", "i"), ("0", "o"), ("@", "a"), ("5", "s"), ("6", "é"), ("6", "b"), ("1", "l"), ("1", "i"), ("9", "g"), ("8", "b"), ("$", "s"), ("€", "e"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("c", "e"), ("e", "c"), ("e'", "é"), ("e’", "é"), ("fi", "ﬁ"), ("q", "g"), ("l", "i"), ("l", "t"),
    ("j", "ل"), ("l", "ا"), ("|", "ا"), ("ں", "ن"), ("ٯ", "ق"), ("ٮ", "ب"), ("o", "ه"), ("ی", "ي"), ("ک", "ك"),
]
CONFUSED_COST, OTHER_COST, MOST_COST = 0.3, 1.0, 0.9
_FOUND_COLUMNS = ["doc_id", "block_id", "word", "alt", "before", "after"]

SOFT_MARKS = "¬‐‑­"
_END_MARKS = tuple("-" + SOFT_MARKS)
_CUT = regex.compile(rf"(\p{{L}}[\p{{L}}\p{{N}}†!@|'’]*)([-{SOFT_MARKS}])[ \t]*\n(\p{{L}}[\p{{L}}\p{{N}}†!@|'’]*)")
_CUT_AT_END = regex.compile(rf"(\p{{L}}[\p{{L}}\p{{N}}†!@|'’]*)([-{SOFT_MARKS}])[ \t]*$")
_MARKED = regex.compile(rf"[-{SOFT_MARKS}][ \t]*\n")
_FIRST_WORD = regex.compile(r"^\s*(\p{Ll}[\p{L}\p{N}†!@|'’]*|\p{Arabic}+)")
_CHUNK = regex.compile(r"[^\s\-–—/]+")
_ELISION = regex.compile(r"^(?:[ldsnmtcjLDSNMTCJ1]|[Qq]u|[Ll]orsqu|[Jj]usqu|[Pp]uisqu)['’]")
_OUTER = ".,;:()«»\"“”[]{}•…؛،؟?*<>="
_STRANGE = regex.compile(r"[^\p{L}'’\-]")
_DIGITS = regex.compile(r"\p{N}+")
_HAS_LETTER = regex.compile(r"\p{L}")


def shape(line: str) -> str:
    """A line with digits masked and white space collapsed."""
    return " ".join(_DIGITS.sub("0", line).lower().split())


def shape_column(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"\p{N}+", "0")), r"\s+", " "))


def is_page_line(line: str, page: int) -> bool:
    """Whether a line of its own only names the page's number."""
    bare = line.strip()
    if not bare or str(page) not in bare:
        return False
    pattern = (
        rf"(?i)(?:[-–—·]\s*)?{page}(?:\s*[-–—·])?"
        rf"|{page}\s*(?:/|sur|of|de|من)\s*\d+"
        rf"|(?:.*[\s–—-])?(?:page|p\.|pág(?:ina|\.)?|página|صفحة|ص)\s*{page}(?:\s*(?:/|sur|of|de|من)\s*\d+)?"
    )
    return regex.fullmatch(pattern, bare) is not None


def _chunk_words(chunk: str) -> tuple[tuple[int, int, str], ...]:
    """(start, end, word) of one chunk: outer marks and elisions taken off."""
    out = []
    at = len(chunk) - len(chunk.lstrip(_OUTER))
    word = chunk.strip(_OUTER)
    while e := _ELISION.match(word):
        if "1" in e.group():
            out.append((at, at + e.end(), word[: e.end()]))
        at += e.end()
        word = word[e.end() :]
    if word.endswith(("'", "’")) and not word[:-1].lower().endswith("e"):
        word = word[:-1]
    if len(word) > 1 and _HAS_LETTER.search(word):
        out.append((at, at + len(word), word))
    return tuple(out)


def cut_at_end(text: str) -> regex.Match | None:
    """The word that the text's last character cuts, if it is such a mark."""
    bare = text.rstrip(" \t")
    return _CUT_AT_END.search(text, len(bare) - 1 - len(bare[:-1].rsplit(None, 1)[-1])) if bare[-1:] in _END_MARKS and bare[:-1].strip() else None


class _Cache(dict):
    """Words by chunk, cut up once per worker; emptied when it is full."""

    def __init__(self, lowered: bool):
        super().__init__()
        self.lowered = lowered

    def __missing__(self, chunk: str) -> tuple:
        if len(self) > 300_000:
            self.clear()
        found = _chunk_words(chunk)
        self[chunk] = out = tuple(w.lower() for _, _, w in found) if self.lowered else found
        return out


_PLACED, _LOWERED = _Cache(False), _Cache(True)


def words_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of every word that may be misread."""
    out = []
    for m in _CHUNK.finditer(text):
        base = m.start()
        out += [(base + a, base + b, w) for a, b, w in _PLACED[m.group()]]
    return out


def lowered_words(text: str) -> list[str]:
    """The same words without their places, in lower case."""
    out: list[str] = []
    for chunk in _CHUNK.findall(text):
        out += _LOWERED[chunk]
    return out


@lru_cache(maxsize=10_000)
def _running_ends(running: str) -> tuple[regex.Pattern, regex.Pattern]:
    """Patterns of a running line before and after other text of the same line."""
    body = regex.escape(running, literal_spaces=True).replace("0", r"\p{N}+").replace(" ", r"\s+")
    # a sentence may begin with the buyer's name: what follows must begin anew, which letters without case do not show
    begins = r"[\p{Lu}\p{Lo}\p{N}«\"]" if "0" in running else r"\p{Lu}"
    return regex.compile(rf"(?i:^\s*{body})\s+(?={begins})"), regex.compile(rf"(?<=[.!?:;…؟])\s+(?i:{body}\s*$)")


def beside_text(running: frozenset[str]) -> list[str]:
    """The running lines long enough to be told from text on the same line, longest first."""
    return sorted((r for r in running if len(r) >= LEAST_RUNNING), key=lambda r: (-len(r), r))


def without_running_ends(line: str, masked: str, ends: list[str]) -> str:
    """The line without a running line of its document that it starts or ends with."""
    for r in ends:
        if len(r) < len(masked) and (masked.startswith(r) or masked.endswith(r)):
            before, after = _running_ends(r)
            line = after.sub("", before.sub("", line))
            masked = shape(line)
    return line


@lru_cache(maxsize=1000)
def _running(lines: tuple[str, ...]) -> tuple[frozenset[str], list[str]]:
    known = frozenset(lines)
    return known, beside_text(known)


def without_furniture(text: str, page: int, running: tuple[str, ...] | set[str]) -> tuple[str, bool]:
    """The text without furniture lines or running lines beside other text, and whether it had any."""
    known, ends = _running(tuple(running))
    lines, out = text.split("\n"), []
    for x in lines:
        masked = shape(x) if known else ""
        if len(lines) > 1 and (is_page_line(x, page) or (masked and masked in known)):
            continue
        out.append(without_running_ends(x, masked, ends) if ends else x)
    return ("\n".join(out), True) if out != lines else (text, False)


_SEEN = [a for a, _ in CONFUSIONS]
_MEANT = [b for _, b in CONFUSIONS]


def delete_keys(word: str, sequences: list[str]) -> set[str]:
    """The word with each occurrence of a sequence deleted in turn, its place marked."""
    out = set()
    for s in sequences:
        at = word.find(s)
        while at >= 0:
            out.add(word[:at] + "\x00" + word[at + len(s) :])
            at = word.find(s, at + 1)
    return out


def _alike() -> dict[str, str]:
    """Each character of a one-to-one confusion and the one that stands for all it may be confused with."""
    group: dict[str, str] = {}
    for a, b in CONFUSIONS:
        if len(a) == len(b) == 1:
            joined = {x for x in {**group, a: a, b: b} if group.get(x, x) in (group.get(a, a), group.get(b, b))}
            group.update(dict.fromkeys(joined, min(joined)))
    return group


_GROUP = str.maketrans(_alike())
_LONGER = {a: b for pair in CONFUSIONS for a, b in (pair, pair[::-1]) if len(a) > 1 and len(b) == 1}
_SEQUENCE = regex.compile("|".join(regex.escape(x) for x in _LONGER))


def skeleton(word: str) -> str:
    """The word with all sequences that may be confused made alike, whatever their number."""
    return _SEQUENCE.sub(lambda m: _LONGER[m.group()], word).translate(_GROUP)


def open_keys(word: str) -> set[str]:
    """The word, and the word without each of its characters; start and end alone of a long one."""
    if len(word) > LONG_WORD:
        half = LONG_WORD // 2
        return {"\x01" + word[:half], "\x02" + word[-half:]}
    return {word} | {word[:k] + word[k + 1 :] for k in range(len(word))} if len(word) >= SHORTEST_OPEN else set()


def all_keys(word: str, sequences: list[str]) -> list[str]:
    """The keys under which a word is looked up, their first letter telling the kind: confused, open, alike."""
    return [f"c{k}" for k in delete_keys(word, sequences)] + [f"o{k}" for k in open_keys(word)] + [f"a{skeleton(word)}"]


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b))


def weighted_distance(seen: str, meant: str) -> float:
    """Edit distance in which confusion pairs are cheap.

    Common starts and ends are left out but for two characters, which a pair may reach into.
    """
    start, stop = 0, 0
    least = min(len(seen), len(meant))
    while start < least and seen[start] == meant[start]:
        start += 1
    while stop < least - start and seen[-1 - stop] == meant[-1 - stop]:
        stop += 1
    start, stop = max(0, start - 2), max(0, stop - 2)
    seen, meant = seen[start : len(seen) - stop], meant[start : len(meant) - stop]
    n, m = len(seen), len(meant)
    inf = float("inf")
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        row = cost[i]
        pairs = _BY_FIRST.get(seen[i], ()) if i < n else ()
        for j in range(m + 1):
            here = row[j]
            if here == inf:
                continue
            if i < n:
                below = cost[i + 1]
                if j < m:
                    step = here if seen[i] == meant[j] else here + OTHER_COST
                    if step < below[j + 1]:
                        below[j + 1] = step
                if here + OTHER_COST < below[j]:
                    below[j] = here + OTHER_COST
            if j < m and here + OTHER_COST < row[j + 1]:
                row[j + 1] = here + OTHER_COST
            for a, b in pairs:
                if seen.startswith(a, i) and meant.startswith(b, j):
                    k, l = i + len(a), j + len(b)
                    if here + CONFUSED_COST < cost[k][l]:
                        cost[k][l] = here + CONFUSED_COST
    return cost[n][m]


# ------------------------------------------------------------------ Spark side


def page_facts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, scanned, height) of every page that has blocks, of documents that have pages."""
    known = pages.where(F.col("page").isNotNull()).groupBy("doc_id", "page").agg(F.max("height").alias("height"), F.max("is_scanned").alias("is_scanned"))
    documents = known.groupBy("doc_id").agg(F.coalesce(F.max("is_scanned"), F.lit(False)).alias("scanned"))
    used = blocks.select("doc_id", "page").distinct()
    return used.join(known.drop("is_scanned"), ["doc_id", "page"], "left").join(documents, "doc_id")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """The columns read of ``blocks``, without rows that have no document, page or text."""
    return blocks.select(
        "doc_id", F.col("id").alias("block_id"), "type", "page", F.coalesce("ord", F.lit(0)).alias("ord"), F.col("bbox.y0").alias("y0"), "text", "is_furniture"
    ).where(F.col("doc_id").isNotNull() & F.col("page").isNotNull() & (F.length("text") > 0))


def furniture_block() -> Column:
    """Whether a whole block is furniture."""
    margin = (F.col("y0") < MARGIN * F.col("height")) | (F.col("y0") > (1 - MARGIN) * F.col("height"))
    short = (F.length("text") <= LONGEST_LINE) & ~F.trim("text").contains("\n")
    told = F.col("type").isin(*FURNITURE_TYPES) | F.coalesce(F.col("is_furniture"), F.lit(False))
    return told | F.coalesce(margin & short & ~F.col("type").isin("title", "table"), F.lit(False))


_BROKEN = regex.compile(rf"\p{{L}}+[-{SOFT_MARKS}][ \t]*\n\s*\p{{L}}+")
#: Distinct words and bigrams that a task gathers before it passes their counts on.
GATHERED = 400_000


def word_counts(digital: DataFrame) -> DataFrame:
    """(first, second, n): words (second null) and bigrams of the digital pages; words cut at line ends are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones: Counter = Counter()
        pairs: Counter = Counter()

        def gathered() -> pd.DataFrame:
            rows = [(w, None, n) for w, n in ones.items()] + [(a, b, n) for (a, b), n in pairs.items()]
            ones.clear()
            pairs.clear()
            return pd.DataFrame(rows, columns=["first", "second", "n"])

        for batch in batches:
            for text in batch["text"]:
                found = lowered_words(_BROKEN.sub(" ", text) if "\n" in text else text)
                ones.update(found)
                pairs.update(zip(found, found[1:]))
                if len(pairs) > GATHERED:
                    yield gathered()
        yield gathered()

    counted = digital.select("text").mapInPandas(run, "first string, second string, n bigint")
    return counted.groupBy("first", "second").agg(F.sum("n").alias("n"))


def running_lines(scanned: DataFrame) -> DataFrame:
    """(doc_id, running): the masked furniture lines of each document (few, as digits are masked)."""
    shapes = scanned.where("furniture").select("doc_id", shape_column(F.col("text")).alias("shape")).where(F.length("shape") > 0)
    return shapes.groupBy("doc_id").agg(F.collect_set("shape").alias("running"))


def page_joints(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page, cut_block, next_id) of pages whose last content block ends in a cut, and (doc_id, page, goes_on_id) of the pages after.

    The next page's first block of running text is meant (headings and tables stand between
    at times); null where the next page has none.
    """
    content, at = scanned.where(~F.col("furniture")), F.struct("ord", "block_id")
    body = F.when(~F.coalesce(F.col("type").isin("title", "table"), F.lit(False)), F.col("block_id"))
    pages = content.groupBy("doc_id", "page").agg(
        F.max_by("block_id", at).alias("cut_block"), F.max_by("cut", at).alias("cut"), F.min_by(body, F.when(body.isNotNull(), at)).alias("first_body")
    )
    ends = pages.where("cut").select("doc_id", "page", "cut_block")
    starts = pages.select("doc_id", (F.col("page") - 1).alias("page"), F.col("first_body").alias("next_id"))
    joints = ends.join(starts, ["doc_id", "page"], "left")
    return joints, joints.where(F.col("next_id").isNotNull()).select("doc_id", (F.col("page") + 1).alias("page"), F.col("next_id").alias("goes_on_id"))


def continuation(head: str | None, page: int, running: set[str]) -> str | None:
    """The lower-case word that the next page's text starts with, past furniture lines."""
    if not head:
        return None
    text, _ = without_furniture(head, page + 1, running)
    first = _FIRST_WORD.match(text)
    return first.group(1) if first else None


FINDING = "doc_id bigint, block_id string, kind string, word string, alt string, before string, after string"


def _last_part(word: str) -> str:
    return word.split("'")[-1].split("’")[-1]


def first_findings(content: DataFrame, common: frozenset[str]) -> DataFrame:
    """Per block: furniture lines, cut words, and words that are not among the common ones.

    A word cut at the block's end is a ``tail``: left part and mark, to be continued elsewhere.
    """
    shared = content.sparkSession.sparkContext.broadcast(common)  # at most COMMON_WORDS words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows = []
            for doc, block, page, text, running, goes_on in batch.itertuples(index=False):
                text, had = without_furniture(text, page, tuple(running) if running is not None else ())
                if had:
                    rows.append((doc, block, "furniture", None, None, None, None))
                cuts = [(m.group(1), m.group(2), m.group(3)) for m in _CUT.finditer(text)] if _MARKED.search(text) else []
                if end := cut_at_end(text):
                    rows.append((doc, block, "tail", end.group(1), end.group(2), None, None))
                for left, mark, right in cuts:
                    last = _last_part(left)
                    rows.append((doc, block, "cut" if mark == "-" else "softcut", (last + right).lower(), f"{left}-{right}", last, right))
                joined, seen = text, set()
                if cuts:
                    joined = _CUT.sub(lambda m: m.group(1) + m.group(3) if m.group(2) != "-" or (m.group(1) + m.group(3)).lower() in known else m.group(), text)
                    # a word cut at a hyphen may be misread as well, which only the whole shows
                    seen = {w for left, mark, right in cuts if mark == "-" and (w := (_last_part(left) + right).lower()) not in known}
                # halves of words cut at a page end are no words
                start = first.end() if goes_on and (first := _FIRST_WORD.match(joined)) else 0
                stop = tail.start(1) if end and (tail := cut_at_end(joined)) else len(joined)
                found = lowered_words(joined[start:stop])
                rows += [(doc, block, "word", w, None, None, None) for w in sorted(seen)]
                for k, w in enumerate(found):
                    if w not in known and w not in seen:
                        seen.add(w)
                        rows.append((doc, block, "word", w, None, found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDING.split(", ")])

    return content.select("doc_id", "block_id", "page", "text", "running", "goes_on").mapInPandas(run, FINDING)


def continued_tails(tails: DataFrame, content: DataFrame) -> DataFrame:
    """Findings of the words cut at a block's end, put together with the next page where it goes on."""
    starts = content.where("goes_on").select("doc_id", F.col("block_id").alias("next_id"), "page", "text", "running")
    nexts = content.where(F.col("next_id").isNotNull()).select("doc_id", "block_id", "next_id")
    rows = tails.join(nexts, ["doc_id", "block_id"], "left").join(starts, ["doc_id", "next_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, block, left, mark, following, page, head, running in batch.itertuples(index=False):
                last = _last_part(left)
                right = continuation(head, int(page) - 1, tuple(running) if running is not None else ()) if isinstance(head, str) else None
                if right:
                    out.append((doc, block, "cut" if mark == "-" else "softcut", (last + right).lower(), f"{left}-{right}", last, right))
                    # the whole may be misread as well, in the half that shows it
                    for half, where in ((last, block), (right, following)):
                        if _STRANGE.search(half):
                            out.append((doc, where, "word", (last + right).lower(), None, None, None))
                else:
                    out.append((doc, block, "endcut" if mark == "-" else "softcut", last.lower(), f"{left}-", last, ""))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDING.split(", ")])

    return rows.select("doc_id", "block_id", "word", "alt", "next_id", "page", "text", "running").mapInPandas(run, FINDING)


def keyed(words: DataFrame, sequences: list[str], confused_only: bool = False) -> DataFrame:
    """The words' rows, one for each of their keys (hashed); ``words`` is a bare scan."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[f"c{k}" for k in delete_keys(w, sequences)] if confused_only else all_keys(w, sequences) for w in batch])

    keys = F.pandas_udf(run, "array<string>")
    rows = spread(words, "word").select("*", F.explode(keys("word")).alias("key"))
    return rows.withColumn("sure", ~F.col("key").startswith("o")).withColumn("key", F.xxhash64("key"))


def lexicon_index(words: DataFrame) -> DataFrame:
    """(meant, n, key) of the lexicon."""
    return keyed(words, _MEANT).select(F.col("word").alias("meant"), "n", "key")


def _batch_distance(seen: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(a, b) for a, b in zip(seen, meant)])


def _met(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(word, meant, n, sure): distinct pairs of a common key. Never broadcast, as keys outgrow the words they are made of."""
    pairs = queries.join(index.hint("merge"), "key").where(F.col("word") != F.col("meant"))
    return pairs.groupBy("word", "meant", "n").agg(F.max("sure").alias("sure"))


def corrections(unknown: DataFrame, index: DataFrame) -> DataFrame:
    """(word, meant, n, cost) for every candidate of every unknown word.

    Edits outside the confusions are candidates only of words that no confusion explains.
    """
    distance = F.pandas_udf(_batch_distance, "double")
    met = written(_met(keyed(unknown.select("word"), _SEEN), index))
    sure = met.where("sure").withColumn("cost", distance("word", "meant")).where(F.col("cost") <= MOST_COST)
    long = F.least(F.length("word"), F.length("meant")) >= SHORTEST_OPEN
    other = met.where(long & (F.levenshtein("word", "meant", 1) == 1)).withColumn("cost", F.lit(OTHER_COST))
    both = sure.unionByName(other).groupBy("word", "meant", "n").agg(F.min("cost").alias("cost"))
    least = F.min("cost").over(Window.partitionBy("word"))
    return both.withColumn("_least", least).where((F.col("cost") < OTHER_COST) | (F.col("_least") == OTHER_COST)).drop("_least")


def questioned(words: DataFrame, index: DataFrame) -> DataFrame:
    """(word, meant, n, cost) of known words that one confusion turns into a far commoner one."""
    distance = F.pandas_udf(_batch_distance, "double")
    own = words.withColumnRenamed("n", "own")
    pairs = keyed(own, _SEEN, confused_only=True).join(index.hint("merge"), "key").where((F.col("word") != F.col("meant")) & (F.col("n") >= FAR_COMMONER * F.col("own")))
    return pairs.select("word", "meant", "n").distinct().withColumn("cost", distance("word", "meant")).where(F.col("cost") <= CONFUSED_COST)


class ScanNoise:
    """What the scanned pages of ``root`` hold, found once and kept in the shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        rows = read_blocks(table(spark, root, "blocks"))
        facts, page = written(page_facts(table(spark, root, "doc_pages"), rows)), ["doc_id", "page"]
        line = F.col("type").isin(*FURNITURE_TYPES) | F.coalesce("is_furniture", F.lit(False)) | ((F.length("text") <= LONGEST_LINE) & ~F.trim("text").contains("\n"))
        # what tells of a page, without its texts but for single lines
        light = rows.withColumn("cut", F.col("text").rlike(rf"\p{{L}}[\p{{L}}\p{{N}}†!@|'’]*[-{SOFT_MARKS}][ \t]*$"))
        light = light.withColumn("text", F.coalesce(F.when(line, F.col("text")), F.lit("\n\n")))  # no line
        scanned = light.join(facts.where("scanned"), page).withColumn("furniture", furniture_block())
        told = written(scanned.select("doc_id", "block_id", "page", "ord", "type", "cut", "furniture", F.when(F.col("furniture"), F.col("text")).alias("text")))
        ends, starts = page_joints(told)
        facts = facts.join(running_lines(told), "doc_id", "left").join(ends, page, "left").join(starts, page, "left")
        whole = rows.join(facts, page).dropDuplicates(["doc_id", "page", "block_id"]).withColumn("furniture", furniture_block())
        part = F.when(~F.col("scanned"), "digital").when(F.col("furniture"), "furniture").otherwise("content")
        goes_on = F.coalesce(F.col("block_id") == F.col("goes_on_id"), F.lit(False))
        kept = whole.withColumn("part", part).withColumn("next_id", F.when(F.col("block_id") == F.col("cut_block"), F.col("next_id")))
        parts = written(kept.select("doc_id", "block_id", "page", "ord", "text", "running", "next_id", goes_on.alias("goes_on"), "part"), by="part")
        self.digital, self.furniture, self.content = (parts.where(F.col("part") == p) for p in ("digital", "furniture", "content"))
        counts = written(word_counts(self.digital).withColumn("kind", F.when(F.col("second").isNull(), "word").otherwise("pair")), by="kind")
        self.words = counts.where("kind = 'word'").select(F.col("first").alias("word"), "n")
        self.pairs = counts.where("kind = 'pair'").select("first", "second", F.col("n").alias("b"))
        index = written(lexicon_index(self.words))
        common = self.words.orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
        doubtful = written(questioned(self.words, index))
        asked = common.join(doubtful.select("word").distinct(), "word", "left_anti").select("word").collect()
        self.findings = written(first_findings(self.content, frozenset(r.word for r in asked)), by="kind")
        self.kinds = {k: self.findings.where(F.col("kind") == k) for k in ("furniture", "cut", "softcut", "tail", "word")}
        self.tails = written(continued_tails(self.kinds["tail"], self.content))
        self.kinds["word"] = self._cut_rows("word").withColumn("kind", F.lit("word"))
        unknown = self.kinds["word"].select("word").distinct().join(self.words, "word", "left_anti")
        unknown = written(unknown)
        found = corrections(unknown, index).withColumn("known", F.lit(False))
        self.candidates = written(found.unionByName(doubtful.withColumn("known", F.lit(True))))
        self.accepted = written(self._accepted())

    def _cut_rows(self, kind: str) -> DataFrame:
        return self.kinds[kind].select(_FOUND_COLUMNS).unionByName(self.tails.where(F.col("kind") == kind).select(_FOUND_COLUMNS))

    def cut_words(self) -> DataFrame:
        """(doc_id, block_id, word, alt) of the words really cut."""
        known, cut = self.words.select("word"), self._cut_rows("cut")
        # of a hyphen at a line end, compounds are kept: both halves are words and the joined one is not
        joined = known.unionByName(self.candidates.where("NOT known AND cost < 1").select("word")).distinct().withColumn("_joined", F.lit(True))
        left, right = known.select(F.col("word").alias("_l"), F.lit(True).alias("_lk")), known.select(F.col("word").alias("_r"), F.lit(True).alias("_rk"))
        # the half after the mark is a word without its elision (main-d'œuvre); single letters are words
        second = F.lower(F.regexp_extract(F.regexp_replace("after", r"(?iu)^(?:[ldsnmtcj]|qu|lorsqu|jusqu|puisqu)['’]", ""), r"^\p{L}+", 0))
        judged = (
            cut.withColumn("_second", second)
            .join(joined, "word", "left")
            .join(left, F.lower("before") == F.col("_l"), "left")
            .join(right, F.col("_second") == F.col("_r"), "left")
        )
        words = (F.col("_lk").isNotNull() | (F.length("before") == 1)) & (F.col("_rk").isNotNull() | (F.length("_second") <= 1))
        compound = words | F.col("after").rlike(r"^\p{Lu}")
        really = F.col("_joined").isNotNull() | ~compound
        columns = ["doc_id", "block_id", "word", "alt"]
        # without a continuation in sight, a first half that is no word by itself was cut
        alone = self.tails.where("kind = 'endcut'").join(known, "word", "left_anti")
        return judged.where(really).select(columns).unionByName(self._cut_rows("softcut").select(columns)).unionByName(alone.select(columns))

    def _bigrams(self, options: DataFrame) -> DataFrame:
        """(first, second, b): how often two words follow each other in the digital pages, for words in question."""
        wanted = written(options.select(F.explode(F.array("meant", "word")).alias("w")).distinct())
        ahead = self.pairs.join(wanted.withColumnRenamed("w", "first"), "first", "left_semi")
        behind = self.pairs.join(wanted.withColumnRenamed("w", "second"), "second", "left_semi")
        return ahead.unionByName(behind).distinct()

    def _accepted(self) -> DataFrame:
        """(doc_id, block_id, word, meant, cost, n, fit): the corrections that context or certainty bears out."""
        options = written(self.kinds["word"].drop("kind", "alt").join(self.candidates, "word"))
        pairs = written(self._bigrams(options))

        def beside(rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
            own = pairs.select(F.col("first").alias("_f"), F.col("second").alias("_s"), F.col("b").alias(name))
            return rows.join(own, (F.col(first) == F.col("_f")) & (F.col(second) == F.col("_s")), "left").drop("_f", "_s")

        rows = beside(beside(options, "before", "meant", "b_before"), "meant", "after", "b_after")
        rows = beside(beside(rows, "before", "word", "o_before"), "word", "after", "o_after")
        left, right = F.coalesce("b_before", F.lit(0)), F.coalesce("b_after", F.lit(0))
        sides = (left > 0).cast("int") + (right > 0).cast("int")
        # neighbours may be missing at the ends of a block, or be misread themselves
        asked = F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")
        never = F.col("o_before").isNull() & F.col("o_after").isNull()
        strange = F.col("word").rlike(_STRANGE.pattern)
        take = (
            F.when(F.col("known"), (sides == 2) & never)
            .when(F.col("cost") <= MOST_COST, strange & (F.col("word").rlike(r"\p{L}{2}")) | (sides > 0) | (F.col("n") >= FREQUENT))
            .otherwise((sides == asked) & (asked > 0) & (F.col("n") >= FREQUENT))
        )
        return rows.where(take).select("doc_id", "block_id", "word", "meant", "cost", "n", (left + right).alias("fit"))

    def misread(self) -> DataFrame:
        """(doc_id, block_id, word) of the words that have an accepted correction."""
        return self.accepted.select("doc_id", "block_id", "word").distinct()

    def found(self) -> DataFrame:
        """(doc_id, block_id, noise)."""

        def rows(df: DataFrame, noise: str) -> DataFrame:
            return df.select("doc_id", "block_id", F.lit(noise).alias("noise"))

        return (
            rows(self.furniture, "furniture")
            .unionByName(rows(self.kinds["furniture"], "furniture"))
            .unionByName(rows(self.cut_words(), "hyphen"))
            .unionByName(rows(self.misread(), "chars"))
            .distinct()
        )

    def picked(self) -> DataFrame:
        """(doc_id, block_id, word, meant): of several candidates, the one that fits its neighbours."""
        rank = F.struct("fit", -F.col("cost"), F.col("n"), F.col("meant"))
        return self.accepted.groupBy("doc_id", "block_id", "word").agg(F.max_by("meant", rank).alias("meant"))

    def paragraphs(self) -> DataFrame:
        """(doc_id, block_id, page, ord, text): content blocks of scanned pages as continuous text.

        What is to be done to a block is gathered in one row first and joined to its text once.
        """
        keys, text = ["doc_id", "block_id"], F.lit(None).cast("string")
        cuts = written(self.cut_words().select(*keys, "alt"))
        tails = self.tails.where(F.col("after") != "").select(*keys, "alt")
        nexts = self.content.where(F.col("next_id").isNotNull()).select("doc_id", "block_id", "next_id")
        moved = nexts.join(cuts, keys).select("doc_id", F.col("next_id").alias("block_id"), "alt")
        todo = (
            self.picked().select(*keys, F.lit("repair").alias("what"), "word", F.col("meant").alias("alt"))
            .unionByName(cuts.select(*keys, F.lit("cut").alias("what"), text.alias("word"), "alt"))
            .unionByName(moved.select(*keys, F.lit("moved").alias("what"), text.alias("word"), "alt"))
            .unionByName(tails.select(*keys, F.lit("tail").alias("what"), text.alias("word"), "alt"))
        )
        per_block = todo.groupBy(*keys).agg(F.collect_set(F.struct("what", "word", "alt")).alias("todo"))
        rows = self.content.join(per_block, keys, "left")
        return rows.select(*keys, "page", "ord", "text", "running", "todo").mapInPandas(repair_batches, "doc_id bigint, block_id string, page int, ord int, text string")


_ITEM = regex.compile(r"^\s*(?:[-•*–|]|\d+[.)])\s?|^\s*$")


def as_seen(word: str, meant: str) -> str:
    """The correction in the letter case of the word as it stood."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return meant.upper()
    return meant[:1].upper() + meant[1:] if word[:1].isupper() else meant


def repair_text(text: str, page: int, running: set[str], repairs: dict[str, str], cuts: set[str], tail: str | None, moved: set[str]) -> str:
    """One block as continuous text; ``tail`` is its last word, cut, as left part, hyphen, continuation."""
    text, _ = without_furniture(text, page, running)
    if moved and (first := _FIRST_WORD.match(text)) and any(a.endswith("-" + first.group(1)) for a in moved):
        text = text[first.end() :].lstrip(" \n")
    text = _CUT.sub(lambda m: m.group(1) + m.group(3) if f"{m.group(1)}-{m.group(3)}" in cuts else f"{m.group(1)}-{m.group(3)}", text)
    if tail and (end := cut_at_end(text)) and tail.startswith(f"{end.group(1)}-"):
        text = text[: end.end(1)] + ("" if tail in cuts else "-") + tail[len(end.group(1)) + 1 :]
    out, at = [], 0
    for a, b, w in words_of(text):
        if (meant := repairs.get(w.lower())) is not None:
            out += [text[at:a], as_seen(w, meant)]
            at = b
    text = "".join(out) + text[at:]
    lines: list[str] = []
    for line in text.split("\n"):
        if lines and not _ITEM.match(line) and lines[-1].strip() and not lines[-1].lstrip().startswith("|"):
            lines[-1] = lines[-1].rstrip() + " " + line.strip()
        else:
            lines.append(line.strip())
    return "\n".join(lines).strip()


def repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            repairs, cuts, moved, tail = {}, set(), set(), None
            for x in r.todo if r.todo is not None else ():
                if x["what"] == "repair":
                    repairs[x["word"]] = x["alt"]
                elif x["what"] == "cut":
                    cuts.add(x["alt"])
                elif x["what"] == "moved":
                    moved.add(x["alt"])
                else:
                    tail = x["alt"]
            running = tuple(r.running) if r.running is not None else ()
            rows.append((r.doc_id, r.block_id, r.page, r.ord, repair_text(r.text, r.page, running, repairs, cuts, tail, moved)))
        yield pd.DataFrame(rows, columns=["doc_id", "block_id", "page", "ord", "text"])


def scan_noise(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, block_id, noise) of the blocks of scanned pages."""
    return ScanNoise(spark, root).found()


def scan_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The repaired content blocks of scanned pages."""
    return ScanNoise(spark, root).paragraphs()
