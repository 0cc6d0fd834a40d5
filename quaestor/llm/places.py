"""Free-typed places mapped to a reference list.

A value is cut into entries; words that only add kind, part, surroundings or country are
taken off. What is left, in one spelling (w as ou, c and q as k, y as i), is looked up in a
BK-tree over all names of the reference list in the same spelling, under the unrestricted
Damerau-Levenshtein distance (a true metric, so the triangle inequality prunes exactly). The
nearest name within the threshold wins; entries beyond it are reported as place 0.

Each distinct value is looked up once and joined back to its rows; a value that holds a
large share of them is split by AQE's skew join.

The list is broadcast in shards of at most ``SHARD_ENTRIES`` names; a worker builds the tree
of a shard once. With more than one, every shard returns its best match and the nearest of the shards' winners is
kept, so the list may grow without any broadcast growing.

Defined results: null and blank values, and values equal to a listed name, are no cases; a
value with no entry left (only a country, say) is place 0; repeated rows come out as often as
they came in; ties between two listed names at equal distance go to the lower place_id; an
empty reference list makes every value place 0; extra columns are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.runtime import table, written

SHARD_ENTRIES = 50_000
#: Edits allowed by length of the entry: none below SHORT letters, one below LONG, then two.
SHORT, LONG = 4, 6

# Words that name a kind of place, a part, its surroundings or the country.
KINDS = (
    "province provinces prov prefecture pref commune communes cne ville villes region reg cercle caidat municipalite wilaya douar quartier arrondissement "
    "centre centre-ville medina zone nord sud est ouest environs alentours peripherie banlieue rurale urbaine rural urbain industrielle maroc royaume morocco "
    "إقليم عمالة جهة جماعة مدينة المدينة ولاية حي مركز دائرة قيادة ضواحي وضواحيها ونواحيها نواحي المغرب المملكة المغربية منطقة"
)
LINKS = "de du des d la le les l a au aux en et ses son sa dans of the"

_SPLIT = regex.compile(r"\s*[,;/|+&\n\r،؛•]\s*|\s+(?:et|and|y|ou)\s+|\s+و\s+|\)\s*\(", regex.I)
_DASH = regex.compile(r"\s+[-–—]+\s+")
_AROUND = regex.compile(r"\bet\s+(?:(?:ses|les)\s+)?(?:environs|alentours|périphérie|banlieue)\b", regex.I)
_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def plain(text: str) -> str:
    """Lower case without accents, presentation forms or invisible characters."""
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


_KIND_SET = {plain(w) for w in KINDS.replace("-", " ").split()}
_LINK_SET = set(LINKS.split())


def letters(name: str) -> str:
    """The key under which names are compared: letters and digits only."""
    return "".join(_WORDS.findall(plain(name)))


def folded(key: str) -> str:
    """Common respellings made equal: w and ou, c or q and k, y and i."""
    return key.replace("w", "ou").replace("c", "k").replace("q", "k").replace("y", "i")


def distance(a: str, b: str, most: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance; beyond ``most`` any number above it."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    least = 0  # of what any row so far can still lead to, less the steps since
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        above = rows[i]
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                cost = above[j]
                match = j
            else:
                cost = min(above[j], row[j], above[j + 1]) + 1
            row.append(min(cost, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
        # a later row grows from this one, or by a transposition from an earlier one, a step for each row between
        least = min(least, min(row) - i)
        if most is not None and min(row) > most and least + i > most:
            return most + 1
    return rows[-1][-1]


class BKTree:
    """Names by their distances to a root, recursively; exact range search by the triangle inequality."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.root: list | None = None
        for name, ident in entries:
            self.add(name, ident)

    def add(self, name: str, ident: int) -> None:
        if self.root is None:
            self.root = [name, [ident], {}]
            return
        node = self.root
        while True:
            d = distance(name, node[0])
            if d == 0:
                if ident not in node[1]:
                    node[1].append(ident)
                return
            if d not in node[2]:
                node[2][d] = [name, [ident], {}]
                return
            node = node[2][d]

    def within(self, query: str, most: int) -> list[tuple[int, int]]:
        """(distance, id) of every entry within ``most`` edits."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            name, idents, children = todo.pop()
            # beyond this neither the name nor a child can be near
            d = distance(query, name, most + max(children, default=0))
            if d <= most:
                found += [(d, i) for i in idents]
            todo += [child for step, child in children.items() if d - most <= step <= d + most]
        return found


def allowed(key: str) -> int:
    """Edits allowed for an entry."""
    return 0 if len(key) < SHORT else 1 if len(key) <= LONG else 2


def entries(value: str) -> list[list[str]]:
    """The entries of a value; each as its parts between spaced dashes, which may belong to one name."""
    out = []
    for part in _SPLIT.split(_AROUND.sub(" ", unicodedata.normalize("NFKC", value))):
        if parts := [p for p in _DASH.split(part or "") if _WORDS.search(p)]:
            out.append(parts)
    return out


def listed_kinds(names: DataFrame) -> set[str]:
    """Kind words that listed names hold themselves and that must not be taken off (no more than there are kind words)."""
    held = F.pandas_udf(lambda held_names: held_names.map(lambda n: [w for w in _WORDS.findall(plain(n)) if w in _KIND_SET]), "array<string>")
    return {r.w for r in names.select(F.explode(held("name")).alias("w")).distinct().collect()}


def name_of(entry: str, kinds: set[str]) -> str:
    """The entry's key without kind, part and country words; empty if nothing else is left."""
    rest = [w for w in _WORDS.findall(plain(entry)) if w not in kinds]
    while rest and rest[0] in _LINK_SET:
        rest.pop(0)
    while rest and rest[-1] in _LINK_SET:
        rest.pop()
    return "".join(rest)


class Matcher:
    """Looks up entries in the tree of one shard of the reference list."""

    def __init__(self, reference: list[tuple[int, str]], kept_kinds: set[str] = frozenset()):
        named = [(folded(letters(name)), ident) for ident, name in sorted(reference) if name]
        self.kinds = _KIND_SET - set(kept_kinds)
        self.exact = {}
        for ident, name in sorted(reference):
            self.exact.setdefault(letters(name), ident)
        self.tree = BKTree(named)
        self.look_up = lru_cache(maxsize=200_000)(self._look_up)

    def _look_up(self, key: str) -> tuple[int, int] | None:
        """(distance, place_id) of the nearest listed name, if near enough."""
        if key in self.exact:
            return 0, self.exact[key]
        found = self.tree.within(folded(key), allowed(key))
        return min(found) if found else None

    def units(self, value: str) -> list[tuple[int, int, int, str, int, int]]:
        """(group, part, width, entry, place_id, distance): every part of a value, and every two around a dash."""
        out = []
        for g, parts in enumerate(entries(value)):
            for width in (1, 2):
                for at in range(len(parts) - width + 1):
                    entry = " ".join(parts[at : at + width])
                    if key := name_of(entry, self.kinds):
                        distance_, place = self.look_up(key) or (-1, 0)
                        out.append((g, at, width, entry, place, distance_))
        return out


def resolved(value: str, units: list[tuple[int, int, int, str, int, int]]) -> list[tuple[str, int, int]]:
    """(entry, place_id, distance) of a value: two parts around a dash are one name if only together they match."""
    single = {(g, at): (entry, place, d) for g, at, width, entry, place, d in units if width == 1}
    pair = {(g, at): (entry, place, d) for g, at, width, entry, place, d in units if width == 2 and place}
    out, skip = [], set()
    for g, at in sorted(set(single) | set(pair)):
        if (g, at) in skip:
            continue
        if (g, at) in pair and not any(single.get((g, k), ("", 0, 0))[1] for k in (at, at + 1)):
            out.append(pair[g, at])
            skip.add((g, at + 1))
        elif (g, at) in single:
            out.append(single[g, at])
    return out or [(value, 0, -1)]


def typed_values(spark: SparkSession, root: str) -> DataFrame:
    """(source_table, record_key, pos, value) of the places typed in offers and enterprises."""
    offers = table(spark, root, "offers").select(
        F.lit("offers").alias("source_table"),
        F.col("offer_row").cast("string").alias("record_key"),
        F.lit(0).alias("pos"),
        F.col("lieu_execution").alias("value"),
    )
    enterprises = table(spark, root, "enterprises").select(
        F.lit("enterprises").alias("source_table"), F.col("id").alias("record_key"), F.posexplode("locations").alias("pos", "value")
    )
    return offers.unionByName(enterprises).where(F.trim(F.regexp_replace("value", r"[\s\u00a0]+", " ")) != "")


KEYS = ["source_table", "record_key", "pos", "value"]
_UNIT = ["g", "part", "width", "entry", "place_id", "edits"]
FOUND = "entry:string,place_id:bigint,edits:int"
UNIT = f"g:int,part:int,width:int,{FOUND}"

_MATCHERS: dict[int, Matcher] = {}


def _matcher(reference: list[tuple[int, str]], kept: frozenset[str]) -> Matcher:
    """The matcher of a shard, built once per worker."""
    key = hash((tuple(reference), kept))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(reference, kept)
    return _MATCHERS[key]


def _shard_pass(distinct: DataFrame, reference: list[tuple[int, str]], kept: set[str], whole: bool) -> DataFrame:
    """(value, found): one shard looked up for every value; resolved at once if it is the ``whole`` list, else as units."""
    shared = distinct.sparkSession.sparkContext.broadcast((reference, frozenset(kept)))  # at most SHARD_ENTRIES names

    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from quaestor.llm import places as here

        matcher = here._matcher(*shared.value)
        for batch in batches:
            units = [(v, matcher.units(v)) for v in batch]
            yield pd.Series([resolved(v, u) if whole else u for v, u in units])

    kind = f"array<struct<{FOUND if whole else UNIT}>>"
    return distinct.select("value", F.pandas_udf(look_up, kind)("value").alias("found"))


def _resolve_rows(values: pd.Series, units: pd.Series) -> pd.Series:
    return pd.Series([resolved(v, [tuple(u[c] for c in _UNIT) for u in us]) for v, us in zip(values, units)])


def map_places(values: DataFrame, places: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Each entry of ``values`` with its nearest listed place (0 if none): KEYS, entry, place_id, edits.

    The list is read in shards of bounded size; values spelled as listed are left out. With
    several shards the nearest of their winners is kept for every unit before a value's units
    are resolved, so the result is that of one shard.
    """
    spark = values.sparkSession
    listed = places.where(F.col("name").isNotNull()).select(F.col("name").alias("value")).distinct()
    rest = values.select(*KEYS).join(listed, "value", "left_anti")
    names = places.select("place_id", F.explode(F.array("name", "name_ar")).alias("name")).where(F.col("name").isNotNull() & F.col("place_id").isNotNull())
    shards = max(1, -(-names.count() // shard_entries))
    kept = listed_kinds(names)
    # copies are combined before the shuffle; as many tasks as there are slots, however short the values
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    distinct = rest.select("value").distinct().repartition(tasks)
    if shards == 1:
        found = written(_shard_pass(distinct, [(r.place_id, r.name) for r in names.collect()], kept, True))
    else:
        distinct, merged = written(distinct), None
        for k in range(shards):
            part = names.where(F.pmod(F.xxhash64("place_id"), F.lit(shards)) == k).collect()
            units = _shard_pass(distinct, [(r.place_id, r.name) for r in part], kept, False).select("value", F.explode_outer("found").alias("u")).select("value", "u.*")
            merged = units if merged is None else merged.unionByName(units)
        rank = F.struct(F.when(F.col("place_id") == 0, F.lit(1 << 30)).otherwise(F.col("edits")), F.col("place_id"))
        unit = ["g", "part", "width", "entry"]
        best = merged.groupBy("value", *unit).agg(F.min_by(F.struct("place_id", "edits"), rank).alias("b"))
        per_value = best.groupBy("value").agg(F.filter(F.collect_list(F.struct(*unit, "b.place_id", "b.edits")), lambda u: u["width"].isNotNull()).alias("units"))
        resolve = F.pandas_udf(_resolve_rows, f"array<struct<{FOUND}>>")
        found = written(per_value.select("value", resolve("value", "units").alias("found")))
    return rest.join(found, "value").select(*KEYS, F.explode("found").alias("r")).select(*KEYS, "r.*")


def place_cases(spark: SparkSession, root: str) -> DataFrame:
    """(source_table, record_key, place_id) of every typed value that is no listed name itself."""
    return (
        map_places(typed_values(spark, root), table(spark, root, "places"))
        .select("source_table", "record_key", "place_id")
        .distinct()
    )


def unmatched_entries(spark: SparkSession, root: str) -> DataFrame:
    """Report of the entries that name no listed place: (entry, n_values)."""
    return (
        map_places(typed_values(spark, root), table(spark, root, "places"))
        .where(F.col("place_id") == 0)
        .groupBy(F.lower(F.trim("entry")).alias("entry"))
        .agg(F.count_distinct("source_table", "record_key", "pos").alias("n_values"))
    )
