"""One form of characters for texts that look the same.

House form: composed accents, plain letters and digits, ordinary spaces, nothing invisible,
no letter of another script or alphabet variant posing as a Latin or Arabic one.
Superscripts, ordinals, œ, Ø, ×, dashes and typographic quotes belong to it.

Values made only of surely plain characters never leave the JVM. The rest pass a
context-free stage (composition, width and font variants, presentation forms, invisible
characters, spaces). Letters that may pose as others are repaired per token. Its dominant
script is that of the letters that cannot pose: in an Arabic token the letters of other
Arabic alphabets become standard ones; in a Latin token, or one of posing letters alone,
look-alikes of other scripts are substituted if the corpus vocabulary has the result, the most
frequent one if it has several; in a token of another script nothing is.

Tokens and vocabulary meet under one key, in which the letters that one look-alike may stand
for are alike, so that the number of ambiguous letters does not matter.

Defined results: null gives null, empty gives empty, repeated rows of one key count once,
tabs and line ends become spaces; no length limit; extra columns are never read; a token
without a result in the vocabulary stays as it is; of results equally frequent the first in
alphabetical order is taken.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.runtime import table, written

#: Characters that are in house form wherever they stand.
PLAIN = (
    r"\x20-\x7E¡-¬®-İĴ-ňŊ-ž،؛؟ء-غف-ْ٠-٬"
    r"‐-‖‘-‟†-•…‰′″‹›⁰⁴-⁹€№™←-↓−≠≤≥■●"
)
SUSPECT = f"[^{PLAIN}]"

# Letters of other alphabets and the Latin letters they pass for, likeliest first.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "yu", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r", "п": "n", "и": "u", "ѵ": "v", "ӏ": "l", "ё": "ë", "ї": "ï", "ь": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n", "γ": "y", "σ": "o", "ω": "w", "μ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian, and Latin alphabet variants
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʋ": "v", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ƽ": "s",
}
# Letters of other Arabic-script alphabets and the standard Arabic ones.
ARABIC_VARIANTS = {
    "ی": "ي", "ې": "ي", "ۍ": "ي", "ک": "ك", "ڪ": "ك", "ګ": "ك", "ہ": "ه", "ە": "ه", "ھ": "ه", "ۀ": "ه", "ۃ": "ة", "ٱ": "ا", "ڵ": "ل", "ۇ": "و", "ۈ": "و", "ۊ": "و",
}

_VARIANT_TAGS = {"<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<compat>", "<circle>", "<square>"}
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_POSING = regex.compile("[" + "".join(LOOKALIKES) + "".join(ARABIC_VARIANTS) + "]")
_LATIN, _ARABIC = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Arabic}")
#: Letters that one look-alike may stand for are one in keys.
_ALIKE = str.maketrans({c: x[0] for x in LOOKALIKES.values() if len(x) > 1 for c in x})


def _plain_char(ch: str) -> str:
    kind = unicodedata.category(ch)
    if kind == "Cf" or "︀" <= ch <= "️" or ch in "͏ᅟᅠㅤﾠ឴឵":
        return ""
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind == "Cc":
        return ""
    shape = unicodedata.decomposition(ch)
    tag = shape.split(" ", 1)[0] if shape.startswith("<") else ""
    if tag in ("<wide>", "<narrow>") or (tag in _VARIANT_TAGS and kind[0] in "LN" and ch not in "№™"):
        return unicodedata.normalize("NFKC", ch).replace("⁄", "/")
    return ch


class _Plain(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _plain_char(chr(code))
        return out


_PLAIN = _Plain()


def canonical(text: str) -> str:
    """The context-free part of the house form."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_PLAIN))


def dominant_script(token: str) -> str | None:
    """The script of most of the token's letters that cannot pose as others: Latin, Arabic or other; None without any."""
    sure = [c for c in token if c.isalpha() and c not in LOOKALIKES and c not in ARABIC_VARIANTS]
    latin, arabic = sum(bool(_LATIN.match(c)) for c in sure), sum(bool(_ARABIC.match(c)) for c in sure)
    other = len(sure) - latin - arabic
    if not sure:
        return None
    return "other" if other >= max(latin, arabic) else "Latin" if latin >= arabic else "Arabic"


def standard_arabic(token: str) -> str:
    """The token with the letters of other Arabic alphabets made standard, if it is an Arabic one or all of such letters."""
    if not any(c in ARABIC_VARIANTS for c in token):
        return token
    script = dominant_script(token)
    return "".join(ARABIC_VARIANTS.get(c, c) for c in token) if script == "Arabic" or (script is None and not any(c in LOOKALIKES for c in token)) else token


def questionable(token: str) -> bool:
    """Whether look-alikes of the token may stand for Latin letters."""
    return any(c in LOOKALIKES for c in token) and dominant_script(token) in ("Latin", None)


def alike_key(word: str) -> str:
    """The lower-case key under which a token and the words it may stand for meet."""
    return "".join(LOOKALIKES.get(c, c)[0] for c in word).lower().translate(_ALIKE)


def reading(token: str, word: str) -> str | None:
    """The token with its look-alikes read as in a lower-case word of the same key; None if it cannot be read so."""
    out = []
    for c, want in zip(token, word):
        fits = [x for x in LOOKALIKES.get(c, c) if x.lower() == want]
        if not fits:
            return None
        out.append(fits[0])
    return "".join(out) if len(token) == len(word) else None


def offer_values(offers: DataFrame) -> DataFrame:
    """(source_table, record_key, field, pos, value) of the offers' text fields."""
    pairs = [F.struct(F.lit(f).alias("field"), F.lit(0).alias("pos"), F.col(f).alias("value")) for f in ("objet", "acheteur_public")]
    return offers.select(F.lit("offers").alias("source_table"), F.col("offer_row").cast("string").alias("record_key"), F.explode(F.array(*pairs)).alias("v")).select("source_table", "record_key", "v.*")


def keyword_values(enterprises: DataFrame) -> DataFrame:
    """The same for every element of ``keywords``."""
    return enterprises.select(F.lit("enterprises").alias("source_table"), F.col("id").alias("record_key"), F.posexplode("keywords").alias("pos", "value")).select(
        "source_table", "record_key", F.lit("keywords").alias("field"), "pos", "value"
    )


def text_values(spark: SparkSession, root: str) -> DataFrame:
    """All values of the project that must come out in house form."""
    return offer_values(table(spark, root, "offers")).unionByName(keyword_values(table(spark, root, "enterprises"))).where(F.col("value").isNotNull())


def _first_stage(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        plain = [canonical(v) for v in batch]
        plain = [_WORD.sub(lambda m: standard_arabic(m.group()), p) if _POSING.search(p) else p for p in plain]
        tokens = [[w for w in dict.fromkeys(_WORD.findall(p)) if questionable(w)] if _POSING.search(p) else [] for p in plain]
        yield pd.DataFrame({"plain": plain, "tokens": tokens})


def _keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([alike_key(t) for t in batch])


def _readings(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for tokens, words in batches:
        yield pd.Series([reading(t, w) for t, w in zip(tokens, words)], dtype="object")


def _substitute(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for plain, repairs in batches:
        out = []
        for text, pairs in zip(plain, repairs):
            known = {p["token"]: p["repaired"] for p in pairs} if pairs is not None else {}
            out.append(_WORD.sub(lambda m: known.get(m.group(), m.group()), text) if known else text)
        yield pd.Series(out)


def chosen_readings(flagged: DataFrame, values: DataFrame) -> DataFrame:
    """(token, repaired) of every look-alike token that is to be replaced.

    Vocabulary counts are taken over all values, combined map-side before the words are keyed,
    and only words of the tokens' keys are read further.
    """
    tokens = flagged.select(F.explode("s.tokens").alias("token")).distinct().withColumn("key", F.pandas_udf(_keys, "string")("token"))
    words = values.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # a word of plain letters is its own key but for the letters that are alike
    counts = words.where(~F.col("word").rlike(_POSING.pattern)).withColumn("key", F.translate("word", "".join(chr(c) for c in _ALIKE), "".join(_ALIKE.values())))
    options = tokens.join(counts, "key").withColumn("repaired", F.pandas_udf(_readings, "string")("token", "word")).where(F.col("repaired").isNotNull())
    first = F.struct(-F.col("n"), F.col("word"))
    return options.groupBy("token").agg(F.min_by("repaired", first).alias("repaired"))


KEYS = ["source_table", "record_key", "field", "pos", "value"]


def repaired_values(values: DataFrame) -> DataFrame:
    """The distinct values with a character that is not surely plain, and their ``normal`` form."""
    first_stage = F.pandas_udf(_first_stage, "struct<plain:string,tokens:array<string>>")
    substitute = F.pandas_udf(_substitute, "string")
    rows = values.select(*KEYS).where(F.col("value").isNotNull())
    # a few per cent of the values; written to the shared folder since three branches read them
    flagged = written(rows.where(F.col("value").rlike(SUSPECT)).distinct().withColumn("s", first_stage("value")))
    repairs = chosen_readings(flagged, rows)
    per_value = (
        flagged.where(F.size("s.tokens") > 0)
        .select(*KEYS, F.explode("s.tokens").alias("token"))
        .join(repairs, "token")
        .groupBy(*KEYS)
        .agg(F.collect_list(F.struct("token", "repaired")).alias("repairs"))
    )
    return flagged.join(per_value, KEYS, "left").select(*KEYS, substitute(F.col("s.plain"), F.col("repairs")).alias("normal"))


def house_form(values: DataFrame) -> DataFrame:
    """Adds ``normal`` to distinct (source_table, record_key, field, pos, value) rows."""
    rows = values.select(*KEYS)
    plain = rows.where(F.col("value").isNull() | ~F.col("value").rlike(SUSPECT)).withColumn("normal", F.col("value"))
    return plain.distinct().unionByName(repaired_values(rows))


def unlike_house_form(spark: SparkSession, root: str) -> DataFrame:
    """(source_table, record_key, field) of the fields with a value not in house form; values of plain characters never are."""
    return (
        repaired_values(text_values(spark, root))
        .where(F.col("normal") != F.col("value"))
        .select("source_table", "record_key", "field")
        .distinct()
    )
