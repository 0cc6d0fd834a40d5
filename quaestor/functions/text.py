"""Column functions on text: normal forms, lists, slugs, languages, sizes. No Python runs per row."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of characters whose compatibility forms are folded.
FOLDED_BLOCKS = [(0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x52F), (0x600, 0x6FF), (0x1E00, 0x1FFF), (0x2000, 0x214F), (0xFB00, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)]


def fold_char(ch: str) -> str:
    """Compatibility decomposition without combining marks, case-folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).casefold()


@lru_cache(maxsize=1)
def folding_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for one-to-one foldings and removals, and the replacements of several letters."""
    one, other, gone, longer = [], [], [], {}
    for lo, hi in FOLDED_BLOCKS:
        for code in range(lo, hi + 1):
            ch = chr(code)
            out = fold_char(ch)
            if out == ch:
                continue
            if len(out) == 1:
                one.append(ch)
                other.append(out)
            elif not out:
                gone.append(ch)
            else:
                longer[ch] = out
    return "".join(one + gone), "".join(other), longer


#: Characters that fold to several letters: all Latin ones, and ligatures and signs met in practice.
LETTER_GROUPS = "".join(c for c in folding_tables()[2] if ord(c) < 0x250) + "…ﬀﬁﬂﬃﬄﬅﬆ№™ﻻﻼﻷﻸﻹﻺﻵﻶ℃"


def collapse(text: Column) -> Column:
    """White space (any) collapsed to single blanks, outer blanks off."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Without accents and case, white space collapsed; null and empty give ''."""
    source, target, longer = folding_tables()
    out = F.coalesce(text, F.lit(""))
    for ch in LETTER_GROUPS:
        if ch in longer:
            out = F.replace(out, F.lit(ch), F.lit(longer[ch]))
    return collapse(F.lower(F.translate(out, source, target)))


def normalize_locations(text: Column) -> Column:
    """The value and its parts, normalised, without kind prefixes, the country, blanks and repeats; in order."""
    # fixed values: what separates parts, and the kinds taken off
    parts = F.concat(F.array(text), F.split(text, r"[,;/|\-–—]"))
    plain = F.transform(
        parts, lambda p: F.regexp_replace(normalize_text(p), r"^(?:region|prefecture|province)\s+(?:de|d')\s+", "")
    )
    return F.coalesce(F.array_distinct(F.filter(plain, lambda p: (p != "") & (p != "maroc"))), F.array().cast("array<string>"))


def keep_first(values: Column) -> Column:
    """A list trimmed, without blanks, and without later values equal but for case; in order."""
    clean = F.filter(F.transform(values, lambda v: collapse(v)), lambda v: v != "")
    # the first of each lower-cased value is where its position in the lower-cased list is its own
    bound = F.transform(F.array(clean), lambda own: F.struct(own.alias("own"), F.transform(own, F.lower).alias("low")))
    first = F.transform(bound, lambda b: F.filter(b["own"], lambda v, i: F.array_position(b["low"], F.get(b["low"], i)) == i + 1))
    return F.coalesce(F.get(first, F.lit(0)), F.array().cast("array<string>"))


def slug(name: Column, default: str = "document") -> Column:
    """A safe file name ending in .pdf, at most 150 characters."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._-]+", "-")
    plain = F.regexp_replace(plain, r"^[-.]+|[-.]+$", "")
    named = F.when(plain == "", F.lit(default)).otherwise(plain)
    full = F.when(F.lower(named).endswith(".pdf"), named).otherwise(F.concat(named, F.lit(".pdf")))
    return F.when(F.length(full) <= 150, full).otherwise(F.concat(F.substring(full, 1, 146), F.lit(".pdf")))


def document_type(searchable: Column, url: Column) -> Column:
    """Kind of a document by marker words, else by the extension of its address."""
    plain = normalize_text(searchable)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    extension = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return (
        F.when(plain.contains("reglement"), "regulation")
        .when(plain.contains("complement"), "complement")
        .when(plain.contains("avis"), "notice")
        .when(plain.contains("dce") | plain.contains("dossier"), "dossier")
        .when(path.contains("."), extension)
        .otherwise("document")
    )


def clean_cell(text: Column) -> Column:
    """Text of a table cell: line ends, times signs and dollar wrappings, blanks inside them or not, taken off."""
    out = F.replace(text, F.lit("\n"), F.lit(" "))
    out = F.regexp_replace(out, r"\$\s*\\times\s*\$", "x")
    return collapse(F.regexp_replace(out, r"\$\s*([^$]*?)\s*\$", "$1"))


def estimate_tokens(text: Column) -> Column:
    """0 if empty, else code points / 3.5 rounded, at least 1."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.round(F.length(text) / F.lit(3.5)).cast("int"))).otherwise(0)


ARABIC_LETTER = r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}&&\p{L}]"
LATIN_LETTER = r"[\p{IsLatin}&&\p{L}]"


def arabic_letters(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ARABIC_LETTER)), F.lit(0))


def latin_letters(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(LATIN_LETTER)), F.lit(0))


def script_language(arabic: Column, latin: Column, threshold: float = 0.15) -> Column:
    """``ar``, ``fr`` or ``mixed`` by the share of Arabic letters; ``fr`` without letters."""
    ratio = arabic / (arabic + latin)
    return (
        F.when(arabic + latin == 0, "fr").when(ratio > 1 - threshold, "ar").when(ratio < threshold, "fr").otherwise("mixed")
    )


# Fixed values: ``12``, ``- 12 -``, ``12/48``, ``Page 12 of 48``, roman numerals.
PAGE_NUMBER = r"(?i)^(page|p\.?|pg\.?)?\s*[\[\(\-–—]*\s*[\divxlcdm]+\s*(/|sur|of|de)?\s*[\divxlcdm]*\s*[\]\)\-–—.]*$"


def is_page_number(text: Column) -> Column:
    bare = F.trim(text)
    return (bare != "") & (F.length(bare) <= 24) & bare.rlike(PAGE_NUMBER)


def size_label(size: Column) -> Column:
    """Bytes as Ko, one at least, or Mo with one decimal; '' for null."""
    return (
        F.when(size.isNull(), F.lit(""))
        .when(size < 1024 * 1024, F.concat(F.greatest(F.lit(1), F.floor(size / 1024 + 0.5)).cast("string"), F.lit(" Ko")))
        .otherwise(F.concat(F.format_string("%.1f", size / (1024 * 1024)), F.lit(" Mo")))
    )


def file_type_label(media_type: Column, file_type: Column, name: Column, size: Column, requires_portal: Column) -> Column:
    """What a file is called in a list: its kind and size, or what it is part of."""
    sized = lambda kind: F.concat(kind, F.lit(" · "), size_label(size))
    extension = F.element_at(F.split(F.coalesce(name, F.lit("")), r"\."), -1)
    named = F.upper(F.when((extension != "") & (extension != name), extension).otherwise("Fichier"))
    return (
        F.when(requires_portal, "Dossier protégé — téléchargement officiel")
        .when(media_type == "application/pdf", sized(F.lit("PDF")))
        .when(media_type.startswith("image/"), sized(F.lit("Image")))
        .when(media_type.startswith("text/"), sized(F.lit("Texte")))
        .when(file_type == "dossier", "Dossier de consultation")
        .when(file_type == "notice", "Avis de publicité")
        .when(size.isNotNull(), sized(named))
        .otherwise(F.upper(F.coalesce(F.nullif(file_type, F.lit("")), F.nullif(media_type, F.lit("")), F.lit("Document"))))
    )


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def comma_list(text: Column) -> Column:
    """The distinct trimmed parts between commas, in order; none for null."""
    parts = F.filter(F.transform(F.split(text, ","), stripped), lambda x: x != "")
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def e_mail(text: Column) -> Column:
    """An address as it is compared: trimmed, in lower case."""
    return F.lower(stripped(text))


def optional_text(text: Column) -> Column:
    """Text with its white space collapsed; null if nothing is left."""
    return F.nullif(collapse(text), F.lit(""))


def error_text(kind: Column, message: Column, most: int = 500) -> Column:
    """An error as it is recorded, cut to ``most`` characters."""
    return F.substring(F.concat(kind, F.lit(": "), message), 1, most)


# Words by which an error is one of the graphics processor.
DEVICE_MARKERS = ("cuda", "cudnn", "cublas", "out of memory", "memory", "device", "vram")


def holds_marker(text: Column, markers: tuple[str, ...] = DEVICE_MARKERS) -> Column:
    """Whether a text holds one of the words, in any case; null does not."""
    return F.coalesce(F.lower(text).rlike("|".join(markers)), F.lit(False))


#: A text layer with fewer characters is none.
LEAST_TEXT_LAYER = 100


def without_text_layer(text: Column) -> Column:
    """Whether a page's own text is too short to be one: the page is a scan."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")) < LEAST_TEXT_LAYER


# What a layout label becomes; other labels become ``other``.
BLOCK_TYPE_OF_LABEL = {
    "text": "paragraph", "abstract": "paragraph", "content": "paragraph", "table": "table", "image": "image", "chart": "image", "figure": "image", "seal": "image",
    "header_image": "image", "footer_image": "image", "figure_title": "image_caption", "table_title": "image_caption", "chart_title": "image_caption", "table_caption": "image_caption",
    "image_caption": "image_caption", "formula": "formula", "formula_number": "formula", "header": "header", "footer": "footer", "number": "page_number", "footnote": "reference",
    "reference": "reference", "reference_content": "reference", "doc_title": "title", "chapter_title": "title", "paragraph_title": "title", "title": "title",
}
TITLE_LEVEL_OF_LABEL = {"doc_title": 1, "chapter_title": 2}
FURNITURE_LABELS = ("header", "footer", "number", "aside_text", "header_image", "footer_image")


def block_type(label: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in BLOCK_TYPE_OF_LABEL.items() for x in kv])
    return F.coalesce(F.element_at(pairs, label), F.lit("other"))


def title_level(label: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in TITLE_LEVEL_OF_LABEL.items() for x in kv])
    return F.when(block_type(label) == "title", F.coalesce(F.element_at(pairs, label), F.lit(3)))


# How reasons of a match are shown, by what they begin with.
REASON_WORDS = [
    ("Matched keyword:", "Mot-clé correspondant :"), ("Matched category:", "Catégorie correspondante :"), ("Matched location:", "Zone correspondante :"),
    ("Keyword match:", "Mot-clé correspondant :"), ("Category match:", "Catégorie correspondante :"), ("Location match:", "Zone correspondante :"),
    ("Semantic similarity(?: with enterprise keywords)?$", "Activité sémantiquement proche"), ("Hybrid relevance match$", "Correspondance combinée"),
]


def translated_reasons(reasons: Column, mark: str = "§") -> Column:
    """Reasons joined by a mark, each in the words it is shown with."""
    for english, french in REASON_WORDS:
        reasons = F.regexp_replace(reasons, f"(?i)(^|{mark}){english}", f"$1{french}")
    return reasons
