"""Template residue and error-page text in a corpus.

Each document is taken as the answer of a host: its first line is its title, the rest its
body, and its kind and reference stand for the address slug, which the corpus lacks.

* Terms: the words that at least ``TYPICAL_SHARE`` of the corpus's rich documents use are its
  typical terms. A body with few of them, that mostly consists of other words, holds little
  information; one that takes up less than half of its title's words, and neither kind nor
  reference, is mismatched. Both together make a document a suspect answer.
* Host evidence: the sentences of suspects, digits masked, are counted over the whole corpus.
  One that suspects of several hosts share, and that is not mainly found elsewhere, is a
  message or filler whatever its wording, and marks every document that has it, alone or as
  a piece of content.
* Detectors: fields, instructions and failed substitutions that a template left behind,
  filler words; and, in suspects only, words of servers and scripts.

Blanks for the bidder, bracketed references and formulas, and requirements that speak about
such pages are content: they match no detector, and stand among typical terms.

The typical terms are broadcast: at most ``1 / TYPICAL_SHARE`` times the mean number of
distinct terms of a document, whatever the corpus size. Sentences are compared by 64-bit hashes.

Defined results: null and empty texts are not residue; rows without an id are left out; repeated rows give one row; whole
texts are read; ties are of no effect (thresholds are inclusive); extra columns are never
read; an empty table gives no rows; a corpus without rich documents has no typical terms, so
its suspects are told by the mismatch alone.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.runtime import written

_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]*"
# How templates mark fields, and what drafters leave to be filled in; before each, literals of which every match holds one.
PLACEHOLDERS: list[tuple[list[str], list[str]]] = [
    (["{{"], [r"\{\{\s*[^{}\n]+\}\}"]),
    (["{%", "<%"], [r"\{%\s*[^%\n]+%\}|<%[=\-]?\s*[^%\n]+%>"]),
    (["${", "#{"], [r"[$#]\{\s*[^{}\n]+\}"]),
    (["<<"], [r"<<\s*[^<>\n]+>>"]),
    (["[["], [r"\[\[\s*[^\[\]\n]+\]\]"]),
    (["@@"], [rf"@@{_NAME}@@"]),
    (["__"], [r"(?<![\p{L}\p{N}_.])__[\p{L}][\p{L}\p{N}_.]*?__(?![\p{L}\p{N}_])"]),
    (["%"], [r"(?<![\p{L}\p{N}%])%[\p{L}][\p{L}\p{N}_.]+%(?![\p{L}\p{N}])"]),
    (["«"], [rf"«{_NAME}»"]),
    (["<"], [rf"<(?:{_NAME}|(?i:à|a|to be|insert|insérer|nom|name|date|montant)\s[^<>\n]+)>"]),
    (["{"], [r"\{\d{1,2}\}"]),
    (
        ["["],
        [
            r"\[(?iu:à|a)\s(?iu:compl[ée]ter|pr[ée]ciser|renseigner|d[ée]finir|remplir|ins[ée]rer|indiquer|fixer)[^\[\]\n]*\]",
            r"\[(?iu:ins[ée]rer|insert|indiquer|renseigner|compl[ée]ter|pr[ée]ciser|remplir|enter|fill in|to be|tbd|tbc|type|choose|saisir|mettre|ajouter|your|votre)\b[^\[\]\n]*\]",
            r"\[[^\[\]\n]+\s(?iu:à|to be)\s(?iu:compl[ée]ter|reporter|pr[ée]ciser|renseigner|d[ée]finir|ins[ée]rer|completed|filled|inserted|defined)[^\[\]\n]*\]",
            r"\[(?:NOM|NAME|DATE|LIEU|ADRESSE|MONTANT|TITRE|OBJET|VILLE|ORGANISME|ACHETEUR|BUYER|PLACE|AMOUNT)(?:[\s'’][\p{Lu}'’\s]*)?\]",
            r"\[(?:اسم|تاريخ|مبلغ|عنوان|مكان|يملأ|يكتب)[^\[\]\n]*\]",
            r"\[object Object\]",
        ],
    ),
    (["TODO", "FIXME", "TBD", "TBC", "XXX"], [r"\b(?:TODO|FIXME|TBD|TBC|XXX)\b"]),
    (["XX/XX", "JJ/MM", "DD/MM"], [r"\bX{2}/X{2}/(?:20)?X{2,4}\b|\bJJ/MM/AAAA\b|\bDD/MM/YYYY\b"]),
    (["undefined", "NaN", "null null", ": null"], [r"\bundefined\b|\bNaN\b|\bnull null\b|: null\b"]),
]
# Words of the usual Latin filler text.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo "
    "consequat aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum "
    "sapien vivamus ligula mauris augue felis massa porta orci erat quam vestibulum curabitur pellentesque tincidunt"
)
_LATIN = "(?:" + "|".join(LATIN.split()) + ")"
# Filler text.
FILLER = [
    # four filler words, with no more than two others between any two of them
    rf"(?iu)\b{_LATIN}\b(?:[\s,.]+(?:\p{{L}}+[\s,.]+){{0,2}}?{_LATIN}\b){{3}}",
    # a sentence that begins with the same word three times; inside a sentence it may be chance
    r"(?iu)(?:^|[\n.!?:])\s*(\p{L}{3,}+)(?:[\s,]++\1\b){2}",
    r"(?i)\bblabla\b|\bbla bla\b",
    r"(?i)\b(?:azerty|qwerty|qsdfgh|asdfgh|wxcvbn|zxcvbn)\b",
    r"(?i)\bplaceholder text\b|\b(?:sample|dummy|filler) text (?:for|goes|only)\b",
    r"(?iu)\bcontenu d['’]exemple\b|\btexte (?:d['’]exemple|de remplissage|fictif|factice)\b|\btexto de (?:ejemplo|relleno)\b",
    r"نص تجريبي|نص عشوائي|نص لملء",
]
# Terms of which every text that matches filler holds one, but for ``bla bla``, which has none.
FILLER_TERMS = [w for w in LATIN.split() if len(w) >= 4] + "blabla azerty qwerty qsdfgh asdfgh wxcvbn zxcvbn placeholder sample dummy filler exemple remplissage fictif factice ejemplo relleno تجريبي عشوائي لملء".split()
# Words of servers and scripts, in four languages; evidence in suspect documents only.
CUES = [
    r"(?iu)\bhttp\b|javascript|\bscripts?\b|\bcookies?\b|\bproxy\b|gateway|navigateur|browser|navegador|\bserve(?:ur|r)\b|servidor|introuvable|not found|no encontrada|indisponible|unavailable|forbidden|denied|too many|reconnecter|log in again",
    r"(?iu)erreur|\berror\b|exception|traceback|\bla page\b|\bthis page\b|página|\bsession\b|sesión|maintenance\b|chargement|loading|réessayer|retry",
    r"الصفحة|المتصفح|متصفح|الجلسة|الخادم|خطأ|جافا|الخدمة غير",
]

#: A term is typical if this share of the rich documents has it; rich ones have so many distinct terms.
TYPICAL_SHARE, RICH_TERMS = 0.01, 20
#: A body holds little information with at most so many typical terms, and at most this share of its own terms.
FEW_TERMS, LOW_TYPICAL = 7, 0.5
#: A title's words count from this length; a body that has less than this share of them mismatches.
TITLE_WORD, TITLE_SHARE = 5, 0.5
#: A sentence is a message if so many suspects, and hosts, share it...
SHARED_DOCUMENTS, SHARED_HOSTS = 3, 2
#: ... and they are at least this share of the documents that have it.
SUSPECT_SHARE = 0.3
_TERM = r"\p{L}{4,}"
#: White space at the ends of sentences, and marks nobody sees.
_BLANKS = " \t\r\f\x0b\u00a0\u200b\ufeff"


def any_of(patterns: list[str]) -> str:
    """One pattern from several, each in its own group so that flags stay local."""
    return "|".join(f"(?:{p})" for p in patterns)


def _holds(lowered: Column, literals: list[str]) -> Column:
    out = lowered.contains(literals[0])
    for literal in literals[1:]:
        out = out | lowered.contains(literal)
    return out


#: Same word three times in a row has no literal to look for and is tried on every text.
_REPEATED = next(p for p in FILLER if r"\1" in p)
_WORDED_FILLER = [p for p in FILLER if p != _REPEATED]


def detected(text: Column, lowered: Column, own: Column) -> Column:
    """array of the detectors that a text with the terms ``own`` trips: placeholder, filler."""
    hinted = F.exists(own, lambda w: w.isin(*FILLER_TERMS)) | lowered.contains("bla bla")
    worded = hinted & text.rlike(any_of(_WORDED_FILLER))
    return F.filter(
        F.array(
            F.when(reduce(or_, (_holds(text, anchors) & text.rlike(any_of(patterns)) for anchors, patterns in PLACEHOLDERS)), F.lit("placeholder")),
            F.when(worded | text.rlike(_REPEATED), F.lit("filler")),
        ),
        lambda r: r.isNotNull(),
    )


def terms(lowered: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0)))


def typical_terms(documents: DataFrame) -> list[str]:
    """The terms that at least ``TYPICAL_SHARE`` of the rich documents use.

    They are at most the mean number of distinct terms over that share. Poor documents are
    left out, so that copies of one error page do not make its words typical.
    """
    rich = documents.select(terms(F.lower("text")).alias("t")).where(F.size("t") >= RICH_TERMS)
    # the empty term stands for the number of documents
    counts = written(rich.select(F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n = counts.where(F.col("term") == "").select("df").scalar()
    return [r.term for r in counts.where((F.col("df") >= TYPICAL_SHARE * n) & (F.col("term") != "")).select("term").collect()]


def sentence_shapes(text: Column) -> Column:
    """64-bit hashes of the sentences of a text, lower-cased, digits masked; short ones left out."""
    masked = F.regexp_replace(F.lower(text), r"\p{N}+", "0")
    sentences = F.transform(F.split(masked, r"\n|(?<=[.!?…؟])\s+"), lambda s: F.btrim(s, F.lit(_BLANKS)))
    return F.array_distinct(F.transform(F.filter(sentences, lambda s: F.length(s) >= 8), lambda s: F.xxhash64(s)))


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(words)) or "''"


def judged(documents: DataFrame, typical: list[str]) -> DataFrame:
    """(doc_id, host, suspect, cued, reasons, shapes) of every document with a text.

    ``shapes`` are those of a suspect's body, null for others. The steps are bound one by one
    behind generators, so that none is computed twice.
    """
    host = F.xxhash64(F.coalesce("source", F.lit("")), F.coalesce("org_acronyme", F.lit("")))
    words = lambda x: F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    base = documents.where(F.length("text") > 0).select(
        "doc_id", host.alias("host"), "text", F.explode(F.array(F.lower("text"))).alias("lowered"),
        F.filter(F.array(F.lower("doc_type"), F.lower("consultation_id")), lambda x: x.isNotNull() & (x != "")).alias("slug"),
    )
    # the title is the first line, if others follow
    split_ = F.split(F.regexp_replace("lowered", r"^\s+", ""), r"\n", 2)
    titled = base.withColumn("parts", F.explode(F.transform(F.array(split_), lambda p: F.when((F.size(p) == 2) & p[F.size(p) - 1].rlike(r"\S"), p).otherwise(F.array(F.lit(""), F.col("lowered"))))))
    body = F.col("parts")[1]
    found = titled.withColumn("t", F.explode(F.array(terms(body))))
    known = F.expr(f"size(filter(t, w -> w IN ({_quoted(typical)})))")
    found = found.withColumn("known", F.explode(F.array(known)))
    few = (F.col("known") <= FEW_TERMS) & (F.col("known") <= LOW_TYPICAL * F.size("t"))
    title_words = F.array_distinct(F.filter(words(F.col("parts")[0]), lambda w: F.length(w) >= TITLE_WORD))
    taken_up = F.size(F.array_intersect(title_words, words(body))) >= F.greatest(F.lit(1.0), TITLE_SHARE * F.size(title_words))
    mismatch = ~taken_up & ~F.arrays_overlap("slug", words(F.col("lowered")))
    suspect = F.when(few, mismatch).otherwise(False)
    marked = found.withColumn("suspect", F.explode(F.array(suspect)))
    return marked.select(
        "doc_id", "host", "suspect",
        F.when(F.col("suspect"), F.col("text").rlike(any_of(CUES))).otherwise(False).alias("cued"),
        F.explode(F.array(detected(F.col("text"), F.col("lowered"), F.concat("t", terms(F.col("parts")[0]))))).alias("reasons"),
        F.when(F.col("suspect"), sentence_shapes(body)).alias("shapes"),
    )


def candidate_shapes(marked: DataFrame) -> DataFrame:
    """(shape, suspects): the sentences that enough suspects of enough hosts share."""
    rows = marked.where("suspect").select("host", F.explode("shapes").alias("shape"))
    # per shape and host first, so that a shape of many documents is combined before it is gathered
    per_host = rows.groupBy("shape", "host").agg(F.count("*").alias("n"))
    return (
        per_host.groupBy("shape")
        .agg(F.sum("n").alias("suspects"), F.count("*").alias("hosts"))
        .where((F.col("suspects") >= SHARED_DOCUMENTS) & (F.col("hosts") >= SHARED_HOSTS))
        .select("shape", "suspects")
    )


def residue_evidence(documents: DataFrame) -> DataFrame:
    """(doc_id, reason) of every residue document: placeholder, filler, message or shared message.

    Three passes over the texts: term counts, suspects and detectors, sentences that suspects
    share. What the last two keep (a few per cent of the rows, without texts) is written to
    the shared folder; its known size lets the planner broadcast the sentences if they are few.
    """
    rows = documents.select("doc_id", "text", "source", "org_acronyme", "doc_type", "consultation_id").where(F.col("doc_id").isNotNull())
    marked = written(judged(rows, typical_terms(rows)).where(F.col("suspect") | (F.size("reasons") > 0)))
    shapes = written(candidate_shapes(marked))
    sentences = rows.where(F.length("text") > 0).select("doc_id", F.explode(sentence_shapes(F.col("text"))).alias("shape"))
    hits = written(sentences.join(shapes.select("shape"), "shape"))
    elsewhere = hits.groupBy("shape").agg(F.count("*").alias("n"))
    messages = shapes.join(elsewhere, "shape").where(F.col("suspects") >= SUSPECT_SHARE * F.col("n")).select("shape")
    shared = hits.join(messages, "shape", "left_semi").select("doc_id", F.lit("shared message").alias("reason"))
    alone = marked.where("cued").select("doc_id", F.lit("message").alias("reason"))
    return marked.select("doc_id", F.explode("reasons").alias("reason")).unionByName(shared).unionByName(alone).distinct()


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents to keep out of the corpus."""
    return residue_evidence(documents).select("doc_id").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are no residue."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")
