import datetime as dt
import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaestor.functions import dates, ids, text
from quaestor.operators.retrieval import reasons


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("o")).collect()[0].o


def normal(value):
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(plain.casefold().split())


def test_normal_form_agrees_with_unicode_tables(spark):
    values = ["Préfecture  de Rabat", "STRASSE ß œuvre", "ｆｕｌｌ ２０２５", "ofﬁce ﬂ", "أعمال الترميم", "𝟐𝟎𝟐𝟔 m²", "", " \t\n", "é" * 20_000, "İstanbul ŉ Ĳ"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.o for r in df.select("i", text.normalize_text(F.col("v")).alias("o")).collect()}
    assert got == {i: normal(v) for i, v in enumerate(values)}
    assert one(spark, None, text.normalize_text) == ""


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=30), min_size=1, max_size=60))
def test_normal_form_on_any_latin_text(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.o for r in df.select("i", text.normalize_text(F.col("v")).alias("o")).collect()}
    assert got == {i: normal(v) for i, v in enumerate(values)}


def test_locations(spark):
    assert one(spark, "Préfecture de Rabat", text.normalize_locations) == ["rabat"]
    assert one(spark, "Rabat-Salé-Kénitra", text.normalize_locations) == ["rabat-sale-kenitra", "rabat", "sale", "kenitra"]
    assert one(spark, "Maroc; province d'Agadir, ", text.normalize_locations) == ["maroc; province d'agadir,", "province d'agadir"]
    assert one(spark, None, text.normalize_locations) == [] and one(spark, "", text.normalize_locations) == []


def test_lists_slugs_types(spark):
    assert one(spark, [" A  b", "a B", None, "", "c"], text.keep_first, "array<string>") == ["A b", "c"]
    assert one(spark, None, text.keep_first, "array<string>") == []
    assert one(spark, "Règlement (final).PDF", text.slug) == "R-glement-final-.PDF"
    assert one(spark, "...", text.slug) == "document.pdf" and len(one(spark, "x" * 400, text.slug)) == 150
    assert one(spark, "https://h/x/plan.DWG?a=1", lambda c: text.document_type(c, c)) == "dwg"
    assert one(spark, "https://h/Avis complémentaire", lambda c: text.document_type(c, c)) == "complement"
    assert one(spark, "https://h/none", lambda c: text.document_type(c, c)) == "document"


def test_language_tokens_pages(spark):
    both = lambda c: text.script_language(text.arabic_letters(c), text.latin_letters(c))
    assert [one(spark, v, both) for v in ("a" * 84 + "ب" * 16, "a" * 86 + "ب" * 14, "a" * 16 + "ب" * 84, "ب" * 86 + "a" * 14, "123", "", None)] == ["mixed", "fr", "mixed", "ar", "fr", "fr", "fr"]
    assert [one(spark, v, text.estimate_tokens) for v in ("", "a", "a" * 1401, "a" * 1402)] == [0, 1, 400, 401]
    assert [one(spark, v, text.is_page_number) for v in ("- 12 -", "Page 3 / 48", "xiv", "Page douze", "", "1" * 30)] == [True, True, True, False, False, False]


def test_ids(spark):
    want = str(uuid.uuid5(uuid.NAMESPACE_URL, "marchespublics.ma:123:abc"))
    assert one(spark, "123", lambda c: ids.point_id(c, F.lit("abc"))) == want
    assert [one(spark, v, ids.allowed_url) for v in ("https://www.marchespublics.gov.ma/x", "http://www.marchespublics.gov.ma/", "https://evil.example/", "::", None)] == [True, False, False, False, False]


def test_deadlines(spark):
    got = [one(spark, v, dates.parse_deadline) for v in ("01/01/2027 12:00", " 1/2/2027 9:05 ", "01/01/2027", "31/02/2027", "soon", None)]
    assert got == [1798801200, 1801469100, 1798758000, None, None, None]


def test_reasons(spark):
    df = spark.createDataFrame([(["Béton", "x", "route"], ["Travaux"], ["Préfecture de Rabat"])], "k array<string>, c array<string>, l array<string>")
    why = lambda objet, cat, places: reasons(F.col("k"), F.col("c"), F.col("l"), F.lit(objet), F.lit(cat), F.array(*map(F.lit, places)))
    got = df.select(why("beton de route", "travaux", ["rabat", "sale"]).alias("a"), why("rien", "services", ["fes"]).alias("b")).collect()[0]
    assert got.a == ["Matched keyword: Béton", "Matched keyword: route", "Matched category: travaux", "Matched location: rabat"]
    assert got.b == ["Semantic similarity with enterprise keywords"]


def test_shown_deadlines(spark):
    from quaestor.functions import dates

    given = [("01/02/2026",), ("le 01/02/2026 08:30 précises",), ("31/02/2026 00:00",), ("sans date",), (None,)]
    got = [r.d for r in spark.createDataFrame(given, "t string").select(dates.shown_deadline(F.col("t")).alias("d")).collect()]
    # Morocco is at UTC+1, in Ramadan at UTC; a time that is not given is 23:59, days beyond the month run over
    at = lambda *x: int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp())
    assert got == [at(2026, 2, 1, 22, 59), at(2026, 2, 1, 7, 30), at(2026, 3, 3, 0, 0), None, None]
    shown = spark.createDataFrame([(0,), (1,), (2,), (7,), (8,), (30,), (31,), (None,)], "n int").select(dates.urgency(F.col("n")), dates.urgency_detail(F.col("n")), dates.tone(F.col("n"))).collect()
    assert [tuple(r) for r in shown] == [("Dernier jour", "Dernier jour", "chip-error")] * 2 + [(f"{n} jours restants", f"{n} jours restants", t) for n, t in ((2, "chip-warning"), (7, "chip-warning"), (8, "chip-neutral"), (30, "chip-neutral"))] + [("", "Offre active", "chip-neutral"), ("", "", None)]


def test_small_text_functions(spark):
    from quaestor.functions import ids, text

    df = spark.createDataFrame([(" A , b,,a , b ", " X@Y.Z \n", bytearray(b"PK\x03"), bytearray(b"%PDF-1"), 0, "  ", "CUDA error"), (None, None, None, None, None, None, None)], "a string, b string, c binary, d binary, e long, f string, g string")
    got = df.select(text.comma_list(F.col("a")), text.e_mail(F.col("b")), ids.archive_like(F.col("c"), F.lit(None)), ids.pdf_like(F.col("d")), text.size_label(F.col("e")), text.optional_text(F.col("f")), text.holds_marker(F.col("g")), text.clean_cell(F.lit("3 $ \\times $ 4 $ x $"))).collect()
    assert [tuple(r) for r in got] == [(["A", "b", "a"], "x@y.z", True, True, "1 Ko", None, True, "3 x 4 x"), ([], None, False, False, "", None, False, "3 x 4 x")]
    assert spark.range(1).select(text.error_text(F.lit("E"), F.lit("x" * 900))).collect()[0][0] == "E: " + "x" * 497
    assert [r[0] for r in spark.createDataFrame([("a", "httpx"), ("a", "application/ZIP")], "x string, t string").select(ids.archive_like(F.lit(None).cast("binary"), F.col("t"))).collect()] == [False, True]


def test_durations(spark):
    df = spark.createDataFrame([(10.0, 12.25), (10.0, None), (None, None)], "s double, f double")
    assert [r[0] for r in df.select(dates.duration(F.col("s"), F.col("f"), F.lit(20.0))).collect()] == [2.2, 10.0, None]
