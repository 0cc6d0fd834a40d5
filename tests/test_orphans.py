from conftest import at, rows

from quaestor.operators.orphans import orphan_references, orphan_snapshots
from quaestor.operators.skew import hot_keys, salted_left_join

T = [at(f"2025-0{m}-10T10:00:00") for m in range(1, 9)]


def _tables():
    offers = [
        dict(offer_row=1, consultation_id="7", org_acronyme="ABC", ingested_at=T[0]),
        dict(offer_row=2, consultation_id="8", org_acronyme="ABC", ingested_at=T[4]),  # after its document
        dict(offer_row=3, consultation_id="9", org_acronyme="ABC", ingested_at=T[0]),
        dict(offer_row=4, consultation_id="9", org_acronyme="abc ", ingested_at=T[6], swept_at=T[7]),  # withdrawn later
        dict(offer_row=5, consultation_id=None, org_acronyme="ABC", ingested_at=T[0]),
        dict(offer_row=6, consultation_id="7", org_acronyme="ABC", ingested_at=None),
    ]
    documents = [
        dict(id=10, consultation_id="7", org_acronyme=" abc", ingested_at=T[1]),
        dict(id=10, consultation_id="7", org_acronyme=" abc", ingested_at=T[1]),  # repeated
        dict(id=11, consultation_id="8", org_acronyme="ABC", ingested_at=T[1]),
        dict(id=12, consultation_id="9", org_acronyme="ABC", ingested_at=T[1]),
        dict(id=13, consultation_id="404", org_acronyme="ABC", ingested_at=T[1]),
        dict(id=14, consultation_id=" ", org_acronyme="ABC", ingested_at=T[1]),
        dict(id=15, consultation_id="404", org_acronyme=None, ingested_at=T[1]),
        dict(id=16, consultation_id="404", org_acronyme="ABC", ingested_at=T[1], swept_at=T[2]),  # withdrawn itself
        dict(id=17, consultation_id="404", org_acronyme="ABC", ingested_at=T[1]),
        dict(id=17, consultation_id="7", org_acronyme="ABC", ingested_at=T[5]),  # corrected later
        dict(id=None, consultation_id="404", org_acronyme="ABC", ingested_at=T[1]),
    ]
    files = [
        dict(id=20, offer_document_id=10, ingested_at=T[2]),
        dict(id=21, offer_document_id=999, ingested_at=T[2]),
        dict(id=22, offer_document_id=None, ingested_at=T[2]),
        dict(id=23, offer_document_id=11, ingested_at=T[0]),  # before its document
        dict(id=24, offer_document_id=16, ingested_at=T[2]),
    ]
    return dict(offers=offers, offer_documents=documents, offer_files=files)


WANT = sorted(
    [("offer_documents", 11, "2025-02"), ("offer_documents", 12, "2025-02"), ("offer_documents", 13, "2025-02"),
     ("offer_files", 21, "2025-03"), ("offer_files", 23, "2025-01"), ("offer_files", 24, "2025-03")], key=repr
)


def test_cases_are_the_same_for_any_cut_of_the_history(spark, make_root):
    root = make_root(**_tables())
    for cuts in ([], ["2025-03-01T00:00:00Z"], ["2025-02-01T00:00:00Z", "2025-05-20T00:00:00Z"]):
        assert rows(orphan_references(spark, root, cuts)) == WANT


def test_snapshots_show_resolution_and_reopening(spark, make_root):
    root = make_root(**_tables())
    seen = {(r.batch, r.table_name, r.status): r.orphans for r in orphan_snapshots(spark, root, ["2025-04-20T00:00:00Z"]).collect() if r.table_name == "offer_documents"}
    assert seen[1, "offer_documents", "absent"] == 3  # 11, 13 and 17 wait
    assert seen[2, "offer_documents", "absent"] == 1 and seen[2, "offer_documents", "late"] == 1 and seen[2, "offer_documents", "withdrawn"] == 1


def test_empty_tables(spark, make_root):
    assert orphan_references(spark, make_root()).count() == 0


def test_hot_keys_are_split_without_loss(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else str(i)) for i in range(600)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("0", 2)], "k string, v int")
    hot = hot_keys(left, "k", share=0.1, least=10)
    assert hot == ["hot"]
    plain = rows(salted_left_join(left, right, "k", "id", []).select("id", "k", "v"))
    assert rows(salted_left_join(left, right, "k", "id", hot, salts=7).select("id", "k", "v")) == plain and len(plain) == 600
