"""The versioned store and import files with headers of their own."""

from pyspark.sql import functions as F

from paymatch.plans import registry
from paymatch.sources import tables as tb
from paymatch.sources.artifacts import ArtifactStore

SCHEMA = "company_id string, document_id string, match_status string, provenance string, matched_pos string, vendor_id string"


def rows(spark, *values):
    return spark.createDataFrame([("C", i, s, "", "", "") for i, s in values], SCHEMA)


def test_store_appends_only_what_changed(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    assert store.latest("match").count() == 0
    assert store.append("match", rows(spark, ("a", "matched"), ("b", "unmatched")), "r1", "2024-01-01").count() == 2
    second = rows(spark, ("a", "matched"), ("b", "matched"), ("c", "matched"))
    for _ in range(2):  # a run that is repeated leaves the same rows
        added = store.append("match", second, "r2", "2024-01-02")
        assert sorted((r.document_id, r.version) for r in added.collect()) == [("b", 2), ("c", 1)]
        assert store.history("match").count() == 4
    assert store.append("match", second, "r3", "2024-01-03").count() == 0
    assert {r.document_id: (r.match_status, r.version, r.run_id) for r in store.latest("match").collect()} == {
        "a": ("matched", 1, "r1"), "b": ("matched", 2, "r2"), "c": ("matched", 1, "r2")}
    gaps = {(r.document_id, r.artifact_type): r.resolved for r in store.artifacts().collect()}
    assert gaps[("a", "match")] and not gaps[("a", "decision")] and len(gaps) == 15
    assert {r.document_id: r.decision for r in store.reconstruct().collect()} == {"a": None, "b": None, "c": None}


def test_rerun_writes_versions_of_touched_documents_only(spark):
    from paymatch.plans.queries_rerun import store
    fx = registry.fixtures(spark, "/root/testdata/sf0.001")
    s = store(fx)
    touched = {r.document_id for r in fx.__dict__["touched"].collect()}
    for name in ("match", "validation", "decision", "explanation"):
        again = s.history(name).filter("run_id = 'rerun'")
        assert {r.document_id for r in again.collect()} <= touched
        assert s.history(name).groupBy("document_id").agg(F.max("version").alias("v"), F.count("*").alias("n")).filter("v <> n").count() == 0
    assert s.history("decision").filter("version = 2").count() > 0
    stored = {r.document_id for r in s.latest("decision").collect()}
    assert stored == {r.document_id for r in fx.invoices.select("document_id").collect()}


def test_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Vendor ID,Name, Status \nV1,\"A, Inc.\",ok\n\nV2,B\n")
    (tmp_path / "b.csv").write_text("name,VENDOR  id,,name\nC,V3,x,again,more\n")
    (tmp_path / "c.csv").write_text("")
    got = {r.raw["vendor_id"]: (r.file_name, dict(r.raw)) for r in tb.read_import_files(spark, str(tmp_path)).collect()}
    assert got == {"V1": ("a.csv", {"vendor_id": "V1", "name": "A, Inc.", "status": "ok"}), "V2": ("a.csv", {"vendor_id": "V2", "name": "B"}),
                   "V3": ("b.csv", {"name": "C", "vendor_id": "V3", "column_3": "x", "name__4": "again", "column_5": "more"})}
