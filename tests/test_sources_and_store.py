"""Sheets, manifests, sinks, and the store: batch, one by one, late and again."""

import hashlib
import json
from datetime import datetime

import pytest

from quillspan.sources import sheets, sinks
from quillspan.sources.register import STATE_COLUMNS
from quillspan.streaming.store import RegisterStore, windowed_counts


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Reference Number,Title\nA,"one\nline, more"\n,\nB,two\n')
    rows = sheets.read_sheet(spark, str(tmp_path / "s.csv")).collect()
    assert [r["Reference Number"] for r in rows] == ["A", "B"]
    assert sheets.read_sheet_or_empty(spark, str(tmp_path / "none.csv"), ["A", "B"]).collect() == []
    assert sheets.read_sheet_or_empty(spark, str(tmp_path / "s.csv"), ["Title", "More"]).columns == ["Title", "More"]


def test_drifting_sheet(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Release register,,\n,,\nNIC Number (if any),Organisation Name,Purpose of use\nNIC-11111-AAAAA-v1; nic-22222-BBBBB-v3,Org,Why\n,Nobody,\n")
    fields = {"reference": ("NIC Number",), "organisation": ("Organisation", "Organisation Name"), "purpose": ("Purpose",), "benefits": ("Benefits",)}
    got = sheets.read_drifting(spark, str(tmp_path / "d.csv"), fields, "reference")
    from pyspark.sql import functions as F

    r = got.withColumn("refs", sheets.references_in(F.col("reference"))).collect()
    assert len(r) == 1 and r[0].organisation == "Org" and r[0].purpose == "Why" and r[0].benefits == ""
    assert r[0].refs == ["DARS-NIC-11111-AAAAA-V1", "DARS-NIC-22222-BBBBB-V3"]
    with pytest.raises(ValueError):
        sheets.read_drifting(spark, str(tmp_path / "d.csv"), {"x": ("Nowhere",)}, "x")


def test_rules_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"aliases": [{"canonical": "C", "variants": ["v", "w"]}], "ignored": []}))
    assert sorted((r.variant, r.canonical) for r in sheets.alias_rules(spark, str(tmp_path / "a.json")).collect()) == [("v", "C"), ("w", "C")]
    (tmp_path / "x.json").write_text(json.dumps({"agreements": [{"reference": "a-1", "reason": "test"}]}))
    rows = spark.createDataFrame([("A-1",), ("B-1",)], "base string")
    assert [r.base for r in sheets.without_excluded(rows, "base", sheets.exclusions(spark, str(tmp_path / "x.json"))).collect()] == ["B-1"]
    m = spark.createDataFrame([("july2023", "f1", "h1", "first"), ("june2023", "f0", "h0", "first")], "edition string, source_file string, sha256 string, ingested string")
    e = spark.createDataFrame([("july2023", "f1", "h1", "second"), ("june2023", "f0", "h9", "second"), ("august2023", "f2", "h2", "second")], m.schema)
    assert [(r.edition, r.ingested) for r in sheets.upsert(m, e).collect()] == [("june2023", "second"), ("july2023", "first"), ("august2023", "second")]


def test_verify(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    sha = hashlib.sha256(b"a").hexdigest()
    m = spark.createDataFrame([("a", sha), ("b", "0"), ("gone", "1")], "source_file string, sha256 string")
    assert sorted(tuple(r) for r in sheets.verify(spark, str(tmp_path), m).collect()) == [("a", "ok"), ("b", "BAD"), ("c", "new"), ("gone", "MISSING")]


def test_file_edition(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("x/register_July2023.csv",), ("other.csv",)], "p string").select(sheets.file_edition(F.col("p")).alias("e")).collect()
    assert [x.e for x in r] == ["july2023", ""]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, t string")
    at = str(tmp_path / "t")
    assert sinks.write_if_changed(df, at) and not sinks.write_if_changed(df, at)
    assert sinks.write_if_changed(df.limit(2), at) and spark.read.parquet(at).count() == 2
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "file").write_text("x")
    with pytest.raises(ValueError):
        sinks.prepare_output(spark, str(tmp_path / "mine"))
    sinks.prepare_output(spark, str(tmp_path / "out"))
    sinks.prepare_output(spark, str(tmp_path / "out"))
    sinks.write_index(spark.createDataFrame([("abc", "1"), ("b", "2")], "word string, encoded string"), str(tmp_path / "index"))
    assert {r.shard for r in spark.read.json(str(tmp_path / "index")).select("shard").collect()} == {"a", "b"}
    sinks.write_csv(spark.createDataFrame([(["x", "y"],)], "l array<string>"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().l == "x; y"


def test_feeds(spark):
    rows = spark.createDataFrame([(24000 + i, f"R<{i}>", "added", "A & B", f"p{i % 2}") for i in range(130)], "edition_no int, reference string, kind string, title string, page string")
    e = sinks.feed_entries(rows, "example.org").collect()
    assert len(e) == 24 and "A &amp; B" in e[0].entry and "R&lt;129&gt;" in min(e, key=lambda r: r.rank).entry
    per = sinks.feed_entries(rows, "example.org", "page")
    assert per.groupBy("page").count().collect()[0]["count"] == 50
    assert sinks.feed_documents(per, "Changes", "page").count() == 2


SNAP = "snapshot_id long, edition string, delivered_at timestamp_ntz, reference string, " + ", ".join(f"{c} {'array<string>' if c == 'controllers' else 'string'}" for c in STATE_COLUMNS)
FILES = "release_row_id long, file_ref string, group_id long, release_month string, opt_outs string, edition string, loaded_at timestamp_ntz"
AT = datetime(2023, 1, 1)


def snaps(spark, data):
    return spark.createDataFrame([(i, e, AT, r, *[["c"] if c == "controllers" else t if c == "title" else "" for c in STATE_COLUMNS]) for i, (e, r, t) in enumerate(data)], SNAP)


def files(spark, data):
    return spark.createDataFrame([(i, f, 1, m, "Yes", e, AT) for i, (e, f, m) in enumerate(data)], FILES)


EDITIONS = [("may2023", "A", "x"), ("may2023", "B", "b"), ("june2023", "A", "y"), ("july2023", "A", "x"), ("july2023", "C", "c")]
RELEASED = [("may2023", "F1", "2021-01"), ("may2023", "F2", "2021-01"), ("june2023", "F1", "2021-02"), ("july2023", "F1", "2021-02"), ("july2023", "F2", "2021-01")]
NO = {m: 2023 * 12 + i for m, i in (("may2023", 4), ("june2023", 5), ("july2023", 6))}


def content(store):
    states = store.read("states")
    return sorted((r.edition_no, r.key, r.state) for r in store.read("index").join(states, ["key", "state_no"]).collect())


def test_store(spark, tmp_path):
    one, all_at_once = RegisterStore(spark, str(tmp_path / "one")), RegisterStore(spark, str(tmp_path / "all"))
    s, f = snaps(spark, EDITIONS), files(spark, RELEASED)
    counts = [one.append(s.filter(f"edition = '{e}'"), f.filter(f"edition = '{e}'")) for e in ("may2023", "june2023", "july2023")]
    assert counts[0] == {"new_states": 2, "new_files": 2, "redescribed": 0, "withdrawn": 0}
    assert counts[1] == {"new_states": 1, "new_files": 0, "redescribed": 1, "withdrawn": 1}
    assert counts[2] == {"new_states": 1, "new_files": 1, "redescribed": 0, "withdrawn": 0}  # A is as it was first; F2 is back
    all_at_once.append(s, f)
    assert content(one) == content(all_at_once)
    assert {r.state_no for r in one.read("index").filter(f"key = 'A' and edition_no = {NO['july2023']}").collect()} == {0}
    assert [sorted((r.file_ref, r.month) for r in one.files_as_at(NO[e]).collect()) for e in NO] == [[("F1", "2021-01"), ("F2", "2021-01")], [("F1", "2021-02")], [("F1", "2021-02"), ("F2", "2021-01")]]
    assert one.edition(NO["june2023"]).count() == 1 and one.dangling().count() == 0
    again = one.append(s.filter("edition = 'july2023'"), f.filter("edition = 'july2023'"))
    assert again == {"new_states": 0, "new_files": 0, "redescribed": 0, "withdrawn": 0} and content(one) == content(all_at_once)


def test_late_edition_withdraws_nothing_newer(spark, tmp_path):
    store = RegisterStore(spark, str(tmp_path / "late"))
    s, f = snaps(spark, EDITIONS), files(spark, [*RELEASED[:-1], ("july2023", "F2", "2021-03")])
    for e in ("may2023", "july2023", "june2023"):
        store.append(s.filter(f"edition = '{e}'"), f.filter(f"edition = '{e}'"))
    assert sorted(r.file_ref for r in store.files_as_at(NO["july2023"]).collect()) == ["F1", "F2"]
    assert len(content(store)) == 5


def test_stream_of_editions(spark, tmp_path):
    store, whole = RegisterStore(spark, str(tmp_path / "s")), RegisterStore(spark, str(tmp_path / "w"))
    s = snaps(spark, EDITIONS)
    for k, e in enumerate(("may2023", "june2023", "july2023")):
        s.filter(f"edition = '{e}'").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
    for _ in range(2):  # the second run finds nothing new
        q = store.follow(str(tmp_path / "in" / "*.parquet"), SNAP, str(tmp_path / "ck"))
        q.awaitTermination()
    whole.append(s)
    assert content(store) == content(whole)


def test_windowed_stream(spark, sf, tmp_path):
    import shutil

    (tmp_path / "ev").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "ev")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    q = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("ev_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ev_counts").groupBy().sum("n").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
