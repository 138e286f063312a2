"""Snapshot diff and attribute history against plain dictionaries."""

from datetime import datetime

import pytest

from quillspan.operators import history
from quillspan.operators.snapshot_diff import SnapshotIndex, diff_snapshots, with_values

SCHEMA = "snapshot_id long, edition string, delivered_at timestamp_ntz, reference string, objective string, end_date string, controllers array<string>, edition_no int, key string"
COLUMNS = ("objective", "end_date", "controllers")


def rows(spark, data):
    at = lambda d: datetime(2023, 1, d)
    return spark.createDataFrame([(i, e, at(d), r, o, x, c, 7, "clash") for i, (e, d, r, o, x, c) in enumerate(data)], SCHEMA)


DATA = [
    ("january2023", 1, "A-v1", "one", "2024", ["X"]),
    ("january2023", 1, " a-V1 ", "late and right", "2024", ["X"]),  # the same reference, delivered later below
    ("january2023", 1, "B-v1", None, "", None),
    ("january2023", 1, "", "no reference", "", []),
    ("january2023", 1, None, "no reference", "", []),
    ("march2023", 3, "A-v1", "late and right", "2024", ["X"]),
    ("march2023", 3, "B-v1", "", None, []),  # null counts as blank
    ("march2023", 3, "C-v1", "new", "2025", ["X", "Y"]),
    ("april2023", 4, "B-v1", "", None, []),
    ("april2023", 4, "B-v1", "", None, []),  # repeated row
    ("april2023", 4, "C-v1", "new", "2025", ["X,Y"]),  # another array
    ("december2022", 1, "A-v1", "one", "2024", ["X"]),
    (None, 4, "D-v1", "no edition", "", []),
    ("sometime", 4, "D-v1", "no month", "", []),
]


def found(df):
    return sorted((r.edition, r.reference, r.change_kind) for r in df.collect())


def test_added_removed_changed(spark):
    assert found(diff_snapshots(rows(spark, DATA), COLUMNS)) == [
        ("april2023", "A-V1", "removed"),
        ("april2023", "C-V1", "changed"),
        ("january2023", "A-V1", "changed"),
        ("january2023", "B-V1", "added"),
        ("march2023", "C-V1", "added"),
    ]


def test_probing_and_swapping_gives_the_same_as_the_replay(spark):
    from pyspark.sql import functions as F
    from quillspan.functions.dates import edition_no
    from quillspan.sources.register import editions_of

    r = rows(spark, DATA)
    index, got = SnapshotIndex(spark, COLUMNS, 3), []
    for no, label in editions_of(r):
        got += found(index.probe(r.filter(edition_no(F.col("edition")) == no), label))
        with pytest.raises(ValueError):
            index.probe(r, label)
        index.swap()
        assert index.edition == label
        assert [t.name for t in spark.catalog.listTables() if t.name.startswith("quillspan_")] == [index.last]
    assert sorted(got) == found(diff_snapshots(r, COLUMNS))
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillspan_")]


def test_the_probe_shuffles_nothing(spark):
    r = rows(spark, DATA)
    index = SnapshotIndex(spark, COLUMNS, 3)
    index.probe(r.limit(2), "a").collect()
    index.swap()
    plan = index.probe(r, "b")._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert "Exchange" not in plan or "BroadcastExchange" in plan


def test_old_and_new_values_of_changes_alone(spark):
    r = rows(spark, DATA)
    got = {(x.edition, x.reference): (x.old_objective, x.new_objective) for x in with_values(diff_snapshots(r, COLUMNS), r, ("objective",)).collect()}
    assert got["january2023", "A-V1"] == ("one", "late and right")
    assert got["april2023", "A-V1"] == ("late and right", None)
    assert len(got) == 5


def test_text_moving_between_columns_is_a_change(spark):
    data = [("may2023", 1, "A", "x", "", []), ("june2023", 1, "A", "", "x", [])]
    assert found(diff_snapshots(rows(spark, data), COLUMNS)) == [("june2023", "A", "changed")]


def test_null_in_an_array_is_a_blank_entry(spark):
    data = [("may2023", 1, "A", "x", "", ["a", None]), ("june2023", 1, "A", "x", "", ["a", ""]), ("july2023", 1, "A", "x", "", ["a"])]
    assert found(diff_snapshots(rows(spark, data), COLUMNS)) == [("july2023", "A", "changed")]


@pytest.mark.parametrize("data", [[], DATA[:3]])
def test_no_or_one_edition_gives_nothing(spark, data):
    assert diff_snapshots(rows(spark, data), COLUMNS).collect() == []


def test_last_delivered_holds_however_late(spark):
    data = [("may2023", 1, "A", "x", "", []), ("june2023", 9, "A", "x", "", []), ("june2023", 2, "A", "wrong", "", [])]
    assert found(diff_snapshots(rows(spark, data), COLUMNS)) == []


def spans(df):
    return sorted((r.reference, r.valid_from, r.valid_to) for r in df.select("reference", "valid_from", "valid_to").collect())


def test_history(spark):
    assert spans(history.build(rows(spark, DATA), ("objective", "end_date"))) == [
        ("A-V1", "december2022", "january2023"),
        ("A-V1", "january2023", "april2023"),
        ("B-V1", "january2023", ""),
        ("C-V1", "march2023", ""),
    ]


def test_history_of_nothing(spark):
    assert history.build(rows(spark, []), ("objective",)).collect() == []


def test_a_reference_that_returns_opens_a_new_version(spark):
    data = [("may2023", 1, "A", "x", "", []), ("june2023", 1, "B", "y", "", []), ("july2023", 1, "A", "x", "", [])]
    assert spans(history.build(rows(spark, data), ("objective",))) == [("A", "july2023", ""), ("A", "may2023", "june2023"), ("B", "june2023", "july2023")]


def test_merging_edition_by_edition_gives_the_same_history(spark):
    from quillspan.functions.dates import edition_no
    from quillspan.sources.register import editions_of
    from pyspark.sql import functions as F

    r = rows(spark, DATA)
    dimension = history.empty_dimension(r)
    editions = editions_of(r)
    for no, _ in editions:
        dimension = history.merge(dimension, r.filter(edition_no(F.col("edition")) == no), no, ("objective", "end_date"))
    label = dict(editions)
    got = sorted((x.key, label[x.from_no], label[x.to_no] if x.to_no else "") for x in dimension.collect())
    assert got == spans(history.build(r, ("objective", "end_date")))


def test_values_of_a_history(spark):
    r = rows(spark, DATA)
    got = {(x.reference, x.valid_from): x.objective for x in history.history_values(history.build(r, ("objective",)), r, ("objective",)).collect()}
    assert got["A-V1", "january2023"] == "late and right"
