"""The shared folder and what is left in it."""

import os

from quillspan.session import cleanup, cut, shared_dir, work_path


def test_shared_folder(spark):
    at = shared_dir(spark)
    assert at == spark.conf.get("spark.checkpoint.dir")
    p = work_path(spark, "x")
    spark.range(3).write.parquet(p)
    cleanup(spark)
    assert not os.path.exists(p)


def test_cut_keeps_partitions(spark):
    df = spark.range(100).repartition(7, "id")
    assert cut(df).rdd.getNumPartitions() == 7 and cut(df).count() == 100


def test_command_line(spark, sf, tmp_path, capsys):
    from quillspan.__main__ import main

    main(["list"])
    assert "p1_found" in capsys.readouterr().out
    main(["a14_yearly_totals", sf, "--out", str(tmp_path / "o"), "--format", "csv"])
    assert spark.read.csv(str(tmp_path / "o"), header=True).columns == ["year", "files"]
    main(["s5_point_read", sf, "--explain"])
    assert "PushedFilters" in capsys.readouterr().out
