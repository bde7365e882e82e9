import uuid

import pytest
from pyspark.sql import functions as F

from mullion.sources import sinks

HEADER = "# head\n\n"


def sections(spark, n, parts=5):
    rows = [(k, f"t{k}", f"## t{k}\né{'x' * (k % 50)}\n---\n") for k in range(n)]
    return spark.createDataFrame(rows, "ordinal bigint, task_id string, markdown string").orderBy(F.rand(1)).repartition(parts), HEADER + "".join(r[2] for r in rows)


@pytest.fixture
def mounted(spark, tmp_path):
    """A path that only Spark's file systems can open."""
    name = f"reports{uuid.uuid4().hex}"  # Spark keeps a file system by its name
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./out", f"file://{tmp_path}")
    return f"viewfs://{name}/out/run/report.md"


def test_parts_in_order_are_the_report(spark, mounted):
    made, text = sections(spark, 400)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = sinks.write_report(made, HEADER, mounted)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest["parts"]) > 1 and manifest["bytes"] == len(text.encode())
    assert "".join(sinks.report_parts(spark, mounted)) == text
    whole = text.encode()
    for p, part in zip(manifest["parts"], sinks.report_parts(spark, mounted), strict=True):
        assert whole[p["offset"] : p["offset"] + p["bytes"]] == part.encode()
    assert sinks.read_report(spark, mounted).count() == 400


def test_a_later_report_takes_the_place_and_a_failed_one_does_not(spark, mounted):
    first, text = sections(spark, 30)
    sinks.write_report(first, HEADER, mounted)
    broken = first.withColumn("markdown", F.when(F.col("ordinal") == 7, "no end").otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="line feed"):
        sinks.write_report(broken, HEADER, mounted)
    assert "".join(sinks.report_parts(spark, mounted)) == text
    second, later = sections(spark, 3)
    sinks.write_report(second, HEADER, mounted)
    assert "".join(sinks.report_parts(spark, mounted)) == later
    fs, at = sinks._file_system(spark, mounted)
    assert len([s for s in fs.listStatus(at) if s.getPath().getName().startswith("run-")]) == 1


def test_no_sections_and_no_header(spark, tmp_path):
    none, _ = sections(spark, 1)
    assert sinks.write_report(none.where("false"), HEADER, f"{tmp_path}/a")["bytes"] == len(HEADER)
    assert sinks.write_report(none.where("false"), "", f"{tmp_path}/b") == {"bytes": 0, "parts": []}
    assert sinks.read_report(spark, f"{tmp_path}/b").count() == 0
    with pytest.raises(ValueError, match="line feed"):
        sinks.write_report(none, "# head", f"{tmp_path}/c")


def test_the_summary_goes_through_the_same_file_systems(spark, mounted):
    path = mounted.replace("report.md", "summary.json")
    for n in (1, 2):
        sinks.write_summary(spark, {"n": n}, path)
        assert '"n": %d' % n in sinks.get(spark, path)
