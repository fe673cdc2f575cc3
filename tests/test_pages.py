"""Pages from a stored order."""

import pytest
from pyspark.sql import functions as F

from brigade.operators import pages
from brigade.session import shared_path


@pytest.fixture(scope="module")
def directory(spark):
    df = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_003).alias("id"), F.repeat(F.lit("x"), 20).alias("text"))
    df.write.parquet(path := shared_path(spark, "list"))
    return pages.build(spark.read.parquet(path), [F.col("id").desc()], shared_path(spark, "pages"))


@pytest.mark.parametrize("offset,limit", [(0, 10), (1_000_000, 20), (99_990, 40), (1_999_990, 50), (2_000_000, 5), (5, 0)])
def test_pages_equal_the_sorted_list(spark, directory, offset, limit):
    want = sorted((k * 7919 % 2_000_003 for k in range(2_000_000)), reverse=True)[offset : offset + limit]
    got = pages.page(spark, directory, limit, offset).orderBy("position").collect()
    assert [r["id"] for r in got] == want and [r["position"] for r in got] == list(range(offset, offset + len(want)))


def test_a_far_page_reads_few_slices(spark, directory):
    assert directory.total == 2_000_000 and len(directory.slices) >= 15
    files = pages.page(spark, directory, 20, 1_000_000).select(F.input_file_name()).distinct().count()
    plan = pages.page(spark, directory, 20, 1_000_000)._jdf.queryExecution().executedPlan().toString()
    assert files < 3 and "_slice" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert pages.open_directory(spark, directory.path) == directory
