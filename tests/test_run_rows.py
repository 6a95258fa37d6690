"""How the pages of a run are told apart while they are converted."""

import re

from pyspark.sql import functions as F

from pagemill.plans import run as run_plan


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_pages_of_a_run_sort_by_a_number_first(spark):
    captures = run_plan.Captures.of(pages(spark, (1, "https://e.com/a", "<main>x</main>")), None, False, False)
    keys = run_plan._keys(pages(spark, (1, "https://e.com/a", "")).select(F.col("url").alias("url_key"), "url"), [])
    df = captures.fetch(keys)
    assert [(r.url_key, r.markdown, r.converted) for r in df.collect()] == [("https://e.com/a", "x", True)]
    sorts = re.findall(r"Window .*?\], \[(\w+?)#\d+L?, (\w+?)#", df._jdf.queryExecution().sparkPlan().toString())
    assert sorts and set(sorts) == {("__row", "url_key")}
