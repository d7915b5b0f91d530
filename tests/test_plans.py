"""The shape of the plans: what is pruned, pushed down, moved."""

from pyspark.sql import functions as F

from quillspark.catalog import inputs
from quillspark.catalog.queries import PAGE_OPTIONS
from quillspark.operators.matching import missing_files
from quillspark.operators.parts import slice_parts
from quillspark.operators.report import status_report
from quillspark.plans.batch import convert_batch

from .helpers import plan_of


def _pages(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.col("html").alias("text"))


def test_conversion_is_one_pass_without_a_shuffle(spark, sf_dir):
    plan = plan_of(convert_batch(_pages(spark, sf_dir), collisions=False, **PAGE_OPTIONS), "simple")
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert plan.count("<(?i:b|strong)>") == 1
    assert "Python" not in plan and "ArrowEval" not in plan


def test_every_format_is_checked_once(spark, sf_dir):
    corpus = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), "doc_id", F.lit(".json")).alias("file"), "text"
    )
    plan = plan_of(convert_batch(corpus, collisions=False), "simple")
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert plan.count("from_xml") == 2 and plan.count("from_json") == 2
    assert plan.count("is_valid_utf8") <= 1


def test_the_report_prunes_the_conversion(spark, sf_dir):
    results = convert_batch(_pages(spark, sf_dir), collisions=False, **PAGE_OPTIONS)
    plan = plan_of(status_report(results), "simple")
    assert "<(?i:b|strong)>" not in plan and "rangepartitioning" in plan


def test_page_ranges_reach_the_scan(spark, sf_dir):
    plan = plan_of(slice_parts(inputs.table(spark, sf_dir, "conversations"), "turn", 1, 3))
    assert "GreaterThanOrEqual(turn,1), LessThanOrEqual(turn,3)" in plan


def test_the_existence_check_reads_the_key_only(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang")
    plan = plan_of(missing_files(docs, inputs.table(spark, sf_dir, "labels"), "doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in plan
