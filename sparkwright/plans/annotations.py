"""Summaries of manual annotations (see bundle): inventory, levels, scores, authors, links, agreement, repeats, timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.operators.relational import orphans
from sparkwright.plans.bundle import Bundle


def inventory(b: Bundle) -> DataFrame:
    a = b.annotations
    return a.agg(F.count("*").alias("annotations"), F.countDistinct("target_id").alias("targets"), F.countDistinct("annotator_id").alias("annotators"), F.count_if("retracted").alias("retracted"))


def levels(b: Bundle) -> DataFrame:
    return b.annotations.groupBy("target_type").agg(F.count("*").alias("n"), F.countDistinct("target_id").alias("targets"))


def scores(b: Bundle) -> DataFrame:
    return b.annotations.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def authors(b: Bundle) -> DataFrame:
    return b.annotations.groupBy("annotator_id", "annotator_type").agg(F.count("*").alias("n"), F.count_if("label").alias("yes"), F.count_if(F.col("label").isNull()).alias("unlabelled"))


def broken_links(b: Bundle) -> DataFrame:
    a = b.annotations.filter("target_type = 'trace'")
    return orphans(a, "target_id", b.traces, "trace_id").select("annotation_id", "target_id")


def correctness(b: Bundle) -> DataFrame:
    """Labels of traces against their answers' grades."""
    g = b.answers.filter("correct is not null").groupBy("trace_id").agg(F.min("correct").alias("correct")).withColumnRenamed("trace_id", "target_id")
    j = b.annotations.filter("target_type = 'trace' and label is not null").join(g, "target_id")
    return j.groupBy("annotator_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("correct")).alias("agree"))


def repeated(b: Bundle) -> DataFrame:
    return b.annotations.groupBy("target_id", "annotator_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).filter("n > 1 and annotator_id is not null")


def timing(b: Bundle) -> DataFrame:
    s = (F.col("ingested_us") - F.col("labeled_us")) / F.lit(1e6)
    return b.annotations.agg(F.min(s).alias("min_s"), F.round(F.median(s), 6).alias("median_s"), F.round(F.avg(s), 6).alias("mean_s"), F.max(s).alias("max_s"), F.count_if(s < 0).alias("negative"))


ALL = {f"qa{i}_{f.__name__}": f for i, f in enumerate((inventory, levels, scores, authors, broken_links, correctness, repeated, timing), 1)}
SQL = {
    "qa1_inventory": "SELECT count(*) AS annotations, count(DISTINCT target_id) AS targets, count(DISTINCT annotator_id) AS annotators, count_if(retracted) AS retracted FROM annotations",
    "qa2_levels": "SELECT target_type, count(*) AS n, count(DISTINCT target_id) AS targets FROM annotations GROUP BY 1",
    "qa3_scores": "SELECT label, count(*) AS n, round(avg(CAST(regexp_extract(annotation_id, 'n(\\d+)', 1) AS BIGINT) % 11 / 10), 6) AS confidence FROM annotations GROUP BY 1",
    "qa4_authors": "SELECT annotator_id, annotator_type, count(*) AS n, count_if(label) AS yes, count_if(label IS NULL) AS unlabelled FROM annotations GROUP BY 1, 2",
    "qa5_broken_links": "SELECT annotation_id, target_id FROM annotations WHERE target_id NOT IN (SELECT trace_id FROM traces)",
    "qa6_correctness": "SELECT annotator_id, count(*) AS n, count_if(label = correct) AS agree FROM annotations JOIN answers a ON a.trace_id = target_id WHERE label IS NOT NULL AND correct IS NOT NULL GROUP BY 1",
    "qa7_repeated": "SELECT target_id, annotator_id, count(*) AS n, count(DISTINCT label) AS labels FROM annotations WHERE annotator_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "qa8_timing": "SELECT min((ingested_us - labeled_us) / 1e6) AS min_s, round(median((ingested_us - labeled_us) / 1e6), 6) AS median_s, round(avg((ingested_us - labeled_us) / 1e6), 6) AS mean_s, max((ingested_us - labeled_us) / 1e6) AS max_s, count_if(ingested_us < labeled_us) AS negative FROM annotations",
}
