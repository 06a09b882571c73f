"""Queries over whole tables: no row of the input is left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma import catalog

SF = "/root/testdata/sf0.001"


def test_catalog_identify_takes_every_part(spark):
    got = catalog.QUERIES["catalog_identify"](spark, SF)
    parts = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {r[0] for r in got.select("id").collect()} == {r[0] for r in got.select("work_id").collect()} == parts
    assert got.where(F.col("id") == F.col("work_id")).count() == len(parts)


def test_every_event_is_a_marker(spark):
    spans, errors = (catalog.QUERIES[f"milestone_{k}"](spark, SF).select("doc", "id") for k in ("spans", "errors"))
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("doc"), F.expr("event_id div 4").alias("id")).distinct()
    assert spans.unionByName(errors).count() == events.count() and events.exceptAll(spans.unionByName(errors)).count() == 0


def test_every_event_is_of_a_job(spark):
    from stemma.queries.streams import job_events

    events = spark.read.parquet(f"{SF}/events.parquet")
    got = job_events(spark, SF)
    assert got.count() == events.count() and got.where("job >= 600 and kind <> 'queued'").count() == 0


def test_every_reference_is_read(spark):
    orders, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    customers = spark.read.parquet(f"{SF}/customer.parquet").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey").distinct()
    assert {r[0] for r in catalog.QUERIES["passages_by_reference"](spark, SF).select("id").collect()} == {r[0] for r in customers.collect()}


def test_postings_of_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    terms = docs.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("n"))
    assert catalog.QUERIES["postings"](spark, SF).agg(F.sum("n")).first()[0] == terms.agg(F.sum("n")).first()[0]
