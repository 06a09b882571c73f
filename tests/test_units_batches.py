"""Units of many documents go back to Spark together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from stemma.sources import markup


class Docs:
    """Stands for a DataFrame: runs the function on one batch of documents."""

    schema = {"id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    def __init__(self, texts):
        self.batch = pa.record_batch({"id": list(range(len(texts))), "x": texts})

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return list(run([self.batch]))


def test_small_documents_share_a_batch():
    got = markup.units(Docs(["<o><l flag='A'>1</l><l>2</l></o>", None, "<bad", "<o/>"] * 1000), "xml", "id", "x")
    assert len(got) == 1 and got[0].num_rows == 4000
    assert got[0].slice(0, 3).select(["id", "unit_id", "parent_id", "path", "type", "attrs", "text"]).to_pylist() == [
        {"id": 0, "unit_id": 0, "parent_id": None, "path": "00000000", "type": "l", "attrs": [("flag", "A")], "text": "1"},
        {"id": 0, "unit_id": 1, "parent_id": None, "path": "00000001", "type": "l", "attrs": [], "text": "2"},
        {"id": 2, "unit_id": 0, "parent_id": None, "path": "00000000", "type": "error", "attrs": [], "text": got[0].column("text")[2].as_py()},
    ]


def test_batches_lose_no_unit(spark):
    docs = spark.range(3000).select("id", F.concat(F.lit("<o>"), F.repeat(F.lit("<l/>"), F.expr("cast(id % 40 as int)")), F.lit("<m/></o>")).alias("x")).coalesce(1)
    got = markup.units(docs, "xml", "id", "x").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("unit_id").alias("top"))
    assert got.where("n = id % 40 + 1 and top = id % 40").count() == 3000
