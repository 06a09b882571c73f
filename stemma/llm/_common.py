"""Shared helpers: tables on the cluster's shared folder, and the word definition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word of the operators 2 and 10, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Its complement: runs of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local session without that setting gets a temporary folder; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stemma-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _write(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stemma-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the application's part of the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation of what came before. The table stays, as a result may read it at any time."""
    return _write(df, label)[1]


class Tables:
    """Tables as of shared_table, which go when the block ends. Results must not read them: keep() writes what does."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.rows: dict[str, int] = {}  # of the last table of each label

    def __enter__(self) -> Tables:
        return self

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        seen = Observation(f"rows of {label}")
        path, out = _write(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
        self.paths.append(path)
        self.rows[label] = seen.get["n"]
        return out

    keep = staticmethod(shared_table)

    def __exit__(self, *_) -> None:
        context = self.spark.sparkContext
        for p in self.paths:
            path = context._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_parts(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df, whose work is on about `rows` rows, in no more tasks than have `each` of them: what is small needs few."""
    return df.coalesce(max(1, -(-rows // each)))


#: Words of 64 bits in the filter of narrow().
FILTER_WORDS = 1 << 17


def narrow(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows of df whose key may be among those of wanted: all of them, and a few others, which an exact join that
    follows takes out. Keys are 64-bit hashes. A bit stands for a key; the words that hold set bits are broadcast, at most
    FILTER_WORDS rows of 16 bytes, so the filter saves shuffles up to some million keys and costs little beyond."""
    place = F.pmod(wanted_key, F.lit(FILTER_WORDS * 64))
    bits = wanted.select(place.alias("__place")).groupBy(F.shiftright("__place", 6).alias("__word"))
    bits = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(__place & 63 as int))")).alias("__bits"))
    out = df.withColumn("__place", F.pmod(key, F.lit(FILTER_WORDS * 64)))
    out = out.join(F.broadcast(bits), F.shiftright("__place", 6) == F.col("__word"))
    return out.where("(__bits & shiftleft(1L, cast(__place & 63 as int))) <> 0").drop("__place", "__word", "__bits")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body: a lambda variable, so that the optimizer
    can't inline a costly expression into an inner lambda."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Words in text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bound the bytes of a batch that goes to Python, where the session has that setting, so that long
    texts don't add up; a smaller setting stays."""
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, f"{mb}m")
    if int(spark.conf.get(rows)) <= 0 or int(spark.conf.get(rows)) > 2000:
        spark.conf.set(rows, 2000)
