"""Archives and uploads: what a file is, what a zip holds, and corpora as Parquet with a manifest."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import Corpus

MAX_FILES, MAX_BYTES = 10_000, 2 << 30
#: The tables of a written corpus; an empty one has no files to read its columns from.
SCHEMAS = {
    "slots": "slot long, text string, after string, corpus string",
    "nodes": "node long, otype string, first_slot long, last_slot long, n_slots long, key long, corpus string",
    "node_features": "node long, value_str string, value_int long, corpus string, feature string",
    "edge_features": "src long, dst long, value string, corpus string, feature string",
}


def family(content: Column) -> Column:
    """zip, pdf, xml, html or text from the first bytes of a binary column, whatever its encoding; null for none of them. S27."""
    head = F.lower(F.hex(F.substring(content, 1, 5)))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return (
        F.when(head.startswith("504b0304"), "zip").when(head == "255044462d", "pdf")
        .when(text.startswith("<!doctype html") | text.startswith("<html"), "html").when(text.startswith("<?xml") | text.rlike(r"^<[a-z]"), "xml")
        .when(F.length(content) == 0, None).otherwise("text")
    )


def safe_members(data: bytes) -> list[tuple[str, bytes]]:
    """The files of a zip in name order; unsafe paths, links, encryption and bombs are errors. S17, S19."""
    out, total = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MAX_FILES:
            raise ValueError("too many files in the archive")
        for i in sorted(infos, key=lambda i: i.filename):
            path = PurePosixPath(i.filename)
            if path.is_absolute() or ".." in path.parts or "\\" in i.filename:
                raise ValueError(f"unsafe path {i.filename!r}")
            if i.flag_bits & 1:
                raise ValueError("the archive is encrypted")
            if i.external_attr >> 28 == 0xA:
                raise ValueError(f"{i.filename!r} is a link")
            total += i.file_size
            if total > MAX_BYTES:
                raise ValueError("the archive is too large")
            if not any(p.startswith((".", "__MACOSX")) for p in path.parts):
                out.append((i.filename, z.read(i)))
    return out


def version_parts(name: str) -> tuple:
    """Sorts version folders: numbers by value, a pre-release before its release. S18."""
    m = re.match(r"^v?(\d+(?:\.\d+)*)[.\-]?([A-Za-z].*)?$", name)
    if not m:
        return ((-1,), 0, name)
    return (tuple(int(x) for x in m[1].split(".")), 0 if m[2] else 1, m[2] or "")


def write_corpus(corpus: Corpus, folder: str) -> None:
    """Tables partitioned by corpus, with a manifest of their sizes. S20."""
    tables = {"slots": corpus.slots, "nodes": corpus.nodes, "node_features": corpus.node_features, "edge_features": corpus.edge_features}
    for name, df in tables.items():
        by = ["corpus", "feature"] if "feature" in df.columns else ["corpus"]
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")
    spark = corpus.slots.sparkSession
    meta = [("section_types", ",".join(corpus.section_types)), ("section_features", ",".join(corpus.section_features[t] for t in corpus.section_types)), ("slot_type", corpus.slot_type), ("int_features", ",".join(sorted(k for k, v in corpus.value_types.items() if v == "int")))]
    spark.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The inverse; a filter on corpus or feature prunes folders. S07, R09."""
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{folder}/manifest").collect()}
    types = meta["section_types"].split(",")
    t = lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    return Corpus(t("slots"), t("nodes"), t("node_features"), t("edge_features"), types, dict(zip(types, meta["section_features"].split(","), strict=True)), {k: "int" for k in meta["int_features"].split(",") if k}, meta["slot_type"])


def write_csv(rows: DataFrame, folder: str) -> None:
    """Search results as CSV with a header. S23."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def digests(files: DataFrame) -> DataFrame:
    """path, size, sha256, crc of files (path, content). S21, C19."""
    return files.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc"))


def latest_dataset(names: list[str]) -> str:
    """Of the folders that hold an otype file, the one to load: of sibling versions the latest. S17, S18."""
    folders = sorted({str(PurePosixPath(n).parent) for n in names if PurePosixPath(n).name == "otype.tf"})
    if not folders:
        raise ValueError("the archive holds no dataset")
    parents = {str(PurePosixPath(f).parent) for f in folders}
    if len(folders) > 1 and len(parents) > 1:
        raise ValueError("the archive holds several datasets")
    return max(folders, key=lambda f: version_parts(PurePosixPath(f).name))


def import_dataset(spark: SparkSession, data: bytes, folder: str, name: str, features: list[str] | None = None) -> Corpus:
    """A zip with a dataset as a corpus; its files are put into a folder that all executors see. S17."""
    from .tf import load_corpus

    members = safe_members(data)
    chosen = latest_dataset([n for n, _ in members])
    files = [(PurePosixPath(n).name, content.decode()) for n, content in members if str(PurePosixPath(n).parent) == chosen and n.endswith(".tf")]
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for file, text in files:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    return load_corpus(spark, folder, name, features)


def tei_members(zips: DataFrame) -> DataFrame:
    """path, member, text of the TEI files in zips (path, content), in name order, noise and other files skipped; a zip without
    any is an error. S19."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                found = [(path, n, x.decode("utf-8-sig")) for n, x in safe_members(bytes(content)) if n.lower().endswith((".xml", ".tei"))]
                if not found:
                    raise ValueError(f"{path} holds no TEI file")
                yield pd.DataFrame(found, columns=["path", "member", "text"])

    return zips.select("path", "content").mapInPandas(run, "path string, member string, text string")


def layout_errors(paths: list[str]) -> list[str]:
    """What a written corpus lacks or has too many of, from its file names. S20."""
    top = {p.split("/")[0] for p in paths}
    lacking = [f"missing {n}" for n in ("manifest", *SCHEMAS) if n not in top]
    return lacking + [f"unexpected {n}" for n in sorted(top - {"manifest", "contents", "history", *SCHEMAS}) if not n.startswith((".", "_"))]


def write_index(corpus: Corpus, folder: str, history: DataFrame) -> None:
    """The table of contents and the history beside a written corpus. S20."""
    from ..operators.reading import contents

    contents(corpus).write.mode("overwrite").partitionBy("corpus").parquet(f"{folder}/contents")
    history.write.mode("overwrite").parquet(f"{folder}/history")


def package_errors(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, error of a package's members (path, content) against its manifest (path, size, sha256): missing, unlisted, or changed. S21."""
    have = digests(members).select("path", F.col("size").alias("have_size"), F.col("sha256").alias("have"))
    both = manifest.select("path", "size", "sha256").join(have, "path", "full_outer")
    error = F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when((F.col("have") != F.col("sha256")) | (F.col("have_size") != F.col("size")), "changed")
    return both.select("path", error.alias("error")).where("error is not null")


def sql_literal(value: Column, kind: str) -> Column:
    """A value as SQL text: quotes doubled, null as NULL, lists as ARRAY[...]. S25."""
    if kind.startswith("array<"):
        inner = F.array_join(F.transform(value, lambda x: sql_literal(x, kind[6:-1])), ", ")
        return F.when(value.isNull(), "NULL").otherwise(F.concat(F.lit("ARRAY["), inner, F.lit("]")))
    plain = value.cast("string")
    shown = plain if kind in ("int", "bigint", "smallint", "tinyint", "boolean") or kind.startswith("decimal") else F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.isNull(), "NULL").otherwise(shown)


def inserts(rows: DataFrame, table: str) -> DataFrame:
    """statement: an INSERT for each row. S25."""
    names = ", ".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    values = F.concat_ws(", ", *[sql_literal(F.col(c), k) for c, k in rows.dtypes])
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(");")).alias("statement"))


def stored(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".corpus", ".cusx", ".ctei")) -> DataFrame:
    """path, size, modified of the objects in a store that end in one of the suffixes; contents aren't read. S26."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(F.lower("path").rlike("(" + "|".join(re.escape(x) for x in suffixes) + ")$"))
