"""The slot graph as tables, and corpora built from relational and text sources.

slots(corpus, slot, text, after) and nodes(corpus, node, otype, first_slot, last_slot, n_slots, ranges):
slots are 1..max_slot, nodes come after them. Features are long tables; every node also carries the ids of
the sections that enclose it, so that section containment is an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prefix import running_sum
from .tables import kept


@dataclass
class Corpus:
    """One or many corpora, told apart by the column corpus."""

    slots: DataFrame
    nodes: DataFrame
    node_features: DataFrame
    edge_features: DataFrame
    section_types: list[str]
    section_features: dict[str, str]
    value_types: dict[str, str] = field(default_factory=dict)
    slot_type: str = "word"

    def of_type(self, otype: str) -> DataFrame:
        return self.nodes.where(F.col("otype") == otype)

    def feature(self, name: str) -> DataFrame:
        """corpus, node and the feature's value; only rows where it is defined."""
        column = "value_int" if self.value_types.get(name) == "int" else "value_str"
        return self.node_features.where(F.col("feature") == name).select("corpus", "node", F.col(column).alias(name))

    def with_features(self, nodes: DataFrame, names: list[str]) -> DataFrame:
        """nodes with a column for each feature, null where it isn't defined. One scan of the long table."""
        if not names:
            return nodes
        pick = lambda n: F.max(F.when(F.col("feature") == n, F.col("value_int" if self.value_types.get(n) == "int" else "value_str"))).alias(n)
        wide = self.node_features.where(F.col("feature").isin(names)).groupBy("corpus", "node").agg(*[pick(n) for n in names])
        return nodes.join(wide, ["corpus", "node"], "left")


def canonical_order() -> list[Column]:
    """First slot, the longer node first, then the node's number; nodes without slots come last."""
    return [F.col("first_slot").asc_nulls_last(), F.col("last_slot").desc_nulls_last(), F.col("node")]


def canonical_rank(nodes: DataFrame, within: tuple[str, ...] = ("corpus", "otype")) -> DataFrame:
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*canonical_order())))


#: The columns that put lineitem rows in a total order.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trade_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as slots under region, nation, customer and order: slot and the keys of all four levels.

    An order's slots are consecutive; its first comes from running sums over orders by customer, customers by
    nation and nations, so no task sees more than one customer's orders or a range of customers.
    """
    nation = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *LINE_ORDER)
    size = line.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    by_order = orders.join(size, "o_orderkey")
    by_customer = by_order.groupBy("c_custkey").agg(F.sum("n").alias("n")).join(customer, "c_custkey").join(nation, "n_nationkey")
    by_customer = running_sum(by_customer, ["n_regionkey", "n_nationkey"], F.expr("c_custkey div 8192"), ["c_custkey"], F.col("n"), "before")
    by_nation = by_customer.groupBy("n_regionkey", "n_nationkey").agg(F.sum("n").alias("nn"))
    by_nation = by_nation.withColumn("nation_before", F.coalesce(F.sum("nn").over(Window.orderBy("n_regionkey", "n_nationkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("nn")
    first = by_customer.join(by_nation, ["n_regionkey", "n_nationkey"]).select("n_regionkey", "n_nationkey", "c_custkey", (F.col("nation_before") + F.col("before")).alias("customer_before"))
    in_customer = Window.partitionBy("c_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    by_order = by_order.withColumn("order_before", F.coalesce(F.sum("n").over(in_customer), F.lit(0))).join(first, "c_custkey")
    by_order = by_order.select("n_regionkey", "n_nationkey", "c_custkey", "o_orderkey", (F.col("customer_before") + F.col("order_before")).alias("order_before"))
    in_order = Window.partitionBy("o_orderkey").orderBy(*LINE_ORDER)
    line = line.withColumn("place", F.row_number().over(in_order)).join(by_order, "o_orderkey")
    return line.select((F.col("order_before") + F.col("place")).cast("long").alias("slot"), "n_regionkey", "n_nationkey", "c_custkey", "o_orderkey", "place", *LINE_ORDER)


_loaded: dict[tuple[str, str], Corpus] = {}


def trade_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """build_trade_corpus, loaded once for each application and folder: later queries read its kept tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        _loaded[key] = build_trade_corpus(spark, sf_dir)
    return replace(_loaded[key])


def build_trade_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The order hierarchy as a slot graph: region > nation > customer > order, with lineitem rows as slots.

    Nodes above the slots are numbered by type (region, nation, customer, order) and key. Slots and the nodes of each
    type are kept as tables, so that no later plan holds the plan of the whole hierarchy again for each of its reads.
    """
    lines = kept(trade_slots(spark, sf_dir).drop("place", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"), "slots")
    span = lines.groupBy("n_regionkey", "n_nationkey", "c_custkey", "o_orderkey").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("n_slots"))
    span = kept(span, "spans")
    levels = [
        ("region", read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key")), "n_regionkey"),
        ("nation", read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key")), "n_nationkey"),
        ("customer", read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key")), "c_custkey"),
        ("order", read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key")), "o_orderkey"),
    ]
    offset = lines.agg(F.max("slot")).first()[0] or 0
    nodes = None
    for otype, keys, column in levels:
        spans = span.groupBy(F.col(column).cast("long").alias("key")).agg(F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"), F.sum("n_slots").alias("n_slots"))
        numbered = running_sum(keys.distinct(), [], F.expr("key div 8192"), ["key"], F.lit(1), "n") if otype != "region" else keys.withColumn("n", F.row_number().over(Window.orderBy("key")) - 1)
        part = numbered.join(spans, "key", "left").select(
            F.lit("trade").alias("corpus"), (F.col("n") + offset + 1).cast("long").alias("node"), F.lit(otype).alias("otype"),
            "first_slot", "last_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.col("key").alias("key"),
        )
        part = kept(part, otype).withColumn("otype", F.lit(otype))  # as a literal again: other types' tables aren't read
        offset += part.count()
        nodes = part if nodes is None else nodes.unionByName(part)
    slot_nodes = lines.select(F.lit("trade").alias("corpus"), F.col("slot").alias("node"), F.lit("item").alias("otype"), F.col("slot").alias("first_slot"), F.col("slot").alias("last_slot"), F.lit(1).cast("long").alias("n_slots"), F.col("l_partkey").alias("key"))
    nodes = slot_nodes.unionByName(nodes)
    slots = lines.select(F.lit("trade").alias("corpus"), "slot", F.col("l_returnflag").alias("text"), F.lit(" ").alias("after"))
    node = nodes.where("otype <> 'item'").select("otype", "key", "node")
    of = lambda t: node.where(F.col("otype") == t).select("key", "node")
    string = lambda df, otype, key, name, value: df.select(F.col(key).cast("long").alias("key"), F.col(value).cast("string").alias("value_str")).join(of(otype), "key").select(F.lit("trade").alias("corpus"), F.lit(name).alias("feature"), "node", "value_str", F.lit(None).cast("long").alias("value_int"))
    item = lambda name, value, kind: lines.select(F.lit("trade").alias("corpus"), F.lit(name).alias("feature"), F.col("slot").alias("node"), (F.col(value) if kind == "str" else F.lit(None)).cast("string").alias("value_str"), (F.col(value) if kind == "int" else F.lit(None)).cast("long").alias("value_int"))
    features = (
        string(read(spark, sf_dir, "region"), "region", "r_regionkey", "name", "r_name")
        .unionByName(string(read(spark, sf_dir, "nation"), "nation", "n_nationkey", "name", "n_name"))
        .unionByName(string(read(spark, sf_dir, "customer"), "customer", "c_custkey", "segment", "c_mktsegment"))
        .unionByName(string(read(spark, sf_dir, "orders"), "order", "o_orderkey", "status", "o_orderstatus"))
        .unionByName(string(read(spark, sf_dir, "orders"), "order", "o_orderkey", "priority", "o_orderpriority"))
        .unionByName(item("flag", "l_returnflag", "str")).unionByName(item("linestatus", "l_linestatus", "str"))
        .unionByName(item("quantity", "l_quantity", "int")).unionByName(item("linenumber", "l_linenumber", "int"))
    )
    edges = lines.select(F.lit("trade").alias("corpus"), F.lit("next_part").alias("feature"), F.col("slot").alias("src"), "l_partkey")
    following = lines.select((F.col("slot") - 1).alias("src"), F.col("slot").alias("dst"), F.col("l_partkey").alias("p2"))
    edges = edges.join(following, "src").where("p2 > l_partkey").select("corpus", "feature", "src", "dst", (F.col("p2") - F.col("l_partkey")).cast("string").alias("value"))
    return Corpus(slots, nodes, features, edges, ["region", "nation", "customer", "order"], {"region": "name", "nation": "name", "customer": "key", "order": "key"}, {"quantity": "int", "linenumber": "int"}, "item")


TOKEN = r"(\S+)(\s*)"


def text_lines(docs: DataFrame) -> DataFrame:
    """corpus (the language), doc_id, line_no (from 1), line: the lines that hold a word."""
    parts = docs.select(F.coalesce("lang", F.lit("und")).alias("corpus"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return parts.where(F.col("line").rlike(r"\S")).select("corpus", "doc_id", (F.col("p") + 1).alias("line_no"), "line")


def text_tokens(docs: DataFrame) -> DataFrame:
    """corpus, doc_id, line_no, word_no (from 1 in the line), text, after: white space before a line's first word drops."""
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(1)).alias("text"), F.regexp_extract_all("line", F.lit(TOKEN), F.lit(2)).alias("after"))
    t = text_lines(docs).select("corpus", "doc_id", "line_no", F.posexplode(both).alias("p", "t"))
    return t.select("corpus", "doc_id", "line_no", (F.col("p") + 1).alias("word_no"), F.col("t.text").alias("text"), F.col("t.after").alias("after"))


def text_slots(docs: DataFrame) -> DataFrame:
    """text_tokens with slot: dense from 1 in each corpus, in document order."""
    tokens = text_tokens(docs)
    per_line = text_lines(docs).select("corpus", "doc_id", "line_no", F.regexp_count("line", F.lit(r"\S+")).alias("n"))
    per_doc = per_line.groupBy("corpus", "doc_id").agg(F.sum("n").alias("n"))
    per_doc = running_sum(per_doc, ["corpus"], F.expr("doc_id div 4096"), ["doc_id"], F.col("n"), "doc_before").drop("n")
    in_doc = Window.partitionBy("corpus", "doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    per_line = per_line.withColumn("line_before", F.coalesce(F.sum("n").over(in_doc), F.lit(0))).join(per_doc, ["corpus", "doc_id"])
    before = per_line.select("corpus", "doc_id", "line_no", (F.col("doc_before") + F.col("line_before")).alias("before"))
    return tokens.join(before, ["corpus", "doc_id", "line_no"]).select("corpus", "doc_id", "line_no", "word_no", (F.col("before") + F.col("word_no")).cast("long").alias("slot"), "text", "after")


def text_corpus(docs: DataFrame) -> Corpus:
    """Documents as corpora by language: document > line, with words as slots. Lines are named as such: these texts have no blank lines."""
    t = text_slots(docs)
    top = t.groupBy("corpus").agg(F.max("slot").alias("top"))
    doc = t.groupBy("corpus", "doc_id").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("n_slots"))
    doc = running_sum(doc, ["corpus"], F.expr("doc_id div 4096"), ["doc_id"], F.lit(1), "n").join(top, "corpus")
    doc = doc.withColumn("node", F.col("top") + F.col("n") + 1)
    n_docs = doc.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"))
    line = t.groupBy("corpus", "doc_id", "line_no").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("n_slots"))
    line = running_sum(line, ["corpus"], F.expr("doc_id div 1024"), ["doc_id", "line_no"], F.lit(1), "n").join(top, "corpus").join(n_docs, "corpus")
    line = line.withColumn("node", F.col("top") + F.col("n_docs") + F.col("n") + 1)
    word = t.select("corpus", F.col("slot").alias("node"), F.lit("word").alias("otype"), F.col("slot").alias("first_slot"), F.col("slot").alias("last_slot"), F.lit(1).cast("long").alias("n_slots"), F.col("doc_id").alias("key"))
    nodes = word.unionByName(doc.select("corpus", "node", F.lit("document").alias("otype"), "first_slot", "last_slot", "n_slots", F.col("doc_id").alias("key")))
    nodes = nodes.unionByName(line.select("corpus", "node", F.lit("line").alias("otype"), "first_slot", "last_slot", "n_slots", F.col("line_no").cast("long").alias("key")))
    feature = lambda df, name, node, s, i: df.select("corpus", F.lit(name).alias("feature"), F.col(node).alias("node"), s.cast("string").alias("value_str"), i.cast("long").alias("value_int"))
    none = F.lit(None)
    features = feature(t, "text", "slot", F.col("text"), none).unionByName(feature(t, "after", "slot", F.col("after"), none))
    features = features.unionByName(feature(doc, "doc", "node", none, F.col("doc_id"))).unionByName(feature(line, "line", "node", none, F.col("line_no")))
    edges = t.sparkSession.createDataFrame([], "corpus string, feature string, src long, dst long, value string")
    return Corpus(t.select("corpus", "slot", "text", "after"), nodes, features, edges, ["document", "line"], {"document": "doc", "line": "line"}, {"doc": "int", "line": "int"}, "word")
