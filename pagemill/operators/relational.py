"""What is asked of token, error, trace and node tables: plain DataFrame work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import visible


def ordered_text(rows: DataFrame, *keys: str, order: str = "tok", data: str = "data", name: str = "text") -> DataFrame:
    """The data of each group joined in order; a group is a document, so its list is bounded by the document."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("s"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias(name))


def text_of(nodes: Column, parents: Callable[[Column], Column], inside: bool = True) -> Column:
    """The texts of a document's nodes (an array in order) whose parent meets a condition, or doesn't, joined; null without any."""
    ids = F.transform(F.filter(nodes, parents), lambda n: n["node"])
    texts = F.filter(nodes, lambda n: (n["kind"] == "text") & (F.array_contains(ids, n["parent"]) == F.lit(inside)))
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda n: n["data"]), ""))


def node_at(nodes: Column, *path: int) -> Column:
    """The node at a path of child positions from the root, out of a document's nodes; null if there is none.

    One pass: children stand behind their parent, so each node is held against the next step only.
    """
    steps = F.array(F.lit(0), *[F.lit(sib) for sib in path])
    begin = F.struct(F.lit(0).alias("level"), F.get(nodes, F.lit(-1)).alias("node"))

    def step(at: Column, n: Column) -> Column:
        here = n["parent"].eqNullSafe(at["node"]["node"]) & (n["sib"] == F.get(steps, at["level"]))
        return F.when(here, F.struct((at["level"] + 1).alias("level"), n.alias("node"))).otherwise(at)

    return F.aggregate(nodes, begin, step, lambda at: F.when(at["level"] == len(path) + 1, at["node"]))


def shape(tokens: DataFrame) -> DataFrame:
    """Tokens without characters, as labels: DOCTYPE, <tag>, <tag/>, </tag>, comment, EOF."""
    label = (
        F.when(F.col("kind") == "StartTag", F.concat(F.lit("<"), "tag", F.when(F.col("self_closing"), F.lit("/>")).otherwise(F.lit(">"))))
        .when(F.col("kind") == "EndTag", F.concat(F.lit("</"), "tag", F.lit(">")))
        .when(F.col("kind") == "Comment", F.concat(F.lit("<!--"), "data", F.lit("-->")))
        .otherwise(F.col("kind"))
    )
    return tokens.where("kind <> 'Character'").select("doc_id", "tok", label.alias("label"))


def pretty(tokens: DataFrame) -> DataFrame:
    """A line for each token, for display."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))), "")
    line = (
        F.when(F.col("kind") == "StartTag", F.concat(F.lit("StartTag <"), "tag", attrs, F.when(F.col("self_closing"), F.lit("/>")).otherwise(F.lit(">"))))
        .when(F.col("kind") == "EndTag", F.concat(F.lit("EndTag </"), "tag", F.lit(">")))
        .when(F.col("kind") == "DOCTYPE", F.concat_ws(" ", F.lit("DOCTYPE"), "dt_name", "dt_public", "dt_system", F.when(F.col("force_quirks"), F.lit("(quirks)"))))
        .when(F.col("data").isNotNull(), F.concat(F.col("kind"), F.lit(' "'), visible(F.col("data")), F.lit('"')))
        .otherwise(F.col("kind"))
    )
    return tokens.select("doc_id", "tok", line.alias("line"))


def coalesce_runs(rows: DataFrame, *, order: str, value: str, key: str = "doc_id") -> DataFrame:
    """Runs of adjacent rows with one value: run, first and last order, rows. Gaps and islands over each document."""
    w = Window.partitionBy(key).orderBy(order)
    starts = rows.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def trace_runs(trace: DataFrame) -> DataFrame:
    """doc_id, run, state, n steps, pos of the first."""
    w = Window.partitionBy("doc_id").orderBy("step")
    starts = trace.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.first("state").alias("state"), F.count("*").alias("n"), F.min_by("pos", "step").alias("pos"))


def first_of(tokens: DataFrame, condition: str) -> DataFrame:
    """The first token of each document that meets the condition."""
    return tokens.where(condition).groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in tokens.columns if c != "doc_id"]), "tok").alias("t")).select("doc_id", "t.*")


def with_error(docs: DataFrame, errors: DataFrame, code: str) -> DataFrame:
    """Documents that have that parse error."""
    return docs.join(errors.where(F.col("code") == code), "doc_id", "left_semi")


def first_errors(errors: DataFrame, n: int = 100) -> DataFrame:
    """The first n errors of each document; their numbers are dense, so no window is needed."""
    return errors.where(F.col("err_ord") < n)


def child_at(nodes: DataFrame, *path: int) -> DataFrame:
    """The node at a path of child positions from each document's root."""
    at = nodes.where("parent IS NULL").select("doc_id", F.col("node").alias("up"))
    for sib in path:
        step = nodes.where(F.col("sib") == sib).select("doc_id", F.col("parent").alias("up"), "node")
        at = at.join(step, ["doc_id", "up"]).select("doc_id", F.col("node").alias("up"))
    return nodes.join(at.withColumnRenamed("up", "node"), ["doc_id", "node"], "left_semi")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, with multiplicity; side tells which."""
    right = right.select(left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
