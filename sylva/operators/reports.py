"""Short descriptions of trees, sets of trees, clades and comparisons as tables of text, and other small forms of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.tree_tables import predicates, tree_summary, with_children


def tree_report(nodes: DataFrame, shown: int = 6) -> DataFrame:
    """(tree_id, report): numbers of tips and nodes, the first labels of tips, whether rooted, whether with lengths."""
    counts = tree_summary(nodes).select("tree_id", "n_tip", "n_node")
    tips = with_children(nodes).where("is_tip").withColumn("k", F.row_number().over(Window.partitionBy("tree_id").orderBy("node")))
    first = tips.where(F.col("k") <= shown).groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ", ").alias("labels"))
    rooted = predicates(nodes).select("tree_id", "is_rooted")
    lengths = nodes.groupBy("tree_id").agg((F.count("length") > 0).alias("with_lengths"))
    met = counts.join(first, "tree_id").join(rooted, "tree_id").join(lengths, "tree_id")
    text = F.concat(
        F.lit("tree with "), F.col("n_tip").cast("string"), F.lit(" tips and "), F.col("n_node").cast("string"), F.lit(" inner nodes; tips: "), F.col("labels"), F.when(F.col("n_tip") > shown, ", ...").otherwise(""),
        F.when(F.col("is_rooted"), "; rooted").otherwise("; unrooted"), F.when(F.col("with_lengths"), "; with branch lengths").otherwise("; without branch lengths"),
    )
    return met.select("tree_id", text.alias("report"))


def set_report(nodes: DataFrame) -> DataFrame:
    """One row: number of trees, tips of the smallest and the largest, different labels of tips."""
    own = with_children(nodes).where("is_tip")
    sizes = own.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_trees"), F.min("n").alias("min_tips"), F.max("n").alias("max_tips"))
    labels = own.agg(F.countDistinct("label").alias("n_labels"))
    return sizes.crossJoin(labels)  # one row each


def clade_report(census: DataFrame, n_trees: int) -> DataFrame:
    """(clade, number, share, text) of a census of clades, the most frequent ones first by ``place``."""
    clade = F.concat_ws(",", "clade")
    place = F.row_number().over(Window.orderBy(F.desc("number"), clade))
    text = F.concat(F.lit("{"), clade, F.lit("} in "), F.col("number").cast("string"), F.lit(f" of {n_trees} trees"))
    return census.select(place.cast("long").alias("place"), "number", (F.col("number") / n_trees).alias("share"), text.alias("text"))


def comparison_report(compared: DataFrame) -> DataFrame:
    """One row: clades of both trees, of the first only, of the second only, and whether they agree."""
    n = compared.agg(F.count_if(F.col("in_x") & F.col("in_y")).alias("shared"), F.count_if(~F.col("in_y")).alias("first_only"), F.count_if(~F.col("in_x")).alias("second_only"))
    return n.withColumn("same", (F.col("first_only") == 0) & (F.col("second_only") == 0))


def signed_ids(nodes: DataFrame) -> DataFrame:
    """The nodes with tips numbered 1 to n and inner nodes -1 to -m, each in the order of their ids, as older files have them."""
    own = with_children(nodes)
    k = F.row_number().over(Window.partitionBy("tree_id", "is_tip").orderBy("node")).cast("long")
    ids = own.select("tree_id", "node", F.when(F.col("is_tip"), k).otherwise(-k).alias("signed"))
    up = ids.toDF("tree_id", "parent", "above")
    return own.join(ids, ["tree_id", "node"]).join(up, ["tree_id", "parent"], "left").select("tree_id", F.col("signed").alias("node"), F.col("above").alias("parent"), "length", "label")


def unsigned_ids(nodes: DataFrame) -> DataFrame:
    """The inverse of ``signed_ids``: tips 1 to n, inner nodes from n + 1."""
    n = nodes.groupBy("tree_id").agg(F.count_if(F.col("node") > 0).alias("n"))
    f = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col("n") - F.col(c))
    return nodes.join(n, "tree_id").select("tree_id", f("node").alias("node"), F.when(F.col("parent").isNotNull(), f("parent")).alias("parent"), "length", "label")


def calibrations(nodes: DataFrame, ages: DataFrame | None = None, age_min: float = 1.0, age_max: float | None = None, soft: bool = False) -> DataFrame:
    """(tree_id, node, age_min, age_max, soft_bounds) for dating: the roots, or the nodes of ``ages`` (tree_id, node, age_min, age_max)."""
    top = F.lit(age_min if age_max is None else age_max)
    own = nodes.where("parent is null").select("tree_id", "node", F.lit(age_min).alias("age_min"), top.alias("age_max")) if ages is None else ages.select("tree_id", "node", "age_min", F.coalesce("age_max", "age_min").alias("age_max"))
    return own.withColumn("soft_bounds", F.lit(soft))


def files_by_folder(files: DataFrame) -> DataFrame:
    """(folder, kind, files, bytes) of a table of files (path, kind, bytes)."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder"), "kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
