"""Operators on the labels of trees and sequences: cleaning, unique names, replacement, taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_label(label: Column) -> Column:
    """No outer blanks or parentheses; commas, colons and semicolons become dashes, inner blanks underscores."""
    x = F.regexp_replace(label, r"^[\s(]+|[\s)]+$", "")
    x = F.regexp_replace(x, "[,:;]", "-")
    return F.regexp_replace(F.regexp_replace(x, r"[()\[\]]", "-"), r"\s+", "_")


def make_label(df: DataFrame, column: str, keys: list[str], length: int = 99, space: str = "_", unique: bool = True, illegal: str = "():;,[]", quote: bool = False, order: list[str] | None = None) -> DataFrame:
    """Labels without illegal characters, cut to a length and made unique within ``keys`` by a number at the end."""
    x = F.translate(F.regexp_replace(column, r"\s", space), illegal, "")
    out = df.withColumn(column, F.substring(x, 1, length))
    if unique:
        own = Window.partitionBy(*keys, column).orderBy(*(order or keys or [column]))
        n, k = F.count("*").over(Window.partitionBy(*keys, column)), F.row_number().over(own)
        short = F.expr(f"substring({column}, 1, {length} - length(cast(__n as string)))")
        out = out.withColumn("__n", n).withColumn("__k", k).withColumn(column, F.when(F.col("__n") > 1, F.concat(short, F.lpad(F.col("__k").cast("string"), F.length(F.col("__n").cast("string")), F.lit("0")))).otherwise(F.col(column))).drop("__n", "__k")
    return out.withColumn(column, F.concat(F.lit('"'), column, F.lit('"'))) if quote else out


def update_label(df: DataFrame, column: str, mapping: DataFrame, exact: bool = True) -> DataFrame:
    """Replace labels by a table (old, new): equal ones, or those that contain ``old``; with several, the first ``old`` in order wins."""
    m = F.broadcast(mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new")))
    if exact:
        return df.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")
    pairs = mapping.orderBy("old").collect()  # a list of replacements given by the caller
    out = F.col(column)
    for r in reversed(pairs):
        out = F.when(F.col(column).contains(r.old), F.lit(r.new)).otherwise(out)
    return df.withColumn(column, out)


def label_table(label: Column, sep: str = "_") -> list[Column]:
    """genus, species and subspecies of a label."""
    parts = F.split(label, sep)
    return [F.try_element_at(parts, F.lit(k + 1)).alias(name) for k, name in enumerate(("genus", "species", "subspecies"))]


def strip_label(label: Column, species: bool = False, subspecies: bool = True, sep: str = "_") -> Column:
    """Without the subspecies, or with ``species`` without the species too."""
    n = 1 if species else 2 if subspecies else 10
    return F.array_join(F.slice(F.split(label, sep), 1, n), sep)


def abbreviate_genus(label: Column, genus: bool = True, species: bool = False, sep: str = "_") -> Column:
    """The first lower-case run before the separator becomes a point, and on request the one after it."""
    out = label
    if genus:
        out = F.regexp_replace(out, rf"^([^a-z]*)[a-z]+{sep}", rf"$1.{sep}")
    if species:
        out = F.regexp_replace(out, rf"{sep}([a-z]).*$", rf"{sep}$1.")
    return out


def assign(label: Column, values: dict[str, str], default: str | None = None, pattern: bool = False) -> Column:
    """A value for each label by name, or by regular expressions of which the last match wins."""
    if not pattern:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[label], F.lit(default))
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(label.rlike(k), F.lit(v)).otherwise(out)
    return out


def node_labels(nodes: DataFrame, method: str = "number", prefix: str = "Node") -> DataFrame:
    """The nodes with labels for internal ones: numbered in order, or digests of the sorted labels below (md5)."""
    from sylva.operators.clades import clade_table
    from sylva.operators.tree_tables import with_children

    own = with_children(nodes)
    if method == "md5":
        names = clade_table(nodes).select("tree_id", "node", F.md5(F.concat_ws("\n", F.concat("clade", F.array(F.lit(""))))).alias("name"))
    else:
        names = own.where("not is_tip").select("tree_id", "node", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("tree_id").orderBy("node"))).alias("name"))
    return own.join(names, ["tree_id", "node"], "left").withColumn("label", F.coalesce("name", "label")).drop("name", "n_children", "is_tip")
