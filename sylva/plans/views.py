"""Trees, alignments, distances and traits derived from the commercial tables, as DataFrames.

``SQL`` has the same views as common table expressions for DuckDB.

Tables of nodes have one row a node: tree_id, node, parent (null for the root), length (null for the root or
where the tree has none) and label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.operators.vectors import vector_pairs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rooted binary tree over the parts: node k under floor(k / 2), lengths from the prices."""
    part = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("node"), (F.col("p_retailprice") / 1000).alias("price"))
    n = part.count()
    n -= 1 - n % 2
    inner = F.col("node") > 1
    return part.where(F.col("node") <= n).select(
        F.lit(1).cast("long").alias("tree_id"),
        "node",
        F.when(inner, F.floor(F.col("node") / 2)).alias("parent"),
        F.when(inner, F.col("price")).alias("length"),
        F.col("node").cast("string").alias("label"),
    )


def clock_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ultrametric binary tree: the heap tree with length 1 / level; tips above the last level reach down to it."""
    part = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("node"))
    n = part.count()
    n -= 1 - n % 2
    level = F.floor(F.log2(F.col("node") + F.lit(0.5)))
    inner, last = F.col("node") > 1, n.bit_length() - 1
    short = (2 * F.col("node") > n) & (level < last)
    length = 1 / level + F.when(short, 1 / (level + 1)).otherwise(0.0)
    return part.where(F.col("node") <= n).select(
        F.lit(2).cast("long").alias("tree_id"), "node", F.when(inner, F.floor(F.col("node") / 2)).alias("parent"), F.when(inner, length).alias("length"), F.col("node").cast("string").alias("label")
    )


def taxonomy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region / nation / customer names of each customer."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_name").alias("customer"))
    )


def week_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id, types): of each user and week with all five event types, the types by first occurrence."""
    events = read(spark, sf_dir, "events")
    first = events.groupBy("user_id", F.date_trunc("week", "ts").alias("week"), "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    weeks = first.groupBy("user_id", "week").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("s"))
    key = F.col("user_id") * 10_000 + F.datediff("week", F.lit("2000-01-01")).cast("long") / 7
    return weeks.where(F.size("s") == 5).select(F.floor(key).cast("long").alias("tree_id"), F.transform("s", lambda x: x["event_type"]).alias("types"))


def caterpillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rooted caterpillar tree for each week: the first type next to the root, the last two in the cherry."""
    nodes = week_orders(spark, sf_dir).select(
        "tree_id",
        F.explode(
            F.concat(
                F.transform("types", lambda t, i: F.struct((i + 1).cast("long").alias("node"), F.least(6 + i, F.lit(9)).cast("long").alias("parent"), (i + 1).cast("double").alias("length"), t.alias("label"))),
                F.transform(F.sequence(F.lit(6), F.lit(9)), lambda k: F.struct(k.cast("long").alias("node"), F.when(k > 6, (k - 1).cast("long")).alias("parent"), F.when(k > 6, F.lit(1.0)).alias("length"), F.lit(None).cast("string").alias("label"))),
            )
        ).alias("x"),
    )
    return nodes.select("tree_id", "x.*")


def calendar_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, seq): of each user one base a day from the type of the day's first event, a gap on other days."""
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = events.groupBy("user_id", "day").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("e"))
    types = events.select("event_type").distinct().withColumn("r", F.row_number().over(Window.orderBy("event_type")))
    span = events.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    bases = first.join(F.broadcast(types), F.col("e.event_type") == types.event_type).select("user_id", "day", F.expr("substring('aagct', cast((r - 1) % 5 + 1 as int), 1)").alias("base"))
    rows = bases.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "base"))).alias("m"))
    return rows.crossJoin(F.broadcast(span)).select(
        F.col("user_id").alias("label"), F.array_join(F.transform(F.sequence("lo", "hi"), lambda d: F.coalesce(F.element_at("m", d), F.lit("-"))), "").alias("seq")
    )


def nucleotides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, seq): the letters a, c, g, t and n of each whole document, in lower case."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("label"), F.regexp_replace(F.lower("text"), "[^acgtn]", "").alias("seq"))


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``nucleotides``, with spaces as gaps."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("label"), F.regexp_replace(F.regexp_replace(F.lower("text"), "[^acgtn ]", ""), " ", "-").alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, e): the embeddings in double precision."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, e, value): ``vectors`` with the class of each."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.col("label").alias("value"))


def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(matrix_id, i, j, d): Euclidean distances of all pairs of embeddings, i < j."""
    return vector_pairs(vectors(spark, sf_dir)).select(F.lit(1).cast("long").alias("matrix_id"), "i", "j", "d")


def user_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, k, w): seconds between a user's consecutive events, numbered from 1."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = at - F.lag(at).over(order)
    return events.select("user_id", (F.row_number().over(order) - 1).cast("long").alias("k"), (w / 1_000_000).alias("w")).where("w is not null")


#: The views for DuckDB.
SQL = {
    "heap": """heap AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS node, CASE WHEN p_partkey > 0 THEN CAST((p_partkey + 1) // 2 AS BIGINT) END AS parent, CASE WHEN p_partkey > 0 THEN p_retailprice / 1000 END AS length
  FROM part WHERE p_partkey + 1 <= (SELECT count(*) - 1 + count(*) % 2 FROM part))""",
    "clock": """clock AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS node, CASE WHEN p_partkey > 0 THEN CAST((p_partkey + 1) // 2 AS BIGINT) END AS parent,
    CASE WHEN p_partkey > 0 THEN 1 / l + CASE WHEN 2 * (p_partkey + 1) > n AND l < floor(log2(n + 0.5)) THEN 1 / (l + 1) ELSE 0 END END AS length
  FROM (SELECT p_partkey, floor(log2(p_partkey + 1.5)) AS l, (SELECT count(*) - 1 + count(*) % 2 FROM part) AS n FROM part) WHERE p_partkey + 1 <= n)""",
    "closure": """closure AS (
  SELECT node, node AS ancestor, 0 AS hops, CAST(0 AS DOUBLE) AS dist FROM {t}
  UNION ALL SELECT c.node, t.parent, c.hops + 1, c.dist + t.length FROM closure c JOIN {t} t ON t.node = c.ancestor WHERE t.parent IS NOT NULL)""",
    "weeks": """firsts AS (
  SELECT user_id, date_trunc('week', ts) AS week, event_type, min({'a': ts, 'b': event_id}) AS first_at FROM events GROUP BY ALL
), weeks AS (
  SELECT user_id * 10000 + date_diff('day', DATE '2000-01-01', CAST(week AS DATE)) // 7 AS tree_id, list(event_type ORDER BY first_at) AS types
  FROM firsts GROUP BY user_id, week HAVING count(*) = 5)""",
    "calendar": """types AS (
  SELECT event_type, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)
), day_first AS (
  SELECT user_id, CAST(ts AS DATE) AS day, min({'a': ts, 'b': event_id, 'c': event_type}).c AS event_type FROM events GROUP BY ALL
), bases AS (
  SELECT user_id, day, substr('aagct', CAST((r - 1) % 5 + 1 AS BIGINT), 1) AS base FROM day_first JOIN types USING (event_type)
), days AS (
  SELECT unnest(generate_series((SELECT min(day) FROM bases), (SELECT max(day) FROM bases), INTERVAL 1 DAY)) AS day
), sites AS (
  SELECT u.user_id AS label, date_diff('day', (SELECT min(day) FROM bases), CAST(d.day AS DATE)) + 1 AS pos, coalesce(base, '-') AS base
  FROM (SELECT DISTINCT user_id FROM bases) u CROSS JOIN days d LEFT JOIN bases b ON b.user_id = u.user_id AND b.day = d.day)""",
    "nucleotides": "nucleotides AS (SELECT doc_id AS label, regexp_replace(lower(text), '[^acgtn]', '', 'g') AS seq FROM documents)",
    "gapped": "gapped AS (SELECT doc_id AS label, replace(regexp_replace(lower(text), '[^acgtn ]', '', 'g'), ' ', '-') AS seq FROM documents)",
    "distances": """vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
distances AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.e, b.e) AS d FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id)""",
    "gaps": """gaps AS (SELECT user_id, k, w FROM (
  SELECT user_id, row_number() OVER o - 1 AS k, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER o AS DOUBLE) / 1000000 AS w FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE w IS NOT NULL)""",
}


def with_views(*names: str, tree: str = "") -> str:
    """A WITH clause of views; ``tree`` names the table whose closure is meant."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n].replace("{t}", tree) if n == "closure" else SQL[n] for n in names) + "\n"
