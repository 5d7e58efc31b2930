"""Registered queries on edits, orders, sets, readers and writers of trees, trees from distances, covariance models, and forms of
sequences.

Edited trees are compared by the labels below each node and the length above it, which does not depend on how nodes are numbered.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.operators import comparative as K
from sylva.operators import edits as E
from sylva.operators import inference as I
from sylva.operators import seq_types as Q
from sylva.operators import sequences as S
from sylva.operators import simulation as M
from sylva.operators import tree_tables as T
from sylva.plans import views as V
from sylva.registry import query
from sylva.sources import readers as R
from sylva.sources import writers as W

TIPS5, INNER4 = "(SELECT unnest([1, 2, 3, 4, 5]) AS i)", "(SELECT unnest([1, 2, 3, 4]) AS j)"
CAT_SQL = f"""cat AS (SELECT tree_id, CAST(i AS BIGINT) AS node, CAST(least(5 + i, 9) AS BIGINT) AS parent, CAST(i AS DOUBLE) AS length, types[i] AS label FROM weeks, {TIPS5}
UNION ALL SELECT tree_id, 5 + j, CASE WHEN j > 1 THEN 4 + j END, CASE WHEN j > 1 THEN 1.0 END, NULL FROM weeks, {INNER4})"""
CAT = V.with_views("weeks").rstrip() + ",\n" + CAT_SQL + "\n"
#: Each caterpillar with the place of the first of all labels.
PLACED = CAT.rstrip() + ", base AS (SELECT tree_id, types, list_position(types, m) AS p FROM weeks, (SELECT min(event_type) AS m FROM events))\n"
#: The clades of the trees ``e`` with their lengths.
CLADES = """, reach AS (SELECT tree_id, node, node AS anc FROM e UNION ALL SELECT r.tree_id, r.node, e.parent FROM reach r JOIN e ON e.tree_id = r.tree_id AND e.node = r.anc WHERE e.parent IS NOT NULL)
SELECT r.tree_id, string_agg(t.label, ',' ORDER BY t.label) AS clade, round(any_value(a.length), 6) AS length FROM reach r JOIN e t ON t.tree_id = r.tree_id AND t.node = r.node AND t.label IS NOT NULL
JOIN e a ON a.tree_id = r.tree_id AND a.node = r.anc GROUP BY r.tree_id, r.anc"""


def edited_sql(e: str, head: str = CAT) -> str:
    return head.rstrip() + ", e AS (" + e + ")\n" + CLADES


def cat(spark, sf_dir):
    return V.caterpillars(spark, sf_dir)


def first_label(spark, sf_dir) -> str:
    return V.read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]


def clades(nodes):
    return E.clade_lengths(nodes).withColumn("length", F.round("length", 6))


# -- rooting, pruning, grafting ---------------------------------------------------------------------------
@query(edited_sql("""SELECT tree_id, node, CASE WHEN parent = 7 THEN 6 ELSE parent END AS parent, CASE WHEN node = 1 THEN length + 1 ELSE length END AS length, label FROM cat WHERE node <> 7"""))
def unroot(spark, sf_dir):
    return clades(E.unroot(cat(spark, sf_dir)))


HALF = "(CASE WHEN p = 1 THEN 2 ELSE p END) / 2.0"
ROOTED = edited_sql(
    f"""SELECT tree_id, 0 AS node, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS DOUBLE) AS length, CAST(NULL AS VARCHAR) AS label FROM base
UNION ALL SELECT tree_id, i, CASE WHEN i = p THEN 0 WHEN i <= 2 THEN 6 WHEN i = 3 THEN 8 ELSE 9 END, CASE WHEN i = p THEN 0.5 ELSE 1 END * CASE WHEN i = 1 THEN 2 ELSE i END, types[i] FROM base, {TIPS5}
UNION ALL SELECT tree_id, 6, CASE WHEN p <= 2 THEN 0 ELSE 8 END, CASE WHEN p <= 2 THEN {HALF} ELSE 1 END, NULL FROM base
UNION ALL SELECT tree_id, 8, CASE WHEN p <= 2 THEN 6 WHEN p = 3 THEN 0 ELSE 9 END, CASE WHEN p = 3 THEN {HALF} ELSE 1 END, NULL FROM base
UNION ALL SELECT tree_id, 9, CASE WHEN p <= 3 THEN 8 ELSE 0 END, CASE WHEN p <= 3 THEN 1 ELSE {HALF} END, NULL FROM base""",
    PLACED,
)


@query(ROOTED)
def root(spark, sf_dir):
    return clades(E.root(cat(spark, sf_dir), [first_label(spark, sf_dir)]))


@query(edited_sql("SELECT tree_id, node, CASE node WHEN 8 THEN NULL WHEN 7 THEN 8 WHEN 1 THEN 7 ELSE parent END AS parent, CASE node WHEN 8 THEN NULL WHEN 1 THEN 2 ELSE length END AS length, label FROM cat WHERE node <> 6"))
def root_at_node(spark, sf_dir):
    return clades(E.root(cat(spark, sf_dir), node=8))


KEPT = edited_sql(
    f"""SELECT tree_id, 5 + j AS node, CASE WHEN pj >= 1 THEN 5 + pj END AS parent, CASE WHEN pj >= 1 THEN CAST(j - pj AS DOUBLE) END AS length, CAST(NULL AS VARCHAR) AS label
FROM (SELECT tree_id, j, least(p, 4) AS r, CASE WHEN j - 1 = least(p, 4) THEN j - 2 ELSE j - 1 END AS pj FROM base, {INNER4}) WHERE j <> r
UNION ALL SELECT tree_id, i, CASE WHEN least(i, 4) = least(p, 4) THEN 8 ELSE 5 + least(i, 4) END, CASE WHEN least(i, 4) = least(p, 4) THEN i + 1 ELSE i END, types[i] FROM base, {TIPS5} WHERE i <> p""",
    PLACED,
)


@query(KEPT)
def keep_tip(spark, sf_dir):
    kinds = [r[0] for r in V.read(spark, sf_dir, "events").select("event_type").distinct().collect()]
    return clades(E.keep_tips(cat(spark, sf_dir), [x for x in kinds if x != min(kinds)]))


@query(edited_sql("SELECT tree_id, node, CASE WHEN node <> 9 THEN parent END AS parent, CASE WHEN node <> 9 THEN length END AS length, label FROM cat WHERE node IN (4, 5, 9)"))
def drop_fossil(spark, sf_dir):
    return clades(E.drop_fossils(cat(spark, sf_dir), 1.5))


@query(edited_sql("SELECT * FROM cat"))
def collapse_singles(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    tip = F.col("label").isNotNull()
    above = nodes.where(tip).select("tree_id", (F.col("node") + 100).alias("node"), "parent", (F.col("length") / 4).alias("length"), F.lit(None).cast("string").alias("label"))
    below = nodes.withColumn("parent", F.when(tip, F.col("node") + 100).otherwise(F.col("parent"))).withColumn("length", F.when(tip, F.col("length") * 0.75).otherwise(F.col("length")))
    return clades(E.collapse_singles(below.unionByName(above)))


def _second(spark, sf_dir):
    return cat(spark, sf_dir).withColumn("label", F.concat("label", F.lit("2")))


@query(edited_sql("SELECT * FROM cat UNION ALL SELECT tree_id, node + 10, CASE WHEN parent = 6 THEN 6 ELSE parent + 10 END, length, label || '2' FROM cat WHERE node <> 6"))
def bind_tree(spark, sf_dir):
    return clades(E.bind(cat(spark, sf_dir), _second(spark, sf_dir)))


@query(
    edited_sql(
        """SELECT c.tree_id, node, CASE WHEN node = p THEN 200 ELSE parent END AS parent, CASE WHEN node = p THEN 0.5 ELSE length END AS length, label FROM cat c JOIN base USING (tree_id)
UNION ALL SELECT c.tree_id, 200, parent, length - 0.5, NULL FROM cat c JOIN base USING (tree_id) WHERE node = p
UNION ALL SELECT tree_id, node + 10, CASE WHEN node = 6 THEN 200 ELSE parent + 10 END, length, label || '2' FROM cat""",
        PLACED,
    )
)
def bind_tree_edge(spark, sf_dir):
    return clades(E.bind(cat(spark, sf_dir), _second(spark, sf_dir), first_label(spark, sf_dir), 0.5))


# -- polytomies and lengths ---------------------------------------------------------------------------------
@query(edited_sql("SELECT tree_id, node, CASE WHEN parent = 8 AND tree_id % 2 = 0 THEN 7 ELSE parent END AS parent, length, label FROM cat WHERE NOT (node = 8 AND tree_id % 2 = 0)"))
def di2multi(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    short = (F.col("node") == 8) & (F.col("tree_id") % 2 == 0)
    return clades(E.to_polytomies(nodes.withColumn("length", F.when(short, 1e-9).otherwise(F.col("length")))).withColumn("length", F.round("length", 6)))


@query(
    edited_sql("SELECT tree_id, node, CASE WHEN node IN (2, 3) THEN 300 WHEN node = 9 THEN 7 ELSE parent END AS parent, length, label FROM cat WHERE node <> 8 UNION ALL SELECT tree_id, 300, 7, 0, NULL FROM weeks")
)
def multi2di(spark, sf_dir):
    nodes = cat(spark, sf_dir).where("node <> 8").withColumn("parent", F.when(F.col("parent") == 8, F.lit(7)).otherwise(F.col("parent")).cast("long"))
    return clades(E.to_binary(nodes))


@query(CAT + "SELECT tree_id, node, CAST(CASE WHEN node BETWEEN 1 AND 4 THEN 5 - node WHEN node = 5 THEN 1 WHEN node > 6 THEN 1 END AS DOUBLE) AS length FROM cat")
def compute_brtime(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    ages = nodes.select("tree_id", "node", F.when(F.col("node") <= 5, 0).otherwise(10 - F.col("node")).cast("double").alias("age"))
    return E.lengths_from_ages(nodes, ages).select("tree_id", "node", "length")


# -- orders and coordinates -----------------------------------------------------------------------------------
HEAP = V.with_views("heap", "closure", tree="heap").rstrip()
HEAP_TIPS = HEAP + ", tips AS (SELECT node FROM heap WHERE node NOT IN (SELECT parent FROM heap WHERE parent IS NOT NULL))\n"


@query(V.with_views("heap") + "SELECT node, row_number() OVER (ORDER BY bin(node)) - 1 AS rank FROM heap QUALIFY node <> 1")
def cladewise(spark, sf_dir):
    return E.edge_ranks(V.heap_tree(spark, sf_dir)).drop("tree_id")


@query(
    V.with_views("heap").rstrip()
    + """, pre AS (SELECT node, row_number() OVER (ORDER BY bin(node)) AS k FROM heap)
SELECT h.node, count(*) OVER () - row_number() OVER (ORDER BY p.k, h.node DESC) + 1 AS rank FROM heap h JOIN pre p ON p.node = h.parent"""
)
def postorder(spark, sf_dir):
    return E.edge_ranks(V.heap_tree(spark, sf_dir), "postorder").drop("tree_id")


WALK = """, walk AS (SELECT node, '' AS path FROM heap WHERE parent IS NULL UNION ALL SELECT p.node, w.path || p.pos FROM walk w JOIN pos p ON p.parent = w.node)
SELECT node, row_number() OVER (ORDER BY path) - 1 AS rank FROM walk QUALIFY node <> 1"""


@query(
    HEAP_TIPS.rstrip()
    + """, below AS (SELECT c.ancestor AS node, count(*) AS n FROM closure c JOIN tips USING (node) GROUP BY c.ancestor),
pos AS (SELECT h.node, h.parent, row_number() OVER (PARTITION BY h.parent ORDER BY n DESC, h.node) AS pos FROM heap h JOIN below ON below.node = h.node WHERE h.parent IS NOT NULL)"""
    + WALK
)
def ladderize(spark, sf_dir):
    return E.edge_ranks(V.heap_tree(spark, sf_dir), siblings="ladderize", right=False).drop("tree_id")


@query(V.with_views("heap").rstrip() + ", pos AS (SELECT node, parent, CASE WHEN parent = 5 THEN 1 - node % 2 ELSE node % 2 END AS pos FROM heap WHERE parent IS NOT NULL)" + WALK)
def rotate(spark, sf_dir):
    return E.edge_ranks(V.heap_tree(spark, sf_dir), siblings="rotate", node=5).drop("tree_id")


@query(
    CAT.rstrip()
    + """, reach AS (SELECT tree_id, node, node AS anc FROM cat UNION ALL SELECT r.tree_id, r.node, c.parent FROM reach r JOIN cat c ON c.tree_id = r.tree_id AND c.node = r.anc WHERE c.parent IS NOT NULL),
firsts_of AS (SELECT r.tree_id, r.anc AS node, max(c.label) AS f FROM reach r JOIN cat c ON c.tree_id = r.tree_id AND c.node = r.node AND c.label IS NOT NULL GROUP BY r.tree_id, r.anc),
pos AS (SELECT c.tree_id, c.node, c.parent, row_number() OVER (PARTITION BY c.tree_id, c.parent ORDER BY f DESC) AS pos FROM cat c JOIN firsts_of USING (tree_id, node) WHERE c.parent IS NOT NULL),
walk AS (SELECT tree_id, node, '' AS path FROM cat WHERE parent IS NULL UNION ALL SELECT w.tree_id, p.node, w.path || p.pos FROM walk w JOIN pos p ON p.tree_id = w.tree_id AND p.parent = w.node)
SELECT tree_id, node, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS rank FROM walk QUALIFY node <> 6"""
)
def rotate_constr(spark, sf_dir):
    kinds = sorted((r[0] for r in V.read(spark, sf_dir, "events").select("event_type").distinct().collect()), reverse=True)
    return E.edge_ranks(cat(spark, sf_dir), siblings="constraint", constraint=kinds)


@query(
    HEAP_TIPS.rstrip()
    + """, y AS (SELECT node, row_number() OVER (ORDER BY bin(node)) AS y FROM tips)
SELECT c.ancestor AS node, round(sum(y * pow(0.5, hops)), 6) AS height FROM closure c JOIN y USING (node) GROUP BY c.ancestor"""
)
def node_height(spark, sf_dir):
    return E.node_heights(V.heap_tree(spark, sf_dir)).select("node", F.round("height", 6).alias("height"))


CAT_REACH = CAT.rstrip() + """, reach AS (SELECT tree_id, node, node AS anc, CAST(0 AS DOUBLE) AS dist FROM cat
  UNION ALL SELECT r.tree_id, r.node, c.parent, r.dist + c.length FROM reach r JOIN cat c ON c.tree_id = r.tree_id AND c.node = r.anc WHERE c.parent IS NOT NULL)\n"""


@query(CAT_REACH + "SELECT x.tree_id, x.node AS a, y.node AS b, round(min(x.dist + y.dist), 6) AS dist FROM reach x JOIN reach y ON x.tree_id = y.tree_id AND x.anc = y.anc AND x.node <= y.node GROUP BY ALL")
def dist_nodes(spark, sf_dir):
    return E.node_distances(cat(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


# -- sets of trees --------------------------------------------------------------------------------------------
@query(CAT + "SELECT tree_id * 2 + k AS tree_id, count(*) AS nodes, round(sum(length) * (k + 1), 6) AS total FROM cat, (SELECT unnest([0, 1]) AS k) GROUP BY tree_id, k")
def concat_trees(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    both = E.concat_trees(nodes, nodes.withColumn("length", F.col("length") * 2))
    return both.groupBy("tree_id").agg(F.count("*").alias("nodes"), F.round(F.sum("length"), 6).alias("total"))


def _rooted(nodes):
    return nodes.select("tree_id", "node", F.coalesce("parent", F.lit(0)).alias("parent"), "length", "label")


@query(CAT + "SELECT tree_id, node, coalesce(parent, 0) AS parent, length, label FROM cat WHERE tree_id % 2 = 0")
def get_trees(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    return _rooted(E.get_trees(nodes, nodes.where("tree_id % 2 = 0").select("tree_id").distinct()))


@query(CAT + "SELECT tree_id, node, coalesce(parent, 0) AS parent, CASE WHEN tree_id % 2 = 0 THEN length * 2 ELSE length END AS length, label FROM cat UNION ALL SELECT -tree_id, node, coalesce(parent, 0), length * 2, label FROM cat WHERE tree_id % 2 = 1")
def assign_trees(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    values = nodes.withColumn("tree_id", F.when(F.col("tree_id") % 2 == 0, F.col("tree_id")).otherwise(-F.col("tree_id"))).withColumn("length", F.col("length") * 2)
    return _rooted(E.assign_trees(nodes, values))


@query(CAT + "SELECT tree_id, node, dense_rank() OVER (ORDER BY label) AS tip_id FROM cat WHERE label IS NOT NULL")
def compress_tip_label(spark, sf_dir):
    return E.compress_labels(cat(spark, sf_dir))[1].where("tip_id is not null").select("tree_id", "node", "tip_id")


@query(CAT + "SELECT tree_id, node, coalesce(parent, 0) AS parent, length, label FROM cat")
def uncompress_tip_label(spark, sf_dir):
    return _rooted(E.uncompress_labels(*E.compress_labels(cat(spark, sf_dir))))


SIDES = V.with_views("weeks").rstrip() + f", sides AS (SELECT tree_id, list_sort(types[j : 5]) AS c, list_sort(types) AS w FROM weeks, {INNER4})\n"
OTHER = "list_filter(w, lambda x: NOT list_contains(c, x))"


def _sides(spark, sf_dir):
    weeks = V.week_orders(spark, sf_dir).select("tree_id", "types", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j"))
    return weeks.select("tree_id", F.array_sort(F.slice("types", F.col("j"), 6 - F.col("j"))).alias("c"), F.array_sort("types").alias("w"))


@query(SIDES + f"SELECT array_to_string(s, ',') AS side, count(*) AS n FROM (SELECT CASE WHEN list_contains(c, w[1]) THEN c ELSE {OTHER} END AS s FROM sides) GROUP BY s")
def one_wise(spark, sf_dir):
    return _sides(spark, sf_dir).groupBy(F.concat_ws(",", E.one_wise("c", "w")).alias("side")).agg(F.count("*").alias("n"))


@query(SIDES + f"SELECT array_to_string(s, ',') AS side, count(*) AS n FROM (SELECT CASE WHEN 2 * len(c) < len(w) THEN c ELSE {OTHER} END AS s FROM sides) GROUP BY s")
def short_wise(spark, sf_dir):
    return _sides(spark, sf_dir).groupBy(F.concat_ws(",", E.short_wise("c", "w")).alias("side")).agg(F.count("*").alias("n"))


@query(PLACED + "SELECT tree_id, p >= 2 AS is_monophyletic FROM base")
def is_monophyletic(spark, sf_dir):
    kinds = [r[0] for r in V.read(spark, sf_dir, "events").select("event_type").distinct().collect()]
    nodes = cat(spark, sf_dir)
    others = [x for x in kinds if x != min(kinds)]
    return T.is_monophyletic(nodes, others).withColumn("is_monophyletic", ~F.col("is_monophyletic"))


@query(PLACED + "SELECT tree_id, CAST(CASE WHEN p = 1 THEN 7 ELSE 6 END AS BIGINT) AS node FROM base")
def get_mrca(spark, sf_dir):
    kinds = [r[0] for r in V.read(spark, sf_dir, "events").select("event_type").distinct().collect()]
    return T.mrca_of(cat(spark, sf_dir), [x for x in kinds if x != min(kinds)])


# -- readers and writers: what is written is read back ------------------------------------------------------------
@query(CAT + "SELECT tree_id, '(' || label || ':1,(' || l2 || ':2,(' || l3 || ':3,(' || l4 || ':4,' || l5 || ':5):1):1):1);' AS newick FROM (SELECT tree_id, types[1] AS label, types[2] AS l2, types[3] AS l3, types[4] AS l4, types[5] AS l5 FROM weeks)")
def write_tree(spark, sf_dir):
    return W.to_newick(cat(spark, sf_dir))


@query(edited_sql("SELECT * FROM cat"))
def read_tree(spark, sf_dir):
    return clades(R.parse_trees(W.to_newick(cat(spark, sf_dir))).drop("name"))


@query(edited_sql("SELECT * FROM cat"))
def read_nexus(spark, sf_dir):
    texts = W.to_nexus(cat(spark, sf_dir)).select(F.col("tree_id").cast("string").alias("file"), "value")
    return clades(R.nexus_trees(texts).withColumn("tree_id", F.col("file").cast("long")).select("tree_id", "node", "parent", "length", "label"))


@query(V.with_views("weeks") + "SELECT tree_id, CAST(5 AS BIGINT) AS tips, CAST(9 AS BIGINT) AS clades, 18.0::DOUBLE AS total FROM weeks")
def write_phyloxml(spark, sf_dir):
    texts = W.to_phyloxml(cat(spark, sf_dir))
    found = F.regexp_extract_all("value", F.lit("<branch_length>([^<]*)</branch_length>"), F.lit(1))
    return texts.select("tree_id", F.size(F.regexp_extract_all("value", F.lit("<clade>[^/]*<name>"), F.lit(0))).cast("long").alias("tips"), F.size(F.regexp_extract_all("value", F.lit("<clade>"), F.lit(0))).cast("long").alias("clades"), F.aggregate(found, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


CALENDAR = V.with_views("calendar")
SEQS = CALENDAR.rstrip() + ", seqs AS (SELECT CAST(label AS VARCHAR) AS label, string_agg(base, '' ORDER BY pos) AS seq FROM sites GROUP BY label)\n"


def calendar(spark, sf_dir):
    return V.calendar_alignment(spark, sf_dir).withColumn("label", F.col("label").cast("string"))


def _through(form):
    def f(spark, sf_dir):
        texts = W.alignment_documents(calendar(spark, sf_dir).withColumn("alignment", F.lit("all")), form)
        return R.sequences_of(texts, form).drop("file")

    return f


def _round_trip(name, form):
    f = _through(form)
    f.__name__ = name
    query(SEQS + "SELECT label, seq FROM seqs")(f)


for _name, _form in (("read_dna_interleaved", "phylip"), ("read_dna_sequential", "phylip_sequential"), ("read_nexus_data", "nexus")):
    _round_trip(_name, _form)


@query(SEQS + "SELECT '>' || label || chr(10) || substr(seq, 1, 60) || CASE WHEN length(seq) > 60 THEN chr(10) || substr(seq, 61, 60) ELSE '' END AS value FROM seqs")
def write_fasta(spark, sf_dir):
    return W.fasta_lines(calendar(spark, sf_dir).withColumn("seq", F.substring("seq", 1, 120)), 60)


# -- trees from distances: additive distances give back their tree -----------------------------------------------
def _additive(spark, sf_dir):
    pairs = E.node_distances(cat(spark, sf_dir)).where("a < b and b <= 5")
    label = cat(spark, sf_dir).where("label is not null").select("tree_id", "node", "label")
    named = pairs.join(label.toDF("tree_id", "a", "i"), ["tree_id", "a"]).join(label.toDF("tree_id", "b", "j"), ["tree_id", "b"])
    return named.select(F.col("tree_id").alias("matrix_id"), "i", "j", F.col("dist").alias("d"))


def _inferred(method):
    def f(spark, sf_dir):
        trees = I.trees_from_distances(_additive(spark, sf_dir), method)
        return clades(E.root(R.parse_trees(trees, key="matrix_id").drop("name"), [first_label(spark, sf_dir)]))

    f.__name__ = f"{method}_additive"
    query(ROOTED)(f)


for _name in ("nj", "bionj", "mvr", "njs", "bionjs", "mvrs", "fastme_bal", "fastme_ols", "triangle", "triangles"):
    _inferred(_name)


# -- traits ---------------------------------------------------------------------------------------------------
NAMED = CAT_REACH.rstrip() + """, tip AS (SELECT r.tree_id, c.label, r.anc, r.dist FROM reach r JOIN cat c ON c.tree_id = r.tree_id AND c.node = r.node WHERE c.label IS NOT NULL),
depth AS (SELECT tree_id, node, max(dist) AS depth FROM reach GROUP BY tree_id, node),
met AS (SELECT x.tree_id, x.label AS a, y.label AS b, min(x.dist + y.dist) AS d, max(p.depth) AS shared, max(CASE WHEN x.anc >= 6 THEN (x.anc - 6) / 4.0 ELSE 1.0 END) AS grafen FROM tip x JOIN tip y ON x.tree_id = y.tree_id AND x.anc = y.anc AND x.label <= y.label
  JOIN depth p ON p.tree_id = x.tree_id AND p.node = x.anc GROUP BY x.tree_id, x.label, y.label)\n"""


def _covariance(name, v, **options):
    def f(spark, sf_dir):
        return K.covariances(cat(spark, sf_dir), name, **options).withColumn("v", F.round("v", 6))

    f.__name__ = f"cor_{name}" + ("_scaled" if options.get("corr") else "")
    own = ", own AS (SELECT tree_id, a, shared AS s FROM met WHERE a = b)\nSELECT met.tree_id, met.a, met.b, round(" + v + ", 6) AS v FROM met JOIN own x ON x.tree_id = met.tree_id AND x.a = met.a JOIN own y ON y.tree_id = met.tree_id AND y.a = met.b"
    query(NAMED.rstrip() + own)(f)


_covariance("brownian", "shared")
_covariance("brownian", "shared / sqrt(x.s * y.s)", corr=True)
_covariance("martins", "exp(-0.3 * d)", value=0.3)
_covariance("pagel", "CASE WHEN met.a = met.b THEN shared ELSE 0.4 * shared END", value=0.4)
_covariance("grafen", "grafen", value=1.0)
_covariance("blomberg", "pow(shared, 1 / 1.5)", value=1.5)

_FOLD = "SELECT w.tree_id, " + ", ".join(f"CAST(length(types[{i}]) AS DOUBLE) AS x{i}" for i in range(1, 6)) + " FROM weeks w"
PIC = (
    CAT.rstrip()
    + f""", x AS ({_FOLD}), n4 AS (SELECT *, (x4 - x5) / sqrt(9) AS c4, 9.0 AS v4, (x4 * 5 + x5 * 4) / 9 AS y4, 1 + 20.0 / 9 AS e4 FROM x),
n3 AS (SELECT *, (x3 - y4) / sqrt(3 + e4) AS c3, 3 + e4 AS v3, (x3 * e4 + y4 * 3) / (3 + e4) AS y3, 1 + 3 * e4 / (3 + e4) AS e3 FROM n4),
n2 AS (SELECT *, (x2 - y3) / sqrt(2 + e3) AS c2, 2 + e3 AS v2, (x2 * e3 + y3 * 2) / (2 + e3) AS y2, 1 + 2 * e3 / (2 + e3) AS e2 FROM n3),
n1 AS (SELECT *, (x1 - y2) / sqrt(1 + e2) AS c1, 1 + e2 AS v1, (x1 * e2 + y2) / (1 + e2) AS y1 FROM n2)\n"""
)


def _traits(spark, sf_dir):
    return V.read(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.length("event_type").cast("double").alias("x")).distinct()


@query(PIC + " UNION ALL ".join(f"SELECT tree_id, CAST({5 + j} AS BIGINT) AS node, round(c{j}, 6) AS contrast, round(v{j}, 6) AS variance, round(y{j}, 6) AS value FROM n1" for j in range(1, 5)))
def pic(spark, sf_dir):
    out = K.pic(cat(spark, sf_dir), _traits(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("contrast", "variance", "value")})


@query(PIC + " UNION ALL ".join(f"SELECT tree_id, CAST({5 + j} AS BIGINT) AS node, round(y{j}, 6) AS value, round((c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4) / 4, 6) AS rate FROM n1" for j in range(1, 5)))
def ace_pic(spark, sf_dir):
    out = K.ancestral_values(cat(spark, sf_dir), _traits(spark, sf_dir), "PIC")
    return out.select("tree_id", "node", F.round("value", 6).alias("value"), F.round("rate", 6).alias("rate"))


# the root's joint estimate under Brownian motion is its value by contrasts, and their mean square is the REML rate
@query(PIC + "SELECT tree_id, round(y1, 6) AS value, round((c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4) / 4, 6) AS rate FROM n1")
def ace_reml(spark, sf_dir):
    out = K.ancestral_values(cat(spark, sf_dir), _traits(spark, sf_dir), "REML").where("node = 6")
    return out.select("tree_id", F.round("value", 6).alias("value"), F.round("rate", 6).alias("rate"))


@query(PIC + "SELECT tree_id, round(y1, 6) AS value, round((c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4) / 5, 6) AS rate FROM n1")
def ace_ml(spark, sf_dir):
    out = K.ancestral_values(cat(spark, sf_dir), _traits(spark, sf_dir), "ML").where("node = 6")
    return out.select("tree_id", F.round("value", 6).alias("value"), F.round("rate", 6).alias("rate"))


# -- simulated trees: shapes are fixed, the rest is random ----------------------------------------------------------
def _simulated(kind, ultrametric):
    def f(spark, sf_dir):
        nodes = M.random_trees(spark, 40, 12, kind)
        if kind == "rtopology":
            nodes = nodes.withColumn("length", F.lit(1.0))
        shape = T.tree_summary(nodes).select("tree_id", "n_tip", "n_edge").join(T.predicates(nodes), "tree_id")
        return shape.select("tree_id", "n_tip", "is_binary", *(["is_ultrametric"] if ultrametric else []))

    f.__name__ = f"simulate_{kind}"
    query("SELECT CAST(i AS BIGINT) AS tree_id, CAST(12 AS BIGINT) AS n_tip, true AS is_binary" + (", true AS is_ultrametric" if ultrametric else "") + " FROM range(40) t(i)")(f)


for _name, _flag in (("rtree", False), ("rtopology", False), ("rcoal", True)):
    _simulated(_name, _flag)


# -- forms of sequences -----------------------------------------------------------------------------------------
CODES = "CASE base " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in Q.BASE_CODES.items()) + " ELSE 0 END"


@query(CALENDAR + f"SELECT CAST(label AS VARCHAR) AS label, string_agg(CAST({CODES} AS VARCHAR), ' ' ORDER BY pos) AS codes FROM sites GROUP BY label")
def as_dnabin(spark, sf_dir):
    return Q.to_codes(calendar(spark, sf_dir)).select("label", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


@query(V.with_views("gapped") + "SELECT label, md5(seq) AS digest FROM gapped")
def as_character(spark, sf_dir):
    return Q.from_codes(Q.to_codes(V.gapped(spark, sf_dir))).select("label", F.md5("seq").alias("digest"))


@query(CALENDAR + "SELECT CAST(label AS VARCHAR) AS label, CAST(pos AS BIGINT) AS pos, base AS letter FROM sites")
def as_alignment(spark, sf_dir):
    return Q.to_sites(calendar(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(SEQS + "SELECT label, seq FROM seqs")
def as_list(spark, sf_dir):
    return Q.to_rows(Q.to_sites(calendar(spark, sf_dir)))


@query(SEQS + "SELECT label, seq FROM seqs")
def as_matrix(spark, sf_dir):
    return Q.to_matrix(calendar(spark, sf_dir))


@query(SEQS + "SELECT label, seq FROM seqs UNION ALL SELECT label || '2', reverse(seq) FROM seqs")
def rbind(spark, sf_dir):
    seqs = calendar(spark, sf_dir)
    return Q.stack(seqs, seqs.select(F.concat("label", F.lit("2")).alias("label"), F.reverse("seq").alias("seq")))


@query(SEQS + "SELECT label, seq || CASE WHEN CAST(label AS BIGINT) % 3 = 0 THEN repeat('-', length(seq)) ELSE reverse(seq) END AS seq FROM seqs")
def cbind(spark, sf_dir):
    seqs = calendar(spark, sf_dir)
    return S.bind_columns(seqs, seqs.where("cast(label as long) % 3 <> 0").withColumn("seq", F.reverse("seq")), fill_with_gaps=True)


@query(V.with_views("nucleotides") + "SELECT label * 2 + k AS label, length(seq) * (1 + k) AS n FROM nucleotides, (SELECT unnest([0, 1]) AS k)")
def concat_sequences(spark, sf_dir):
    seqs = V.nucleotides(spark, sf_dir)
    both = Q.stack(seqs.withColumn("label", F.col("label") * 2), seqs.select((F.col("label") * 2 + 1).alias("label"), F.concat("seq", "seq").alias("seq")), aligned=False)
    return both.select("label", F.length("seq").cast("long").alias("n"))


@query(V.with_views("nucleotides") + "SELECT label FROM nucleotides")
def sequence_labels(spark, sf_dir):
    return V.nucleotides(spark, sf_dir).select("label")


@query(
    V.with_views("nucleotides").rstrip()
    + ", c AS (SELECT count(*) AS n, min(length(seq)) AS shortest, max(length(seq)) AS longest, avg(length(seq)) AS mean_length, "
    + ", ".join(f"sum(length(seq) - length(replace(seq, '{b}', ''))) AS {b}" for b in "acgt")
    + " FROM nucleotides)\nSELECT n, shortest, longest, round(mean_length, 6) AS mean_length, "
    + ", ".join(f"round({b} / (a + c + g + t), 6) AS {b}" for b in "acgt")
    + " FROM c"
)
def describe_sequences(spark, sf_dir):
    out = Q.describe(V.nucleotides(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_length", *"acgt")})


@query("SELECT doc_id AS label, md5(regexp_replace(upper(regexp_replace(lower(text), '[^a-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g')) AS digest FROM documents")
def as_aabin(spark, sf_dir):
    docs = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("seq"))
    return Q.to_amino_acids(docs).select("label", F.md5("seq").alias("digest"))


@query(SEQS + "SELECT label, substr(seq, 5, 20) AS seq FROM seqs")
def subset_sites(spark, sf_dir):
    return S.subset(calendar(spark, sf_dir), 5, 20)
