"""Registered queries on labels, numbers and shapes of topologies, networks, comparisons, times over sets of trees, and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sylva.catalog_edits import CALENDAR, CAT, INNER4, PLACED, SEQS, TIPS5, calendar, cat, clades, edited_sql
from sylva.operators import clades as C
from sylva.operators import comparative as K
from sylva.operators import dating as A
from sylva.operators import distances as D
from sylva.operators import edits as E
from sylva.operators import inference as I
from sylva.operators import labels as L
from sylva.operators import reports as O
from sylva.operators import seq_types as Q
from sylva.operators import sequences as S
from sylva.operators import spatial as P
from sylva.operators import time_tables as TT
from sylva.operators import topology_counts as N
from sylva.operators import tree_tables as T
from sylva.plans import views as V
from sylva.registry import query, shared_folder
from sylva.sources import readers as R
from sylva.sources import writers as W

# -- labels -----------------------------------------------------------------------------------------------
SPECIES = "species AS (SELECT p_partkey AS k, replace(upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)), ' ', '_') AS label FROM part)"


def species(spark, sf_dir):
    return V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace(F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.expr("substring(p_type, 2)"))), " ", "_").alias("label"))


@query(
    "WITH "
    + SPECIES
    + """, x AS (SELECT k, substr(label, 1, 9) AS x FROM species), n AS (SELECT k, x, CAST(count(*) OVER (PARTITION BY x) AS VARCHAR) AS n, CAST(row_number() OVER (PARTITION BY x ORDER BY k) AS VARCHAR) AS r FROM x)
SELECT k, CASE WHEN n <> '1' THEN substr(x, 1, 9 - length(n)) || lpad(r, CAST(length(n) AS INTEGER), '0') ELSE x END AS label FROM n"""
)
def make_label(spark, sf_dir):
    return L.make_label(species(spark, sf_dir), "label", [], length=9, order=["k"])


@query("SELECT p_partkey AS k, replace(p_name, ' ', '_') || '-' || replace(p_type, ' ', '_') || '-x-' AS label FROM part")
def check_label(spark, sf_dir):
    part = V.read(spark, sf_dir, "part")
    raw = F.concat(F.lit(" ("), "p_name", F.lit(":"), "p_type", F.lit(",x;) "))
    return part.select(F.col("p_partkey").alias("k"), L.clean_label(raw).alias("label"))


@query("WITH " + SPECIES + ", old AS (SELECT label, min(k) AS m FROM species GROUP BY label)\nSELECT s.k, CASE WHEN m % 2 = 0 THEN 'new' || m ELSE s.label END AS label FROM species s JOIN old ON old.label = s.label")
def update_label(spark, sf_dir):
    own = species(spark, sf_dir)
    mapping = own.groupBy("label").agg(F.min("k").alias("m")).where("m % 2 = 0").select(F.col("label").alias("old"), F.concat(F.lit("new"), "m").alias("new"))
    return L.update_label(own, "label", mapping).select("k", "label")


@query("WITH " + SPECIES + "\nSELECT k, nullif(split_part(label, '_', 1), '') AS genus, nullif(split_part(label, '_', 2), '') AS species, nullif(split_part(label, '_', 3), '') AS subspecies FROM species")
def label2table(spark, sf_dir):
    return species(spark, sf_dir).select("k", *L.label_table(F.col("label")))


@query("WITH " + SPECIES + "\nSELECT k, array_to_string(str_split(label, '_')[1:2], '_') AS no_sub, split_part(label, '_', 1) AS genus FROM species")
def strip_label(spark, sf_dir):
    return species(spark, sf_dir).select("k", L.strip_label(F.col("label")).alias("no_sub"), L.strip_label(F.col("label"), species=True).alias("genus"))


@query("WITH " + SPECIES + r"""
SELECT k, regexp_replace(label, '^([^a-z]*)[a-z]+_', '\1._') AS label FROM species""")
def abbreviate_genus(spark, sf_dir):
    return species(spark, sf_dir).select("k", L.abbreviate_genus(F.col("label")).alias("label"))


@query("SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'red' WHEN 'MACHINERY' THEN 'blue' ELSE 'grey' END AS colour, CASE WHEN c_mktsegment LIKE '%ING' THEN 'a' ELSE 'b' END AS kind FROM customer")
def assign_by_label(spark, sf_dir):
    label = F.col("c_mktsegment")
    return V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), L.assign(label, {"BUILDING": "red", "MACHINERY": "blue"}, "grey").alias("colour"), L.assign(label, {"ING$": "a"}, "b", pattern=True).alias("kind"))


@query(CAT + "SELECT tree_id, node, coalesce(label, 'Node' || (node - 5)) AS label FROM cat")
def make_node_label(spark, sf_dir):
    return L.node_labels(cat(spark, sf_dir)).select("tree_id", "node", "label")


@query(V.with_views("weeks") + f"SELECT tree_id, CAST(5 + j AS BIGINT) AS node, md5(array_to_string(list_sort(types[j : 5]), chr(10)) || chr(10)) AS label FROM weeks, {INNER4}")
def make_node_label_md5(spark, sf_dir):
    return L.node_labels(cat(spark, sf_dir), "md5").where("node > 5").select("tree_id", "node", "label")


# -- topologies ---------------------------------------------------------------------------------------------
@query(
    """SELECT CAST(n AS BIGINT) AS n, CAST(factorial(CAST(2 * n - 2 AS INTEGER)) / (pow(2, n - 1) * factorial(CAST(n - 1 AS INTEGER))) AS BIGINT) AS rooted, CAST(CASE WHEN n < 3 THEN 1 ELSE factorial(CAST(2 * n - 4 AS INTEGER)) / (pow(2, n - 2) * factorial(CAST(n - 2 AS INTEGER))) END AS BIGINT) AS unrooted,
CAST([1, 4, 26, 236, 2752, 39208, 660032, 12818912][n - 1] AS BIGINT) AS multifurcating, CAST([1, 1, 2, 3, 6, 11, 23, 46][n - 1] AS BIGINT) AS unlabelled FROM range(2, 10) t(n)"""
)
def howmanytrees(spark, sf_dir):
    rows = [(n, N.how_many_trees(n), N.how_many_trees(n, rooted=False), N.how_many_trees(n, binary=False), N.how_many_trees(n, labelled=False)) for n in range(2, 10)]
    return spark.createDataFrame(rows, "n long, rooted long, unrooted long, multifurcating long, unlabelled long")


NAMES = "(SELECT string_agg('t' || k, ',' ORDER BY 't' || k) FROM range({0}, {1} + 1) r(k))"


@query(
    f"""WITH c AS (SELECT 'star' AS kind, i AS a, i AS b FROM range(1, 9) t(i) UNION ALL SELECT 'star', 1, 8
UNION ALL SELECT 'balanced', (i - 1) * w + 1, i * w FROM (SELECT unnest([1, 2, 4, 8]) AS w), range(1, 9) t(i) WHERE i * w <= 8
UNION ALL SELECT 'left', i, i FROM range(1, 9) t(i) UNION ALL SELECT 'left', 1, i FROM range(2, 9) t(i) UNION ALL SELECT 'right', i, i FROM range(1, 9) t(i) UNION ALL SELECT 'right', i, 8 FROM range(1, 8) t(i))
SELECT kind, {NAMES.format("c.a", "c.b")} AS clade FROM c"""
)
def stree(spark, sf_dir):
    rows = [(k, *r) for k, kind in enumerate(("star", "balanced", "left", "right")) for r in R.tree_rows(N.regular_tree(8, kind))]
    nodes = spark.createDataFrame(rows, "tree_id long, node long, parent long, length double, label string")
    return clades(nodes).select(F.element_at(F.array(*map(F.lit, ("star", "balanced", "left", "right"))), F.col("tree_id").cast("int") + 1).alias("kind"), "clade")


@query(V.with_views("heap") + "SELECT min(node) AS a, max(node) AS b, parent FROM heap WHERE parent IS NOT NULL GROUP BY parent")
def as_matching(spark, sf_dir):
    return N.matching(V.heap_tree(spark, sf_dir)).drop("tree_id")


@query(V.with_views("heap") + "SELECT node, coalesce(parent, 0) AS parent FROM heap")
def as_phylo_matching(spark, sf_dir):
    return N.from_matching(N.matching(V.heap_tree(spark, sf_dir))).select("node", F.coalesce("parent", F.lit(0)).alias("parent"))


# -- networks -----------------------------------------------------------------------------------------------
def _network(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    links = nodes.select("tree_id").distinct().select("tree_id", F.lit(6).cast("long").alias("src"), F.lit(9).cast("long").alias("dst"))
    return nodes, links


EDGES = "SELECT tree_id, parent AS src, node AS dst, 'tree' AS kind FROM cat WHERE parent IS NOT NULL UNION ALL SELECT tree_id, 6, 9, 'reticulation' FROM weeks"


@query(CAT + EDGES)
def as_evonet(spark, sf_dir):
    return N.network_edges(*N.network(N.network_nodes(*_network(spark, sf_dir))))


@query(CAT + f"SELECT tree_id, n AS node, count(*) AS degree FROM (SELECT tree_id, src AS n FROM ({EDGES}) UNION ALL SELECT tree_id, dst FROM ({EDGES})) GROUP BY tree_id, n")
def degree_evonet(spark, sf_dir):
    return N.network_degree(*_network(spark, sf_dir))


@query(V.with_views("weeks") + "SELECT tree_id, '(' || types[1] || ':1,(' || types[2] || ':2,(' || types[3] || ':3,(' || types[4] || ':4,' || types[5] || ':5)#H9:1):1):1,#H9);' AS newick FROM weeks")
def write_evonet(spark, sf_dir):
    return W.to_newick(N.network_nodes(*_network(spark, sf_dir)))


@query(CAT + f"SELECT tree_id, kind, count(*) AS n FROM ({EDGES}) GROUP BY tree_id, kind")
def read_evonet(spark, sf_dir):
    nodes = R.parse_trees(W.to_newick(N.network_nodes(*_network(spark, sf_dir)))).drop("name")
    return N.network_edges(*N.network(nodes)).groupBy("tree_id", "kind").agg(F.count("*").alias("n"))


# -- sets of trees --------------------------------------------------------------------------------------------
@query(V.with_views("weeks") + "SELECT tree_id, CAST(t AS DOUBLE) AS time, CAST(n AS BIGINT) AS n FROM weeks, (VALUES (-8, 2), (-7, 2), (-6, 3), (-5, 3), (-3, 2), (-1, 1)) v(t, n)")
def mltt(spark, sf_dir):
    return TT.ltt(cat(spark, sf_dir))


@query(PLACED + "SELECT c.tree_id, node FROM cat c JOIN base USING (tree_id) WHERE node <> p AND node <> 6 AND NOT (p = 1 AND node = 7)")
def which_edge(spark, sf_dir):
    kinds = [r[0] for r in V.read(spark, sf_dir, "events").select("event_type").distinct().collect()]
    return T.which_edge(cat(spark, sf_dir), [x for x in kinds if x != min(kinds)])


@query(CAT + f"SELECT tree_id, round(regr_slope(d, x), 6) AS mu, round(regr_intercept(d, x), 6) AS intercept FROM (SELECT tree_id, i + least(i, 4) - 1 AS d, length(types[i]) AS x FROM weeks, {TIPS5}) GROUP BY tree_id")
def estimate_mu(spark, sf_dir):
    dates = V.read(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.length("event_type").alias("date")).distinct()
    return TT.estimate_rate(cat(spark, sf_dir), dates).select("tree_id", F.round("mu", 6).alias("mu"), F.round("intercept", 6).alias("intercept"))


CLADES_OF = V.with_views("weeks").rstrip() + f", c AS (SELECT tree_id, list_sort(types[j : 5]) AS clade FROM weeks, {INNER4}), ends AS (SELECT min(tree_id) AS a, max(tree_id) AS b FROM weeks)\n"


@query(CLADES_OF + "SELECT array_to_string(clade, ',') AS clade, bool_or(tree_id = a) AS in_x, bool_or(tree_id = b) AS in_y FROM c, ends WHERE tree_id IN (a, b) GROUP BY clade")
def compare_phylo(spark, sf_dir):
    table = C.clade_table(cat(spark, sf_dir))
    ends = table.agg(F.min("tree_id").alias("a"), F.max("tree_id").alias("b"))
    x, y = (table.join(F.broadcast(ends.select(F.col(k).alias("tree_id"))), "tree_id") for k in "ab")
    return C.compare_trees(x, y).withColumn("clade", F.concat_ws(",", "clade"))


SPLITS = (
    V.with_views("weeks").rstrip()
    + """, sides AS (SELECT tree_id, list_sort(types[j : 5]) AS c, list_sort(types) AS w FROM weeks, (SELECT unnest([3, 4]) AS j)),
s AS (SELECT DISTINCT tree_id, CASE WHEN list_contains(c, w[1]) THEN list_filter(w, lambda x: NOT list_contains(c, x)) ELSE c END AS split FROM sides)\n"""
)


@query(SPLITS + "SELECT array_to_string(split, ',') AS split, count(*) AS freq FROM s WHERE split IN (SELECT split FROM s WHERE tree_id = (SELECT min(tree_id) FROM s)) GROUP BY split")
def count_bipartitions(spark, sf_dir):
    splits = C.split_table(cat(spark, sf_dir))
    first = splits.agg(F.min("tree_id").alias("tree_id"))
    return C.count_splits(splits.join(F.broadcast(first), "tree_id"), splits).withColumn("split", F.concat_ws(",", "split"))


@query(SPLITS + "SELECT array_to_string(split, ',') AS split, count(*) AS freq FROM s GROUP BY split")
def as_prop_part(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    tips = nodes.where("label is not null")
    return C.splits_of(C.bitsplits(C.split_table(nodes), tips), tips).withColumn("split", F.concat_ws(",", "split"))


@query(
    V.with_views("weeks").rstrip()
    + """, places AS (SELECT tree_id, types[i] AS t, i AS k FROM weeks, (SELECT unnest([1, 2, 3, 4, 5]) AS i))
SELECT a.t AS i, b.t AS j, CAST(min(a.k + b.k + abs(least(a.k, 4) - least(b.k, 4))) AS DOUBLE) AS d FROM places a JOIN places b ON a.tree_id = b.tree_id AND a.t < b.t GROUP BY a.t, b.t"""
)
def species_tree(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    label = nodes.where("label is not null").select("tree_id", "node", "label")
    named = T.cophenetic(nodes).join(label.toDF("tree_id", "a", "x"), ["tree_id", "a"]).join(label.toDF("tree_id", "b", "y"), ["tree_id", "b"])
    return N.species_tree_distances(named.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.col("dist").alias("d"))).drop("matrix_id")


@query(CAT + "SELECT tree_id, node, CAST(10 - node AS DOUBLE) AS age FROM cat WHERE node > 5")
def chrono_mpl(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    return A.chrono_mpl(nodes.withColumn("length", F.when(F.col("node") < 6, 5 - F.least("node", F.lit(4))).otherwise(F.col("length")).cast("double"))).select("tree_id", "node", F.round("age", 6).alias("age"))


# -- sequences ------------------------------------------------------------------------------------------------
@query(CALENDAR + "SELECT CAST(label AS VARCHAR) AS label, CAST(pos AS BIGINT) AS pos, base AS base_a, 'c' AS base_b FROM sites WHERE pos % 9 = 0 AND base <> 'c'")
def compare_alignments(spark, sf_dir):
    seqs = calendar(spark, sf_dir)
    changed = seqs.withColumn("seq", F.array_join(F.transform(F.split("seq", ""), lambda c, i: F.when((i + 1) % 9 == 0, F.lit("c")).otherwise(c)), ""))
    return S.compare_alignments(seqs, changed).withColumn("pos", F.col("pos").cast("long"))


@query(
    CALENDAR.rstrip()
    + """, m AS (SELECT pos, min_by(base, {'a': -n, 'b': base}) AS mode FROM (SELECT pos, base, count(*) AS n FROM sites WHERE base IN ('a', 'c', 't') GROUP BY pos, base) GROUP BY pos)
SELECT CAST(s.label AS VARCHAR) AS label, string_agg(CASE WHEN base = 'g' THEN coalesce(mode, 'k') ELSE base END, '' ORDER BY s.pos) AS seq FROM sites s LEFT JOIN m ON m.pos = s.pos GROUP BY s.label"""
)
def solve_ambiguous_bases(spark, sf_dir):
    return S.solve_ambiguous(calendar(spark, sf_dir).withColumn("seq", F.translate("seq", "g", "k")))


@query(CALENDAR + "SELECT CAST(pos AS BIGINT) AS pos FROM sites GROUP BY pos HAVING count(DISTINCT base) > 1")
def aasubst(spark, sf_dir):
    return S.aa_polymorphic_sites(calendar(spark, sf_dir))


@query(CALENDAR + "SELECT CAST(a.label AS VARCHAR) AS i, CAST(b.label AS VARCHAR) AS j, count(*) FILTER (a.base <> b.base) AS d FROM sites a JOIN sites b ON a.pos = b.pos AND CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR) GROUP BY a.label, b.label")
def dist_aa(spark, sf_dir):
    return D.dist_aa(calendar(spark, sf_dir))


@query(CALENDAR.rstrip() + """, f AS (SELECT min(CAST(label AS VARCHAR)) AS f FROM sites), r AS (SELECT pos, base FROM sites, f WHERE CAST(label AS VARCHAR) = f)
SELECT CAST(s.label AS VARCHAR) AS label, string_agg(CASE WHEN CAST(s.label AS VARCHAR) <> f AND s.base = r.base THEN '.' ELSE s.base END, '' ORDER BY s.pos) AS seq FROM sites s JOIN r ON r.pos = s.pos, f GROUP BY s.label""")
def alview(spark, sf_dir):
    return S.alignment_view(calendar(spark, sf_dir))


@query("SELECT 'Ind_' || i AS label, CAST(40 AS BIGINT) AS n, true AS is_dna FROM range(1, 31) t(i)")
def random_dna(spark, sf_dir):
    return S.random_sequences(spark, 30, 40).select("label", F.length("seq").cast("long").alias("n"), F.col("seq").rlike("^[acgt]*$").alias("is_dna"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, n_regionkey AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT a.k AS i, b.k AS j, 1.0::DOUBLE AS w FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k"""
)
def weight_taxo(spark, sf_dir):
    s = V.read(spark, sf_dir, "supplier").join(F.broadcast(V.read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return P.weight_taxo(s, "s_suppkey", "n_regionkey")


# -- files ------------------------------------------------------------------------------------------------------
@query(SEQS + "SELECT label, seq FROM seqs")
def read_fasta(spark, sf_dir):
    path = shared_folder(spark)
    W.write_fasta(calendar(spark, sf_dir), path, width=50)
    return R.read_fasta(spark, path)


@query(SEQS + "SELECT label, seq, CAST(7 * length(seq) AS BIGINT) AS total FROM seqs")
def read_fastq(spark, sf_dir):
    path = shared_folder(spark)
    record = F.concat_ws("\n", F.concat(F.lit("@"), "label"), "seq", F.lit("+"), F.translate("seq", "acgt-", "((((("))
    calendar(spark, sf_dir).select(record.alias("value")).write.text(path)
    out = R.read_fastq(spark, path)
    return out.select("label", "seq", F.aggregate("qual", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT 'chr' || s_nationkey AS seqid, 'gene' AS type, CAST(s_suppkey * 10 AS INTEGER) AS start, CAST(s_suppkey * 10 + 5 AS INTEGER) AS \"end\", CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS score, 'ID=' || s_suppkey AS attributes FROM supplier")
def read_gff(spark, sf_dir):
    path = shared_folder(spark)
    score = F.when(F.col("s_suppkey") % 2 == 0, "0.5").otherwise(".")
    row = F.concat_ws("\t", F.concat(F.lit("chr"), "s_nationkey"), F.lit("."), F.lit("gene"), F.col("s_suppkey") * 10, F.col("s_suppkey") * 10 + 5, score, F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "s_suppkey"))
    V.read(spark, sf_dir, "supplier").select(row.alias("value")).write.text(path)
    return R.read_gff(spark, path).select("seqid", "type", "start", "end", "score", "attributes")


@query(edited_sql("SELECT * FROM cat").replace("SELECT r.tree_id, string_agg", "SELECT clade, length, count(*) AS n FROM (SELECT r.tree_id, string_agg").rstrip() + ") GROUP BY clade, length")
def read_tree_file(spark, sf_dir):
    path = shared_folder(spark)
    W.write_trees(cat(spark, sf_dir), path)
    return clades(R.read_newick(spark, path).drop("name")).groupBy("clade", "length").agg(F.count("*").alias("n"))


# -- fits, densities, layouts -------------------------------------------------------------------------------------
def _two_traits(spark, sf_dir):
    kinds = V.read(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    return kinds.select("label", F.length("label").cast("double").alias("y"), F.ascii("label").cast("double").alias("x"))


def _contrasts(name: str, value: str) -> str:
    """Contrasts of a trait over the caterpillars, from the cherry to the root."""
    x = ", ".join(f"CAST({value.format(f'types[{i}]')} AS DOUBLE) AS x{i}" for i in range(1, 6))
    return f""", {name}0 AS (SELECT tree_id, {x} FROM weeks), {name}4 AS (SELECT *, (x4 - x5) / 3 AS c4, (x4 * 5 + x5 * 4) / 9 AS y4, 1 + 20.0 / 9 AS e4 FROM {name}0),
{name}3 AS (SELECT *, (x3 - y4) / sqrt(3 + e4) AS c3, (x3 * e4 + y4 * 3) / (3 + e4) AS y3, 1 + 3 * e4 / (3 + e4) AS e3 FROM {name}4),
{name}2 AS (SELECT *, (x2 - y3) / sqrt(2 + e3) AS c2, (x2 * e3 + y3 * 2) / (2 + e3) AS y2, 1 + 2 * e3 / (2 + e3) AS e2 FROM {name}3),
{name}1 AS (SELECT *, (x1 - y2) / sqrt(1 + e2) AS c1, (x1 * e2 + y2) / (1 + e2) AS y1 FROM {name}2)"""


# a regression under Brownian motion has the slope of the contrasts' regression through the origin, and passes through the root's estimates
@query(
    V.with_views("weeks").rstrip()
    + _contrasts("p", "length({})")
    + _contrasts("q", "ascii({})")
    + """, f AS (SELECT p.tree_id, p.y1 AS py, q.y1 AS qy, (p.c1 * q.c1 + p.c2 * q.c2 + p.c3 * q.c3 + p.c4 * q.c4) / (q.c1 * q.c1 + q.c2 * q.c2 + q.c3 * q.c3 + q.c4 * q.c4) AS b,
  p.c1 * p.c1 + p.c2 * p.c2 + p.c3 * p.c3 + p.c4 * p.c4 AS pp, q.c1 * q.c1 + q.c2 * q.c2 + q.c3 * q.c3 + q.c4 * q.c4 AS qq FROM p1 p JOIN q1 q USING (tree_id))
SELECT tree_id, round(b, 6) AS slope, round(sqrt((pp - b * b * qq) / 3 / qq), 6) AS se, round(py - b * qy, 6) AS intercept, round((pp - b * b * qq) / 3, 6) AS variance FROM f"""
)
def gls_brownian(spark, sf_dir):
    fits = K.gls_fits(cat(spark, sf_dir), _two_traits(spark, sf_dir), ["x"])
    slope = fits.where("term = 'x'").select("tree_id", F.round("estimate", 6).alias("slope"), F.round("se", 6).alias("se"), F.round("variance", 6).alias("variance"))
    return slope.join(fits.where("term = 'intercept'").select("tree_id", F.round("estimate", 6).alias("intercept")), "tree_id")


@query("SELECT CAST(x AS BIGINT) AS x, round(exp(-0.6) * pow(1 - exp(-0.6), x - 1), 9) AS p FROM range(1, 40) t(x)")
def dyule(spark, sf_dir):
    return spark.range(1, 40).select(F.col("id").alias("x"), F.round(TT.yule_density(F.col("id"), 0.3, 2.0), 9).alias("p"))


@query(
    """WITH r AS (SELECT exp(0.4) AS e), c AS (SELECT 0.1 * (e - 1) / (0.3 * e - 0.1) AS a, 0.3 * (e - 1) / (0.3 * e - 0.1) AS b FROM r)
SELECT CAST(x AS BIGINT) AS x, round(CASE WHEN x = 0 THEN a ELSE (1 - a) * (1 - b) * pow(b, x - 1) END, 9) AS p, round(CASE WHEN x = 0 THEN 0 ELSE (1 - b) * pow(b, x - 1) END, 9) AS alive FROM c, range(0, 40) t(x)"""
)
def dbd(spark, sf_dir):
    x = F.col("id")
    return spark.range(40).select(x.alias("x"), F.round(TT.birth_death_density(x, 0.3, 0.1, 2.0), 9).alias("p"), F.round(TT.birth_death_density(x, 0.3, 0.1, 2.0, conditional=True), 9).alias("alive"))


@query(
    V.with_views("gaps").rstrip()
    + """, d AS (SELECT user_id, (k - lag(k) OVER o) * (w + lag(w) OVER o) / 2 AS a FROM gaps WINDOW o AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, round(coalesce(sum(a), 0), 3) AS integral FROM d GROUP BY user_id"""
)
def integrate_trapeze(spark, sf_dir):
    return TT.trapezoids(V.user_gaps(spark, sf_dir), "user_id", "k", "w").withColumn("integral", F.round("integral", 3))


DRAWN = V.with_views("heap", "closure", tree="heap").rstrip() + """, tips AS (SELECT node FROM heap WHERE node NOT IN (SELECT parent FROM heap WHERE parent IS NOT NULL)),
y AS (SELECT node, row_number() OVER (ORDER BY bin(node)) AS y FROM tips), h AS (SELECT c.ancestor AS node, sum(y * pow(0.5, hops)) AS y FROM closure c JOIN y USING (node) GROUP BY c.ancestor),
d AS (SELECT node, max(hops) AS level, max_by(dist, hops) AS x FROM closure GROUP BY node)\n"""


@query(DRAWN + "SELECT node, round(x, 6) AS x, round(y, 6) AS y FROM d JOIN h USING (node)")
def plot_phylo_coor(spark, sf_dir):
    return E.layout(V.heap_tree(spark, sf_dir)).select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(DRAWN + "SELECT node, CAST(level AS DOUBLE) AS x, round(y, 6) AS y FROM d JOIN h USING (node)")
def cladogram_layout(spark, sf_dir):
    return E.layout(V.heap_tree(spark, sf_dir), "cladogram").select("node", "x", F.round("y", 6).alias("y"))


@query(DRAWN + "SELECT node, round(x * cos(2 * pi() * (y - 1) / n), 6) AS x, round(x * sin(2 * pi() * (y - 1) / n), 6) AS y FROM d JOIN h USING (node), (SELECT count(*) AS n FROM tips)")
def circular_layout(spark, sf_dir):
    return E.layout(V.heap_tree(spark, sf_dir), "fan").select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT c_custkey AS k, round(sqrt(pow(c_acctbal / 1000, 2) + pow(c_nationkey - 12, 2)), 6) AS r, round(atan2(c_nationkey - 12, c_acctbal / 1000), 6) AS angle FROM customer")
def rect2polar(spark, sf_dir):
    out = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *E.to_polar(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double") - 12))
    return out.select("k", F.round("r", 6).alias("r"), F.round("angle", 6).alias("angle"))


@query("SELECT c_custkey AS k, round(c_acctbal / 1000 * cos(c_nationkey), 6) AS x, round(c_acctbal / 1000 * sin(c_nationkey), 6) AS y FROM customer")
def polar2rect(spark, sf_dir):
    out = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *E.to_cartesian(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")))
    return out.select("k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# -- clusterings, covariances and incomplete matrices ---------------------------------------------------------------
def level_cat(spark, sf_dir):
    """The caterpillars with all tips at the same depth."""
    return cat(spark, sf_dir).withColumn("length", F.when(F.col("node") < 6, 5 - F.least("node", F.lit(4))).otherwise(F.col("length")).cast("double"))


LEVEL = edited_sql("SELECT tree_id, node, parent, CASE WHEN node < 6 THEN CAST(5 - least(node, 4) AS DOUBLE) ELSE length END AS length, label FROM cat")


@query(V.with_views("weeks") + "SELECT tree_id, CAST(k AS INTEGER) AS k, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, 2.0::DOUBLE * k AS height FROM weeks, (VALUES (1, -5, -4), (2, -3, 1), (3, -2, 2), (4, -1, 3)) v(k, a, b)")
def as_hclust(spark, sf_dir):
    return N.merges(level_cat(spark, sf_dir))


@query(LEVEL)
def as_phylo_hclust(spark, sf_dir):
    nodes = level_cat(spark, sf_dir)
    labels = nodes.where("label is not null").select("tree_id", F.col("node").alias("tip"), "label")
    return clades(N.from_merges(N.merges(nodes), labels))


@query(edited_sql("SELECT * FROM cat"))
def vcv2phylo(spark, sf_dir):
    v = K.covariances(cat(spark, sf_dir)).withColumnRenamed("tree_id", "matrix_id")
    return clades(R.parse_trees(I.trees_from_covariances(v), key="matrix_id").drop("name"))


HOLED = """, placed AS (SELECT tree_id, types[i] AS t, i AS k FROM weeks, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
d AS (SELECT a.tree_id AS matrix_id, a.t AS i, b.t AS j, CAST({d} AS DOUBLE) AS d FROM placed a JOIN placed b ON a.tree_id = b.tree_id AND a.t <> b.t),
hole AS (SELECT min(event_type) AS lo, min(event_type) FILTER (event_type > (SELECT min(event_type) FROM events)) AS hi FROM events),
known AS (SELECT d.* FROM d, hole WHERE NOT (i = lo AND j = hi) AND NOT (i = hi AND j = lo))\n"""
SAME_LEVEL = HOLED.format(d="2 * (5 - least(a.k, b.k, 4))")
UNEVEN = HOLED.format(d="a.k + b.k + abs(least(a.k, 4) - least(b.k, 4))")


def _holed(nodes, spark, sf_dir):
    kinds = sorted(r[0] for r in V.read(spark, sf_dir, "events").select("event_type").distinct().collect())
    label = nodes.where("label is not null").select("tree_id", "node", "label")
    named = T.cophenetic(nodes).join(label.toDF("tree_id", "a", "x"), ["tree_id", "a"]).join(label.toDF("tree_id", "b", "y"), ["tree_id", "b"])
    d = named.select(F.col("tree_id").alias("matrix_id"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.col("dist").alias("d"))
    return d.where((F.col("i") != kinds[0]) | (F.col("j") != kinds[1]))


@query(V.with_views("weeks").rstrip() + SAME_LEVEL + "SELECT matrix_id, i, j, d FROM known WHERE i < j UNION ALL SELECT a.matrix_id, lo, hi, min(greatest(a.d, b.d)) FROM hole, known a JOIN known b ON a.matrix_id = b.matrix_id AND a.j = b.j WHERE a.i = lo AND b.i = hi GROUP BY a.matrix_id, lo, hi")
def ultrametric(spark, sf_dir):
    return I.filled_distances(_holed(level_cat(spark, sf_dir), spark, sf_dir), "ultrametric")


@query(
    V.with_views("weeks").rstrip()
    + UNEVEN
    + """SELECT matrix_id, i, j, d FROM known WHERE i < j
UNION ALL SELECT x.matrix_id, lo, hi, min(greatest(x.d + w.d, y.d + z.d) - k.d) FROM hole, known k JOIN known x ON x.matrix_id = k.matrix_id AND x.j = k.i JOIN known y ON y.matrix_id = k.matrix_id AND y.j = k.j
JOIN known z ON z.matrix_id = k.matrix_id AND z.j = k.i JOIN known w ON w.matrix_id = k.matrix_id AND w.j = k.j WHERE x.i = lo AND y.i = lo AND z.i = hi AND w.i = hi GROUP BY x.matrix_id, lo, hi"""
)
def additive(spark, sf_dir):
    return I.filled_distances(_holed(cat(spark, sf_dir), spark, sf_dir), "additive")


@query(
    CALENDAR.rstrip()
    + """, s AS (SELECT label, pos, CASE WHEN base = '-' AND pos % 3 > 0 THEN 'a' ELSE base END AS base FROM sites), full_sites AS (SELECT pos FROM s GROUP BY pos HAVING count(*) FILTER (base = '-') = 0)
SELECT a.label AS i, b.label AS j, round(avg(CASE WHEN a.base <> b.base THEN 1.0 ELSE 0.0 END), 6) AS d FROM s a JOIN s b ON a.pos = b.pos AND a.label < b.label WHERE a.pos IN (SELECT pos FROM full_sites) GROUP BY a.label, b.label"""
)
def dist_global_deletion(spark, sf_dir):
    seqs = V.calendar_alignment(spark, sf_dir)
    partly = F.array_join(F.transform(F.split("seq", ""), lambda c, i: F.when((c == "-") & ((i + 1) % 3 > 0), F.lit("a")).otherwise(c)), "")
    return D.dist_dna(seqs.withColumn("seq", partly), "raw", digits=6)


# -- reports and small forms --------------------------------------------------------------------------------------
@query(V.with_views("weeks") + "SELECT tree_id, 'tree with 5 tips and 4 inner nodes; tips: ' || array_to_string(types[1:3], ', ') || ', ...; rooted; with branch lengths' AS report FROM weeks")
def print_phylo(spark, sf_dir):
    return O.tree_report(cat(spark, sf_dir), shown=3)


@query(V.with_views("weeks") + "SELECT count(*) AS n_trees, CAST(5 AS BIGINT) AS min_tips, CAST(5 AS BIGINT) AS max_tips, CAST(5 AS BIGINT) AS n_labels FROM weeks")
def print_multiphylo(spark, sf_dir):
    return O.set_report(cat(spark, sf_dir))


CENSUS = CLADES_OF.rstrip() + ", census AS (SELECT array_to_string(clade, ',') AS clade, count(*) AS number FROM c GROUP BY clade), total AS (SELECT count(*) AS n FROM weeks)\n"


@query(CENSUS + "SELECT row_number() OVER (ORDER BY number DESC, clade) AS place, number, round(number / n, 6) AS share, '{' || clade || '} in ' || number || ' of ' || n || ' trees' AS text FROM census, total")
def print_prop_part(spark, sf_dir):
    table = C.clade_table(cat(spark, sf_dir))
    n = table.select("tree_id").distinct().count()
    return O.clade_report(C.prop_part(table), n).withColumn("share", F.round("share", 6))


@query(SPLITS.rstrip() + ", f AS (SELECT array_to_string(split, ',') AS split, count(*) AS freq FROM s GROUP BY split)\nSELECT split, freq, row_number() OVER (ORDER BY freq DESC, split) AS place FROM f")
def sort_bitsplits(spark, sf_dir):
    nodes = cat(spark, sf_dir)
    tips = nodes.where("label is not null")
    own = C.splits_of(C.bitsplits(C.split_table(nodes), tips), tips).select(F.concat_ws(",", "split").alias("split"), "freq")
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("freq"), "split")).cast("long"))


@query(CLADES_OF.rstrip() + ", m AS (SELECT clade, bool_or(tree_id = a) AS x, bool_or(tree_id = b) AS y FROM c, ends WHERE tree_id IN (a, b) GROUP BY clade)\nSELECT count(*) FILTER (x AND y) AS shared, count(*) FILTER (NOT y) AS first_only, count(*) FILTER (NOT x) AS second_only, bool_and(x AND y) AS same FROM m")
def print_compare_phylo(spark, sf_dir):
    table = C.clade_table(cat(spark, sf_dir))
    ends = table.agg(F.min("tree_id").alias("a"), F.max("tree_id").alias("b"))
    x, y = (table.join(F.broadcast(ends.select(F.col(k).alias("tree_id"))), "tree_id") for k in "ab")
    return O.comparison_report(C.compare_trees(x, y))


@query(CAT + "SELECT tree_id, CASE WHEN node > 5 THEN 5 - node ELSE node END AS node, coalesce(5 - parent, 0) AS parent FROM cat")
def new2old_phylo(spark, sf_dir):
    return O.signed_ids(cat(spark, sf_dir)).select("tree_id", "node", F.coalesce("parent", F.lit(0)).alias("parent"))


@query(CAT + "SELECT tree_id, node, coalesce(parent, 0) AS parent, coalesce(label, '') AS label FROM cat")
def old2new_phylo(spark, sf_dir):
    return O.unsigned_ids(O.signed_ids(cat(spark, sf_dir))).select("tree_id", "node", F.coalesce("parent", F.lit(0)).alias("parent"), F.coalesce("label", F.lit("")).alias("label"))


@query(V.with_views("weeks") + "SELECT tree_id, CAST(6 AS BIGINT) AS node, 2.0::DOUBLE AS age_min, 3.0::DOUBLE AS age_max, true AS soft_bounds FROM weeks")
def make_chronos_calib(spark, sf_dir):
    return O.calibrations(cat(spark, sf_dir), age_min=2.0, age_max=3.0, soft=True)


@query(CAT + "SELECT tree_id, node, CAST(CASE WHEN node <= 4 THEN 2 * node - 1 WHEN node = 5 THEN 8 ELSE 2 * (node - 6) END AS BIGINT) AS rank FROM cat WHERE node <> 6")
def reorder_evonet(spark, sf_dir):
    nodes, _ = N.network(N.network_nodes(*_network(spark, sf_dir)))
    return E.edge_ranks(nodes)


NEXUS_CODES = "CASE base " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in Q.BASE_CODES.items()) + " ELSE 0 END"


@query(CALENDAR + f"SELECT CAST(label AS VARCHAR) AS label, string_agg(CAST({NEXUS_CODES} AS VARCHAR), ' ' ORDER BY pos) AS codes FROM sites GROUP BY label")
def nexus2dnabin(spark, sf_dir):
    texts = W.alignment_documents(calendar(spark, sf_dir).withColumn("alignment", F.lit("all")), "nexus")
    return Q.to_codes(R.sequences_of(texts, "nexus").drop("file")).select("label", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


@query(SEQS + "SELECT 'fasta' AS kind, CAST(1 AS BIGINT) AS folders, CAST(sum(length(label) + length(seq) + 3) AS BIGINT) AS bytes FROM seqs")
def bydir(spark, sf_dir):
    path = shared_folder(spark)
    W.write_fasta(calendar(spark, sf_dir), path + "/whole")
    found = O.files_by_folder(R.find_files(spark, path, extra={"fasta": "txt"}))
    return found.groupBy("kind").agg(F.countDistinct("folder").alias("folders"), F.sum("bytes").alias("bytes"))
