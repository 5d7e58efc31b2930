"""Lineages through time, coalescent intervals, skylines and closed-form diversification statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.tree_tables import branching_times, root_paths, with_children


def ltt(nodes: DataFrame, reach: DataFrame | None = None, tol: float = 1e-6) -> DataFrame:
    """(tree_id, time, n): lineages after each event, time counted back from the present (negative).

    Each split adds its children less one; in trees with tips before the present those end a lineage.
    """
    own = with_children(nodes).join(root_paths(nodes, reach), ["tree_id", "node"])
    own = own.withColumn("time", F.col("depth") - F.max("depth").over(Window.partitionBy("tree_id")))
    events = own.where("not is_tip").select("tree_id", "time", (F.col("n_children") - 1).alias("delta")).unionByName(own.where(F.col("is_tip") & (F.col("time") < -tol)).select("tree_id", "time", F.lit(-1).cast("long").alias("delta")))
    sums = events.groupBy("tree_id", "time").agg(F.sum("delta").alias("delta"))
    running = F.sum("delta").over(Window.partitionBy("tree_id").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("tree_id", "time", (F.lit(1) + running).alias("n"))


def coalescent_intervals(nodes: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(tree_id, k, lineages, w): intervals from the tips to the root, k from 1; widths between consecutive branching times."""
    order = Window.partitionBy("tree_id").orderBy("age", "node")
    t = branching_times(nodes, reach)
    n = F.count("*").over(Window.partitionBy("tree_id"))
    k = F.row_number().over(order)
    return t.select("tree_id", k.cast("long").alias("k"), (n - k + 2).alias("lineages"), (F.col("age") - F.coalesce(F.lag("age").over(order), F.lit(0.0))).alias("w"))


def intervals_from_widths(widths: DataFrame, key: str, order: str, width: str) -> DataFrame:
    """Intervals from plain widths, first one at the tips."""
    o = Window.partitionBy(key).orderBy(order)
    k, n = F.row_number().over(o), F.count("*").over(Window.partitionBy(key))
    return widths.select(F.col(key).alias("tree_id"), k.cast("long").alias("k"), (n - k + 2).alias("lineages"), F.col(width).alias("w"))


def skyline(intervals: DataFrame) -> DataFrame:
    """(tree_id, k, time, ne): the classic skyline, one population size an interval."""
    time = F.sum("w").over(Window.partitionBy("tree_id").orderBy("k"))
    return intervals.select("tree_id", "k", time.alias("time"), (F.col("w") * F.col("lineages") * (F.col("lineages") - 1) / 2).alias("ne"))


def collapse_intervals(intervals: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(tree_id, k, lineages, w, grp): consecutive intervals pooled until a group is longer than epsilon.

    The rule carries a running sum that restarts, so it runs as a fold over each tree's intervals; what is left at the end joins the last group.
    """
    rows = intervals.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("k", "lineages", "w"))).alias("x"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        total = acc["sum"] + x["w"]
        done = total > epsilon
        return F.struct(F.when(done, 0.0).otherwise(total).alias("sum"), (acc["g"] + F.when(done, 1).otherwise(0)).alias("g"), F.array_append(acc["out"], acc["g"]).alias("out"))

    folded = rows.withColumn("f", F.aggregate("x", start, step))
    last = F.greatest(F.col("f.g") - 1, F.lit(1))
    grp = F.transform("f.out", lambda g: F.least(g, last))
    return folded.select("tree_id", F.explode(F.arrays_zip(F.col("x"), grp.alias("grp"))).alias("y")).select("tree_id", "y.x.k", "y.x.lineages", "y.x.w", "y.grp")


def skyline_groups(collapsed: DataFrame) -> DataFrame:
    """(tree_id, grp, time, width, ne): mean of w l (l - 1) / 2 over the intervals of a group."""
    g = collapsed.groupBy("tree_id", "grp").agg(F.avg(F.col("w") * F.col("lineages") * (F.col("lineages") - 1) / 2).alias("ne"), F.sum("w").alias("width"))
    return g.select("tree_id", "grp", F.sum("width").over(Window.partitionBy("tree_id").orderBy("grp")).alias("time"), "width", "ne")


def skyline_likelihood(collapsed: DataFrame) -> DataFrame:
    """(tree_id, loglik, params, aicc) of a generalised skyline; aicc is null where it has too few intervals."""
    sizes = skyline_groups(collapsed).select("tree_id", "grp", "ne")
    c = F.col("lineages") * (F.col("lineages") - 1) / 2
    ll = collapsed.join(sizes, ["tree_id", "grp"]).groupBy("tree_id").agg(F.sum(F.log(c / F.col("ne")) - F.col("w") * c / F.col("ne")).alias("loglik"), F.countDistinct("grp").alias("params"), F.count("*").alias("n"))
    return ll.select("tree_id", "loglik", "params", F.when(F.col("n") - F.col("params") > 1, F.col("loglik") - F.col("params") * F.col("n") / (F.col("n") - F.col("params") - 1)).alias("aicc"))


def gamma_stat(nodes: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(tree_id, gamma): the statistic of Pybus and Harvey."""
    i = coalescent_intervals(nodes, reach).withColumn("weighted", F.col("lineages") * F.col("w"))
    up = Window.partitionBy("tree_id").orderBy("lineages")
    run = i.withColumn("run", F.sum("weighted").over(up))
    top = F.max("lineages").over(Window.partitionBy("tree_id"))
    run = run.withColumn("top", top)
    stats = run.groupBy("tree_id").agg(F.max("top").alias("n"), F.sum("weighted").alias("total"), F.sum(F.when(F.col("lineages") < F.col("top"), F.col("run"))).alias("inner"))
    return stats.where("n > 2").select("tree_id", ((F.col("inner") / (F.col("n") - 2) - F.col("total") / 2) / (F.col("total") * F.sqrt(1 / (12 * (F.col("n") - 2))))).alias("gamma"))


def yule(nodes: DataFrame) -> DataFrame:
    """(tree_id, lambda, se, loglik): the constant-rate pure-birth fit."""
    s = with_children(nodes).groupBy("tree_id").agg(F.count_if(~F.col("is_tip")).alias("m"), F.sum(F.when(F.col("parent").isNotNull(), F.col("length"))).alias("x"))
    rate = (F.col("m") - 1) / F.col("x")
    return s.where("m > 1").select(
        "tree_id", rate.alias("lambda"), (rate / F.sqrt(F.col("m") - 1)).alias("se"), (-rate * F.col("x") + _lfactorial(F.col("m")) + (F.col("m") - 1) * F.log(rate)).alias("loglik")
    )


def _lfactorial(n):
    """Sum of the logarithms up to n."""
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))


def exponential_fit(widths: DataFrame, key: str, width: str, published: bool = False) -> DataFrame:
    """(key, n, w2, a2): Cramer-von Mises and Anderson-Darling statistics of times against an exponential of the same mean.

    The additive term of W2 is n / 12; ``published`` asks for the literature's 1 / (12 n).
    """
    o = Window.partitionBy(key).orderBy(width)
    per = Window.partitionBy(key)
    z = 1 - F.exp(-F.col(width) / F.avg(width).over(per))
    rows = widths.select(key, F.row_number().over(o).alias("i"), F.count("*").over(per).alias("n"), z.alias("z"))
    mirrored = rows.select(key, (F.col("n") + 1 - F.col("i")).alias("i"), F.col("z").alias("zr"))
    w = F.pow(F.col("z") - (2 * F.col("i") - 1) / (2 * F.col("n")), F.lit(2))
    a = (2 * F.col("i") - 1) * (F.log(F.when(F.col("z") > 0, F.col("z"))) + F.log(F.when(F.col("zr") < 1, 1 - F.col("zr"))))
    g = rows.join(mirrored, [key, "i"]).groupBy(key).agg(F.max("n").alias("n"), F.sum(w).alias("w"), F.sum(a).alias("a"))
    extra = 1 / (12 * F.col("n")) if published else F.col("n") / 12
    return g.select(key, "n", ((F.col("w") + extra) * (1 - 0.16 / F.col("n"))).alias("w2"), ((-F.col("n") - F.col("a") / F.col("n")) * (1 + 0.6 / F.col("n"))).alias("a2"))


def slowinski_guyer(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(n, chi2): Fisher's combination of the sister-clade probabilities r / (r + s - 1) of the richer clade on the left."""
    p = F.col(right) / (F.col(left) + F.col(right) - 1)
    return pairs.agg(F.count("*").alias("n"), (-2 * F.sum(F.log(p))).alias("chi2"))


def mcconway_sims(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(n, chi2): summed likelihood ratios of one diversification rate for both sister clades against one each.

    The factor 1.629 is the published correction of the ratio's scale.
    """
    m, n = F.col(left).cast("double"), F.col(right).cast("double")
    f = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    apart = f(m - 1) - f(m) + f(n - 1) - f(n)
    pooled = f(m + n - 2) - f(m + n) + f(F.lit(2.0))
    return pairs.agg(F.count("*").alias("n"), (1.629 * F.sum(apart - pooled)).alias("chi2"))


def diversity_contrast(pairs: DataFrame, left: str, right: str, method: str = "ratiolog") -> DataFrame:
    """(n, total): sum of the signed contrasts of sister-clade sizes."""
    lo, hi = F.least(left, right).cast("double"), F.greatest(left, right).cast("double")
    if method == "ratiolog":
        shift = F.max((F.least(left, right) == 1).cast("int")).over(Window.partitionBy(F.lit(1)))
        size = F.log(hi + shift) / F.log(lo + shift)
    else:
        size = {"proportion": hi / (hi + lo), "difference": hi - lo, "logratio": F.log(lo / hi)}[method]
    return pairs.select((F.signum(F.col(left) - F.col(right)) * size).alias("y")).agg(F.count("*").alias("n"), F.sum("y").alias("total"))


def cherry_test(nodes: DataFrame) -> DataFrame:
    """(tree_id, n_tip, n_cherries, z_yule, z_uniform): deviations of the cherry count from both null models (20 or more tips)."""
    from sylva.operators.tree_tables import cherries

    n = with_children(nodes).groupBy("tree_id").agg(F.count_if("is_tip").alias("n_tip"))
    c = cherries(nodes).join(n, "tree_id")
    k = F.col("n_tip").cast("double")
    mean = k * (k - 1) / (2 * (2 * k - 5))
    var = k * (k - 1) * (k - 4) * (k - 5) / (2 * F.pow(2 * k - 5, F.lit(2)) * (2 * k - 7))
    return c.select("tree_id", "n_tip", "n_cherries", (F.abs(F.col("n_cherries") - k / 3) / F.sqrt(2 * k / 45)).alias("z_yule"), (F.abs(F.col("n_cherries") - mean) / F.sqrt(var)).alias("z_uniform"))


def estimate_rate(nodes: DataFrame, dates: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(tree_id, mu, intercept): slope of the tips' depths over their dates; dates: (label, date)."""
    tips = with_children(nodes).where("is_tip").join(root_paths(nodes, reach), ["tree_id", "node"]).join(dates, "label")
    return tips.groupBy("tree_id").agg(F.regr_slope("depth", "date").alias("mu"), F.regr_intercept("depth", "date").alias("intercept"))


def yule_density(x: Column, rate: float, t: float, log: bool = False) -> Column:
    """Probability of x species after time t of pure birth."""
    out = -rate * t + (x - 1) * math.log(-math.expm1(-rate * t))
    return out if log else F.exp(out)


def birth_death_density(x: Column, birth: float, death: float, t: float, conditional: bool = False, log: bool = False) -> Column:
    """Probability of x species after time t, given survival if ``conditional``; x = 0 is extinction."""
    if abs(birth - death) < 1e-12:
        alpha = beta = birth * t / (1 + birth * t)
    else:
        e = math.exp((birth - death) * t)
        alpha, beta = death * (e - 1) / (birth * e - death), birth * (e - 1) / (birth * e - death)
    alive = math.log1p(-beta) + (x - 1) * math.log(beta) + (0.0 if conditional else math.log1p(-alpha))
    gone = F.lit(-math.inf if conditional or alpha <= 0 else math.log(alpha))
    out = F.when(x > 0, alive).otherwise(gone)
    return out if log else F.exp(out)


def trapezoids(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, integral): area under the points of each key, in the order of x."""
    o = Window.partitionBy(key).orderBy(x)
    area = (F.col(x) - F.lag(x).over(o)) * (F.col(y) + F.lag(y).over(o)) / 2
    return points.select(key, area.alias("area")).groupBy(key).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("integral"))
