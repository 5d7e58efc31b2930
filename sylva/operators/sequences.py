"""Operators on sequences (label, seq): composition, sites, gaps, complement, translation, patterns.

Everything is a column expression or a group-by on exploded sites; no sequence leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ambiguity codes with the bases they stand for.
IUPAC = {"r": "ag", "m": "ac", "w": "at", "s": "cg", "k": "gt", "y": "ct", "v": "acg", "h": "act", "d": "agt", "b": "cgt", "n": "acgt", "?": "acgt"}
BASES = "acgt"
ALL_CODES = "acgtrmwskyvhdbn-?"

# Amino acids of the 64 codons in the order TCAG, of the genetic codes 1 to 6.
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}


def count_of(seq: Column, chars: str) -> Column:
    """How many characters of a sequence are in ``chars``."""
    return F.length(seq) - F.length(F.translate(seq, chars, ""))


def base_counts(seqs: DataFrame, every: bool = False) -> DataFrame:
    """(base, n) over all sequences: a, c, g, t, or every code."""
    codes = ALL_CODES if every else BASES
    sums = seqs.agg(*[F.coalesce(F.sum(count_of(F.lower("seq"), c)), F.lit(0)).alias(f"n{i}") for i, c in enumerate(codes)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("base"), F.col(f"n{i}").alias("n")) for i, c in enumerate(codes)])).alias("x")).select("x.*")


def base_freq(seqs: DataFrame, freq: bool = False, every: bool = False) -> DataFrame:
    """Proportions of the bases (or counts); the denominator holds only the codes asked for."""
    counts = base_counts(seqs, every)
    if freq:
        return counts
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("base", (F.col("n") / F.nullif("total", F.lit(0))).alias("freq"))


def gc_content(seqs: DataFrame) -> DataFrame:
    """(label, gc) of each sequence: (c + g) / (a + c + g + t)."""
    s = F.lower("seq")
    return seqs.select("label", (count_of(s, "cg") / F.nullif(count_of(s, "acgt"), F.lit(0))).alias("gc"))


def complement(seqs: DataFrame) -> DataFrame:
    """Reverse complement, with ambiguity codes."""
    return seqs.withColumn("seq", F.reverse(F.translate(F.lower("seq"), "acgtrymkbdhv", "tgcayrkmvhdb")))


def codon_map(code: int) -> dict[str, str]:
    order = "tcag"
    table = GENETIC_CODES[code]
    return {order[i // 16] + order[i // 4 % 4] + order[i % 4]: table[i] for i in range(64)}


def translate(seqs: DataFrame, code: int = 1, codon_start: int = 1) -> DataFrame:
    """Amino acids of the whole codons; an ambiguous codon is X unless all it stands for agree."""
    full = dict(codon_map(code))
    letters = {b: b for b in BASES} | IUPAC
    for a, aa in letters.items():
        for b, bb in letters.items():
            for c, cc in letters.items():
                found = {full[x + y + z] for x in aa for y in bb for z in cc if x + y + z in full} if a + b + c not in full else {full[a + b + c]}
                if len(found) == 1:
                    full.setdefault(a + b + c, next(iter(found)))
    table = F.create_map(*[F.lit(x) for kv in full.items() for x in kv])
    s = F.lower("seq")
    n = F.floor((F.length(s) - (codon_start - 1)) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.element_at(table, F.substring(s, (i * 3 + codon_start).cast("int"), F.lit(3))), F.lit("X")))
    return seqs.withColumn("seq", F.when(n > 0, F.array_join(codons, "")).otherwise(""))


def where_pattern(seqs: DataFrame, pattern: str) -> DataFrame:
    """(label, pos): starts, from 1, of all occurrences of a pattern, overlapping ones too."""
    s, p = F.lower("seq"), pattern.lower()
    found = F.filter(F.sequence(F.lit(1), F.length(s) - len(p) + 1), lambda i: F.substring(s, i.cast("int"), F.lit(len(p))) == p)
    return seqs.where(F.length("seq") >= len(p)).where(s.contains(p)).select("label", F.explode(found).alias("pos"))


def del_gaps(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", F.translate("seq", "-", ""))


def gap_share(seq: Column) -> Column:
    return count_of(seq, "-") / F.nullif(F.length(seq), F.lit(0))


def del_row_gaps(seqs: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drop sequences whose share of gaps reaches the threshold."""
    return seqs.where(F.coalesce(gap_share(F.col("seq")) < threshold, F.lit(True)))


def sites(seqs: DataFrame) -> DataFrame:
    """(label, pos, base) with pos from 1."""
    return seqs.select("label", F.posexplode(F.split(F.lower("seq"), "")).alias("p", "base")).where("base <> ''").select("label", (F.col("p") + 1).cast("long").alias("pos"), "base")


def del_column_gaps(seqs: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drop the sites whose share of gaps reaches the threshold."""
    s = sites(seqs)
    keep = s.groupBy("pos").agg(F.avg((F.col("base") == "-").cast("int")).alias("g")).where(F.col("g") < threshold).select("pos")
    kept = s.join(keep, "pos", "left_semi").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("x"))
    return seqs.select("label").join(kept, "label", "left").select("label", F.coalesce(F.array_join(F.transform("x", lambda v: v["base"]), ""), F.lit("")).alias("seq"))


def end_gaps_to_n(seqs: DataFrame) -> DataFrame:
    """Leading and trailing gaps become n."""
    lead = F.length(F.regexp_extract("seq", "^-*", 0))
    trail = F.when(lead == F.length("seq"), 0).otherwise(F.length(F.regexp_extract("seq", "-*$", 0)))
    middle = F.substring(F.col("seq"), (lead + 1).cast("int"), (F.length("seq") - lead - trail).cast("int"))
    return seqs.withColumn("seq", F.concat(F.repeat(F.lit("n"), lead.cast("int")), middle, F.repeat(F.lit("n"), trail.cast("int"))))


def seg_sites(seqs: DataFrame, strict: bool = False, end_gaps_as_n: bool = True) -> DataFrame:
    """(pos) of the segregating sites.

    By default a site segregates if two of its codes share no base, or a gap meets a base; ``strict`` counts any two different codes.
    """
    s = sites(end_gaps_to_n(seqs) if end_gaps_as_n else seqs)
    if strict:
        return s.groupBy("pos").agg(F.countDistinct("base").alias("k")).where("k > 1").select("pos")
    bits = {b: 1 << i for i, b in enumerate(BASES)}
    masks = {**bits, **{k: sum(bits[b] for b in v) for k, v in IUPAC.items()}}
    value = F.create_map(*[F.lit(x) for k, v in masks.items() for x in (k, v)])[F.col("base")]
    # codes all share a base where the masks' intersection is not empty; else two of them may still only meet pairwise
    seen = s.groupBy("pos").agg(F.collect_set(value).alias("m"), F.max((F.col("base") == "-").cast("int")).alias("gap"))
    pair = F.exists("m", lambda a: F.exists("m", lambda b: a.bitwiseAND(b) == 0))
    return seen.where(pair | ((F.col("gap") == 1) & (F.size("m") > 0) & F.exists("m", lambda a: a < 15))).select("pos")


def aa_polymorphic_sites(seqs: DataFrame) -> DataFrame:
    """(pos) of the sites with more than one amino acid, X aside."""
    s = seqs.select("label", F.posexplode(F.split(F.upper("seq"), "")).alias("p", "aa")).where("aa not in ('', 'X')")
    return s.groupBy((F.col("p") + 1).cast("long").alias("pos")).agg(F.countDistinct("aa").alias("k")).where("k > 1").select("pos")


def gap_blocks(seqs: DataFrame) -> DataFrame:
    """(label, pos, len): start and length of each run of gaps."""
    s = sites(seqs).where("base = '-'")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("label").orderBy("pos"))
    return s.withColumn("g", island).groupBy("label", "g").agg(F.min("pos").alias("pos"), F.count("*").alias("len")).select("label", "pos", "len")


def site_entropy(seqs: DataFrame) -> DataFrame:
    """(pos, n_codes, entropy) of the bases a, c, g, t at each site."""
    n = sites(seqs).where(F.col("base").isin(*BASES)).groupBy("pos", "base").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))
    return p.groupBy("pos").agg(F.count("*").alias("n_codes"), F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def solve_ambiguous(seqs: DataFrame) -> DataFrame:
    """Replace ambiguous codes by the site's most frequent base (ties: alphabetical), where it has one."""
    s = sites(seqs)
    mode = s.where(F.col("base").isin(*BASES)).groupBy("pos", "base").agg(F.count("*").alias("n")).groupBy("pos").agg(F.min_by("base", F.struct(-F.col("n"), "base")).alias("mode"))
    fixed = s.join(mode, "pos", "left").select("label", "pos", F.when(F.col("base").isin(*[k for k in IUPAC]), F.coalesce("mode", "base")).otherwise(F.col("base")).alias("base"))
    return fixed.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("x")).select("label", F.array_join(F.transform("x", lambda v: v["base"]), "").alias("seq"))


def subset(seqs: DataFrame, start: int, length: int) -> DataFrame:
    """The sites from start (from 1)."""
    return seqs.withColumn("seq", F.substring("seq", start, length))


def bind_columns(a: DataFrame, b: DataFrame, fill_with_gaps: bool = False, filler: str = "-") -> DataFrame:
    """Join two alignments site-wise by label: labels in both, or all with missing parts filled."""
    x, y = a.select("label", F.col("seq").alias("x")), b.select("label", F.col("seq").alias("y"))
    if not fill_with_gaps:
        return x.join(y, "label").select("label", F.concat("x", "y").alias("seq"))
    nx, ny = a.agg(F.max(F.length("seq")).alias("nx")), b.agg(F.max(F.length("seq")).alias("ny"))
    both = x.join(y, "label", "full").crossJoin(F.broadcast(nx)).crossJoin(F.broadcast(ny))
    return both.select("label", F.concat(F.coalesce("x", F.repeat(F.lit(filler), F.col("nx"))), F.coalesce("y", F.repeat(F.lit(filler), F.col("ny")))).alias("seq"))


def compare_alignments(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, pos, base_a, base_b) where two alignments differ; null where one has no such site."""
    x, y = sites(a).withColumnRenamed("base", "base_a"), sites(b).withColumnRenamed("base", "base_b")
    return x.join(y, ["label", "pos"], "full").where(~F.col("base_a").eqNullSafe(F.col("base_b")))


def alignment_view(seqs: DataFrame) -> DataFrame:
    """Each sequence with a dot where it equals the first one by label."""
    first = seqs.agg(F.min_by("seq", "label").alias("ref"), F.min("label").alias("first"))
    dots = F.array_join(F.zip_with(F.split("seq", ""), F.split("ref", ""), lambda s, r: F.when(s == r, ".").otherwise(s)), "")
    return seqs.crossJoin(F.broadcast(first)).select("label", F.when(F.col("label") == F.col("first"), F.col("seq")).otherwise(dots).alias("seq"))


def random_sequences(spark, n_rows: int, n_sites: int, freq: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), prefix: str = "Ind_", seed: int = 1) -> DataFrame:
    """Seeded random sequences with the given base frequencies."""
    from itertools import accumulate

    cut = list(accumulate(freq))
    site = F.explode(F.sequence(F.lit(1), F.lit(n_sites)))
    r = F.rand(seed)
    rows = spark.range(1, n_rows + 1).select("id", site.alias("pos")).withColumn("r", r)
    base = F.when(F.col("r") < cut[0], "a").when(F.col("r") < cut[1], "c").when(F.col("r") < cut[2], "g").otherwise("t")
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", base.alias("b")))).alias("x")).select(F.concat(F.lit(prefix), F.col("id")).alias("label"), F.array_join(F.transform("x", lambda v: v["b"]), "").alias("seq"))
