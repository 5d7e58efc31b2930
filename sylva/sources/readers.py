"""Readers of tree, sequence and feature files into DataFrames.

Formats with a record mark are split by Spark's text source (Newick at ``;``, FASTA at ``>``), so one large file is
read by many tasks. Formats whose records depend on the lines around them are read file by file.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.functions.phylo import Phylo, parse_newick, split_trees, strip_comments

NODES = "node long, parent long, length double, label string"


def tree_rows(tree: Phylo) -> list[tuple]:
    """(node, parent, length, label) with tips numbered from 1, then the root and the other nodes in preorder."""
    order = [*tree.tips(), *tree.internal()]
    number = {v: i + 1 for i, v in enumerate(order)}
    return [(number[v], number[tree.parent[v]] if tree.parent[v] >= 0 else None, tree.length[v], tree.label[v]) for v in order]


def parse_trees(texts: DataFrame, column: str = "newick", key: str = "tree_id") -> DataFrame:
    """(tree_id, name, node, parent, length, label) from Newick strings, one tree a row."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[column]):
                name, tree = parse_newick(text)
                rows += [(k, name, *r) for r in tree_rows(tree)]
            out = pd.DataFrame(rows, columns=["tree_id", "name", "node", "parent", "length", "label"])
            yield out.astype({"parent": "Int64"})

    return texts.select(key, column).mapInPandas(run, f"tree_id long, name string, {NODES}")


def read_newick(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Trees of Newick files. ``quoted`` reads whole files, for labels that hold semicolons."""
    if quoted:
        whole = spark.read.text(path, wholetext=True)

        def cut(batches):
            for pdf in batches:
                yield pd.DataFrame({"newick": [t for x in pdf["value"] for t in split_trees(strip_comments(x))]})

        texts = whole.mapInPandas(cut, "newick string")
    else:
        texts = spark.read.option("lineSep", ";").text(path).withColumnRenamed("value", "newick").where("trim(translate(newick, '\n\r\t', '   ')) <> ''")
    return parse_trees(texts.withColumn("tree_id", F.monotonically_increasing_id()))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(label, seq) of FASTA files, compressed ones too."""
    records = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return records.select(F.trim(F.translate(F.substring_index("value", "\n", 1), "\r", "")).alias("label"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str, offset: int = -33) -> DataFrame:
    """(label, seq, qual) of FASTQ files with four lines a record; qualities are character codes plus the offset."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.translate("value", "\r", ""), "\n").alias("l"))
    records = F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int")), lambda i: F.slice("l", (i * 4 + 1).cast("int"), F.lit(4))), lambda r: F.size(r) == 4)
    r = whole.select(F.explode(records).alias("r"))
    qual = F.transform(F.filter(F.split(F.col("r")[3], ""), lambda c: c != ""), lambda c: F.ascii(c) + offset)
    return r.select(F.expr("substring(r[0], 2)").alias("label"), F.col("r")[1].alias("seq"), qual.alias("qual"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns of GFF files; ``.`` and ``?`` are missing."""
    schema = "seqid string, source string, type string, start string, end string, score string, strand string, phase string, attributes string"
    raw = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="")
    clean = raw.select(*[F.when(~F.col(c).isin(".", "?"), F.col(c)).alias(c) for c in raw.columns])
    return clean.withColumns({"start": F.col("start").try_cast("int"), "end": F.col("end").try_cast("int"), "score": F.col("score").try_cast("double")})


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def _by_file(texts: DataFrame, parse, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["value"]):
                rows = parse(text.replace("\r", ""))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["file", *re.findall(r"(\w+) \w", schema)])

    return texts.select("file", "value").mapInPandas(run, f"file string, {schema}")


def parse_phylip(text: str, interleaved: bool = True) -> list[tuple[str, str]]:
    lines = [x for x in text.split("\n") if x.strip()]
    n, sites = map(int, lines[0].split()[:2])
    names, seqs = [], []
    if interleaved:
        for k, line in enumerate(lines[1:]):
            if k < n:
                name, _, rest = line.strip().partition(" ")
                names.append(name)
                seqs.append(re.sub(r"\s", "", rest))
            else:
                seqs[k % n] += re.sub(r"\s", "", line)
    else:
        at = 1
        for _ in range(n):
            name, _, rest = lines[at].strip().partition(" ")
            seq = re.sub(r"\s", "", rest)
            at += 1
            while len(seq) < sites and at < len(lines):
                seq += re.sub(r"\s", "", lines[at])
                at += 1
            names.append(name)
            seqs.append(seq)
    if any(len(s) != sites for s in seqs):
        raise ValueError("a sequence has not the announced length")
    return list(zip(names, seqs))


def parse_clustal(text: str) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for line in text.split("\n")[1:]:
        parts = line.split()
        if len(parts) >= 2 and not line[0].isspace() and not set(parts[0]) <= set("*:."):
            out[parts[0]] = out.get(parts[0], "") + parts[1]
    return list(out.items())


def parse_nexus_data(text: str) -> list[tuple[str, str]]:
    m = re.search(r"begin\s+(?:data|characters)\s*;(.*?)end\s*;", strip_comments(text), re.I | re.S)
    matrix = re.search(r"matrix(.*?);", m.group(1), re.I | re.S) if m else None
    out: dict[str, str] = {}
    for line in matrix.group(1).split("\n") if matrix else ():
        got = re.match(r"\s*('(?:[^']|'')*'|\S+)\s+(.*\S)\s*$", line)
        if got:
            name = got.group(1).strip("'")
            out[name] = out.get(name, "") + re.sub(r"\s", "", got.group(2))
    return list(out.items())


SEQUENCES = {"phylip": parse_phylip, "phylip_sequential": lambda t: parse_phylip(t, False), "clustal": parse_clustal, "nexus": parse_nexus_data}


def sequences_of(texts: DataFrame, form: str) -> DataFrame:
    """(file, label, seq) of whole texts (file, value) in one of the forms of ``SEQUENCES``."""
    return _by_file(texts, SEQUENCES[form], "label string, seq string")


def read_phylip(spark: SparkSession, path: str, interleaved: bool = True) -> DataFrame:
    return sequences_of(files(spark, path), "phylip" if interleaved else "phylip_sequential")


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    return sequences_of(files(spark, path), "clustal")


def read_nexus_data(spark: SparkSession, path: str) -> DataFrame:
    return sequences_of(files(spark, path), "nexus")


def parse_nexus_trees(text: str) -> list[tuple[str, Phylo]]:
    m = re.search(r"begin\s+trees\s*;(.*?)(?:\bend\s*;|\bendblock\s*;)", strip_comments(text), re.I | re.S)
    if not m:
        return []
    table: dict[str, str] = {}
    out = []
    for statement in split_trees(m.group(1)):
        got = re.match(r"translate\s+(.*)", statement, re.I | re.S)
        if got:
            for token, label in re.findall(r"(\S+)\s+('(?:[^']|'')*'|[^,\s]+)\s*(?:,|$)", got.group(1)):
                table[token] = label.strip("'").replace("''", "'")
            continue
        got = re.match(r"u?tree\s+\*?\s*('(?:[^']|'')*'|[^=\s]+)\s*=\s*(.*)", statement, re.I | re.S)
        if got:
            tree = parse_newick(got.group(2))[1].map_labels(lambda x: table.get(x, x), nodes=False)
            out.append((got.group(1).strip("'"), tree))
    return out


def read_nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    return nexus_trees(files(spark, path))


def nexus_trees(texts: DataFrame) -> DataFrame:
    """(file, tree_no, name, node, parent, length, label) of the TREES blocks of whole texts (file, value), tokens translated."""

    def parse(text):
        return [(k + 1, name, *r) for k, (name, tree) in enumerate(parse_nexus_trees(text)) for r in tree_rows(tree)]

    def run(batches):
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["value"]):
                out = pd.DataFrame([(name, *r) for r in parse(text.replace("\r", ""))], columns=["file", "tree_no", "name", "node", "parent", "length", "label"])
                yield out.astype({"parent": "Int64"})

    return texts.select("file", "value").mapInPandas(run, f"file string, tree_no int, name string, {NODES}")


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, start, end, type, product) of feature tables: ``>Feature id`` heads, tab-separated rows and qualifiers."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.translate("value", "\r", ""), "\n")).alias("no", "line"))
    order = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^>Feature\s+(\S+)", 1)
    tagged = lines.withColumn("seqid", F.last(F.when(head != "", head), ignorenulls=True).over(order))
    row = r"^[<>]?(\d+)\t[<>]?(\d+)\t(\S+)\s*$"
    feature = F.when(F.col("line").rlike(row), F.col("no"))
    tagged = tagged.withColumn("f", F.last(feature, ignorenulls=True).over(order)).where("f is not null")
    return tagged.groupBy("seqid", "f").agg(
        F.max(F.regexp_extract("line", row, 1)).cast("int").alias("start"),
        F.max(F.regexp_extract("line", row, 2)).cast("int").alias("end"),
        F.max(F.regexp_extract("line", row, 3)).alias("type"),
        F.max(F.regexp_extract("line", r"^\t+product\t(.*)$", 1)).alias("product"),
    ).orderBy("f").drop("f")


def find_files(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """(path, kind, bytes) of files of known kinds below a folder; ``extra`` adds file extensions (joined by |) by kind."""
    kinds = {"clustal": "aln", "fasta": "fas|fasta|fa", "fastq": "fq|fastq", "newick": "nwk|newick|tre|tree", "nexus": "nex|nexus", "phylip": "phy", "gff": "gff[23]?", "features": "tbl"}
    for kind, endings in (extra or {}).items():
        kinds[kind] = f"{kinds[kind]}|{endings}" if kind in kinds else endings
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    kind = F.coalesce(*[F.when(F.lower("path").rlike(rf"\.({p})(\.gz)?$"), k) for k, p in kinds.items()])
    return files.select("path", kind.alias("kind"), "bytes").where("kind is not null")
