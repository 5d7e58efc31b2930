"""Writers of trees and sequences: each makes a column of text lines, written with Spark's text sink."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.phylo import Phylo, format_number, write_newick
from sylva.operators.comparative import rows_per_tree


def to_newick(nodes: DataFrame, digits: int = 10) -> DataFrame:
    """(tree_id, newick) of a table of nodes."""

    return rows_per_tree(nodes, lambda tree: [(write_newick(tree, digits),)], "newick string")


def write_trees(nodes: DataFrame, path: str, digits: int = 10, mode: str = "error") -> None:
    to_newick(nodes, digits).select("newick").write.mode(mode).text(path)


def nexus_document(trees: list[tuple[str, Phylo]], digits: int = 10, translate: bool = True) -> str:
    """A NEXUS file of trees with the same tips."""
    labels = sorted({t.label[v] for _, t in trees for v in t.tips()})
    number = {x: str(i + 1) for i, x in enumerate(labels)}
    out = ["#NEXUS", "BEGIN TAXA;", f"\tDIMENSIONS NTAX = {len(labels)};", "\tTAXLABELS", *(f"\t\t{x}" for x in labels), "\t;", "END;", "BEGIN TREES;"]
    if translate:
        out += ["\tTRANSLATE", ",\n".join(f"\t\t{number[x]}\t{x}" for x in labels), "\t;"]
    for name, t in trees:
        shown = t.map_labels(lambda x: number.get(x, x), nodes=False) if translate else t
        out.append(f"\tTREE {name} = [&{'R' if t.is_rooted() else 'U'}] {write_newick(shown, digits)}")
    return "\n".join([*out, "END;", ""])


def to_nexus(nodes: DataFrame, digits: int = 10, translate: bool = True) -> DataFrame:
    """(tree_id, value): a NEXUS document for each tree."""
    return rows_per_tree(nodes, lambda tree: [(nexus_document([("tree", tree)], digits, translate),)], "value string")


def to_phyloxml(nodes: DataFrame) -> DataFrame:
    """(tree_id, value): a phyloXML document for each tree."""
    return rows_per_tree(nodes, lambda tree: [(phyloxml_document([(None, tree)]),)], "value string")


def alignment_documents(seqs: DataFrame, form: str = "phylip", key: str = "alignment", **options) -> DataFrame:
    """(file, value): a document (phylip, phylip_sequential or nexus) for each alignment (key, label, seq), sequences sorted by label."""
    make = {"phylip": phylip_document, "phylip_sequential": lambda s, **o: phylip_document(s, interleaved=False, **o), "nexus": nexus_data_document}[form]

    def run(k, rows):
        rows = rows.sort_values("label")
        return pd.DataFrame({"file": [str(k[0])], "value": [make(list(zip(rows["label"].astype(str), rows["seq"])), **options)]})

    return seqs.select(key, "label", "seq").groupBy(key).applyInPandas(run, "file string, value string")


def fasta_lines(seqs: DataFrame, width: int | None = None) -> DataFrame:
    """(value): one record a row, with line breaks inside."""
    body = F.col("seq") if width is None else F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width).cast("int")), lambda i: F.substring("seq", i * width + 1, F.lit(width))), lambda x: x != ""), "\n")
    return seqs.select(F.concat(F.lit(">"), F.col("label").cast("string"), F.lit("\n"), body).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int | None = None, mode: str = "error") -> None:
    fasta_lines(seqs, width).write.mode(mode).text(path)


def phylip_document(seqs: list[tuple[str, str]], interleaved: bool = True, columns: int = 6, width: int = 10) -> str:
    """A PHYLIP file: blocks of ``columns`` groups of ``width`` sites."""
    n, sites = len(seqs), len(seqs[0][1]) if seqs else 0
    pad = max((len(x) for x, _ in seqs), default=0) + 1
    out = [f"{n} {sites}"]
    step = columns * width
    group = lambda s: " ".join(s[i : i + width] for i in range(0, len(s), width))
    if interleaved:
        for at in range(0, sites, step):
            if at:
                out.append("")
            out += [(label.ljust(pad) if not at else "") + group(s[at : at + step]) for label, s in seqs]
    else:
        for label, s in seqs:
            out += [(label.ljust(pad) if not at else "") + group(s[at : at + step]) for at in range(0, sites, step)]
    return "\n".join([*out, ""])


def nexus_data_document(seqs: list[tuple[str, str]], kind: str = "dna", width: int = 80, gap: str = "-", missing: str = "?") -> str:
    n, sites = len(seqs), len(seqs[0][1]) if seqs else 0
    pad = max((len(x) for x, _ in seqs), default=0) + 1
    out = ["#NEXUS", "BEGIN DATA;", f"  DIMENSIONS NTAX={n} NCHAR={sites};", f"  FORMAT DATATYPE={kind.upper()} MISSING={missing} GAP={gap} INTERLEAVE=YES;", "  MATRIX"]
    for at in range(0, sites, width):
        out += [f"    {label.ljust(pad)}{s[at : at + width]}" for label, s in seqs]
        out.append("")
    return "\n".join([*out, "  ;", "END;", ""])


def phyloxml_document(trees: list[tuple[str | None, Phylo]]) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<phyloxml xmlns="http://www.phyloxml.org">']
    for name, t in trees:
        out.append(f'<phylogeny rooted="{str(t.is_rooted()).lower()}">')
        if name:
            out.append(f"<name>{escape(name)}</name>")
        stack: list[tuple[int, bool]] = [(t.root, False)]
        while stack:
            v, done = stack.pop()
            if done:
                out.append("</clade>")
                continue
            out.append("<clade>")
            if t.label[v] is not None:
                out.append(f"<name>{escape(t.label[v])}</name>")
            if t.length[v] is not None:
                out.append(f"<branch_length>{format_number(t.length[v])}</branch_length>")
            stack.append((v, True))
            stack.extend((c, False) for c in reversed(t.children[v]))
        out.append("</phylogeny>")
    return "\n".join([*out, "</phyloxml>", ""])
