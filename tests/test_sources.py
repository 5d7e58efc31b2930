"""Readers and writers, round trips on hand-written files."""

from pyspark.sql import functions as F

from sylva.functions.phylo import parse_newick
from sylva.operators import simulation
from sylva.sources import readers as R
from sylva.sources import writers as W


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_newick_files(spark, tmp_path):
    path = put(tmp_path, "t.nwk", "(a:1,(b:2,c:3)x:1);\n(a,b,\n(c,d));\n")
    nodes = R.read_newick(spark, path)
    assert nodes.select("tree_id").distinct().count() == 2
    assert {r.label for r in nodes.where("label is not null").collect()} == {"a", "b", "c", "d", "x"}
    quoted = put(tmp_path, "q.nwk", "('x;y':1,b:2);")
    assert R.read_newick(spark, quoted, quoted=True).where("label = 'x;y'").count() == 1
    out = str(tmp_path / "out")
    W.write_trees(nodes, out)
    assert R.read_newick(spark, out).count() == nodes.count()


def test_sequence_files(spark, tmp_path):
    fasta = put(tmp_path, "s.fasta", ">one\nACGT\nac-t\r\n>two words\nNNNN\n")
    assert [tuple(r) for r in R.read_fasta(spark, fasta).orderBy("label").collect()] == [("one", "ACGTac-t"), ("two words", "NNNN")]
    W.write_fasta(R.read_fasta(spark, fasta), str(tmp_path / "f"), width=3)
    assert sorted(map(tuple, R.read_fasta(spark, str(tmp_path / "f")).collect())) == [("one", "ACGTac-t"), ("two words", "NNNN")]
    fastq = put(tmp_path, "s.fq", "@r1\nACG\n+\n!\"#\n@r2\nT\n+\nI\n")
    assert [(r.label, r.seq, list(r.qual)) for r in R.read_fastq(spark, fastq).orderBy("label").collect()] == [("r1", "ACG", [0, 1, 2]), ("r2", "T", [40])]
    seqs = [("aa", "acgt" * 30), ("b", "tttt" * 30)]
    for inter in (True, False):
        p = put(tmp_path, f"p{inter}.phy", W.phylip_document(seqs, inter))
        assert sorted((r.label, r.seq) for r in R.read_phylip(spark, p, inter).collect()) == seqs
    n = put(tmp_path, "d.nex", W.nexus_data_document(seqs))
    assert sorted((r.label, r.seq) for r in R.read_nexus_data(spark, n).collect()) == seqs
    c = put(tmp_path, "c.aln", "CLUSTAL W\n\na  ACGT\nb  AC-T\n   ** *\n\na  GG\nb  GG\n")
    assert sorted((r.label, r.seq) for r in R.read_clustal(spark, c).collect()) == [("a", "ACGTGG"), ("b", "AC-TGG")]


def test_nexus_trees_and_features(spark, tmp_path):
    trees = [("one", parse_newick("(a:1,(b:2,c:3):1);")[1]), ("two", parse_newick("((a:1,b:2):1,c:3);")[1])]
    path = put(tmp_path, "t.nex", W.nexus_document(trees))
    got = R.read_nexus_trees(spark, path)
    assert {r.label for r in got.where("label is not null").collect()} == {"a", "b", "c"} and got.select("tree_no").distinct().count() == 2
    gff = put(tmp_path, "g.gff", "##gff\nchr1\tx\tgene\t1\t9\t.\t+\t.\tID=1\n")
    r = R.read_gff(spark, gff).first()
    assert (r.start, r.end, r.score, r.phase) == (1, 9, None, None)
    f = put(tmp_path, "f.tbl", ">Feature gb|X1|\n1\t20\tgene\n\t\t\tgene\tcytb\n<3\t9\tCDS\n\t\t\tproduct\tcytochrome\n")
    assert [(r.start, r.end, r.type) for r in R.read_feature_table(spark, f).collect()] == [(1, 20, "gene"), (3, 9, "CDS")]
    assert "<name>a</name>" in W.phyloxml_document(trees)
    assert R.find_files(spark, str(tmp_path)).count() == 3


def test_random_trees_do_not_depend_on_partitions(spark):
    a = simulation.random_trees(spark, 6, 9, "rcoal", seed=3)
    b = simulation.random_trees(spark, 6, 9, "rcoal", seed=3).repartition(3)
    key = lambda d: sorted(map(tuple, d.select("tree_id", "node", "parent", F.round("length", 9), "label").fillna("", ["label"]).fillna(0).collect()))
    assert key(a) == key(b) and a.where("label is not null").count() == 54
