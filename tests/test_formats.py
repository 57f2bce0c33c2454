"""Readers and writers on small files, and the message stream on a file source."""

import json

from pyspark.sql import functions as F

from helixframe.sources import formats as fm
from helixframe.streaming import messages as ms


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    rows = fm.read_fasta(spark, put(tmp_path / "a.fa", ">s1 first one\nACGT\nACG\n>s2\nAUG\n>p3 prot\nMKL>x\n")).collect()
    assert [(r.id, r.description, r.seq, r.kind) for r in rows][:2] == [("s1", "first one", "ACGTACG", "dna"), ("s2", "", "AUG", "rna")]
    fm.write_fasta(fm.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"), 4)
    assert fm.read_fasta(spark, str(tmp_path / "out")).where("id = 's1'").first().seq == "ACGTACG"


def test_fastq(spark, tmp_path):
    text = "@r1/1 x\nACGT\n+\n@III\n@r2/1\nGG\n+\nII\n"
    rows = fm.read_fastq(spark, put(tmp_path / "a.fq", text)).collect()
    assert [(r.id, r.seq, r.quality) for r in rows] == [("r1/1", "ACGT", "@III"), ("r2/1", "GG", "II")]
    pairs = fm.read_fastq_pairs(spark, str(tmp_path / "a.fq"), put(tmp_path / "b.fq", "@r2/2\nTT\n+\nII\n")).collect()
    assert [(p.name, p.seq1, p.seq2) for p in pairs] == [("r2", "GG", "TT")]


def test_gff_and_bed(spark, tmp_path):
    rows = fm.read_gff(spark, put(tmp_path / "a.gff", "##gff\nc1\tsrc\tgene\t1\t90\t.\t+\t.\tID=g1;Name=x y\nc1\t.\tCDS\t10\t20\t5.5\t-\t0\tgene_id=g1\nbad line\n"))
    a, b = rows.orderBy("start").collect()
    assert (a.start, a.end, a.score, a.attributes["Name"]) == (1, 90, None, "x y") and b.phase == 0 and b.source is None
    assert [(g.gene, g.n) for g in fm.genes_of(rows).collect()] == [("g1", 2)]
    gtf = fm.read_gff(spark, put(tmp_path / "a.gtf", 'c1\ts\texon\t1\t9\t.\t+\t.\tgene_id "g7"; transcript_id "t 1";\n'), gtf=True).first()
    assert gtf.attributes == {"gene_id": "g7", "transcript_id": "t 1"}
    bed = fm.read_bed(spark, put(tmp_path / "a.bed", "track x\nchr1\t0\t10\nchr2\t5\t9\tn\t7\t-\t5\t9\t0\t2\t1,2,\t0,3\n")).orderBy("chrom").collect()
    assert (bed[0].start, bed[0].name) == (0, None) and bed[1].block_sizes == [1, 2]


def test_sam(spark, tmp_path):
    path = put(tmp_path / "a.sam", "@HD\tVN:1\n@SQ\tSN:chr1\tLN:100\nq\t16\tchr1\t5\t60\t3M1I\t*\t0\t0\tACGT\tIIII\tNM:i:1\tXX:Z:a:b\n")
    r = fm.read_sam(spark, path).first()
    assert (r.pos, r.flag, r.tags["NM"].value, r.tags["XX"].value) == (5, 16, "1", "a:b")
    assert [(x.name, x.length) for x in fm.sam_references(spark, path).collect()] == [("chr1", 100)]
    fm.write_sam(fm.read_sam(spark, path), str(tmp_path / "out"))
    assert fm.read_sam(spark, str(tmp_path / "out")).first().cigar == "3M1I"


def test_vcf_and_maf(spark, tmp_path):
    path = put(tmp_path / "a.vcf", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nchr1\t12345\t.\tA\tG,T\t50\tPASS\tDP=100;DB\tGT:DP\t0/1:50\t1/1:7\n')
    r = fm.read_vcf(spark, path).first()
    assert (r.id, r.alt, r.info, r.samples["S2"]["GT"]) == (None, ["G", "T"], {"DP": "100", "DB": "true"}, "1/1")
    assert fm.vcf_meta(spark, path).first().fields["Description"] == "Depth, all"
    maf = fm.read_maf(spark, put(tmp_path / "a.maf", "#v\nHugo_Symbol\tVariant_Classification\tTumor_Sample_Barcode\nKRAS\tMissense\tT1\n"))
    assert maf.first().Hugo_Symbol == "KRAS"


def test_matrices_and_sets(spark, tmp_path):
    long = fm.read_matrix(spark, put(tmp_path / "m.csv", "gene,s1,s2\ng1,1.5,\ng2,3,x\n"), features_on_rows=True)
    assert sorted((r.sample, r.feature, r.value) for r in long.where("value IS NOT NULL").collect()) == [("s1", "g1", 1.5), ("s1", "g2", 3.0)]
    gct = fm.read_gct(spark, put(tmp_path / "a.gct", "#1.2\n1\t2\nName\tDescription\tA\tB\ng1\td\t1\t2\n")).orderBy("sample").collect()
    assert [(r.sample, r.feature, r.value) for r in gct] == [("A", "g1", 1.0), ("B", "g1", 2.0)]
    mtx = fm.read_matrix_market(spark, put(tmp_path / "a.mtx", "%%MatrixMarket\n3 2 2\n1 2 5\n3 1 7\n")).collect()
    assert [(r.row, r.column, r.value) for r in mtx] == [(1, 2, 5.0), (3, 1, 7.0)]
    assert fm.read_gmt(spark, put(tmp_path / "a.gmt", "P1\td\tA\tB\nP2\td\tC\n")).count() == 3
    segments, links = fm.read_gfa(spark, put(tmp_path / "a.gfa", "H\tVN:Z:1.0\nS\t1\tACGT\nL\t1\t+\t2\t-\t3M\n"))
    assert segments.first().seq == "ACGT" and links.first().overlap == 3
    atoms = fm.read_pdb(spark, put(tmp_path / "a.pdb", "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  0.00           C\nEND\n"))
    assert (atoms.first().name, atoms.first().x, atoms.first().element) == ("CA", 11.104, "C")
    parts = spark.createDataFrame([("s", 1, "c1", 10, "+"), ("s", 2, None, 5, None), ("s", 3, "c2", 7, "-")], "scaffold string, part int, contig string, length int, strand string")
    assert fm.agp(parts).orderBy("part").collect()[2].line == "s\t16\t22\t3\tW\tc2\t1\t7\t-"


def test_genbank(spark, tmp_path):
    record = "LOCUS       AB1 20 bp\nDEFINITION  A thing\n            of note.\nACCESSION   AB1\nFEATURES             Location/Qualifiers\n     gene            1..20\n                     /gene=\"abc\"\n                     /note=\"two\n                     lines\"\nORIGIN\n        1 acgtacgtac gtacgtacgt\n//\n"
    r = fm.read_genbank(spark, put(tmp_path / "a.gb", record * 2))
    assert r.count() == 2 and r.first().seq == "ACGT" * 5 and r.first().definition == "A thing of note."
    assert fm.features_of_type(r, "gene").first().qualifiers == {"gene": ["abc"], "note": ["two lines"]}


def test_rules(spark):
    df = spark.createDataFrame([(1, 5), (3, 2), (None, 1)], "start int, end int")
    assert {r.rule: r.n for r in fm.violations(df, ordered=F.col("start") < F.col("end"), known=F.col("start").isNotNull()).collect()} == {"ordered": 2, "known": 1}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"type": "mutation_detected", "gene": g, "mutation": "x", "sample_id": str(i)} for i, g in enumerate(["EGFR", "TP53", "kras"])] + [{"type": "odd"}]
    put(tmp_path / "in" / "a.txt", "\n".join(map(json.dumps, lines)) + "\nnot json\n")
    stream = ms.processed(ms.parsed(spark.readStream.text(str(tmp_path / "in"))))
    query = stream.writeStream.format("memory").queryName("processed_messages").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["type"], r["count"]) for r in spark.table("processed_messages").groupBy("type").count().collect()} == {("alert", 1), ("status_update", 2), ("error", 2)}
