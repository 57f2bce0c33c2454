"""Queries against their SQL on tables where small data would hide a difference."""

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.functions import sequence as sq
from helixframe.operators import annotation as an
from helixframe.operators import intervals as iv


def differences(spark, folder, name):
    """Rows that only the query or only its SQL has."""
    query, sql = catalog.REGISTRY[name]
    db = duckdb.connect()
    for file in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}{'/*.parquet' if file.is_dir() else ''}')")
    query(spark, str(folder)).write.parquet(str(folder / "got"))
    found = db.execute(sql)
    columns = ", ".join(f'"{c[0]}"' for c in found.description)
    got = f"SELECT {columns} FROM read_parquet('{folder}/got/*.parquet')"
    return db.execute(f"(({sql}) EXCEPT ALL ({got})) UNION ALL (({got}) EXCEPT ALL ({sql}))").fetchall()


def test_equal_intervals_are_in_one_cluster(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("pmod(xxhash64(id), 2000) * 40 AS l_orderkey", "id AS l_linenumber", "pmod(xxhash64(id, 7), 4) AS l_suppkey", "5.0D AS l_quantity", "'N' AS l_returnflag", "id AS l_partkey")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert differences(spark, tmp_path, "gene_clusters") == []
    df = spark.createDataFrame([("a", 0, 5), ("a", 100, 105), ("a", 100, 105), ("a", 107, 109), ("b", 3, 4)], "ref string, start long, end long")
    got = sorted((r.ref, r.start, r.cluster) for r in iv.clusters(df, "ref", 5).collect())
    assert got == [("a", 0, 0), ("a", 100, 1), ("a", 100, 1), ("a", 107, 1), ("b", 3, 0)]


@pytest.mark.parametrize("name", ["polish_corrections", "polish_drafts"])
def test_a_word_shared_by_chance_keeps_drafts_from_being_mended(spark, tmp_path, name):
    # the DNA of the first two has 15 bases in common by chance, so each is a read on both drafts and neither base wins there
    rows = [(1, "text 1238"), (2, "text 10658"), (3, "text 1"), (4, "text 1"), (5, None)]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, tmp_path, name) == []


def test_structure_propensity_takes_up_its_sequence_once(spark):
    # written out for each residue, a protein that is computed on the way was computed over a hundred times a row
    df = spark.createDataFrame([(1, "AAAA"), (2, ""), (3, None), (4, "aX")], "id long, seq string")
    made = df.select("id", sq.structure_propensity(F.concat(F.reverse("seq"), F.lit(""))).alias("s"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("reverse(") <= 2
    got = {r.id: r.s and tuple(round(x, 9) for x in r.s) for r in made.collect()}
    assert got == {1: (1.42, 0.83, 0.75), 2: None, 3: None, 4: (1.21, 0.915, 0.875)}


def test_only_words_that_recur_nearby_are_widened(spark):
    unit, far = "ACGTTGCAAGTCCATGACGGTATCG", "TTGACCGGATATCCGCATGGTACCA"
    array = "C".join(unit + g for g in ("GATTACA" * 5, "CCGTAGA" * 5, ""))
    rows = [(1, array), (2, far + "AC" * 10 + "G" * 9 + "AT" * 300 + "C" + far), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    heads = {(r.id, r["head"]) for r in an.near_heads(df.where("s IS NOT NULL"), "id", 23, 127).collect()}
    assert (1, unit[:23]) in heads and (2, far[:23]) not in heads
    found = [tuple(r) for r in an.crispr_arrays(df.withColumnRenamed("s", "seq"), "id").collect()]
    assert {f[0] for f in found} == {1} and (1, unit, 1, 25 * 3 + 35 * 2 + 2, 3) in found


def test_lengths_of_zero_and_null_are_counted(spark, tmp_path):
    rows = [(1, "en", 0), (2, "en", 7), (3, "en", 3), (4, "de", 0), (5, "de", 0), (6, "fr", None), (7, "fr", 10), (8, "fr", 0), (9, "fr", 10), (10, "es", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, tmp_path, "n50_by_language") == []


def test_gaps_are_filled_between_flanks_with_several_places(spark, tmp_path):
    # the DNA of a text that reads the same backwards is one half twice, so both flanks have two places in it
    rows = [(1, ""), (2, ""), (3, "anna"), (4, "text"), (5, None), (6, "x")]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, tmp_path, "fill_gaps") == []


def test_arrays_are_found_without_shuffles_as_by_parts(spark, monkeypatch):
    import random

    rng = random.Random(12)
    text = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    unit, close = text(30), text(24)
    rows = [text(20).join([unit] * 2) + text(9) + unit + text(40), text(40).join([unit] * 5) + text(300) + unit, (unit + text(30)) * 2 + unit[:25] + "N" + unit[26:] + text(28) + unit[:26], "".join(close + text(k) for k in (26, 72, 40, 73)) + close, (text(60) * 6).lower(), "AC" * 300, text(55) + "ñ" * 30 + text(50) + "ñ" * 30, "ACG", "", None, text(500, "AC")]
    df = spark.createDataFrame([*enumerate(rows), (None, rows[1])], "id long, seq string").repartition(3)
    want = sorted(map(tuple, an.arrays_in_parts(df, "id").collect()))
    assert len(want) > 20 and sorted(map(tuple, an.crispr_arrays(df, "id").collect())) == want
    with monkeypatch.context() as m:  # contigs that are too long for a task
        m.setattr(an, "WHOLE", 250)
        assert sorted(map(tuple, an.crispr_arrays(df, "id").collect())) == want
    monkeypatch.setattr(an, "arrays_in_parts", lambda *a: pytest.fail("shuffled"))
    assert "Exchange" not in an.crispr_arrays(df, "id")._jdf.queryExecution().executedPlan().toString()
