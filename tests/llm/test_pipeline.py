import corpus_pipeline
from helixframe.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop_rows(spark):
    docs = read_table(spark, SF, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids, name


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.length for r in rows} and max(r.length for r in rows) <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near duplicates", "personal data", "packing"]


def test_the_rules_stage_removes_failing_lines(spark):
    good = [" ".join(f"word{i}x{j}" for j in range(20)) + "." for i in range(4)]
    text = "\n".join(["Home", good[0], good[1], "a | b | c | d", good[2], good[0], "All rights reserved.", good[3]])
    docs = spark.createDataFrame([(1, text, "en", "web", len(text)), (2, "too short", "en", "web", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    assert [tuple(r) for r in rows] == [(1, "\n".join(good), "en", "web", len("\n".join(good)))]


def test_odd_rows_pass_every_stage(spark):
    """Null and empty texts, repeated rows, null ids, columns with the names that stages use themselves, and the empty table."""
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, good, "en", "web", len(good)), (1, good, "en", "web", len(good)), (2, None, None, None, None), (3, "", "en", "web", 0), (None, "call +44 20 7946 0958 now", "en", "web", 25)]
    df = spark.createDataFrame([(*r, "MINE", "kinds", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_entities string, entity_kinds string, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        found = out.collect()
        assert out.columns == df.columns and {r.n_entities for r in found} <= {"MINE"} and {r.entity_kinds for r in found} <= {"kinds"}, name
        assert stage(spark, df.limit(0), SF).collect() == [], name
    kept = corpus_pipeline.personal_data(spark, df, SF).collect()
    assert sorted((str(r.doc_id), str(r.n_chars)) for r in kept if r.doc_id) == sorted((str(d), str(n)) for d, _, _, _, n in rows if d)
    (hidden,) = [r for r in kept if r.doc_id is None]
    assert "7946" not in hidden.text and hidden.n_chars == len(hidden.text)
    assert len([r for r in corpus_pipeline.near_duplicates(spark, df, SF).collect() if r.text == good]) == 1
    packed = corpus_pipeline.packed_sequences(spark, df, SF).collect()
    assert sum(r.doc_id == 1 for r in packed) == 2 and len(packed) == 5
