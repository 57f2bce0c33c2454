import numpy as np

from helixframe.llm import neighbours


def test_blocks_of_queries_do_not_change_what_is_found(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(300, 8)).astype(np.float32)
    codes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, code binary").cache()
    graph = neighbours.build_graph(codes, 8)
    queries = spark.createDataFrame([(i,) for i in range(0, 300, 10)], "qid long")
    found = []
    for size in (500, 7):
        monkeypatch.setattr(neighbours, "QUERIES_PER_BLOCK", size)
        found.append({r.qid: (list(r.ids), list(r.scores)) for r in neighbours.search(graph, codes, queries, 8).collect()})
    assert len(found[0]) == 30 and found[0] == found[1]
