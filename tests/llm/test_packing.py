import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helixframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_cut():
    assert packing.cut(5) == [(0, 5)] and packing.cut(2048) == [(0, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_packing(spark):
    rng = random.Random(1)
    texts = ["word " * rng.randint(0, 900) + "é<|endoftext|>" for _ in range(120)] + ["long text, " * 4000, "", None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item int").repartition(4)
    rows = packing.pack_documents(df, PATH).collect()
    library, total = Tokenizer.from_file(PATH), 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        own = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, n) for k, (a, n) in enumerate(packing.cut(len(ids)))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert check(rows, 2048) <= -(-total // 2048) + 1
    assert packing.pack_documents(df.limit(0), PATH).collect() == []


def test_crossover_keeps_every_item_once():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    order = sorted(range(500), key=lambda i: -sizes[i])
    one = packing.best_fit(sizes, order, 100)
    other = packing.best_fit(sizes, rng.sample(order, 500), 100)
    for _ in range(20):
        child = packing.crossover(one, other, sizes, rng)
        assert sorted(i for b in child.bins for i in b) == list(range(500))
        assert all(sum(sizes[i] for i in b) + f == 100 and f >= 0 for b, f in zip(child.bins, child.free))
        other = child
    best = packing.evolve(sizes, 1, [], 100)
    assert packing.lower_bound(sizes, 100) <= len(best.bins) <= len(one.bins)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rng = random.Random(3)
    rows = [(i, i, 0, 0, rng.randint(1, 2047), 0, None) for i in range(400)]
    pieces = spark.createDataFrame(rows, packing._PIECES)
    placed = packing.pack(pieces).collect()
    assert sorted(r.doc_id for r in placed) == list(range(400))
    assert check(placed, 2048) <= 1.06 * sum(r[4] for r in rows) / 2048 + 2
