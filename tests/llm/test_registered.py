"""The registered queries themselves: against their SQL, or against brute force over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import neighbours, packing, pii, queries
from helixframe.llm.common import read_table
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_quality_and_rules import brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in read_table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = Counter(tuple(map(plain, r)) for r in found.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_op1_is_the_library(spark, documents):
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in queries.op1_bpe(spark, SF).collect():
        ids = library.encode(documents[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_op2_is_brute_force(spark, documents):
    rows = queries.op2_near_dedup(spark, SF).collect()
    keys = sorted(documents)
    want = dict(zip(keys, (keys[i] for i in brute_classes([documents[k] for k in keys]))))
    assert {r.doc_id: r.class_id for r in rows} == want
    assert all(r.class_size == sum(c == r.class_id for c in want.values()) and r.n_links >= r.n_texts - 1 for r in rows)


def test_op3_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    rows = queries.op3_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert held and sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op4_against_exact_search(spark):
    vectors = read_table(spark, SF, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    want = {(r.query_id, r.vec_id): r.score for r in neighbours.exact(vectors, asked).collect()}
    got = {(r.query_id, r.vec_id): r.score for r in queries.op4_neighbours(spark, SF).collect()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.95 * len(want)
    own = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in vectors.collect()}
    assert all(math.isclose(s, own[q] @ own[v], rel_tol=1e-12) for (q, v), s in got.items())


def test_op6_leaves_no_entity_and_changes_nothing_else(spark, documents):
    entity = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{15,16}\b|AKIA[A-Z0-9]{16}|[0-9a-f]{40}")
    rows = queries.op6_pii(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents)
    pairs = {}
    for r in rows:
        if not r.n_entities:
            assert r.text == documents[r.doc_id]
        old, new = (entity.findall(t) for t in (documents[r.doc_id], r.text))
        assert len(old) == len(new) and not set(old) & set(new)
        assert entity.sub("", documents[r.doc_id]).count(" ") == entity.sub("", r.text).count(" ")
        for a, b in zip(old, new):
            assert pairs.setdefault(a.lower(), b) == b  # one surrogate for each entity
    assert len(set(pairs.values())) == len(pairs)


def test_op7_counts(spark, documents):
    for r in queries.op7_line_rules(spark, SF).collect():
        text = documents[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), brute_repeats(words))
        assert not (r.kept and r.base_failed)


def test_op9_rebuilds_every_document(spark, documents):
    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    by = {}
    for r in queries.op9_packing(spark, SF).collect():
        by.setdefault(r.doc_id, []).append(r)
    total, bins = 0, {}
    for key, text in documents.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        own = sorted(by.pop(key), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids)) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        for r in own:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not by and all(sum(n for _, n in b) <= 2048 and sorted(b)[0][0] == 0 for b in bins.values())
    assert len(bins) <= -(-total // 2048) + 1


def test_people_are_the_same_with_other_titles_and_without(spark):
    texts = [
        "Mr. John Brown met Dr. Brown and Prof. John Brown. Later John said hi.", "My name is Peter Smith. Peter left.", "Contact: Maria Gonzalez", "王小明先生来了。王小明 said so",
        "call 020 7946 0958 or +44 20 7946 0958", "a@b.org and A@B.org, c@b.org, d@other.org", "DE89 3704 0044 0532 0130 00",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_entities": F.lit("x"), "entity_kinds": F.lit("y")})
    rows = {r.doc_id: r for r in pii.replace_entities(df, counts=True).collect()}
    m = re.fullmatch(r"Mr\. (\S+) (\S+) met Dr\. (\S+) and Prof\. (\S+) (\S+)\. Later (\S+) said hi\.", rows[0].text)
    assert m and m[1] == m[4] == m[6] and m[2] == m[3] == m[5] and not {"John", "Brown"} & set(m.groups())
    assert re.fullmatch(r"My name is (\S+) \S+\. \1 left\.", rows[1].text) and "Peter" not in rows[1].text
    assert "Maria" not in rows[2].text and "Gonzalez" not in rows[2].text and "王小明" not in rows[3].text
    assert re.fullmatch(r"call 0\d\d \d{4} \d{4} or \+44 \d\d \d{4} \d{4}", rows[4].text) and "7946" not in rows[4].text
    one, two, three, four = re.findall(r"\S+@[\w.-]+\w", rows[5].text)
    assert one == two and one.split("@")[1] == three.split("@")[1] != four.split("@")[1] and one != three
    account = rows[6].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1 and rows[6].n_entities == 1


def test_secrets_around_a_length(spark):
    values = [("aB3x" * n)[:n] for n in (199, 200, 201, 5000)]
    texts = [f'x token="{v}" y' for v in values] + [f"x {'l' * n}@example.net y" for n in (64, 65, 300)]
    rows = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), counts=True).collect()}
    assert all(r.n_entities == 1 and r.text.startswith("x ") and r.text.endswith(" y") and r.text != texts[i] for i, r in rows.items())


def test_wrapped_prose_is_kept_and_menus_are_not():
    from helixframe.llm import line_rules

    words = [f"word{i}" for i in range(700)]
    for k in range(34, 700, 35):
        words[k] += "."
    wrapped = "\n".join(" ".join(words[i : i + 14]) for i in range(0, 700, 14))
    assert line_rules.clean(wrapped)["kept"]
    menu = "Noticias\nDeportes\nCultura\nContacto"
    assert line_rules.clean(menu + "\n\n" + wrapped)["cleaned"] == wrapped


def test_generations_run_and_do_not_lose_to_best_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i, 0, 0, int(n), 0, None) for i, n in enumerate(rng.integers(50, 1500, 600))]
    for r in packing.evolution(spark.createDataFrame(rows, packing._PIECES)).collect():
        assert r.generations >= packing.EPOCHS and r.least <= r.n_bins <= r.plain
