"""Conversation repair: the walk against all edits, odd rows, and what repaired conversations are."""

import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import repair

GRAMMAR = re.compile("(s?(ua)+)?")


def plain(rows):
    """(cost, audit) by all prefixes of edits, cheapest first; a row is (initial, fault)."""
    best = {("", 0): (0, "")}  # (what the output ends with, rows read)

    def spread(best):
        for _ in range(3):
            for (end, i), (cost, audit) in list(best.items()):
                other = "a" if end == "u" else "u"
                offer = (cost + 5, audit + "I")
                best[other, i] = min(best.get((other, i), offer), offer)
        return best

    for i, (initial, fault) in enumerate(rows):
        best, now = {}, spread(best)
        for (end, _), (cost, audit) in now.items():
            other, more = "a" if end == "u" else "u", 5 if fault == "truncated" else 0
            offers = [(end, cost + 2, "D")]
            if fault in ("", "truncated"):
                offers.append((other, cost + 1 + more, "R"))
                if initial == other or initial == "s" and end == "":
                    offers.append((initial, cost + more, "K"))
            for to, c, letter in offers:
                best[to, i + 1] = min(best.get((to, i + 1), (c, audit + letter)), (c, audit + letter))
    best = spread(best)
    return min(best[end, len(rows)] for end in ("", "a") if (end, len(rows)) in best)


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", ""]), st.sampled_from(["", "", "blank", "duplicate", "truncated"])), max_size=9)


@given(ROWS, st.integers(1, 4))
@settings(max_examples=400, deadline=None)
def test_walk_is_the_cheapest_and_least_edit(rows, chunk):
    faults = ["", "blank", "duplicate", "truncated"]
    codes = bytes(4 * repair.INITIALS.index(i) + faults.index(f) for i, f in rows)
    assert repair.cheapest(codes, chunk) == plain(rows)


def judged(rows):
    """Initials and faults of a conversation's rows (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
    return out


@pytest.fixture(scope="module")
def odd():
    long = "word " * 100_000 + "end."
    return [
        (1, 0, "user", "Hello?"), (1, 1, "assistant", long), (1, 1, "assistant", long), (1, 5, "tool", "no end"), (1, None, "system", "Be kind."), (2, None, None, None), (3, 7, "", "x."), (3, 8, "uncle", "odd."),
        (4, 0, "assistant", "late."), (None, 0, "user", "who?"), (None, 1, "assistant", "nobody."), (5, 0, "user", "\t\n"), (6, 0, "user", "q?"), (6, 0, "user", "q?"), (6, 1, "assistant", "Ü…."),
    ]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(*r, "mine") for r in odd], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = {r.conv_id: r for r in repair.repair(repair.rows(df)).collect()}
    assert set(got) == {r[0] for r in odd}
    for key, r in got.items():
        own = sorted((t is not None, t or 0, role if role is not None else " ", text if text is not None else " ") for k, t, role, text in odd if k == key)
        rows = [(role, text) for _, _, role, text in own]
        faults = [f for _, f in judged(rows)]
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(faults.count, ("blank", "duplicate", "truncated")))
        assert (r.cost, r.audit) == plain(judged(rows))
        turns = {t for k, t, *_ in odd if k == key and t is not None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        out, left = [], iter(rows)
        for e in r.audit:
            role, text = ("", "") if e == "I" else next(left)
            if e != "D":
                out.append((role if e == "K" else "assistant" if out and out[-1][0][:1] == "u" else "user", text))
        assert GRAMMAR.fullmatch("".join(role[0] for role, _ in out))
        assert r.repaired_sha256 == sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    assert repair.repair(repair.rows(df.limit(0))).collect() == []


def test_dropped_conversations_stay_and_inserts_are_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "only.", 1), (2, 1, "user", "more.", 1), (2, 2, "assistant", "yes.", 2)], "conv_id long, turn long, role string, text string, copies int")
    one, two = repair.repair(turns).orderBy("conv_id").collect()
    assert (one.audit, one.cost, one.blank, one.repaired_sha256) == ("", 0, 0, sha256(b"").hexdigest())
    assert (two.audit, two.cost, two.duplicate, two.illegal) == ("DKKD", 4, 1, 2)
    alone = spark.createDataFrame([(1, 0, "user", "q.", 1), (1, 1, "assistant", "a.", 1), (1, 2, "user", "cut", 1)] + [(1, k, "user", f"{k}.", 1) for k in range(3, 5)], turns.schema)
    kept = repair.repaired(alone, repair.audits(alone)).orderBy("position").collect()
    assert GRAMMAR.fullmatch("".join(r.role[0] for r in kept)) and [r.position for r in kept] == list(range(len(kept)))


def test_one_long_conversation(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    (row,) = repair.repair(repair.rows(df)).collect()
    assert row.audit == "K" * n and row.cost == 0 and row.repaired_sha256 == sha256("\n".join(f"{'assistant' if k % 2 else 'user'}:{k}." for k in range(n)).encode()).hexdigest()
