"""Divergence audit of sources: how each source of a language differs from the others and from its language, term by term.

Everything is a sort and a scan. Tasks count the terms of their texts by (lang, source) and give sorted runs: a run has a
term, its first document, its number of documents and of occurrences. Runs are dealt by (lang, term, source), sorted by that
and document, and a run-length scan adds them up; dealt by (lang, term) and sorted by source, a second scan keeps the terms
of enough documents. A third scan of the kept terms has the totals of all sources of a language sorted before the terms
(so nothing is broadcast) and gives partial sums of pairs and the best terms of each run, which Spark adds up.

Counting before the first shuffle makes a common term one row a task, source and bundle, whatever its share of the text. Sums of pairs
are kept for a bounded number of cells and given out when they exceed it, so a task's memory grows with one language's
sources, not with their square. Arithmetic is on integers of 64 bits throughout, with long division where products would not fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import drop_stored, slices, stored

LEAST_DOCUMENTS, SCALE, RANKS = 10, 1_000_000_000, 10
#: Different terms that a task counts before it gives out its runs, entries of the third scan in a group of terms, and cells of pairs a task holds.
BUNDLE, PART_ENTRIES, CELLS = 300_000, 250_000, 1 << 21
#: Bytes to letters: A-Z lowered, what is not a letter or above ASCII to a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_RUNS = "lang string, term string, source string, document long, documents long, n long"


def terms(text: bytes) -> list[bytes]:
    """Matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lowered; all separators are ASCII, so bytes will do."""
    return text.translate(_LETTERS).split()


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Runs of the terms within the bundles of each task, see `_RUNS`; every (lang, source) also has the empty term, in all its documents with no occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter, list[int]]] = {}

        def runs() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, documents, first) in groups.items():
                names = sorted(n)
                width = len(names)
                columns = [
                    pa.repeat(a, width), pa.array(names, pa.binary()).cast(pa.string()), pa.repeat(b, width), pa.repeat(pa.scalar(first[0], pa.int64()), width),
                    pa.array([documents[x] for x in names], pa.int64()), pa.array([n[x] for x in names], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "document", "documents", "n"])
            groups.clear()

        for batch in batches:
            for part in slices(batch, 3):
                for a, b, document, said in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    n, documents, first = groups.setdefault((a, b), (Counter({b"": 0}), Counter(), [document]))
                    found = terms(said)
                    n.update(found)
                    documents.update(set(found))
                    documents[b""] += 1
                    first[0] = min(first[0], document)
                if sum(len(n) for n, _, _ in groups.values()) > BUNDLE:
                    yield from runs()
        yield from runs()

    known = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    columns = docs.select(known(lang).alias("lang"), known(source).alias("source"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("document"), known(text).cast("binary").alias("text"))
    return columns.mapInArrow(run, _RUNS)


def _starts(keys: list[pa.Array]) -> np.ndarray:
    """Rows that differ from the row before in one of the keys, as places; the first row is one."""
    n = len(keys[0])
    differs = np.zeros(n, dtype=bool)
    if n:
        differs[0] = True
    for k in keys:
        differs[1:] |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs)


def _whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The batches cut anew behind the last row of a run of the first `keys` columns; what is carried over is one run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts([batch.column(k) for k in range(keys)])
        goes_on = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        if len(starts) == 1 and goes_on:
            held.append(batch)
            continue
        head = batch.slice(0, starts[-1])
        if held or head.num_rows:
            yield pa.Table.from_batches([*held, head]).combine_chunks().to_batches()[0]
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _int(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def added(runs: DataFrame) -> DataFrame:
    """The run-length scan: a row per (lang, term, source) with its first document, documents and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts([batch.column(k) for k in range(3)])
            now = batch.take(pa.array(starts))
            sums = [np.add.reduceat(_int(batch.column(k)), starts) for k in (4, 5)]
            now = pa.RecordBatch.from_arrays([*now.columns[:4], *map(pa.array, sums)], schema=batch.schema)
            if last is not None:
                if last[:3] == [c[0].as_py() for c in now.columns[:3]]:
                    first = [*last[:4], *(last[k] + now.column(k)[0].as_py() for k in (4, 5))]
                    now = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(first, batch.schema)], schema=batch.schema), now.slice(1)]).combine_chunks().to_batches()[0]
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(last, batch.schema)], schema=batch.schema)
            last = [c[-1].as_py() for c in now.columns]
            yield now.slice(0, now.num_rows - 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(last, now.schema)], schema=now.schema)

    return runs.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source", "document").mapInArrow(run, _RUNS)


def kept(runs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, n, first (1 on one row of each term): the terms of at least `least` documents of their language, and all empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, 2):
            starts = _starts([batch.column(0), batch.column(1)])
            enough = (np.add.reduceat(_int(batch.column(3)), starts) >= least) | pc.equal(batch.column(1).take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
            first = np.zeros(batch.num_rows, dtype=np.int32)
            first[starts] = 1
            stay = pa.array(np.repeat(enough, np.diff([*starts, batch.num_rows])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(first)], names=["lang", "term", "source", "n", "first"]).filter(stay)

    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.select("lang", "term", "source", "documents", "n").mapInArrow(run, "lang string, term string, source string, n long, first int")


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total), in three steps of 1000 so that no product exceeds 64 bits; 0 where the total is 0."""
    out, rest = np.zeros(np.broadcast(n, total).shape, dtype=np.int64), n
    safe = np.maximum(total, 1)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // safe
        rest = rest % safe
    return np.where(total > 0, out + 1, 0)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


class _Language:
    """A language's sources in one task: their totals, shares of terms that do not occur, sums of pairs and best terms."""

    def __init__(self, lang: str, sources: pa.Array, totals: np.ndarray, total: int, v: int, base: bool):
        self.lang, self.sources, self.totals, self.total = lang, sources, totals, total
        self.none = share(np.full(len(totals), 2), totals)
        self.rows: dict[int, np.ndarray] = {}
        self.best: tuple[np.ndarray, np.ndarray, pa.Array] = (np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.string()))
        self.v, self.base = v, base

    def pairs(self, rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Each row of sums twice, once for either source of the pair; sums are of doubled values."""
        width = len(self.sources)
        for s, sums in rows.items():
            others = np.flatnonzero(np.arange(width) != s)
            there, here = self.sources.take(pa.array(others)), pa.repeat(self.sources[s], len(others))
            for a, b in ((here, there), (there, here)):
                yield self.table(a, "pair", b, sums[others])

    def table(self, source, part: str, item, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.repeat(self.lang, n), source, pa.repeat(part, n), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def add(self, source: pa.Array, term: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole terms, in order."""
        starts = _starts([term])
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(n)]))
        place = _int(pc.index_in(source, self.sources))
        p = share(n + 2, self.totals[place])
        q = share(np.add.reduceat(n, starts) + 2, np.full(len(starts), self.total))[of]
        over = np.flatnonzero(p > q)
        self.keep_best(place[over], divergence(p[over], q[over]), term.take(pa.array(over)))
        step = max(1, CELLS // len(self.sources))
        for low in range(0, len(n), step):
            yield from self.add_pairs(place, p, of, low, min(len(n), low + step))

    def add_pairs(self, place: np.ndarray, p: np.ndarray, of: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Every entry of low..high against its term's shares in all sources, above what two absent terms would give.

        An entry has the doubled difference where the other source lacks the term, and the single one where that source's own
        entry has it too.
        """
        first, last = np.searchsorted(of, of[low]), np.searchsorted(of, of[high - 1], side="right")
        shares = np.tile(self.none, (of[high - 1] - of[low] + 1, 1))
        times = np.full(shares.shape, 2, dtype=np.int64)
        shares[of[first:last] - of[low], place[first:last]] = p[first:last]
        times[of[first:last] - of[low], place[first:last]] = 1
        row, s = of[low:high] - of[low], place[low:high]
        more = (divergence(p[low:high, None], shares[row]) - divergence(self.none[s][:, None], self.none[None, :])) * times[row]
        order = np.argsort(s, kind="stable")
        starts = np.flatnonzero(np.diff(s[order], prepend=-1))
        for k, sums in zip(s[order][starts].tolist(), np.add.reduceat(more[order], starts)):
            self.rows[k] = self.rows[k] + sums if k in self.rows else sums
        if len(self.rows) * len(self.sources) > CELLS:
            yield from self.pairs(self.rows)
            self.rows.clear()

    def keep_best(self, place: np.ndarray, value: np.ndarray, term: pa.Array) -> None:
        """The RANKS terms of the largest values of each source; equal values keep the order of terms, in which they come."""
        place, value = np.concatenate([self.best[0], place]), np.concatenate([self.best[1], value])
        term = pa.concat_arrays([self.best[2], term])
        order = np.lexsort((-value, place))
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
        stay = np.sort(order[rank < RANKS])
        self.best = (place[stay], value[stay], term.take(pa.array(stay)))

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.pairs(self.rows)
        place, value, term = self.best
        yield self.table(self.sources.take(pa.array(place)), "term", term, value)
        if self.base:  # one task a language has what all terms would give if no source had them; doubled, and shared by the pair's two rows
            for s in range(len(self.sources)):
                yield from self.pairs({s: divergence(self.none[s], self.none) * self.v})


_PARTIAL = "lang string, source string, part string, item string, value long"


def partial(entries: DataFrame, totals: DataFrame, parts: int) -> DataFrame:
    """The third scan. entries: lang, term, source, n of kept terms; totals: lang, source, total, lang_total, v. Gives partial rows, pairs doubled."""
    terms_of = entries.select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", "source", "n", F.lit(0).cast("long").alias("lang_total"), F.lit(0).cast("long").alias("v"))
    heads = totals.select("lang", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit("").alias("term"), "source", F.col("total").alias("n"), "lang_total", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = None
        for batch in _whole(batches, 3):
            for low, high in zip(starts := _starts([batch.column(0), batch.column(1)]).tolist(), [*starts[1:], batch.num_rows]):
                group = batch.slice(low, high - low)
                if group.column(2)[0].as_py() == "":  # the totals of a group of terms come first
                    if language:
                        yield from language.close()
                    width = int(np.searchsorted(pc.not_equal(group.column(2), "").to_numpy(zero_copy_only=False), True))
                    head, group = group.slice(0, width), group.slice(width)
                    language = _Language(head.column(0)[0].as_py(), head.column(3), _int(head.column(4)), head.column(5)[0].as_py(), head.column(6)[0].as_py(), head.column(1)[0].as_py() == 0)
                if group.num_rows:
                    yield from language.add(group.column(3), group.column(2), _int(group.column(4)))
        if language:
            yield from language.close()

    return terms_of.unionByName(heads).repartition("lang", "part").sortWithinPartitions("lang", "part", "term", "source").mapInArrow(run, _PARTIAL)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source): `pair` rows against all other sources of the language, the best `term` rows.

    Every row is a document, repeated rows and ids too. Null texts, langs and sources count as empty strings, which are names
    like any; groups without terms have pairs of value 0 or what the others' terms give, and no terms. A language with one source has
    no pairs. Equal values rank by the item's UTF-8 bytes. An empty table gives no rows; other columns are ignored.
    """
    entries = stored(kept(added(counted(docs, text, lang, source, key)), least), "divergence-terms")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = entries.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("term") != "", F.col("first")).otherwise(0)).alias("v"))
    totals = stored(totals.join(langs, F.col("lang") == F.col("l")).select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("all") + 2 * F.col("v")).alias("lang_total"), "v"), "divergence-totals")
    real = entries.where("term != ''").select("lang", "term", "source", "n")
    found = stored(partial(real, totals, max(1, -(-real.count() // PART_ENTRIES))).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence-rows")
    drop_stored(entries)
    drop_stored(totals)
    ranked = found.withColumn("value", F.when(F.col("part") == "pair", F.expr("value div 2")).otherwise(F.col("value")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= RANKS))
