"""Repair of the structure of conversations: optional system turn, then user and assistant in turn.

Faults of single rows (blank, duplicate, truncated) are found by Spark's functions on digests of the texts, so that no text
is shuffled for them. A conversation then is a string of one-byte codes and an edit graph: a node is a number of rows read
and a state of the grammar `(s?(ua)+)?`, an arc keeps, rewrites or deletes the next row or inserts a turn. Minimum costs from
the start and to the end tell for every arc whether some cheapest repair takes it (it is tight). A walk along tight arcs that
holds the set of nodes reached by the letters so far, and takes the least letter each time, writes the least cheapest audit.

A second pass streams the texts in order past their conversation's audit and gives the repaired turns. Memory of a task is a
byte a row of one conversation, its audit and the costs of `CHUNK` rows, never its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from helixframe.llm.common import ASCII_SPACE, slices, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with an initial, from each state (None: not allowed).
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "": (None,) * 4}
INITIALS = ("s", "u", "a", "")
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, CUT = range(4)
INFINITE = 1 << 40
#: Rows whose costs to the end are held at a time.
CHUNK = 1 << 16


def arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, state behind, cost) of the arcs that read a row: its code is four times the place of its initial and its fault."""
    initial, fault = INITIALS[code >> 2], code & 3
    found = [("D", state, DELETE)]
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if NEXT[initial][state] is not None:
            found.append(("K", NEXT[initial][state], KEEP + more))
        found += [("R", NEXT[x][state], REROLE + more) for x in "ua" if NEXT[x][state] is not None]
    return found


def inserts(state: int) -> list[tuple[str, int, int]]:
    return [("I", NEXT[x][state], INSERT) for x in "ua" if NEXT[x][state] is not None]


def _settled(costs: list[int], backward: bool) -> tuple[int, tuple[int, ...]]:
    """The costs once turns may be inserted, as their least one and what the others have more."""
    for _ in range(2):  # a third insertion in one place would come back to a state
        for state in range(4):
            for _, to, cost in inserts(state):
                at, other = (state, to) if backward else (to, state)
                costs[at] = min(costs[at], costs[other] + cost)
    least = min(costs)
    return least, tuple(min(c - least, INFINITE) for c in costs)


FROM_START, TO_END = _settled([0, INFINITE, INFINITE, INFINITE], False), _settled([0, INFINITE, INFINITE, 0], True)


@lru_cache(maxsize=1 << 14)
def _before(code: int, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs to the end before a row from those behind it."""
    return _settled([min(costs[to] + cost for _, to, cost in arcs(code, state)) for state in range(4)], True)


@lru_cache(maxsize=1 << 14)
def _behind(code: int, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs from the start behind a row from those before it."""
    out = [INFINITE] * 4
    for state in range(4):
        for _, to, cost in arcs(code, state):
            out[to] = min(out[to], costs[state] + cost)
    return _settled(out, False)


def _backward(codes: bytes, end: tuple[int, tuple[int, ...]]) -> list[tuple[int, tuple[int, ...]]]:
    """Costs to the end before each of the rows and behind the last one."""
    out = [end]
    for code in reversed(codes):
        least, costs = _before(code, out[-1][1])
        out.append((out[-1][0] + least, costs))
    return out[::-1]


def cheapest(codes: bytes, chunk: int = CHUNK) -> tuple[int, str]:
    """Cost and least audit of a conversation's rows, by forward and backward costs and a walk along tight arcs."""
    n = len(codes)
    ends = {n: TO_END}  # costs to the end at the start of each chunk
    for low in reversed(range(0, n, chunk)):
        ends[low] = _backward(codes[low : low + chunk], ends[min(n, low + chunk)])[0]
    total = ends[0][0] + ends[0][1][START]
    letters, frontier, forward = bytearray(), {START}, FROM_START
    for low in range(0, max(n, 1), chunk):
        high = min(n, low + chunk)
        backward = _backward(codes[low:high], ends[high])
        i = low
        while i < high or high == n:
            if i == n and any(forward[0] + forward[1][s] == total and s in (START, ASSISTANT) for s in frontier):
                break  # an audit that ends here is less than one that goes on
            reached: dict[str, set[int]] = {}
            for state in frontier:
                so_far = forward[0] + forward[1][state]
                for letter, to, cost in (arcs(codes[i], state) if i < n else []) + inserts(state):
                    rest = backward[i - low + (letter != "I")]
                    if so_far + cost + rest[0] + rest[1][to] == total:
                        reached.setdefault(letter, set()).add(to)
            letter = min(reached)
            letters += letter.encode()
            frontier = reached[letter]
            if letter != "I":
                least, costs = _behind(codes[i], forward[1])
                forward = (forward[0] + least, costs)
                i += 1
    return total, letters.decode()


def rows(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as the operator takes them: conv_id, turn, role, text (null role or text: one space), copies (1). Other columns are left out."""
    text_or_space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return conversations.select(F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), text_or_space(role).alias("role"), text_or_space(text).alias("text"), F.lit(1).alias("copies"))


def damaged(turns: DataFrame) -> DataFrame:
    """`rows` with a deterministic damage by crc32 of `conv_id:turn` (null: a space) modulo 20: a row is dropped (0 copies), emptied, loses `.!?`, is repeated (2 copies) or gets role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(F.col("copies")).alias("copies"),
    )


def _coded(turns: DataFrame) -> DataFrame:
    """Turns without their texts, equal ones of a conversation as one row: conv_id, turn, role, digest, copies, code, repeated (role and text stood at an earlier turn)."""
    end = F.rtrim("text", F.lit(ASCII_SPACE))
    fault = F.when(end == "", BLANK).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[:3])), F.substring("role", 1, 1)), F.lit(0))
    code = 4 * F.when(place == 0, 3).otherwise(place - 1) + fault
    one = turns.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), code.cast("int").alias("code"), "copies").groupBy("conv_id", "turn", "role", "digest", "code").agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = one.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return one.join(first, same, "left").select("conv_id", "turn", "role", "digest", "code", "copies", F.coalesce(when > F.col("first"), F.lit(False)).alias("repeated"))


def _in_order(df: DataFrame, *first: str) -> DataFrame:
    """A conversation's rows in one task, by turn (nulls first), then role, then digest of the text."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest")


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What a task holds of the conversation that it reads."""

    def __init__(self) -> None:
        self.codes, self.turns, self.low, self.high = bytearray(), 0, None, None

    def add(self, turn: int | None, code: int, copies: int, repeated: bool) -> None:
        if not copies:
            return
        again = code if code & 3 == BLANK else code & ~3 | DUPLICATE
        self.codes.append(again if repeated else code)
        self.codes += bytes((again,)) * (copies - 1)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def report(self) -> tuple:
        codes = bytes(self.codes)
        faults = bytes(c & 3 for c in codes)
        initials = bytes(c >> 2 for c in codes)
        legal = {bytes((INITIALS.index(a), INITIALS.index(b))) for a, b in LEGAL}
        illegal = sum(initials[i : i + 2] not in legal for i in range(len(initials) - 1))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, *cheapest(codes)


def _table(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*done)] or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def audits(turns: DataFrame) -> DataFrame:
    """A row per conversation of `rows` or `damaged`, also of those whose rows are all dropped: see `_AUDIT`.

    Rows go by turn (null turns first), those of one turn by role and digest of the text; each row's first fault counts (blank,
    duplicate, truncated). Null keys are one conversation. Repeated rows are duplicates. A role's initial is its first
    character; other initials than s, u and a (and empty roles) fit nowhere and are rewritten or deleted.
    """
    schema = StructType.fromDDL(_AUDIT)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conversation, done = None, None, []
        for batch in batches:
            for part in slices(batch):
                for key, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if conversation is None or key != now:
                        if conversation:
                            done.append((now, *conversation.report()))
                        now, conversation = key, _Conversation()
                    conversation.add(*row)
            yield _table(done, arrow)
            done.clear()
        if conversation:
            yield _table([(now, *conversation.report())], arrow)

    return _in_order(_coded(turns)).select("conv_id", "turn", "code", "copies", "repeated").mapInArrow(run, schema)


_REPAIRED = "conv_id long, position long, edit string, role string, text string"


def repaired(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """The turns of the repaired conversations, in order within each task: conv_id, position (from 0), edit (K, R or I), role, text.

    Inserted turns have empty texts; kept ones all they had. Conversations that lose all turns have no row.
    """
    schema = StructType.fromDDL(_REPAIRED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edits, at, position, last = None, "", 0, 0, ""
        out: list[tuple] = []

        def put(edit: str, role: str | None, text: str) -> None:
            nonlocal position, last
            role = role if edit == "K" else "assistant" if last == "u" else "user"
            out.append((now, position, edit, role, text))
            position, last = position + 1, role[:1]

        def inserted() -> None:
            nonlocal at
            while edits[at : at + 1] == "I":
                put("I", None, "")
                at += 1

        for batch in batches:
            for part in slices(batch, 3):
                for key, audit, role, text, copies in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if audit is not None:  # the first row of each conversation
                        inserted()
                        now, edits, at, position, last = key, audit, 0, 0, ""
                        continue
                    for _ in range(copies):
                        inserted()
                        if edits[at] != "D":
                            put(edits[at], role, text)
                        at += 1
                yield _table(out, arrow)
                out.clear()
        inserted()
        yield _table(out, arrow)

    texts = turns.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("digest"), F.lit(None).cast("string").alias("audit"), "text", "copies")
    heads = audit.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), "audit", F.lit("").alias("text"), F.lit(0).alias("copies"))
    return _in_order(texts.unionByName(heads), "kind").select("conv_id", "audit", "role", "text", "copies").mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its `role:text` lines, of turns that come in order as `repaired` leaves them."""
    schema = StructType.fromDDL("conv_id long, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for part in slices(batch, 3):
                for key, position, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not position:
                        if state:
                            done.append((now, state.hexdigest()))
                        now, state = key, sha256()
                    state.update(f"{chr(10) if position else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _table(done, arrow)
            done.clear()
        if state:
            yield _table([(now, state.hexdigest())], arrow)

    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, schema)


def repair(turns: DataFrame) -> DataFrame:
    """The audit of every conversation with repaired_sha256, the digest of its repaired `role:text` lines (of the empty string, where no turn is left).

    An empty table gives no rows; null, empty and very long texts are turns like any; columns with other names do not matter to `rows`.
    """
    found = stored(audits(turns), "audits")  # read twice
    of = digests(repaired(turns, found)).withColumnRenamed("conv_id", "c")
    return found.join(of, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())))
