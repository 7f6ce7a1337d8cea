"""Repair of conversation structure by a run-length dynamic program.

A conversation is a row of symbols, one for each message: the initial of its role and whether it must go (blank, duplicate),
is truncated or is sound. Four states tell which roles may follow; the costs of a symbol's edits form a 4 x 4 matrix over
(min, +). Equal neighbouring symbols are one run; a run of n is advanced by the cached binary powers of its matrix, from the
end to the beginning, which leaves the cheapest rest of every state at every run. The choices are then unrolled forwards.

Conversations are dealt out by a range partitioning in the order of their messages, so that one of any length is cut into
blocks: the matrices of its blocks are composed, and every block unrolls its own messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import CRC32_SQL, CRC_TABLE_SQL, slices, staged

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what stands last in the repaired conversation
FAR = 1 << 50
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
BLANKS = "\t\n\x0b\x0c\r "
SOUND, TRUNCATED, GOES = range(3)
NAMES = {USER: "user", ASSISTANT: "assistant"}

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


@dataclass(frozen=True)
class RepairOptions:
    """block: most messages of one conversation that are solved at once, bytes: most characters; a longer one is cut into blocks."""

    block: int = 20_000
    bytes: int = 16_000_000


# ---- the dynamic program ----------------------------------------------------------------------------------------------


def _following(state: int) -> int:
    """The state after a user or assistant message that fits."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after keeping a message, None where it doesn't fit."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    return {"u": USER, "a": ASSISTANT}.get(initial) if _following(state) == {"u": USER, "a": ASSISTANT}.get(initial) else None


def times(a: Matrix, b: Matrix) -> Matrix:
    """Product over (min, +)."""
    columns = list(zip(*b))
    return tuple(tuple(min(min(x + y for x, y in zip(row, col)), FAR) for col in columns) for row in a)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


IDENTITY: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def _insertions() -> Matrix:
    one = tuple(tuple(INSERT_COST if j == _following(i) else 0 if i == j else FAR for j in range(4)) for i in range(4))
    return times(times(one, one), one)


INSERTIONS = _insertions()
#: Cheapest way from each state to an end that is allowed: nothing left, or an assistant's message last.
AT_END: Vector = apply(INSERTIONS, tuple(0 if s in (EMPTY, ASSISTANT) else FAR for s in range(4)))


@lru_cache(maxsize=None)
def edits(symbol: tuple[str, int]) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits (letter, cost, next state) that consume a message of this symbol, letters ascending."""
    initial, fault = symbol
    extra, out = TRUNCATED_COST if fault == TRUNCATED else 0, []
    for state in range(4):
        own = [("D", DELETE_COST, state)]
        if fault != GOES:
            if _kept(state, initial) is not None:
                own.append(("K", KEEP_COST + extra, _kept(state, initial)))
            own.append(("R", REROLE_COST + extra, _following(state)))
        out.append(tuple(own))
    return tuple(out)


@lru_cache(maxsize=None)
def power(symbol: tuple[str, int], k: int) -> Matrix:
    """Matrix of 2 ** k messages of one symbol, insertions before each included."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    one = [[FAR] * 4 for _ in range(4)]
    for state, own in enumerate(edits(symbol)):
        for _, cost, after in own:
            one[state][after] = min(one[state][after], cost)
    return times(INSERTIONS, tuple(tuple(row) for row in one))


@lru_cache(maxsize=100_000)
def before_run(symbol: tuple[str, int], n: int, rest: Vector) -> Vector:
    """Cheapest rest of each state before a run, from the one after it."""
    k = 0
    while n:
        if n & 1:
            rest = apply(power(symbol, k), rest)
        n, k = n >> 1, k + 1
    return rest


def matrix_of(runs: list[tuple[tuple[str, int], int]]) -> Matrix:
    """Matrix of several runs."""
    found = IDENTITY
    for symbol, n in runs:
        k = 0
        while n:
            if n & 1:
                found = times(found, power(symbol, k))  # powers of one matrix commute
            n, k = n >> 1, k + 1
    return found


def relative(v: Vector) -> tuple[Vector, int]:
    low = min(v)
    return tuple(x - low for x in v), low


@lru_cache(maxsize=100_000)
def choices(symbol: tuple[str, int], rest: Vector) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """One message, given the (relative) cheapest rest after it: the rest before it, and for each state the letters of the
    cheapest edits, insertions before the message first, and the state after them. Of equal costs the ASCII-least letter."""
    before = before_run(symbol, 1, rest)
    out = []
    for state in range(4):
        letters = ""
        while True:
            left = before[state]
            found = {letter: after for letter, cost, after in edits(symbol)[state] if cost + rest[after] == left}
            if "D" in found:
                letters, state = letters + "D", found["D"]
            elif INSERT_COST + before[_following(state)] == left:
                letters, state = letters + "I", _following(state)
                continue
            else:
                letter = min(found)
                letters, state = letters + letter, found[letter]
            break
        out.append((letters, state))
    return relative(before)[0], tuple(out)


def rests(runs: list[tuple[tuple[str, int], int]], end: Vector) -> tuple[list[Vector], int]:
    """Relative cheapest rest after each run, and the absolute one of the EMPTY state before all."""
    found, rest, total = [], *relative(end)
    for symbol, n in reversed(runs):
        found.append(rest)
        rest, low = relative(before_run(symbol, n, rest))
        total += low
    return found[::-1], total + rest[EMPTY]


def unroll(runs: list[tuple[tuple[str, int], int]], after: list[Vector], state: int) -> tuple[list[str], int]:
    """Letters of the edits for each message, and the last state."""
    letters = []
    for (symbol, n), rest in zip(runs, after):
        own = []
        for _ in range(n):
            rest, chosen = choices(symbol, rest)
            own.append(chosen)
        for chosen in reversed(own):
            found, state = chosen[state]
            letters.append(found)
    return letters, state


def final_letters(state: int) -> str:
    return {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]


def repaired(messages: list[tuple[str, str]], letters: list[str], state: int, last: str = "") -> list[tuple[str, str]]:
    """(role, text) of the messages that are left when the edits are carried out from a state."""
    out = []
    for (role, text), own in zip([*messages, ("", "")], [*letters, last]):
        for letter in own:
            if letter == "D":
                continue
            if letter == "K":
                state = _kept(state, role[:1])
                out.append((role, text))
            else:
                state = _following(state)
                out.append((NAMES[state], text if letter == "R" else ""))
    return out


# ---- conversations as blocks ------------------------------------------------------------------------------------------


def fault_of(role: str, text: str, seen: set) -> str:
    """blank, duplicate, truncated or nothing; messages that aren't blank are remembered in `seen`."""
    core = text.rstrip(BLANKS)
    if not core:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return "" if core[-1] in ".!?" else "truncated"


def symbols(messages: list[tuple[str, str]], faults: list[str]) -> list[tuple[tuple[str, int], int]]:
    """Runs of equal symbols. Roles other than system, user and assistant share one initial; of what goes the role is of no account."""
    kinds = {"": SOUND, "truncated": TRUNCATED, "blank": GOES, "duplicate": GOES}
    row = [("-" if f in ("blank", "duplicate") else r[:1] if r[:1] in ("s", "u", "a") else "-", kinds[f]) for (r, _), f in zip(messages, faults)]
    return [(symbol, len(list(own))) for symbol, own in groupby(row)]


def counts(turns: list[int | None], messages: list[tuple[str, str]], faults: list[str]) -> dict:
    """What is counted of a block; sums() joins the counts of neighbouring blocks."""
    initials = [r[:1] for r, _ in messages]
    known = [t for t in turns if t is not None]
    return {
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "first": initials[0] if initials else None,
        "last": initials[-1] if initials else None,
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "turns": len(set(known)),
    }


def sums(blocks: list[dict]) -> dict:
    """Counts of a conversation from those of its blocks, in order (turns ascend, so the ends tell what neighbours share)."""
    total = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal")}
    filled = [b for b in blocks if b["first"] is not None]
    total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(filled, filled[1:]))
    known = [b for b in blocks if b["low"] is not None]
    distinct = sum(b["turns"] for b in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    total["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
    return total


def as_text(turns: list[tuple[str, str]]) -> str:
    return "\n".join([f"{role}:{text}" for role, text in turns])


def solve(turns: list[int | None], messages: list[tuple[str, str]]) -> dict:
    """A whole conversation."""
    seen: set = set()
    faults = [fault_of(r, t, seen) for r, t in messages]
    runs = symbols(messages, faults)
    after, cost = rests(runs, AT_END)
    letters, state = unroll(runs, after, EMPTY)
    last = final_letters(state)
    done = repaired(messages, letters, EMPTY, last)
    return {**sums([counts(turns, messages, faults)]), "cost": cost, "audit": "".join(letters) + last, "turns_left": len(done), "repaired": as_text(done)}


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
WHOLE = pa.schema([*[(c, pa.int64()) for c in TOTALS], ("audit", pa.string()), ("turns_left", pa.int64()), ("repaired", pa.string())])
OPEN = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns_left long, repaired string, "
    "block long, at long, turn long, role string, text string, fault string"
)
_ARROW = pa.schema([("conv_id", pa.int64()), *WHOLE, *OPEN])


def _walk(o: RepairOptions):
    """Messages of one partition, in order. Conversations that lie inside it are solved; the first and the last one, which
    neighbours may share, and those longer than a block leave as messages, each with its fault inside its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        out, waiting, size = [], 0, 0  # rows and characters that wait to leave, characters of the conversation at hand
        at: list = []  # the conversation at hand, as a list of one id
        shared, held = True, []

        def opened() -> None:
            """The messages at hand leave as a block."""
            nonlocal serial, held
            seen: set = set()
            for k, (turn, role, text, gone) in enumerate(held):
                fault = "gone" if gone else fault_of(role, text, seen)
                out.append({"conv_id": at[0], "block": (part << 32) + serial, "at": k, "turn": turn, "role": role, "text": text, "fault": fault})
            serial, held = serial + 1, []

        def closed() -> None:
            nonlocal held
            left = [(t, r, x) for t, r, x, gone in held if not gone]
            out.append({"conv_id": at[0], **solve([t for t, _, _ in left], [(r, x) for _, r, x in left])})
            held = []

        for batch in slices(batches, "text"):
            for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
                if [conv] != at:
                    if at:
                        (opened if shared else closed)()
                        shared = False
                    at, size = [conv], 0
                held.append((turn, role, text, gone))
                size, waiting = size + len(text), waiting + len(text)
                if len(held) >= o.block or size >= o.bytes:
                    shared, size = True, 0
                    opened()
                if out and (waiting > 4_000_000 or len(out) > 5000):
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out, waiting = [], 0
        if at and (held or shared):
            opened()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def _blocks(work: Callable[[int, list[dict]], list[dict]], schema: pa.Schema):
    """Call work(block, messages) for each block of rows sorted by (block, at); a block is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches, "text") for row in batch.to_pylist())
        for block, own in groupby(rows, key=lambda r: r["block"]):
            found = work(block, list(own))
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


def _of_block(rows: list[dict]) -> tuple[list, list[tuple[str, str]], list[str]]:
    rows = [r for r in rows if r["fault"] != "gone"]
    return [r["turn"] for r in rows], [(r["role"], r["text"]) for r in rows], [r["fault"] for r in rows]


_COUNTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
_COUNTS += [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())]
_MANY = pa.list_(pa.int64())


def _summary(block: int, rows: list[dict]) -> list[dict]:
    turns, messages, faults = _of_block(rows)
    flat = [x for row in matrix_of(symbols(messages, faults)) for x in row]
    return [{"conv_id": rows[0]["conv_id"], "block": block, "matrix": flat, **counts(turns, messages, faults)}]


def _ends(table: pa.Table) -> pa.Table:
    """Blocks of one conversation: the cheapest rest after each, and the totals."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    rest, found = AT_END, []
    for r in reversed(rows):
        found.append({"block": r["block"], "rest": relative(rest)[0]})
        rest = apply(tuple(tuple(r["matrix"][k : k + 4]) for k in (0, 4, 8, 12)), rest)
    total = {**sums(rows), "cost": rest[EMPTY]}
    return pa.Table.from_pylist([{**f, **total} for f in found], schema=pa.schema([("block", pa.int64()), ("rest", _MANY), *[(c, pa.int64()) for c in TOTALS]]))


def _exits(block: int, rows: list[dict]) -> list[dict]:
    """The state after a block for each state before it."""
    _, messages, faults = _of_block(rows)
    runs = symbols(messages, faults)
    after, _ = rests(runs, tuple(rows[0]["rest"]))
    return [{"conv_id": rows[0]["conv_id"], "block": block, "exits": [unroll(runs, after, s)[1] for s in range(4)]}]


def _entries(table: pa.Table) -> pa.Table:
    """The state before each block of one conversation, and after its last one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    state, found = EMPTY, []
    for k, r in enumerate(rows):
        found.append({"block": r["block"], "state": state, "piece": k, "pieces": len(rows)})
        state = r["exits"][state]
    return pa.Table.from_pylist(found, schema=pa.schema([(c, pa.int64()) for c in ("block", "state", "piece", "pieces")]))


def _pieces(block: int, rows: list[dict]) -> list[dict]:
    """Letters and messages of one block."""
    _, messages, faults = _of_block(rows)
    runs, first = symbols(messages, faults), rows[0]
    after, _ = rests(runs, tuple(first["rest"]))
    letters, state = unroll(runs, after, first["state"])
    last = final_letters(state) if first["piece"] + 1 == first["pieces"] else ""
    done = repaired(messages, letters, first["state"], last)
    return [{**{c: first[c] for c in ("conv_id", "piece", "pieces", *TOTALS)}, "audit": "".join(letters) + last, "turns_left": len(done), "repaired": as_text(done)}]


OUT = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("pieces", pa.int64()), *WHOLE])
OUT_DDL = "conv_id long, piece long, pieces long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns_left long, repaired string"


def _solve_open(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Pieces of the conversations that left as messages."""
    rows = rows.select("conv_id", "block", "at", "turn", "role", "text", "fault")
    # a message is a duplicate if an earlier block has its first equal; inside a block that is known, so no key is hot
    new = rows.filter("fault IN ('', 'truncated')").select("conv_id", "block", "at", "role", F.sha2("text", 256).alias("digest"))
    first = new.groupBy("conv_id", "role", "digest").agg(F.min("block").alias("home"), F.count("*").alias("k")).filter("k > 1")
    same = new["conv_id"].eqNullSafe(first["conv_id"]) & (new["role"] == first["role"]) & (new["digest"] == first["digest"])
    later = new.join(first, same).filter("block <> home").select("block", "at", F.lit(True).alias("again"))
    marked = rows.join(later, ["block", "at"], "left").withColumn("fault", F.when(F.col("again"), F.lit("duplicate")).otherwise(F.col("fault"))).drop("again")
    marked = staged(spark, marked, "messages")

    def each_block(df: DataFrame, work, schema: pa.Schema, ddl: str) -> DataFrame:
        return df.repartition("block").sortWithinPartitions("block", "at").mapInArrow(_blocks(work, schema), ddl)

    summary = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("matrix", _MANY), *_COUNTS])
    ddl = "conv_id long, block long, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
    totals = ", ".join(f"{c} long" for c in TOTALS)
    ends = each_block(marked, _summary, summary, ddl).groupBy("conv_id").applyInArrow(_ends, f"block long, rest array<long>, {totals}")
    marked = marked.join(staged(spark, ends, "ends"), "block")
    exits = each_block(marked, _exits, pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("exits", _MANY)]), "conv_id long, block long, exits array<long>")
    entries = exits.groupBy("conv_id").applyInArrow(_entries, "block long, state long, piece long, pieces long")
    return each_block(marked.join(staged(spark, entries, "entries"), "block"), _pieces, OUT, OUT_DDL)


def repair(spark: SparkSession, rows: DataFrame, options: RepairOptions = RepairOptions()) -> DataFrame:
    """Cheapest repair of each conversation of rows (conv_id, turn, role, text[, gone]).

    One row per conversation and piece: conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost (of the whole
    conversation), audit and repaired text of the piece, turns_left. Conversations have one piece unless they are longer than a
    block or lie across a partition border; pieces joined in order are the whole, texts by line breaks.

    Messages are taken by turn, missing turns first; those of one turn by role, then by a hash of the text. A missing role or text
    reads as one space. Messages without conv_id form one conversation. Rows marked `gone` count as absent, but their
    conversation is returned. Repeated rows are duplicates; other columns are ignored; an empty table gives no rows.
    """
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), whole("role"), whole("text"), gone.alias("gone"))
    plain = plain.withColumns({"_order": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})  # equal rows may lie on both sides of a border
    order = ["conv_id", "turn", "role", "_order"]
    sorted_rows = plain.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "text", "_row")
    walked = staged(spark, sorted_rows.select("conv_id", "turn", "role", "text", "gone").mapInArrow(_walk(options), SCHEMA), "conversations")
    inside = walked.filter("block IS NULL").select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), *WHOLE.names)
    return inside.unionByName(_solve_open(spark, walked.filter("block IS NOT NULL")))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with faults planted by crc32(`conv_id:turn`) % 20: 0 drops the row (marked
    gone), 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes it the user's. Missing values read as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    planted = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(planted == 1, F.lit("")).when(planted == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(planted == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(planted == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), (planted == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order; the hash runs over them as they pass."""
    import hashlib

    at, total, letters, state, any_left = None, None, [], None, False

    def flush() -> pa.RecordBatch:
        row = {**total, "audit": "".join(letters), "repaired_sha256": state.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in TOTALS], ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    for batch in slices(batches, "repaired"):
        for row in batch.to_pylist():
            if at != [row["conv_id"]]:
                if at:
                    yield flush()
                at, total = [row["conv_id"]], {c: row[c] for c in ("conv_id", *TOTALS)}
                letters, state, any_left = [], hashlib.sha256(), False
            letters.append(row["audit"])
            if row["turns_left"]:
                state.update(("\n" if any_left else "").encode() + row["repaired"].encode("utf-8", "surrogatepass"))
                any_left = True
    if at:
        yield flush()


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Only the
    pieces of conversations that have several are shuffled; a hash has to see them one after another."""
    whole = pieces.filter("pieces = 1").select("conv_id", *TOTALS, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    several = pieces.filter("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", *TOTALS, "audit", "turns_left", "repaired")
    totals = ", ".join(f"{c} long" for c in TOTALS)
    return whole.unionByName(several.mapInArrow(_digest, f"conv_id long, {totals}, audit string, repaired_sha256 string"))


def _plus(path: str, cost: int | str, letter: str) -> str:
    """SQL: a path (cost in twelve digits, then letters) with one more edit. Paths sort by cost, then by letters."""
    return f"(printf('%012d', CAST(substr({path}, 1, 12) AS BIGINT) + {cost}) || substr({path}, 13) || '{letter}')"


_AFTER_INSERTS = f"""
      SELECT *, least(a, {_plus('u2', 5, 'I')}) AS a2 FROM (SELECT *, least(u, {_plus('e', 5, 'I')}, {_plus('s', 5, 'I')}, {_plus('a', 5, 'I')}) AS u2 FROM @@)"""
#: The same rows by a recursion over messages with the best path into each state: empty, system, user, assistant last.
SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}
  plain AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS bytes
    FROM conversations),
  planted AS (
    SELECT conv_id, turn, role, text, {CRC32_SQL} % 20 AS h
    FROM plain, crc_table),
  damaged AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
      CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM planted WHERE h <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS core FROM damaged),
  judged AS (
    SELECT conv_id, i, turn, role, text, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
  counted AS (
    SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS rows FROM judged GROUP BY conv_id),
  coded AS (SELECT conv_id, i, left(role, 1) AS x, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
  step AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM conversations
    UNION ALL
    SELECT conv_id, i, {_plus('e', 2, 'D')},
      least({_plus('s', 2, 'D')}, CASE WHEN NOT must AND x = 's' THEN {_plus('e', '0 + extra', 'K')} END),
      least({_plus('u2', 2, 'D')}, CASE WHEN NOT must THEN least({_plus('e', '1 + extra', 'R')}, {_plus('s', '1 + extra', 'R')}, {_plus('a2', '1 + extra', 'R')}) END,
        CASE WHEN NOT must AND x = 'u' THEN least({_plus('e', '0 + extra', 'K')}, {_plus('s', '0 + extra', 'K')}, {_plus('a2', '0 + extra', 'K')}) END),
      least({_plus('a2', 2, 'D')}, CASE WHEN NOT must THEN {_plus('u2', '1 + extra', 'R')} END, CASE WHEN NOT must AND x = 'a' THEN {_plus('u2', '0 + extra', 'K')} END)
    FROM ({_AFTER_INSERTS.replace("@@", '(SELECT c.conv_id, c.i, p.e, p.s, p.u, p.a, c.x, c.must, c.extra FROM step p JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1)')})),
  ended AS (
    SELECT conv_id, least(e, a2) AS found FROM ({_AFTER_INSERTS.replace("@@", '(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM step) WHERE back = 1)')})),
  letters AS (SELECT conv_id, substr(found, 13) AS audit, unnest(range(1, length(found) - 11)) AS p FROM ended),
  marks AS (
    SELECT conv_id, p, substr(audit, p, 1) AS letter, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p - 1), 'D', '')) AS before FROM letters),
  built AS (
    SELECT m.conv_id, p, letter, before, role, text, max(before = 0 AND letter = 'K' AND role[1] = 's') OVER (PARTITION BY m.conv_id) AS opened
    FROM marks m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.i = m.i WHERE letter <> 'D'),
  joined AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (before - opened::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired
    FROM built GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(substr(found, 1, 12) AS BIGINT) AS cost, substr(found, 13) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM e.conv_id
"""
