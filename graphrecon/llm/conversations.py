"""Repair of conversations: the cheapest edits that give the roles ``(s?(ua)+)?``.

Rows are kept (free, or 5 where cut short), given another role (1 more), deleted (2), and empty turns are
inserted (5). A role sequence is in one of four states (nothing yet, after system, after user, after
assistant), so the cost of a stretch of rows is a vector of four numbers. Hirschberg's way: the cost
vector of the first half, forward from the state at its start, and that of the second half, backward from the end,
meet in the middle; the cheapest crossing splits the problem in two, and no table of all rows and states is kept.
Where crossings tie, the half before them is solved towards all of them, and the end of its audit-least edits decides.

A conversation is cut in blocks of ``BLOCK`` rows, one row of the table each. The matrices of the blocks
(cost from state to state) are multiplied by a scan over the blocks, then what each block makes of each
state at its start is composed in the same way, and so every block is solved by itself. No task holds more than
a block's codes, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.operators.prefix import global_index
from graphrecon.session import materialize

DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
BLOCK, FAN = 1024, 256
#: Code strings whose solution a worker remembers.
REMEMBERED = 50_000
FAR = 1 << 50
START, SYSTEM, USER, ASSISTANT = range(4)
_SPACE = " \t\n\x0b\x0c\r"
_INITIALS, _FAULTS = "sua-", "-bdt"  # a row's code: its initial's place times four, and its fault's
_NEXT = (USER, USER, ASSISTANT, USER)  # what may be inserted after each state
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Whether the roles may end in the state, and the cost to end from it when turns may be inserted.
_ENDS, _ACCEPT = (0, FAR, FAR, 0), (0, 2 * INSERT, INSERT, 0)


def code(initial: str, fault: str) -> str:
    """``initial``: s, u, a or another; ``fault``: b(lank), d(uplicate), t(runcated) or -."""
    return chr(65 + 4 * _INITIALS.index(initial if initial in "sua" and initial else "-") + _FAULTS.index(fault))


def _moves(c: str) -> list[tuple[str, int, tuple[int, ...]]]:
    """Edits of a row with this code in ASCII order: initial, cost, and the state that follows each state (-1: none)."""
    initial, fault = _INITIALS[(ord(c) - 65) // 4], _FAULTS[(ord(c) - 65) % 4]
    found = [("D", DELETE, (0, 1, 2, 3))]
    if fault not in "bd":
        more = CUT if fault == "t" else 0
        kept = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
        if initial in kept:
            found.append(("K", more, kept[initial]))
        found.append(("R", more + REROLE, _NEXT))
    return found


_MOVES = {chr(65 + i): _moves(chr(65 + i)) for i in range(16)}


def _with_inserts(after: Sequence[int]) -> list[int]:
    """Costs to the end when turns may be inserted first; more than two never pay."""
    once = [min(after[s], INSERT + after[_NEXT[s]]) for s in range(4)]
    return [min(once[s], INSERT + once[_NEXT[s]]) for s in range(4)]


def backward(codes: str, after: Sequence[int]) -> list[int]:
    """Cost from each state before the rows to the end, given the costs ``after`` them."""
    for c in reversed(codes):
        row = [FAR] * 4
        for _, cost, to in _MOVES[c]:
            for s in range(4):
                if to[s] >= 0:
                    row[s] = min(row[s], cost + after[to[s]])
        after = _with_inserts(row)
    return list(after)


def forward(codes: str, before: Sequence[int]) -> list[int]:
    """Cost to each state after the rows, given the costs ``before`` them."""
    now = list(before)
    for c in codes:
        for _ in range(2):
            user = min(now[USER], INSERT + min(now[START], now[SYSTEM], now[ASSISTANT]))
            now = [now[START], now[SYSTEM], user, min(now[ASSISTANT], INSERT + now[USER])]
        row = [FAR] * 4
        for _, cost, to in _MOVES[c]:
            for s in range(4):
                if to[s] >= 0:
                    row[to[s]] = min(row[to[s]], cost + now[s])
        now = row
    return now


def _one_row(c: str, state: int, after: Sequence[int]) -> tuple[str, int]:
    """Audit-least cheapest edits of one row, with turns inserted before it, and the state behind them."""
    audit, costs = "", backward(c, after)
    while True:
        for edit, cost, to in (_MOVES[c][0], ("I", INSERT, _NEXT), *_MOVES[c][1:]):
            if to[state] < 0:
                continue
            rest = costs[to[state]] if edit == "I" else after[to[state]]
            if cost + rest == costs[state]:
                audit, state = audit + edit, to[state]
                break
        if edit != "I":
            return audit, state


def cheapest(codes: str, state: int, after: Sequence[int]) -> tuple[str, int]:
    """Audit-least cheapest edits of the rows from ``state`` on, and the state behind them."""
    if len(codes) == 1:
        return _one_row(codes, state, after)
    mid = len(codes) // 2
    there = forward(codes[:mid], [0 if s == state else FAR for s in range(4)])
    here = backward(codes[mid:], after)
    best = min(a + b for a, b in zip(there, here))
    crossings = [here[s] if there[s] + here[s] == best else FAR for s in range(4)]
    first, at = cheapest(codes[:mid], state, crossings)
    second, end = cheapest(codes[mid:], at, after)
    return first + second, end


def audit_of(codes: str, state: int = START, after: Sequence[int] = _ACCEPT, last: bool = True) -> str:
    """The edits' initials; in the ``last`` block with the turns that are inserted at the end."""
    audit, end = cheapest(codes, state, after) if codes else ("", state)
    while last and _ENDS[end]:
        audit, end = audit + "I", _NEXT[end]
    return audit


def counts_of(codes: str, audit: str, lead: str = "") -> tuple[int, int, int, int, int]:
    """Blank, duplicate and truncated rows, pairs of roles that may not be neighbours (``lead``: code before), cost."""
    faults = [_FAULTS[(ord(c) - 65) % 4] for c in codes]
    roles = [_INITIALS[(ord(c) - 65) // 4] for c in lead + codes]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    edits = audit.replace("I", "")
    cost = DELETE * edits.count("D") + REROLE * edits.count("R") + INSERT * (len(audit) - len(edits))
    cost += CUT * sum(f == "t" and e != "D" for f, e in zip(faults, edits))
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost


# --- tables -----------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``conv`` (text of the id, "" for null), ``turn``, ``role``, ``text`` of what is left of ``conversations``.

    By crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it the user's. A null id, turn, role or text reads as one space.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    fate = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return rows.where(fate != 0).select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_ORDER = ("conv", "turn", "role", "head", "digest")


def _ordered(rows: DataFrame) -> DataFrame:
    """With ``head`` and ``digest``, by which rows of one turn and role are put in order without their texts."""
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", F.md5("text"))


def row_codes(rows: DataFrame) -> DataFrame:
    """``_ORDER`` columns, ``idx`` (place among all rows) and ``code`` of each row, without the texts."""
    ends = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    fault = F.when(ends == "", 1).when(ends.isin(".", "!", "?"), 0).otherwise(3)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = _ordered(rows).select(*_ORDER, fault.alias("fault"), place.alias("place"))
    placed = materialize(global_index(slim, list(_ORDER), "idx"))
    seen = placed.where("fault <> 1").groupBy("conv", "role", "digest").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = materialize(seen.where("n > 1").drop("n"))
    marked = placed.join(seen, ["conv", "role", "digest"], "left")
    fault = F.when(F.col("fault") == 1, 1).when(F.col("idx") > F.col("first"), 2).otherwise(F.col("fault"))
    return marked.select(*_ORDER, "idx", F.char(65 + 4 * F.col("place") + fault).alias("code"))


def _scan(rows: DataFrame, depth: int, combine: Callable, backwards: bool) -> DataFrame:
    """``rows`` (``conv``, ``block``, ``item``) with ``before``: the items of all blocks before, combined (null for none).

    ``combine`` takes two arrays of numbers and must be associative. ``FAN`` blocks at a time, their totals by the
    same scan. ``backwards``: of all blocks behind.
    """
    kind = "conv string, block long, item array<long>"
    grouped = rows.withColumn("group", F.floor(F.col("block") / FAN))

    def in_order(frame: pd.DataFrame) -> list[tuple]:
        return sorted(frame.itertuples(index=False), key=lambda r: r.block, reverse=backwards)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        found = None
        for r in in_order(frame):
            found = r.item if found is None else combine(found, r.item)
        return pd.DataFrame({"conv": [r.conv], "block": [r.group], "item": [list(found)]})

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        found, out = frame["outer"].iloc[0], []
        for r in in_order(frame):
            out.append((r.conv, r.block, list(r.item), None if found is None else list(found)))
            found = r.item if found is None else combine(found, r.item)
        return pd.DataFrame(out, columns=["conv", "block", "item", "before"])

    outer = F.lit(None).cast("array<long>")
    if depth > 1:
        totals = grouped.groupBy("conv", "group").applyInPandas(total, kind)
        above = _scan(totals, depth - 1, combine, backwards)
        above = materialize(above.select("conv", F.col("block").alias("group"), F.col("before").alias("outer")))
        grouped = grouped.join(above, ["conv", "group"], "left")
    else:
        grouped = grouped.withColumn("outer", outer)
    return grouped.groupBy("conv", "group").applyInPandas(spread, f"{kind}, before array<long>")


def _product(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Cheapest costs through both matrices, ``b`` before ``a`` (as the blocks are met from the end on)."""
    return [min(min(b[4 * i + k] + a[4 * k + j] for k in range(4)), FAR) for i in range(4) for j in range(4)]


def _compose(a: Sequence[int], b: Sequence[int]) -> list[int]:
    return [b[s] for s in a]


def _each(rows: DataFrame, added: str, compute: Callable) -> DataFrame:
    """``rows`` with more columns, computed from the row."""
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [compute(r) for r in batch.itertuples(index=False)]
            yield batch.assign(**{n: pd.Series([f[i] for f in found], dtype=object, index=batch.index) for i, n in enumerate(names)})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kept}, {added}")


def _placed(blocks: DataFrame, most: int) -> DataFrame:
    """``blocks`` with the ``state`` at their start, the costs ``after`` them, whether ``last``, the code before (``lead``)."""
    alone = [F.lit(START).alias("state"), F.array(*map(F.lit, _ACCEPT)).cast("array<long>").alias("after"), F.lit(True).alias("last")]
    if most == 0:
        return blocks.select("*", *alone, F.lit("").alias("lead"))
    depth, wide = 1, most + 1
    while wide > FAN:
        depth, wide = depth + 1, -(-wide // FAN)
    many = materialize(blocks.where("block > 0").select("conv").distinct())
    split = materialize(blocks.join(many, "conv", "left_semi"))
    starts = [[0 if s == t else FAR for s in range(4)] for t in range(4)]

    def matrix(r) -> tuple:
        return ([x for start in starts for x in forward(r.codes, start)],)

    def ends(r) -> tuple:
        behind = r.before if r.before is not None else None
        after = list(_ACCEPT) if behind is None else [min(behind[4 * s + t] + _ACCEPT[t] for t in range(4)) for s in range(4)]
        reached = [cheapest(r.codes, s, after)[1] for s in range(4)]
        return after, behind is None, reached

    costs = _scan(_each(split.select("conv", "block", "codes"), "item array<long>", matrix).drop("codes"), depth, _product, True)
    met = split.select("conv", "block", "codes").join(costs.select("conv", "block", "before"), ["conv", "block"])
    towards = materialize(_each(met, "after array<long>, last boolean, item array<long>", ends).drop("before", "codes"))
    states = _scan(towards.select("conv", "block", "item"), depth, _compose, False)
    led = split.select("conv", (F.col("block") + 1).alias("block"), F.substring("codes", -1, 1).alias("lead"))
    full = (
        split.join(states.select("conv", "block", F.coalesce(F.get("before", F.lit(START)), F.lit(START)).cast("int").alias("state")), ["conv", "block"])
        .join(towards.select("conv", "block", "after", "last"), ["conv", "block"])
        .join(led, ["conv", "block"], "left")
        .select(*blocks.columns, "state", "after", "last", F.coalesce("lead", F.lit("")).alias("lead"))
    )
    single = blocks.join(many, "conv", "left_anti").select(*blocks.columns, *alone, F.lit("").alias("lead"))
    return single.unionByName(full)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def block_edits(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each block of each conversation: ``_ORDER`` columns of its first row, ``block``, ``state``, ``audit``, counts and cost."""
    first = materialize(codes.groupBy("conv").agg(F.min("idx").alias("start")))
    rows = codes.join(first, "conv").withColumn("block", F.floor((F.col("idx") - F.col("start")) / block))
    blocks = materialize(
        rows.groupBy("conv", "block").agg(
            F.min(F.struct("idx", *_ORDER[1:])).alias("first"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "code"))), lambda r: r["code"]), "").alias("codes"),
        )
    )
    most = blocks.agg(F.max("block")).first()[0] or 0
    placed = _placed(blocks.select("conv", "block", "codes", *[F.col(f"first.{c}").alias(c) for c in _ORDER[1:]]), most)
    known: dict[tuple, tuple] = {}

    def solve(r) -> tuple:
        name = (r.codes, r.state, tuple(r.after), r.last, r.lead)
        if name not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            audit = audit_of(r.codes, r.state, list(r.after), r.last)
            known[name] = (audit, *counts_of(r.codes, audit, r.lead))
        return known[name]

    # Turns are nullable numbers, which pandas would make floats: they pass as text.
    placed = placed.withColumn("turn", F.col("turn").cast("string")).select(*_ORDER, "block", "state", "codes", "after", "last", "lead")
    solved = _each(placed, ", ".join(["audit string", *[f"{c} long" for c in _COUNTS]]), solve)
    return materialize(solved.withColumn("turn", F.col("turn").cast("long")).drop("codes", "after", "last", "lead"))


class _Repair:
    """Applies audits to the rows of one conversation as they come by."""

    def __init__(self):
        self.audit, self.at, self.state, self.waiting = "", 0, START, []

    def expect(self, state: int, audit: str) -> None:
        self.waiting.append((state, audit))

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _NEXT[self.state]
            yield _NAMES[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        if self.at == len(self.audit):
            (self.state, self.audit), self.at = self.waiting.pop(0), 0
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            self.state = _NEXT[self.state]
            role = _NAMES[self.state]
        yield role, text, edit

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _streamed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows and, before each block's rows, its audit: dealt out by conversation and in order."""
    audits = edits.select(*_ORDER, F.lit(0).alias("kind"), "block", "state", F.col("audit").alias("text"))
    nothing = F.lit(None)
    texts = _ordered(rows).select(*_ORDER, F.lit(1).alias("kind"), nothing.cast("long").alias("block"), nothing.cast("int").alias("state"), "text")
    dealt = texts.unionByName(audits).repartition("conv").sortWithinPartitions(*_ORDER, "kind", "block")
    return dealt.select("conv", "role", "text", "kind", "state")


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv``, ``at`` (place from 0), ``role``, ``text`` and ``edit`` (K, R or I) of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, out, at = None, None, [], 0

        def take(found):
            nonlocal at
            for role, text, edit in found:
                out.append((conv, at, role, text, edit))
                at += 1

        def batch_of():
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "at", "role", "text", "edit"])

        for batch in batches:
            for name, role, text, kind, state in zip(*[c.to_pylist() for c in batch.columns]):
                if repair is None or name != conv:
                    take(repair.end() if repair else ())
                    conv, repair, at = name, _Repair(), 0
                if kind == 0:
                    repair.expect(state, text)
                else:
                    take(repair.row(role, text))
            yield batch_of()
        take(repair.end() if repair else ())
        yield batch_of()

    return _streamed(rows, edits).mapInArrow(run, "conv string, at long, role string, text string, edit string")


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256`` of its repaired rows, ``role:text`` each, joined by line breaks.

    A hash of one text can't be split, so a conversation streams through one task, row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, digest, some = None, None, None, False

        def take(found):
            nonlocal some
            for role, text, _ in found:
                digest.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                some = True

        for batch in batches:
            names, sums = [], []

            def close():
                if repair:
                    take(repair.end())
                    names.append(conv)
                    sums.append(digest.hexdigest())

            for name, role, text, kind, state in zip(*[c.to_pylist() for c in batch.columns]):
                if repair is None or name != conv:
                    close()
                    conv, repair, digest, some = name, _Repair(), hashlib.sha256(), False
                if kind == 0:
                    repair.expect(state, text)
                else:
                    take(repair.row(role, text))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.string())], ["conv", "repaired_sha256"])
        names, sums = [], []
        if repair:
            take(repair.end())
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    return _streamed(rows, edits).mapInArrow(run, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each ``conv_id``: ``gaps``, faults, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    The rows are damaged first (see ``damaged``) and taken by turn, nulls first; rows of one turn by role and text (its
    first 64 characters, then its MD5). A conversation without rows has zeros, an empty audit and the hash of an empty
    text; a null id is a conversation of its own; an empty table gives an empty result. Other columns aren't
    read. Texts of any length pass once, by conversation, to be hashed; all else works on a byte a row.
    """
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    edits = block_edits(row_codes(rows), block)
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "")
    sums = edits.groupBy("conv").agg(*[F.sum(c).alias(c) for c in _COUNTS], audit.alias("audit"))
    turns = rows.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    ids = conversations.select("conv_id").distinct()
    marked = ids.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    joined = marked.join(sums, "conv", "left").join(turns, "conv", "left").join(repaired_digests(rows, edits), "conv", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", *_COUNTS)],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
