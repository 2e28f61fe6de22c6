"""Repair of the structure of conversations by cheapest edits.

A conversation is right when its role initials spell ``(s?(ua)+)?``.  Rows may be kept, given
another role or deleted, and rows with an empty text may be inserted.  The cheapest
edits are a shortest path over nodes (rows read, state of the grammar), found by Dijkstra's
algorithm with the key (cost, audit); the graph is never built.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size spreads over
many tasks.  One that lies within a task and has PIECE_ROWS rows and PIECE_BYTES bytes at most is
finished there.  What a border of two tasks cuts, or is longer, goes on as pieces: for each
piece the search gives the cheapest edits between any two states, the pieces of a conversation
are chained by the same search (two paths to one node differ before either ends, unless
their costs differ, so the least audit of a whole has the least audits as its parts), and the
repaired text is hashed piece by piece in order.  Two things of one conversation meet in one
task: its audits, up to sixteen bytes a row, as the whole audit is one value of the result,
and the stream of its repaired text, since SHA-256 can only be taken in order; that stream is not held.

Nulls count as one space in ids (for the damage), turns (for the damage), roles and texts.  Rows are taken
by turn, nulls first; rows of equal turn by role, then text.  A null id is a conversation of
its own.  Repeated rows are duplicates after the first.  An empty table gives no rows.  Further
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mapped, partitions, stored

PIECE_ROWS = 512
PIECE_BYTES = 4 << 20

#: States: nothing yet, after the system's turn, after the user's, after the assistant's.
STATES, ENDS = range(4), (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Last character that isn't white space.
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
STOP = re.compile("[.!?]")
LEGAL = {"su", "ua", "au"}

#: Of a row: initial of its role, whether it must go, whether it is truncated.
Row = tuple[str, bool, bool]


def paths(rows: list[Row], start: int) -> Iterator[tuple[int, str, int]]:
    """Cheapest (cost, audit) to each state after all rows, in the order of that key; lazily, so the
    search goes no further than the caller."""
    heap, seen, n = [(0, "", 0, start)], set(), len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n:
            yield cost, audit, state
        grown = [(state, to) for to in (NEXT.get((state, "u")), NEXT.get((state, "a"))) if to]
        for _, to in grown:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))
        if i < n:
            initial, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not must_go:
                if (to := NEXT.get((state, initial))) is not None:
                    heapq.heappush(heap, (cost + KEEP + TRUNCATED * cut, audit + "K", i + 1, to))
                for _, to in grown:
                    heapq.heappush(heap, (cost + REROLE + TRUNCATED * cut, audit + "R", i + 1, to))


def cheapest(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair: the first end node that the search settles."""
    return next((cost, audit) for cost, audit, state in paths(rows, 0) if state in ENDS)


def replayed(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """``role:text`` of each row after the edits of ``audit``, and the state then.  The grammar leaves no
    choice of the role of a row that is inserted or gets another role."""
    out, i = [], 0
    for edit in audit:
        if edit in "IR":
            state = 3 if state == 2 else 2
            out.append(f"{ROLE[state]}:{texts[i] if edit == 'R' else ''}")
        elif edit == "K":
            state = NEXT[state, roles[i][:1]]
            out.append(f"{roles[i]}:{texts[i]}")
        i += edit != "I"
    return out, state


def fault(text: str, repeated: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    last = LAST.search(text)
    if not last:
        return "blank"
    return "duplicate" if repeated else "" if STOP.match(last[1]) else "truncated"


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def with_faults(roles: list[str], texts: list[str], repeated: Iterable[bool]) -> tuple[list[Row], list[str]]:
    faults = [fault(t, d) for t, d in zip(texts, repeated, strict=True)]
    return [(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, faults, strict=True)], faults


def seen_before(roles: list[str], texts: list[str]) -> list[bool]:
    seen, out = set(), []
    for key in zip(roles, texts, strict=True):
        out.append(key in seen)
        seen.add(key)
    return out


DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repaired(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    """The values of DIGEST for one whole conversation, in order."""
    rows, faults = with_faults(roles, texts, seen_before(roles, texts))
    cost, audit = cheapest(rows)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    text = "\n".join(replayed(audit, 0, roles, texts)[0])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal_pairs(roles), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text, times): rows with the test damage done; times is 0 where a row is dropped and 2
    where it is repeated, so that no conversation gets lost."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text(id_col), F.lit(":"), as_text(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(as_text(text_col), "[.!?]", "")).when(kind == 0, F.lit("")).otherwise(as_text(text_col))
    role = F.when(kind == 4, F.lit("user")).otherwise(as_text(role_col))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))


def undamaged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("bigint").alias("turn"), as_text(role_col).alias("role"), as_text(text_col).alias("text"), F.lit(1).alias("times"))


def _first_pass(id_type: pa.DataType):
    """Sorted rows of a task -> finished conversations, and the rows of all others with their pieces."""
    names = ["id", "done", *(c.split()[0] for c in DIGEST.split(", ")), "pid", "piece", "seq", "turn", "role", "text"]
    types = [id_type, pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []  # rows of the conversation at hand that are not out yet
        size = at = piece = 0  # bytes held, rows read and pieces begun of the conversation at hand
        now, first, pid = None, True, 0

        def passed_on() -> None:
            nonlocal held, size, at, piece
            out.extend((now, False, *[None] * 8, pid, piece, at + k, t, r, x) for k, (t, r, x) in enumerate(held))
            at, piece, held, size = at + len(held), piece + 1, [], 0

        def finished() -> None:
            rows = [r for r in held if r[1] is not None]
            out.append((now, True, *repaired(*([r[i] for r in rows] for i in range(3))), pid, *[None] * 5))

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for key, turn, role, text, times, pid in zip(*columns, strict=True):  # noqa: B020
                if first or key != now:
                    if not first:
                        # what began in this task and ends here is whole; the first may go back
                        finished() if whole and not piece else passed_on()
                    whole = not first
                    now, first, held, size, at, piece = key, False, [], 0, 0, 0
                # a dropped row stays as a mark without role, so that its conversation is known
                for _ in range(times or 1):
                    held.append((turn, role, text) if times else (None, None, None))
                    size += len(text) + 32
                if len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                    passed_on()
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
        if not first:
            passed_on()
        if out:
            yield batch(out)

    return run


def _piece(t: pa.Table) -> pa.Table:
    """One row for the rows of a piece: counts, and the cheapest edits between any two states."""
    t = t.sort_by("seq")
    col = {c: t.column(c).to_pylist() for c in ("turn", "role", "text", "again")}
    live = [i for i, r in enumerate(col["role"]) if r is not None]
    turns, roles, texts, again = ([col[c][i] for i in live] for c in ("turn", "role", "text", "again"))
    rows, faults = with_faults(roles, texts, again)
    costs, audits = [-1] * 16, [""] * 16
    for start in STATES:
        for cost, audit, state in paths(rows, start):
            costs[4 * start + state], audits[4 * start + state] = cost, audit
    known = [x for x in turns if x is not None]
    values = [t.column("id")[0], t.column("pid")[0].as_py(), t.column("piece")[0].as_py(), len(rows), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal_pairs(roles),
              roles[0][:1] if roles else "", roles[-1][:1] if roles else "", known[0] if known else None, known[-1] if known else None, len(set(known)), costs, audits, roles, texts]
    fields = dict(x.rsplit(" ", 1) for x in PIECE.split(", "))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.table([pa.array([v], t.schema.field("id").type if i == 0 else kinds[k]) for i, (v, k) in enumerate(zip(values, ["", *fields.values()], strict=True))], names=["id", *fields])


PIECE = "pid int, piece bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, first_turn bigint, last_turn bigint, n_turns bigint, costs array<bigint>, audits array<string>, roles array<string>, texts array<string>"


def chained(pieces: list[tuple[list[int], list[str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Total cost, and (state before, audit) of each piece: the search over nodes (pieces read, state).

    All edges lead one piece on, so the nodes are settled piece by piece.  Of the audits of the four states only
    what they do not have in common is held."""
    best, back = {0: (0, "")}, []
    for costs, audits in pieces:
        new, frm = {}, {}
        for state, (cost, tail) in best.items():
            for to in STATES:
                k = 4 * state + to
                if costs[k] >= 0 and (key := (cost + costs[k], tail + audits[k])) < new.get(to, (float("inf"), "")):
                    new[to], frm[to] = key, state
        common = len(os.path.commonprefix([tail for _, tail in new.values()]))
        best = {to: (cost, tail[common:]) for to, (cost, tail) in new.items()}
        back.append(frm)
    state = min((s for s in ENDS if s in best), key=best.get)
    total, out = best[state][0], []
    for (_, audits), frm in zip(reversed(pieces), reversed(back), strict=True):
        out.append((frm[state], audits[4 * frm[state] + state]))
        state = frm[state]
    return total, out[::-1]


CHOSEN = "pid int, piece bigint, state int, edits string, n bigint, " + DIGEST.rsplit(", ", 1)[0]


def _chain(t: pa.Table) -> pa.Table:
    """The edits of each piece of a conversation; the first piece's row also has the totals."""
    t = t.sort_by([("pid", "ascending"), ("piece", "ascending")])
    c = {name: t.column(name).to_pylist() for name in t.column_names if name != "id"}
    cost, chosen = chained(list(zip(c["costs"], c["audits"], strict=True)))
    gaps, illegal, n_turns, turn, role, low = 0, sum(c["illegal"]), 0, None, None, None
    for i in range(t.num_rows):
        if c["n"][i]:
            illegal += role is not None and role + c["first_role"][i] not in LEGAL
            role = c["last_role"][i]
        if c["n_turns"][i]:
            n_turns += c["n_turns"][i] - (turn == c["first_turn"][i])
            turn = c["last_turn"][i]
            low = c["first_turn"][i] if low is None else low
    if low is not None:
        gaps = turn - low + 1 - n_turns
    totals = [gaps, *(sum(c[f]) for f in ("blank", "duplicate", "truncated")), illegal, cost, "".join(a for _, a in chosen)]
    rest = [None] * (t.num_rows - 1)
    kinds = [pa.int64()] * 6 + [pa.string()]
    cols = [t.column("id"), t.column("pid"), t.column("piece"), pa.array([s for s, _ in chosen], pa.int32()), pa.array([a for _, a in chosen], pa.string()), t.column("n"),
            *(pa.array([v, *rest], k) for v, k in zip(totals, kinds, strict=True))]
    return pa.table(cols, names=["id", *(x.split()[0] for x in CHOSEN.split(", "))])


def _hashed(id_type: pa.DataType):
    """Sorted pieces -> SHA-256 of each conversation's repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, begun = None, None, False
        for b in batches:
            out = []
            for key, audit, state, roles, texts in zip(*(b.column(c).to_pylist() for c in ("id", "edits", "state", "roles", "texts")), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest, begun = key, hashlib.sha256(), False
                lines, _ = replayed(audit, state, roles, texts)
                if lines:
                    digest.update(("\n" * begun + "\n".join(lines)).encode())
                    begun = True
            yield pa.record_batch([pa.array([k for k, _ in out], id_type), pa.array([h for _, h in out], pa.string())], names=["id", "repaired_sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([now], id_type), pa.array([digest.hexdigest()], pa.string())], names=["id", "repaired_sha256"])

    return run


def repairs(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """id and the columns of DIGEST, one row per conversation of ``rows``."""
    spark = rows.sparkSession
    thin = (damaged if damage else undamaged)(rows, id_col, turn_col, role_col, text_col)
    kind = thin.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(thin.schema["id"].dataType)
    # prefixes bound what the sampling of ranges collects; equal rows may share a task, of any number
    order = ["id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32), "role", "text"]
    dealt = thin.repartitionByRange(partitions(spark), *order[:4]).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    first = f"id {kind}, done boolean, {DIGEST}, pid int, piece bigint, seq bigint, turn bigint, role string, text string"
    passed = stored(mapped(dealt, _first_pass(arrow), first), "conv-first")
    digest = [c.split()[0] for c in DIGEST.split(", ")]
    done = passed.where("done").select("id", *digest)
    open_rows = passed.where("NOT done").select("id", "pid", "piece", "seq", "turn", "role", "text", F.sha2("text", 256).alias("sha"), F.struct("pid", "seq").alias("place"))
    earliest = stored(open_rows.where("role IS NOT NULL").groupBy("id", "role", "sha").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("i"), F.col("role").alias("r"), F.col("sha").alias("s"), "earliest"), "conv-repeated")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    flagged = open_rows.join(earliest, same, "left").withColumn("again", F.coalesce(F.col("place") > F.col("earliest"), F.lit(False)))
    pieces = stored(flagged.select("id", "pid", "piece", "seq", "turn", "role", "text", "again").groupBy("id", "pid", "piece").applyInArrow(_piece, f"id {kind}, {PIECE}"), "conv-pieces")
    chosen = stored(pieces.drop("roles", "texts").groupBy("id").applyInArrow(_chain, f"id {kind}, {CHOSEN}"), "conv-edits")
    edits = chosen.select(F.col("id").alias("i"), F.col("pid").alias("p"), F.col("piece").alias("q"), "state", "edits")
    here = F.col("id").eqNullSafe(F.col("i")) & (F.col("pid") == F.col("p")) & (F.col("piece") == F.col("q"))
    texts = pieces.select("id", "pid", "piece", "roles", "texts").join(edits, here).select("id", "pid", "piece", "edits", "state", "roles", "texts")
    in_order = texts.repartition("id").sortWithinPartitions("id", "pid", "piece")
    hashes = mapped(in_order, _hashed(arrow), f"id {kind}, repaired_sha256 string").withColumnRenamed("id", "i")
    totals = chosen.where("cost IS NOT NULL").join(hashes, F.col("id").eqNullSafe(F.col("i"))).select("id", *digest)
    return done.unionByName(totals).withColumnRenamed("id", id_col)
