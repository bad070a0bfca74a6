"""Repair of conversation structure: the cheapest edits to legal turns, the least audit among them.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles. A
row may be kept, given another role, or deleted, and empty turns may be
inserted; ``audit`` is the string of the edits' initials.

Method: a conversation is a graph of nodes (row, state), the state being what
the repaired part ends with: nothing, s, u or a. Costs to the end come from a
dynamic program. Arcs on a cheapest path are kept, and their nodes are ranked
by prefix doubling: ranks by the first letter of the least audit from a node,
then by 2, 4, 8, ... letters from the pairs (rank, rank of the node that many
letters on). The pointers double alongside, and every letter of the least path
is read off them by the bits of its place. A node has one arc per letter, so
the least first letter fixes its pointer; the ranks compare what follows.

* Rows are numbered in one global order over range partitions, and dealt out in
  runs of RUN neighbours. A run holds many short conversations, or a piece of a
  long one, so a conversation that holds most rows spreads like any other.
* Pieces of a conversation that crosses runs are tied together by small
  products: a 4 x 4 matrix of costs per piece gives each piece the costs after
  it, a map of states per piece gives it the state it is entered in. Both are
  composed over groups of FAN pieces, level by level, up and down again.
* A digest and an audit are single values: at the end the rows of a
  conversation stream through one task in order, and only the audit is held.

Results in the odd cases: a null text or role is one blank, so a null text is
blank; a null conv_id is a conversation of its own; null turns come first;
rows of one turn stand in the order of role and text; repeated rows are
duplicates; an empty role has no initial and is never kept; a conversation
without rows has zeros and an empty audit; an empty table gives no rows.
Columns other than the four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rows that one group of the dynamic program holds, and pieces that one product joins.
RUN = 4096
FAN = 1024

#: States: nothing yet, after s, after u, after a. Costs of edits, as the contract fixes them.
INITIALS = "sua"
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEVER = 1 << 40
#: State after keeping a row of each initial (or another), after a new role, after an insert.
KEEP_TO = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
ROLE_TO = np.array([2, 2, 3, 2])
#: Costs after the last row: inserts that complete the pair.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)

_SPACE = r" \t\n\u000b\u000c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the fixed damage by crc32 of ``conv_id:turn``."""
    key = "concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))"
    rows = conversations.selectExpr(
        "conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"crc32(cast({key} AS binary)) % 20 AS kind").filter("kind <> 0")
    return rows.selectExpr(
        "conv_id", "turn", "CASE WHEN kind = 4 THEN 'user' ELSE role END AS role",
        "CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text", "explode(sequence(1, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, their place in the order (conv_id, turn, role, text)."""
    order = "conv_id", "turn", "role"
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    rows = saved(rows.drop("copy").withColumn("no", F.monotonically_increasing_id()), "turns").selectExpr("*", "shiftright(no, 33) AS part")
    # One row per partition, so the window is as small as the number of partitions.
    parts = rows.groupBy("part").count().selectExpr("part AS p", "sum(count) OVER (ORDER BY part) - count AS before")
    return rows.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumn("at", F.expr("before + (no & 8589934591L)")).drop("no", "part", "p", "before")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, initial, fault) of every row."""
    plain = rows.selectExpr(
        "conv_id", "at", "turn", f"instr('{INITIALS}', nullif(substring(role, 1, 1), '')) AS initial",
        f"trim(TRAILING '{_SPACE}' FROM text) AS t",
        "unhex(sha2(concat_ws(':', cast(conv_id AS string), octet_length(role), role, text), 256)) AS digest", "conv_id IS NULL AS no_id")
    plain = plain.selectExpr(
        "conv_id", "at", "turn", "coalesce(initial, 0) AS initial", "digest", "no_id",
        f"CASE WHEN t = '' THEN {BLANK} WHEN right(t, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {CLEAN} END AS fault")
    seen = plain.filter(f"fault <> {BLANK}").groupBy("digest", "no_id").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = plain.join(seen, ["digest", "no_id"], "left")
    return marked.selectExpr("conv_id", "at", "turn", "initial", f"CASE WHEN fault <> {BLANK} AND at > first THEN {DUPLICATE} ELSE fault END AS fault")


def _costs(piece: np.ndarray, initial: np.ndarray, fault: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs of the nodes, (rows + pieces, 4, width), from those after each piece, (pieces, 4, width)."""
    n, ends = len(piece), np.flatnonzero(np.diff(piece, append=-1))
    lengths = np.diff(ends, prepend=-1)
    cost = np.concatenate([np.empty((n, 4, after.shape[2]), np.int64), after])
    following = _following(piece, ends)
    for back in range(lengths.max(initial=0)):
        at = ends[lengths > back] - back
        then = cost[following[at]]
        delete, keep, role = _arcs(then, initial[at], fault[at])
        cost[at] = _inserted(np.minimum(np.minimum(delete, keep), role))
    return cost


def _following(piece: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.arange(1, len(piece) + 1)
    out[ends] = len(piece) + np.arange(len(ends))
    return out


def _arcs(then: np.ndarray, initial: np.ndarray, fault: np.ndarray):
    """Costs over each kind of arc from the rows' four states, given those of the nodes ``then``."""
    to = KEEP_TO[initial - 1]
    kept = np.take_along_axis(then, np.maximum(to, 0)[:, :, None], axis=1)
    extra = (np.where((fault == BLANK) | (fault == DUPLICATE), NEVER, 0) + np.where(fault == TRUNCATED, CUT_OFF, 0))[:, None, None]
    return then + DELETE, np.where(to[:, :, None] < 0, NEVER, kept) + extra, then[:, ROLE_TO] + RETYPE + extra


def _inserted(cost: np.ndarray) -> np.ndarray:
    """The same nodes' costs when turns may be inserted first."""
    out = cost.copy()
    out[:, 2] = np.minimum(cost[:, 2], INSERT + cost[:, 3])
    out[:, 3] = np.minimum(cost[:, 3], INSERT + cost[:, 2])
    for q in (0, 1):
        out[:, q] = np.minimum(cost[:, q], INSERT + out[:, 2])
    return np.minimum(out, NEVER)


def _columns(run: pa.Table):
    run = run.sort_by("at")
    cid = run["cid"].to_numpy()
    return run, np.cumsum(np.diff(cid, prepend=cid[0]) != 0), run["initial"].to_numpy(), run["fault"].to_numpy()


def _matrices(run: pa.Table) -> pa.Table:
    """Per piece: cheapest costs from each state at its start to each at its end."""
    run, piece, initial, fault = _columns(run)
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    through = np.where(np.eye(4, dtype=bool), 0, NEVER)
    cost = _costs(piece, initial, fault, np.repeat(through[None], len(starts), 0))[starts]
    return pa.table({"cid": run["cid"].take(starts), "k": run["k"].take(starts), "m": _lists(cost.reshape(len(starts), 16))})


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(pa.int64()))


def _then(m: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Min-plus product of a piece's matrix with what follows it."""
    return np.minimum((m[:, :, None] + after[None]).min(axis=1), NEVER)


def _product(group: pa.Table) -> pa.Table:
    group = group.sort_by("k")
    out = None
    for m in reversed(group["m"].to_pylist()):
        m = np.array(m).reshape(4, 4)
        out = m if out is None else _then(m, out)
    return pa.table({"cid": group["cid"].slice(0, 1), "k": group["up"].slice(0, 1), "m": _lists(out.reshape(1, 16))})


def _afters(group: pa.Table) -> pa.Table:
    group = group.sort_by([("k", "descending")])
    now, out = np.array(group["after"][0].as_py())[:, None], []
    for m in group["m"].to_pylist():
        out.append(now[:, 0])
        now = _then(np.array(m).reshape(4, 4), now)
    return pa.table({"cid": group["cid"], "k": group["k"], "after": _lists(np.array(out))})


def swept(pieces: DataFrame, end: np.ndarray, name: str) -> DataFrame:
    """(cid, k, after): the product of all matrices behind each piece (cid, k from 0, m) with the vector ``end``."""
    levels = [pieces]
    while not levels[-1].groupBy("cid").count().filter("count > 1").isEmpty():
        up = levels[-1].withColumn("up", F.expr(f"k div {FAN}"))
        levels.append(saved(up.groupBy("cid", "up").applyInArrow(_product, "cid long, k long, m array<long>"), name))
    after = levels[-1].select("cid", "k", F.lit(end.tolist()).cast("array<long>").alias("after"))
    for level in reversed(levels[:-1]):
        above = after.withColumnsRenamed({"k": "up"})
        down = level.withColumn("up", F.expr(f"k div {FAN}")).join(above, ["cid", "up"])
        after = saved(down.groupBy("cid", "up").applyInArrow(_afters, "cid long, k long, after array<long>"), name)
    return after


def least_paths(letter: np.ndarray, to: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Doubled pointers, lengths and ranks of the least audits from every node.

    ``letter`` and ``to`` (nodes, arcs) hold the cheapest arcs, letter 0 where
    there is none; an end has none at all.
    """
    n, big = len(letter), np.iinfo(np.int64).max
    first = np.where(letter > 0, letter, big).argmin(axis=1)
    here = np.arange(n)
    rank = letter[here, first]
    pointer = np.where(rank > 0, to[here, first], here)
    steps, pointers = (rank > 0).astype(np.int64), []
    while True:
        pointers.append(pointer)
        if not (steps[pointer] > 0).any():
            return pointers, steps, rank
        # Audits of twice the length rank as the pairs of their halves' ranks.
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        steps = steps + steps[pointer]
        pointer = pointer[pointer]


def _edits(run: pa.Table) -> pa.Table:
    """Per row the edits of the least cheapest path, for each state that its piece may be entered in."""
    run, piece, initial, fault = _columns(run)
    n, starts, ends = len(piece), np.flatnonzero(np.diff(piece, prepend=-1)), np.flatnonzero(np.diff(piece, append=-1))
    known = run["after"].take(starts).to_pylist()
    crossing = np.array([a is not None for a in known])
    last = (run["last"].to_numpy() == run["at"].to_numpy())[ends]
    after = np.array([AT_END if a is None else a for a in known], np.int64).reshape(len(starts), 4)
    cost = _costs(piece, initial, fault, after[:, :, None])[:, :, 0]
    following = _following(piece, ends)
    # Arcs of all nodes in the order of their letters: D, I, K, R.
    state = np.arange(4)
    delete, keep, role = (a[:, :, 0] for a in _arcs(cost[following][:, :, None], initial, fault))
    insert = INSERT + cost[:, ROLE_TO]
    letter = np.zeros((n + len(starts), 4, 4), np.int64)
    for j, arc in enumerate((delete, insert[:n], keep, role)):
        letter[:n, :, j] = np.where(arc == cost[:n], j + 1, 0)
    letter[n:, :, 1] = np.where(last[:, None] & (insert[n:] == cost[n:]), 2, 0)
    keep_to = np.maximum(KEEP_TO[initial - 1], 0)
    to = np.zeros(letter.shape, np.int64)
    to[:n, :, 0] = following[:, None] * 4 + state
    to[:, :, 1] = np.arange(n + len(starts))[:, None] * 4 + ROLE_TO
    to[:n, :, 2] = following[:, None] * 4 + keep_to
    to[:n, :, 3] = following[:, None] * 4 + ROLE_TO
    letter, to = letter.reshape(-1, 4), to.reshape(-1, 4)
    pointers, steps, rank = least_paths(letter, to)
    # The arc of a node on its least path: least letter, then least rank of what follows.
    best = np.where(letter > 0, letter * (rank.max(initial=0) + 1) + rank[to], np.iinfo(np.int64).max).argmin(axis=1)
    here = np.arange(len(letter))
    kind, into = letter[here, best], to[here, best] % 4

    source = (starts[:, None] * 4 + state)[crossing[:, None] | (state == 0)]
    length = steps[source]
    path = np.repeat(np.arange(len(source)), length)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    node, end = source[path], source.copy()
    for bit, pointer in enumerate(pointers):
        node = np.where(place >> bit & 1, pointer[node], node)
        end = np.where(length >> bit & 1, pointer[end], end)
    row = np.where(node // 4 < n, node // 4, ends[np.maximum(node // 4 - n, 0)])  # edits behind the last row stand with it
    # One character an edit; inserts and new roles in small letters are the user's.
    shown = np.array(list(" DIKR"))[kind[node]]
    shown = np.where(((kind[node] == 2) | (kind[node] == 4)) & (into[node] == 2), np.char.lower(shown), shown)
    edits = [[""] * (4 if c else 1) for c in crossing[piece]]
    for r, q, ch in zip(row.tolist(), (source[path] % 4).tolist(), shown.tolist()):
        edits[r][q] += ch
    exits = [None] * n
    for s, e in zip(source.tolist(), end.tolist()):
        if crossing[piece[s // 4]]:
            exits[s // 4] = [*(exits[s // 4] or []), e % 4]
    total = [int(cost[i, 0]) if first else None for i, first in enumerate(run["cid"].to_numpy() == run["at"].to_numpy())]
    return pa.table({
        "conv_id": run["conv_id"], "at": run["at"], "cid": run["cid"], "k": run["k"], "edits": pa.array(edits, pa.list_(pa.string())),
        "cost": pa.array(total, pa.int64()), "exits": pa.array(exits, pa.list_(pa.int64())),
    })


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation, from its rows in order, each behind its edits."""
    now, schema = None, None

    def result():
        conv, cost, audit, illegal, sha, *_ = now
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], schema.field("conv_id").type), pa.array([cost], pa.int64()), pa.array(["".join(audit)]),
             pa.array([illegal], pa.int64()), pa.array([sha.hexdigest()])],
            names=["conv_id", "cost", "audit", "illegal", "repaired_sha256"])

    for batch in batches:
        schema = batch.schema
        for conv, cid, cost, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "cid", "cost", "edits", "role", "text"))):
            if edits is not None:
                if cost is not None:  # its first row
                    if now:
                        yield result()
                    now = [conv, cost, [], 0, hashlib.sha256(), None, False]
                now[2].append(edits.upper())
                pending = edits
                continue
            if now[5] is not None and now[5] + role[:1] not in ("su", "ua", "au"):
                now[3] += 1
            now[5] = role[:1]
            for e in pending:
                if e == "D":
                    continue
                to = role if e == "K" else "user" if e.islower() else "assistant"
                line = f"{to}:" + ("" if e in "iI" else text)
                now[4].update((("\n" if now[6] else "") + line).encode("utf-8", "replace"))
                now[6] = True
    if now:
        yield result()


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the damaged conversations."""
    rows = ordered(damage(conversations))
    marked = saved(with_faults(rows), "turn-faults")
    counts = [F.count_if(F.col("fault") == k).alias(name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    span = F.expr("coalesce(cast(max(turn) AS decimal(20, 0)) - min(turn) + 1 - count(DISTINCT turn), 0)").cast("long").alias("gaps")
    each = marked.groupBy("conv_id").agg(F.min("at").alias("cid"), F.max("at").alias("last"), span, *counts)
    each = saved(each, "conversations")
    ends = each.select(F.col("conv_id").alias("c"), "cid", "last")
    nodes = marked.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "at", "cid", "last", F.col("initial").cast("int"), F.col("fault").cast("int"), F.expr(f"at div {RUN}").alias("run"),
        F.expr(f"at div {RUN} - cid div {RUN}").alias("k"))
    nodes = saved(nodes, "turn-nodes")
    long = nodes.filter(f"cid div {RUN} <> last div {RUN}")
    pieces = saved(long.groupBy("run").applyInArrow(_matrices, "cid long, k long, m array<long>"), "turn-pieces")
    after = swept(pieces, AT_END, "turn-after")
    conv = f"conv_id {nodes.schema['conv_id'].dataType.simpleString()}"
    edits = nodes.join(after, ["cid", "k"], "left").groupBy("run").applyInArrow(
        _edits, f"{conv}, at long, cid long, k long, edits array<string>, cost long, exits array<long>")
    edits = saved(edits, "turn-edits")
    # A map of states is a matrix of zeros; transposed and read from the last piece, it tells the state a piece is entered in.
    maps = edits.filter("exits IS NOT NULL").join(ends.withColumnRenamed("cid", "first"), F.col("cid") == F.col("first")).selectExpr(
        "cid", f"last div {RUN} - cid div {RUN} - k AS k", f"transform(sequence(0, 15), x -> CASE WHEN exits[x % 4] = x div 4 THEN 0L ELSE {NEVER}L END) AS m", "k AS piece")
    entered = swept(maps.drop("piece"), np.array([0, NEVER, NEVER, NEVER]), "turn-entered")
    entered = entered.join(maps.select("cid", "k", "piece"), ["cid", "k"]).selectExpr("cid", "piece AS k", "cast(array_position(after, 0L) AS int) AS entry")
    chosen = edits.join(entered, ["cid", "k"], "left").selectExpr(
        "conv_id", "at", "cid", "cost", "edits[coalesce(entry, 1) - 1] AS edits", "cast(null AS string) AS role", "cast(null AS string) AS text")
    texts = rows.selectExpr("conv_id", "at", "cast(null AS bigint) AS cid", "cast(null AS bigint) AS cost", "cast(null AS string) AS edits", "role", "text")
    told = chosen.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("edits").isNull()).mapInArrow(
        _told, f"{conv}, cost long, audit string, illegal long, repaired_sha256 string")
    out = conversations.select("conv_id").distinct().alias("o").join(each.alias("e"), F.expr("o.conv_id <=> e.conv_id"), "left").join(
        told.alias("t"), F.expr("o.conv_id <=> t.conv_id"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("o.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
