"""Conversation repair against its SQL, at run and fan sizes that cut conversations into many pieces, and against enumeration."""

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from oracle_check import rows_of
from retentia.llm import conversation_repair as repair
from retentia.llm import oracle

COLUMNS = "conv_id long, turn long, role string, text string, at string, cost int, fault int"
ROLES = ["user", "assistant", "system", "tool", "User", "", None, "uber", "agent", "söt"]
TEXTS = ["Yes.", "No!", "And?", "cut off", "blank soon", "", None, " \n\t ", "same. ", "same.", "x" * 5_000 + ".", "ünï\ncödé?", "a.\x0b"]


def table(seed, sizes):
    rng, out = random.Random(seed), []
    for conv, n in enumerate(sizes):
        conv = [None, 2**62 + 1, -3][conv] if conv < 3 else conv
        for turn in range(n):
            role = rng.choice(ROLES) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(TEXTS) if rng.random() < 0.5 else f"turn {turn}."
            turn = rng.choice([None, turn, turn // 2 * 2]) if rng.random() < 0.2 else turn
            out.append((conv, turn, role, text, "x", 1, None))
    return out


@pytest.mark.parametrize("run, fan, sizes", [(4096, 1024, [5, 3, 9, 1, 1, 0, 8, 30] + [6] * 30), (5, 2, [60, 3, 41, 8, 1, 90] + [4] * 10), (1, 3, [20, 1, 2])])
def test_repair_equals_its_sql(spark, tmp_path, monkeypatch, run, fan, sizes):
    monkeypatch.setattr(repair, "RUN", run)
    monkeypatch.setattr(repair, "FAN", fan)
    data = table(run, sizes)
    spark.createDataFrame(data + data[:4], COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    res = con.execute(oracle.OP12)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    got = repair.repair(spark.read.parquet(f"{tmp_path}/c"))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    assert len(want[0]) == len({r[0] for r in data})


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], COLUMNS)).collect() == []


def least(rows):
    """Cheapest (cost, audit) by trying all edits of (initial, fault) rows, with up to two inserts in each place."""
    found = []
    inserts = [list(x) for k in range(3) for x in itertools.product("ua", repeat=k)]

    def go(i, cost, audit, roles):
        for ins in inserts:
            c, a, r = cost + 5 * len(ins), audit + "I" * len(ins), roles + "".join(ins)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", r):
                    found.append((c, a))
                continue
            initial, fault = rows[i]
            go(i + 1, c + 2, a + "D", r)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                cut = 5 * (fault == repair.TRUNCATED)
                if initial:
                    go(i + 1, c + cut, a + "K", r + "sua"[initial - 1])
                for role in "ua":
                    go(i + 1, c + cut + 1, a + "R", r + role)

    go(0, 0, "", "")
    return min(found)


def test_least_audit_by_enumeration():
    rng = random.Random(3)
    for _ in range(40):
        rows = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.choice([1, 2, 3]))]
        n = len(rows)
        run = pa.table({
            "conv_id": [9] * n, "at": list(range(4, 4 + n)), "cid": [4] * n, "last": [3 + n] * n, "k": [0] * n,
            "initial": pa.array([r[0] for r in rows], pa.int32()), "fault": pa.array([r[1] for r in rows], pa.int32()),
            "after": pa.array([None] * n, pa.list_(pa.int64()))})
        out = repair._edits(run).to_pylist()
        assert (out[0]["cost"], "".join(r["edits"][0] for r in out).upper()) == least(rows)


def test_ranks_order_audits():
    rng = np.random.default_rng(1)
    n = 200  # a graph whose arcs lead on, with distinct letters at a node
    letter = np.array([np.where(rng.random(4) < 0.6, np.arange(1, 5), 0) for _ in range(n)] + [[0] * 4])
    letter[:-1, 3] = np.where(letter[:-1].max(axis=1) == 0, 4, letter[:-1, 3])
    to = np.array([[rng.integers(v + 1, n + 1) for _ in range(4)] for v in range(n)] + [[n] * 4])
    pointers, steps, rank = repair.least_paths(letter, to)

    def audit(v):
        out = ()
        while letter[v].any():
            j = min(j for j in range(4) if letter[v, j])
            out, v = (*out, letter[v, j]), to[v, j]
        return out

    audits = [audit(v) for v in range(n + 1)]
    assert [len(a) for a in audits] == steps.tolist()
    order = {a: k for k, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == np.unique(rank, return_inverse=True)[1].tolist()
