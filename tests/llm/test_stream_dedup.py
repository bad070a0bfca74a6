"""Streaming deduplication: state across batches and restarts, collisions, odd rows; against a plain grouping."""

import hashlib
import random
import re

import pytest

from retentia.llm import queries, stream_dedup

COLUMNS = "doc_id long, text string, lang string, size string, file int, best string"
BIG = 2**62 + 1


def rows(seed, n=60):
    rng = random.Random(seed)
    texts = ["same text", "Same text", " s ame\ttext ", "x" * 50_000, "x" * 49_999 + "\ny", None, "", " \n\x0b", "ünï cödé", "ünïcödé", "　wide"]
    out = [(rng.choice([None, BIG, BIG + 2, i, i % 7]), rng.choice(texts), "en", "s", i, "b") for i in range(n)]
    return out + out[:3]


def want(every):
    groups = {}
    for at, r in enumerate(every):
        t = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        groups.setdefault(t, []).append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    out = []
    for t, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(None if m[1] else m[2], keep, len(members), sha) for m in members]
    return sorted(out, key=str), len(groups)


def check(got, every):
    expected, n = want(every)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == n == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("digest", [stream_dedup.SHA256, "X''", f"cast(char_length({stream_dedup.NORMAL}) % 2 AS string)"])
def test_late_copies_restarts_and_collisions(spark, tmp_path, digest):
    path, folder, every = f"{tmp_path}/documents.parquet", f"{tmp_path}/work", []
    for part in range(3):  # each delivery is a run of the stream of its own, on the state of those before
        every += rows(part)
        spark.createDataFrame(rows(part), COLUMNS).repartition(3).write.mode("append").parquet(path)
        stream_dedup.absorb(stream_dedup.document_stream(spark, path, files=2), folder, digest)
        got = stream_dedup.decisions(spark.read.parquet(path), stream_dedup.groups(spark, folder), digest).collect()
        check(got, every)
    assert spark.read.parquet(f"{folder}/groups").select("batch").distinct().count() >= 5
    assert (tmp_path / "work/state/state").exists()


def test_query_on_one_file_and_on_nothing(spark, tmp_path):
    spark.createDataFrame(rows(9, 20), COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    check(queries.op11_exact_dedup(spark, str(tmp_path)).collect(), rows(9, 20))
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_exact_dedup(spark, f"{tmp_path}/none").collect() == []
