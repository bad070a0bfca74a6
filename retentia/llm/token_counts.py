"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded as it is. A longer one is cut
into chunks that overlap their successor; chunks are rows of their own and are
dealt over the cluster, so one huge document is not one task.

Two neighbours are spliced at a boundary both encodings prove. The tokenizer
cuts pre-tokens left to right, and where the next one ends depends only on the
text from its start on. So if the left chunk, right up to there, and the right
chunk both start a pre-token at p, then the left encoding up to p and the right
one from p on are those of the whole text. Special strings are found before
that: p keeps ``margin`` characters (their longest length) from either end of
the overlap, so that neither chunk can have cut one that matters.

Encoding itself is spared for words seen before. A byte-level tokenizer's
pre-token holds a blank or line feed at its start or among other white space
only, and none of its rules looks back, so a text may be cut before each blank
or line feed that follows another character than white space, and before a
comma or stop that follows a plain letter: the segments' encodings make up the
text's (``Segments``). Counts of short segments are kept
in each worker's bounded memo, and segment starts are pre-token starts. Long segments give
their pre-token starts by word numbers and offsets of the encoding. Tokenizers
with other rules (``cuttable``) encode each text or chunk as one segment.

Documents with an overlap that holds no common boundary are cut again, with
chunk and overlap four times as long, until a chunk holds all.

Defined cases: null counts as empty, empty has no tokens; a null doc_id keeps
its row; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, maybe_in, saved, through_pandas

LIMIT = 512
CHUNK = 16_384  # characters
OVERLAP = 512
WIDEN = 4
BATCH = 64
LONG = 64  # characters; longer segments are not memoised
MEMO = 800_000  # segments

#: A run of white space and what follows, up to a comma or stop after plain letters or the next blank or line feed after another character.
_SEGMENT = re.compile(r"\s*[A-Za-z]++(?=[.,])|\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")

_MADE: dict = {}
_SEEN: dict = {}  # token counts of segments, by tokenizer


def tokenizer(path: str):
    """The library's tokenizer, single-threaded, once for each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _MADE:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _MADE[path] = t
    return _MADE[path]


def margin(path: str) -> int:
    """Characters a cut must keep from either end of an overlap."""
    added = tokenizer(path).get_added_tokens_decoder().values()
    return max([1, *(len(a.content) for a in added)]) + 1


def _clean(t) -> str:
    return t if isinstance(t, str) else ""


def cuttable(tok) -> bool:
    """Byte-level rules without a normaliser, and no special string that a cut may part."""
    spec = json.loads(tok.to_str())
    pre = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return plain and not any(
        a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s|[A-Za-z][.,]", a["content"]) for a in spec["added_tokens"])


class Segments:
    """Segments of texts and the number of tokens of each."""

    def __init__(self, path: str):
        self.tok, self.memo = tokenizer(path), _SEEN.setdefault(path, {})
        self.cut = _SEGMENT.findall if cuttable(self.tok) else lambda t: [t] if t else []

    def counts(self, lists: list[list[str]]) -> list[list[int]]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        got = [list(map(memo.get, segs)) for segs in lists]
        fresh = list({s for segs, n in zip(lists, got) if None in n for s, c in zip(segs, n) if c is None})
        for s, e in zip(fresh, self.tok.encode_batch_fast(fresh, add_special_tokens=False)):
            memo[s] = len(e)
        out = [list(map(memo.get, segs)) if None in n else n for segs, n in zip(lists, got)]
        for s in fresh:
            if len(s) > LONG:
                del memo[s]
        return out

    def starts(self, piece: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Tokens in all; positions of pre-token starts (of segments, and inside long ones) and the tokens before each."""
        segs = self.cut(piece)
        n = np.array(self.counts([segs])[0], dtype=np.int64)
        at = np.cumsum([0, *map(len, segs)])[:-1]
        before = np.cumsum(np.append(0, n))[:-1]
        at_all, before_all = [at], [before]
        for i, s in enumerate(segs):
            if len(s) > LONG:
                e = self.tok.encode(s, add_special_tokens=False)
                words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
                inner = np.flatnonzero(words[1:] != words[:-1]) + 1
                at_all.append(at[i] + np.array([o[0] for o in e.offsets], dtype=np.int64)[inner])
                before_all.append(before[i] + inner)
        at, before = np.concatenate(at_all).astype(np.int64), np.concatenate(before_all).astype(np.int64)
        order = np.argsort(at, kind="stable")
        return int(n.sum()), at[order], before[order]


def _short(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments = Segments(path)

        def f(d: pd.DataFrame) -> pd.DataFrame:
            texts, n = [_clean(t) for t in d["text"]], []
            for i in range(0, len(texts), BATCH):
                n += map(sum, segments.counts([segments.cut(t) for t in texts[i : i + BATCH]]))
            return pd.DataFrame({"doc_id": d["doc_id"], "n_bytes": d["n_bytes"], "n_tokens": n})

        yield from each(frames, f)

    return run


def _cut(chunk: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, t in zip(frame["key"], frame["text"]):
                rows = [(key, i, i * chunk + chunk >= len(t), t[i * chunk : (i + 1) * chunk + overlap]) for i in range(max(1, -(-len(t) // chunk)))]
                for j in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[j : j + 256], columns=["key", "i", "last", "piece"])

    return run


def _boundaries(path: str, chunk: int, overlap: int):
    """For each chunk: tokens in all, and pre-token starts in its head and tail overlap with the tokens before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments, m = Segments(path), margin(path)

        def f(d: pd.DataFrame) -> pd.DataFrame:
            out = []
            for key, i, last, piece in zip(d["key"], d["i"], d["last"], d["piece"]):
                n, pos, before = segments.starts(piece)
                head = (pos >= m) & (pos <= overlap - m) & (i > 0)
                tail = (pos >= chunk + m) & (pos <= chunk + overlap - m) & (not last)
                base = int(i) * chunk
                out.append((key, i, last, n, pos[head] + base, before[head], pos[tail] + base, before[tail]))
            return pd.DataFrame(out, columns=["key", "i", "last", "n", "head", "head_n", "tail", "tail_n"])

        yield from each(frames, f)

    return run


def _long(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of long texts; equal texts share a key and are encoded once."""
    done = None
    while True:
        pieces = texts.mapInPandas(_cut(chunk, overlap), "key string, i bigint, last boolean, piece string")
        rows = saved(
            pieces.dropDuplicates(["key", "i"]).mapInPandas(
                _boundaries(path, chunk, overlap),
                "key string, i bigint, last boolean, n bigint, head array<bigint>, head_n array<bigint>, tail array<bigint>, tail_n array<bigint>"),
            "chunks")
        left = rows.filter("NOT last").select("key", "i", "tail", "tail_n")
        right = rows.filter("i > 0").select(F.col("key").alias("k"), (F.col("i") - 1).alias("j"), "head", "head_n")
        p = "get(array_intersect(tail, head), 0)"
        cut = left.join(right, (F.col("key") == F.col("k")) & (F.col("i") == F.col("j"))).select(
            "key", F.expr(f"get(tail_n, cast(array_position(tail, {p}) as int) - 1) - get(head_n, cast(array_position(head, {p}) as int) - 1)").alias("n"))
        parts = cut.union(rows.filter("last").select("key", "n"))
        counts = parts.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.count_if(F.col("n").isNull()).alias("failed"))
        counts = saved(counts, "spliced")
        good = counts.filter("failed = 0").select("key", "n_tokens")
        done = good if done is None else done.union(good)
        bad = counts.filter("failed > 0").select("key")
        if bad.isEmpty():
            return done
        texts = texts.filter(maybe_in(bad, "key", "key")).join(bad, "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): a row per input row."""
    if overlap <= 2 * margin(path) or chunk <= overlap:
        raise ValueError("the overlap must exceed two margins and the chunk the overlap")
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    short = through_pandas(d.filter(F.length("text") <= chunk), _short(path), f"{kind}, n_bytes bigint, n_tokens bigint")
    long = d.filter(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    counts = _long(long.select("key", "text"), path, chunk, overlap)
    spliced = long.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.union(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
