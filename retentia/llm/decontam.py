"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are runs of letters and other non-blank, non-punctuation bytes, A-Z in
lower case; a set holds the distinct 5-word shingles. A document is
contaminated by an item when it holds at least ``containment`` of the item's
shingles, however long it is.

Documents are partitioned by set size (powers of two). In each partition the
one-permutation MinHash signature has four bins for every shingle the
partition's largest set may hold, so the signature grows with the document and
an item's minimum survives in its bin with probability above 0.88, wherever
the item stands. Items get one signature a partition (an LSH ensemble with one
row a band). A document and an item that share a minimum are a candidate;
exact containment of the shingle sets decides. With c shared shingles a match
is missed with probability below 0.12 ** c; items with fewer than
``MIN_HASHED`` shingles are therefore looked up by all their shingles.

The items go to the tasks in blocks of bounded size, one scan of the documents
a block; nothing is shuffled.

Defined cases: null, empty and wordless texts match nothing, as documents and
as items; texts of fewer than five words are one shingle; repeated rows give
repeated results; a null id is reported as null; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, each, shingles, text_bytes, through_pandas

WIDTH = 5
CONTAINMENT = 0.8
BINS_PER_SHINGLE = 4
MIN_HASHED = 8
BLOCK_BYTES = 16 << 20  # item text in one block

_PLAIN = bytes.maketrans(
    (string.ascii_uppercase + string.punctuation).encode(),
    (string.ascii_lowercase + " " * len(string.punctuation)).encode(),
)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def signature(h: np.ndarray, part: int) -> np.ndarray:
    """Bin minima of a sorted hash set; the bin is in the hash's high bits."""
    shift = np.uint64(64 - min(part + BINS_PER_SHINGLE.bit_length(), 48))
    bins = h >> shift
    return h[np.concatenate(([True], bins[1:] != bins[:-1]))] if len(h) else h


class _Index:
    """Signatures of a block of items, made for each partition as it is met."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items, self.parts = items, {}

    def __call__(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        if part not in self.parts:
            sigs = [h if len(h) < MIN_HASHED else signature(h, part) for _, h in self.items]
            value = np.concatenate([np.empty(0, np.uint64), *sigs])
            item = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
            order = np.argsort(value, kind="stable")
            self.parts[part] = value[order], item[order]
        return self.parts[part]

    def candidates(self, h: np.ndarray) -> np.ndarray:
        part = len(h).bit_length()
        value, item = self(part)
        short = [i for i, (_, s) in enumerate(self.items) if 0 < len(s) < MIN_HASHED]
        sig = signature(h, part)
        found = np.searchsorted(sig, value)
        hit = found < len(sig)
        hit[hit] = sig[found[hit]] == value[hit]
        return np.union1d(item[hit], np.array(short, dtype=np.int64)).astype(np.int64)


def _matches(items: list[tuple[int | None, np.ndarray]], index: _Index, h: np.ndarray, containment: float):
    """(item_id, shared, item_shingles) of the items that a text with the shingles ``h`` holds."""
    for i in index.candidates(h) if len(h) else ():
        item, s = items[i]
        n = int(np.isin(s, h, assume_unique=True).sum())
        if n and n >= containment * len(s) - 1e-9:
            yield item, n, len(s)


def _search(items: list[tuple[int | None, np.ndarray]], containment: float, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, index = WordHash(), _Index(items)

        def f(d: pd.DataFrame) -> pd.DataFrame:
            out = []
            for doc, t in zip(d["doc_id"], text_bytes(d["text"])):
                for item, n, size in _matches(items, index, shingles(hashed(plain_words(t)), width), containment):
                    out.append((doc, item, n, size))
            return pd.DataFrame(out, columns=["doc_id", "item_id", "shared", "item_shingles"]).astype(
                {"item_id": "Int64", "shared": "int64", "item_shingles": "int64"})

        yield from each(frames, f)

    return run


def _item_blocks(benchmark: DataFrame, width: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The items with their shingles, a block of ``BLOCK_BYTES`` of text at a time."""
    b = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, hashed = 1 + size // BLOCK_BYTES, WordHash()
    for k in range(n):
        rows = b.filter(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}")).collect()
        yield [(r["item_id"], shingles(hashed(plain_words(t)), width)) for r, t in zip(rows, text_bytes([r["text"] for r in rows]))]


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): every contaminated pair."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, shared bigint, item_shingles bigint"
    out = None
    for items in _item_blocks(benchmark, width):
        part = through_pandas(d, _search(items, containment, width), schema)
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def _clean(items: list[tuple[int | None, np.ndarray]], containment: float, width: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, index = WordHash(), _Index(items)
        for batch in batches:
            texts = text_bytes(batch.column(at).cast(pa.string()).to_pylist())
            sets = (shingles(hashed(plain_words(t)), width) for t in texts)
            yield batch.filter(pa.array([next(_matches(items, index, h, containment), None) is None for h in sets], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their doc_id."""
    for items in _item_blocks(benchmark, width):
        docs = docs.mapInArrow(_clean(items, containment, width, docs.columns.index("text")), docs.schema)
    return docs
