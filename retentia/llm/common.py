"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.context import ensure_checkpoint_dir

#: The contracts' word separators: the ASCII white space, nothing else.
SPACES = r"\t\u000b\u000c\r"  # as a SQL literal; line feed and blank apart


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run, or written, inside give their shuffle files back as soon as they have run.

    Otherwise these stay on the executors' disks until the driver collects its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder and read back.

    It cuts the lineage, so that a lost executor costs no more than the stages
    after it, and it keeps an intermediate result that several steps read. Its
    shuffles are done with, so they go. ``at`` names a folder for ``removed``.
    """
    spark = df.sparkSession
    path = at or scratch(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a saved table that no frame still to be run reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def plain_blanks(text: str) -> str:
    """SQL of ``text`` with the rarer ASCII white space as blanks (line feeds stay); most texts hold none."""
    return (
        f"CASE WHEN contains({text}, '\\t') OR contains({text}, '\\r') OR contains({text}, '\\u000b') OR contains({text}, '\\u000c')"
        f" THEN translate({text}, '{SPACES}', '    ') ELSE {text} END"
    )


def bucket(col: str, n: int) -> Column:
    """crc32 of the id as text, mod ``n``: the folds the contracts fix."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def crc_mod(col: str, n: int) -> Column:
    """``bucket`` with a null id put into fold 0."""
    return F.coalesce(bucket(col, n), F.lit(0))


def text_bytes(texts) -> list[bytes]:
    """UTF-8 of each text, ``b""`` for a null."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def ascii_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, split on the ASCII white space (what ``bytes`` methods do)."""
    return text.lower().split()


class WordHash:
    """64-bit word hashes with a bounded memo of the words seen."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.memo = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, get = self.memo, self.memo.get
        if len(memo) > self.limit:
            memo.clear()
        out = [get(w) for w in words]
        if None in out:
            digest = xxhash.xxh3_64_intdigest
            for i, h in enumerate(out):
                if h is None:
                    memo[words[i]] = out[i] = digest(words[i])
        return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles.

    With fewer than k words the whole sequence counts as one shingle; without
    words there is none.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - width + 1 + j])
    return np.unique(h)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(h).view(np.int64)


def each(frames: Iterator[pd.DataFrame], f) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            yield f(frame)


def few(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``rows`` at most, so that a task holds no more of what it derives from them."""
    for frame in frames:
        yield from (frame.iloc[i : i + rows] for i in range(0, len(frame), rows))


def through_pandas(df: DataFrame, run, schema: str | T.StructType, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``mapInPandas`` that hands the columns ``carry`` through unchanged.

    A null among integers makes floats of all in its batch, and those above
    2^53 lose digits. So carried integers travel as text and come back as they were.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = {f.name: f.dataType for f in df.schema if f.name in carry and isinstance(f.dataType, T.IntegralType)}
    as_text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in whole else f for f in out])
    rows = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in whole}).mapInPandas(run, as_text)
    return rows.withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in whole.items()})


def maybe_in(ids: DataFrame, col: str, probe: str, words: int = 1 << 16) -> Column:
    """A test that holds for every value of ``ids[col]`` and for few others.

    A one-hash bitmap of fixed size (64 bits in each of ``words`` longs) is
    made by a scalar subquery. It only spares work: a join still decides.
    ``probe`` is the SQL of the value to test.
    """
    def slot(x: str) -> str:
        return f"pmod(xxhash64({x}), {words * 64})"

    every = ids.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("bit"))
    bits = ids.select(F.expr(f"cast(shiftright({slot(col)}, 6) as int) AS w"), F.expr(f"shiftleft(1L, cast({slot(col)} & 63 as int)) AS bit"))
    one = bits.union(every).groupBy("w").agg(F.expr("bit_or(bit) AS bits")).agg(
        F.expr("transform(sort_array(collect_list(struct(w, bits))), x -> x.bits) AS map"))
    word = F.get(one.scalar(), F.expr(f"cast(shiftright({slot(probe)}, 6) as int)"))
    return F.call_function("shiftright", word, F.expr(f"cast({slot(probe)} & 63 as int)")).bitwiseAND(F.lit(1)) == 1


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable by the links (a, b); nodes without links are absent.

    Alternating large-star and small-star steps (Kiveris et al. 2014): a hub's
    links meet its minimum, which a map-side aggregation found, and never each
    other. The driver sees two numbers a round.
    """
    e = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(low, F.col("u") == F.col("k"))
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        e = saved(small.filter("u <> v").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        last = now


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/retentia-{name}-{uuid.uuid4().hex}"
