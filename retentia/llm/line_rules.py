"""Quality rules from cross-document line frequency (DataFrame functions only).

Lines are normalised (trimmed, lower case, white space runs as one blank) and
hashed; per host (``source``) the documents holding each line are counted. A
line found in more than ``min_docs`` documents of one host and in more than
``max_percent`` per cent of that host's documents is boilerplate: it is removed
from all of them but the first (smallest doc_id). The limit is a share, so a
line is judged alike in small and large hosts and at every input size. A
document whose remaining words are fewer than ``min_words``, or less than
``min_share`` of what it had, is depleted and rejected.

The base rules of the contract are computed in each row: long hash arrays are
sorted in place, so a text costs n log n and nothing of it is shuffled.

Defined cases: a null or empty text has no words and fails the base rules; an
empty table gives no rows; a null source is a host of its own; a doc_id counts
once per line and host however many rows repeat it, all null ids together as
one, which never comes first; rows that repeat a doc_id with another text are
judged each by its own lines, equal rows alike; positions are plain integers,
so a text may be as long as a column value can be; extra columns pass through under their
names if they do not clash with a result column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, plain_blanks

MIN_DOCS = 5
MAX_PERCENT = 1
MIN_WORDS = 50
MIN_SHARE = 0.5

BLANKS = " " + SPACES


def _words(text: str) -> str:
    """Words of a text in which blanks and line feeds are the only white space."""
    return f"array_remove(split(replace({text}, '\\n', ' '), ' '), '')"


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = "coalesce(text, '')"
    d = docs.withColumn("__plain", F.expr(plain_blanks(text)))
    d = d.withColumn("__words", F.expr(_words("__plain")))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("word_chars", F.expr("cast(length(array_join(__words, '')) as bigint)"))
    d = d.withColumn("n_symbols", F.expr(f"cast(length({text}) - length(translate({text}, '#*$%&|<>', '')) as bigint)"))
    lines = f"filter(split({text}, '\\n'), l -> trim('{BLANKS}', l) <> '')"
    d = d.withColumn("__lines", F.expr(lines))
    d = d.withColumn("n_dup_lines", F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)"))
    # Windows: (hash of three words, position) sorts equal windows side by side.
    hashes = "transform(slice(__words, 1, greatest(size(__words) - 2, 0)), (w, i) -> struct(xxhash64(w, __words[i + 1], __words[i + 2]) AS h, i AS i))"
    d = d.withColumn("__k", F.expr(f"sort_array({hashes})"))
    twice = "(i > 0 AND __k[greatest(i - 1, 0)].h = k.h) OR (i < size(__k) - 1 AND __k[least(i + 1, size(__k) - 1)].h = k.h)"
    d = d.withColumn("__p", F.expr(f"sort_array(transform(filter(__k, (k, i) -> {twice}), k -> k.i))"))
    covered = "aggregate(transform(__p, (p, i) -> CASE WHEN i = size(__p) - 1 THEN 3 ELSE least(3, __p[least(i + 1, size(__p) - 1)] - p) END), 0L, (s, x) -> s + x)"
    d = d.withColumn("n_repeat_words", F.expr(covered))
    d = d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return d.drop("__plain", "__words", "__lines", "__k", "__p")


def line_words(docs: DataFrame) -> DataFrame:
    """(doc_id, host, body, no, line, n): each line with a word, its hash and number of words, and the hash of its text."""
    text = F.lower(F.expr(plain_blanks("coalesce(text, '')")))
    return (
        docs.select("doc_id", F.col("source").alias("host"), F.xxhash64("text").alias("body"), F.posexplode(F.split(text, "\n")).alias("no", "l"))
        .select("doc_id", "host", "body", "no", F.expr(_words("l")).alias("ws")).filter("size(ws) > 0")
        .select("doc_id", "host", "body", "no", F.xxhash64("ws").alias("line"), F.size("ws").alias("n"))
    )


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT) -> DataFrame:
    """(host, line, docs, first_doc) of the lines above the limit.

    Counting distinct documents is a count of (host, line, doc_id) groups: the
    first aggregation collapses a document's repeats, the second sums them
    map-side, so that a line found everywhere reaches its reducer as one row
    for each map task. The documents of a host are counted in the same two steps.
    """
    per_doc = line_words(docs).groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one"))
    lines = (
        per_doc.groupBy("host", "line")
        .agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).filter(F.col("docs") > min_docs)
    )
    hosts = docs.select(F.col("source").alias("__host"), "doc_id").distinct().groupBy("__host").agg(F.count("*").alias("__docs"))
    return (
        lines.join(hosts, F.col("host").eqNullSafe(F.col("__host")))
        .filter(F.col("docs") * 100 > F.col("__docs") * max_percent).drop("__host", "__docs")
    )


def quality_rules(
    docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE
) -> DataFrame:
    """One row per input row: the base rules, the words removed, and ``kept``."""
    result = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    own = [c for c in docs.columns if c not in result and c not in ("text",)]
    frequent = frequent_lines(docs, min_docs, max_percent).select(F.col("host").alias("h"), F.col("line").alias("l"), "first_doc")
    lines = line_words(docs)
    gone = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        # rows that repeat a document hold the same lines at the same places: each place counts once
        .groupBy("doc_id", "host", "body", "no").agg(F.max("n").alias("n"))
        .groupBy("doc_id", "host", "body").agg(F.sum("n").alias("__sum"))
        .withColumnsRenamed({"doc_id": "__id", "host": "__host", "body": "__body"})
    )
    base = base_rules(docs.select("doc_id", "source", "text", *[F.col(f"`{c}`") for c in own if c not in ("doc_id", "source")]))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__body"))
    d = base.withColumn("__own", F.xxhash64("text")).join(gone, same, "left")
    d = d.withColumn("removed_words", F.least(F.coalesce("__sum", F.lit(0)).cast("long"), F.col("n_words")))
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & (left >= min_words) & (left >= min_share * F.col("n_words"))
    return d.withColumn("kept", kept).select(*[F.col(f"`{c}`") for c in own], *result)
