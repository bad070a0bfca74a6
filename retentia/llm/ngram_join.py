"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 3-word shingles (64-bit hashes). Two sets
with 100 |A and B| >= 90 |A or B| differ in at most min(|A|, |B|) / 9 shingles.
The shingles are dealt into blocks by hash, and a block's sketch holds their
parities (the XOR of their hashes). With more blocks than that bound, two
linked sets agree on a block (pigeonhole).

* Size bands: a linked partner lies in the same band or the next, so a
  document emits blocks for its own band (as the smaller side) and, if a
  linked set may lie there, for the band below (as the larger side); each band
  fixes the number of blocks.
* Blocks of few or usual shingles are alike in documents that have little else
  in common, and empty ones in all. So a set emits only its best blocks, one
  more than its bound: those with the most unusual shingles, then with the most
  shingles, then by hash. What is usual tells a sample; a block's rank depends
  on its shingles alone, so any order would give the same links. Of two linked
  sets, take the one that stops at the better rank: the other agrees on one of
  the blocks that it emits, and emits that block too.
* Equal sets collapse to their smallest doc_id first.
* Block rows are shuffled once, by block. Blocks that hold over a
  ``HOT_SHARE``-th of the block rows of a sample are few, so their leads are
  broadcast and their rows stay where they are. The sample only chooses
  between two ways to the same pairs.
* Documents that share a block are first checked against the block's smallest
  document only, the lead of their group. Connected components of those links
  settle groups of copies without pairing their members. Members of a group
  that are still in different components can only link if their differences
  from the lead overlap; a prefix and positional filter on those differences
  and the Hamming distance of fixed-width sketches find all such pairs, and
  no others but a few, for the check. In groups of more than ``FEW`` members
  the elements that most members share come last, so that a lead unlike all
  its members does not make them meet each other.
* Every link is verified on the full shingle sets.

Defined cases: null, empty and blank texts have no shingles and are their own
component; fewer than three words form one shingle; a null doc_id gets a null
component_id and links with nothing; rows that repeat a doc_id are one node;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, ascii_words, components, each, few, maybe_in, mix, removed, saved, scratch, shingles, signed, text_bytes, through_pandas

WIDTH = 3
PERCENT = 90
SKETCH_WORDS = 8  # longs of the sketch that two members of a group compare
SAMPLE = 128  # one in so many documents tells which shingles are usual
USUAL = 1 << 14  # usual shingles at most
HOT_SHARE = 10_000  # at most so many blocks are hot
BATCH = 1_000  # sets that a task holds at once
LEADS = 256  # sets of leads that a task keeps
FEW = 32  # members of a group that may meet on any element
COMMON = 8  # an element that more than one in so many members of a larger group have comes last


def bands(longest: int, percent: int = PERCENT) -> list[int]:
    """Upper size of each band; sizes up to the first allow equal sets only."""
    first = percent // (100 - percent) - 1
    out = [max(first, 1)]
    while out[-1] < longest:
        out.append((out[-1] + 1) * 100 // percent)
    return out


@lru_cache(maxsize=None)
def n_blocks(top: int, percent: int) -> int:
    """Blocks of a slot: so many that most sets of ``top`` shingles have two or more in over ``most_apart`` of them."""
    least = most_apart(top, percent) + 1
    for n in range(least, 2 * least):
        poor = n * (1 - 1 / n) ** top + top * (1 - 1 / n) ** (top - 1)
        if n - poor - 2 * poor**0.5 >= least:
            return n
    return 2 * least


def _blocks(h: np.ndarray, own: np.ndarray, slot: int, top: int, percent: int) -> np.ndarray:
    """Block keys of a set in one slot; ``h`` is sorted, and so are its blocks. ``own`` is 1 for unusual shingles, else 0."""
    n, bound = n_blocks(top, percent), most_apart(min(len(h), top), percent)
    at = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    block, odd = at[first], np.bitwise_xor.reduceat(h, first)
    if len(first) <= bound:
        every = np.zeros(n, np.uint64)
        every[block.astype(np.int64)] = odd
        block, odd = np.arange(n, dtype=np.uint64), every
    key = mix(mix(block + np.uint64(slot << 32)) * np.uint64(0x9E3779B97F4A7C15) ^ odd)
    if len(first) > bound:
        many, size = (np.minimum(x, 0xFFFF).astype(np.uint64) for x in (np.add.reduceat(own, first), np.diff(first, append=len(h))))
        rank = many << np.uint64(48) | size << np.uint64(32) | key >> np.uint64(32)
        key = key[rank >= np.partition(rank, len(rank) - bound - 1)[len(rank) - bound - 1]]
    return signed(key)


def block_keys(h: np.ndarray, tops: list[int], percent: int = PERCENT, usual: np.ndarray | None = None) -> np.ndarray:
    """All block keys of a set: its own band, and the band below if a linked set may lie there. ``usual`` is sorted."""
    band = int(np.searchsorted(tops, len(h)))
    slots = [band] if band else []
    if band > 1 and len(h) * percent <= 100 * tops[band - 1]:
        slots.append(band - 1)
    own = np.ones(len(h), np.int64)
    if slots and usual is not None and len(usual):
        own -= usual[np.minimum(np.searchsorted(usual, h), len(usual) - 1)] == h
    return np.concatenate([np.empty(0, np.int64), *(_blocks(h, own, k, tops[k], percent) for k in slots)])


def usual_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles in three or more documents of a sample, the ``USUAL`` most frequent at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        yield from each(few(frames, BATCH), lambda d: pd.DataFrame({"e": [signed(shingles(hashed(ascii_words(t)), width)) for t in text_bytes(d["text"])]}))

    some = docs.filter(f"pmod(xxhash64(doc_id), {SAMPLE}) = 0").select("text").mapInPandas(run, "e array<bigint>")
    counts = some.select(F.explode("e").alias("el")).groupBy("el").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3")
    return np.sort(np.array([r["el"] for r in counts.orderBy(F.desc("c"), "el").limit(USUAL).collect()], np.int64).view(np.uint64))


def _sets(percent: int, width: int, usual: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        tops = bands(1 << 12, percent)

        def f(d: pd.DataFrame) -> pd.DataFrame:
            nonlocal tops
            n, k1, k2, blocks = [], [], [], []
            for t in text_bytes(d["text"]):
                h = shingles(hashed(ascii_words(t)), width)
                if len(h) > tops[-1]:
                    tops = bands(len(h), percent)
                digest = xxhash.xxh3_128_intdigest(h.tobytes())
                n.append(len(h))
                k1.append((digest >> 64) - (1 << 63))
                k2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                blocks.append(block_keys(h, tops, percent, usual) if len(h) else np.empty(0, np.int64))
            return pd.DataFrame({"doc_id": d["doc_id"], "n": n, "k1": k1, "k2": k2, "blocks": blocks})

        yield from each(few(frames, BATCH), f)

    return run


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity sketch of ``SKETCH_WORDS`` longs, the same width for every set."""
    bits = SKETCH_WORDS * 64
    odd = (np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return signed(np.packbits(odd).view(np.uint64))


def _verdicts(percent: int, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()

        def set_of(text: bytes) -> np.ndarray:
            return shingles(hashed(ascii_words(text)), width)

        lead = lru_cache(maxsize=LEADS)(set_of)  # a lead of many comes again and again

        def f(d: pd.DataFrame) -> pd.DataFrame:
            out = []
            for s, t in zip(text_bytes(d["s"]), text_bytes(d["t"])):
                x, y = lead(s), set_of(t)
                foreign = y[np.isin(y, x, assume_unique=True, invert=True)]
                common = len(y) - len(foreign)
                own = np.concatenate([foreign, x[np.isin(x, y, assume_unique=True, invert=True)]])
                linked = 100 * common >= percent * (len(x) + len(y) - common)
                out.append((linked, len(y), len(own), signed(own), sketch(y)))
            got = pd.DataFrame(out, columns=["linked", "n", "m", "e", "sig"], index=d.index)
            got["e"] = [e if whole else e[: most_apart(n, percent) + 1] for e, n, whole in zip(got["e"], got["n"], d["many"])]
            return pd.concat([d[["a", "b", "many"]], got], axis=1)

        yield from each(few(frames, BATCH), f)

    return run


def _compared(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b, many) with ``linked``, the exact verdict on their shingle sets x and y.

    Besides: n, the size of y; m, that of the symmetric difference; e, its
    elements (with ``many`` all, else a prefix), those foreign to x before the
    others; the sketch of y. Texts are what travels: they take less than half
    the bytes of their sets.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows = docs.filter(maybe_in(ids, "doc_id", "doc_id"))  # read once, for both sides
    both = pairs.join(rows.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a").join(
        rows.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "many", "s", "t").mapInPandas(
        _verdicts(percent, width), "a bigint, b bigint, many boolean, linked boolean, n int, m int, e array<bigint>, sig array<bigint>")


def most_apart(n: int, percent: int) -> int:
    """Largest symmetric difference of linked sets, of which one has n shingles."""
    return n * (100 - percent) // percent


def _most_apart(n: str, percent: int) -> str:
    """``most_apart`` in SQL."""
    return f"cast(floor({n} * {100 - percent} / {percent}D + 1e-9) as int)"


def _open(star: DataFrame, roots: DataFrame, *cols: str) -> DataFrame:
    """(a, b, ``cols``, root) of the groups whose members, lead included, have different roots."""
    named = star.select("a", "b", *cols).join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left").join(
        roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left")
    named = named.select("a", "b", *cols, F.coalesce("rb", "b").alias("root"), F.coalesce("ra", "a").alias("lead_root"))
    open_ = named.groupBy("a").agg(F.min(F.least("root", "lead_root")).alias("lo"), F.max(F.greatest("root", "lead_root")).alias("hi"))
    return named.join(open_.filter("lo <> hi").select("a"), "a", "left_semi").drop("lead_root")


def _rarest_first(star: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``star`` with the prefixes of open groups of many members in another order: elements that few of the members have come first.

    Any order that a group's members have in common serves the prefix filter.
    Where the lead is the odd one out, its members share most of their
    differences from it; such elements come last, so that members do not meet on them.
    A group has at most ``COMMON`` times a member's elements of that kind, on
    average, so they meet its members as one list, not element by element.
    Only groups with such an element in a member's prefix are put in order.
    """
    size = f"{_most_apart('n', percent)} + 1"
    leads = saved(_open(star.filter("many"), roots).groupBy("a").agg(F.count(F.lit(1)).alias("members")), "leads")
    big = star.filter("many").join(leads, "a", "left_semi")

    def often(members: DataFrame, elements: str) -> DataFrame:
        held = members.select("a", F.explode(F.expr(elements)).alias("el")).groupBy("a", "el").agg(F.count(F.lit(1)).alias("c"))
        return held.filter(f"{COMMON} * c > {FEW}").join(leads, "a").filter(f"{COMMON} * c > members")

    crowded = saved(often(big, f"slice(e, 1, {size})").select("a").distinct(), "crowded")
    common = often(big.join(crowded, "a", "left_semi"), "e").groupBy("a").agg(
        F.expr("transform(sort_array(collect_list(struct(c, el))), x -> x.el) AS common"))
    ordered = "coalesce(concat(array_except(e, common), array_intersect(common, e)), e)"
    cut = F.expr(f"slice({ordered}, 1, {size}) AS e")
    big = big.join(common, "a", "left").select("a", "b", "n", "m", cut, "sig")
    return saved(star.filter("NOT many").select(big.columns).union(big), "ordered")


def _within_groups(star: DataFrame, roots: DataFrame, percent: int, first: bool) -> DataFrame:
    """Pairs (a, b) of members of one lead's group that may link and have different roots.

    With u and v the members' differences from the lead, the symmetric
    difference of the members is that of u and v. A link needs an overlap of u
    and v of (|u| + |v| - most apart) / 2, at least 1 for members that the lead
    does not link. So they share an element of their first (most apart + 1)
    elements in any common order; shingles foreign to the lead, the rare ones,
    come first. The positional filter is that of the first shared element.
    The Hamming distance of the members' sketches never exceeds their
    symmetric difference, so it may not exceed the most apart either.
    With ``first``, members meet only the smallest one that has the element.
    """
    rows = _open(star, roots, "n", "m", "e").select("a", "b", "n", "m", "root", F.posexplode("e").alias("p", "el"))
    one = rows.select("a", "el", F.struct("b", "n", "m", "root", "p").alias("u"))
    two = rows.select("a", "el", F.struct("b", "n", "m", "root", "p").alias("v"))
    if first:
        one = one.groupBy("a", "el").agg(F.min("u").alias("u"))
    apart = _most_apart("least(u.n, v.n)", percent)
    need = f"greatest(1, ceil((u.m + v.m - {apart}) / 2D))"
    near = f"100 * least(u.n, v.n) >= {percent} * greatest(u.n, v.n) AND least(u.m - u.p, v.m - v.p) >= {need}"
    met = one.join(two, ["a", "el"]).filter(f"u.b < v.b AND u.root <> v.root AND {near}").selectExpr("u.b AS a", "v.b AS b", f"{apart} AS apart").distinct()
    # Sketches are wide: they meet the pairs that are left, and do not travel with every element.
    sigs = star.groupBy("b").agg(F.any_value("sig").alias("sig"))
    both = met.join(sigs.select(F.col("b").alias("a"), F.col("sig").alias("s")), "a").join(sigs.select("b", F.col("sig").alias("t")), "b")
    hamming = " + ".join(f"bit_count(s[{i}] ^ t[{i}])" for i in range(SKETCH_WORDS))
    return both.filter(f"{hamming} <= apart").select("a", "b")


def _led(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Pairs (a, b): b shares a block with a, the smallest document that has the block. Both hold (doc_id, block)."""
    seen = sample.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    hot = saved(seen.filter((F.col("n") > 1) & (F.col("n") * HOT_SHARE > seen.agg(F.sum("n")).scalar())).select("block"), "hot")
    cold = rows.join(F.broadcast(hot), "block", "left_anti").withColumn("lead", F.min("doc_id").over(Window.partitionBy("block")))
    few = rows.join(F.broadcast(hot), "block", "left_semi")
    leads = few.groupBy("block").agg(F.min("doc_id").alias("lead"))  # a row per hot block, HOT_SHARE at most
    both = cold.select("doc_id", "lead").union(few.join(F.broadcast(leads), "block").select("doc_id", "lead"))
    return both.filter("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()


def ngram_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id: a row per input row."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    blocks = scratch(spark, "sets")
    sets = saved(through_pandas(d, _sets(percent, width, usual_shingles(d, width)), "doc_id bigint, n bigint, k1 bigint, k2 bigint, blocks array<bigint>"), "sets", blocks)
    full = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = saved(full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    # Nearly all documents lead a class, so the others are kept: their ids are few unless copies are many.
    heads = classes.select(F.col("class_id").alias("doc_id"))
    copies = saved(full.select("doc_id").join(heads, "doc_id", "left_anti").distinct(), "copies")
    rows = full.join(copies, "doc_id", "left_anti").select("doc_id", F.explode("blocks").alias("block"))
    sample = full.filter("pmod(xxhash64(doc_id), 128) = 0").select("doc_id", F.explode("blocks").alias("block"))
    pairs = saved(_led(rows, sample), "pairs")
    # From here on the blocks, most of the disk, are not needed.
    sets = saved(sets.drop("blocks"), "sizes")
    removed(spark, blocks)
    many = pairs.groupBy("a").agg((F.count(F.lit(1)) > FEW).alias("many"))
    star = saved(_compared(pairs.join(many, "a"), d, percent, width), "star")
    links = star.filter("linked").select("a", "b")
    roots = components(links)
    # What that left apart: members of one group in different components, again by leads first.
    star = _rarest_first(star, roots, percent)
    for first in (True, False):
        rest = saved(_within_groups(star, roots, percent, first), "rest")
        links = links.union(saved(_compared(rest.withColumn("many", F.lit(False)), d, percent, width).filter("linked").select("a", "b"), "more"))
        roots = components(links)

    out = sets.select("doc_id", "n", "k1", "k2").join(
        classes.withColumnsRenamed({"k1": "c1", "k2": "c2", "n": "cn"}),
        (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("cn")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id."""
    keep = ngram_components(docs, percent, width).filter("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
