"""Packing documents into fixed-length sequences as a cutting-stock problem.

A document's ids (tokenizer ids and one end id) are cut into full pieces of
``size`` and a rest. Rests are items of the cutting-stock problem: their
lengths, rounded up to a grain, form a histogram (at most size / grain
classes, so it is bounded whatever the corpus).

1. Column generation: the restricted linear program (cover every class with
   the fewest sequences) keeps its basis inverse; a knapsack dynamic program
   prices the best new pattern until the bound is met.
2. Pattern counts are rounded down; the classes still open are filled first
   fit decreasing. Both touch the histogram only.
3. Documents get ranks within their class and take the patterns' places by
   rank. Ranks come from counts per (class, salt) and row numbers inside
   them, so a length that a third of the corpus shares is ranked by many tasks.

Defined cases: null counts as empty, an empty text is the end id alone; a null
doc_id keeps its pieces; repeated rows are packed as often as they occur; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, saved, through_pandas
from .token_counts import tokenizer

SIZE = 2048
GRAIN = 8
END_ID = 1
GAP = 1e-3
TURNS = 40
SALTS = 256
MEMO = 800_000  # words whose ids a worker keeps
PIECES = 400_000  # pieces of words whose ids a worker keeps
WORDS = 2_000  # words in one call of the tokenizer
MARK = "<|startoftext|>"  # a special token, cut out of any text first: it keeps words apart


#: The tokenizer's white space is Unicode's; Python's holds U+001C to U+001F besides, which the tokenizer makes tokens of.
MORE_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in MORE_SPACE) + "]+")


def blank_separated(text: str) -> list[str]:
    """Words between the tokenizer's white space."""
    if any(c in text for c in MORE_SPACE):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


#: The steps before the library's BPE model that ``WordIds._pieces`` takes itself, as a tokenizer file states them.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_LATIN = re.compile("[!-~\xa1-\xff]+")  # Latin-1 without blanks and controls: NFC leaves it as it is
_PLAIN_BYTES = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHAR = {b: chr(b) for b in _PLAIN_BYTES} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN_BYTES)}
_BYTE_CHARS = {c: "".join(_BYTE_CHAR[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class _Memo(dict):
    """Ids by word; ``make`` gives those of a new word, or None, which is not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes | None:
        ids = self.make(word)
        if ids is not None:
            self[word] = ids
        return ids


class WordIds:
    """Ids of whole texts from the ids of their blank-separated words.

    The tokenizer of this operator drops white space and never joins across
    it (its pattern matches no white space and its normaliser works within a
    word), so a text's ids are its words' ids in a row. Distinct words go to the
    library once and stay in a bounded memo. Words of Latin-1 characters are
    lower-cased and cut by the tokenizer's pattern here, and their distinct pieces
    go to the library's BPE model; all other words, and all words if the tokenizer
    file states other steps, go through its whole pipeline.
    """

    def __init__(self, path: str):
        self.tok, self.memo, self.piece_ids, self.late = tokenizer(path), _Memo(self._own), {}, set()
        self.mark, self.model = self.tok.token_to_id(MARK), self.tok.model
        made = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in made["added_tokens"]]
        self.latin = (
            made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == _PRE_TOKENIZER
            and made["post_processor"] is None and all("<|" in c for c in self.special))

    def _own(self, word: str) -> bytes | None:
        """The ids of a word of Latin-1 characters; another is set aside for the whole pipeline."""
        if self.latin and _LATIN.fullmatch(word) and "<|" not in word:
            return self._pieces(word)
        self.late.add(word)
        return None

    def _pieces(self, word: str) -> bytes:
        """The ids of a word of Latin-1 characters."""
        known, out = self.piece_ids, []
        for piece in _PIECE.findall(word.lower()):
            ids = known.get(piece)
            if ids is None:
                if len(known) > PIECES:
                    known.clear()
                text = piece if piece.isascii() else piece.translate(_BYTE_CHARS)
                ids = known[piece] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            out.append(ids)
        return b"".join(out)

    def __call__(self, texts: list[str], end: int) -> list[np.ndarray]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        words = [blank_separated(t) for t in texts]
        known = [list(map(memo.__getitem__, ws)) for ws in words]
        new = list(self.late)
        self.late.clear()
        plain = [w for w in new if MARK not in w]
        for i in range(0, len(plain), WORDS):
            part = plain[i : i + WORDS]
            ids = np.array(self.tok.encode(MARK.join(part), add_special_tokens=False).ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer does not keep the mark apart")
            for w, a, b in zip(part, [0, *(cuts + 1)], [*cuts, len(ids)]):
                memo[w] = ids[a:b].tobytes()
        for w in new:
            if w not in memo:
                memo[w] = np.array(self.tok.encode(w, add_special_tokens=False).ids, dtype=np.uint32).tobytes()
        last = np.array([end], dtype=np.uint32).tobytes()
        for ws, ids in zip(words, known) if new else ():
            if None in ids:
                ids[:] = [memo[w] if i is None else i for w, i in zip(ws, ids)]
        return [np.frombuffer(b"".join(ids) + last, dtype="<u4") for ids in known]


def _pieces(path: str, size: int, end: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = WordIds(path)

        def f(d: pd.DataFrame) -> pd.DataFrame:
            out = []
            for lo in range(0, len(d), 256):
                part = d.iloc[lo : lo + 256]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                for doc, ids in zip(part["doc_id"], ids_of(texts, end)):
                    n = len(ids)
                    for s in range(0, n, size):
                        cut = ids[s : s + size]
                        out.append((doc, s, len(cut), zlib.crc32(cut.tobytes()), n))
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": d["doc_id"].dtype})

        yield from each(frames, f)

    return run


def _best_pattern(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of the highest value."""
    worth = np.full(capacity, -1.0)  # by weight, from 1
    worth[weight - 1] = value
    number = np.zeros(capacity, np.int64)
    number[weight - 1] = np.arange(len(weight))
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        total = best[:c][::-1] + worth[:c]
        j = int(total.argmax())
        if total[j] > best[c - 1]:
            best[c], took[c] = total[j], number[j]
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(weight)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= weight[took[c]]
    return float(best[capacity]), pattern


def column_generation(weight: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts: the linear program's basis.

    Stops when the pricing bound (Farley) proves the value within ``gap`` or
    half a sequence, or after ``TURNS`` pivots a class.
    """
    m = len(weight)
    fit = capacity // weight
    basis, inverse = np.diag(fit.astype(float)), np.diag(1.0 / fit)
    x = demand / fit
    bound = 0.0
    for turn in range(TURNS * m):
        dual = inverse.sum(axis=0)
        value, pattern = _best_pattern(np.maximum(dual, 0), weight, capacity)
        now = float(x.sum())
        bound = max(bound, now / max(value, 1.0))
        if now - bound <= max(gap * now, 0.5):
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        x = np.maximum(x - ratio[r] * step, 0)
        x[r] = ratio[r]
        basis[:, r] = pattern
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
        if turn % 200 == 199:
            inverse += inverse @ (np.eye(m) - basis @ inverse)  # a Newton step undoes the drift
            x = np.maximum(inverse @ demand, 0)
    return basis, x


def first_fit(weight: np.ndarray, open_: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for the open demand: fill one sequence at a time, largest class first."""
    open_, out = open_.copy(), []
    while open_.any():
        pattern, left = np.zeros(len(weight), np.int64), capacity
        for i in np.flatnonzero(open_)[::-1]:
            n = min(int(open_[i]), left // int(weight[i]))
            pattern[i], left = n, left - n * int(weight[i])
        open_ -= pattern
        out.append(pattern)
    return out


def plan(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {class: items}) that hold exactly the demand; classes are weights."""
    if not demand:
        return []
    weight = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[w] for w in weight], dtype=np.int64)
    basis, x = column_generation(weight, need.astype(float), capacity)
    out, left = [], need.copy()
    for p in np.argsort(-x):
        pattern = basis[:, p].round().astype(np.int64)
        used = pattern > 0
        times = min([int(np.floor(x[p] + 1e-6)), *(left[used] // pattern[used])]) if used.any() else 0
        if times > 0:
            left -= times * pattern
            out.append((times, pattern))
    for pattern in first_fit(weight, left, capacity):
        out.append((1, pattern))
    return [(t, {int(weight[i]): int(p[i]) for i in np.flatnonzero(p)}) for t, p in out]


def _places(patterns: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each class and pattern: first rank served, first sequence, items a sequence, first slot."""
    rows, taken, seq = [], {}, 0
    for times, pattern in patterns:
        slot = 0
        for c, n in sorted(pattern.items(), reverse=True):
            rows.append((c, taken.get(c, 0), seq, n, slot))
            taken[c] = taken.get(c, 0) + times * n
            slot += n
        seq += times
    return pd.DataFrame(rows, columns=["c", "rank0", "seq0", "n", "slot0"]).sort_values(["c", "rank0"])


def pack(
    docs: DataFrame, path: str, size: int = SIZE, grain: int = GRAIN, end_id: int = END_ID, salts: int = SALTS
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    if size % grain:
        raise ValueError("the grain must divide the size")
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = saved(through_pandas(d, _pieces(path, size, end_id), schema), "pieces")
    pieces = pieces.withColumn("c", F.expr(f"cast(ceil(length / {grain}) as int)")).withColumn(
        "salt", F.expr(f"cast(pmod(xxhash64(doc_id, start, ids_crc32), {salts}) as int)"))
    hist = pieces.groupBy("c", "salt").agg(F.count("*").alias("n"))
    before = hist.select("c", "salt", F.expr("sum(n) OVER (PARTITION BY c ORDER BY salt) - n").alias("before"))
    demand = {r["c"]: r["n"] for r in hist.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(demand, size // grain))

    rank = F.expr("row_number() OVER (PARTITION BY c, salt ORDER BY length DESC, doc_id, start) - 1")
    ranked = pieces.withColumn("r", rank).join(F.broadcast(before), ["c", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    by_class = {c: g.to_numpy() for c, g in places.groupby("c")}

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def f(x: pd.DataFrame) -> pd.DataFrame:
            seq, slot = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
            c, rank = x["c"].to_numpy(), x["rank"].to_numpy()
            for k in np.unique(c):
                at, p = np.flatnonzero(c == k), by_class[int(k)]
                row = p[np.searchsorted(p[:, 1], rank[at], side="right") - 1]
                j = rank[at] - row[:, 1]
                seq[at], slot[at] = row[:, 2] + j // row[:, 3], row[:, 4] + j % row[:, 3]
            return x[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=seq, slot=slot)

        yield from each(frames, f)

    placed = through_pandas(ranked.drop("r", "before", "salt"), assign, f"{schema}, sequence_id bigint, slot bigint")
    offset = F.expr("coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return placed.withColumn("offset", offset.cast("bigint")).drop("slot")
