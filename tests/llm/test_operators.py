import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import (
    common, decontam, langid, lbl_lm, line_dedup, line_rules, ngram_join, packing, quality_cotrain, queries, token_counts, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNT, PACK = (queries.tokenizer_path(n) for n in (queries.COUNT_TOKENIZER, queries.PACK_TOKENIZER))


@pytest.fixture(scope="session")
def docs(spark):
    """A small table of edge cases with a clashing extra column."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog today\nshort line", "en", "a", 60, "x"),
        (2, "The quick brown fox jumps over the lazy dog now\nanother line of quite many different words", "en", "a", 80, "y"),
        (3, None, None, None, None, None),
        (4, "", "en", "a", 0, None),
        (5, " \n\t ", "de", None, 4, None),
        (6, "the quick BROWN fox jumps over the lazy dog today\nshort line", "en", "b", 60, "x"),
        (7, "w " * 40_000 + "end", "de", "b", 80_003, None),
        (8, "ein Wort", "de", "b", 8, None),
        (8, "ein Wort", "de", "b", 8, None),
        (None, "no id but the quick brown fox jumps over the lazy dog today", "en", "b", 60, None),
        (9, "a\x0bb\x0cc\rd\te f　g", "fr", "c", 13, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def near_copies(seed, groups=3, copies=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 80, 160]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_every_operator_on_edge_cases_and_empty_tables(spark, docs, empty, labels):
    none = labels.limit(0)
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    for d, y, b, n in ((docs, labels, benchmark, 11), (empty, none, benchmark.limit(0), 0), (docs, none, benchmark, 11)):
        scorer, _ = toxicity.fit(d, y, common.crc_mod("doc_id", 5) != 0)
        assert all(0 <= r.score <= 1 for r in toxicity.score(d, scorer).collect())
        assert token_counts.token_counts(d, COUNT).count() == n
        assert line_dedup.dedup_lines(d).count() == n
        assert all(0 <= r.score <= 1 for r in quality_cotrain.quality_scores(d, y).collect())
        assert quality_cotrain.keep_good(d, y).columns == d.columns
        assert ngram_join.ngram_components(d).count() == n
        assert decontam.drop_leaks(d, b).columns == d.columns
        got = langid.identify(d, langid.fit(d, common.crc_mod("doc_id", 4) != 2)).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
        assert line_rules.quality_rules(d).count() == n
        assert lbl_lm.score_texts(d, common.crc_mod("doc_id", 7) == 2).count() == n
        assert (packing.pack(d, PACK).select("sequence_id").distinct().count() > 0) == (n > 0)


def test_missing_languages_are_und(docs):
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(docs, common.crc_mod("doc_id", 4) != 99)).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] != "und"


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    texts = ["\n".join(near_copies(seed * 10 + i, 2, 3)) for i in range(12)] + [None, "", "a b", "x y z\nx y z"]
    sets = [((i, n), frozenset(WORD.findall(line.lower()))) for i, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))]
    sets = [(k, s) for k, s in sets if s]
    want = {k for j, (k, s) in enumerate(sets) if any(5 * len(s & u) >= 4 * len(s | u) for _, u in sets[:j])}
    got = line_dedup.similar_lines(frame(spark, texts)).collect()
    assert {(r.doc_id, n) for r in got for n in r.line_nos} == want and want


def test_line_dedup_of_wide_ids_repeats_and_many_lines(spark):
    big, line = 2**62, "one two three four five six"
    long = "\n".join(f"r{k} s{k} t{k}" for k in range(3_000)) + "\n" + "w " * 3_000_000 + "\n" + line
    rows = [
        (big, long, "x", 1), (big + 1, line + " \nkeep this", "x", 1), (-big, "One two", None, None), (5, "one TWO\ntwo", None, None),
        (8, "quite alone here", "a", 1), (8, line + "\nlast of eight", "b", 1), (8, line + "\nlast of eight", "b", 1),
        (None, line, None, None), (9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, lines_removed int")
    assert line_dedup.line_id(docs) == line_dedup.WIDE_ID
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "__id", "lines_removed"]
    kept = Counter((r.doc_id, r.text, r["__id"], r.lines_removed) for r in got.collect())
    assert kept == Counter([
        (big, "\n".join(long.split("\n")[:-1]), "x", 1), (big + 1, "keep this", "x", 1), (-big, "One two", None, 0), (5, "two", None, 1),
        (8, "quite alone here", "a", 0), (8, line + "\nlast of eight", "b", 0), (8, line + "\nlast of eight", "b", 0),
        (None, line, None, 0), (9, None, None, 0)])
    # the short form decides alike
    few = docs.filter("doc_id IS NULL OR doc_id <> 8")
    assert line_dedup.line_id(few.filter(f"abs(doc_id) < {big}")) != line_dedup.WIDE_ID
    small = few.withColumn("doc_id", F.expr(f"CASE WHEN doc_id >= {big} THEN doc_id - {big} + 100 WHEN doc_id = -{big} THEN -7 ELSE doc_id END"))
    assert line_dedup.line_id(small) != line_dedup.WIDE_ID
    assert {(r.doc_id, r.lines_removed) for r in line_dedup.dedup_lines(small).collect()} == {(100, 0), (101, 1), (-7, 0), (5, 1), (None, 0), (9, 0)}


def test_ngram_components_equal_brute_force(spark):
    texts = near_copies(3) + [None, "", " ", "a", "a b", "A  B", "a b c"]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 90 * len(s | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, texts)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert len(set(root)) < len(texts) - 10


def test_sketches_stay_within_the_symmetric_difference():
    rng = np.random.default_rng(3)
    for n, edits in ((1, 1), (40, 4), (900, 90), (900, 0)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[edits:], rng.integers(0, 1 << 63, edits, dtype=np.uint64)]))
        x, y = (ngram_join.sketch(h).view(np.uint64) for h in (a, b))
        assert len(x) == ngram_join.SKETCH_WORDS
        assert sum(int(w).bit_count() for w in x ^ y) <= len(np.setxor1d(a, b))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [" ".join(f"q{rng.randrange(200)}" for _ in range(rng.randrange(3, 50))) for _ in range(30)]
    texts = [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(0, 3000))) + " " + rng.choice(items).upper() + "!" for _ in range(40)]
    texts += [" ".join(rng.choice(items).split()[3:]) for _ in range(20)]

    def grams(t):
        w = decontam.plain_words(t.encode())
        return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)}

    want = {(i, k) for i, t in enumerate(texts) for k, q in enumerate(items) if 5 * len(grams(t) & grams(q)) >= 4 * len(grams(q))}
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame(spark, texts), b).collect()} == want


def test_token_counts_equal_the_library(spark):
    rng = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "é", "'s", "1", "!", "<|endoftext|>", "　", "日本", "<|endof", "text|>", "x" * 30, " " * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 600))) for _ in range(80)] + ["x" * 3000, " " * 2000, None, ""]
    tok = token_counts.tokenizer(COUNT)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, texts), COUNT, chunk=100, overlap=40).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}


def test_segments_encode_as_the_whole_text():
    segments = token_counts.Segments(COUNT)
    assert token_counts.cuttable(segments.tok)
    rng = random.Random(3)
    parts = ["a", "ab", "Zo", "'s", "1", "\u00bd", "e\u0301", "\u4e2d", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\u00a0",
             "\u200b", "\u2028", ",", ".", ",.", "!", "<|endoftext|>", "<|endo", "text|>", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(4000)]
    cut = [segments.cut(t) for t in texts]
    assert ["".join(c) for c in cut] == texts
    want = [len(e) for e in segments.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(map(sum, segments.counts(cut))) == want


def test_held_entries_are_those_of_the_text():
    texts = ["Idiot, idiots. x\u0301y-z idiot", "", None, "\x1cIDIOTIC\x1c.,", "a" * 300]
    for t in texts:
        every = toxicity.entries(t)
        assert toxicity.Held(every | {"=other"})(t) == every


def test_packing_round_trip(spark):
    rng = random.Random(8)
    texts = [" ".join(f"Word{rng.randrange(99)}, it's" for _ in range(rng.randrange(0, 1500))) for _ in range(60)]
    texts += [None, "", "<|startoftext|> q<|endoftext|>", "Ünï ́x　b"]
    tok = token_counts.tokenizer(PACK)
    rows = packing.pack(frame(spark, texts), PACK).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048


def test_column_generation_meets_the_bound():
    rng = np.random.default_rng(1)
    demand = {int(w): int(n) for w, n in zip(range(3, 120), rng.integers(1, 200, 117))}
    patterns = packing.plan(demand, 256)
    got = Counter()
    for times, p in patterns:
        assert sum(w * n for w, n in p.items()) <= 256
        for w, n in p.items():
            got[w] += times * n
    assert got == demand
    assert sum(t for t, _ in patterns) <= 1.02 * sum(w * n for w, n in demand.items()) / 256 + 1


def test_line_rules_equal_brute_force(spark):
    texts = [t + "\nshared boiler line here\n" + t.split(" ")[0] * 2 for t in near_copies(9, 2, 8)] + [None, "", "a b c " * 30, "#q|\n#q|"]
    got = {r.doc_id: r for r in line_rules.quality_rules(frame(spark, texts), min_docs=3, max_percent=1).collect()}
    norm = lambda s: tuple(WORD.findall(s.lower()))
    where = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if norm(line):
                where.setdefault((i % 2, norm(line)), set()).add(i)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        tri = list(zip(w, w[1:], w[2:]))
        n = Counter(tri)
        rep = {p for k, x in enumerate(tri) if n[x] > 1 for p in (k, k + 1, k + 2)}
        lines = [s for s in t.split("\n") if WORD.search(s)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        gone = sum(len(norm(s)) for s in lines if len(where[(i % 2, norm(s))]) > 3 and min(where[(i % 2, norm(s))]) != i)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert (r.base_failed, r.removed_words) == (failed, gone)
        assert r.kept == (not failed and len(w) - gone >= 50 and 2 * (len(w) - gone) >= len(w))


def test_lm_is_normalised_and_counts_are_exact(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the cat", "a dog", "ran fast", f"x{rng.randrange(400)}"]) for _ in range(60)) for _ in range(80)]
    rows = {r.doc_id: r for r in lbl_lm.score_texts(frame(spark, texts), common.crc_mod("doc_id", 7) == 2).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t.split() + [None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = t.split() + [None]
        assert rows[i].base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    k = lbl_lm.VOCAB + lbl_lm.SUFFIXES
    p = lbl_lm.Params(np.full(k, 1 / k))
    ctx = np.random.default_rng(0).integers(0, k, (5, lbl_lm.ORDER))
    assert np.exp(p.log_probs(ctx)).sum(axis=1) == pytest.approx(1, abs=1e-4)
    assert p.target_log_probs(ctx, np.arange(5)) == pytest.approx(p.log_probs(ctx)[np.arange(5), np.arange(5)], abs=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r for r in common.table(spark, sf, "labels").collect()}
    lang = {r.doc_id: r.lang for r in common.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    tox = [(r.predicted, y[r.doc_id].toxic) for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in y]
    assert sum(a == b for a, b in tox) >= 0.93 * len(tox)
    good = [(r.kept, y[r.doc_id].quality == 1) for r in queries.op4_quality(spark, sf).collect() if r.doc_id in y]
    assert sum(a == b for a, b in good) >= 0.95 * len(good)
    spoken = [(r.lang_pred, lang[r.doc_id]) for r in queries.op8_language(spark, sf).collect() if r.held_out]
    assert sum(a == b for a, b in spoken) >= 0.95 * len(spoken)


def test_pipeline_stages_keep_document_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    left, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = common.saved(stage(spark, left, sf), name)
        assert left.columns == docs.columns
        counts.append(left.count())
    assert counts == sorted(counts, reverse=True) and 0.5 * counts[0] < counts[-1] < counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_line_rules_remove_lines_and_reject_depleted_documents_at_production_parameters(spark, tmp_path):
    import duckdb

    from retentia.llm import oracle

    boiler = " ".join(f"b{k}" for k in range(70))
    texts = [" ".join(f"d{i}x{k}" for k in range(60 if i % 2 else 90)) + "\n" + boiler for i in range(240)]
    host = lambda i: "host" if i < 200 else "small" if i < 205 else "large"
    texts += [" ".join(f"e{i}x{k}" for k in range(60)) + ("\n" + boiler if i % 100 == 1 else "") for i in range(240, 1240)]  # 45 of 1,035
    texts += [boiler.upper() + "\n" + " ".join(f"f{k}" for k in range(80))] * 8  # too few of a host's 2,000
    texts += [" ".join(f"g{i}x{k}" for k in range(50)) for i in range(1992)]
    rows = [(i, t, "en", host(i) if i < 1240 else "huge", len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], (7, "other " + texts[8], "en", "host", None), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    cols = "doc_id, n_words, removed_words, base_failed, kept"
    got = {tuple(r) for r in queries.op9_line_rules(spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect()}
    assert {r for r in got if r[0] in range(205) and r[0] != 7} == {
        (i, 160 - 30 * (i % 2), 70 if 0 < i < 200 else 0, False, not (0 < i < 200 and i % 2)) for i in range(205) if i != 7}
    assert {r for r in got if r[0] == 7} == {(7, 130, 70, False, False), (7, 161, 70, False, True)}
    assert {r[2] for r in got if 205 < (r[0] or 0) < 240} == {70} and {r[2] for r in got if (r[0] or 0) >= 1240} == {0}
    assert (None, 0, 0, True, False) in got
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.sql(f"SELECT {cols} FROM ({oracle.OP9})").fetchall()) == got


def test_lm_trains_on_every_share_and_grows_its_outcomes(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the cat", "ran fast", f"x{rng.randrange(900)}"]) for _ in range(400)) for _ in range(120)]
    seen = spark.sparkContext.accumulator(0)
    fit = lbl_lm.nce_fit

    def counted(p, context, slot, inner, *rest):
        seen.add(len(slot))
        return fit(p, context, slot, inner, *rest)

    monkeypatch.setattr(lbl_lm, "nce_fit", counted)
    docs = frame(spark, texts)
    stats = lbl_lm.Stats(lbl_lm.count_tokens(docs))
    p = lbl_lm.train(docs, stats)
    assert seen.value == stats.n
    n = Counter(w for t in texts for w in t.split())
    frequent = [w.encode() for w in n if n[w] >= lbl_lm.MIN_COUNT]
    assert len(frequent) > 1.5 * lbl_lm.VOCAB
    words = [*frequent, b"nowhere"]
    h, cls = np.array([lbl_lm.token_hash(w) for w in words]), np.array([lbl_lm.suffix_class(w) for w in words])
    _, slot, inner = stats.look(h, cls)
    own = (inner == -1) | (inner != stats.starts[cls])
    assert own[:-1].all() and not own[-1]
    assert len(set(zip(slot[:-1], inner[:-1]))) == len(frequent)
    # Both levels together are normalised.
    every = np.concatenate([[(i, -1) for i in range(lbl_lm.VOCAB)], *[
        [(lbl_lm.VOCAB + k, i) for i in range(stats.starts[k], stats.starts[k + 1])] for k in range(lbl_lm.SUFFIXES)]])
    got = p.scores(np.repeat([[1, lbl_lm.TOP + 1, 0]], len(every), axis=0), every[:, 0], every[:, 1])
    assert np.exp(got).sum() == pytest.approx(1, abs=1e-4)


def test_pipeline_near_duplicates_equal_brute_force_on_five_words(spark):
    import corpus_pipeline

    texts = near_copies(11) + [None, "", "a b", "A  b", "a b c d e f g h", "a b c d e f g h i"]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*(w[i:] for i in range(5)))) if len(w) > 4 else ({tuple(w)} if w else set()))

    def kept(sets, percent):
        root = list(range(len(sets)))
        for i, s in enumerate(sets):
            for j in range(i):
                if s and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
        return {i for i, r in enumerate(root) if i == r}

    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts), "").collect()}
    assert got == kept(sets, 80) and got != kept(sets, 90)


def test_packing_keeps_separators_that_the_tokenizer_keeps(spark):
    texts = ["a\x1cb", "\x1c \x1d\x1e a\x1f\x1fb \x85c d e　f\x1c", "a\x0b\x0c\t\r\nb", "\x1c", "     x\x1d<|startoftext|>\x1e"]
    tok = token_counts.tokenizer(PACK)
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(frame(spark, texts), PACK).collect()}
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_members_meet_without_their_sketches(spark):
    sketch = [0] * ngram_join.SKETCH_WORDS
    star = [(1, b, 100, m, [*sketch[1:], sig], e) for b, m, sig, e in ((2, 12, 1, [7, 8]), (3, 12, 3, [8, 9]), (4, 12, (1 << 20) - 1, [8, 7]))]
    star = spark.createDataFrame(star, "a long, b long, n int, m int, sig array<bigint>, e array<bigint>")
    roots = spark.createDataFrame([], "node long, root long")
    for first, want in ((True, {(2, 3)}), (False, {(2, 3)})):
        pairs = ngram_join._within_groups(star, roots, 90, first)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"named_struct\([^)]*sig", plan)  # a row per element, each with eight longs besides
        assert {tuple(r) for r in pairs.collect()} == want


def test_packing_cuts_latin_words_as_the_library():
    tok, rng = token_counts.tokenizer(PACK), random.Random(4)
    ids_of = packing.WordIds(PACK)
    assert ids_of.latin
    calls = []
    ids_of.tok = type("Counted", (), {"encode": lambda self, text, **how: calls.append(text) or tok.encode(text, **how)})()
    plain = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x100)]]
    texts = [a + b for a in plain for b in ("", "s", "É", "'ll", "²")]
    texts += ["".join(rng.choices(plain + ["'S", "'re", " "], k=9)).replace("<|", "") for _ in range(3000)]
    got = ids_of(texts, 1)
    assert not calls  # words of Latin-1 take the model only
    texts += ["a<|endoftext|>b", "<|startoftext|>", "e\u0301\u0130\u03a3", "\x85a\x7fb\x00", "\ufb01n \u4e2d"]
    got += ids_of(texts[len(got):], 1)
    assert calls
    for t, ids in zip(texts, got):
        assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t


def test_pipeline_lines_remove_short_repeats(spark):
    import corpus_pipeline

    texts = ["All rights reserved.\nspam spam spam spam spam\na b c d e", "all  rights reserved.\n\nown", "spam\na b c d\na b c", "own\na b c\nb a", None, " \n "]
    sets = [((i, n), frozenset(WORD.findall(line.lower()))) for i, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))]
    sets = [(k, s) for k, s in sets if s]
    gone = {k for j, (k, s) in enumerate(sets) if any(5 * len(s & u) >= 4 * len(s | u) for _, u in sets[:j])}
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame(spark, texts), "").collect()} == want
    assert want[1] == "\nown" and want[2] == "a b c"


def test_leaking_rows_without_id_go(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, "x " + item, 1), (None, "clean", None), (1, item, 2), (1, "clean too", 3)], "doc_id long, text string, n int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {tuple(r) for r in decontam.drop_leaks(docs, b).collect()} == {(None, "clean", None), (1, "clean too", 3)}


def test_rare_languages_are_learned_at_every_size(spark):
    rng = random.Random(4)
    words = {"en": ["the", "house", "with", "that", "water"], "fr": ["le", "maison", "avec", "que", "eau"], "ru": ["дом", "вода", "что", "как", "это"]}
    langs = ["en"] * 3000 + ["fr"] * 3000 + ["ru"] * 3
    rows = [(i, " ".join(rng.choices(words[s], k=8)), s) for i, s in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, common.crc_mod("doc_id", 4) != 99, max_rows=200)
    assert model.langs == ["en", "fr", "ru"] and model.predict("это вода")[0] == "ru"


def test_members_do_not_meet_on_what_all_differ_in_from_their_lead(spark):
    """A lead unlike all its members: most of their differences from it are common to all, and a few are a member's own."""
    k = ngram_join.FEW + 8
    sig = [0] * ngram_join.SKETCH_WORDS
    own = {b: list(range(100 * b, 100 * b + 12)) for b in range(2, k)}
    own[3] = own[2][:11] + [5000]  # these two link
    rows = [(1, b, True, False, 100, 52, list(range(40)) + e, sig) for b, e in own.items()]
    star = spark.createDataFrame(rows, "a long, b long, many boolean, linked boolean, n int, m int, e array<long>, sig array<long>")
    roots = spark.createDataFrame([], "node long, root long")
    ordered = ngram_join._rarest_first(star, roots, 90)
    for first in (True, False):
        assert {tuple(r) for r in ngram_join._within_groups(ordered, roots, 90, first).collect()} == {(2, 3)}


def test_many_copies_of_an_odd_lead_link_as_by_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:50] + [f"lead{i}" for i in range(4)] + base[54:])]
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(120), rng.choice((1, 2, 3, 5))):
            w[j] = f"x{i}_{j}"
        texts.append(" ".join(w))
    sets = [set(zip(*(t.split()[i:] for i in range(3)))) for t in texts]
    root = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 90 * len(s | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(frame(spark, texts)).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 3


def test_packing_looks_a_word_up_once(monkeypatch):
    class Word(str):
        looks = 0

        def __hash__(self):
            Word.looks += 1
            return str.__hash__(self)

    ids_of, want = packing.WordIds(PACK), packing.WordIds(PACK)
    texts = ["One two, three's", "two 3 three's One"]
    plain = want(texts, 1)
    split = packing.blank_separated
    monkeypatch.setattr(packing, "blank_separated", lambda t: [Word(w) for w in split(t)])
    for most in (7 + 5, 7):  # five words are new and kept, then none
        Word.looks = 0
        got = ids_of(texts, 1)
        assert Word.looks <= most
        assert [x.tolist() for x in got] == [x.tolist() for x in plain]


def test_elements_common_to_a_group_join_as_a_list(spark, monkeypatch):
    """A row for each element of each member would grow with the square of the groups' sizes."""
    k, sig, plans = ngram_join.FEW + 8, [0] * ngram_join.SKETCH_WORDS, []
    rows = [(1, b, True, False, 100, 52, list(range(40)) + list(range(100 * b, 100 * b + 12)), sig) for b in range(2, k)]
    star = spark.createDataFrame(rows, "a long, b long, many boolean, linked boolean, n int, m int, e array<long>, sig array<long>")

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return common.saved(df, *args)

    monkeypatch.setattr(ngram_join, "saved", seen)
    ordered = ngram_join._rarest_first(star, spark.createDataFrame([], "node long, root long"), 90)
    assert not any(re.search(r"Join .*\bel#", p) for p in plans) and any("Join" in p for p in plans)
    assert {tuple(r.e) for r in ordered.collect()} == {tuple(range(100 * b, 100 * b + 12)) for b in range(2, k)}


def test_line_dedup_removes_its_largest_tables_once_read(spark, monkeypatch):
    kept = []
    real = line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df, name, *at: kept.append((name, *at)) or real(df, name, *at))
    texts = [f"one two three four five six seven eight nine ten w{i % 5}\nsolo{i} other{i}" for i in range(40)]
    line_dedup.dedup_lines(frame(spark, texts)).collect()
    gone = {x[0]: x[1] for x in kept if len(x) > 1}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # only within a write
    assert gone.keys() == {"prefixes", "star"} and not any(os.path.exists(p.removeprefix("file:")) for p in gone.values())


def test_lm_scores_few_texts_at_once(spark, monkeypatch):
    """An executor's memory does not hold the token arrays of a whole batch of Spark's."""
    most = spark.sparkContext.accumulator(0)
    scores = lbl_lm.Params.scores

    def counted(self, context, slot, inner):
        most.add(int(len(slot) > 21 * lbl_lm.TEXTS))
        return scores(self, context, slot, inner)

    monkeypatch.setattr(lbl_lm.Params, "scores", counted)
    n = 4 * lbl_lm.TEXTS
    docs = frame(spark, [" ".join(f"w{(i * j) % 50}" for j in range(20)) for i in range(n)]).coalesce(1)
    assert lbl_lm.score_texts(docs, F.col("doc_id") % 7 == 2).filter("n_tokens = 21").count() == n
    assert most.value == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_block_keys_are_shared_by_linked_sets_and_not_by_disjoint_ones(percent):
    rng = np.random.default_rng(8)
    tops = ngram_join.bands(4000, percent)

    def some(n):
        return np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))

    sizes = [*range(percent // (100 - percent), 60), *rng.integers(60, 1500, 140)]
    for n in sizes:
        a = some(int(n))
        gone = int(rng.integers(0, ngram_join.most_apart(len(a), percent) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], some(ngram_join.most_apart(len(a), percent) - gone)]))
        c = len(np.intersect1d(a, b))
        for usual in (None, some(50), np.unique(np.concatenate([a[::2], b[::3]])), np.union1d(a, b)):
            shared = np.intersect1d(ngram_join.block_keys(a, tops, percent, usual), ngram_join.block_keys(b, tops, percent, usual))
            assert len(shared) or 100 * c < percent * (len(a) + len(b) - c)
    passage = some(48)
    keys = np.concatenate([ngram_join.block_keys(np.union1d(passage, some(112)), tops, percent, passage) for _ in range(200)])
    assert len(keys) - len(np.unique(keys)) < 20  # documents that have a usual passage in common do not meet on it
    keys = np.concatenate([ngram_join.block_keys(some(int(n)), tops, percent) for n in rng.integers(100, 1000, 300)])
    assert len(keys) - len(np.unique(keys)) < 30  # a set with few filled blocks may emit an empty one


def test_groups_put_in_order_are_those_whose_members_would_meet(spark, monkeypatch):
    """The differences of other groups are not counted element by element."""
    k, sig, frames = ngram_join.FEW + 8, [0] * ngram_join.SKETCH_WORDS, {}
    rows = [(1, b, True, False, 100, 400, [1000 * b + i for i in range(400)], sig) for b in range(2, k)]
    rows += [(5000, 5000 + b, True, False, 100, 400, [*range(100), *[-1000 * b - i for i in range(300)]], sig) for b in range(2, k)]
    star = spark.createDataFrame(rows, "a long, b long, many boolean, linked boolean, n int, m int, e array<long>, sig array<long>")
    monkeypatch.setattr(ngram_join, "saved", lambda df, name, *at: frames.setdefault(name, common.saved(df, name, *at)))
    ordered = ngram_join._rarest_first(star, spark.createDataFrame([], "node long, root long"), 90)
    assert {r.a for r in frames["crowded"].collect()} == {5000}
    got = {r.b: set(r.e) for r in ordered.collect()}
    assert got == {b: {1000 * b + i for i in range(12)} for b in range(2, k)} | {5000 + b: {-1000 * b - i for i in range(12)} for b in range(2, k)}


def test_line_dedup_meets_sets_in_compiled_arithmetic(spark, monkeypatch):
    """No decimals and no lambda in the filters that every prefix word goes through, and its candidates are made once."""
    plans = {}

    def seen(df, name, *at):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return common.saved(df, name, *at)

    monkeypatch.setattr(line_dedup, "saved", seen)
    rows = frame(spark, [f"one two three four five six seven eight nine w{i}" for i in range(12)])
    assert sum(len(r.line_nos) for r in line_dedup.similar_lines(rows).collect()) == 11
    met = plans["prefixes"]
    assert "decimal" not in met + plans["rest"] and "lambda" not in met.split("Window")[0]
    assert met.count("bit_count") <= line_dedup.BEFORE + 1
