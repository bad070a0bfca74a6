"""Ids above 2^53 beside null ids and repeated rows come back as they were, from every operator."""

from collections import Counter

import pytest

from retentia.llm import common, decontam, langid, lbl_lm, ngram_join, packing, quality_cotrain, queries, token_counts, toxicity

BIG = 2**62
IDS = [None, None, BIG + 1, BIG + 3, BIG + 3, -BIG - 5, 2**53 + 1, *range(1, 40)]


@pytest.fixture(scope="module")
def big(spark):
    rows = [
        (i, f"alpha beta gamma delta {k % 5} epsilon zeta eta theta iota kappa lambda mu", ("en", "de")[k % 2], "s", None if k % 3 else BIG + k, BIG + k)
        for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long").coalesce(1)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)] + [(BIG + 1, 1, 0)], "doc_id long, quality int, toxic int")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_ids_survive(spark, big, marks):
    from pyspark.sql import functions as F

    every, train = Counter(IDS), F.lit(True)
    assert ids(toxicity.score(big, toxicity.fit(big, marks, train)[0])) == every
    assert ids(token_counts.token_counts(big, queries.tokenizer_path(queries.COUNT_TOKENIZER))) == every
    assert ids(quality_cotrain.quality_scores(big, marks)) == every
    assert ids(langid.identify(big, langid.fit(big, train))) == every
    assert ids(packing.pack(big, queries.tokenizer_path(queries.PACK_TOKENIZER))) == every
    assert ids(lbl_lm.score_texts(big, F.lit(False))) == every
    assert ids(ngram_join.ngram_components(big)).keys() == every.keys()


def test_carried_rows_are_whole(spark, big, marks):
    kept = quality_cotrain.keep_good(big, marks)
    rows = Counter(map(tuple, big.collect()))
    assert kept.schema == big.schema and not Counter(map(tuple, kept.collect())) - rows
    same = common.through_pandas(big, lambda frames: frames, big.schema, tuple(big.columns))
    assert Counter(map(tuple, same.collect())) == rows


def test_leaks_name_their_documents(spark, big):
    item = spark.createDataFrame([(BIG + 9, "alpha beta gamma delta 3 epsilon zeta eta theta iota kappa lambda mu"), (None, "nothing like it here at all today")], "item_id long, text string")
    got = decontam.find_leaks(big, item).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for k, i in enumerate(IDS) if k % 5 == 3) and {r.item_id for r in got} == {BIG + 9}
