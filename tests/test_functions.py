import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus.functions import dates, denoise, metadata, text
from loomcorpus.functions.hashing import hash52, hash52_of


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "x, want",
    [
        ("It costs 1.5 now. Yes! No? End", ["It costs 1.5 now.", "Yes!", "No?", "End"]),
        ("The U.S market fell. Wait... what", ["The U.S market fell.", "Wait...", "what"]),
        ("a\r\n\r\nb  c.\td", ["a", "b c.", "d"]),
        ("  \n\n ", []),
        ("", []),
        ("file.name stays apart", ["file.", "name stays apart"]),
        (None, None),
    ],
)
def test_sentences(spark, x, want):
    assert one(spark, x, text.sentences) == want


@pytest.mark.parametrize("x, want", [("a b c　d", 4), ("  ", 0), ("", 0), ("x​y", 1), ("x\x1fy", 1)])
def test_tokens(spark, x, want):
    assert one(spark, x, text.token_count) == want


@pytest.mark.parametrize(
    "x, want",
    [
        ("| a | b |\n|---|:-:|\nplain", "a b\nplain"),
        ("12 34 56\n---", None),
        ("Revenue 12 34 56 78 90 11 22", "Revenue 12"),
        ("one | pipe", "one | pipe"),
        ("|\t|\n", None),
        (None, None),
    ],
)
def test_denoise(spark, x, want):
    got = one(spark, x, denoise.denoise)
    assert got == want


def _by_waves(d, a, ratio):
    """The search as it is told: one wave after the other."""
    keep = [x > 0 for x in a]
    while True:
        wave = [i for i in range(len(d)) if not keep[i] and (i and keep[i - 1] or i + 1 < len(d) and keep[i + 1])]
        then = [k or i in wave for i, k in enumerate(keep)]
        n, m = sum(x for x, k in zip(d, then) if k), sum(x for x, k in zip(a, then) if k)
        if not wave or n + m and n / (n + m) > ratio:
            return keep
        keep = then


def test_denoise_waves():
    r = random.Random(4)
    for _ in range(2000):
        n = r.randint(1, 14)
        a = [r.choice([0, 0, 0, 1, 5]) for _ in range(n)]
        d = [r.choice([0, 1, 2, 7]) for _ in range(n)]
        assert denoise.keep_mask(np.array(d), np.array(a), 0.35).tolist() == _by_waves(d, a, 0.35)


def test_letters_are_alphabetic_in_all_scripts(spark):
    # the vowel signs count, so 5 letters and 2 digits are under the ratio, 5 and 3 over it
    assert one(spark, "हिन्दी 12", denoise.denoise) == "हिन्दी 12"
    assert one(spark, "हिन्दी 12 34567", denoise.denoise) == "हिन्दी 12"
    assert one(spark, "plain line\nab 1 22 333", denoise.denoise) == "plain line\nab 1"


@pytest.mark.parametrize(
    "folder, want",
    [("04-14-2025--INCOMPLETE", "2025-04-14"), ("2024_10_15", "2024-10-15"), ("04-14", "2025-04-14"), ("13-14", None), ("02-30", None), ("notes", None), ("", None)],
)
def test_folder_dates(spark, folder, want):
    got = one(spark, folder, lambda c: dates.folder_date(F.lit("2025"), c))
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize("folder, want", [("Jan + Feb 2026", "2026-02-01"), ("Dec 2025 + Jan 2026", "2026-01-01"), ("none", None)])
def test_month_ranges(spark, folder, want):
    got = one(spark, folder, lambda c: dates.month_range_date(F.lit("2026"), c))
    assert (got and got.isoformat()) == want


def test_hash_is_portable(spark):
    assert one(spark, "k", lambda c: hash52(42, "split", c)) == hash52_of(42, "split", "k")


def test_prefix(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"))
    draw = lambda emit, presence=1.0: df.select(metadata.KvpPrefix([[metadata.KvpField("a", F.array(F.lit("x"), F.lit("y"), F.lit("")), presence)]], emit).draw(F.col("id")).alias("p")).collect()
    assert {r.p for r in draw(1.0)} == {"meta: a=x", "meta: a=y"}
    assert {r.p for r in draw(0.0)} == {None}
    assert {r.p for r in draw(1.0, 0.0)} == {None}
    some = sum(r.p is not None for r in draw(0.5))
    assert 60 < some < 140


def test_decorate(spark):
    f = lambda p: one(spark, "a b c d", lambda c: metadata.decorate(F.lit(p).cast("string"), text.tokens(c), c, 3))
    assert f(None) == "a b c d"
    assert f("p") == "p\na b"
    assert f("p q r s") == "p q r"


def test_metadata_keys(spark):
    assert one(spark, "date=2024-01-02", lambda c: metadata.taxonomy_value(F.array(F.lit("src"), c), "date")) == "2024-01-02"
    assert one(spark, "other=1", lambda c: metadata.strip("date", c)) is None


def test_byte_similarity_counts_long_texts_in_pieces():
    import tracemalloc

    import pyarrow as pa

    from loomcorpus.functions import weights

    texts = pa.array(["ab" * 2_000_000, None, "", "é", *["abc"] * 600])
    others = pa.array(["a" * 3_000_000, "x", "x", "é", *["abd"] * 600])
    tracemalloc.start()
    got = weights._byte_similarity(texts, others).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # 8 bytes and more a byte of text before
    assert [(x["jaccard"], round(x["cosine"], 6)) for x in got[:4]] == [(0.5, 0.707107), (0, 0), (0, 0), (1, 1)]
    assert {(x["jaccard"], round(x["cosine"], 6)) for x in got[4:]} == {(0.5, 0.666667)}
