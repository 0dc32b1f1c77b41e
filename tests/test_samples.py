"""Samples of recipes with equal selectors and of selectors other than roles; BM25 negatives with a fallback."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomcorpus.config import CONTEXT, ChunkingStrategy, Selector, TextRecipe, TripletRecipe, long_section_recipe, row_recipes, title_context_recipes
from loomcorpus.errors import ConfigurationError
from loomcorpus.functions import metadata
from loomcorpus.operators import chunking, metrics, sampling, selection

STRATEGY = ChunkingStrategy(window=8, overlaps=(0,), fallback_tokens=0)


def tables(spark, words):
    rows = [(f"d{i}", j, "context", 1.0, " ".join(f"w{i}x{j}x{k}" for k in range(words))) for i in range(6) for j in range(2 if words < 8 else 1)]
    sections = spark.createDataFrame(rows, "id string, section_idx int, role string, trust double, text string")
    pool = sections.select("id").distinct().select("id", F.lit("s").alias("source"), F.lit("train").alias("split"), F.lit(None).cast("date").alias("date"))
    return sections, pool


def test_a_text_may_be_its_own_positive(spark):
    sections, pool = tables(spark, 5)
    sections = sections.filter("section_idx = 0")
    got = sampling.triplets(sections, pool, row_recipes(False), STRATEGY).collect()
    assert sorted(x.slot_id for x in got) == [f"d{i}" for i in range(6)]
    assert all(x.anchor_text == x.positive_text != x.negative_text for x in got)
    assert sampling.triplets(sections, pool, (TripletRecipe("r", CONTEXT, CONTEXT, CONTEXT),), STRATEGY).collect() == []


def test_equal_selectors_give_two_chunks(spark):
    sections, pool = tables(spark, 20)
    got = sampling.triplets(sections, pool, (TripletRecipe("r", CONTEXT, CONTEXT, CONTEXT),), STRATEGY).collect()
    assert len(got) == 6 and all(x.anchor_text != x.positive_text and x.anchor_text.split("x")[0] == x.positive_text.split("x")[0] for x in got)


def test_selectors_other_than_roles(spark):
    sections, pool = tables(spark, 5)
    recipe = TripletRecipe("r", Selector("paragraph", 0), Selector("paragraph", 1), Selector("random"))
    got = sampling.triplets(sections, pool, (recipe,), STRATEGY).collect()
    assert len(got) == 6 and all({x.anchor_text.split("x")[1], x.positive_text.split("x")[1]} == {"0", "1"} for x in got)
    assert sampling.texts(sections, (TextRecipe("t", Selector("random")),), STRATEGY).count() == 6
    with pytest.raises(ConfigurationError):
        sampling.texts(sections, (TextRecipe("t", Selector("temporal_offset", 1)),), STRATEGY)


def test_anchors_without_a_bm25_hit_fall_back(spark):
    rows = [("a", "s", "train", "red fox"), ("b", "s", "train", "red fox runs"), ("c", "s", "train", "blue"), ("d", "t", "train", "alone"), ("e", "u", "test", "single")]
    pool = spark.createDataFrame(rows, "id string, source string, split string, text string").withColumn("date", F.lit(None).cast("date"))
    got = {x.id: x for x in selection.bm25_negative(selection.bm25_top(pool), pool.drop("text")).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"].negative_id, got["a"].fallback, got["b"].negative_id, got["b"].fallback) == ("b", False, "a", False)
    assert got["c"].negative_id in ("a", "b") and got["c"].fallback
    assert got["d"].negative_id in ("a", "b", "c") and got["d"].fallback
    rate = metrics.fallback_rate(selection.bm25_negative(selection.bm25_top(pool), pool.drop("text"))).first()
    assert (rate.fallbacks, rate.selections) == (2, 4)


def test_blocks_of_documents_score_alike(spark, monkeypatch):
    r = random.Random(2)
    rows = [(f"d{i:03}", "st"[i % 7 == 0], " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(r.randint(1, 12)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id string, source string, text string")
    whole = sorted(map(tuple, selection.bm25_top(docs, top=5).collect()))
    monkeypatch.setattr(selection, "BLOCK_DOCS", 7)
    monkeypatch.setattr(selection, "BLOCK_ANCHORS", 11)
    assert sorted(map(tuple, selection.bm25_top(docs, top=5).collect())) == whole and len(whole) > 400


def test_bm25_by_brute_force(spark):
    """Common terms, of which only those count that can lift a document into the best, and rare ones."""
    r = random.Random(3)
    rows = [(f"d{i:03}", "s", " ".join(["the"] * r.randint(1, 3) + [r.choice("abcd") for _ in range(6)] + [f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 9))])) for i in range(150)]
    top = selection.bm25_top(spark.createDataFrame(rows, "id string, source string, text string"), top=4)
    assert top._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1  # the terms of anchors are weighed once
    toks = {i: t.split() for i, _, t in rows}
    mean, df = sum(map(len, toks.values())) / len(toks), {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    part = lambda w, t: math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    got = {(x.anchor, x["rank"]): (x.id, x.score) for x in top.collect()}
    for a, q in toks.items():
        scores = sorted((-round(sum(part(w, t) for w in set(q)), 6), i) for i, t in toks.items())[:4]
        assert [got[a, k + 1] for k in range(4)] == [(i, -s) for s, i in scores]


def test_a_role_of_several_sections_gives_one_sample_a_slot(spark):
    rows = [(f"d{i}", j, role, 1.0, f"{role} {i} {j} text") for i in range(30) for j, role in enumerate(("anchor", "context", "context"))]
    sections = spark.createDataFrame(rows, "id string, section_idx int, role string, trust double, text string")
    pool = sections.select("id").distinct().select("id", F.lit("s").alias("source"), F.lit("train").alias("split"), F.lit(None).cast("date").alias("date"))
    got = sampling.triplets(sections, pool, title_context_recipes(), STRATEGY).collect()
    assert sorted(x.slot_id for x in got) == sorted({f"d{i}" for i in range(30)})
    assert {x.positive_text.split()[2] for x in got if x.positive_text.startswith("context")} == {"1", "2"}


def test_two_windows_of_a_long_section(spark):
    sections, pool = tables(spark, 40)
    got = sampling.triplets(sections, pool, (long_section_recipe("s"),), STRATEGY).collect()
    assert len(got) == 6
    for x in got:
        i, j = (int(t.split()[0].split("x")[2]) // 8 for t in (x.anchor_text, x.positive_text))
        near = 1 - abs(i - j) / (abs(i - j) + 1)
        assert i != j and x.anchor_id == x.positive_id and abs(x.weight - (2 * max(0.1, near) + 1) / 3) < 1e-9
    assert sampling.triplets(*tables(spark, 5), (long_section_recipe("s"),), STRATEGY).collect() == []


def test_proximity_counts_for_windows_of_one_section(spark):
    sections, pool = tables(spark, 20)
    for x in sampling.triplets(sections, pool, (TripletRecipe("r", CONTEXT, CONTEXT, CONTEXT),), STRATEGY).collect():
        i, j = (int(t.split()[0].split("x")[2]) // 8 for t in (x.anchor_text, x.positive_text))
        near = 1 / (abs(i - j) + 1)
        assert abs(x.weight - (max(0.1, near / (i + 1)) + max(0.1, near / (j + 1)) + 1) / 3) < 1e-9


def test_neighbours_in_time_as_positives(spark):
    rows = [(f"d{i}", "context", 1.0, f"text {i}") for i in range(8)]
    sections = spark.createDataFrame(rows, "id string, role string, trust double, text string").withColumn("section_idx", F.lit(0))
    pool = spark.createDataFrame([(f"d{i}", "s" if i < 4 else "t", "train", datetime(2024, 1, 1) + timedelta(days=i), "x" if i in (3, 4) else f"x{i}") for i in range(8)], "id string, source string, split string, created_at timestamp, taxon string")
    pool = pool.withColumn("date", F.lit(None).cast("date"))
    near = {r.id: r.neighbor_id for r in selection.temporal_neighbor(pool, 1, ("source", "split"), ("taxon", "split")).collect()}
    assert near == {"d0": "d1", "d1": "d2", "d2": "d3", "d3": "d4", "d4": "d5", "d5": "d6", "d6": "d7", "d7": "d6"}
    got = sampling.triplets(sections, pool, (TripletRecipe("r", CONTEXT, Selector("temporal_offset", 1), CONTEXT),), STRATEGY).collect()
    assert got and all(near[x.slot_id] in (x.anchor_id, x.positive_id) and x.slot_id in (x.anchor_id, x.positive_id) for x in got)
    with pytest.raises(ConfigurationError):
        selection.select_sections(sections, Selector("temporal_offset", 1))


@pytest.mark.parametrize("whole", [0, 20])
def test_neighbours_in_time_of_large_and_small_groups(spark, monkeypatch, whole):
    """Groups of more than WHOLE records are searched by ranges, the others are one range."""
    monkeypatch.setattr(selection, "RANGES", 5)
    monkeypatch.setattr(selection, "WHOLE", whole)
    r = random.Random(8)
    rows = [(f"r{i}", "gh"[i % 5 == 0], datetime(2024, 1, 1) + timedelta(hours=r.choice([0, 1, 9, 30, 400, 700]))) for i in range(60)]
    want = {i: min((abs(u - t - timedelta(days=2)), j) for j, h, u in rows if h == g and j != i)[1] for i, g, t in rows}
    found = selection.temporal_neighbor(spark.createDataFrame(rows, "id string, source string, created_at timestamp"), 2, ("source",))
    assert {x.id: x.neighbor_id for x in found.collect()} == want


@pytest.mark.parametrize("ranges", [selection.RANGES, 3])
def test_neighbours_in_time_by_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(selection, "RANGES", ranges)
    r = random.Random(6)
    rows = [(f"r{i}", "gh"[i % 9 == 0], datetime(2024, 1, 1) + timedelta(days=r.choice([0, 1, 1, 2, 30, 31, 400]), hours=r.choice([0, 0, 5]))) for i in range(80)]
    df = spark.createDataFrame([*rows, ("alone", "z", datetime(2024, 1, 1)), ("never", "g", None)], "id string, source string, created_at timestamp")
    for days in (0, 30, -1):
        want = {}
        for i, g, t in rows:
            aim = t + timedelta(days=days)
            want[i] = min((abs(u - aim), j) for j, h, u in rows if h == g and j != i)[1]
        assert {x.id: x.neighbor_id for x in selection.temporal_neighbor(df, days, ("source",)).collect()} == want


def test_tokenizers_can_be_given(spark):
    df = spark.createDataFrame([("a", "x-y-z w-v")], "id string, text string")
    strategy = ChunkingStrategy(window=2, overlaps=(0,), fallback_tokens=0, tokenizer=lambda c: F.split(c, "[- ]"))
    assert [x.text for x in chunking.windows(df, strategy).orderBy("window_index").collect()] == ["x y", "z w", "v"]


def test_texts_are_cut_into_tokens_once_a_pass(spark):
    sections, _ = tables(spark, 5)
    plan = chunking.windows(sections, STRATEGY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # a filter on their number would cut them again


def test_instructions_reasons_and_prefixes(spark):
    sections, pool = tables(spark, 5)
    sections = sections.filter("section_idx = 0")
    recipe = TripletRecipe("r", CONTEXT, CONTEXT, CONTEXT, "question_answer_mismatch", instruction="find it", allow_same_anchor_positive=True)
    meta = (metadata.KvpPrefix([[metadata.KvpField("src", F.array("source"))]]), pool)
    got = sampling.triplets(sections, pool, (recipe,), STRATEGY, meta=meta)
    rows = got.collect()
    assert all(x.anchor_meta == x.positive_meta == x.negative_meta == ["src=s"] for x in rows)
    assert len(rows) == 6 and all(x.instruction == "find it" and x.anchor_text.startswith("meta: src=s\nw") for x in rows)
    assert [(x.label, x.reason) for x in sampling.pairs(got).orderBy("slot_id", "nth").collect()] == [("positive", None), ("negative", "wrong_qa_pairing")] * 6
    assert all(x.text.startswith("meta: src=s\n") for x in sampling.texts(sections, (TextRecipe("t", CONTEXT),), STRATEGY, meta=meta).collect())
    tight = ChunkingStrategy(window=4, overlaps=(0,), fallback_tokens=0)
    assert all(len(x.text.split()) <= 4 for x in sampling.texts(sections, (TextRecipe("t", CONTEXT),), tight, meta=meta).collect())


def test_chunkers_and_backends_can_be_given(spark):
    sections, pool = tables(spark, 5)
    sections = sections.filter("section_idx = 0")

    def first_word(df, strategy):
        word = F.substring_index("text", " ", 1)
        return df.select("id", "section_idx", "role", "trust", F.lit("window").alias("view"), F.lit(0).alias("window_index"), F.lit(0).alias("overlap"), F.lit(1).alias("span"), F.lit(1).alias("n_tokens"), word.alias("text"))

    class Next(selection.NegativeBackend):
        def choose(self, strategy, pool, anchors, seed):
            assert set(anchors.columns) == {"id", "text"}
            return pool.select("id", F.concat(F.lit("d"), ((F.substring("id", 2, 9).cast("int") + 1) % 6).cast("string")).alias("negative_id"), F.lit(False).alias("fallback"))

    got = sampling.triplets(sections, pool, row_recipes(False), STRATEGY, backend=Next(), chunker=first_word).collect()
    assert {(x.slot_id, x.negative_id, x.negative_text) for x in got} == {(f"d{i}", f"d{(i + 1) % 6}", f"w{(i + 1) % 6}x0x0") for i in range(6)}
    hard = sampling.triplets(sections, pool, row_recipes(False), STRATEGY, backend=selection.Bm25Backend(sections.select("id", F.lit("s").alias("source"), "text"))).collect()
    assert len(hard) == 6 and all(x.recipe.endswith("_fallback_same_split") for x in hard)  # no two texts share a word


def test_sources_draw_from_recipes_of_their_own(spark):
    sections, pool = tables(spark, 5)
    sections = sections.filter("section_idx = 0")
    pool = pool.withColumn("source", F.when(F.col("id") < "d3", "s").otherwise("t"))
    two = {"s": (TripletRecipe("one", CONTEXT, CONTEXT, CONTEXT, allow_same_anchor_positive=True),), "t": (TripletRecipe("two", CONTEXT, CONTEXT, CONTEXT, allow_same_anchor_positive=True),)}
    got = sampling.triplets(sections, pool, two, STRATEGY).collect()
    assert sorted((x.slot_id, x.recipe) for x in got) == [(f"d{i}", "one" if i < 3 else "two") for i in range(6)]


def test_search_text_of_records(spark):
    row = ("r", "s", [("anchor", "Head", "a b", []), ("context", None, "  ", []), ("context", None, "c d", [])])
    df = spark.createDataFrame([row, ("q", "s", [])], "id string, source string, sections array<struct<role: string, heading: string, text: string, sentences: array<string>>>")
    assert {r.id: r.text for r in selection.record_text(df).collect()} == {"r": "Head\na b\nc d", "q": "q"}
    assert selection.record_text(df, 2).filter("id = 'r'").first().text == "Head a"
