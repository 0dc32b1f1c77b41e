import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomcorpus import cli, reports
from loomcorpus.config import ChunkingStrategy, Selector, SamplerConfig, SplitRatios, TripletRecipe, ANCHOR, CONTEXT, tickets, text_recipes
from loomcorpus.errors import ConfigurationError, Exhausted, InvalidWeight, StateError
from loomcorpus.operators import mixing, splits
from loomcorpus.sampler import Prefetcher, Sampler
from loomcorpus.sources import CsvSource, Cursor, FileSource, IndexableAdapter, IndexableSource, InMemorySource, RowSource, TableSource
from loomcorpus.sources.rows import class_labels, decode_lines, parse_source_line, parse_source_list, shard_order, shard_sizes
from loomcorpus.state import MemoryStore, SamplerState, StateStore


def test_csv(spark, tmp_path):
    p = tmp_path / "qa.csv"
    p.write_text('Question,ANSWER\n a? , b \n,skipped\nc?,"d, e"\n')
    rows = CsvSource("qa", str(p), anchor="question", positive="answer").records(spark).orderBy("id").collect()
    assert [(r.id, [s.text for s in r.sections], r.trust) for r in rows] == [("qa::row_1", ["a?", "b"], 0.85), ("qa::row_3", ["c?", "d, e"], 0.85)]
    with pytest.raises(ConfigurationError):
        CsvSource("qa", str(p), text="nothing").records(spark)
    with pytest.raises(ConfigurationError):
        CsvSource("qa", str(p), text="a", anchor="b")
    with pytest.raises(ConfigurationError):
        CsvSource("qa", str(p), positive="answer")
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        CsvSource("qa", str(bad), text="a").records(spark).collect()


def test_files(spark, tmp_path):
    root = tmp_path / "news"
    (root / "2025-01-02").mkdir(parents=True)
    (root / "2025-01-02" / "a_title.txt").write_text("Body one.")
    (root / "Other").mkdir()
    (root / "Other" / "b.TXT").write_text("Body two.")
    (root / "Other" / "c.md").write_text("no")
    src = FileSource("news", str(root), category_trust={"other": 0.3})
    rows = {r.id: r for r in src.records(spark).collect()}
    assert set(rows) == {"news::2025-01-02/a_title.txt", "news::Other/b.TXT"}
    first = rows["news::2025-01-02/a_title.txt"]
    assert [s.text for s in first.sections] == ["a title", "Body one."] and first.taxonomy == ["news", "2025-01-02"] and first.trust == 0.85
    assert rows["news::Other/b.TXT"].trust == 0.3
    assert src.count(spark) == 2
    assert src.capped(spark, 2).count() == 2


def test_rows(spark, tmp_path):
    lines = [{"id": "1", "text": " ", "alt": "x"}, {"id": "2", "text": "y", "alt": None}, {"row": {"id": "3", "text": "z"}}, {"id": "4"}]
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(map(json.dumps, lines)))
    got = RowSource("r", str(p), "jsonl", text=("text", "alt")).records(spark).orderBy("id").collect()
    assert [(r.id, r.sections[0].text) for r in got] == [("r::1", "x"), ("r::2", "y"), ("r::3", "z")]
    df = spark.createDataFrame([(1, "a", "p", "c", 0), (2, "a", None, "c", 1)], "id int, q string, a string, c string, label int")
    got = RowSource("r", "", anchor=("label",), positive=("a", "q"), context=("c",), labels={"label": ["no", "yes"]}).map_rows(df).orderBy("id").collect()
    assert [[s.text for s in r.sections] for r in got] == [["no", "p", "c"], ["yes", "a", "c"]]
    with pytest.raises(ConfigurationError):
        RowSource("r", "", text=("a",), anchor=("b",))


def test_lines(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [1,2], "c": null}',), ('"word"',), ("raw line",)], "value string")
    got = [r.object for r in decode_lines(df, strict=False).collect()]
    assert got == [{"a": "1", "b": "[1,2]", "c": None}, {"text": "word"}, {"text": "raw line"}]
    with pytest.raises(Exception, match="JSON object"):
        decode_lines(df, strict=True).collect()
    with pytest.raises(Exception, match="blank line"):
        decode_lines(spark.createDataFrame([(" ",)], "value string"), strict=False).collect()


def test_source_list():
    a, b, c = parse_source_list("# note\nhf://Org/Set text=body\n\nhf://org/set text=body trust=0.9\nhf://org/x/cfg/train anchor=q positive=a,b source_id=mine")
    assert (a.name, b.name, c.name) == ("org-set.0", "org-set.1", "mine") and b.trust == 0.9 and c.positive == ("a", "b")
    assert "split=train" in c.taxonomy
    for bad in ("nonsense", "hf://o/d", "hf://o/d text=a colour=1", "hf://o/d text=a trust=x"):
        with pytest.raises(ConfigurationError):
            parse_source_line(bad)
    assert class_labels({"dataset_info": {"features": {"l": {"_type": "ClassLabel", "names": ["n", "p"]}, "t": {"_type": "Value"}}}}) == {"l": ["n", "p"]}


def test_mixing(spark):
    plan = mixing.schedule({"a": 6, "b": 6}, {"a": 2.0, "b": 1.0}, 6)
    assert [s for _, s, _ in plan] == ["a", "b", "a", "a", "b", "a"]
    assert {s for _, s, _ in mixing.schedule({"a": 2, "b": 2}, {"b": 0.0}, 9)} == {"a"}
    assert len(mixing.schedule({"a": 2, "b": 2}, {"a": 0.0, "b": 0.0}, 9)) == 4
    for bad in ({"c": 1.0}, {"a": -1.0}):
        with pytest.raises(InvalidWeight):
            mixing.check_weights(bad, {"a"})
    blocks = mixing.grouped_order({"big": 90, "small": 10}, 10)
    assert sum(n for *_, n in blocks) == 100 and max(n for at, *_, n in blocks if at < 10) <= 5
    src = InMemorySource("m")
    src.add(*[{"id": f"m::{i}", "sections": []} for i in range(5)])
    assert [r.id for r in src.page(spark, 3, 3).collect()] == ["m::3", "m::4", "m::0"]


def _sampler(spark, n=40, **kw):
    src = InMemorySource("s")
    sec = lambda role, t: {"role": role, "heading": None, "text": t, "sentences": []}
    src.add(*[{"id": f"s::{i:03}", "trust": 1.0, "taxonomy": ["s"], "sections": [sec("anchor", f"title {i}"), sec("context", f"body {i} " * 9)]} for i in range(n)])
    recipes = (TripletRecipe("r", ANCHOR, CONTEXT, CONTEXT),)
    return Sampler(spark, SamplerConfig(recipes=recipes, chunking=ChunkingStrategy(window=8, overlaps=(2,)), **kw), [src])


def test_batches(spark):
    all_of = lambda size: [r.slot_id for b in _sampler(spark, batch_size=size).batches() for r in b]
    small, large = list(dict.fromkeys(all_of(4))), list(dict.fromkeys(all_of(7)))
    assert small == large and len(small) > 20
    s = _sampler(spark)
    train = {r.id for r in splits.assign(s.records().select("id")).filter("split = 'train'").collect()}
    rows = s.triplets().collect()
    assert {x for r in rows for x in (r.anchor_id, r.negative_id)} <= train
    assert all(r.negative_id != r.anchor_id for r in rows)
    swapped = sum(not r.anchor_text.startswith("title") for r in rows)
    assert 0 < swapped < len(rows)
    assert s.pairs().count() == 2 * len(rows)
    assert {r.recipe.removeprefix("s_long_sections").removeprefix("r") for r in s.texts().collect()} <= {"_anchor", "_positive", "_negative"}
    with pytest.raises(ConfigurationError):
        s.triplets("test")
    with pytest.raises(Exhausted):
        list(_sampler(spark, n=1).batches())


def test_prefetcher_hands_errors_on():
    def items():
        yield 1
        raise ValueError("x")

    p = Prefetcher(items())
    assert next(p) == 1
    with pytest.raises(ValueError):
        next(p)
    with pytest.raises(StopIteration):
        next(p)


def test_config():
    assert tickets({"a": 0.75, "b": 0.25, "c": 0.0, "d": 100.0}) == {"a": 3, "b": 1, "d": 16}
    with pytest.raises(ConfigurationError):
        tickets({"a": 0.0})
    with pytest.raises(ConfigurationError):
        SplitRatios(0.5, 0.1, 0.1)
    with pytest.raises(ConfigurationError):
        ChunkingStrategy(window=0)
    with pytest.raises(ConfigurationError):
        Selector("nothing")
    assert len(text_recipes(SamplerConfig(recipes=(TripletRecipe("r"),)))) == 3


def test_pages_go_round(spark):
    rows = [{"id": f"m::{i}", "updated_at": datetime(2024, 1, 1 + i), "sections": []} for i in range(7)]
    src = TableSource("m", InMemorySource("m", rows).records(spark))
    first = src.refresh(spark, limit=5)
    second = src.refresh(spark, first.cursor, 5)
    ids = lambda p: {r.id for r in p.records.collect()}
    assert len(ids(first)) == len(ids(second)) == 5 and ids(first) | ids(second) == {r["id"] for r in rows}
    assert (first.cursor.revision, second.cursor.revision) == (5, 3) and second.cursor.last_seen == datetime(2024, 1, 7)
    assert ids(src.refresh(spark, Cursor(99), 5)) == ids(first) and src.refresh(spark, None, 5, seed=7).records.count() == 5
    memory = InMemorySource("m", rows)
    assert [r.id for r in memory.refresh(spark, Cursor(5), 4).records.collect()] == ["m::5", "m::6", "m::0", "m::1"]
    assert src.refresh(spark, limit=99).records.count() == 7 and InMemorySource("e").refresh(spark, None, 3).records.count() == 0


def test_holes_are_skipped(spark):
    class Sparse(IndexableSource):
        name = "x"

        def len_hint(self, spark):
            return 20

        def rows(self, spark):
            df = InMemorySource("x", [{"id": f"x::{i}", "sections": []} for i in range(20)]).records(spark)
            return df.filter("row_idx % 4 <> 0")

    src, cursor, seen = IndexableAdapter(Sparse()), None, []
    for _ in range(3):
        page = src.refresh(spark, cursor, 5)
        seen += [r.id for r in page.records.collect()]
        cursor = page.cursor
    assert len(seen) == 15 and set(seen) == {f"x::{i}" for i in range(20) if i % 4}
    assert src.count(spark) == 20

    class Endless(IndexableSource):
        name = "y"

    with pytest.raises(ConfigurationError):
        IndexableAdapter(Endless()).refresh(spark)


def test_rows_are_told_apart_without_ids(spark, tmp_path):
    spark.range(9).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("body")).repartition(3).write.parquet(str(tmp_path / "p"))
    src = RowSource("r", str(tmp_path / "p"), text=("body",))
    ids = {r.id: r.sections[0].text for r in src.records(spark).collect()}
    again = {r.id: r.sections[0].text for r in src.records(spark).repartition(2).collect()}
    assert len(ids) == 9 and ids == again
    (tmp_path / "l.txt").write_text("one\ntwo\none\n\tx\n")
    lines = RowSource("l", str(tmp_path / "l.txt"), "text", text=("text",)).records(spark).collect()
    assert len({r.id for r in lines}) == 4 and sorted(r.sections[0].text for r in lines) == ["\tx", "one", "one", "two"]
    with pytest.raises(ConfigurationError):
        src.map_rows(spark.createDataFrame([("a",)], "body string"))
    assert src.map_rows(spark.createDataFrame([("a", " \t\n")], "id string, body string")).count() == 0


def test_transcoded_rows_read_alike(spark, tmp_path):
    lines = [{"id": str(i), "q": f"q{i}", "a": f"a{i}" if i != 2 else " ", "c": "k", "label": i % 2} for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    key = lambda src: sorted((r.id, [(s.role, s.text) for s in r.sections]) for r in src.records(spark).collect())
    for roles in ({"anchor": ("q",), "positive": ("a",), "context": ("c",)}, {"anchor": ("a",)}, {"text": ("a", "q")}):
        src = RowSource("r", str(tmp_path / "a.jsonl"), "jsonl", **roles)
        assert key(src.transcode(spark, str(tmp_path / "out"))) == key(src) != []


def test_shards_and_sizes():
    paths = [f"s{i}" for i in range(9)]
    order = shard_order(paths, "src")
    assert sorted(order) == paths != order and shard_order(paths[::-1], "src") == order != shard_order(paths, "src", 7)
    assert shard_sizes({"size": {"splits": [{"split": "train", "num_rows": 3}, {"config": "x"}]}}) == {"train": 3}


def test_samplers_go_on_where_they_stopped(spark, tmp_path):
    s = _sampler(spark, batch_size=4)
    slots = [r.slot_id for b in s.batches(epoch=0) for r in b]
    took = [next(iter_) for iter_ in [s.batches()] for _ in range(2)]
    store = StateStore(str(tmp_path / "s.json"))
    store.save(s.state)
    later = _sampler(spark, batch_size=4).restore(store.load(42))
    rest = list(later.batches())
    assert [r.slot_id for b in took + rest for r in b] == slots
    assert (later.state.epoch, later.state.next_slot) == (1, 0)
    pairs = _sampler(spark, batch_size=4)
    whole = [(r.slot_id, r.nth) for b in pairs.batches("pairs", epoch=0) for r in b]
    assert whole[:2] == [(whole[0][0], 0), (whole[0][0], 1)]
    pairs.state.next_slot = 8
    assert [(r.slot_id, r.nth) for b in pairs.batches("pairs") for r in b][: len(whole) - 8] == whole[8:]


def test_overrides_come_before_hashed_labels(spark):
    s = _sampler(spark)
    ids = sorted(r.id for r in s.records().collect())
    s.restore(SamplerState(overrides={i: "test" for i in ids[:30]}))
    assert {r.anchor_id for r in s.triplets().collect()} <= set(ids[30:])


def _two(spark, **kw):
    sec = lambda role, t: {"role": role, "heading": None, "text": t, "sentences": []}
    rows = lambda n: [{"id": f"{n}::{i:03}", "trust": 1.0, "taxonomy": [n], "sections": [sec("anchor", f"title {n} {i}"), sec("context", f"body {n} {i}")]} for i in range(40)]
    recipes = (TripletRecipe("r", ANCHOR, CONTEXT, CONTEXT),)
    return Sampler(spark, SamplerConfig(recipes=recipes, batch_size=6, **kw), [InMemorySource(n, rows(n)) for n in "ab"])


def test_sources_take_turns_by_weight(spark):
    first = next(_two(spark).batches(epoch=0, weights={"a": 2.0, "b": 1.0}))
    assert Counter(r.anchor_id[0] for r in first) == {"a": 4, "b": 2}
    assert {r.anchor_id[0] for b in _two(spark).batches(epoch=0, weights={"b": 0.0}) for r in b} == {"a"}
    with pytest.raises(InvalidWeight):
        _two(spark).batches(weights={"c": 1.0})


def test_ingestion_is_limited_and_goes_on(spark):
    s = _two(spark, max_records=10)
    first = {r.id for r in s.ingest().collect()}
    assert len(first) == 20 and s.state.cursors == {"a": 10, "b": 10}
    assert not first & {r.id for r in s.ingest().collect()}
    assert {r.anchor_id for r in s.triplets().collect()} <= {r.id for r in s.records().collect()}
    mixed = s.ingest(9, {"a": 2.0, "b": 1.0}).collect()
    assert Counter(r.source for r in mixed) == {"a": 6, "b": 3}
    assert all(x.records == 9 and x.per_second > 0 for x in s.stats)

    class Broken(InMemorySource):
        def refresh(self, *a, **k):
            raise OSError("gone")

    s.register(Broken("z"))
    s.ingest()
    assert [(x.source, x.error) for x in s.stats] == [("a", None), ("b", None), ("z", "gone")]
    with pytest.raises(OSError):
        Sampler(spark, SamplerConfig(), [Broken("z")]).ingest()


def test_long_sections_get_a_recipe(spark):
    s = _sampler(spark)
    assert [r.name for r in s._recipes(s.records())["s"]] == ["r", "s_long_sections"]
    assert {r.recipe for r in s.triplets().collect()} == {"r", "s_long_sections"}
    assert [r.name for r in _sampler(spark, long_sections=False)._recipes(s.records())["s"]] == ["r"]


def test_reconciled_orders(spark):
    order = spark.createDataFrame([("s", f"r{i}", i) for i in range(6)], "source string, id string, pos long")
    used = order.filter("id in ('r0', 'r3')").select("id")
    got = [r.id for r in splits.reconcile(order, used, span=2).orderBy("pos").collect()]
    assert got == ["r1", "r2", "r4", "r5", "r0", "r3"]
    same = splits.population_checksum(order).first().checksum
    assert [r.id for r in splits.resumed(order, used, same).orderBy("pos").collect()] == [f"r{i}" for i in range(6)]
    assert [r.id for r in splits.resumed(order, used, same + 1).orderBy("pos").collect()] == got


def test_commands(spark, tmp_path, capsys):
    for i in range(12):
        d = tmp_path / "news" / f"2025-01-{i % 3 + 1:02}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"item_{i}.txt").write_text(f"Body number {i}. It has words.")
    root = str(tmp_path / "news")
    cli.main(["capacity", "--source-root", root])
    out = capsys.readouterr().out
    assert "all sources / all splits: 12 records" in out and "replay 1.00x" in out
    state = str(tmp_path / "state.json")
    for kind in ([], ["--pair-batch"], ["--text-recipes"]):
        cli.main(["demo", "--source-root", root, "--batches", "2", "--batch-size", "2", "--split-store-path", state, "--reset", "--ingestion-max-records", "8", *kind])
        out = capsys.readouterr().out
        assert "batch 1: 2 " in out and "news 100%" in out and "news: 8 records" in out
        assert StateStore(state).load().next_slot == 4 and StateStore(state).load().cursors == {"news": 8}
    cli.main(["demo", "--source-root", root, "--list-text-recipes"])
    assert "title_context_wrong_article_anchor 0.75" in capsys.readouterr().out
    for bad in (["--batch-size", "0"], ["--split-ratios", "1,1,1"], ["--batches", "x"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["demo", "--source-root", root, *bad])


def test_printed_numbers():
    assert [reports.grouped_digits(x) for x in (0, 999, 1234567)] == ["0", "999", "1,234,567"]
    assert [reports.replay_factor(*x) for x in ((10, 4), (0, 1), (3, 0))] == ["2.50x", "n/a", "n/a"]
    assert reports.preview("a \n b" + "c" * 200, 10) == "a bcccccc…"


def test_state(tmp_path):
    store = StateStore(str(tmp_path / "s.json"))
    store.save(SamplerState(seed=1).advance(25, 10))
    state = store.load(1)
    assert (state.epoch, state.next_slot) == (2, 5)
    with pytest.raises(StateError):
        store.load(2)
    with pytest.raises(StateError):
        store.save(state, store.path)


def test_states_in_memory():
    store, state = MemoryStore(), SamplerState(seed=3, cursors={"a": 1})
    with pytest.raises(StateError):
        store.load()
    store.save(state)
    state.cursors["a"] = 9
    assert store.load(3).cursors == {"a": 1}
    with pytest.raises(StateError):
        store.load(4)
    store.save(state, "copy")
    with pytest.raises(StateError):
        store.save(state, "copy")


def test_streaming(spark, tmp_path):
    from loomcorpus.streaming import ingest

    schema = "source string, id string, version long"
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "z", 1)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "cache"), str(tmp_path / "cp"), 1).awaitTermination()
    last = sorted((tmp_path / "cache").iterdir(), key=lambda p: int(p.name.split("=")[1]))[-1]
    assert {tuple(r) for r in spark.read.parquet(str(last)).select("source", "id", "version").collect()} == {("a", "x", 3), ("b", "z", 1)}
