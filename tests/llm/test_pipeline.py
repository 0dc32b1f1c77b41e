"""The pipeline's stages over planted documents, against what each must do to its own input."""

import duckdb

import corpus_pipeline
from loomcorpus.llm import near_dedup, packing, quality, secrets
from loomcorpus.llm.common import DOCUMENT_COLUMNS
from tests.llm.cases import COPY, clashing, prose, table
from tests.llm.test_operators import _repeats

SECRET = "q7Xk2LmP9vRt4WzB8nYc3DfG6hJs"
CLEAN = [(i, prose(50 + i, 150), "en", "s", 1) for i in range(20)]
PASSAGE = " ".join(COPY.split()[:60])
ROWS = [
    *CLEAN,
    (100, "menu | menu | menu | menu\n" * 20, "en", "s", 1),
    (101, CLEAN[3][1], "en", "s", 1),
    (102, CLEAN[4][1].replace("a", "a", 1) + " One more sentence here.", "en", "s", 1),
    (103, prose(80, 100) + " " + PASSAGE + " " + prose(81, 30), "en", "s", 1),
    (104, prose(82, 100) + " " + PASSAGE + " " + prose(83, 30), "en", "s", 1),
    (105, prose(84, 100) + f" The key is {SECRET} today.", "en", "s", 1),
    (106, None, "en", "s", 1),
    (None, prose(85, 50), None, None, None),
]


def _stages(spark, docs, tmp_path):
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        f(spark, out[-1], "").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, tmp_path):
    docs, good, near, cut, masked, packed = _stages(spark, clashing(spark, ROWS).toDF("doc_id", "text", "lang", "source", "n_chars", "extra", "T2", "D2", "label"), tmp_path)
    for df in (good, near, cut, masked):
        assert tuple(df.columns) == DOCUMENT_COLUMNS
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(docs) - ids(good) == {100, 106}
    assert ids(good) - ids(near) == {101, 102}
    assert ids(cut) == ids(masked) == ids(near)
    texts = lambda df: {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    before, after = texts(near), texts(cut)
    for d, t in before.items():
        w = t.split()
        gone = {i for e, later, a, b in _repeats(before, 50) if e == d and later for i in range(a, b)}
        assert after[d].split() == [x for i, x in enumerate(w) if i not in gone]
    assert PASSAGE in after[103] and PASSAGE not in after[104]
    assert [d for d, t in texts(masked).items() if t != after[d]] == [105]
    assert SECRET not in texts(masked)[105]
    n = {r.doc_id: r.n_tokens for r in packing.token_lengths(masked).collect()}
    placed = {r.doc_id: r["sum(n_tokens)"] for r in packed.groupBy("doc_id").sum("n_tokens").collect()}
    assert placed == {k: v for k, v in n.items() if v}


def test_quality_stage_matches_sql(spark, tmp_path):
    docs = table(spark, ROWS)
    docs.write.parquet(str(tmp_path / "d"))
    want = duckdb.sql("SELECT doc_id, text FROM (" + quality.SQL_OVER.replace("__docs__", f"read_parquet('{tmp_path}/d/*.parquet')") + ") WHERE keep").fetchall()
    got = [(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_run(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).collect() == []
    table(spark, ROWS).write.parquet(str(tmp_path / "f/documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "f")).collect()
    assert {r.doc_id for r in rows} >= {r[0] for r in CLEAN}


def test_parts_are_there():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
    assert near_dedup.NAME.startswith("op7_") and secrets.NAME.startswith("op10_")
