"""Token windows, their weights and pairs of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ChunkingStrategy, Selector
from ..functions import weights
from ..operators import chunking, selection
from .common import DOCS, SECTIONS, chunk_ctes, docs, h, label, sections
from ..operators.splits import split_label

ONE = ChunkingStrategy(window=128, overlaps=(16,), fallback_tokens=0)
MANY = ChunkingStrategy(window=128, overlaps=(16, 64), fallback_tokens=0)
FULL = ChunkingStrategy(window=128, overlaps=(16,), fallback_tokens=96)
_COLS = "id, view, window_index, overlap, span, n_tokens, text"


def _texts(spark, d):
    return docs(spark, d).select("id", F.lit(0.5).alias("trust"), "text")


def _windows(strategy):
    return lambda spark, d: chunking.windows(_texts(spark, d), strategy).drop("trust")


def chunk_weights(spark, d):
    """The windows and summaries of all records, with their weights and their record's split."""
    chunks = chunking.weighted(chunking.windows(_texts(spark, d).withColumn("split", split_label(F.col("id"))), FULL), FULL)
    return chunks.select("id", "split", "view", "window_index", "n_tokens", "weight")


def auto_chunk_pairs(spark, d):
    return selection.chunk_pairs(chunking.windows(docs(spark, d).select("id", F.lit(1).alias("section_idx"), "text"), MANY))


def proximity(spark, d):
    a, b = F.col("anchor_index"), F.col("positive_index")
    return auto_chunk_pairs(spark, d).select("id", "overlap", F.round(weights.window_distance(a, b), 9).alias("distance"), F.round(weights.proximity(a, b, F.lit(True)), 9).alias("near"), F.round(weights.index_proximity(a), 9).alias("start"))


def _select(kind, value=None):
    return lambda spark, d: selection.select_sections(sections(spark, d), Selector(kind, value)).select("id", "section_idx", "role", F.length("text").alias("n_chars"))


def draw_chunk(spark, d):
    chunks = chunking.windows(_texts(spark, d), FULL)
    return selection.draw_chunk(chunks, ("id",), 1).select("id", "view", "window_index", "overlap", "n_tokens")


_T = f"{DOCS}, texts AS (SELECT id, 0.5::DOUBLE AS trust, text FROM docs)"
_ONE = chunk_ctes("texts", "id", 128, (16,), 0)
_MANY = chunk_ctes("texts", "id", 128, (16, 64), 0)
_FULL = chunk_ctes("texts", "id", 128, (16,), 96)
_KEY = ("'42'", "%s", "id", "'1'", "overlap::VARCHAR")
_PAIRS = f"""WITH {_T}, {_MANY}, found AS (SELECT id, overlap, count(*) AS n FROM chunks WHERE view = 'window' GROUP BY ALL HAVING count(*) >= 2),
drawn AS (SELECT id, overlap, {h("'42'", "'anchor'", *_KEY[2:])} % n AS a, {h("'42'", "'positive'", *_KEY[2:])} % (n - 1) AS b FROM found),
pairs AS (SELECT id, 1 AS section_idx, overlap, a AS anchor_index, CASE WHEN b >= a THEN b + 1 ELSE b END AS positive_index FROM drawn)"""
_PICK = "SELECT id, section_idx, role, length(text)::INT AS n_chars FROM sections"

QUERIES = {
    "chunk_windows": (_windows(ONE), f"WITH {_T}, {_ONE} SELECT {_COLS} FROM chunks"),
    "chunk_multi_overlap": (_windows(MANY), f"WITH {_T}, {_MANY} SELECT {_COLS} FROM chunks"),
    "chunk_summary": (_windows(FULL), f"WITH {_T}, {_FULL} SELECT {_COLS} FROM chunks"),
    "chunk_weights": (
        chunk_weights,
        f"""WITH {_T}, {_FULL} SELECT id, {label('id')} AS split, view, window_index, n_tokens,
  greatest(0.1::DOUBLE, CASE WHEN view = 'summary' THEN 0.35::DOUBLE ELSE 1.0::DOUBLE / (window_index + 1) END * 0.5::DOUBLE) AS weight
  FROM chunks""",
    ),
    "auto_chunk_pairs": (auto_chunk_pairs, f"{_PAIRS} SELECT * FROM pairs"),
    "proximity": (
        proximity,
        f"""{_PAIRS} SELECT id, overlap, round(abs(anchor_index - positive_index)::DOUBLE / (abs(anchor_index - positive_index) + 1), 9) AS distance,
  round(1 - abs(anchor_index - positive_index)::DOUBLE / (abs(anchor_index - positive_index) + 1), 9) AS near, round(1.0::DOUBLE / (anchor_index + 1), 9) AS start FROM pairs""",
    ),
    "select_role": (_select("role", "anchor"), f"WITH {SECTIONS} {_PICK} WHERE role = 'anchor'"),
    "select_paragraph": (_select("paragraph", 1), f"WITH {SECTIONS} {_PICK} WHERE section_idx = 1"),
    "select_random": (_select("random"), f"WITH {SECTIONS} {_PICK} WHERE section_idx = {h(chr(39) + '42' + chr(39), chr(39) + 'random' + chr(39), chr(39) * 2, 'id')} % 2"),
    "draw_chunk": (
        draw_chunk,
        f"""WITH {_T}, {_FULL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY view, overlap, window_index) - 1 AS nth, count(*) OVER (PARTITION BY id) AS n FROM chunks)
SELECT id, view, window_index, overlap, n_tokens FROM ranked WHERE nth = ({h("'42'", "'chunk'", 'id')} + 1) % n""",
    ),
}
