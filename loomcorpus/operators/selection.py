"""Choice of sections and chunks, negatives by rank, temporal neighbours and BM25.

Negatives are never found by comparing all pairs: candidates are ranked within their group, a rank
is drawn by hash with the anchor's own block skipped, and the drawn rank is joined."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Selector
from ..errors import ConfigurationError
from ..functions.hashing import hash52
from ..functions.text import SPACES, tokens


def select_sections(sections: DataFrame, selector: Selector, seed: int = 42, visit: int = 0) -> DataFrame:
    """One section of each record: of a role or any (from a hashed start, one further each visit), or
    the i-th. Records without such a section are left out."""
    if selector.kind == "temporal_offset":
        raise ConfigurationError("a neighbour in time is another record: see temporal_neighbor")
    if selector.kind == "paragraph":
        return sections.filter(F.col("section_idx") == int(selector.value))
    pool = sections.filter(F.col("role") == selector.value) if selector.kind == "role" else sections
    by = Window.partitionBy("id")
    drawn = (hash52(seed, selector.kind, selector.value or "", F.col("id")) + visit) % F.count("*").over(by)
    ranked = pool.withColumn("nth", F.row_number().over(by.orderBy("section_idx")) - 1).withColumn("drawn", drawn)
    return ranked.filter("nth = drawn").drop("nth", "drawn")


def draw_chunk(chunks: DataFrame, by: tuple[str, ...], visit: Column | int = 0, seed: int = 42) -> DataFrame:
    """One chunk of each group: a hashed start, then one further each visit."""
    w = Window.partitionBy(*by)
    at = (hash52(seed, "chunk", *[F.col(c) for c in by]) + visit) % F.count("*").over(w)
    ranked = chunks.withColumn("nth", F.row_number().over(w.orderBy("view", "overlap", "window_index")) - 1).withColumn("drawn", at)
    return ranked.filter("nth = drawn").drop("nth", "drawn")


def chunk_pairs(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """Two different windows of each long section: id, section_idx, anchor_index, positive_index. The
    second is drawn from the n - 1 others, so nothing is drawn again."""
    found = chunks.filter("view = 'window'").groupBy("id", "section_idx", "overlap").agg(F.count("*").alias("n")).filter("n >= 2")
    key = [F.col("id"), F.col("section_idx"), F.col("overlap")]
    a = hash52(seed, "anchor", *key) % F.col("n")
    b = hash52(seed, "positive", *key) % (F.col("n") - 1)
    return found.select("id", "section_idx", "overlap", a.alias("anchor_index"), F.when(b >= a, b + 1).otherwise(b).alias("positive_index"))


#: A group is ranked in 2^BITS ranges of the hash of its ids, so that no task sorts a whole source or split.
BITS = 8


def _ranked(pool: DataFrame, by: list[str], first: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The pool with rk, its rank in its group by (first, range of the hash, id), and n, the group's size;
    and the sizes of the ranges. Through a group's task go only those."""
    ranged = pool.withColumn("rg", F.shiftright(hash52("rank", F.col("id")), 52 - BITS).cast("int"))
    key = [*by, *first, "rg"]
    sizes = ranged.groupBy(*key).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    before = F.sum("c").over(group.orderBy(*first, "rg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    sizes = sizes.select(*key, before.alias("before"), F.sum("c").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("id")) - 1
    return ranged.withColumn("in", inside).join(sizes, key).withColumn("rk", F.col("before") + F.col("in")), sizes


def _draw(pool: DataFrame, by: list[str], purpose: str, seed: int) -> DataFrame:
    """id, neg of every record of a group with others."""
    ranked, _ = _ranked(pool, by)
    r = hash52(seed, purpose, F.col("id")) % (F.col("n") - 1)
    asked = ranked.filter("n > 1").select("id", *by, F.when(r >= F.col("rk"), r + 1).otherwise(r).alias("want"))
    other = ranked.select(*by, F.col("rk").alias("want"), F.col("id").alias("neg"))
    return asked.join(other, [*by, "want"]).select("id", "neg")


def _tiers(pool: DataFrame, tiers: list[tuple[DataFrame, bool]]) -> DataFrame:
    out, picked = pool.select("id"), F.lit(None).cast("string")
    fallback = F.lit(None).cast("boolean")
    for i, (t, is_fallback) in enumerate(tiers):
        out = out.join(t.withColumnRenamed("neg", f"n{i}"), "id", "left")
        fallback = F.coalesce(fallback, F.when(picked.isNull() & F.col(f"n{i}").isNotNull(), F.lit(is_fallback)))
        picked = F.coalesce(picked, F.col(f"n{i}"))
    return out.select("id", picked.alias("negative_id"), fallback.alias("fallback")).filter("negative_id is not null")


def wrong_article(pool: DataFrame, seed: int = 42) -> DataFrame:
    """id, negative_id, fallback. pool: id, source, split, date (may be null). Another record of the
    same source and date, else of the source, else of the split (fallback)."""
    same_date = _draw(pool.filter("date is not null"), ["source", "split", "date"], "wrong_article", seed)
    return _tiers(pool, [(same_date, False), (_draw(pool, ["source", "split"], "wrong_article", seed), False), (_draw(pool, ["split"], "wrong_article", seed), True)])


def wrong_date(pool: DataFrame, seed: int = 42) -> DataFrame:
    """id, negative_id, fallback: another record of the source with another date, or with one where the
    anchor has none; else any other of the split. The records of a source are ranked by date, so the
    anchor's own date is one block, which the draw skips."""
    by = ["source", "split"]
    ranked, sizes = _ranked(pool.withColumn("day", F.coalesce(F.col("date").cast("string"), F.lit(""))), by, ("day",))
    ranked = ranked.join(sizes.groupBy(*by, "day").agg(F.min("before").alias("lo")), [*by, "day"])
    ranked = ranked.join(pool.groupBy(*by, F.coalesce(F.col("date").cast("string"), F.lit("")).alias("day")).agg(F.count("*").alias("size")), [*by, "day"])
    r = hash52(seed, "wrong_date", F.col("id")) % (F.col("n") - F.col("size"))
    asked = ranked.filter("n > size").withColumn("want", F.when(r >= F.col("lo"), r + F.col("size")).otherwise(r))
    other = ranked.select(*by, F.col("rk").alias("want"), F.col("id").alias("neg"))
    dated = asked.join(other, [*by, "want"]).select("id", "neg")
    return _tiers(pool, [(dated, False), (_draw(pool, ["split"], "wrong_date", seed), True)])


def qa_mismatch(pool: DataFrame, seed: int = 42) -> DataFrame:
    """id, negative_id, fallback: another record of the source, else of the split."""
    return _tiers(pool, [(_draw(pool, ["source", "split"], "qa", seed), False), (_draw(pool, ["split"], "qa", seed), True)])


def temporal_neighbor(df: DataFrame, days: int, by: tuple[str, ...] = ("source", "split"), also: tuple[str, ...] | None = None) -> DataFrame:
    """id, neighbor_id: the other record of the group (``by``, or the second group ``also``) nearest in
    time to created_at + days; the smaller id of equally near ones."""
    found = _nearest(df, days, by)
    if also:
        more = df.filter(" and ".join(f"{c} is not null" for c in also))
        found = found.unionByName(_nearest(more, days, also)).groupBy("id").agg(F.min("best").alias("best"))
    return found.select("id", F.col("best.i").alias("neighbor_id"))


#: Ranges of time in which a group is searched, each on its own; a group of at most WHOLE records is one range.
RANGES, WHOLE = 256, 50_000


def _nearest(df: DataFrame, days: int, by: tuple[str, ...]) -> DataFrame:
    """id, best: struct of distance and id of the nearest other record of the group.

    Distinct times are searched, not records: in each range of time one sort of points and targets gives
    the two points before and behind each target, where the range ends those next to the range. No pair
    is compared, and no task sorts more of a large group than a range's times. Only large groups, of which
    there are few, have ranges to look beyond."""
    base = df.select(F.struct(*by).alias("g"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "id").filter("at is not null")
    low, high = base.agg(F.min("at"), F.max("at")).first()
    width = max(1, ((high or 0) - (low or 0)) // RANGES + 1)
    large = F.broadcast(base.groupBy("g").agg(F.count("*").alias("c")).filter(F.col("c") > WHOLE).select("g", F.lit(True).alias("large")))
    rg = F.when(F.col("large"), F.floor((F.col("at") - F.lit(low or 0)) / F.lit(width))).otherwise(F.lit(0)).alias("rg")
    # of records at the same time only the two smallest ids can be an answer
    tied = base.withColumn("k", F.row_number().over(Window.partitionBy("g", "at").orderBy("id"))).filter("k <= 2")
    points = tied.groupBy("g", "at").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(large, "g", "left").select("g", "at", "large", rg, F.struct("at", "ids").alias("p"))
    shifted = points.select("g", (F.col("at") + days * 86_400_000_000).alias("at"), "large")
    inside = Window.partitionBy("g", "rg")
    some = lambda *c: F.array_compact(F.array(*c))
    lined = points.select("*", some(F.lag("p").over(inside.orderBy("at")), F.col("p")).alias("left"), some(F.col("p"), F.lead("p").over(inside.orderBy("at"))).alias("right"))
    asks = shifted.select("g", "at", rg, "large")
    both = lined.select("g", "at", "rg", F.lit(1).alias("kind"), "left", "right").unionByName(asks.drop("large").withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order, back = inside.orderBy("at", F.col("kind").desc()), inside.orderBy(F.desc("at"), "kind")  # a frame up to the end would go through it for each row
    seen = both.withColumn("l", F.last("left", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.last("right", True).over(back.rowsBetween(Window.unboundedPreceding, -1))).filter("kind = 0")
    far, sought = points.filter("large"), asks.filter("large")
    ends = far.withColumn("k", F.row_number().over(inside.orderBy("at"))).withColumn("z", F.row_number().over(inside.orderBy(F.desc("at")))).filter("k <= 2 or z <= 2")
    ends = ends.groupBy("g", "rg").agg(F.sort_array(F.collect_list("p")).alias("e"))
    last2 = lambda c: F.slice(c, F.greatest(F.size(c) - 1, F.lit(1)), F.lit(2))
    along = Window.partitionBy("g").orderBy("rg")
    edges = sought.select("g", "rg").union(far.select("g", "rg")).distinct().join(ends, ["g", "rg"], "left")  # RANGES rows a group, and those that targets reach
    earlier = F.flatten(F.collect_list(last2("e")).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    beyond = F.flatten(F.collect_list(F.slice("e", 1, 2)).over(along.rowsBetween(1, Window.unboundedFollowing)))
    edges = edges.select("g", "rg", earlier.alias("b"), beyond.alias("a")).select("g", "rg", last2("b").alias("b"), F.slice("a", 1, 2).alias("a"))
    around = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<struct<at: bigint, ids: array<string>>>")) for c in ("l", "r", "b", "a")]))
    near = seen.join(edges, ["g", "rg"], "left").select("g", "at", around.alias("around"))
    asked = base.select("g", "id", (F.col("at") + days * 86_400_000_000).alias("at")).join(near, ["g", "at"])
    options = F.flatten(F.transform("around", lambda p: F.transform(F.filter(p["ids"], lambda i: i != F.col("id")), lambda i: F.struct(F.abs(p["at"] - F.col("at")).alias("d"), i.alias("i")))))
    return asked.select("id", F.array_min(options).alias("best")).filter("best is not null")


K1, B = 1.2, 0.75
TOP = 32
QUERY_TOKENS = 64
#: Documents, and anchors, of one source that one task scores against each other. Each document is sent once for
#: each block of anchors, each anchor once for each block of documents.
BLOCK_DOCS, BLOCK_ANCHORS = 8192, 65536
#: Terms of lower idf are in more than an eighth of the documents: a block keeps their weights as one row a term,
#: of CELLS numbers in all.
COMMON, CELLS = float(np.log(8)), 1 << 23
_HITS = "source string, anchor string, id string, score double"


def record_text(records: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """source, id, text: what a record is searched by: the headings and texts of its sections, a line
    each, its id where they are blank, ``max_tokens`` tokens at most."""
    lines = F.flatten(F.transform("sections", lambda s: F.filter(F.array(s["heading"], s["text"]), lambda x: x.isNotNull() & (F.size(tokens(x)) > 0))))
    body = F.array_join(lines, "\n")
    words = tokens(body)
    cut = F.when(F.size(words) <= max_tokens, body).otherwise(F.array_join(F.slice(words, 1, max_tokens), " "))
    return records.select("source", "id", F.when(F.size(words) > 0, cut).otherwise(F.col("id")).alias("text"))


def bm25_top(docs: DataFrame, top: int = TOP, query_tokens: int = QUERY_TOKENS, anchors: DataFrame | None = None) -> DataFrame:
    """anchor, id, score, rank: per source, the best documents for each anchor's first tokens, best
    first, then by id; a document that is an anchor is among its own. docs: source, id, text; anchors:
    the same, or all documents. Sources with fewer than two documents have no index.

    Blocks of a source's documents are scored against blocks of its anchors: rare terms by the block's
    postings, common ones by a row of weights, the latter only where they can still lift a document into
    the ``top`` of the block; these are merged. So no term, however frequent, and no source, however
    large, gives a task more than its two blocks."""
    toks = lambda df: df.select("source", "id", tokens(F.lower("text")).alias("t")).filter(F.size("t") > 0)
    texts = toks(docs)
    stats = texts.groupBy("source").agg(F.count("*").alias("nd"), F.avg(F.size("t")).alias("mean")).filter("nd >= 2")
    df = texts.select("source", F.explode(F.array_distinct("t")).alias("term")).groupBy("source", "term").agg(F.count("*").alias("df"))
    begun = F.array_remove(F.split(F.lower("text"), SPACES, query_tokens + 2), "")  # one more may be empty, the last is the rest
    asked = (anchors if anchors is not None else docs).select("source", F.col("id").alias("anchor"), F.explode(F.array_distinct(F.slice(begun, 1, query_tokens))).alias("term"))
    idf = F.log(1 + (F.col("nd") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, ["source", "term"]).join(F.broadcast(stats), "source")
    queries = weighed.groupBy("source", "anchor").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("q"))
    queries = queries.select("source", "anchor", F.array_join("q.term", " ").alias("terms"), F.col("q.idf").alias("idf"))  # terms hold no white space
    asking = (anchors if anchors is not None else docs).groupBy("source").agg(F.count("*").alias("na"))  # blank ones too: only sets how many blocks
    grid = F.broadcast(stats.join(asking, "source").select("source", "mean", F.ceil(F.col("nd") / BLOCK_DOCS).cast("int").alias("blocks"), F.ceil(F.col("na") / BLOCK_ANCHORS).cast("int").alias("chunks")))
    cell = lambda id, own, other: (F.pmod(F.xxhash64(id), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    mine, each = cell("id", "blocks", "chunks")
    held = texts.join(grid, "source").select("source", "id", "t", "mean", mine.alias("block"), each.alias("chunk"))
    mine, each = cell("anchor", "chunks", "blocks")
    searched = queries.join(grid, "source").select(F.col("source").alias("_source"), "anchor", "terms", "idf", mine.alias("_chunk"), each.alias("_block"))
    both = held.groupBy("source", "block", "chunk").cogroup(searched.groupBy("_source", "_block", "_chunk"))
    scores = both.applyInArrow(lambda d, q: _scored(d, q, top), _HITS)
    rank = F.row_number().over(Window.partitionBy("source", "anchor").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= top).select("source", "anchor", "id", "score", "rank")


def _scored(docs: pa.Table, queries: pa.Table, top: int) -> pa.Table:
    """The ``top`` documents of a block for each query that has any of its terms. A score is summed over the
    rare terms, then over the common ones."""
    schema = pa.schema([("source", pa.string()), ("anchor", pa.string()), ("id", pa.string()), ("score", pa.float64())])
    if not docs.num_rows or not queries.num_rows:
        return schema.empty_table()
    docs = docs.sort_by("id")  # equal scores then go by place
    held = docs["t"].combine_chunks()
    size = np.diff(held.offsets.to_numpy())
    terms = held.flatten().dictionary_encode()
    n, doc = len(docs), np.repeat(np.arange(len(docs)), size)
    key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
    doc = key % n
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / docs["mean"][0].as_py()))
    first = np.searchsorted(key, np.arange(len(terms.dictionary) + 1) * n)  # a term's postings
    del key, tf, held
    whole = queries["idf"].combine_chunks()
    words = pc.split_pattern(queries["terms"].combine_chunks(), " ").flatten()
    term = pc.index_in(words, value_set=terms.dictionary).fill_null(-1).to_numpy().astype(np.int64)
    idf, whose = whole.flatten().to_numpy(), np.repeat(np.arange(len(whole)), np.diff(whole.offsets.to_numpy()))
    here = term >= 0
    term, idf, whose = term[here], idf[here], whose[here]
    usual = np.unique(term[idf < COMMON])
    usual = usual[np.argsort(first[usual] - first[usual + 1], kind="stable")][: max(1, CELLS // n)]
    row = np.full(len(first), -1)
    row[usual] = np.arange(len(usual))
    rows, most = np.zeros((len(usual), n)), np.zeros(len(usual))
    for i, t in enumerate(usual):
        rows[i, doc[first[t] : first[t + 1]]] = w = weight[first[t] : first[t + 1]]
        most[i] = w.max()
    order = np.lexsort((row[term] >= 0, whose))  # stable: by term within either kind
    term, idf, whose = term[order], idf[order], whose[order]
    at, start, end = row[term], first[term], first[term + 1]
    bounds = np.searchsorted(whose, np.arange(len(whole) + 1))
    rare = bounds[:-1] + np.bincount(whose[at < 0], minlength=len(whole))
    found = []
    for q, (a, m, b) in enumerate(zip(bounds[:-1].tolist(), rare.tolist(), bounds[1:].tolist(), strict=True)):
        if a == b:
            continue
        parts = [slice(x, y) for x, y in zip(start[a:m].tolist(), end[a:m].tolist(), strict=True)]
        if parts:
            hits = np.concatenate([doc[p] for p in parts])
            score = np.bincount(hits, np.repeat(idf[a:m], end[a:m] - start[a:m]) * np.concatenate([weight[p] for p in parts]), n)
        else:
            score = np.zeros(n)
        some = None
        if parts and n > 4 * top:  # who can still be among the best when each common term adds its most
            low = np.partition(score, n - top)[n - top] - float(idf[m:b] @ most[at[m:b]])
            some = np.flatnonzero(score >= low - 1e-6) if low > 1e-6 else None
        if some is None:
            for i, x in zip(at[m:b].tolist(), idf[m:b].tolist(), strict=True):
                score += x * rows[i]
            some = np.flatnonzero(score)
            score = score[some]
        else:
            score = score[some]
            for i, x in zip(at[m:b].tolist(), idf[m:b].tolist(), strict=True):
                score += x * rows[i].take(some)
        if len(some) > top:
            near = score >= np.partition(score, len(score) - top)[len(score) - top] - 1e-6
            some, score = some[near], score[near]
        score = np.floor(score * 1e6 + 0.5) / 1e6
        best = np.lexsort((some, -score))[:top]
        found.append((np.full(len(best), q), some[best], score[best]))
    if not found:
        return schema.empty_table()
    q, d, score = (np.concatenate(c) for c in zip(*found, strict=True))
    cols = [queries["_source"].take(pa.array(q)), queries["anchor"].take(pa.array(q)), docs["id"].take(pa.array(d)), pa.array(score)]
    return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=schema)


def _eligible(pairs: DataFrame, pool: DataFrame, strategy: str) -> DataFrame:
    """Of pairs (id, neg), those of one split that the strategy allows: for wrong dates, with different
    dates, or one without."""
    label = pool.select("id", "split", "date")
    met = pairs.join(label, "id").join(label.toDF("neg", "other", "day"), "neg").filter("split = other and id <> neg")
    return met.filter("not (date <=> day)") if strategy == "wrong_publication_date" else met


def bm25_negative(ranked: DataFrame, pool: DataFrame, draw_no: int = 0, rotate: int = 3, seed: int = 42, strategy: str = "wrong_article") -> DataFrame:
    """id, negative_id, fallback: of the anchor's best documents that are others of its own split, and
    that the strategy allows, one of the first ``rotate``, a further one each draw; the rank is cut
    before that is looked at. Where there is none, a uniform draw by the strategy (fallback). pool: id,
    source, split, date."""
    hits = _eligible(ranked.select(F.col("anchor").alias("id"), F.col("id").alias("neg"), "rank"), pool, strategy)
    w = Window.partitionBy("id")
    nth = hits.withColumn("nth", F.row_number().over(w.orderBy("rank")) - 1).withColumn("n", F.count("*").over(w))
    found = nth.filter(F.col("nth") == F.lit(draw_no) % F.least(F.lit(rotate), F.col("n"))).select("id", "neg")
    uniform = MAKERS[strategy](pool, seed).select("id", F.col("negative_id").alias("neg"))
    return _tiers(pool, [(found, False), (uniform, True)])


MAKERS = {"wrong_article": wrong_article, "wrong_publication_date": wrong_date, "question_answer_mismatch": qa_mismatch}


class NegativeBackend:
    """Chooses negatives; this one draws uniformly. Others override ``choose``."""

    def choose(self, strategy: str, pool: DataFrame, anchors: DataFrame, seed: int) -> DataFrame:
        """id, negative_id, fallback for the records of one split. anchors: id and text of the anchors."""
        return MAKERS[strategy](pool, seed)


class Bm25Backend(NegativeBackend):
    """Hard negatives: an anchor's text is searched in an index of its source (documents: source, id,
    text); anchors without a hit get a uniform draw."""

    def __init__(self, documents: DataFrame, draw_no: int = 0, rotate: int = 3):
        self.documents, self.draw_no, self.rotate = documents, draw_no, rotate

    def choose(self, strategy: str, pool: DataFrame, anchors: DataFrame, seed: int) -> DataFrame:
        asked = anchors.join(pool.select("id", "source"), "id").select("source", "id", "text")
        return bm25_negative(bm25_top(self.documents, anchors=asked), pool, self.draw_no, self.rotate, seed, strategy)
