"""The sampler: sources in, batches of triplets, pairs or texts out."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import CONTEXT, SamplerConfig, long_section_recipe, text_recipes
from .errors import ConfigurationError, Exhausted, SamplerError
from .functions.hashing import hash52
from .functions.metadata import KvpPrefix, taxonomy_value
from .functions.text import token_count
from .operators import mixing, sampling, selection, splits
from .operators import records as rec
from .sources.base import Cursor
from .state import SamplerState

#: How often a sampler that found nothing moves its sources on before it gives up.
RETRIES = 2
COLUMNS = ("id", "source", "created_at", "updated_at", "trust", "taxonomy", "sections")


@dataclass(frozen=True)
class RefreshStats:
    """What a refresh of one source took and gave."""

    source: str
    records: int
    seconds: float
    error: str | None = None

    @property
    def per_second(self) -> float:
        return self.records / self.seconds if self.seconds > 0 else 0.0


class Sampler:
    """Draws samples from the records of its sources. An epoch visits each record of a split once as an
    anchor, in hashed order; batches are cut from that order, so a batch's size changes nothing else.

    ``chunker`` cuts sections into chunks, ``backend`` chooses negatives, ``overrides`` (id, split) are
    labels that go before the hashed ones, and ``meta`` is a prefix for texts whose fields read the
    columns of records."""

    def __init__(
        self,
        spark: SparkSession,
        config: SamplerConfig,
        sources: list = (),  # noqa: B006
        chunker: sampling.Chunker | None = None,
        backend: selection.NegativeBackend | None = None,
        overrides: DataFrame | None = None,
        meta: KvpPrefix | None = None,
    ):
        self.spark, self.config, self.sources = spark, config, list(sources)
        self.chunker, self.backend, self.overrides, self.meta = chunker, backend, overrides, meta
        self.state = SamplerState(config.seed, config.ratios)
        self.stats: list[RefreshStats] = []
        self._pages: DataFrame | None = None

    def register(self, source) -> Sampler:  # noqa: ANN001
        self.sources.append(source)
        return self

    def restore(self, state: SamplerState) -> Sampler:
        """Goes on from a stored state: epoch, place, cursors and overrides."""
        self.state = state
        if state.overrides:
            self.overrides = self.spark.createDataFrame(sorted(state.overrides.items()), "id string, split string")
        return self

    def ingest(self, limit: int | None = None, weights: Mapping[str, float] | None = None) -> DataFrame:
        """Reads the next page of every source, at most ``limit`` (or config.max_records) records each, from
        the cursors of the state on, which move. A source that fails is left out and named in ``stats``;
        if all fail, the last error is raised. With weights, the pages are mixed by them to ``limit`` records
        in all. Batches then draw from what was read."""
        limit = limit or self.config.max_records
        if weights:
            mixing.check_weights(weights, {s.name for s in self.sources})
        frames, self.stats, failed = [], [], None
        for s in self.sources:
            began = time.time()
            try:
                page = s.refresh(self.spark, Cursor(self.state.cursors.get(s.name, 0)), limit, self.config.seed)
                frame = page.records.select(*COLUMNS)
                n = frame.count()
            except Exception as e:  # one source's failure isn't the others'
                failed = e
                self.stats.append(RefreshStats(s.name, 0, time.time() - began, str(e).splitlines()[0]))
                continue
            self.stats.append(RefreshStats(s.name, n, time.time() - began))
            self.state.cursors[s.name] = page.cursor.revision
            frames.append(frame)
        if not frames:
            raise failed or ConfigurationError("no sources")
        pages = reduce(DataFrame.unionByName, frames)
        if weights:
            pages = mixing.weighted(pages, weights, limit or sum(s.records for s in self.stats), ("id",)).select(*COLUMNS)
        self._pages = pages
        return pages

    def records(self) -> DataFrame:
        """All records of all sources, or what ``ingest`` read last."""
        if not self.sources:
            raise ConfigurationError("no sources")
        if self._pages is not None:
            return self._pages
        if self.config.max_records:
            return self.ingest()
        return reduce(DataFrame.unionByName, [s.records(self.spark).select(*COLUMNS) for s in self.sources])

    def _recipes(self, records: DataFrame):  # noqa: ANN202
        """Those of the configuration, or each source's own; and for each source with a section longer than
        the window one of long sections, unless it has one."""
        own = {s.name: tuple(s.recipes()) if hasattr(s, "recipes") else () for s in self.sources}
        own = {k: self.config.recipes for k in own} if self.config.recipes else own
        if not any(own.values()):
            raise ConfigurationError("no recipes")
        if not self.config.long_sections:
            return own
        longer = F.exists("sections", lambda s: (s["role"] == CONTEXT.value) & (token_count(s["text"]) > self.config.chunking.window))
        found = {r.source for r in records.groupBy("source").agg(F.bool_or(longer).alias("long")).filter("long").collect()}  # one row a source
        return {k: v + ((long_section_recipe(k),) if k in found and not any(r.long_section for r in v) else ()) for k, v in own.items()}

    def _pool(self, records: DataFrame) -> DataFrame:
        c, tax = self.config, F.col("taxonomy")
        pool = records.select("id", "source", "created_at", F.get(tax, F.lit(0)).alias("taxon"), taxonomy_value(tax, "date").alias("date"))
        return splits.assign(pool, "id", c.seed, c.ratios, self.overrides)

    def _meta(self, records: DataFrame):  # noqa: ANN202
        return None if self.meta is None else (self.meta, records.drop("sections"))

    def triplets(self, split: str = "train", epoch: int = 0) -> DataFrame:
        self.config.check_split(split)
        records, seed = self.records(), self.config.seed ^ epoch
        return sampling.triplets(rec.sections_of(records), self._pool(records), self._recipes(records), self.config.chunking, split, seed, self.backend, self._meta(records), self.chunker)

    def pairs(self, split: str = "train", epoch: int = 0) -> DataFrame:
        return sampling.pairs(self.triplets(split, epoch))

    def texts(self, split: str = "train", epoch: int = 0) -> DataFrame:
        self.config.check_split(split)
        records = self.records()
        mine = self._pool(records).filter(F.col("split") == split)
        sections = rec.sections_of(records).join(mine.select("id"), "id", "left_semi")
        recipes = () if self.config.text_recipes else tuple({r.name: r for rs in self._recipes(records).values() for r in rs}.values())
        return sampling.texts(sections, text_recipes(self.config, recipes), self.config.chunking, self.config.seed ^ epoch, mine, self._meta(records), self.chunker)

    def batches(self, kind: str = "triplets", split: str = "train", epoch: int | None = None, ahead: int = 2, weights: Mapping[str, float] | None = None) -> Iterator[list[Row]]:
        """Full batches of what is left of an epoch, the last filled up by reuse. ``ahead`` batches are
        fetched in the background, partition by partition; failures are raised at the batch they hit.

        Without ``epoch`` the state's epoch goes on from its next sample; the state moves with the
        batches that are taken, and to the next epoch behind the last. With weights, sources take
        turns by them. Where no sample can be drawn, sources that are read in pages are moved on
        RETRIES times at most."""
        key = {"triplets": "slot_id", "pairs": "slot_id", "texts": "id"}[kind]
        follow = epoch is None
        epoch, done = (self.state.epoch, self.state.next_slot) if follow else (epoch, 0)
        if weights:
            mixing.check_weights(weights, {s.name for s in self.sources})
        for turn in range(RETRIES + 1):
            samples = self._ordered(getattr(self, kind)(split, epoch), kind, key, epoch, weights)
            if samples.head(1):
                break
            if self._pages is None or turn == RETRIES:
                raise Exhausted("no sample can be drawn")
            self.ingest()
        rest = samples.filter(F.col("_pos") >= done).orderBy("_pos").drop("_pos")
        return self._follow(Prefetcher(self._cut(rest), ahead)) if follow else Prefetcher(self._cut(rest), ahead)

    def _ordered(self, samples: DataFrame, kind: str, key: str, epoch: int, weights: Mapping[str, float] | None) -> DataFrame:
        """The samples with _pos, their place in the epoch."""
        visit = hash52(self.config.seed ^ epoch, "visit", F.col(key))
        order = [key] + (["nth"] if kind == "pairs" else [])
        if not weights:
            return splits.ranked(samples.withColumn("_visit", visit), (), F.shiftright("_visit", 44), ["_visit", *order], "_pos").drop("_visit")
        some = {s.name: float(weights.get(s.name, 1.0)) for s in self.sources}
        some = some if any(w > 0 for w in some.values()) else dict.fromkeys(some, 1.0)
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in some.items() for x in kv]), F.col("_source"))
        of = samples.join(self.records().select(F.col("id").alias(key), F.col("source").alias("_source")), key).filter(weight > 0)
        each = splits.ranked(of.withColumn("_visit", visit), ("_source",), F.shiftright("_visit", 44), ["_visit", *order], "_nth").withColumn("_turn", (F.col("_nth") + 0.5) / weight)
        return splits.ranked(each, (), F.floor(F.log2(F.col("_turn") + 1) * 8), ["_turn", "_source", *order], "_pos").drop("_visit", "_nth", "_turn", "_source")

    def _follow(self, batches: Iterator[list[Row]]) -> Iterator[list[Row]]:
        for batch in batches:
            self.state.next_slot += len(batch)
            yield batch
        self.state.epoch, self.state.next_slot = self.state.epoch + 1, 0

    def _cut(self, samples: DataFrame) -> Iterator[list[Row]]:
        size, batch, some = self.config.batch_size, [], False
        for row in samples.toLocalIterator(prefetchPartitions=True):
            some = True
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield [batch[i % len(batch)] for i in range(size)]
        if not some:
            raise Exhausted("no sample is left in this epoch")


class Prefetcher(Iterator):
    """Runs an iterator in a thread, some items ahead."""

    _END = object()

    def __init__(self, items: Iterator, capacity: int = 2):
        self.queue: queue.Queue = queue.Queue(max(1, capacity))
        self.errors = 0
        self.thread = threading.Thread(target=self._run, args=(items,), daemon=True)
        self.thread.start()

    def _run(self, items: Iterator) -> None:
        try:
            for x in items:
                self.queue.put(x)
            self.queue.put(self._END)
        except Exception as e:  # handed to the reader
            self.errors += 1
            self.queue.put(e)

    def __next__(self):  # noqa: ANN204
        x = self.queue.get()
        if x is self._END or isinstance(x, Exception):
            self.queue.put(self._END)
            if isinstance(x, Exception):
                raise x
            raise StopIteration
        return x


__all__ = ["Prefetcher", "RefreshStats", "Sampler", "SamplerError"]
