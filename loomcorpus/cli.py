"""Commands: capacity of a folder of sources, and a demonstration of batches.

python -m loomcorpus.cli capacity --source-root DIR...
python -m loomcorpus.cli demo --source-root DIR... [--text-recipes | --pair-batch] [--batches N]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from . import reports
from .config import SamplerConfig, SplitRatios, text_recipes, title_context_recipes
from .operators import metrics, splits
from .sampler import Sampler
from .sources import FileSource
from .state import SamplerState, StateStore


def positive(x: str) -> int:
    if int(x) <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return int(x)


def ratios(x: str) -> SplitRatios:
    try:
        return SplitRatios(*map(float, x.split(",")))
    except (TypeError, ValueError) as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomcorpus")
    sub = p.add_subparsers(dest="command", required=True)
    for name, seed in (("capacity", 99), ("demo", 42)):
        s = sub.add_parser(name)
        s.add_argument("--seed", type=int, default=seed)
        s.add_argument("--split-ratios", type=ratios, default=SplitRatios())
        s.add_argument("--source-root", action="append", required=True)
    s.add_argument("--text-recipes", action="store_true")
    s.add_argument("--pair-batch", action="store_true")
    s.add_argument("--list-text-recipes", action="store_true")
    s.add_argument("--batch-size", type=positive, default=4)
    s.add_argument("--batches", type=positive, default=1)
    s.add_argument("--ingestion-max-records", type=positive, default=2048)
    s.add_argument("--split", default="train")
    s.add_argument("--split-store-path")
    s.add_argument("--reset", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    sources = [FileSource(os.path.basename(os.path.normpath(r)), r) for r in a.source_root]
    if a.command == "capacity":
        sampler = Sampler(spark, SamplerConfig(seed=a.seed, ratios=a.split_ratios), sources)
        labelled = splits.assign(sampler.records().select("id", "source"), "id", a.seed, a.split_ratios)
        recipes = len(title_context_recipes())
        print(reports.capacity(metrics.capacity(labelled, recipes, 3 * recipes).collect()))  # one row a source and split
        return
    config = SamplerConfig(seed=a.seed, batch_size=a.batch_size, ratios=a.split_ratios, allowed_splits=(a.split,), max_records=a.ingestion_max_records)
    sampler = Sampler(spark, config, sources)
    if a.list_text_recipes:
        for r in text_recipes(config, sources[0].recipes()):
            print(f"{r.name} {r.weight}")
        return
    store = StateStore(a.split_store_path) if a.split_store_path else None
    fresh = store is None or a.reset or not os.path.exists(store.path)
    state = SamplerState(a.seed, a.split_ratios) if fresh else store.load(a.seed, a.split_ratios)
    kind = "texts" if a.text_recipes else "pairs" if a.pair_batch else "triplets"
    for i, batch in zip(range(a.batches), sampler.restore(state).batches(kind, a.split)):
        print(reports.batch(kind, i + 1, batch))
    for s in sampler.stats:
        print(f"{s.source}: {reports.grouped_digits(s.records)} records in {s.seconds:.1f} s ({s.per_second:.0f} a second){': ' + s.error if s.error else ''}")
    if store:
        store.save(sampler.state)


if __name__ == "__main__":
    main()
