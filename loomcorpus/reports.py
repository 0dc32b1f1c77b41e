"""Texts of batches, counts and factors, as commands print them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Row


def grouped_digits(value: int) -> str:
    return f"{value:,}"


def replay_factor(longest: int, records: int) -> str:
    """How often a source is gone through while the longest is once."""
    return f"{longest / records:.2f}x" if longest and records else "n/a"


def preview(text: str | None, width: int = 100) -> str:
    one = " ".join((text or "").split())
    return one if len(one) <= width else one[: width - 1] + "…"


def _lines(row: Mapping, names: Iterable[str]) -> list[str]:
    return [f"    {n}: {preview(row[n]) if isinstance(row[n], str) else row[n]}" for n in names if row.get(n) is not None]


def triplet(row: Mapping) -> str:
    head = f"  {row['recipe']}  weight {row['weight']:.4f}"
    return "\n".join([head, *_lines(row, ("instruction", "anchor_id", "anchor_text", "positive_id", "positive_text", "negative_id", "negative_text"))])


def pair(row: Mapping) -> str:
    head = f"  {row['recipe']}  {row['label']}{' (' + row['reason'] + ')' if row.get('reason') else ''}  weight {row['weight']:.4f}"
    return "\n".join([head, *_lines(row, ("instruction", "anchor_id", "anchor_text", "other_id", "other_text"))])


def text(row: Mapping) -> str:
    return "\n".join([f"  {row['recipe']}  weight {row['weight']:.4f}", *_lines(row, ("instruction", "id", "text"))])


FORMATS = {"triplets": triplet, "pairs": pair, "texts": text}


def batch(kind: str, number: int, rows: list[Row]) -> str:
    """One batch of a kind, sample by sample, and its share of each source."""
    shares: dict[str, int] = {}
    key = "id" if kind == "texts" else "anchor_id"
    for r in rows:
        source = r[key].split("::", 1)[0] if "::" in r[key] else "unknown"
        shares[source] = shares.get(source, 0) + 1
    share = ", ".join(f"{s} {n / len(rows):.0%}" for s, n in sorted(shares.items(), key=lambda x: (-x[1], x[0])))
    return "\n".join([f"batch {number}: {grouped_digits(len(rows))} {kind} ({share})", *(FORMATS[kind](r.asDict()) for r in rows)])


def capacity(rows: list[Row]) -> str:
    """The capacity report, a line a source and split, with what is gone through again."""
    counts = {r.source: r.n for r in rows if r.source is not None and r.split is None}
    longest = max(counts.values(), default=0)
    out = []
    for r in sorted(rows, key=lambda r: (r.source is None, r.source or "", r.split is None, r.split or "")):
        name = f"{r.source or 'all sources'} / {r.split or 'all splits'}"
        again = f"  replay {replay_factor(longest, r.n)}" if r.source is not None and r.split is None else ""
        out.append(f"{name}: {grouped_digits(r.n)} records, {grouped_digits(int(r.triplets))} triplets ({grouped_digits(int(r.effective))} effective), {grouped_digits(int(r.pairs))} pairs, {grouped_digits(int(r.texts))} texts{again}")
    return "\n".join(out)
