"""Rows of Parquet, JSON lines or plain text, mapped onto records by column lists; and the parser of
source lists. Remote folders are read through Spark's own file systems."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TripletRecipe, row_recipes
from ..errors import ConfigurationError
from ..functions.hashing import hash52_of
from ..functions.text import is_blank
from ..operators.records import TRUST, record, section
from .base import DataSource


def value_to_text(df: DataFrame, name: str, labels: list[str] | None = None) -> Column:
    """A column as text: null and blank are null, booleans and numbers as JSON has them (class labels
    by name), arrays, maps and structs as JSON."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    elif labels and isinstance(kind, T.IntegralType):
        text = F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), c.cast("int")), c.cast("string"))
    else:
        text = c.cast("string")
    return F.when(~is_blank(text), text)


def decode_lines(lines: DataFrame, strict: bool) -> DataFrame:
    """object (map of JSON texts) of each line in ``value``: strict lines must be JSON objects; else a
    JSON scalar or a raw line becomes {text: line}. An envelope ``row`` is opened; a blank line is an
    error."""
    value = F.col("value")
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    scalar = F.try_variant_get(parsed, "$", "string")
    inner = F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.row", "variant")).startswith("OBJECT"), F.lit(False)), F.try_variant_get(parsed, "$.row", "variant")).otherwise(parsed)
    asmap = F.try_variant_get(inner, "$", "map<string,variant>")
    texts = F.transform_values(asmap, lambda k, v: F.when(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")))
    blank = F.when(is_blank(value), F.raise_error(F.lit("blank line")).cast("map<string,string>"))
    plain = F.raise_error(F.lit("not a JSON object")).cast("map<string,string>") if strict else F.create_map(F.lit("text"), F.coalesce(F.when(~kind.startswith("ARRAY"), scalar), value))
    return lines.select("*", F.coalesce(blank, F.when(is_object, texts).otherwise(plain)).alias("object"))


@dataclass(frozen=True)
class RowSource(DataSource):
    """Records of a table's rows. Roles: the first column of ``anchor`` (then ``positive``) that isn't
    blank, and every column of ``context``; or the first of ``text``. Rows that lack one are skipped.
    Without anchor columns the first role text is the anchor. Ids come from ``id`` where it is there,
    else from the file and the row's number in it (Parquet), or its content (lines of text)."""

    name: str
    path: str
    format: str = "parquet"
    anchor: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    id: str = "id"
    trust: float = TRUST
    labels: dict[str, list[str]] = field(default_factory=dict)
    taxonomy: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if bool(self.text) == bool(self.anchor or self.positive or self.context):
            raise ConfigurationError("either text columns or role columns are needed")

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows with ``_row``, which tells them apart wherever they are read."""
        file = F.element_at(F.split("_metadata.file_path", "/"), -1)
        if self.format == "parquet":
            return spark.read.parquet(self.path).withColumn("_row", F.concat_ws("#", file, F.col("_metadata.row_index").cast("string")))
        lines = spark.read.text(self.path).select("value", F.concat_ws("#", file, F.substring(F.md5("value"), 1, 16)).alias("_row"))
        copy = F.row_number().over(Window.partitionBy("_row").orderBy("value"))  # equal lines are numbered
        lines = lines.withColumn("_copy", copy).withColumn("_row", F.when(F.col("_copy") > 1, F.concat_ws("#", "_row", "_copy")).otherwise(F.col("_row")))
        objects = decode_lines(lines, self.format in ("jsonl", "ndjson"))
        names = dict.fromkeys([self.id, *self.anchor, *self.positive, *self.context, *self.text])
        return objects.select("_row", *[F.col("object")[n].alias(n) for n in names])

    def map_rows(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        text = lambda n: value_to_text(df, n, self.labels.get(n)) if n in have else F.lit(None).cast("string")
        first = lambda names: F.coalesce(*[text(n) for n in names])
        if self.text:
            fields = [first(self.text)]
        else:
            fields = [first(names) for names in (self.anchor, self.positive) if names] + [text(n) for n in self.context]
        if "_row" not in have and self.id not in have:
            raise ConfigurationError(f"rows of {self.name} have neither {self.id} nor a place")
        key = F.coalesce(text(self.id), F.concat(F.lit("row_"), F.col("_row")) if "_row" in have else F.lit(None).cast("string"))
        mapped = df.select(key.alias("key"), *[f.alias(f"f{i}") for i, f in enumerate(fields)]).filter("key is not null")
        for i in range(len(fields)):
            mapped = mapped.filter(F.col(f"f{i}").isNotNull())
        cols = [F.col(f"f{i}") for i in range(len(fields))]
        second = cols[1] if len(cols) > 1 else cols[0]
        sections = F.array(section("anchor", cols[0]), section("context", second), *[section("context", c) for c in cols[2:]])
        return record(mapped, F.concat(F.lit(f"{self.name}::"), F.col("key")), F.lit(self.name), sections, self.trust, F.array(F.lit(self.name), *[F.lit(x) for x in self.taxonomy]))

    def records(self, spark: SparkSession) -> DataFrame:
        return self.map_rows(self.frame(spark))

    def transcode(self, spark: SparkSession, path: str) -> RowSource:
        """Writes the mapped records as Parquet, rows that lack a field left out, and gives the source that
        reads them."""
        names = [f"f{i}" for i in range(max(1, bool(self.anchor) + bool(self.positive) + len(self.context)))]
        rows = self.records(spark).select(F.substring("id", len(self.name) + 3, 1 << 30).alias("id"), *self._fields(names))
        rows.write.mode("overwrite").parquet(path)
        roles = {"text": ("f0",)} if self.text else {"anchor": tuple(names[: bool(self.anchor)]), "positive": tuple(names[bool(self.anchor) : bool(self.anchor) + bool(self.positive)]), "context": tuple(names[bool(self.anchor) + bool(self.positive) :])}
        return replace(self, path=path, format="parquet", id="id", labels={}, **{k: roles.get(k, ()) for k in ("anchor", "positive", "context", "text")})

    def _fields(self, names: list[str]) -> list[Column]:
        """The mapped columns, from a record's sections; a single field stands in two of them."""
        return [F.col("sections")[i]["text"].alias(n) for i, n in enumerate(names)]

    def recipes(self) -> tuple[TripletRecipe, ...]:
        return row_recipes(bool(self.anchor))


def shard_order(paths: list[str], source: str, seed: int = 42) -> list[str]:
    """Shards in a hashed order, the same wherever it is worked out."""
    return sorted(paths, key=lambda p: (hash52_of(seed, "shard", source, len(paths), p), p))


def shard_sizes(info: dict) -> dict[str, int]:
    """Rows of each split, from a dataset's size report."""
    return {s["split"]: int(s["num_rows"]) for s in info.get("size", info).get("splits", []) if "split" in s and "num_rows" in s}


_COLUMNS = {"anchor", "positive", "context", "text"}


def parse_source_line(line: str) -> RowSource | None:
    """One line ``scheme://org/name[/config[/split]] key=value ...``; None for blanks and comments. Keys:
    anchor, positive, context, text (lists by comma), id, trust, source_id."""
    body = line.split("#", 1)[0].strip() if line.lstrip().startswith("#") else line.strip()
    if not body:
        return None
    uri, *pairs = shlex.split(body)
    m = re.fullmatch(r"(\w+)://([^/\s]+)/([^/\s]+)(?:/([^/\s]+))?(?:/([^/\s]+))?/?", uri)
    if not m:
        raise ConfigurationError(f"not a source: {uri}")
    scheme, org, name, config, split = m.groups()
    given: dict = {}
    for p in pairs:
        key, eq, value = p.partition("=")
        if key in _COLUMNS and eq:
            given[key] = tuple(x.strip() for x in value.split(",") if x.strip())
        elif key == "trust" and eq:
            try:
                given["trust"] = float(value)
            except ValueError as e:
                raise ConfigurationError(f"trust is no number: {value}") from e
        elif key in ("id", "source_id") and eq:
            given["id" if key == "id" else "name"] = value
        else:
            raise ConfigurationError(f"unknown key: {p}")
    given.setdefault("name", re.sub(r"[^a-z0-9]+", "-", "-".join(x for x in (org, name, config, split) if x).lower()).strip("-"))
    tax = tuple(f"{k}={v}" for k, v in (("dataset", f"{org}/{name}"), ("config", config), ("split", split)) if v)
    return RowSource(path=f"{scheme}://datasets/{org}/{name}" if scheme == "hf" else uri, taxonomy=tax, **given)


def parse_source_list(text: str) -> list[RowSource]:
    """All sources of a list; names that collide all get their place in the list appended."""
    found = [s for s in map(parse_source_line, text.splitlines()) if s]
    names = [s.name for s in found]
    return [replace(s, name=f"{s.name}.{i}") if names.count(s.name) > 1 else s for i, s in enumerate(found)]


def class_labels(info: dict) -> dict[str, list[str]]:
    """Column -> names of its class labels, from a dataset's info."""
    features = info.get("dataset_info", info).get("features", {})
    return {k: list(v["names"]) for k, v in features.items() if isinstance(v, dict) and v.get("_type") == "ClassLabel" and v.get("names")}
