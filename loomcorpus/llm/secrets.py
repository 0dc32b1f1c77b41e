"""Secret scan by token efficiency: a random string costs a BPE vocabulary many tokens for its
length. Candidate strings are found in each whole text, known digests and identifiers are set
aside, and the rest is measured in characters per token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import DOCUMENT_COLUMNS, documents, pick, slices

NAME = "op10_secret_scan"
SQL = None
#: A candidate: so many of such signs in a row, no letter or digit of any script beside them; an
#: assignment's = may stand directly before it.
MIN_CHARS = 16
CANDIDATE = rf"(?<![\w+/\-])[A-Za-z0-9+/_\-]{{{MIN_CHARS},}}={{0,2}}(?![\w+/=\-])"
#: Strings with at most so many characters a token count as random.
MAX_RATIO = 2.4
#: A name of a credential just before the candidate, with signs of an assignment between.
CREDENTIAL = re.compile(
    r"(?:token|(?:secret|auth(?:orization)?)(?:[ _-]?(?:key|id|value))?|encryption[ _-]?(?:key|id|value)|passw(?:or)?d|pwd|passphrase"
    r"|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credentials?)[\"'\s:=!#$%&*|>]{1,24}$",
    re.IGNORECASE,
)
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Words, numbers and short codes joined by - _ or /, and camel case with a number at the end.
_WORDS = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?:[-_/]|\Z))+\Z")
_CAMEL = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,4})+[0-9]{0,4}\Z")
_SWITCH = re.compile(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")
SCHEMA = "doc_id bigint, start int, stop int, secret string, n_tokens int, ratio double, named boolean"
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int32()),
        ("stop", pa.int32()),
        ("secret", pa.string()),
        ("n_tokens", pa.int32()),
        ("ratio", pa.float64()),
        ("named", pa.bool_()),
    ]
)


def excluded(s: str, named: bool) -> bool:
    """Known digests (unless named as a credential), UUIDs, numbers, words and identifiers."""
    core = s.rstrip("=")
    if _UUID.match(core) or not re.search("[A-Za-z]", core):
        return True
    if _HEX.match(core) and len(core) in DIGESTS and not named:
        return True
    if _WORDS.match(core) or _CAMEL.match(core):
        return True
    # letters alone count only where upper and lower case alternate as in random strings
    return not re.search("[0-9]", core) and len(_SWITCH.findall(core)) < len(core) / 4


def scan_text(text: str, count, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str, int, float, bool]]:
    """(start, stop, secret, tokens, characters a token, named) of each finding in one text."""
    found = []
    for m in _FINDER.finditer(text):
        s = m.group()
        named = bool(CREDENTIAL.search(text, max(0, m.start() - 48), m.start()))
        if excluded(s, named):
            continue
        tokens = count(s)
        if len(s) <= max_ratio * tokens:
            found.append((m.start(), m.end(), s, tokens, len(s) / tokens, named))
    return found


_FINDER = re.compile(CANDIDATE)


def find_secrets(df: DataFrame, max_ratio: float = MAX_RATIO, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, stop, secret, n_tokens, ratio, named of every finding in every text.

    start and stop are character offsets. Only rows with a candidate reach Python. A null or
    empty text has no findings; repeated rows give repeated findings, and a secret that a text holds
    twice is found twice; a null doc_id stays null; a ratio of just ``max_ratio`` counts; extra
    columns are ignored; an empty table gives an empty result. Texts are searched whole, however
    long, a bounded slice of the rows at a time.
    """
    path = vocabulary or vocab.vocabulary_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoding(path)
        count = lambda s: len(encoder.encode_ordinary(s))
        for part in (p for batch in batches for p in slices(batch, "text")):
            rows = [
                (i, *hit)
                for i, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True)
                for hit in scan_text(text.as_py(), count, max_ratio)
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * len(RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RESULT, strict=True)], schema=RESULT)

    some = pick(df, "doc_id", "text").filter(F.col("text").rlike(f"[A-Za-z0-9+/_-]{{{MIN_CHARS}}}"))
    return some.mapInArrow(scan, SCHEMA)


def mask_secrets(df: DataFrame, mask: str = "[SECRET]", max_ratio: float = MAX_RATIO, vocabulary: str | None = None) -> DataFrame:
    """The documents, with the columns of documents, with every finding replaced by ``mask`` and n_chars
    set anew; all rows stay, and texts without a candidate stay as they are (null and empty ones
    too). Repeated rows give repeated rows; a null doc_id stays null; extra columns go; an empty table
    gives an empty result. One pass; long texts are masked whole; ties are as in find_secrets."""
    path = vocabulary or vocab.vocabulary_path()

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        encoder = vocab.encoding(path)
        count = lambda s: len(encoder.encode_ordinary(s))

        def one(text):  # noqa: ANN001, ANN202
            if text is None:
                return None
            parts, at = [], 0
            for start, stop, *_ in scan_text(text, count, max_ratio):
                parts += [text[at:start], mask]
                at = stop
            return "".join([*parts, text[at:]]) if parts else text

        return pa.array((one(t.as_py()) for t in texts), pa.string())

    # texts without a candidate reach Python as nulls, and come from the table itself
    some = F.when(F.col("text").rlike(f"[A-Za-z0-9+/_-]{{{MIN_CHARS}}}"), F.col("text"))
    docs = pick(df, *DOCUMENT_COLUMNS).withColumn("new", masked(some))
    chars = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(F.col("n_chars"))
    return docs.select("doc_id", F.coalesce("new", "text").alias("text"), "lang", "source", chars.alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
