"""Line-first cleaning: punctuation, navigation and boilerplate rules per line; then documents
that lost too much of their text are rejected. All expressions run in the JVM, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick

NAME = "op2_quality_rules"
#: Signs that set menu entries apart, and how many make a line navigation.
SEPARATORS = "|»›•¦"
MIN_SEPARATORS = 3
#: Signs that prose holds few of, and the share of a line's characters from which it is noise.
NOISE = "#$%&*!~^<>{}="
MAX_NOISE = 0.08
#: A line ends a sentence: one of these signs (the sentence terminals of all scripts, colon and
#: semicolon), and any number of closing quotes, brackets and spaces.
TERMINALS = (
    ".!?…:;。！？．｡；：‼‽⁇⁈⁉﹒﹖﹗։؛؝؞؟۔।॥၊။።፤፧፨។៕៖།༎༏༐߹܀܁܂᙮᠃᠉᥄᥅⸮⸼"
    "࠷࠹࠽࠾᜵᜶᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"
)
CLOSING = "'\"”’»)]“«‘›‹」』）］】〉》〕｣ \u00a0\u202f"
#: A sentence ends within a line.
WITHIN = r"[.!?…।॥؟۔։።။།] |[。！？｡]"
#: Signs of scripts that write sentences without an end mark (Thai, Lao, Khmer); a line with so many
#: of them is not judged by its end.
UNMARKED = r"(?:[\x{0e00}-\x{0eff}\x{1780}-\x{17ff}][^\x{0e00}-\x{0eff}\x{1780}-\x{17ff}]*){20}"
BOILERPLATE = (
    r"all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|use of cookies"
    r"|enable javascript|lorem ipsum|click here|sign up for|subscribe to|powered by|back to top"
    r"|tous droits réservés|mentions légales|politique de confidentialité|accepter les cookies|retour en haut"
    r"|alle rechte vorbehalten|datenschutzerklärung|cookies akzeptieren|nach oben springen"
    r"|todos los derechos reservados|política de privacidad|aceptar las cookies|volver arriba"
)
#: Words of a line that equal the word before them, as a share of its words, from which it is filler;
#: lines with fewer words are not judged by it.
MAX_ECHO = 0.3
ECHO_WORDS = 8
#: Share of the characters that a document may lose.
MAX_LOST = 0.7


def _cut(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def _without(line: Column, signs: str) -> Column:
    return F.length(line) - F.length(F.translate(line, signs, ""))


def _ended(line: Column) -> Column:
    last = F.substring(F.rtrim(line, F.lit(CLOSING)), -1, 1)
    return (last != F.lit("")) & (F.instr(F.lit(TERMINALS), last) > 0)


def line_fault(line: Column) -> Column:
    """'navigation', 'boilerplate' or 'punctuation', the first rule in this order that a trimmed
    line fails; '' for a good line. Boilerplate is a stock phrase, or filler that repeats each word;
    punctuation fails by too many signs, or where no sentence ends (by the end marks of any script;
    lines in scripts without such marks pass)."""
    words = F.split(line, " ", -1)
    n = F.size(words)
    echo = F.size(F.filter(F.arrays_zip(F.slice(words, 1, n - 1).alias("a"), F.slice(words, 2, n - 1).alias("b")), lambda z: z["a"] == z["b"]))
    return (
        F.when(_without(line, SEPARATORS) >= MIN_SEPARATORS, "navigation")
        .when(F.lower(line).rlike(BOILERPLATE), "boilerplate")
        .when((n >= ECHO_WORDS) & (echo > MAX_ECHO * n), "boilerplate")
        .when(_without(line, NOISE) > MAX_NOISE * F.length(line), "punctuation")
        .when(~_ended(line) & ~line.rlike(WITHIN) & ~line.rlike(UNMARKED), "punctuation")
        .otherwise("")
    )


def clean_lines(df: DataFrame, max_lost: float = MAX_LOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, navigation, boilerplate, punctuation (failed lines),
    n_chars, kept_chars, keep, text (the good lines).

    Lines are trimmed; blank ones count as no line. n_chars and kept_chars are the characters of
    the lines before and after the rules; keep is false where more than ``max_lost`` of them went
    or none were there. A null, empty or blank text thus has no lines, text '' and keep false.
    Repeated rows give repeated results; a null doc_id stays null; extra columns are ignored; an
    empty table gives an empty result. Long texts are handled whole.
    Columns named in ``carry`` are passed on.
    """
    lines = F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _cut), lambda x: x != F.lit("")
    )
    tagged = F.transform("lines", lambda x: F.struct(x.alias("line"), line_fault(x).alias("fault")))
    failed = lambda kind: F.size(F.filter("tagged", lambda x: x["fault"] == kind)).cast("long")
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    kept = F.transform(F.filter("tagged", lambda x: x["fault"] == ""), lambda x: x["line"])
    return (
        pick(df, "doc_id", "text", *carry)
        .select("doc_id", *carry, lines.alias("lines"))
        .select("doc_id", *carry, "lines", tagged.alias("tagged"))
        .select("*", kept.alias("kept"))
        .select(
            "doc_id",
            *carry,
            F.size("lines").cast("long").alias("n_lines"),
            *[failed(k).alias(k) for k in ("navigation", "boilerplate", "punctuation")],
            chars("lines").alias("n_chars"),
            chars("kept").alias("kept_chars"),
            F.array_join("kept", "\n").alias("text"),
        )
        # a generator keeps what filters these columns later from standing for the rules a second time
        .select(F.explode(F.array(F.struct("*"))).alias("r"))
        .select("r.*")
        .select(
            "*",
            ((F.col("kept_chars") > 0) & (F.col("kept_chars") >= (1 - max_lost) * F.col("n_chars"))).alias("keep"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir))


def _sql_text(x: str) -> str:
    return x.replace("'", "''")


#: The rules over any relation with doc_id and text; the pipeline's SQL uses it too.
SQL_OVER = f"""
SELECT doc_id, n_lines, navigation, boilerplate, punctuation, n_chars, kept_chars, text,
       kept_chars > 0 AND kept_chars >= {1 - MAX_LOST!r}::DOUBLE * n_chars AS keep
FROM (
  SELECT doc_id, len(lines)::BIGINT AS n_lines,
         len(list_filter(faults, lambda f: f = 'navigation'))::BIGINT AS navigation,
         len(list_filter(faults, lambda f: f = 'boilerplate'))::BIGINT AS boilerplate,
         len(list_filter(faults, lambda f: f = 'punctuation'))::BIGINT AS punctuation,
         coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS n_chars,
         coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0)::BIGINT AS kept_chars,
         array_to_string(kept, chr(10)) AS text
  FROM (
    SELECT doc_id, lines, faults,
           list_transform(list_filter(list_zip(lines, faults), lambda z: z[2] = ''), lambda z: z[1]) AS kept
    FROM (
      SELECT doc_id, lines, list_transform(lines, lambda x: CASE
               WHEN length(x) - length(translate(x, '{SEPARATORS}', '')) >= {MIN_SEPARATORS} THEN 'navigation'
               WHEN regexp_matches(lower(x), '{_sql_text(BOILERPLATE)}') THEN 'boilerplate'
               WHEN len(string_split(x, ' ')) >= {ECHO_WORDS} AND
                    len(list_filter(list_zip(string_split(x, ' ')[:-2], string_split(x, ' ')[2:]), lambda z: z[1] = z[2]))
                    > {MAX_ECHO!r}::DOUBLE * len(string_split(x, ' ')) THEN 'boilerplate'
               WHEN length(x) - length(translate(x, '{NOISE}', '')) > {MAX_NOISE!r}::DOUBLE * length(x)
                 THEN 'punctuation'
               WHEN NOT (rtrim(x, '{_sql_text(CLOSING)}') <> '' AND contains('{_sql_text(TERMINALS)}', right(rtrim(x, '{_sql_text(CLOSING)}'), 1)))
                 AND NOT regexp_matches(x, '{WITHIN}') AND NOT regexp_matches(x, '{UNMARKED}') THEN 'punctuation'
               ELSE '' END) AS faults
      FROM (
        SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
                 lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> '') AS lines
        FROM __docs__))))
"""
SQL = SQL_OVER.replace("__docs__", "documents")
