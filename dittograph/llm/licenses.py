"""Licence scan: canonical digests of texts, joined with those of known licences.

A text's canonical form has no case, punctuation, copyright lines or variant
spellings; its SHA-256 is the key of a hash join. Whole documents are looked up,
and each of their lines as a text of its own, since a notice often stands alone
in one. Everything is built-in expressions in one pass; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dittograph.llm.license_texts import KNOWN

#: Known texts up to which their digests are broadcast; their number is counted first.
BROADCAST_ROWS = 100_000
#: Spellings that count as one, applied to the form without punctuation.
SPELLINGS = (
    (r"\blicence(s|d)?\b", "license$1"),
    (r"\bsub license(s|d)?\b", "sublicense$1"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bcopyright owner(s)?\b", "copyright holder$1"),
    (r"\bhttps\b", "http"),
    (r"\bv(er)? ?(\d)", "version $2"),
)
_COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$|all rights reserved\.?"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null for null, empty where nothing is left."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def known_digests(known: DataFrame) -> DataFrame:
    """``(digest, license)`` of known texts (license, text); of licences with equal forms the least name counts."""
    form = known.select("license", canonical(F.col("text")).alias("form")).filter("license is not null and form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, lines: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, line, license, digest)``: every text that equals a known licence in canonical form.

    ``line`` is 0 for the whole document, else the number of the line from 1; of a
    document of one line only the document is looked up. ``known`` is a table
    (license, text), by default the built-in one.

    A null, empty or punctuation-only text matches nothing. Repeated rows give
    repeated results; a null id stays null. Other columns are not read; an
    empty table gives no rows. Very long texts are hashed whole.
    """
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(sorted(KNOWN), "license string, text string")
    digests = known_digests(known)
    if digests.count() <= broadcast_rows:
        digests = F.broadcast(digests)
    text = F.col("text").cast("string")
    units = F.array(text)
    if lines:
        several = F.split(text, "\n")
        units = F.when(F.size(several) > 1, F.concat(F.array(text), several)).otherwise(units)
    each = docs.select(F.col("doc_id"), F.posexplode(units).alias("line", "unit"))
    # never null, so that the join adds no null check that would work out the form twice
    digest = F.coalesce(F.sha2(canonical(F.col("unit")), 256), F.lit(""))
    return each.select("doc_id", "line", digest.alias("digest")).join(digests, "digest").select("doc_id", "line", "license", "digest")


def _sql_form(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{_COPYRIGHT}', ' ', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


def sql() -> str:
    """The same scan in DuckDB's SQL, with the built-in licences."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in sorted(KNOWN))
    return f"""
    WITH known(license, text) AS (VALUES {rows}),
    k AS (SELECT sha256(form) AS digest, min(license) AS license FROM (SELECT license, {_sql_form("text")} AS form FROM known) WHERE form <> '' GROUP BY 1),
    u AS (SELECT doc_id, 0 AS line, text AS unit FROM documents UNION ALL
      SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) > 1),
    f AS (SELECT doc_id, line, {_sql_form("unit")} AS form FROM u WHERE unit <> '')
    SELECT doc_id, CAST(line AS INTEGER) AS line, license, digest FROM (SELECT doc_id, line, sha256(form) AS digest FROM f WHERE form <> '') JOIN k USING (digest)
    """
