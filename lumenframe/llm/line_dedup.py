"""Line dedup: lines that several documents hold stay only in the document of least id.

Lines are exploded with their positions, their normalised keys hashed to 128 bits,
and each hash gets the least and the greatest document id that hold it: two
documents at least hold it if these differ, so no set of ids is kept, and a line
that a third of all documents hold is counted before the shuffle.  The common hashes
and the dropped positions are written before they are joined, so both sides of each
join are plain exchanges, which adaptive execution splits where a line is very common.

A null or empty text is one empty line.  A null id is no document for the counts,
and its lines stay.  Rows that repeat an id are one document: a line in both of them
alone stays in both.  An empty table gives none.  Columns beside doc_id and text, of
any name, aren't read; clean() hands them on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import written

MIN_CHARS = 10
#: The white space of a key's ends, and the letters that are folded.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, dropped): the positions, from 0, of the lines that a document loses; documents that lose any."""
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    keys = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line")).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keys = keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("lines"), F.col("key")).alias("h2"))
    keys = written(docs.sparkSession, keys, "line-keys")  # texts are cut and hashed once, for both uses
    common = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    common = written(docs.sparkSession, common, "common-lines")
    lost = keys.join(common, ["h1", "h2"]).where("doc_id > first_id")
    return written(docs.sparkSession, lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped")), "dropped-lines")


def _without(text: Column, dropped: Column) -> Column:
    """The lines that stay. The outer transform binds the split lines, so that they are split once and not once a line."""
    rest = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.transform(rest(lines), lambda i: F.get(lines, i)))
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.get(kept, F.lit(0)), "\n"))


def _with_dropped(docs: DataFrame, min_chars: int) -> DataFrame:
    """row: a document with all its columns, which so can't clash; id, hash; dropped positions, matched by id and text, so repeated rows stay repeated."""
    lost = dropped_positions(docs.select("doc_id", "text"), min_chars).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "dropped")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumns({"id": F.col("row.doc_id"), "hash": F.xxhash64("row.text")})
    return rows.join(lost, ["id", "hash"], "left")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row."""
    text = F.col("row.text")
    return _with_dropped(docs.select("doc_id", "text"), min_chars).select(
        "row.doc_id",
        F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        _without(text, F.col("dropped")).alias("kept_text"),
    )


def clean(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the remaining lines as text and n_chars counted anew; no row goes, and other columns stay as they are."""
    out = _with_dropped(docs, min_chars).withColumn("kept", _without(F.col("row.text"), F.col("dropped")))
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: The same for DuckDB.
SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, coalesce(c.first_id < l.doc_id, false) AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
