"""Line deduplication: explode normalised lines, hash, count documents for each hash, drop, reassemble by position.

Every document is split at ``\\n`` (a null or empty text is one empty line). A
line's key is the line without white space at its ends and with A-Z
lower-cased. Keys of at least ``min_chars`` code points that occur in at least
``min_documents`` rows lose all their lines in every row; the others stay in
their order. Repeated rows and repeated ids count as documents of their own,
ties do not arise, and an empty table gives an empty result. Result columns
replace columns of the same name.

A key is known by two 64-bit hashes. Each row sends every distinct key once,
and counts are combined before the shuffle, so a line in a third of all rows
costs one row for each task. Only lines' hashes and positions are shuffled to
the common keys, in a join that AQE can split where a key is hot. The positions to drop are written out
and meet the texts in a merge join, at every size: they grow with the texts, so each text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import FILE, ROW, SPACES, ascii_lower, documents, stage, text_of, with_row_key


def dedup_lines(df: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """Adds ``kept_text``, ``n_lines`` and ``n_dropped`` to every row."""
    rows = with_row_key(df)
    lines = F.split(ascii_lower(text_of()), "\n")
    keys = rows.select(FILE, ROW, F.posexplode(lines).alias("position", "line")).select(
        FILE, ROW, "position", F.trim("line", F.lit(SPACES)).alias("key")
    ).filter(F.length("key") >= min_chars).select(
        FILE, ROW, "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )
    keys = stage(keys, "line_keys")

    common = keys.groupBy(FILE, ROW, "h1", "h2").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    common = stage(common.filter(F.col("n") >= min_documents).select("h1", "h2"), "common_lines")

    dropped = keys.join(common, ["h1", "h2"], "left_semi").groupBy(FILE, ROW).agg(F.collect_list("position").alias("__llm_dropped"))
    out = rows.join(stage(dropped, "dropped_positions").hint("merge"), [FILE, ROW], "left").withColumn("__llm_lines", F.split(text_of(), "\n"))
    n = F.size("__llm_lines")
    gone = F.coalesce("__llm_dropped", F.array().cast("array<int>"))
    out = out.withColumns({
        "__llm_kept": F.array_except(F.sequence(F.lit(0), n - 1), gone),
        "n_lines": n.cast("long"), "n_dropped": F.size(gone).cast("long"),
    })
    kept = F.transform("__llm_kept", lambda i: F.get("__llm_lines", i))
    return out.withColumn("kept_text", F.array_join(kept, "\n")).drop(FILE, ROW, "__llm_dropped", "__llm_lines", "__llm_kept")


def digest(df: DataFrame) -> DataFrame:
    return dedup_lines(df.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def query(spark, sf_dir):
    return digest(documents(spark, sf_dir))


SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) AS position, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM c)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE key NOT IN (SELECT key FROM c)), '')) AS kept_sha256
FROM k GROUP BY doc_id"""
