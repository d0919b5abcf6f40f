"""Line dedup over overlapping three-line windows.

Each document's lines are read three at a time, window by window. Windows are compared over all
documents by a 128-bit hash, first occurrences are found by a pre-aggregated minimum, and every later
occurrence covers its three lines. Covered positions are merged and those lines removed. All of it is
DataFrame functions.

Cases: a null text is empty; an empty text is one empty line; documents of fewer than three lines have
no window and stay as they are; the order of occurrences is that of document ids (a null id first),
then positions, so a document that repeats its own window loses the later one; rows that share an id
are one document, and equal positions in them are one occurrence; long texts are taken whole; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, materialize, release

WINDOW = 3


def _lines(text: str):
    return F.split(text, "\n", -1)


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, salt (a hash of the text) and starts: where in the document windows begin that occur
    earlier too."""
    docs = documents(df, id_col, text_col).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("salt"), _lines("text").alias("lines"))
    spot = F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1))
    hashed = F.transform(spot, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("lines", i, WINDOW)).alias("h1"), F.xxhash64(F.lit(1), F.slice("lines", i, WINDOW)).alias("h2")))
    windows = docs.filter(F.size("lines") >= WINDOW).select("doc", "salt", F.explode(hashed).alias("w")).select("doc", "salt", "w.*")
    windows = materialize(windows, "windows")
    place = F.struct("doc", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # written first, so that the join has plain inputs and Spark can split a very common window
    first = materialize(first, "first")
    again = windows.join(first, ["h1", "h2"]).filter(~F.col("first").eqNullSafe(place))
    starts = materialize(again.groupBy("doc", "salt").agg(F.collect_set("at").alias("starts")), "starts")
    release(windows, first)
    return starts


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the remaining lines in text_col, and n_lines and n_removed in columns added under these
    names (with _ in front while df has such columns)."""
    starts = repeated_windows(df, id_col, text_col)
    names = {}
    for name in ("_doc", "_salt", "_starts", "_lines", "_kept", "n_lines", "n_removed"):
        out = name
        while out in df.columns:
            out = "_" + out
        names[name] = out
    doc, salt, lines, kept = (names[n] for n in ("_doc", "_salt", "_lines", "_kept"))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    # sorted and merged at every size, as the starts grow with the input and may outgrow a broadcast
    side = starts.toDF(doc + "s", salt + "s", names["_starts"]).hint("merge")
    keyed = df.withColumns({doc: df[id_col].cast("long"), salt: F.xxhash64(text)})
    joined = keyed.join(side, F.col(doc).eqNullSafe(F.col(doc + "s")) & (F.col(salt) == F.col(salt + "s")), "left")
    covered = F.flatten(F.transform(names["_starts"], lambda s: F.sequence(s, s + (WINDOW - 1))))
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.coalesce(covered, F.array().cast("array<int>")))
    out = joined.withColumn(lines, _lines(text)).withColumn(kept, left)
    new = F.when(F.col(names["_starts"]).isNull(), df[text_col]).otherwise(F.array_join(F.transform(kept, lambda k: F.element_at(lines, k)), "\n"))
    return out.select(
        *(new.alias(c) if c == text_col else df[c] for c in df.columns),
        F.size(lines).cast("long").alias(names["n_lines"]),
        (F.size(lines) - F.size(kept)).cast("long").alias(names["n_removed"]),
    )


#: The digest of op2 in DuckDB's SQL: documents with the lines that stay.
SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c FROM l WHERE i + 2 <= len(lines)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
k AS (SELECT l.doc_id, string_agg(l.lines[l.i], chr(10) ORDER BY l.i) AS kept, count(*) AS n_kept
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i WHERE x.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(len(d.lines) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       md5(coalesce(k.kept, '')) AS kept_md5
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
