"""Line deduplication over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, ascii_lower, materialize, small_batches


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rebuild(batches):
    """Drops the doomed keys' lines of each text; keeps the order of the rest by position."""
    import hashlib

    import pyarrow as pa

    blanks = BLANKS.encode()
    for batch in batches:
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        kept, n_lines, n_dropped = [], [], []
        for text, doomed in zip(cols["_text"], cols["_doomed"]):
            lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
            n_lines.append(len(lines))
            if doomed.is_valid:
                gone = set(doomed.as_py())
                rest = [x for x in lines if hashlib.md5(x.strip(blanks).lower()).digest() not in gone]
            else:
                rest = lines
            n_dropped.append(len(lines) - len(rest))
            kept.append(text.as_py() if text.is_valid and len(rest) == len(lines) else b"\n".join(rest).decode())
        arrays = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("_text", "_doomed")]
        names = [name for name in batch.schema.names if name not in ("_text", "_doomed")]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "_kept", "_n_lines", "_n_dropped"])


def doomed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, doomed: array of md5 of keys): the keys whose lines each document loses.

    Keys are exploded once per document, so a line that a document repeats costs one
    row; their counts are combined on the map side, and a key held by a third of all
    documents meets others only in a join that Spark splits.
    """
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.char_length(k) >= min_chars))
    held = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.explode(keys).alias("_key"))
        .select("_id", F.unhex(F.md5(F.col("_key").cast("binary"))).alias("_h"))
    )
    common = materialize(
        # rows may repeat an id, so ids are counted distinctly; min and max settle two, a distinct count the rest
        held.groupBy("_h").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_last")).where(F.col("_n") >= min_docs).select("_h", "_last"),
        "common-lines",
    )
    loses = held.join(common.hint("merge"), "_h").where(F.col("_id") != F.col("_last"))
    return materialize(loses.groupBy("_id").agg(F.collect_set("_h").alias("_doomed")), "doomed-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added.

    A line's key has blanks (space, U+0009 to U+000D) stripped at both ends and A-Z in
    lower case. Keys of at least min_chars code points that at least min_docs documents
    hold lose all their lines, except in the document of the largest id. Keys are told
    apart by their md5.

    Null and empty texts are one empty line. Rows of one id count as one document, and
    each row loses its own lines. Rows with a null id neither count nor lose lines. An
    empty table gives an empty result. Other columns pass through; names that start
    with _ are reserved, and kept_text, n_lines, n_dropped are replaced if present.
    """
    small_batches(docs.sparkSession)
    doomed = doomed_lines(docs, id_col, text_col, min_chars, min_docs).withColumnRenamed("_id", "_doomed_id")
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    # sorted by id at every size: a table of doomed lines grows with the corpus, and Spark splits what is skewed
    joined = docs.join(doomed.hint("merge"), docs[id_col] == doomed["_doomed_id"], "left").select(*[docs[c] for c in names], docs[text_col].alias("_text"), "_doomed")
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("_kept", T.StringType()), T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    rebuilt = joined.mapInArrow(_rebuild, schema)
    return rebuilt.withColumnsRenamed({"_kept": "kept_text", "_n_lines": "n_lines", "_n_dropped": "n_dropped"})


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM base)),
common AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.last AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
