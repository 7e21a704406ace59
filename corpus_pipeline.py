"""From raw documents to packed training windows, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldgrid.llm import langid, line_dedup, mixing, ngram_join, packing
from fieldgrid.llm.common import discard, materialize, passing, stored, table

#: A document goes if its language can't be told, or the best one's probability is below this.
MIN_LANGUAGE_SCORE = 0.5
#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def aside(docs: DataFrame) -> DataFrame:
    """docs with all but the documents' own columns in one, so that none has a name that an operator gives."""
    return docs.select(*COLUMNS, F.struct(*[c for c in docs.columns if c not in COLUMNS]).alias("others")) if len(docs.columns) > len(COLUMNS) else docs


def back(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[c if c in COLUMNS else F.col(f"others.`{c}`").alias(c) for c in columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; fills in a missing lang.

    Null and empty texts and texts without a letter go, as no language can be told.
    Repeated rows and null ids stay if their text does. Without any labelled text nothing
    is learned, so all go. Other columns pass through.
    """
    model, pieces = langid.fitted(docs)
    found = langid.identify(aside(docs), model, pieces).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return back(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share, but for the largest id's; all documents and columns stay.

    A null text becomes an empty one. Rows of one id count as one document; rows of a null
    id keep all their lines and count for none.
    """
    done = line_dedup.dedup_lines(aside(docs))
    return back(done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates (five words, similarity 0.8).

    Of the rows of an id and text, which may differ in their other columns, the one stays
    whose other columns come first as JSON (texts are told apart by their md5, a null
    from all); rows of an id with other texts stay beside each other, as groups are of
    ids. Null ids take no part and stay, as do null and empty texts.
    """
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text"), n=5, num=80, den=100)
    stay = materialize(groups.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    rest = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]), {"ignoreNullFields": "false"})
    # the md5 is told once, beside the text
    told = docs.where("doc_id IS NOT NULL").withColumns({"_text_key": F.md5(F.col("text").cast("binary")), "_rest": rest})
    first = Window.partitionBy("doc_id", "_text_key").orderBy("_rest")
    kept = told.join(stay.hint("merge"), "doc_id", "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return kept.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of the sources to their target weights; a document taken twice has two rows.

    A null source is one of its own. Documents without words have nothing to take and no
    row; repeated rows and null ids are documents of their own. Reruns agree.
    """
    mixed = mixing.mixed_documents(aside(docs))
    return back(mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)), docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in windows of 2048 tokens; see op5_packing. Null and empty texts are their end token, repeated rows and null ids documents of their own."""
    return packing.op5_packing(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Model scores, seeded draws and online packing have no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder and read again; an empty table gives an empty result.

    When a stage is written, the tables that it wrote on the way are deleted, and what the
    stage before had left; so the folder holds a stage's input, tables and output at most.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing(spark) as kept:
            docs, path = stored(stage(spark, docs, sf_dir), name)
            kept.append(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
