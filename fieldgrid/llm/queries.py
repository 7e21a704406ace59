"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import audio, collocations, hard_negatives, html_extract, langid, line_dedup, mixing, ngram_join, packing, repeats, topk, toxicity, warc
from .common import table


def queries() -> dict:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.op1_line_dedup(table(spark, d, "documents")),
        "op2_topk": lambda spark, d: topk.op2_topk(table(spark, d, "embeddings")),
        "op3_audio": lambda spark, d: audio.op3_audio(table(spark, d, "embeddings")),
        "op4_ngram_jaccard": lambda spark, d: ngram_join.op4_ngram_jaccard(table(spark, d, "documents")),
        "op5_packing": lambda spark, d: packing.op5_packing(table(spark, d, "documents")),
        "op6_langid": lambda spark, d: langid.op6_langid(table(spark, d, "documents")),
        "op7_html_extract": lambda spark, d: html_extract.op7_html_extract(table(spark, d, "pages")),
        "op8_toxicity": lambda spark, d: toxicity.op8_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op9_mixing": lambda spark, d: mixing.op9_mixing(table(spark, d, "documents")),
        "op10_warc": lambda spark, d: warc.op10_warc(table(spark, d, "pages")),
        "op11_repeats": lambda spark, d: repeats.op11_repeats(table(spark, d, "documents")),
        "op12_collocations": lambda spark, d: collocations.op12_collocations(table(spark, d, "documents")),
        "op13_hard_negatives": lambda spark, d: hard_negatives.op13_hard_negatives(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op2_topk": topk.ORACLE, "op4_ngram_jaccard": ngram_join.ORACLE, "op10_warc": warc.ORACLE, "op12_collocations": collocations.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
