"""The pipeline's stages against plain versions, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F
from test_operators import plain_groups, plain_line_dedup

import corpus_pipeline as p
from fieldgrid.llm import langid
from fieldgrid.llm.common import materialize

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    # what real tables hold besides: nulls, empty texts, repeated rows
    first = docs.orderBy("doc_id").limit(3)
    odd = spark.createDataFrame([(10_001, None, "en", "src1", None), (10_002, "", None, None, 0), (10_003, "12 34", "en", None, 5), (None, "the cat and the dog of the house", None, None, 9)], docs.schema)
    docs = docs.unionByName(first).unionByName(odd)
    out = [("documents", docs)]
    for name, stage in p.STAGES:
        out.append((name, materialize(stage(spark, out[-1][1], small), name)))
    return dict(out)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_stages_keep_the_columns(kept):
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    for n in names[:-1]:
        assert kept[n].dtypes == kept["documents"].dtypes


def test_languages(kept):
    model, pieces = langid.fitted(kept["documents"])
    found = langid.identify(kept["documents"], model, pieces)
    want = found.where(f"lang_pred <> 'und' AND score >= {p.MIN_LANGUAGE_SCORE}")
    assert sorted(map(repr, rows(want, "doc_id", "text"))) == sorted(map(repr, rows(kept["language_id"], "doc_id", "text")))
    assert kept["language_id"].where("lang IS NULL").count() == 0
    assert not {10_001, 10_002, 10_003} & {r[0] for r in rows(kept["language_id"], "doc_id")}


def test_lines(kept):
    want = [(i, t) for i, _, _, t in plain_line_dedup(rows(kept["language_id"], "doc_id", "text"))]
    assert sorted(map(repr, want)) == sorted(map(repr, rows(kept["line_dedup"], "doc_id", "text")))
    assert kept["line_dedup"].where("n_chars <> char_length(text)").count() == 0


def test_near_duplicates(kept):
    before = rows(kept["line_dedup"], "doc_id", "text")
    stay = {i for i, _, c in plain_groups(before, 5, 80, 100) if i == c}
    want = sorted(map(repr, {r for r in before if r[0] in stay or r[0] is None}))
    assert sorted(map(repr, set(rows(kept["ngram_jaccard"], "doc_id", "text")))) == want
    assert kept["ngram_jaccard"].where("doc_id IS NOT NULL").groupBy("doc_id", "text").count().where("count > 1").count() == 0


def test_mixture(kept):
    words = lambda df: {r[0]: r[1] for r in rows(df.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("n")), "source", "n")}
    before, after = words(kept["ngram_jaccard"]), words(kept["mixing"])
    from fieldgrid.llm.mixing import source_targets

    for s, target in source_targets(before).items():
        assert abs(after.get(s, 0) - target) <= max(100, 0.05 * target)
    assert kept["mixing"].groupBy("doc_id").count().where("count > 2").count() == 0


def test_windows(kept):
    own = rows(kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")), "n")
    assert all(n == 2048 or n & (n - 1) == 0 for (n,) in own)
    tokens = kept["packing"].groupBy("sequence_id", "offset").count().where("count > 1").count()
    assert tokens == 0
    ids = {r[0] for r in rows(kept["packing"], "doc_id")}
    assert ids == {r[0] for r in rows(kept["mixing"], "doc_id")}


def test_survivor_of_rows_that_differ_in_other_columns(spark, small):
    text = "one two three four five six seven eight nine ten"
    rows_ = [(1, text, "fr", "b", 1), (1, text, "en", "c", 2), (1, text, None, "a", 3), (1, "another text", "en", "a", 4), (1, None, "en", "a", 5), (1, "", "en", "a", 6), (2, text, "aa", "a", 0), (None, text, "en", "a", 7), (None, text, "en", "a", 7)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(map(repr, [rows_[1], *rows_[3:6], *rows_[7:]]))
    for n in (1, 5):
        got = p.drop_near_duplicates(spark, df.repartition(n), small)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_run(spark, tmp_path):
    """From documents to packed pieces against plain versions of the stages in a row: each document that stays has all its words' tokens, as often as the mix takes them. Nothing but the last stage's input is left in the folder."""
    import os

    import tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 150")
    odd = spark.createDataFrame([(10_001, None, "en", "src1", None), (10_002, "12 34", "en", None, 5)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    got = {}
    for i, length in rows(p.run(spark, str(tmp_path)), "doc_id", "length"):
        got[i] = got.get(i, 0) + length
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"mixing"}
    told = {i: t for i, t, lang, score in rows(langid.identify(docs, *langid.fitted(docs)), "doc_id", "text", "lang_pred", "score") if lang != "und" and score >= p.MIN_LANGUAGE_SCORE}
    lines = {i: t for i, _, _, t in plain_line_dedup(list(told.items()))}
    stay = {i for i, _, c in plain_groups(list(lines.items()), 5, 80, 100) if i == c}
    meta = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    assert all(meta[i][0] for i in stay)  # so that the rows are those of the run
    kept = spark.createDataFrame([(i, lines[i], *meta[i], len(lines[i])) for i in sorted(stay)], docs.schema)
    codec = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    want = {}
    for i, t in rows(p.mix_sources(spark, kept, ""), "doc_id", "text"):
        want[i] = want.get(i, 0) + len(codec.encode(t, add_special_tokens=False).ids) + 1
    assert got == want and len(want) > 50


def test_stages_of_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
    assert p.STAGES[-1][1](spark, docs, small).count() == 0


def test_stages_of_columns_that_clash(spark, small):
    """Columns named as those that the operators make, and nulls in all of them, pass every stage."""
    names = ["lang_pred", "score", "n_lines", "n_dropped", "kept_text", "component_id", "class_id", "n_shingles", "node", "size", "target", "taken", "first", "shard", "key", "id", "start", "length"]
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.when(F.col("doc_id") % 2 == 0, F.lit(c + ' {}')).alias(c) for c in names])
    for _, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small), "clash")
        assert docs.columns[-len(names) :] == names and docs.count() > 0
        assert docs.where("doc_id % 2 = 0 AND taken <> 'taken {}' OR doc_id % 2 = 1 AND taken IS NOT NULL").count() == 0
    assert p.STAGES[-1][1](spark, docs, small).count() > 0
