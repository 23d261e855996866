"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, language_id, license_scan, line_dedup, masked_lm, media, mixing, ngram_join, quality, queries, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["node", "sig", "sigs", "label", "size", "copies", "h", "id", "key", "gone", "row", "parts", "places", "n_lines", "quality_score", "item", "hash", "part", "start"]
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word", "en", None, 4), (5, PROSE, "en", "s", 10), (6, PROSE, "en", "s", 10),
        (6, PROSE, "en", "s", 10), (7, long, "en", "s", 9), (8, "x" * 200_000, None, "s", 9), (9, "a\nb\nc\nd\na\nb\nc", "fr", "t", 9), (10, "Licensed under the Apache License, Version 2.0.", "en", "t", 9), (None, "no id here", "en", "t", 9), (11, "😀 é \x00 zero", "en", "t", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def jobs(benchmark, labels):
    return {
        "license": lambda d: license_scan.license_blocks(d),
        "join": lambda d: ngram_join.similarity_classes(d),
        "one_each": lambda d: ngram_join.one_of_each_class(d),
        "media": lambda d: media.described(media.texts_as_images(d)),
        "leaks": lambda d: decontaminate.leaks(d, benchmark),
        "clean": lambda d: decontaminate.without_leaks(d, benchmark),
        "tokens": lambda d: token_files.read_tokens(token_files.write_tokens(d, queries.tokenizer_path())),
        "quality": lambda d: quality.with_scores(d, quality.fit(d, labels)),
        "mix": lambda d: mixing.mix(d),
        "lm": lambda d: masked_lm.scores(d),
        "language": lambda d: language_id.predict_languages(d, language_id.fit(d)),
        "lines": lambda d: line_dedup.without_repeats(d),
        "passages": lambda d: line_dedup.without_passages(d),
        "mix_stage": lambda d: corpus_pipeline.mix_sources(d.sparkSession, d, ""),
    }


ONE_A_ROW = ("join", "media", "tokens", "quality", "mix", "lm", "language", "lines", "passages")


@pytest.mark.parametrize("name", ["license", "join", "one_each", "media", "leaks", "clean", "tokens", "quality", "mix", "lm", "language", "lines", "passages", "mix_stage"])
def test_odd_rows_and_no_rows(odd, nothing, benchmark, labels, name):
    run = jobs(benchmark, labels)[name]
    rows = run(odd).collect()
    if name in ONE_A_ROW:
        assert len(rows) == odd.count()
    assert run(nothing).collect() == []


def test_results_of_odd_rows(odd, benchmark, labels):
    run = jobs(benchmark, labels)
    classes = {(r.doc_id, r.n_shingles, r.component_id) for r in run["join"](odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 19, 5), (6, 19, 5)} <= classes
    assert {r.doc_id for r in run["leaks"](odd).collect()} == {5, 6}
    assert [(r.doc_id, r.license) for r in run["license"](odd).collect()] == [(10, "Apache-2.0-line")]
    assert {r.doc_id: r.text for r in run["lines"](odd).collect()}[9] == "a\nb\nc\nd"
    lang = {r.doc_id: (r.lang_pred, r.score) for r in run["language"](odd).collect()}
    assert lang[1] == lang[2] == lang[3] == ("und", 0.0)
    lm = {r.doc_id: r for r in run["lm"](odd).collect()}
    assert (lm[1].n_tokens, lm[1].sum_logp, lm[1].mean_logp) == (0, 0.0, None) and lm[5].sum_logp < 0
    tokens = [(r.doc_id, r.start, r.n_tokens) for r in run["tokens"](odd).orderBy("start").collect()]
    assert tokens[0][0] is None and (1, tokens[0][2], 1) in tokens
    assert all(a[1] + a[2] == b[1] for a, b in zip(tokens, tokens[1:]))
    images = {r.doc_id: r for r in run["media"](odd).collect()}
    assert (images[1].n_bytes, images[1].payload_bytes) == (0, 64) and images[5].feature == images[6].feature


def test_one_of_each_class_stays(odd, spark):
    got = ngram_join.one_of_each_class(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(None, PROSE), (3, PROSE), (2, other), (2, PROSE), (2, PROSE), (9, other + " more"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0), (r.text or "")) for r in ngram_join.one_of_each_class(df).collect())
    assert got == sorted([(0, ""), (2, other), (2, PROSE)])


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_stages_take_odd_and_empty_tables(odd, nothing, spark, benchmark, labels, tmp_path, rows):
    """Every stage on odd rows with odd tables beside them, and on none with empty ones; all but the last keep the columns."""
    docs, b, lab = (odd, benchmark, labels) if rows == "odd" else (nothing, benchmark.limit(0), labels.limit(0))
    for table, df in (("benchmark", b), ("labels", lab)):
        df.withColumns({c: F.lit(0) for c in CLASH}).write.parquet(str(tmp_path / f"{table}.parquet"))
    for stage, run in corpus_pipeline.STAGES:
        got = run(spark, docs, str(tmp_path))
        if stage != "tokens":
            assert got.columns == odd.columns, stage
        assert got.count() <= 2 * docs.count(), stage
