"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from kgspark.llm import decontamination, language, mixing, neighbours, pii, quality, sharding, simhash, url_filter, warc

LONG = "lorem ipsum " * 20_000 + "x" * 50_000 + "1 " * 5_000
#: Columns named like those that operators make.
EXTRA = "shard int, found string, _row string, key string, text_crc32 string, quality_score double, score double, fp long, n int, size long, u long, part string, target double, _hits string, _at int, bucket int, root long"
NAMES = [x.split()[0] for x in EXTRA.split(", ")]
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def docs(spark):
    texts = [(1, "The quick brown fox jumps over the lazy dog", "en", "a"), (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, None, None, None), (3, "", "en", None), (4, LONG, "en", "b"), (None, "Der schnelle braune Fuchs", "de", "a"), (None, None, None, None), (5, "  \n\t ", None, "c"), (6, "the QUICK brown fox jumps over the lazy dog", "en", "b"), (7, "mail a@b.co and 4111 1111 1111 1111", "en", "\U0001f600"), (1, "another text under the same id", None, "a"), (8, "éè \U0001f600 \x00 �", "fr", "a")]
    return spark.createDataFrame([(*t, None, *[None] * len(NAMES)) for t in texts], DOCS)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, None, None), (None, 1, 0), (4, 0, 0), (6, 1, 0), (6, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (None, "lazy dog"), (3, None), (4, ""), (5, "lorem")], "item_id long, text string")


CASES = {
    "shard": (lambda s, d: sharding.shard_slots(d), 7),
    "mix": (lambda s, d: mixing.mix(d), 7),
    "simhash": (lambda s, d: simhash.simhash_groups(d), 3),
    "language": (lambda s, d: language.identify(d), 4),
    "pii": (lambda s, d: pii.report(d), 7),
    "sanitised": (lambda s, d: pii.sanitised(d), len(NAMES) + 5),
    "quality": (lambda s, d: quality.judge(d, labels(s)), 4),
    "decontamination": (lambda s, d: decontamination.judged(d, benchmark(s)), 6),
}


@pytest.mark.parametrize("name", CASES)
def test_a_row_for_each_row(spark, name):
    run, _ = CASES[name]
    assert run(spark, docs(spark)).count() == docs(spark).count()


@pytest.mark.parametrize("name", CASES)
def test_empty_table(spark, name):
    run, width = CASES[name]
    out = run(spark, docs(spark).limit(0))
    assert out.count() == 0
    assert width <= len(out.columns)


def test_mix_has_exact_targets(spark):
    rows = mixing.mix(docs(spark)).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target)
        assert all(r.taken <= 2 * r.size for r in own)


def test_language_without_labels(spark):
    out = language.identify(docs(spark).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in out.collect()} == {"und"}


def test_empty_benchmark_and_labels(spark):
    assert {r.n_items for r in decontamination.judged(docs(spark), benchmark(spark).limit(0)).collect()} == {0}
    assert {round(r.score, 6) for r in quality.judge(docs(spark), labels(spark).limit(0)).collect()} == {0.5}


def test_other_texts_of_a_repeated_id_stay(spark):
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs(spark)).collect()]
    assert sorted(t for i, t in kept if i == 1) == ["The quick brown fox jumps over the lazy dog", "another text under the same id"]
    rows = [(1, "one text that has two copies here"), (2, "one text that has two copies here"), (2, "quite another text of the second id"), (3, "quite another text of the second id")]
    kept = {tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[0], rows[2]}


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, at, empty):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    own = docs(spark).limit(0) if empty else docs(spark)
    out = corpus_pipeline.STAGES[at][1](spark, own, str(tmp_path))
    assert set(own.columns) <= set(out.columns)
    assert (out.count() == 0) == empty


def test_pages(spark):
    rows = [(1, "http://A.net/x", "<p>a"), (2, None, None), (3, "no scheme", ""), (None, "http://x.org/fr/1", "<p>a"), (3, "no scheme", ""), (5, "http://x.example.com/de/" + "y" * 9000, "z" * 200_000), (6, "://", "<p>a"), (7, "http://h?q=1#f", "é")]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, verdict string, key string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert url_filter.filter_urls(pages).count() == len(rows)
    assert (found[1].host, found[1].rule, found[1].verdict) == ("a.net", "net/", "block")
    assert (found[2].host, found[2].path) == ("", "") and (found[7].host, found[7].path) == ("h", "")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    archived = warc.archived(pages).collect()
    assert len(archived) == len(rows)
    assert {r.page_id: (r.record_type, r.refers_to) for r in archived if r.page_id in (1, 6)} == {1: ("revisit", 6), 6: ("response", None)}
    assert sorted(r.record_type for r in archived if r.page_id == 3) == ["response", "response"]
    assert warc.archived(pages.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.9, 0.1]), (100, [1e300, 1e300]), (7, [1e-300, 0.0])]
    vectors = spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<double>, score double")
    out = [tuple(r) for r in neighbours.nearest(vectors).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in out if r[0] == 0] == [(0, 1, 7), (0, 2, 50), (0, 3, 1), (0, 4, 100)]
    assert out[0][3] == 1.0
    assert neighbours.nearest(vectors.limit(0)).count() == 0
