"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candlewick.llm import decontamination, license_scan, near_dup, packing, quality, sharding, token_files, toxicity, url_filter
from candlewick.llm.html_extract import extract_text
from candlewick.sources import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word another " * 40_000
TEXT = " ".join(f"t{i}" for i in range(70))
ROWS = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, " \n\t", "en", "s", 3), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, LONG, "en", "s", len(LONG)), (6, TEXT, "en", "s", 9), (7, TEXT, "en", "s", 9), (None, TEXT, "en", "s", 9), (8, "é\x00  ẞ 漢字", "xx", "s", 5)]
CLASHES = "band node comp rank shard slot size host content words h n label score part key _bucket _row _host _content _drop _text _depleted hub a b x y sketch tie".split()

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, None, 1), (1, 0, None), (4, 1, 0), (4, 1, 1), (6, 0, 1), (99, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, TEXT), (3, TEXT), (4, "two words")], "item_id long, text string")


def operators(labels, bench):
    return {
        "licenses": (license_scan.scan_licenses, None),
        "toxicity": (lambda d: toxicity.toxicity_scores(d, labels), len(ROWS)),
        "near": (near_dup.near_duplicate_groups, len(ROWS)),
        "quality": (quality.quality_verdicts, len(ROWS)),
        "shards": (sharding.kd_shards, len(ROWS)),
        "tokens": (token_files.token_file_digest, len(ROWS)),
        "packing": (packing.pack, None),
        "leaks": (lambda d: decontamination.contamination(d, bench), None),
    }


@pytest.mark.parametrize("name", ["licenses", "toxicity", "near", "quality", "shards", "tokens", "packing", "leaks"])
def test_odd_rows_and_empty_tables(spark, docs, labels, bench, name):
    run, n = operators(labels, bench)[name]
    rows = run(docs).collect()
    assert n is None or len(rows) == n
    empty = run(docs.limit(0))
    assert empty.collect() == [] and empty.columns == run(docs).columns


def test_results_on_odd_rows(spark, docs, labels, bench):
    near = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dup.near_duplicate_groups(docs).collect()}
    assert near[7, 66] == (6, False) and near[None, 66] == (None, True) and near[None, 0] == (None, True) and near[2, 0] == (2, True) and near[4, 1] == (4, True)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, bench).collect()} == {(6, 3), (7, 3), (None, 3)}
    for words in (0, 500_000):  # by shuffle, in the tasks
        assert decontamination.contamination(docs, bench.limit(0), words).collect() == []
    shuffled, held = (sorted(map(str, decontamination.contamination(docs, bench, words).collect())) for words in (0, 500_000))
    assert shuffled == held
    packed = packing.pack(docs).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 2) == 1 and max(r["length"] for r in packed if r["doc_id"] == 5) == 4096
    read = token_files.token_file_digest(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    shards = sharding.kd_shards(docs).collect()
    assert {r["size"] for r in shards if r["doc_id"] == 1} == {8}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows_and_empty_tables(spark, docs, labels, bench, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, str(tmp_path))
    rows = out.collect()
    assert run(spark, docs.limit(0), str(tmp_path)).collect() == []
    if stage < 4:
        assert out.columns == docs.columns and len(rows) > 0
        assert all(r["band"] == "clash" and r["_row"] == "clash" for r in rows)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", ""), (2, "x", "<p>Hi, you."), (3, "http://A.com/de/?x", "<" * 5000)], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = extract_text(pages).orderBy("page_id").collect()
    assert [r["text"] for r in got] == ["", "", "", "Hi, you.", got[4]["text"]]
    urls = url_filter.filter_urls(pages).orderBy("page_id").collect()
    assert [(r["host"], r["path"]) for r in urls[:4]] == [("", "")] * 4 and urls[4]["rule"] == "com/de/" and urls[4]["verdict"] == "block"
    assert extract_text(pages.limit(0)).collect() == url_filter.filter_urls(pages.limit(0)).collect() == []


def test_empty_labels_and_benchmark(spark, docs, labels, bench):
    assert max(r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()) < 1e-9
    assert decontamination.contamination(docs, bench.limit(0)).collect() == []
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert scratch.shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "s3a://bucket/shared/"}
    assert scratch.shared_dir(Session) == "s3a://bucket/shared"
