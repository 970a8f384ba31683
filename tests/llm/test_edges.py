"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import decontamination, fingerprints, licenses, mixing, neardup, passages, quality, secretscan, suffixes, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string, words string, digest string, kind string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", None, "b", 3), (5, LONG, "en", "a", len(LONG)),
        (6, LONG, "en", None, len(LONG)), (7, "one two three", "en", "b", 13), (7, "one two three", "en", "b", 13), (None, "no id here", "de", "c", 10),
        (8, "ünï çödé \U0001F600 \x01\x02\x03 " + "aAbB09" * 9, "fr", "a", 20), (9, "one", "en", "b", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([row + ("x", "y", "z", "d", "k") for row in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, (i % 3 > 0) * 1, 0) for i in range(9)] + [(None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "one two three"), (1, None), (None, ""), (2, LONG[:400])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def operators(tables):
    spark_benchmark = lambda d: d.sparkSession.read.parquet(f"{tables}/benchmark.parquet")
    labels = lambda d: d.sparkSession.read.parquet(f"{tables}/labels.parquet")
    return {
        "passages": passages.remove_passages, "suffixes": suffixes.remove_repeats, "neardup": neardup.near_classes, "licenses": licenses.scan,
        "fingerprints": fingerprints.compare_edits, "mixing": lambda d: mixing.mix(d, F.array("source")),
        "decontamination": lambda d: decontamination.find_hits(d, spark_benchmark(d)),
        "quality": lambda d: quality.score(d, quality.fit(d, labels(d))), "secrets": lambda d: secretscan.scan(d, secretscan.fit(d, made=200)),
    }


NAMES = ("passages", "suffixes", "neardup", "licenses", "fingerprints", "mixing", "decontamination", "quality", "secrets")


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(docs, tables, name):
    out = operators(tables)[name](docs).select("doc_id").collect()
    assert sorted(str(row.doc_id) for row in out) == sorted(str(row[0]) for row in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(docs, tables, name):
    assert operators(tables)[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_all_columns(spark, docs, tables, name, stage):
    out = stage(spark, docs, tables)
    assert set(docs.columns) <= set(out.columns)
    assert out.count() <= len(ROWS)
    assert stage(spark, docs.where("false"), tables).count() == 0


def test_values_of_edge_rows(docs, tables):
    run = {name: {row.doc_id: row for row in operators(tables)[name](docs).collect()} for name in ("passages", "suffixes", "neardup", "decontamination", "fingerprints")}
    assert run["passages"][5].n_removed == 0 and run["passages"][6].n_removed == 30_000 and run["passages"][1].n_words == 0
    assert run["suffixes"][5].n_removed == len(LONG) and run["suffixes"][1].n_bytes == 0
    assert run["neardup"][6].class_id == 5 and run["neardup"][9].class_id == 4 and run["neardup"][3].class_id == 1 and run["neardup"][None].class_id is None
    assert run["neardup"][7].class_size == 2
    assert run["decontamination"][7].n_hit == 3 and run["decontamination"][1].n_hit == 0 and run["decontamination"][5].n_items == 1
    assert run["fingerprints"][6].near_next == 1.0 and run["fingerprints"][2].n_chars == 0 and run["fingerprints"][1].n_chars == 0


def test_url_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTPS://WWW.Example.COM:80/en/?q"), (6, "x://a.example.com/en/é#y"), (6, "x://a.example.com/en/é#y"),
            (7, "x://example.com"), (8, "x://net/es/1"), (None, "x://badexample.com/en/1")]
    pages = spark.createDataFrame([row + ("h", "p", "k") for row in rows], "page_id long, url string, host string, path string, key string")
    rules = spark.createDataFrame(urlfilter.RULES + (("", "/", "block"), (None, "/", "block")), "host string, path string, verdict string")
    out = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules, sweep_rows=1).collect())
    assert out == sorted([("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("4", "", "", None, "allow"),
                          ("5", "www.example.com:80", "/en/", None, "allow"), ("6", "a.example.com", "/en/é", "example.com/en/", "block"),
                          ("6", "a.example.com", "/en/é", "example.com/en/", "block"), ("7", "example.com", "", None, "allow"),
                          ("8", "net", "/es/1", "net/es/", "block"), ("None", "badexample.com", "/en/1", "com/", "allow")])
    assert urlfilter.judge(pages.where("false"), rules).count() == 0
    assert urlfilter.judge(pages, rules.where("false")).where("rule is null").count() == len(rows)


def test_mixing_hands_on_columns_of_any_name(spark):
    rows = [(i, "w " * (i % 7), "ab"[i % 2], 1, 2, 3, 4, 5, 6.0) for i in range(200)] + [(None, f"{i} x", None, 1, 2, 3, 4, 5, 6.0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rest int, cut int, pattern int, bucket int, ordinal int, target double")
    out = mixing.mix(docs, F.array("source")).collect()
    assert len(out) == 250 and {(r.rest, r.cut, r.pattern, r.bucket, r.ordinal) for r in out} == {(1, 2, 3, 4, 5)}
    for source in ("a", "b", None):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and all(0 <= r.taken <= 2 * r.size for r in mine)
