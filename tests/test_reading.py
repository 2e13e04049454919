"""Pages with their plans, streams of pages that are stopped and go on, and sources that fail each for itself."""

import json

import pytest
from pyspark.sql import functions as F

from jobweave.sources import landing, paging
from jobweave.sources.paging import Paging, Place, after

FETCH = "tests.fetchers:noted"
SMALL = Paging("content", limit=3, most=100, total="totalFound")


def asked(tmp_path):
    return open(f"{tmp_path}/asked").read().split("\n")[:-1]


def ids(rows):
    return sorted(x["id"] for r in rows if r.payload for x in json.loads(r.payload)["content"])


@pytest.mark.parametrize("mode, calls", [("none", 5), ("wrong", 5), ("total", 4), ("text total", 4)])
def test_unknown_totals_end_by_an_empty_page(spark, tmp_path, mode, calls):
    rows = paging.pages(spark, FETCH, [f"{tmp_path}|a|4|{mode}"], SMALL).collect()
    assert ids(rows) == sorted(f"a-{k}-{j}" for k in range(4) for j in range(3)) and [r.page for r in rows] == [0, 1, 2, 3]
    assert asked(tmp_path) == [f"a {k}" for k in range(calls)]


def test_caps_and_tokens(spark, tmp_path):
    rows = paging.pages(spark, FETCH, [f"{tmp_path}|a|9|none"], Paging("content", limit=3, most=7)).collect()
    assert len(rows) == 3 and len(asked(tmp_path)) == 3
    rows = paging.pages(spark, FETCH, [f"{tmp_path}|t|4|none"], Paging("results", limit=3, token="nextPage")).collect()
    assert len(rows) == 4 and asked(tmp_path)[3:] == [f"t {k}" for k in range(4)]


def test_what_fails_costs_its_own_slug_from_there_on(spark, tmp_path):
    slugs = [f"{tmp_path}|{m}|3|{m}" for m in ("raises", "broken", "text", "none")]
    for together in (1, 8):
        rows = paging.pages(spark, FETCH, slugs, SMALL, slugs_per_task=together).collect()
        told = {r.slug.split("|")[1]: (r.page, r.error) for r in rows if r.error}
        assert told == {"raises": (1, "RuntimeError: connection lost"), "broken": (1, "no list in content"), "text": (1, "not JSON")}
        assert len(ids(rows)) == 3 * 3 + 9


def test_a_refusal_ends_a_limited_source(spark, tmp_path):
    slugs = [f"{tmp_path}|a|1|none", f"{tmp_path}|b|1|refused", f"{tmp_path}|c|1|none"]
    rows = paging.pages(spark, FETCH, slugs, SMALL, limited=True, wait=0).collect()
    assert [(r.slug.split("|")[1], r.error) for r in rows] == [("a", None), ("b", "status 429"), ("c", "not asked after a refusal")]
    assert asked(tmp_path) == ["a 0", "a 1", "b 0", "b 0"]
    rows = paging.pages(spark, FETCH, slugs, SMALL, wait=0).collect()
    assert {r.slug.split("|")[1] for r in rows if not r.error} == {"a", "c"}


def test_places(spark):
    two = Paging("content", limit=2, most=4, terms=("x", "y"), short_ends=True)
    page = lambda n: json.dumps({"content": [0] * n})
    assert after(two, Place(), page(2))[0] == Place(0, 2, None, 1)
    assert after(two, Place(0, 2, None, 1), page(2))[0] == Place(1, 0, None, 2)  # the term's cap
    assert after(two, Place(), page(1))[0] == Place(1, 0, None, 1) and after(two, Place(), page(0))[0] == Place(1, 0, None, 1)
    assert after(two, Place(1, 0, None, 2), page(1))[0].done
    for bad in ("", "[]", "null", '"x"', '{"content": null}', "{"):
        place, n, error = after(two, Place(), bad)
        assert place.done and n == 0 and error
    oracle = paging.PAGING["oracle"]
    assert after(oracle, Place(), '{"items": []}')[0].done and after(oracle, Place(), '{"items": [3]}')[2]
    full = {"items": [{"TotalJobsCount": "250", "requisitionList": [0] * 100}]}
    assert after(oracle, Place(), json.dumps(full))[0] == Place(0, 100, None, 1)
    full["items"][0]["TotalJobsCount"] = 100
    assert after(oracle, Place(), json.dumps(full))[0].done
    assert [paging.number(x) for x in (True, None, "7", 7.0, "x", [], float("inf"))] == [None, None, 7, 7, None, None, None]


def crawled(spark, tmp_path, slugs, sink, **more):
    stream = paging.page_stream(spark, FETCH, slugs, SMALL, f"{tmp_path}/places", **more)
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def test_a_stopped_crawl_goes_on_at_its_pages(spark, tmp_path):
    slugs = [f"{tmp_path}|{c}|{n}|none" for c, n in (("a", 5), ("b", 2), ("c", 0))]
    seen = []

    def fails_at(epoch):
        def sink(batch, batch_id):
            rows = [(r.slug.split("|")[1], r.page) for r in batch.collect()]
            if batch_id == epoch:
                raise RuntimeError("lost")
            seen.extend((batch_id, *r) for r in rows)

        return sink

    with pytest.raises(Exception, match="lost"):
        crawled(spark, tmp_path, slugs, fails_at(2))
    assert sorted(seen) == [(0, "a", 0), (0, "b", 0), (1, "a", 1), (1, "b", 1)]
    before = len(asked(tmp_path))
    crawled(spark, tmp_path, slugs, fails_at(-1))
    assert sorted((s, p) for _, s, p in seen) == [("a", k) for k in range(5)] + [("b", k) for k in range(2)]
    # Only the pages of the lost batch are asked for again.
    assert sorted(asked(tmp_path)[before:]) == ["a 2", "a 3", "a 4", "a 5", "b 2"]
    done = len(asked(tmp_path))
    crawled(spark, tmp_path, slugs, fails_at(-1))
    assert len(asked(tmp_path)) == done and len(seen) == 7


def test_a_crawl_equals_the_batch_read(spark, tmp_path):
    slugs = [f"{tmp_path}|{m}|{n}|{m}" for n, m in enumerate(("none", "raises", "text", "total", "wrong", "broken"), start=1)]
    want = sorted((r.slug, r.page, r.payload, r.error) for r in paging.pages(spark, FETCH, slugs, SMALL).collect())
    got = []
    crawled(spark, tmp_path, slugs, lambda batch, _: got.extend(tuple(r) for r in batch.select("slug", "page", "payload", "error").collect()), pages_per_epoch=2, slugs_per_task=2)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_failing_source_costs_its_own_rows(spark):
    good = lambda s: s.range(5).select(F.col("id").cast("string").alias("source_id"), F.lit("good").alias("source"))

    def unplanned(_):
        raise ValueError("no such table\nmore")

    late = lambda s: good(s).withColumn("source_id", F.when(F.col("source_id") == "3", F.raise_error(F.lit("row 3")).cast("string")).otherwise(F.col("source_id")))
    done = landing.landed(spark, {"a": good, "b": unplanned, "c": late, "d": lambda s: good(s).withColumn("source", F.lit("d"))})
    report = {r.source: r for r in done.report.collect()}
    assert {s: (r.source_rank, r.fetched) for s, r in report.items()} == {"a": (0, 5), "b": (1, 0), "c": (2, 0), "d": (3, 5)}
    assert report["b"].error == "ValueError: no such table" and "row 3" in report["c"].error and report["a"].error is None
    assert sorted((r.source, r.source_rank) for r in done.records.collect()) == [("d", 3)] * 5 + [("good", 0)] * 5
    counts = {r.source: (r.x, r.error is None) for r in landing.by_source(done.report, done.records.withColumn("outcome", F.lit("x")), ["x"]).collect()}
    assert counts == {"a": (0, True), "b": (0, False), "c": (0, False), "d": (5, True)}
    assert landing.landed(spark, {"b": unplanned}).records is None


def test_landed_rows_are_few_files(spark):
    from jobweave.plans import queries_reading

    made = spark.createDataFrame([(f"b{k % 5}", f"t{k // 5}", f"page {k}") for k in range(1000)], "slug string, key string, payload string")
    slugs = queries_reading.laid(spark, made, "few")
    path = slugs[0].split("|")[0]
    assert len(spark.read.parquet(path).inputFiles()) <= paging.BUCKETS  # of a thousand
    ask = lambda slug, token: paging.landed_row(slug, paging.Request(None, 0, token, 40))
    assert [ask(s, "t7").payload for s in slugs] == [f"page {35 + k}" for k in range(5)] and ask(slugs[0], "t200").status == 404
