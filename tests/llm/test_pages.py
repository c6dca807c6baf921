"""Archives, URL lists, and the pipeline."""

import gzip
from datetime import date
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from quillspark.llm import decontam, gam, mixing, sharding, urls, warc
from quillspark.llm.common import shared_dir

from .helpers import brute_components

PAGES = [(3, "http://a/1", "x" * 100), (1, "http://a/2", "x" * 100), (2, "http://b\r\n/x", "small"), (5, None, "small"), (4, "http://c", None), (6, "http://d", ""), (None, "http://e", "x" * 100), (7, "http://f", "é" * 50), (8, "http://g", "é" * 50), (9, "http://h", "\r\n\r\nbody\r\n" * 20), (9, "http://h", "\r\n\r\nbody\r\n" * 20)]
SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    out = warc.archive_round_trip(spark.createDataFrame(PAGES, SCHEMA).repartition(3)).toPandas()
    assert len(out) == len(PAGES) and out.intact.all()
    by = {i: (n, t, r) for i, n, t, r in zip(out.page_id, out.payload_bytes, out.record_type, out.refers_to) if i == i}
    assert by[3] == (100, "revisit", 1) and by[1][:2] == (100, "response") and by[8][1:] == ("revisit", 7)
    assert by[2][1] == by[5][1] == by[4][1] == by[6][1] == "response" and by[4][0] == 0
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_plain_gzip_members_and_ranges_select(spark):
    where = shared_dir(spark, "t")
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * (i * 10)) for i in range(1, 60)], SCHEMA)
    index = warc.write_archives(pages, where)
    files = sorted(Path(where.removeprefix("file://")).glob("*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == 59 and not list(Path(where.removeprefix("file://")).glob(".*.gz"))
    some = warc.read_records(index.where("page_id % 7 = 0"), where).toPandas()
    assert {i: h for i, h in zip(some.page_id, some.html)} == {i: f"<p>{i}</p>" * (i * 10) for i in range(7, 60, 7)}


def test_intervals_and_hosts(spark):
    day = lambda m, d=1: date(2024, m, d)
    entries = [("Bad.com.", "add", day(2)), ("bad.com", "remove", day(4)), ("bad.com", "add", day(6)), ("x.bad.com", "add", day(1)), ("x.bad.com", "add", day(3)), ("ok.com", "remove", day(1)), (None, "add", day(1)), ("n.com", None, day(1)), ("same.com", "add", day(1)), ("same.com", "remove", day(1))]
    captures = [("http://BAD.com/p", day(1)), ("http://bad.com./p", day(2)), ("https://u:p@www.bad.com:80/", day(3)), ("http://bad.com", day(4)), ("http://bad.com?q=1", day(7)), ("http://x.bad.com/", day(5)), ("http://notbad.com/", day(7)), (None, day(7)), ("mailto:a@bad.com", day(7)), ("http://bad.com", None), ("http://ok.com", day(9)), ("http://same.com", day(1))]
    df = spark.createDataFrame([(i, u, t, "clash") for i, (u, t) in enumerate(captures)], "id int, url string, fetched date, entry string")
    out = urls.judge(df, spark.createDataFrame(entries, "domain string, action string, dated date")).toPandas().set_index("id").sort_index()
    assert out.entry.tolist() == [None, "bad.com", "bad.com", None, "bad.com", "x.bad.com", None, None, None, None, None, "same.com"]
    assert out.blocked.tolist() == [e is not None for e in out.entry]
    assert urls.judge(df.where("false"), spark.createDataFrame(entries, "domain string, action string, dated date")).count() == 0
    assert not urls.judge(df, spark.createDataFrame([], "domain string, action string, dated date")).where("blocked").count()


def test_pipeline_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns, name
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = gam.score(docs, gam.train(docs, labels)).where("score >= 0.3")
    assert ids[1] == {r[0] for r in good.select("doc_id").collect()}
    groups = brute_components([(r[0], r[1]) for r in seen[1].select("doc_id", "text").collect()], k=5)
    assert ids[2] == set(groups.values())
    bad = decontam.decontaminate(seen[2], spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0")
    assert ids[3] == ids[2] - {r[0] for r in bad.select("doc_id").collect()}
    assert ids[4] == {r[0] for r in mixing.mixed_documents(seen[3]).where("kept").collect()}
    assert ids[5] == ids[4] and set(seen[5].columns) >= set(sharding.shard_documents(docs).columns)
    assert corpus_pipeline.run(spark, sf).agg(F.count("doc_id")).first()[0] == len(ids[5])
