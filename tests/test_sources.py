import pytest
"""Sources and scalar edge cases (FIXTURES part C)."""

import json

from pyspark.sql import functions as F

from marketpulse.functions import scalars as sc
from marketpulse.sources import files
from marketpulse.sources.sinks import write_csv
from marketpulse.plans.scrape import extract_triples


def test_csv_text_round_trip_and_null_tokens(spark, tmp_dir):
    rows = [("1700000000", "2024-01-01 08:00:00", 'Hello, "world"', "line1\nline2, more", "N/A", "a|b"),
            ("1700000001", "bad time", "T2", "B2", "u", "k"),
            ("1700000002", "2024-01-01 09:00:00", "T3", "", "u", "k"),
            ("1700000003", "2024-01-01 10:00:00", "  T4  ", "B4", "", "NULL")]
    df = spark.createDataFrame(rows, "Timestamp string, `Published Time` string, Title string, "
                                     "Body string, URL string, Keywords string")
    write_csv(df, f"{tmp_dir}/news")
    out = {r.title: r for r in files.read_news(spark, f"{tmp_dir}/news").collect()}
    assert set(out) == {'Hello, "world"', "  T4  "}
    r = out['Hello, "world"']
    assert r.body == "line1\nline2, more" and r.url is None and r.keywords == "a|b"
    assert out["  T4  "].url is None and out["  T4  "].keywords is None


def test_article_keywords_variants(spark):
    data = {"Data": [
        {"PUBLISHED_ON": 0, "TITLE": "a", "BODY": "b", "URL": "u", "KEYWORDS": "x,y"},
        {"PUBLISHED_ON": 0, "TITLE": "a", "BODY": "b", "URL": "u"},
        {"PUBLISHED_ON": 0, "TITLE": "a", "BODY": "b", "URL": "u", "KEYWORDS": None},
        {"PUBLISHED_ON": 0, "TITLE": "a", "BODY": "b", "URL": "u", "KEYWORDS": 7}]}
    df = spark.createDataFrame([(json.dumps(data),)], "j string")
    out = files.decode_articles(df, "j").collect()
    assert [r.keywords for r in out] == ["x|y", "N/A", "N/A", "N/A"]
    assert out[0].published_time == "1970-01-01 08:00:00"


def test_candles_and_listings(spark):
    k = json.dumps([[1704067200000, "1", "2", "0.5", "1.5", "10", 0], [1704153600000, "2", "3", "1", "2", "0"]])
    out = files.decode_candles(spark.createDataFrame([(k,)], "j string"), "j").collect()
    assert [(r.Date, r.Close) for r in out] == [("2024-01-01", "1.5"), ("2024-01-02", "2")]
    lj = json.dumps({"data": [{"symbol": "BTC"}, {"symbol": "USDT"}, {"symbol": "ETH"}]})
    got = files.decode_listings(spark.createDataFrame([(lj,)], "j string"), "j").collect()
    assert [(r.pos, r.symbol) for r in got] == [(0, "BTC"), (1, "USDT"), (2, "ETH")]


def test_short_date_pattern(spark):
    df = spark.createDataFrame([(x,) for x in ["3/2/24", "03/02/24", "13/2/24", "3/32/24", "3/2/2024"]], "d string")
    assert [r.m for r in df.select(sc.is_short_date("d").alias("m")).collect()] == [True, True, False, False, False]


def test_word_count_matches_python_split(spark):
    texts = ["", "one", " two  words ", "tab\tsep\nnl", "nb sp", "ideo　space", "x\x1cy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(sc.word_count("t").alias("n")).collect()]
    assert got == [len(t.split()) for t in texts]
    stripped = [r.s for r in df.select(sc.strip("t").alias("s")).collect()]
    assert stripped == [t.strip() for t in texts]


HTML = """<html><body>
<div class="Text"><span><div>Alice</div></span></div>
<div class="Text"><div> 3/2/24 </div></div>
<div class="Text"><div>First title<p>unclosed</div></div>
<div class="Text">no inner div</div>
<div class="Text"><div>Bob</div></div>
<div class="Text"><div>12/31/23</div></div>
<div class="Text"><div>First title<p>unclosed</div></div>
<div class="Text Big"><div>Carol</div><div>ignored second div</div></div>
<div class="Text"><div>1/1/24</div></div>
<div class="Text"><div>Another</div></div>
</body></html>"""


def test_html_extraction_and_triples(spark):
    pages = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    texts = [r.text for r in files.extract_texts(pages).orderBy("pos").collect()]
    assert texts == ["Alice", "3/2/24", "First titleunclosed", "Bob", "12/31/23",
                     "First titleunclosed", "Carol", "1/1/24", "Another"]
    tr = extract_triples(pages).orderBy("pos").collect()
    assert [(r.Youtuber, r.Date, r.Title) for r in tr] == [
        ("Alice", "3/2/24", "First titleunclosed"), ("Carol", "1/1/24", "Another")]


def test_html_text_rules(spark):
    html = ("<div class=Text><div> a &lt; b < c<script>var q=1;</script> &amp; <!-- no -->d</div></div>"
            "<div class='Text'><style>.x{}</style><div>a < b</div></div>")
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [r.text for r in files.extract_texts(pages).orderBy("pos").collect()] == ["a < b < c&d", "a < b"]


def test_decoders_keep_the_other_columns(spark):
    bodies = spark.createDataFrame([("BTC", '[[0,"1","2","0.5","1.5","9"]]'), ("ETH", '[[86400000,"3","4","2","3.5","8"]]')], "symbol string, json string")
    got = sorted((r.symbol, r.Date, r.Open, r.Close) for r in files.decode_candles(bodies, "json").collect())
    assert got == [("BTC", "1970-01-01", "1", "1.5"), ("ETH", "1970-01-02", "3", "3.5")]
    lists = spark.createDataFrame([(7, '{"data":[{"symbol":"A"},{"symbol":"B"}]}'), (8, '{"data":[{"symbol":"C"}]}')], "page int, json string")
    assert sorted(map(tuple, files.decode_listings(lists, "json").collect())) == [(7, 0, "A"), (7, 1, "B"), (8, 0, "C")]


def test_strict_scan_order_is_the_files_own(spark, tmp_dir):
    import os
    from marketpulse.operators import tables as tb
    os.makedirs(f"{tmp_dir}/n")
    head = "Timestamp,Published Time,Title,Body,URL,Keywords\n"
    for k, size in ((0, 1), (1, 4000)):  # the larger file is scanned first
        with open(f"{tmp_dir}/n/part-{k}.csv", "w") as f:
            f.write(head + "".join(f"{100 * k + i},2024-01-01 00:00:00,t,{'x' * 200}{k}-{i},u,k\n" for i in range(size)))
    first = tb.first_per_key(files.read_news_strict(spark, f"{tmp_dir}/n"), ["title"], files.FILE_ORDER).collect()
    assert [r.body[200:] for r in first] == ["0-0"]


def test_read_prices_header_only_and_missing(spark, tmp_dir):
    import os
    d = f"{tmp_dir}/price"
    os.makedirs(d)
    with open(f"{d}/BTCUSDT_historical_prices.csv", "w") as f:
        f.write("Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,10\n2024-01-02,1,2,0.5,1.7,0\n")
    with open(f"{d}/LEOUSDT_historical_prices.csv", "w") as f:
        f.write("Date,Open,High,Low,Close,Volume\n")
    p = files.read_prices(spark, d, ["BTC", "LEO", "ETH"])
    assert sorted((r.symbol, r.Close) for r in p.collect()) == [("BTC", 1.5), ("BTC", 1.7)]
    assert {r.symbol for r in files.missing_symbols(spark, d, ["BTC", "LEO", "ETH"]).collect()} == {"ETH"}  # LEO has a file


def test_first_record_of_the_file_wins_whatever_its_time(spark, tmp_dir):
    """Newest first, equal times, quoted line breaks: the place in the file counts."""
    from marketpulse.operators import tables as tb
    from marketpulse.plans import news as newsplan
    with open(f"{tmp_dir}/n.csv", "w") as f:
        f.write("Timestamp,Published Time,Title,Body,URL,Keywords\n"
                '9,2024-01-09 00:00:00,t,"first\n""body""",u1,k\n5,2024-01-05 00:00:00,t,second,u2,k\n'
                "5,2024-01-05 00:00:00,s,a,u3,k\n5,2024-01-05 00:00:00,s,b,u4,k\n7,2024-01-07 00:00:00,s,a,u5,k\n")
    strict = tb.first_per_key(files.read_news_strict(spark, f"{tmp_dir}/n.csv"), ["title"], files.FILE_ORDER).collect()
    assert {r.title: r.body for r in strict} == {"t": 'first\n"body"', "s": "a"}
    newsplan.run_news(f"{tmp_dir}/news", files.read_news(spark, f"{tmp_dir}/n.csv"))
    got = {(r.title, r.body): (r.published_at.day, r.url) for r in newsplan.read_news_table(spark, f"{tmp_dir}/news").collect()}
    assert got[("s", "a")] == (5, "u5")                    # the first row's time, the last row's url


def test_json_list_or_falls_back(spark):
    from marketpulse.functions.scalars import json_list_or
    rows = [(1, '["ETH", "SOL"]'), (2, ' ["XRP"] '), (3, "not json"), (4, '{"coins": ["ETH"]}'),
            (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "k int, answer string")
    got = {r.k: r.coins for r in df.select("k", json_list_or("answer").alias("coins")).collect()}
    assert got == {1: ["ETH", "SOL"], 2: ["XRP"], 3: ["BTC"], 4: ["BTC"], 5: ["BTC"], 6: ["BTC"]}


def test_create_tables_once(spark, tmp_dir):
    from marketpulse import schemas
    from marketpulse.sources import sinks
    made = sinks.create_tables(spark, f"{tmp_dir}/db", "mp_once")
    assert set(made) == set(schemas.TABLES)
    for name, path in made.items():
        t = sinks.read_table(spark, path, schemas.TABLES[name])
        assert t.count() == 0
        assert sorted(t.columns) == sorted(f.name for f in schemas.TABLES[name].fields)
    sessions = spark.createDataFrame([("s", None, "t")], schemas.CHAT_SESSIONS)
    sessions.write.mode("append").parquet(made["chat_sessions"])
    sinks.create_tables(spark, f"{tmp_dir}/db", "mp_once")          # existing tables are kept
    assert sinks.refresh_table(spark, "chat_sessions", "mp_once").count() == 1
    with pytest.raises(ValueError, match="stored at"):
        sinks.create_tables(spark, f"{tmp_dir}/other", "mp_once")
    assert sinks.read_table(spark, made["chat_sessions"], schemas.CHAT_SESSIONS).count() == 1


def test_rebuild_vectors_every_row(spark):
    from marketpulse.functions.scalars import content_key
    from marketpulse.operators import enrich
    from marketpulse.plans import news as newsplan
    from marketpulse.sources import adapters as ad
    from tests.conftest import SMALL
    n = ad.news_v(spark, SMALL).select("title", "body", "published_at")
    enc = enrich.fit_embedder(n.select(F.concat_ws("\n", "title", "body").alias("t")), "t", 64)
    v = newsplan.rebuild_vectors(n, enc).cache()
    assert v.count() == n.count()                          # no title dedup in S11
    assert v.where(F.size("embedding") != 64).count() == 0
    keys = n.select(content_key("title", "body").alias("id"))
    assert v.select("id").exceptAll(keys).count() == 0


def test_catalog_table_prunes_partitions(spark, tmp_dir):
    from marketpulse.plans import market
    from marketpulse.sources import sinks
    from marketpulse.sources.adapters import prices_v
    from tests.conftest import SMALL
    made = sinks.create_tables(spark, f"{tmp_dir}/db", "mp_prune")
    n = market.run_prices(made["crypto_prices"], prices_v(spark, SMALL), ["Close"])
    t = sinks.refresh_table(spark, "crypto_prices", "mp_prune")
    symbols = [r[0] for r in spark.sql("SHOW PARTITIONS mp_prune.crypto_prices").collect()]
    assert t.count() == n and len(symbols) == 5
    one = t.where("symbol = '5-LOW'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" in plan and "5-LOW)], PushedFilters" in plan     # the filter is one on partitions
    assert 0 < len(one.inputFiles()) < len(t.inputFiles())


def test_required_columns_are_checked(spark):
    from marketpulse.operators import quality as q
    df = spark.createDataFrame([("t", "b")], "Title string, Body string")
    assert q.require_columns(df, ["Title", "Body"]) is df
    with pytest.raises(ValueError, match="Body"):
        q.require_columns(df.drop("Body"), ["Title", "Body"])
    with pytest.raises(ValueError, match="Title"):
        q.require_columns(df.toDF("title", "Body"), ["Title", "Body"])   # names are taken as written
