"""The driver's contract."""

import duckdb

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events documents embeddings pages benchmark labels conversations region nation supplier part".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_names_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_audit_queries_match_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    from lakelens.plans import queries

    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    for name, sql in queries.oracle_sql().items():
        df = __spark_entry__.queries()[name](spark, SF)
        cur = con.execute(sql)
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns), name
        want = sorted(repr([norm(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
        assert sorted(repr([norm(r[c]) for c in sorted(columns)]) for r in df.collect()) == want, name


def test_stream(spark, tmp_path):
    from lakelens.streaming.pages import envelope_stream

    spark.read.parquet(f"{SF}/pages.parquet").write.parquet(str(tmp_path / "in"))
    q = envelope_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("env").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("env").count() == __spark_entry__.queries()["page_check_envelopes"](spark, SF).count()


CUT = ["Tom &amp; Ann&amp", "a &am", "x &quot", "&copy; y &copy", "?a=1&b=2 &amp;copy;", "z &#65 &unknown end&"]


def _cut_pages(spark, folder):
    """Pages with character references that were cut, and the rows that the SQL of a query gives for them."""
    page = '<html lang="en"><head><title>{0}</title></head><body><h1>{0}</h1><a href="/?a=1&copy=2">l</a><article>{1}{0}</article></body></html>'
    rows = [(i, f"https://s.test/{i}", page.format(t, "word " * (60 * (i % 2)))) for i, t in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return lambda name: sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def test_words_of_cut_references_are_those_of_the_sql(spark, tmp_path):
    want = _cut_pages(spark, tmp_path)("main_text_words")
    assert sorted(map(tuple, __spark_entry__.queries()["main_text_words"](spark, str(tmp_path)).collect())) == want and want[0][1] == 7  # Tom Ann amp, twice, and l


def test_headings_of_cut_references_are_those_of_the_sql(spark, tmp_path):
    want = _cut_pages(spark, tmp_path)("heading_rows")
    assert sorted(map(tuple, __spark_entry__.queries()["heading_rows"](spark, str(tmp_path)).select("page_id", "heading", "level").collect())) == want and want[0][1] == "Tom & Ann&amp"


def test_titles_of_cut_references_are_those_of_the_sql(spark, tmp_path):
    want = _cut_pages(spark, tmp_path)("page_title_lang")
    assert sorted(map(tuple, __spark_entry__.queries()["page_title_lang"](spark, str(tmp_path)).collect())) == want and want[0] == (0, "Tom & Ann&amp", "en")
