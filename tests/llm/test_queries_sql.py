"""The registered queries against their SQL on the small tables, and on a table of odd rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.llm import queries

SF = "/root/testdata/sf0.001"


def tables(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order]) for r in found)


def agree(spark, name, folder):
    con = tables(folder).execute(queries.ORACLES[name])
    want = rows([d[0] for d in con.description], con.fetchall())
    df = queries.QUERIES[name](spark, folder)
    assert rows(df.columns, map(tuple, df.collect())) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    agree(spark, name, SF)


def test_odd_conversations(spark, tmp_path):
    said = ["</s>[INST] ok [/INST]", "\\", "a\\</s>\\\\[ANS]", "[SAY] [END]", "", None, "ü\n𝄞", "long " * 30000]
    found = [(k % 3 if k % 5 else None, k // 4, ["user", "assistant", "system", None, "[SAY]"][k % 5], said[k % 8]) for k in range(60)]
    spark.createDataFrame(found + found[:6], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    agree(spark, "op2_chat_format", str(tmp_path))


def test_odd_pages(spark, tmp_path):
    links = ['<a href="//bad.com/en/1">', "<A class=x HREF='HTTP://Friend.INFO/x'><a href=/en/2>", "", None, "<a href=http://good.net/de/>"]
    urls = ["http://A.Example.COM/en/7x?q", "https://bad.com/en/1", "http://a.example.net/de/8", "http://good.net/de/1#f", None, "no scheme", "ftp://h.org?x/es/", "http://friend.info/", "http://x.friend.info"]
    found = [(k, urls[k % 9], links[(k // 9) % 5], 1) for k in range(90)]
    spark.createDataFrame(found + found[:3], "page_id long, url string, html string, host int").write.parquet(f"{tmp_path}/pages.parquet")
    agree(spark, "op8_url_filter", str(tmp_path))


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries() and set(queries.ORACLES) <= set(entry.oracle_sql())
