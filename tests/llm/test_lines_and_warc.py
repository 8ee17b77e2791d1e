import duckdb
import pytest

from tidelog.llm import line_dedup as L
from tidelog.llm import registry
from tidelog.llm import warc_revisits as V

DOCS = "doc_id long, text string, n_lines string, key int"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    got = sorted(map(tuple, df.collect()), key=repr)
    want = con.sql(registry.ORACLE_SQL[name]).df()[df.columns].astype(object)
    want = want.where(want.notna(), None)
    assert got == sorted(want.itertuples(index=False, name=None), key=repr)


def test_line_edges(spark):
    block = "\n".join(f"a repeated line {i}" for i in range(12))
    rows = [(1, block), (2, "own start\n" + block + "\nown end"), (3, block), (3, block), (4, None), (5, ""), (6, "\n\n"), (7, "one line"), (8, "one line"), (None, block), (9, "x\n" * 5000)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], DOCS)
    got = L.dedup_lines(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "key", "n_lines", "removed_lines"}
    by = {r.doc_id: r for r in got}
    assert by[1].text == block and by[1].removed_lines == 0
    assert by[2].text.startswith("own start") and "own end" in by[2].text and by[2].removed_lines >= 4
    assert [r.removed_lines for r in got if r.doc_id == 3][0] == [r.removed_lines for r in got if r.doc_id == 3][1] > 6
    assert by[4].text is None and by[5].text == "" and by[7].text == by[8].text == "one line"
    assert by[None].removed_lines > 6
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


RECORDS = "record_id long, warc_type string, target_uri string, t long, header_block string, url int, state string"


def resolve(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], RECORDS).selectExpr("*", "timestamp_seconds(t) AS warc_date")
    return {r.record_id: r for r in V.resolve_revisits(df).collect()}


def test_revisits(spark):
    ok = 'HTTP/1.1 200 OK\r\nETag: "1"\r\nContent-Type: text/html\r\nX-A: 1\r\nX-A: 2\r\nlast-modified: m'
    rows = [
        (1, "response", "http://WWW.A.com:80/x/?b=2&a=1&utm_q=3#f", 10, ok),
        (2, "response", "https://a.com/x?a=1&b=2", 500_000, ok.replace('"1"', '"2"')),
        (3, "revisit", "https://a.com/x/?a=1&b=2", 400_000, 'HTTP/1.1 304\r\nETag: W/"1"\r\nContent-Type: evil\r\nx-a: 3\r\nConnection: close'),
        (4, "revisit", "http://a.com/x?b=2&a=1", 600_000, 'HTTP/1.1 304\r\nETag: "1"'),
        (5, "revisit", "http://a.com/x?b=2&a=1", 600_000, "HTTP/1.1 304\r\nLast-Modified: m"),
        (6, "revisit", "http://a.com/x?b=2&a=1", 600_000, "HTTP/1.1 304"),
        (7, "revisit", "http://a.com/x?b=2&a=1", 10, "HTTP/1.1 304"),
        (0, "revisit", "http://a.com/x?b=2&a=1", 10, "HTTP/1.1 304"),
        (8, "revisit", None, 99, None),
        (9, "revisit", "http://a.com/y", None, ""),
        (10, "response", "http://a.com/y", 5, "HTTP/1.1 404 Not Found"),
        (11, "revisit", "http://a.com/y", 6, "HTTP/1.1 304"),
        (12, None, "http://a.com/y", 6, "HTTP/1.1 304"),
    ]
    got = resolve(spark, rows)
    assert set(got) == {0, 3, 4, 5, 6, 7, 8, 9, 11}
    assert (got[3].state, got[3].response_id) == ("resolved", 1)
    assert got[3].headers == 'Content-Type: text/html\nETag: W/"1"\nlast-modified: m\nx-a: 3'
    assert (got[4].state, got[4].response_id) == ("mismatch", 2)
    assert got[5].state == "resolved" and got[6].state == "no_validator"
    assert (got[7].state, got[7].response_id) == ("no_validator", 1)
    assert all(got[i].state == "no_response" for i in (0, 8, 9, 11))
    assert resolve(spark, []) == {}


def test_repeated_revisits(spark):
    rows = [(1, "response", "http://a/", 1, "HTTP/1.0 200 OK\nETag: x")] + [(2, "revisit", "http://a/", 2, "HTTP/1.0 304\nETag: x")] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], RECORDS).selectExpr("*", "timestamp_seconds(t) AS warc_date")
    assert [r.state for r in V.resolve_revisits(df).collect()] == ["resolved"] * 2
