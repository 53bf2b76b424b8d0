"""Registered queries against their SQL over made-up documents, where a line's text meets the edges of a rule."""

import duckdb
import pytest
from pyspark.sql import functions as F

from clausewise.adapt import Tables
from clausewise.plans import registry


def lines_of(doc_id):
    """Lines that begin or end with the digits of their own place, repeat each other, and stand between spaces of all kinds."""
    out = [f"{k} {chr(97 + k) * 8} {doc_id} {k}" for k in range(20)]
    out[3] = out[14] = "repeated 3"
    out[5], out[7], out[9] = " 　 wide spaces ", "　", "\ttab\t"
    return out


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, "\n".join(lines_of(k)), "en", "web", 1) for k in range(1, 10)] + [(10, "", "en", "web", 0), (11, "11\n1\n2", "de", "web", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, con


def test_lines_keep_the_digits_of_their_place(spark, odd):
    got = [r.text for r in Tables(spark, odd[0]).lines().where("doc_id = 1").orderBy("ordinal").collect()]
    want = [line.strip(" 　   ") for line in lines_of(1)]
    assert got == [line for line in want if line]


@pytest.mark.parametrize("name", ["C4_content_hash", "C5_version_upsert", "D11_diff_listing", "E35_section_lines", "G3_headers", "G4_rendered_blocks"])
def test_query_matches_sql_on_odd_lines(spark, odd, name):
    folder, con = odd
    plan, sql = registry()[name]
    df, got = plan(Tables(spark, folder)), con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*map(F.col, columns)).collect()))) == sorted(map(repr, got.fetchall()))
