"""Words are cut at every ASCII white space byte, in Spark and in the SQL alike."""

from __future__ import annotations

import duckdb

from loomtab.llm.substring_dedup import _SQL, substring_dedup


def test_substring_sql_cuts_words_where_spark_does(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [sep.join(words) for sep in (" ", "\t", "\n", "\x0b", "\x0c", "\r", "\r\n", "\x1f", " ")]
    rows = list(enumerate([*texts, "a\x0bb\x0cc\rd", None, ""]))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({_SQL})").fetchall())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert [r[1] for r in got[:9]] == [30] * 7 + [1, 1] and [r[2] for r in got[1:7]] == [30] * 6
