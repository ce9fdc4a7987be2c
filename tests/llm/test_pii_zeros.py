"""IP addresses with parts of zeros only, against the query's own SQL."""

import duckdb

from strataline.llm import pii

TEXTS = ["ip 10.0000.0.1 up", "0000.000.00.0", "00256.1.1.1", "0001.0255.0.00000", "1.2.3.4", f"1.{'0' * 3000}.2.{'0' * 3000}9"]


def test_parts_of_zeros(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.pii if s.kind == "ip"] for r in pii.find_pii(df).collect()}
    assert got[0] == [(3, 14)] and [len(got[i]) for i in range(len(TEXTS))] == [1, 1, 0, 1, 1, 1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS[:5])))
    want = sorted(con.execute(pii.oracle()).fetchall())
    assert sorted(tuple(r) for r in pii.pii_digest(df.where("doc_id < 5")).collect()) == want
