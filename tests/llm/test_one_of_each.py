"""One row of each group stays, of rows without an id and of rows that repeat one too."""

from strataline.llm import simhash


def test_ids_that_are_null_or_repeat(spark):
    other = "one two three four five six seven eight nine ten"
    rows = [(None, "alone and without any id at all"), (None, other), (7, other), (7, other), (7, "the same id with another text of its own"), (3, "x y z"), (None, "x y z"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.one_of_each(df)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == ["doc_id", "text"] and len(got) == 5
    assert {(None, rows[0][1]), (7, other), rows[4], (3, "x y z")} < set(got)
    nulls = spark.createDataFrame([(None, f"text number {i // 2}") for i in range(20)], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(nulls).collect()) == sorted(f"text number {i}" for i in range(10))
    assert simhash.one_of_each(df.where("false")).count() == 0
