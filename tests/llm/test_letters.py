"""Letters are counted as plain Python counts them, each in what the ones before it have left."""

from scholium.llm import mixing


def test_counts_of_letters_of_one_to_four_bytes(spark):
    texts = ["The éé über 函数 😀a", None, "", "aaa bbb", "ñandú ß ÄÖ 数数", "x" * 5000 + "é" * 300]
    letters = "aeé数😀xß"
    rows = mixing.profile(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang"), "lang", letters).collect()
    assert {r["doc_id"]: list(r["counts"]) for r in rows} == {i: [(t or "").lower().count(c) for c in letters] for i, t in enumerate(texts)}
    # a text is read once: 32 letters don't name the source column 32 times
    plan = mixing.profile(spark.range(1).selectExpr("id AS doc_id", "string(id) AS text", "'en' AS lang"), "lang", "abcdefghijklmnopqrstuvwxyzäöüßéñ").select("counts")
    assert str(plan._jdf.queryExecution().analyzed()).count("replace(") < 3
