"""Names and addresses without end, and columns named like the operator's own."""

from pyspark.sql import functions as F

from starlens.llm import pii


def test_names_without_end(spark):
    word = "Abcd "
    texts = [
        "Mr " + word * 1000 + "went",
        "Mrs " + word * 20_000,
        "Dr J. " + "von " * 5_000 + "Berg left",
        "Herr Ab" + "-b" * 10_000,
        "Mr " * 10_000 + "Smith",
        "a@b" + ".c" * 10_000,
        "Mr Jean-Luc O'Brien's and Mr J.R. Smith or Frau Dr. van der Berg",
    ]
    docs = spark.createDataFrame([(i, t, i, i, "r") for i, t in enumerate(texts)], "doc_id long, text string, i long, known long, row string")
    got = pii.replace_entities(docs, "key").select("doc_id", "text", "i", "known", "row", F.expr("transform(entities, e -> e.value)").alias("v"))
    rows = sorted(got.collect())
    assert [(r.i, r.known, r.row) for r in rows] == [(i, i, "r") for i in range(len(texts))]
    assert rows[0].v == ["Mr " + (word * 1000).strip()] and rows[0].text.endswith(" went") and "Abcd" not in rows[0].text
    assert rows[2].v == [texts[2].removesuffix(" left")] and rows[3].v == [texts[3]] and rows[5].v == [texts[5]]
    assert rows[4].v[0].endswith(" Smith") and "Smith" not in rows[4].text
    assert rows[6].v == ["Mr Jean-Luc O'Brien", "Mr J.R. Smith", "Frau Dr. van der Berg"]
