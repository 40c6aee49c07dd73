import json

from pyspark.sql import functions as F

from veilsight.sources import readers, sinks
from veilsight.streaming.resume import label_stream


def test_clauses_from_json_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    good = {"row_index": 0, "uuid": "u", "field": "persona", "clause": "x y", "label": "PII", "clause_pos": 0}
    path.write_text("\n".join([json.dumps(good), "{broken", "", json.dumps({**good, "label": None}), json.dumps({**good, "clause": " "})]))
    assert readers.clauses(spark, str(path), "json").count() == 1
    assert readers.malformed_lines(spark, str(path)).first().asDict() == {"lines": 4, "malformed": 1}


def test_flat_and_typed_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"], 2)], "terms array<string>, cnt long")
    sinks.csv(df, str(tmp_path / "o"))
    back = readers.csv(spark, str(tmp_path / "o"), "terms_json string, cnt long")
    assert readers.parse_sets(back, "terms_json", "cnt").first().asDict() == {"terms": ["a", "b"], "cnt": 2}
    sinks.parquet(sinks.typed(spark.createDataFrame([("NONE", "7", "q")], "provenance string, size string, extra string")), str(tmp_path / "p"))
    assert dict(spark.read.parquet(str(tmp_path / "p")).dtypes) == {"provenance": "string", "size": "int", "extra": "string"}


def test_records_in_field_order(spark):
    rows = spark.createDataFrame([("u", "persona", "b", 0), ("u", "sports_persona", "a", 0), ("u", "persona", "c", 1), ("u", "other", "z", 0)], "uuid string, field string, clause string, clause_pos int")
    got = readers.records_of(rows, ("sports_persona", "persona")).first()
    assert [x["clause"] for x in got["items"]] == ["a", "b", "c"]


def test_a_stream_labels_each_key_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "id long, clause string")
    rows.coalesce(1).write.mode("append").parquet(src)
    step = lambda df: df.withColumn("label", F.upper("clause"))
    run = lambda: label_stream(spark, src, "id long, clause string", ["id"], step, out, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([(2, "y"), (3, "z")], "id long, clause string").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted((r["id"], r["label"]) for r in spark.read.parquet(out).collect()) == [(1, "X"), (2, "Y"), (3, "Z")]
