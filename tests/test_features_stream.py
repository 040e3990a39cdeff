"""Stateful features: many entities share a call, and keep their own state between runs."""

import datetime as dt

from visitframe.streaming import stream as S


def test_entities_of_one_bucket_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 1)
    schema = "entity_id long, visit_date date, visit_id long, score double"
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    path, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    for rows in ([(1, day(0), 1, None), (2, day(5), 2, 40.0), (1, day(400), 3, 10.0)], [(1, day(800), 4, 20.0), (2, day(1), 5, 1.0), (2, day(10), 6, None), (3, day(2), 7, 31.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        arriving = spark.readStream.schema(schema).parquet(path)
        S.run_available(S.features_stream(arriving).writeStream.format("parquet").option("path", out).outputMode("append"), "features", spark, offsets)
    got = {r["visit_id"]: (r["entity_id"], r["visit_no"], r["ever_high"], r["carried"], r["delta_score"], r["late"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (1, 1, None, None, None, False), 2: (2, 1, 1, 40.0, None, False), 3: (1, 2, 0, 10.0, None, False), 4: (1, 3, 0, 20.0, 10.0, False),
                   5: (2, None, None, None, None, True), 6: (2, 2, 1, 40.0, None, False), 7: (3, 1, 1, 31.0, None, False)}
