"""Texts of many documents: their shares may meet in one bucket, which isn't two texts of one digest."""

from __future__ import annotations

from spindrift.llm import fim


def test_shares_in_one_bucket_are_joined_once(spark, monkeypatch):
    written, staged = [], fim.staged
    monkeypatch.setattr(fim, "staged", lambda spark, df, label: written.append(label) or staged(spark, df, label))
    df = spark.createDataFrame([(i, "the same words" if i % 4 else f"other words {i}") for i in range(400)], "doc_id long, text string")
    got = fim.transform(df).collect()
    assert written.count("fim") == 1
    assert sorted((r["doc_id"], bytes(r["restored"]).decode()) for r in got) == sorted(map(tuple, df.collect()))
