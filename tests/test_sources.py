"""Readers of JSONL records and snapshots."""

from __future__ import annotations

import pytest

from spindrift.sources import crawl as S


def write(path, lines):
    path.write_text("\n".join(lines))
    return f"file://{path}"


def test_mixed_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", ['{"url":"https://example.com","depth":1}', '"https://example.org"', '{"url":""}', "invalid", "", '{"foo":"bar"}', "[1]", "3", "  "])
    rows = S.read_jsonl(spark, path).orderBy("ordinal").collect()
    assert [r["url"] for r in rows] == ["https://example.com", "https://example.org"]
    assert rows[0]["depth"] == 1.0


def test_missing_file_is_empty(spark, tmp_path):
    assert S.read_jsonl(spark, f"file://{tmp_path}/none.jsonl").count() == 0


def test_check_counts_lines(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", ['{"url":"https://example.com"}', "invalid"])
    r = S.check_jsonl(spark, path).first()
    assert (r["valid"], r["total_lines"], r["valid_urls"], r["bad_lines"]) == (True, 2, 1, 1)


def test_snapshots_round_trip(spark, tmp_path):
    for i in (2, 1):
        S.write_snapshot(spark, f"file://{tmp_path}/snaps", f"s{i}", f"2024-01-0{i}", {"m": float(i)}, {"k": "v"})
    rows = S.read_snapshots(spark, f"file://{tmp_path}/snaps").orderBy("snapshot_id").collect()
    assert [(r["snapshot_id"], r["metrics"]["m"]) for r in rows] == [("s1", 1.0), ("s2", 2.0)]


def test_normalize_file(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", ['{"url":"https://e.com/a#x"}', '{"url":"https://e.com/a"}', '"https://e.com/b"'])
    S.normalize_file(spark, path, f"file://{tmp_path}/out")
    assert [r["records"] for r in spark.read.json(f"file://{tmp_path}/out").orderBy("first_ordinal").collect()] == [2, 1]


def test_tables_are_created_once(spark):
    S.create_tables(spark)
    S.create_tables(spark)
    assert {"urls", "categories"} <= {t.name for t in spark.catalog.listTables()}
    for name in S.TABLES:
        spark.sql(f"DROP TABLE {name}")


def test_jdbc_urls():
    assert S.jdbc_options("postgresql+psycopg2://me:p%40w@db:5432/urls") == {"url": "jdbc:postgresql://db:5432/urls", "user": "me", "password": "p@w"}
    assert S.jdbc_options("jdbc:postgresql://db/urls") == {"url": "jdbc:postgresql://db/urls"}
    assert S.jdbc_options("sqlite:////tmp/a.db") == {"url": "jdbc:sqlite:/tmp/a.db"}
    with pytest.raises(ValueError, match="start with"):
        S.jdbc_options("mysql://db/urls")


def test_ordinals_follow_files_and_lines(spark, tmp_path):
    for name, n in (("b", 3), ("a", 400), ("c", 50)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'"https://{name}.com/{i}"\n' for i in range(n)))
    rows = S.read_jsonl(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(453))
    assert [r["url"] for r in rows] == [f"https://{name}.com/{i}" for name, n in (("a", 400), ("b", 3), ("c", 50)) for i in range(n)]


def test_strict_and_lenient_readers(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"url":"https://a.com","depth":1}\n{broken\n')
    assert [r["url"] for r in S.read_lenient(spark, str(tmp_path)).collect() if r["url"]] == ["https://a.com"]
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_strict(spark, str(tmp_path)).collect()
