"""A folder of feeds in four dialects, and its odd files."""

import gzip

import pytest

from pricelode.sources import feed_files


def rows(df):
    return sorted((r.source_file.rsplit("/", 1)[-1], r.line_number, r.ean, r.title, r.price) for r in df.collect())


def test_dialects_of_one_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('﻿ean,title,price\n1,"x, y",2\n\n2,"two\nlines","3,5"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('title;ean;more\r\n"a;b";7;z\r\nlast;8;\r\n')
    (tmp_path / "deep" / "c.txt").write_text("ean\ttitle\n9\tshort\n10\n11\tlong\textra\n")
    (tmp_path / "deep" / "d.csv.gz").write_bytes(gzip.compress("ean~title~ean\nold~café~12\n".encode()))
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("ean\n99\n")
    (tmp_path / "bad.csv").write_bytes(b"ean|title\n13|\xff\n")
    want = [
        ("a.csv", 2, "1", "x, y", "2"), ("a.csv", 3, "2", "two\nlines", "3,5"), ("b.csv", 2, "7", "a;b", ""), ("b.csv", 3, "8", "last", ""), ("bad.csv", 2, "13", "�", ""), ("c.txt", 2, "9", "short", ""),
        ("c.txt", 3, "10", "", ""), ("c.txt", 4, "11", "long", ""), ("d.csv.gz", 2, "12", "café", ""),
    ]
    columns = ["ean", "title", "price"]
    assert rows(feed_files.read_folder(spark, str(tmp_path), columns)) == sorted(want)
    assert [x[0] for x in rows(feed_files.read_folder(spark, str(tmp_path), columns, pattern=r"\.txt$"))] == ["c.txt"] * 3
    assert rows(feed_files.read_folder(spark, f"file://{tmp_path}/b.csv", columns)) == want[2:4]
    assert feed_files.read_folder(spark, str(tmp_path / "none"), columns).count() == 0
    with pytest.raises(Exception, match="lacks price"):
        feed_files.read_folder(spark, str(tmp_path), columns, required=["ean", "price"], pattern="^b").collect()
    with pytest.raises(Exception, match="lacks ean"):
        feed_files.read_folder(spark, str(tmp_path), columns, required=["ean"], pattern="^e").collect()


def test_large_cells_and_batches(spark, tmp_path, monkeypatch):
    cell = "word " * 1_200_000
    (tmp_path / "long.csv").write_text(f'ean;title;price\n1;"{cell}";2\n' + "".join(f"{i};t;{i}\n" for i in range(10_000)))
    found = feed_files.read_folder(spark, str(tmp_path), ["ean", "title", "price"])
    assert found.selectExpr("max(length(title))", "max(line_number)", "count(*)", "count(distinct line_number)").first()[:] == (len(cell), 10_002, 10_001, 10_001)


def test_small_files_share_partitions(tmp_path, monkeypatch):
    for i in range(7):
        (tmp_path / f"{i}.csv").write_text("ean\n" + "1\n" * 48)  # 100 bytes
    monkeypatch.setattr(feed_files, "PARTITION_BYTES", 250)
    source = feed_files.FeedFiles({"path": str(tmp_path), "columns": '["ean"]'})
    parts = source.reader(source.schema()).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 2, 1]
    assert feed_files.best_delimiter(['"a,b,c";d', '"e";"f,,,"']) == ";" and feed_files.best_delimiter(["plain"]) == "," and feed_files.best_delimiter([]) == ","
