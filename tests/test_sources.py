import json
import random

import pytest

from lectern.sources.corpus import read_books, read_passages, write_passages
from lectern.sources.export import write_lines
from lectern.sources.links import link_of, queries_from_links


def test_passages_from_several_files(spark, tmp_path):
    first = [[1, 1, 1, "In, \"quoted\" ],[ text", "神"], [1, 1, 2, "", None]]
    second = [[1, 2, 1, "<é>", ""], [43, 1, 1, "last\nline", "约"]]
    (tmp_path / "a.json").write_text(json.dumps(first), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(second, ensure_ascii=False), encoding="utf-8")
    rows = read_passages(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [
        (0, 1, 1, 1, "In, \"quoted\" ],[ text", "神"),
        (1, 1, 1, 2, None, None),
        (2, 1, 2, 1, "<é>", None),
        (3, 43, 1, 1, "last\nline", "约"),
    ]
    out = str(tmp_path / "table")
    write_passages(read_passages(spark, str(tmp_path / "*.json")), out)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [tuple(r) for r in rows]


def test_books_keep_file_order(spark, tmp_path):
    books = [
        {"idx": 2, "id": "B", "en": "Bee", "cn": "蜂", "chapters": [3, 4], "enAlias": ["b"], "cnAlias": []},
        {"idx": 1, "id": "A", "en": "Ant", "cn": None, "chapters": [], "enAlias": [], "cnAlias": ["蚁"]},
    ]
    path = tmp_path / "books.json"
    path.write_text(json.dumps(books), encoding="utf-8")
    rows = read_books(spark, str(path)).orderBy("book_pos").collect()
    assert [(r.book_pos, r.idx, r.en, r.cn, r.chapters, r.enAlias, r.cnAlias) for r in rows] == [
        (0, 2, "Bee", "蜂", [3, 4], ["b"], []), (1, 1, "Ant", None, [], [], ["蚁"]),
    ]


def test_export_is_written_in_order(spark, tmp_path):
    lines = spark.range(500, 0, -1).selectExpr("id as row_idx", "concat('line ', id) as line")
    out = tmp_path / "out"
    write_lines(lines, str(out))
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert text == "".join(f"line {i}\n" for i in range(1, 501))


def test_links(spark):
    urls = [
        "https://x.org/#q=John%201%3A1", "https://x.org/p?q=no#v=2&q=John%201%3A1", "#q=a+b",
        "https://x.org/#q=%E7%BA%A6%201", "https://x.org/#q=", "https://x.org/#top", "https://x.org/",
        "https://x.org/#q=%ZZ", "https://x.org/#xq=1", "#q=a#b", None,
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.q: r.n for r in queries_from_links(df).collect()}
    assert got == {"John 1:1": 2, "a+b": 1, "约 1": 1, "a#b": 1}


def test_link_and_back(spark):
    texts = ["John 1:1", "a+b & c", "!'()~*", "约 1", "100%"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(link_of("t").alias("url"))
    hashed = df.selectExpr("concat('#', url) as url")
    assert sorted(r.q for r in queries_from_links(hashed).collect()) == sorted(texts)
    assert df.first().url == "q=John%201%3A1"


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_one_file_is_cut_into_byte_ranges(spark, tmp_path, size):
    """Brackets, quotes and backslashes in texts, at any place of a range's border."""
    rnd = random.Random(size)
    odd = ["]", "[", "],[", '"', '\\"', "\\", "\\\\]", '"]', "\n", "神", " ", "a", ",", "]]", "é"]
    rows = [[rnd.randint(1, 66), i % 9, i, "".join(rnd.choices(odd, k=rnd.randint(0, 9))), rnd.choice([None, "", "]神["])] for i in range(400)]
    for k, text in enumerate((json.dumps(rows), json.dumps(rows, ensure_ascii=False, indent=1) + "\n", json.dumps(rows, separators=(",", ":")))):
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
        keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
        for key, value in zip(keys, (str(size), "1", "1")):
            spark.conf.set(key, value)
        try:
            pieces = spark.read.text(str(tmp_path / f"{k}.json"), lineSep="]")
            assert size > 1000 or pieces.rdd.getNumPartitions() >= len(text) // (2 * size)
            got = read_passages(spark, str(tmp_path / f"{k}.json")).orderBy("row_idx").collect()
        finally:
            for key in keys:
                spark.conf.unset(key)
        assert [tuple(r) for r in got] == [(i, *r[:3], r[3] or None, r[4] or None) for i, r in enumerate(rows)]


def test_arrays_that_are_empty_or_broken(spark, tmp_path):
    for text in ("[]", " [ ] \n"):
        (tmp_path / "x.json").write_text(text)
        assert read_passages(spark, str(tmp_path / "x.json")).collect() == []
    record = '[1,1,1,"a","b"]'
    for text in ("{}", record, f"[{record}", f"[{record}\n", f"[{record},", f"[{record},[1,2", f"[{record} {record}]", f'[{record},[1,1,1,"a]]', f"x[{record}]", f"[{record}]]"):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            read_passages(spark, str(tmp_path / "x.json")).collect()
