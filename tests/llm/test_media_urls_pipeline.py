"""Images, url filters, the registered queries and the pipeline."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lectern.llm import media, queries, urls

SF = "/root/testdata/sf0.001"


def test_images_round_trip():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    colour = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6 7 5\n255\n" + colour.tobytes()) == colour).all()
    assert media.decode(b"P1 # bits\n2 2\n1 0\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P2\n2 1\n15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]


BAD_HEADERS = [
    None, b"P5 99999999999999999999 1 255\n", b"P4 99999999999999999999 1\n", b"P6 3000000000 3000000000 255\n",
    b"P5 " + b"9" * 5000 + b" 1 255\n", b"P2 1 1 255 99999999999999999999", b"P2 1 1 9 10", b"P5 2 1 9\n\x09\x0a", b"P3 1 1 255 1 -2 3",
    b"BM" + bytes(8) + struct.pack("<IIiiHHI", 54, 40, 2**31 - 1, -(2**31), 1, 24, 0) + bytes(40),
    b"BM" + bytes(8) + struct.pack("<IIiiHHIIiiI", 2**32 - 1, 40, 1, 1, 1, 8, 0, 0, 0, 0, 2**32 - 1) + bytes(40),
]


@pytest.mark.parametrize("data", [*BAD_HEADERS, b"", b"P5", b"P5\n2 2\n255\nab", b"BM", b"GIF89a", b"P5 0 1 255\n", b"BM" + bytes(60)])
def test_not_images(data):
    with pytest.raises(media.NotAnImage):
        media.decode(data)


def test_area_resize():
    x = np.arange(36, dtype=np.uint8).reshape(6, 6)
    want = x.reshape(3, 2, 2, 3).mean((1, 3))
    assert (media.resize(x, 3, 2) == np.rint(want)).all()
    for shape in ((5, 7), (7, 5, 3), (1, 1), (40, 3)):
        y = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
        fine = y.repeat(12, 0).repeat(9, 1).astype(float)  # each target covers whole cells of it
        cells = fine.reshape(12, shape[0], 9, shape[1], *shape[2:]).mean((1, 3))
        assert np.abs(media.resize(y, 12, 9) - cells).max() <= 0.5 + 1e-9
    assert (media.resize(np.full((1, 64), 9, np.uint8), 8, 9) == 9).all()
    assert media.difference_hash(np.tile(np.arange(9, dtype=np.uint8), (8, 1))) == "ff" * 8


def test_media_columns(spark):
    texts = [(1, "é" * 100), (2, None), (3, ""), (4, "x" * 200_000), (None, "q"), (3, "")]
    docs = spark.createDataFrame([(i, t, "a", 5) for i, t in texts], "doc_id long, text string, media string, n_bytes int")
    rows = media.digest_table(media.text_images(docs)).collect()
    assert len(rows) == len(texts)
    for (doc, text), r in zip(texts, rows):
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (doc, len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    images = spark.createDataFrame([(media.store(b"abc", "bmp"),), (None,), (b"no",)], "media binary")
    tiles = media.tile_table(images).collect()
    broken = spark.createDataFrame([(1, 5, d) for d in BAD_HEADERS], "doc_id long, n_bytes long, media binary")
    rows = media.digest_table(broken).collect()
    assert len(rows) == len(BAD_HEADERS) and {tuple(r)[:2] for r in rows} == {(1, 5)} and all(set(tuple(r)[2:]) == {None} for r in rows)
    assert media.tile_table(broken).where("feature is not null or tile is not null").isEmpty()
    assert media.digest_table(broken.limit(0)).collect() == [] == media.tile_table(broken.limit(0)).collect()
    assert (tiles[0]["height"], tiles[0]["width"]) == (1, 64) and tiles[1]["tile"] is None and tiles[2]["feature"] is None


def url_truth(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest), *(i for c in "/?#" if (i := rest.find(c)) >= 0)])
    host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls_are_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "xcom", "x.com", "", "org.", ".org", "exämple.org"]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12", "/fr/", "/de/q", "//", "/é/\n"]
    urls_ = [rnd.choice(["http://", "HTTPS://", "", "x"]) + rnd.choice(hosts).upper() + rnd.choice(paths) + rnd.choice(["", "?a=/es/", "#://b"]) for _ in range(400)]
    urls_ += ["http://example.org/es/hot"] * 300 + [None, None, "://", "a://b://c/d"]
    rules = queries.URL_RULES + [("a.example.org", "", "block"), ("example.org", "/e", "allow"), ("org", "/es/x", "block")]
    pages = spark.createDataFrame([(i % 500, u, "key", 1) for i, u in enumerate(urls_)], "page_id long, url string, key string, kind int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), rules[0]], urls.RULES)
    got = sorted(map(str, (tuple(r) for r in urls.judge(pages, table).collect())))
    assert got == sorted(str((i % 500, *url_truth(u, rules))) for i, u in enumerate(urls_))
    assert urls.judge(pages.limit(0), table).collect() == []
    alone = urls.judge(pages, table.limit(0), "block").collect()
    assert len(alone) == len(urls_) and {(r["rule"], r["verdict"]) for r in alone} == {(None, "block")}


def test_all_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in names if q.startswith("op")}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline(spark):
    """Each stage on its own input: what it keeps, and the columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(step(spark, docs, SF))
        assert after.columns == docs.columns, name
        assert after.join(docs, "doc_id", "left_anti").isEmpty(), name
        docs = after
    assert 0 < docs.count() < first.count()
    packed = corpus_pipeline.stage(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b " * 500, None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            table = corpus_pipeline.stage(step(spark, table, SF))
        assert table.count() >= 0
