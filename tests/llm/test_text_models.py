"""Toxicity, quality, BPE, packing, token counts: against the public tokenizers, and held-out rows."""

import random
import zlib

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from lectern.llm import bpe, packing, quality, toxicity, unigram
from lectern.llm.common import BLOCK_ROWS, fold, slices, text_bytes

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aAbB'sStT rRe  \n\t\x1c\x1f\x85\xa0　éÉΣς ßİıſ²٣12#!?.,😀中文​ẞǅ▁"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, ids int"


def odd_texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    special = ["", " ", "<|endoftext|>a<|startoftext|>", "<|x|>", "It's we'll I'M", "#" * 4000, "a" * 1500 + " " + "xyzth" * 300]
    return made + special + ["<s> <0x0A> </s>", "a b  c   d", "\n\n a\n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, extra columns of clashing names."""
    rows = [(1, "You idiot. " * 3000, "en", "s", 1, "x", 1), (2, None, None, None, None, None, None)]
    rows += [(3, "", "en", "s", 0, "y", 2), (None, "null id", "de", "s", 7, "z", 3), (3, "", "en", "s", 0, "y", 2)]
    return spark.createDataFrame(rows, DOCS)


def test_bpe_is_the_library():
    own, library = bpe.Encoder(BPE), Tokenizer.from_file(BPE)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text[:80]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own, fresh = bpe.Encoder(BPE), bpe.Encoder(BPE)
    text = "one two three, four five. one"
    assert own.encode(text) == [i for w in text.split() for i in fresh.encode(w)] and len(own) <= 4


def test_bpe_tables(odd):
    rows = bpe.encode_table(odd, BPE).collect()
    assert sorted(len(r["ids"]) for r in rows)[:3] == [0, 0, 0]
    assert {r["n_tokens"] for r in bpe.digest_table(odd, BPE).collect()} == {len(r["ids"]) for r in rows}
    assert bpe.digest_table(odd.limit(0), BPE).collect() == []


def test_token_counts_are_the_library(odd):
    pieces = unigram.read_pieces(PIECES)
    own, library = unigram.Counter(pieces), Tokenizer(models.Unigram(pieces, 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    for text in odd_texts():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]
    assert [r["n_tokens"] for r in unigram.count_table(odd, PIECES).where("doc_id = 2 or doc_id = 3").collect()] == [0] * 3


@pytest.mark.parametrize("crossing, fractions", [(True, False), (False, True), (True, True)])
def test_token_counts_of_any_model(crossing, fractions, monkeypatch):
    """Pieces that cross words and scores with fractions, as the library cuts them; few places held."""
    rnd = random.Random(8)
    made = {"".join(rnd.choice("ab▁\n" if crossing else "ab") for _ in range(rnd.randint(1, 5))) for _ in range(120)}
    score = (lambda: -rnd.uniform(1, 9)) if fractions else (lambda: -float(rnd.randint(1, 9)))
    pieces = [("<unk>", score())] + [(f"<0x{b:02X}>", score()) for b in range(256)] + [(p, score()) for p in sorted(made)]
    own, library = unigram.Counter(pieces), Tokenizer(models.Unigram(pieces, 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    monkeypatch.setattr(unigram, "HELD", 8)
    assert own.whole
    for n in [0, 1, 2, 7, 30, 300] * 20 + [5000]:
        text = "".join(rnd.choice("aabb  \né") for _ in range(n))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_long_chunks_are_not_remembered():
    own = unigram.Counter([("a", -1.0), ("aa", -1.0), ("▁", -1.0)])
    assert own.count("a" * 200_001) == 100_002 and own.count("aa") == 2 and max(map(len, own)) <= unigram.REMEMBERED_CHARS


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 6000])
def test_cuts(n):
    pieces = packing.cuts(n)
    assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces)
    assert pieces == sorted(pieces, reverse=True)


def test_packing_round_trip(spark, odd):
    rows = packing.pack(odd, BPE).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    one = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["start"])
    ids = [i for r in one for i in r["ids"]]
    assert ids == bpe.Encoder(BPE).encode("You idiot. " * 3000) + [1] and one[0]["doc_tokens"] == len(ids)
    for r in rows:
        raw = b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert r["ids_crc32"] == zlib.crc32(raw) and r["length"] == len(r["ids"]) == 1 << r["bucket"]
    assert sum(r["doc_id"] == 3 for r in rows) == 2 and sum(r["doc_id"] == 2 for r in rows) == 1


def test_classifiers_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.join(docs, "doc_id")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_table(docs, model).drop("toxic").join(known, "doc_id")
    clean = scored.where((fold("doc_id", 5) == 0) & (F.col("toxic") == 0))
    assert clean.where("score >= 0.5").count() <= 0.03 * clean.count()
    seen = scored.where("toxic = 1")
    assert seen.where("score >= threshold").count() >= 0.7 * seen.count()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    good = quality.fit(docs, labels)
    rated = quality.score_table(docs, good).join(known, "doc_id").where(fold("doc_id", 4) == 2)
    right = rated.where("(score >= 0.7) = (quality = 1)").count()
    assert right >= 0.85 * rated.count()
    best = rated.where("quality = 1")
    assert best.where("score >= 0.7").count() >= 0.97 * best.count()


def test_thresholds_do_not_follow_the_sample(spark, monkeypatch):
    """Three of eight toxic texts are like every eleventh clean one; there are ten clean ones to a toxic one."""
    kinds = [("vile", 1, 400), ("murky", 1, 240), ("murky", 0, 600), ("fine", 0, 6000)]
    rows = [(f"{word} common words", label) for word, label, n in kinds for _ in range(n)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(rows)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(fold("doc_id", 5) == 0)
    for most in (6000, 300):
        monkeypatch.setattr(toxicity, "SAMPLE_ROWS", most)
        model = toxicity.fit(docs, labels)
        scored = {r["text"].split()[0]: r["score"] for r in docs.join(toxicity.score_table(docs, model), "doc_id").collect()}
        assert scored["murky"] < model.thresholds["en"] <= scored["vile"], (most, model.thresholds, scored)
        assert toxicity.keep_clean(clean, model).count() == clean.count()


def test_every_labelled_row_trains(spark, monkeypatch):
    """Each toxic word stands in few labelled rows; a sample of each class would miss most of them."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1000)
    monkeypatch.setattr(toxicity, "LEAST_SHARE", 0.001)
    texts = [f"so {i // 4 % 25:02d}vil" if i % 4 == 0 else f"so fine {i % 7}" for i in range(2000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "doc_id long, toxic int")
    found = toxicity.score_table(docs, toxicity.fit(docs, labels)).where("score >= 0.5")
    found = {r["doc_id"] for r in found.collect()}
    assert found <= set(range(0, 2000, 4)) and len(found) >= 450


def test_repeated_rows_train_with_their_number(spark):
    """Equal rows meet in a batch and in a shard; what they weigh doesn't change with how they are dealt."""
    rows = [(i % 40, f"text {i % 40} {'vile' if i % 40 < 9 else 'fine'}", None if i % 3 else "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 9)) for i in range(40)] * 2, "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(n), labels) for n in (1, 3)]
    assert (models[0].embedding == models[1].embedding).all() and models[0].thresholds == models[1].thresholds


def test_scores_do_not_follow_the_neighbours(spark):
    labels = [(i, int(i % 3 == 0)) for i in range(90)]
    docs = [(i, "so vile" if c else "so fine", "en") for i, c in labels]
    docs = spark.createDataFrame(docs + [(90, "", "en"), (91, "vile", "en")], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = ["so fine", "vile", "", "so vile", "so fine", ""]
    together = model.scores(*toxicity.buckets_of(*text_bytes(pa.array(texts))))
    alone = [model.scores(*toxicity.buckets_of(*text_bytes(pa.array([t]))))[0] for t in texts]
    assert abs(together - alone).max() < 1e-6


def test_long_labelled_texts_train(spark, monkeypatch):
    """All toxic texts are long, with the telling word last; a text repeats, and a bound on words ends the sample."""
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 30)
    texts = ["so " * 50 + "vile" if i % 4 == 0 else f"so fine {i % 3}" for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(4, texts[4], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    data, positives, negatives = toxicity.sample(docs, labels)
    known = docs.join(labels, "doc_id").where(fold("doc_id", 5) != 0)
    assert sorted((len(w), c) for w, c, _ in data) == sorted((len(r["text"].split()), r["toxic"]) for r in known.collect())
    model = toxicity.train(data, positives, negatives)
    assert {r["doc_id"] for r in toxicity.score_table(docs, model).where("toxic").collect()} == set(range(0, 400, 4))
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 10)
    cut = [(len(w), c) for w, c, _ in toxicity.sample(docs, labels)[0]]
    assert sum(c for _, c in cut) == 6 and max(n for n, _ in cut) == 51 and sum(n for n, c in cut if c) - 51 < 300


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.sample(docs, labels)[1:] == toxicity.sample(docs, turned)[1:]
    turned = labels.withColumn("quality", F.when(fold("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.sample(docs, labels), quality.sample(docs, turned)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None, 1), (3, 1, None), (None, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for known in (labels, empty):
        model, good = toxicity.fit(odd, known), quality.fit(odd, known)
        scores = toxicity.score_table(odd, model).collect() + quality.score_table(odd, good).collect()
        assert len(scores) == 10 and all(0 <= r["score"] <= 1 for r in scores)
        assert toxicity.score_table(odd.limit(0), model).collect() == []
        assert quality.keep_good(odd, good).columns == odd.columns


def test_blocks_keep_whole_texts():
    texts = ["x" * 3_000_000, None, "", "é" * 10] + ["y"] * (BLOCK_ROWS + 5)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(slices(batch))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert max(p.num_rows for p in parts) <= BLOCK_ROWS
    data, offsets = text_bytes(batch.slice(1, 3).column("text"))
    assert bytes(data).decode() == "é" * 10 and offsets.tolist() == [0, 0, 0, 20]
