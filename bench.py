"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Index builds are timed on their own; searches run on the built index, as in use.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from checks import inputs
from checks.queries import QUERIES
from lectern.operators import present
from lectern.operators import search as words
from lectern.operators.citations import classify_queries
from lectern.operators.lookup import lookup_chapter, lookup_range
from lectern.plans.omni import omni_search
from lectern.sources.corpus import address_dim
from lectern.staging import stage


def run(df: DataFrame) -> None:
    """Compute every row and column without collecting."""
    df.write.format("noop").mode("overwrite").save()


def item_pairs(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """One timed search per benchmark item, by its first and third word, as in earlier rounds."""
    pair = "concat_ws(' ', get(split(text, ' '), 0), get(split(text, ' '), 2)) as term"
    items = inputs.table(spark, sf_dir, "benchmark")
    return items.selectExpr("item_id as query_id", pair, f"'{lang}' as lang")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = stage(inputs.documents(spark, sf_dir))
    conv = stage(inputs.conversations(spark, sf_dir))
    books = stage(inputs.conversation_books(spark, sf_dir))
    asked = stage(item_pairs(spark, sf_dir, "en"))
    segments = stage(item_pairs(spark, sf_dir, "cn"))
    requests = stage(inputs.requests(spark, sf_dir))
    raw = stage(inputs.raw_queries(spark, sf_dir))
    addresses = stage(address_dim(conv))
    built: dict = {}

    def token_index() -> None:
        built["en"] = words.index_corpus(docs, ("en",))

    def bigram_index() -> None:
        built["cn"] = words.index_corpus(docs, ("cn",))

    def conversation_index() -> None:
        built["conv"] = words.index_corpus(conv, ("en",), addresses=True)

    def highlight() -> None:
        hits = words.search(built["en"], asked, 20, keep=["term"])
        texts = hits.join(docs, "row_idx")
        run(present.highlight(texts, "text_en", "term"))

    timed = {
        "token_index": token_index,
        "bigram_index": bigram_index,
        "conversation_index": conversation_index,
        "search_and": lambda: run(words.search(built["en"], asked, None)),
        "search_topn": lambda: run(words.search(built["en"], asked, 20)),
        "search_totals": lambda: run(words.search_totals(built["en"], asked)),
        "search_segments": lambda: run(words.search(built["cn"], segments, None)),
        "highlight": highlight,
        "classify_queries": lambda: run(classify_queries(raw, books)),
        "lookup_range": lambda: run(lookup_range(requests, addresses)),
        "lookup_chapter": lambda: run(lookup_chapter(requests, addresses, books)),
        "chapter_view": lambda: run(
            present.chapter_view(
                requests.select("query_id", "book_idx", "chapter"), built["conv"], books, "cn"
            )
        ),
        "omni_search": lambda: run(omni_search(raw, built["conv"], books)),
        "token_postings": lambda: run(QUERIES["token_postings"](spark, sf_dir)),
        "bigram_postings": lambda: run(QUERIES["bigram_postings"](spark, sf_dir)),
        "resolve_citations": lambda: run(QUERIES["resolve_citations"](spark, sf_dir)),
        "address_dim": lambda: run(QUERIES["address_dim"](spark, sf_dir)),
    }
    seconds = {}
    for name, fn in timed.items():
        start = time.perf_counter()
        fn()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
