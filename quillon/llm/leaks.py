"""Problem 7: held-out passages inside the corpus, by Wu-Manber search over words.

Every run of ``WINDOW`` consecutive words of a held-out item is a pattern.  Blocks of two words carry the shift:
where a text's block ends no prefix-aligned place of any pattern, the search jumps on by up to WINDOW - 1 words;
where the shift is zero, the patterns ending in that block are found by it (the suffix bucket) and compared
word by word.  One pass over each text, whole, whatever its length; patterns are built once per task.

The held-out items are a fixed set; they are read in blocks of ``ITEMS_PER_BLOCK`` items, each block sent to all
tasks and searched in its own pass, so that the broadcast stays bounded for any number of items.

Defined cases: null, empty and wordless texts share nothing; items of fewer than WINDOW words have no cases;
repeated rows and repeated passages give one row per item and document; rows without an id are left out;
further columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

WINDOW = 12
ITEMS_PER_BLOCK = 20_000

_WORD = re.compile(r"[^\W_]+")


@functools.lru_cache(maxsize=None)
def _format_characters() -> dict[int, None]:
    return {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, without format characters, in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_format_characters())
    return _WORD.findall(text.lower())


class Patterns:
    """Shift table and suffix buckets over all windows of the items."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        self.window = window
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], list[int]]] = {}
        self.default = window - 1
        shift = self.shift
        for item, said in items:
            for start in range(len(said) - window + 1):
                pattern = tuple(said[start : start + window])
                for end in range(1, window):
                    block = (pattern[end - 1], pattern[end])
                    away = window - 1 - end
                    if away < shift.get(block, self.default):
                        shift[block] = away
                of_block = self.buckets.setdefault(pattern[-2:], {}).setdefault(pattern, [])
                if not of_block or of_block[-1] != item:
                    of_block.append(item)

    def search(self, said: list[str]) -> set[int]:
        found: set[int] = set()
        shift, buckets, window, default, n = self.shift, self.buckets, self.window, self.default, len(said)
        at = window - 1
        while at < n:
            away = shift.get((said[at - 1], said[at]), default)
            if away:
                at += away
                continue
            here = buckets[(said[at - 1], said[at])].get(tuple(said[at - window + 1 : at + 1]))
            if here:
                found.update(here)
            at += 1
        return found


def leaked(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, doc_id) of every item and document sharing ``window`` consecutive words."""
    spark = documents.sparkSession
    texts = spread(documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))
    ordered = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    blocks = [texts.select(F.col("doc_id").alias("item_id"), "doc_id").limit(0)]
    block, rows = [], ordered.toLocalIterator()

    def scan(part):
        shared = spark.sparkContext.broadcast(part)

        def search(batches):
            import pyarrow as pa

            patterns = Patterns([(i, words(t)) for i, t in shared.value], window)
            for batch in batches:
                docs, hits = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item in patterns.search(words(text)):
                        docs.append(doc)
                        hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), pa.array(docs, pa.int64())], names=["item_id", "doc_id"])

        return texts.mapInArrow(search, "item_id bigint, doc_id bigint")

    for row in rows:
        block.append((row.item_id, row.text))
        if len(block) == ITEMS_PER_BLOCK:
            blocks.append(scan(block))
            block = []
    if block:
        blocks.append(scan(block))
    if len(blocks) > 1:
        blocks = blocks[1:]
    return functools.reduce(DataFrame.unionByName, blocks).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc_id"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
