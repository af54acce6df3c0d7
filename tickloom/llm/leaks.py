"""Evaluation texts inside a training corpus: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that make a leak, and words of a shingle.
PASSAGE, SHINGLE = 13, 5
#: Fingerprints of test passages up to which they are sent to all executors (8 bytes each) to drop others at the scan, and
#: passages up to which their words are.
MOST_SENT, MOST_INDEXED = 2_000_000, 200_000
#: Parts of the documents that a passage is joined with separately.
SALTS = 16
#: Letters with strokes and ligatures that Unicode doesn't decompose.
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th"})
_MARKS = re.compile(r"[̀-ͯ­​-‍⁠﻿]+")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case and accents; soft hyphens and zero-width characters are dropped."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())).translate(_PLAIN)
    return _WORD.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hasher:
    """Hashes of words, with a cache that is emptied when it grows large."""

    def __init__(self, most: int = 400_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def window_minima(hashes: np.ndarray, size: int) -> np.ndarray:
    """MinHash of the five-word shingles of every window of ``size`` words (of fewer than five words: of the window).

    Equal windows have equal minima whatever surrounds them, and windows next to each other mostly share theirs.
    """
    k = min(SHINGLE, size)
    n = len(hashes) - k + 1
    if n - (size - k) <= 0:
        return np.empty(0, np.uint64)
    shingle = np.zeros(n, np.uint64)
    for j in range(k):
        shingle = (shingle + hashes[j : j + n]) * _MIX + np.uint64(j + 1)
    least = shingle = _mix(shingle)
    width, m = size - k + 1, n - (size - k)
    done = 1
    while done < width:  # windows double until they are as wide as asked
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return _mix(least[:m] + np.uint64(size))


def _sizes_of(n: int) -> int:
    """Size class of an item of n words."""
    return min(n, PASSAGE)


def _batch(columns: list[list], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], [*fields])


def item_windows(items: DataFrame) -> DataFrame:
    """Passages of the test items by size class: item_id, size, n_shingles, at, fp, gram. An item without words has none.

    ``size`` is the class of the item: 13, or its words if it has fewer; ``n_shingles`` those of the whole item, ``at`` the
    first word of the passage.
    """
    fields = {"item_id": pa.string(), "size": pa.int32(), "n_shingles": pa.int32(), "at": pa.int32(), "fp": pa.int64(), "gram": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                words = words_of(text)
                if words:
                    size = _sizes_of(len(words))
                    n = len(words) - min(SHINGLE, size) + 1
                    rows += [(item, size, n, i, fp, " ".join(words[i : i + size])) for i, fp in enumerate(window_minima(hasher(words), size).view(np.int64).tolist())]
            yield _batch(list(zip(*rows)) if rows else [[]] * 6, fields)

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id string, size int, n_shingles int, at int, fp bigint, gram string")


def _scan(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None, words_too: bool) -> DataFrame:
    """Windows of the documents for each size class: doc_id, fp, and gram if asked for.

    With ``wanted`` (sorted) only those of these fingerprints, else the distinct ones of each document, of which windows
    next to each other mostly share theirs.  Whole texts are read, a batch at a time: the words of all texts of a batch are
    hashed into one array, so that the minima of all its windows are a few vector operations.
    """
    fields = {"doc_id": pa.int64(), "fp": pa.int64()} | ({"gram": pa.string()} if words_too else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            starts = np.cumsum([0] + [len(t) for t in texts])
            every = [w for t in texts for w in t]
            hashes = hasher(every)
            found: list[list] = [[] for _ in fields]
            for size in sizes:
                minima = window_minima(hashes, size)
                if not len(minima) or (wanted is not None and not len(wanted)):
                    continue
                if wanted is not None:
                    at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, minima), len(wanted) - 1)] == minima)
                else:
                    at = np.arange(len(minima))
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = at + size <= starts[doc + 1]
                at, doc = at[inside], doc[inside]
                if not words_too:
                    pairs = np.unique(np.stack([doc, minima[at].view(np.int64)], 1), axis=0) if len(at) else np.empty((0, 2), np.int64)
                    doc, fps = pairs[:, 0], pairs[:, 1]
                else:
                    fps = minima[at].view(np.int64)
                    found[2] += [" ".join(every[i : i + size]) for i in at.tolist()]
                found[0] += ids[doc].tolist()
                found[1] += fps.tolist()
            yield _batch(found, fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id bigint, fp bigint" + (", gram string" if words_too else ""))


def leaked_items(docs: DataFrame, items: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Documents that hold at least 13 consecutive words of a test item, or all of one that is shorter.

    ``docs``: doc_id, text; ``items``: item_id, text.  MinHash containment search: the short side is partitioned by size
    (passages of 13 words, and for shorter items a class for each length), and each passage is indexed by the MinHash of
    its five-word shingles.  A document is searched by the windows of each size: a window that has all shingles of a
    passage in order has its minimum, however long the document, so that candidates lose nothing.  They are verified
    by their words, and ``containment`` is the exact share of the item's shingles in the passages found.

    Where the distinct fingerprints of all items are at most ``most_sent`` (8 bytes each, counted first), they go to the
    executors and windows without a partner never leave the scan.  Beyond that the distinct fingerprints of each document,
    about a fifth of its words, are joined with the items' by shuffle, without texts, and only documents that share one are
    read again.  Both ways give the same rows.  Null and empty texts hold nothing; null ids are left out; items without
    words are never found; repeated rows and passages give one row.  Output: doc_id, item_id, n_passages, containment.
    """
    grams = item_windows(items).groupBy("item_id", "gram").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("size", "n_shingles", "fp")])
    fingerprints = grams.select("fp").distinct()
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())
    if fingerprints.count() <= most_sent:
        wanted = np.unique(fingerprints.toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
        found = _scan(docs, sizes, wanted, True)
    else:
        # Salted by the document, so that a passage that stands in very many of them is many tasks.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        shared = _scan(docs, sizes, None, False).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(fingerprints.select("fp", salts), ["fp", "salt"], "left_semi")
        candidates = docs.join(shared.select("doc_id").distinct(), "doc_id", "left_semi")
        found = _scan(candidates, sizes, None, True)
    found = found.distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    index = grams.select("item_id", "size", "n_shingles", "at", "fp", "gram")
    if index.count() <= MOST_INDEXED:
        pairs = found.join(F.broadcast(index), ["fp", "gram"])
    else:
        pairs = found.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["fp", "gram", "salt"])
    # Shingles in the item's passages found: each of them covers those that begin within it; overlaps count once.
    spans = pairs.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_passages"), F.max("n_shingles").alias("n"), F.array_sort(F.collect_set("at")).alias("at"), F.max("size").alias("size"))
    wide = F.greatest(F.col("size") - (SHINGLE - 1), F.lit(1))
    gaps = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.least(F.get("at", i) - F.get("at", i - 1), wide))
    covered = wide + F.when(F.size("at") > 1, F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0)
    return spans.select("doc_id", "item_id", "n_passages", F.round(F.least(covered / F.col("n"), F.lit(1.0)), 6).alias("containment"))
