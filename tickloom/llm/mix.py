"""Mixing sources to target shares of tokens: Sainte-Laguë quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: How the vocabulary splits text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block and, about, of a shard; the driver gets one number for each shard and source.
BLOCK_TOKENS, SHARD_TOKENS = 512, 2**26
#: Sources that may be listed; more raise an error, as the driver holds their quotas.
MOST_SOURCES = 100_000

_encodings: dict[int, object] = {}


def token_counter(path: str):
    """A column function that counts the tokens of a text by the vocabulary file ``path``; null counts 0.

    The file (about a megabyte) is read once on the driver and goes to the executors with the function.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none above its cap; ties go to the earlier.

    A divisor near the final one is found by bisection, so that only a few seats are handed out one by one: the cost
    doesn't grow with the number of seats.
    """
    w = np.array(weights, float)
    cap = np.array(caps if caps is not None else [seats] * len(w), float)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0 or not len(w):
        return [0] * len(w)
    lo, hi = w[w > 0].min() / (2 * seats + 2), 2 * w.max() + 1.0

    def given(d: float) -> np.ndarray:
        return np.minimum(np.floor(w / d + 0.5), cap)

    for _ in range(1200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if given(mid).sum() > seats else (lo, mid)
        if hi / lo < 1 + 1e-15:
            break
    out = given(hi)
    heap = [(-w[i] / (2 * out[i] + 1), i) for i in range(len(w)) if out[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * out[i] + 1), i))
    return [int(x) for x in out]


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Copies of every document so that each source has its target share of all tokens.

    ``docs``: doc_id, source, n_tokens; ``targets``: source, target_share, max_repeats.  The mixture is as large as the
    caps allow: the number of equal-token blocks is the most at which no source with documents has to repeat more often
    than max_repeats.  Blocks are allocated to sources by the highest quotients (Sainte-Laguë), then in the same way
    to the shards of each source.  The documents of a shard lie in a ring of tokens in an order given by the seed, and a
    shard's quota is a stretch of whole blocks along it: all documents as often as it goes round, and once more those whose
    middle lies in its rest.  Documents aren't cut, so a shard is off its quota by half a document at most.

    Sources are compared without case and blanks; documents of a null or unlisted source, null ids and documents without
    tokens are left out; a listed source without documents gets nothing and the others keep their proportions; a repeated
    doc_id counts once; without any usable source the result is empty.  ``targets`` is one row for each source, at most
    ``MOST_SOURCES``, else an error is raised.  Output: doc_id, source, n_tokens, n_copies (1 at least).
    """
    docs = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).where("doc_id is not null and n_tokens > 0").dropDuplicates(["doc_id"])
    rows = targets.groupBy(F.lower(F.trim("source"))).agg(F.max("target_share"), F.max("max_repeats")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    listed = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None and r[1] and r[1] > 0 and r[2] and r[2] > 0}
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(s,) for s in listed], "source string"))
    have = {r[0]: r[1] for r in docs.join(known, "source").groupBy("source").agg(F.sum("n_tokens")).collect()}
    names = sorted(have)
    shards = F.broadcast(spark.createDataFrame([(s, max(1, round(have[s] / shard_tokens))) for s in names], "source string, shards int"))
    rows = docs.join(shards, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")).cast("int"))
    place = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("middle", F.coalesce(F.sum("n_tokens").over(place), F.lit(0)) + F.expr("n_tokens div 2"))
    sizes: dict[str, list[tuple[int, int]]] = {s: [] for s in names}
    for r in rows.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).collect():
        sizes[r["source"]].append((r["shard"], r["tokens"]))
    quota: list[tuple[str, int, int, int]] = []
    whole = sum(listed[s][0] for s in names)
    if names:
        caps = {s: [t * listed[s][1] // block_tokens for _, t in sorted(sizes[s])] for s in names}
        total = int(min(sum(caps[s]) / (listed[s][0] / whole) for s in names))
        for s, seats in zip(names, sainte_lague([listed[s][0] for s in names], total, [sum(caps[s]) for s in names])):
            own = sorted(sizes[s])
            for (shard, tokens), q in zip(own, sainte_lague([t for _, t in own], seats, caps[s])):
                quota.append((s, shard, q * block_tokens, tokens))
    out = rows.join(F.broadcast(spark.createDataFrame(quota, "source string, shard int, quota long, tokens long")), ["source", "shard"])
    turned = F.pmod(F.col("middle") + F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("tokens")), F.col("tokens"))
    copies = F.expr("quota div tokens") + (turned < F.expr("quota % tokens")).cast("long")
    return out.select("doc_id", "source", "n_tokens", copies.alias("n_copies")).where("n_copies > 0")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: source, target_share, available_tokens, used_tokens, actual_share, max_copies."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("used_tokens"), F.max("n_copies").alias("max_copies"))
    there = docs.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("n_tokens").alias("available_tokens"))
    all_of_it = used.agg(F.sum("used_tokens").alias("all_tokens"))
    rows = targets.select(F.lower(F.trim("source")).alias("source"), "target_share").join(there, "source", "left").join(used, "source", "left").join(F.broadcast(all_of_it), F.lit(True), "left")
    return rows.select("source", "target_share", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.round(F.coalesce("used_tokens", F.lit(0)) / F.col("all_tokens"), 9).alias("actual_share"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
