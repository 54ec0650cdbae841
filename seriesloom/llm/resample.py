"""Importance resampling towards a target: weights scored with arrays, then a distributed quickselect of the highest keys."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches, map_streams, partitions, text_or_empty, worker_state

#: Buckets of the hashed features; so many numbers, and no more, reach the driver and go to the workers.
BUCKETS = 10_000
SEED = 2024
#: Random keys that one round of the selection compares all candidates with.
PIVOTS = 15
#: Words of at most so many bytes are remembered by a worker, and so many of them: about 40 MB.
HELD_BYTES, HELD_WORDS = 64, 250_000
#: Bytes that end a word become a space, A-Z become a-z; every byte from 0x80 belongs to a word.
WORDS = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(128)) + bytes(range(128, 256))
LAST = (1 << 63) - 1


class WordSums(dict):
    """crc32 by word."""

    def __missing__(self, word: bytes) -> int:
        out = crc32(word)
        if len(word) <= HELD_BYTES:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = out
        return out


def features(text: str, most: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to ``most`` consecutive words, repeats included."""
    words = (text or "").encode().translate(WORDS).split()
    known = worker_state("word sums", WordSums)
    sums = list(map(known.__getitem__, words))
    parts = [np.fromiter(sums, np.int64, len(sums))]
    for n in range(1, most):
        sums = [crc32(b" " + w, s) for s, w in zip(sums, words[n:])]
        parts.append(np.fromiter(sums, np.int64, len(sums)))
    return len(words), np.concatenate(parts) % buckets


def bucket_counts(rows: DataFrame, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket over all rows. A task sends one row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                total += np.bincount(features(body, most, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = map_streams(rows.select(text_or_empty(text)), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: floor(1000 ln) of its share in the target over its share in the rows, each count one more."""
    b = len(have)
    all_have, all_want = float(have.sum() + b), float(want.sum() + b)
    ratios = ((float(t) + 1) * all_have / ((float(s) + 1) * all_want) for s, t in zip(have, want))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, most: int = 1, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features, weight and score of every row, and its locator, a number that no other row has."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from hashlib import sha256

        table, rows = held.value, []
        for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, found = features(body, most, len(table))
            weight = int(table[found].sum()) // len(found) if len(found) else 0
            h = int(sha256(f"{seed}:{'' if own is None else own}".encode()).hexdigest()[:8], 16)
            rows.append((own, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        names = ["key", "n_words", "n_features", "weight", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    cols = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    out = map_batches(cols, run, "key long, n_words long, n_features long, weight long, score long")
    return out.withColumn("locator", F.monotonically_increasing_id())


def _before(cols: list[str], at: tuple) -> Column:
    """Whether the composite key stands before ``at``."""
    out = F.lit(False)
    for c, v in reversed(list(zip(cols, at))):
        out = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def _same(cols: list[str], at: tuple) -> Column:
    out = F.lit(True)
    for c, v in zip(cols, at):
        out = out & (F.col(c) == F.lit(v))
    return out


def quickselect(rows: DataFrame, cols: list[str], k: int, pivots: int = PIVOTS, seed: int = SEED) -> tuple:
    """The k-th smallest composite key (from 1) of ``rows``; ``cols`` are numbers without nulls.

    A round draws random pivot keys from the candidates and counts exactly, for each of them, how many candidates stand before it and how
    many equal it. Either a pivot is the k-th key, or the pivots on both sides of it bound the next round's candidates, about one in
    ``pivots`` + 1 of this round's. Only pivots and counts reach the driver; no row moves.
    """
    low = high = None
    skipped = round_ = 0
    while True:
        inside = rows
        if low is not None:
            inside = inside.filter((F.col(cols[0]) >= low[0]) & ~_before(cols, low) & ~_same(cols, low))
        if high is not None:
            inside = inside.filter((F.col(cols[0]) <= high[0]) & _before(cols, high))
        drawn = inside.select(*cols).orderBy(F.xxhash64(*cols, F.lit(seed), F.lit(round_)), *cols).limit(pivots).collect()
        if not drawn:
            raise ValueError(f"no key number {k}")
        at, passed = sorted({tuple(r) for r in drawn}), 0
        counted = inside.agg(*[F.count_if(test(cols, p)) for p in at for test in (_before, _same)]).first()
        for p, before, same in zip(at, counted[::2], counted[1::2]):
            if skipped + before >= k:
                high = p
                break
            if skipped + before + same >= k:
                return p
            low, passed = p, before + same
        skipped += passed
        round_ += 1


def ranked(rows: DataFrame, cols: list[str], rank: str) -> DataFrame:
    """``rows`` with their place (1, 2, 3, ...) in the order of ``cols``: sorted by ranges, numbered inside a range, and shifted by the sizes of the ranges before."""
    places = rows.repartitionByRange(partitions(rows.sparkSession), *cols).sortWithinPartitions(*cols)
    numbered = materialize(places.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range of the sort.
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = numbered.withColumn("_part", part).join(before, "_part")
    return joined.withColumn(rank, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, text: str = "text", key: str = "doc_id", target_text: str = "text", pivots: int = PIVOTS) -> DataFrame:
    """key, n_features, weight, score and rank of every row of ``docs``; drawn rows have a rank (1, 2, ...), the others null.

    A row's weight is the floored mean of its features' gains (see ``gains``), its score adds a Gumbel number made of the seed and its key,
    and of the N rows with ``least_words`` words or more floor(``percent`` N / 100) highest scores are drawn, ties to the smaller key. The
    threshold comes from ``quickselect`` on (score, key, locator); only the rows beyond it are sorted. Null texts and texts without
    words have no features and weight 0, and can't be drawn unless ``least_words`` is 0. Null keys hash as an empty key and lose
    ties; repeated rows are rows of their own. Other columns are ignored. An empty target leaves a uniform one; an empty
    table gives no rows.
    """
    assert 0 <= percent <= 100 and most >= 1
    gain = gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets))
    rows = materialize(scored(docs, gain, most, seed, text, key).withColumns({"_score": -F.col("score"), "_key": F.coalesce("key", F.lit(LAST))}))
    cols, own = ["_score", "_key", "locator"], [F.col("key").alias(key), "n_features", "weight", "score"]
    fit = F.col("n_words") >= least_words
    k = percent * rows.filter(fit).count() // 100
    if not k:
        return rows.select(*own, F.lit(None).cast("long").alias("rank"))
    last = quickselect(rows.filter(fit), cols, k, pivots, seed)
    drawn = fit & (_before(cols, last) | _same(cols, last))
    winners = ranked(rows.filter(drawn), cols, "rank").select(*own, "rank")
    return winners.unionByName(rows.filter(~drawn).select(*own, F.lit(None).cast("long").alias("rank")))
