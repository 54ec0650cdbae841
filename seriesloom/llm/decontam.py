"""Benchmark decontamination: a prefix-filtered set join on the rarest shingle of every window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD_BYTES, hidden, map_batches, text_or_empty

#: Slots of the bit map that spares shingles no window can have, for each shingle, and the most of all (32 MB); beyond them
#: it lets more through, which costs time only.
SLOTS_EACH, MOST_SLOTS = 16, 1 << 28
#: Bytes that are hashed at a time; a longer word is hashed alone.
CHUNK = 1 << 16
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Bytes in lower case, and which of these belong to words, as in WORD_BYTES.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
IN_WORD = np.array([bool(WORD_BYTES.fullmatch(bytes([b]))) for b in range(256)])
#: A word's hash is the sum of its bytes' weights times powers of an odd base, so prefix sums give the hashes of all words.
WEIGHTS = np.random.default_rng(13).integers(1, 2**64, 256, dtype=np.uint64)
POWERS, BACK = (np.multiply.accumulate(np.full(CHUNK, b, np.uint64)) for b in (int(MIX[0]), pow(int(MIX[0]), -1, 1 << 64)))


def words_of(text: str) -> list[bytes]:
    return WORD_BYTES.findall(text.encode().lower())


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words (1 to 3)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * MIX[k]
        out ^= out >> np.uint64(29)
    return out


class Words:
    """The words of some texts in a row: bytes in lower case, where each word starts and ends, its hash, and each text's first word."""

    def __init__(self, bodies: list[bytes]):
        self.small = SMALL[np.frombuffer(b"\0".join(bodies), np.uint8)]
        inside = np.zeros(len(self.small) + 2, bool)
        inside[1:-1] = IN_WORD[self.small]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        begin = np.append(0, np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1))
        self.first = np.searchsorted(self.starts, begin)
        self.owner = np.repeat(np.arange(len(bodies)), np.diff(self.first))
        self.hashes = self.hashed()

    def hashed(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            low = int(self.starts[at])
            to = int(np.searchsorted(self.ends, low + CHUNK, side="right"))
            if to == at:
                out[at] = xxh64_intdigest(self.small[low : int(self.ends[at])].tobytes())
                at += 1
                continue
            part = self.small[low : int(self.ends[to - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(WEIGHTS[part] * POWERS[: len(part)], out=sums[1:])
            starts, ends = self.starts[at:to] - low, self.ends[at:to] - low
            h = (sums[ends] - sums[starts]) * BACK[starts]
            out[at:to] = (h ^ (h >> np.uint64(32))) * MIX[1]
            at = to
        return out

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles that lie within one text, and the number of the word at which each starts."""
        found = shingles(self.hashes, size)
        at = np.flatnonzero(self.owner[: len(found)] == self.owner[size - 1 :])
        return found[at], at

    def joined(self, low: np.ndarray, high: np.ndarray) -> list[str]:
        """The words from ``low`` up to ``high``, joined by a space."""
        data = self.small.tobytes()
        return [b" ".join(WORD_BYTES.findall(data[a:b])).decode() for a, b in zip(self.starts[low].tolist(), self.ends[high - 1].tolist())]


def windows(items: DataFrame, size: int, text: str = "text", key: str = "item_id") -> DataFrame:
    """One row for each window of an item: item (id as text), n (words), words (joined), q (shingle size), shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(body)
            n = min(size, len(words))
            q = min(3, n)
            all_shingles = shingles(Words([body.encode()]).hashes, q).view(np.int64) if n else None
            for at in range(len(words) - n + 1 if n else 0):
                rows.append((item, n, b" ".join(words[at : at + n]).decode(), q, all_shingles[at : at + n - q + 1].tolist()))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()))
        cols = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["item", "n", "words", "q", "shingles"])

    cols = items.select(F.col(key).cast("string"), text_or_empty(text))
    return map_batches(cols, run, "item string, n int, words string, q int, shingles array<long>")


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Bits of the slots that a column ``h`` of hashes hits, 64 to a number; its size comes from the number of rows."""
    slots = min(MOST_SLOTS, 1 << max(16, (SLOTS_EACH * hashes.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(slots - 1))
    bits = hashes.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
    out = np.zeros(slots // 64, np.int64)
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out[found["at"].to_numpy()] = found["bit"].to_numpy()
    return out.view(np.uint64)


def hit_positions(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    slot = found & np.uint64(64 * len(bits) - 1)
    return np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))


def shingle_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """h and count over all documents of the shingles whose slot is set; each batch sends one row for each of them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, parts = Words([t.encode() for t in batch.column(0).to_pylist()]), []
        for q in sizes:
            found, _ = words.shingles(q)
            parts.append(found[hit_positions(bits.value, found)])
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return map_batches(docs, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


CANDIDATES = "key long, doc_hash long, n_words long, at array<struct<h: long, pos: int, lo: int, words: string>>"


def candidates(docs: DataFrame, bits, reach: dict[int, int]) -> DataFrame:
    """One row per document: words, and where a prefix shingle may stand, with the words that a window around it can cover.

    ``reach``: for each size of a shingle the words of the longest window that has one; a window of one shingle needs no other words.
    """
    from xxhash import xxh64_intdigest

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [(t or "").encode() for t in batch.column(1).to_pylist()]
        words, parts = Words(bodies), [(*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))]
        for q, most in reach.items():
            found, at = words.shingles(q)
            hit = hit_positions(bits.value, found)
            at, of = at[hit], words.owner[at[hit]]
            parts.append((at, np.maximum(words.first[of], at - most + q), np.minimum(words.first[of + 1], at + most), found[hit]))
        at, low, high, h = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(at, kind="stable")
        at, low, high, h = at[order], low[order], high[order], h[order]
        of = words.owner[at]
        cells = {"h": pa.array(h.view(np.int64)), "pos": pa.array((at - words.first[of]).astype(np.int32)), "lo": pa.array((low - words.first[of]).astype(np.int32)), "words": pa.array(words.joined(low, high), pa.string())}
        offsets = np.append(0, np.cumsum(np.bincount(of, minlength=len(bodies)))).astype(np.int32)
        spots = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(cells.values()), names=list(cells)))
        own = np.fromiter((xxh64_intdigest(b, 42) for b in bodies), np.uint64, len(bodies)).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(np.diff(words.first)), spots], names=["key", "doc_hash", "n_words", "at"])

    return map_batches(docs, run, CANDIDATES)


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """key, doc_hash, n_words, n_hit, n_items and items (sorted ids as text) for every row of ``docs``.

    A window is ``size`` consecutive words of an item, or the whole of a shorter item. Containment must be whole, so one shingle of
    a window is prefix enough: the rarest, as counted over all documents. Documents send only positions whose shingle is some
    window's prefix; position and length bound where the window would lie; then all its words are compared. Null texts and
    texts without words have no words and no hits; items without words have no window; a null item id counts as no item, but
    its words hit. Rows that repeat a key and a text share one result. A key of null is a value like others. An empty
    table of documents gives no rows, an empty table of items no hits.
    """
    spark, empty = docs.sparkSession, docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = materialize(windows(items, size, item_text, item_key))
    reach = {r["q"]: r["n"] for r in found.groupBy("q").agg(F.max("n").alias("n")).orderBy("q").collect()}
    pre = found.select("item", "n", "words", "q", F.posexplode("shingles").alias("offset", "h"))
    all_bits = spark.sparkContext.broadcast(bit_map(pre.select("h")))
    counts = materialize(shingle_counts(docs.select(text_or_empty(text)), all_bits, list(reach))) if reach else None
    if counts is None:
        prefix = pre
    else:
        rarest = pre.join(counts.withColumnRenamed("n", "seen"), "h", "left").groupBy("item", "n", "words", "q").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "offset")).alias("r"))
        prefix = rarest.filter("r.seen > 0").select("item", "n", "words", "q", F.col("r.h").alias("h"), F.col("r.offset").alias("offset"))
    prefix = materialize(prefix)
    bits = spark.sparkContext.broadcast(bit_map(prefix.select("h")))
    rows = materialize(candidates(empty, bits, reach))
    spots = rows.filter(F.size("at") > 0).select("key", "doc_hash", "n_words", F.explode("at").alias("s")).select("key", "doc_hash", "n_words", "s.*")
    start = (F.col("pos") - F.col("offset")).alias("start")
    bound = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("n") <= F.col("n_words"))
    slots = prefix.withColumnRenamed("words", "window")
    met = spots.join(slots, "h").filter(bound).filter(F.array_join(F.slice(F.split("words", " "), F.col("pos") - F.col("offset") - F.col("lo") + 1, F.col("n")), " ") == F.col("window"))
    met = met.select("key", "doc_hash", start, "n", "item").distinct()
    spans = F.transform(F.collect_set(F.struct("start", "n")), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))
    hits = met.groupBy("key", "doc_hash").agg(F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.select(F.col("key").alias("k"), F.col("doc_hash").alias("d"), "n_hit", "items")
    base = rows.select("key", "doc_hash", "n_words")
    joined = base.join(hits, base["key"].eqNullSafe(hits["k"]) & (base["doc_hash"] == hits["d"]), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(F.col("key").alias(key), "doc_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose hit words are less than a twentieth of their words."""
    text, key = how.get("text", "text"), how.get("key", "doc_id")
    bad = contamination(docs, items, **how).filter(contaminated()).select(F.col(key).alias("k"), F.col("doc_hash").alias("d")).distinct()
    own = hidden(docs, "hash")["hash"]
    held = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return held.join(bad, held[key].cast("long").eqNullSafe(bad["k"]) & (held[own] == bad["d"]), "left_anti").select(*docs.columns)
