"""Near-duplicates by b-bit MinHash: bands bring candidates together, packed low bits estimate them, full shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches, map_streams, partitions, text_or_empty
from .simhash import components, merge_labels

SEED = 42
#: Minima of a signature, and how many of them make a band. Sets of similarity 0.85 miss each other in all 32 bands once in 10^10 pairs.
MINIMA, BAND = 128, 4
#: Low bits that are kept of a minimum (a power of two).
BITS = 4
#: A pair goes on to its full sets if the corrected estimate is no further than this below the limit: six standard deviations.
MARGIN = 0.2
#: Most signatures of a tile in the candidate search; documents and shingles that a tile of full sets is planned for.
TILE, TILE_DOCS, TILE_SHINGLES = 1024, 512, 4_000_000


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[size - 1 :]
    first = np.append(0, ends[: len(last) - 1] + 1)
    return np.unique(np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())], np.uint64, len(last)))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, MINIMA, np.uint64), rng.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of every permutation; blocks of shingles bound the memory."""
    flip, times = perms
    out = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None] ^ flip
        part *= times
        np.minimum(out, (part ^ (part >> np.uint64(32))).min(axis=0), out=out)
    return out


def packed(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of all minima in as few 64-bit numbers as hold them."""
    lanes = 64 // bits
    shifts = np.arange(lanes, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce((low & np.uint64((1 << bits) - 1)).reshape(-1, lanes) << shifts, axis=1)


def similarity(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated similarity of packed signatures, row by row: unequal lanes by bit counts, less what falls together by chance."""
    apart = a ^ b
    step = 1
    while step < bits:
        apart = apart | (apart >> np.uint64(step))
        step *= 2
    unequal = np.bitwise_count(apart & np.uint64(sum(1 << k for k in range(0, 64, bits)))).sum(axis=-1, dtype=np.int64)
    chance = 0.5**bits
    return (1 - unequal / MINIMA - chance) / (1 - chance)


ROW = "key long, text_hash long, n_shingles long, digest binary, signature binary, bands array<long>"


def signatures(docs: DataFrame, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the size of its set, a digest of the set, the packed signature, and one hash per band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        perms, rows = permutations(), []
        number = np.arange(MINIMA // BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for body in batch.column(1).to_pylist():
            found = shingle_set(body, size)
            low = minima(found, perms)
            keys = number.copy()
            for part in low.reshape(-1, BAND).T:
                keys = (keys ^ part) * np.uint64(0xC2B2AE3D27D4EB4F)
                keys ^= keys >> np.uint64(31)
            rows.append((len(found), blake2b(found.astype("<u8").tobytes(), digest_size=16).digest(), packed(low).astype("<u8").tobytes(), keys.view(np.int64).tolist() if len(found) else []))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["key", "text_hash", "n_shingles", "digest", "signature", "bands"])

    return map_batches(_located(docs, text, key), run, ROW)


def _located(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _by_groups(rows: DataFrame, cols: list[str], found, most_rows: int | None = None) -> DataFrame:
    """Links (a, b) that ``found`` gives for the rows of whole groups; a group is never cut, and only one task holds it."""
    dealt = rows.repartition(partitions(rows.sparkSession), *cols).sortWithinPartitions(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def starts(table: pa.Table) -> np.ndarray:
            ids = np.stack([table.column(c).to_numpy() for c in cols])
            return np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1

        def links(table: pa.Table) -> pa.RecordBatch:
            a, b = found(table, np.append(0, starts(table)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for whole in batches:
            step = most_rows or max(1, whole.num_rows)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                held = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
                if len(cut := starts(held)):
                    yield links(held.slice(0, int(cut[-1])))
                    held = held.slice(int(cut[-1]))
        if held and held.num_rows:
            yield links(held)

    out = map_streams(dealt, run, "a long, b long").filter("a != b")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tiled(rows: DataFrame, tiles: Column, by: str) -> DataFrame:
    """Every row once for each pair of tiles that its own tile is part of: columns t and u."""
    dealt = rows.withColumn("_tiles", tiles).withColumn("_own", F.pmod(F.xxhash64(by), "_tiles").cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_tiles") - 1).cast("int"))))
    return other.withColumns({"t": F.least("_own", "_other"), "u": F.greatest("_own", "_other")}).drop("_tiles", "_own", "_other")


def candidate_links(classes: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between class ids, as forests, that connect all classes which share a band and whose estimate is at least ``least``.

    ``classes``: cid, signature, bands. Bands of one class go. The rows of a crowded band are dealt into tiles, and every pair of tiles is
    a group, so no group grows with the band.
    """
    spread = classes.select("cid", F.explode("bands").alias("band"))
    full = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = spread.join(full, "band").join(classes.select("cid", "signature"), "cid")
    rows = _tiled(met, F.ceil(F.col("n") / TILE), "cid").select("band", "t", "u", "cid", "signature")

    def found(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cid, own = np.unique(table.column("cid").to_numpy(), return_inverse=True)
        words, label, n = _words(table.column("signature")), np.arange(len(cid)), table.num_rows
        group = np.zeros(n, np.int64)
        group[first[1:]] = 1
        group = np.cumsum(group)
        left, held, pending = np.arange(n), [], 0
        for step in range(1, n):
            left = left[left + step < n]
            left = left[group[left] == group[left + step]]
            if not len(left):
                break
            for at in range(0, len(left), 1 << 16):
                i = left[at : at + (1 << 16)]
                i = i[label[own[i]] != label[own[i + step]]]
                i = i[similarity(words[i], words[i + step]) >= least]
                held.append((own[i], own[i + step]))
                pending += len(i)
            if pending > 10_000 or step < 4:
                label, held, pending = merge_labels(label, *(np.concatenate(x) for x in zip(*held))), [], 0
        if held:
            label = merge_labels(label, *(np.concatenate(x) for x in zip(*held)))
        return cid, cid[label]

    return _by_groups(rows, ["band", "t", "u"], found)


def confirm(rows: DataFrame, cols: list[str], percent: int, size: int) -> DataFrame:
    """Links (a, b), as forests, between rows of a group whose full sets are similar enough.

    ``rows``: ``cols`` (the group), cid, root (rows of one root are linked already), n_shingles, signature, digest and text. A pair that is
    linked already is not looked at again; sizes and the estimate discard others; the most alike are tried first.
    """
    least = percent / 100 - MARGIN

    def of_group(table: pa.Table) -> list[tuple[int, int]]:
        sets = [shingle_set(t, size) for t in table.column("text").to_pylist()]
        same = [blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() == d for s, d in zip(sets, table.column("digest").to_pylist())]
        cid, words, n = table.column("cid").to_numpy(), _words(table.column("signature")), table.column("n_shingles").to_numpy()
        given = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        label = given.tolist()
        members = {k: [i for i, x in enumerate(label) if x == k] for k in set(label)}
        pairs = []
        for i in range(len(cid) - 1):
            j = np.arange(i + 1, len(cid))
            j = j[(given[j] != given[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
            near = similarity(words[i], words[j])
            ok = near >= least
            pairs.append(np.stack([np.full(ok.sum(), i), j[ok], (near[ok] * 1e6).astype(np.int64)]))
        pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int64)
        out = []
        for i, j in pairs[:2, np.argsort(-pairs[2], kind="stable")].T.tolist():
            if label[i] == label[j] or not (same[i] and same[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                out.append((int(cid[i]), int(cid[j])))
                low, high = sorted((label[i], label[j]), key=lambda k: -len(members[k]))
                for m in members[high]:
                    label[m] = low
                members[low] += members.pop(high)
        return out

    def found(table: pa.Table, first: np.ndarray) -> tuple[list[int], list[int]]:
        out = []
        for a, b in zip(first, [*first[1:], table.num_rows]):
            if b - a > 1:
                out += of_group(table.slice(a, b - a))
        return [a for a, _ in out], [b for _, b in out]

    return _by_groups(rows, cols, found, 64)


def links(classes: DataFrame, located: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between classes that connect all classes whose full sets are similar enough.

    Candidate links give candidate components; links of full sets stand inside them only. The texts of their classes are fetched once. A component is dealt into
    tiles: tiles are linked inside, then the largest linked parts of all tiles with each other. What a component still has
    besides its largest part then meets all its rows, by pairs of tiles. So the pairs of a large group of near copies, which
    are linked early, are never made, and no pair of unlinked rows is left out.
    """
    near = components(candidate_links(classes, percent / 100 - MARGIN)).withColumnsRenamed({"node": "cid", "root": "comp"})
    near = near.unionByName(near.select(F.col("comp").alias("cid"), "comp")).distinct()
    wanted = near.join(classes.drop("bands"), "cid")
    texts = located.withColumnsRenamed({"key": "_key"})
    same = wanted["key"].eqNullSafe(texts["_key"]) & (wanted["text_hash"] == texts["text_hash"])
    rows = materialize(wanted.join(texts, same).select("comp", "cid", "n_shingles", "digest", "signature", "text").dropDuplicates(["cid"]))
    sizes = rows.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE_DOCS, F.sum("n_shingles") / TILE_SHINGLES)).alias("tiles"))
    rows = rows.join(materialize(sizes), "comp").withColumn("t", F.pmod(F.xxhash64("cid"), "tiles").cast("int"))
    met = materialize(confirm(rows.withColumn("root", F.col("cid")), ["comp", "t"], percent, size))
    wide = rows.filter("tiles > 1")
    if wide.isEmpty():
        return met

    def rooted(found: DataFrame) -> DataFrame:
        to = components(found).withColumnRenamed("node", "cid")
        return wide.join(to, "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    def largest(named: DataFrame, cols: list[str]) -> DataFrame:
        parts = named.groupBy(*cols, "root").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid"))
        return parts.groupBy(*cols).agg(F.max_by(F.struct("root", "cid"), F.struct("n", "root")).alias("top"))

    heads = largest(materialize(rooted(met)), ["comp", "t"]).select(F.col("top.cid").alias("cid"))
    heads = wide.join(heads, "cid").withColumns({"root": F.col("cid"), "tiles": F.ceil(F.col("tiles") / TILE_DOCS)})
    met = materialize(met.unionByName(confirm(heads.withColumn("t", F.pmod(F.xxhash64("cid"), "tiles").cast("int")), ["comp", "t"], percent, size)))
    named = materialize(rooted(met))
    tops = largest(named, ["comp"]).select("comp", F.col("top.root").alias("top"))
    rest = materialize(named.join(tops, "comp").filter("root != top").drop("top"))
    if rest.isEmpty():
        return met
    counts = rest.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / TILE_DOCS).alias("slices"))
    one = rest.join(counts, "comp").withColumn("r", F.pmod(F.xxhash64("cid", F.lit(1)), "slices").cast("int"))
    one = one.withColumn("t", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")))).drop("slices")
    all_ = named.join(counts, "comp").withColumn("r", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int")))).drop("slices")
    return met.unionByName(confirm(one.unionByName(all_), ["comp", "t", "r"], percent, size))


def near_components(docs: DataFrame, percent: int = 85, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id of every row: the smallest id reachable over links of full sets.

    Documents are linked if 100 x the common shingles are at least ``percent`` x those of both. Documents of one set are one class, whatever
    their number. Null texts and texts without words have an empty set and are linked with nothing. A null id is never the smallest of a
    component with others; a document of a null id that links to nothing has a null component. Repeated rows share a class. Other
    columns are ignored; an empty table gives no rows.
    """
    assert 50 <= percent <= 100
    rows = materialize(signatures(docs, size, text, key).withColumn("at", F.monotonically_increasing_id()))
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("at").alias("cid"), F.min("key").alias("least"))
    classes = materialize(classes.join(rows.drop("digest"), F.col("cid") == F.col("at")).drop("at"))
    found = components(links(classes, _located(docs, text, key), percent, size))
    named = classes.select("digest", "cid", "least").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "cid")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    to = named.join(smallest, "root").select("digest", "component")
    out = rows.select("key", "n_shingles", "digest").join(to, "digest", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """key, n_shingles, component_id and kept: whether the id is the smallest of its component; a null id of a null component stays."""
    key = how.get("key", "doc_id")
    return near_components(docs, **how).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
