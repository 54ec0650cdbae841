"""Near-duplicates by 64-bit fingerprints, with distance tables to reference fingerprints (pivots)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import hidden, map_batches, map_streams, partitions, text_or_empty

SEED = 42
#: Bits of the blocks that a pair at distance 3 or less must share two of.
BLOCKS = (13, 13, 13, 13, 12)
#: Most fingerprints of one tile; a bucket of more is dealt into pairs of tiles.
TILE = 2048


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[words_per_shingle - 1 :]
    first = np.append(0, ends[: len(last) - 1] + 1)
    hashes = np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())], np.uint64, len(last))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words_per_shingle: int = 3, *carried: str) -> DataFrame:
    """key, fp (the fingerprint as a signed long) and the ``carried`` numbers of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=[key, "fp", *carried])

    cols = docs.select(F.col(key).cast("long").alias(key), text_or_empty(text), *[F.col(c).cast("long").alias(c) for c in carried])
    return map_batches(cols, run, ", ".join(f"`{c}` long" for c in (key, "fp", *carried)))


def pivots(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of linked rows; a class is named after its smallest row."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def link_groups(group: np.ndarray, fp: np.ndarray, most: int, n_pivots: int) -> np.ndarray:
    """For rows sorted by group: the smallest row linked to each, within its group.

    The table of distances to all pivots is computed once for the rows. Rows of a group are ordered by the first distance, so
    only neighbours up to ``most`` apart meet; a pair goes on while no coordinate differs by more than ``most`` (the triangle
    inequality), and is then verified on the fingerprints.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots(n_pivots)[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    label = np.arange(len(fp))
    left, held, pending = np.arange(len(fp)), [], 0
    for step in range(1, len(fp)):
        left = left[left + step < len(fp)]
        right = left + step
        near = (group[left] == group[right]) & (table[right, 0] - table[left, 0] <= most)
        left, right = left[near], right[near]
        if not len(left):
            break
        apart = label[left] != label[right]
        a, b = left[apart], right[apart]
        for c in range(1, n_pivots):
            if not len(a):
                break
            ok = np.abs(table[a, c] - table[b, c]) <= most
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= most
        held.append((a[ok], b[ok]))
        pending += int(ok.sum())
        if pending > 20_000:
            label = merge_labels(label, *(np.concatenate(x) for x in zip(*held)))
            held, pending = [], 0
    if held:
        label = merge_labels(label, *(np.concatenate(x) for x in zip(*held)))
    out = np.empty(len(fp), np.int64)
    out[order] = order[label]
    return out


def links(classes: DataFrame, most: int = 3, n_pivots: int = 16) -> DataFrame:
    """Pairs (a, b) of class ids that connect all classes whose fingerprints differ in at most ``most`` bits.

    ``classes``: root (class id, unique and never null), fp. Two fingerprints at distance 3 or less agree on two of five blocks of bits, which gives ten
    buckets for each; buckets of one row go. A bucket of more than TILE rows is dealt into tiles, and every pair of tiles is a
    group, so no group has more than 2 x TILE rows whatever a bucket's size. A group gives one link for each row that it joins to
    a smaller one, not all pairs.
    """
    assert most <= 3
    spark, starts = classes.sparkSession, [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS)]
    keys = F.array(*[F.lit(k << 26).cast("long") + F.shiftleft(part[i], 13) + part[j] for k, (i, j) in enumerate(combinations(range(5), 2))])
    rows = classes.select("root", "fp", F.explode(keys).alias("key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = rows.join(full, "key").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("t", F.pmod(F.hash("fp"), "tiles"))
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = dealt.select("key", "root", "fp", "t", other.alias("u")).select("key", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), "root", "fp")
    cols = ["key", "a", "b"]
    sorted_rows = pairs.repartition(partitions(spark), *cols).sortWithinPartitions(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(rows: pa.Table) -> pa.RecordBatch:
            root, fp = rows.column("root").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
            ids = np.stack([rows.column(c).to_numpy() for c in cols])
            group = np.append(0, np.cumsum((ids[:, 1:] != ids[:, :-1]).any(axis=0))) if rows.num_rows else np.zeros(0, np.int64)
            to = link_groups(group, fp, most, n_pivots)
            own = np.flatnonzero(to != np.arange(len(to)))
            return pa.RecordBatch.from_arrays([pa.array(root[own]), pa.array(root[to[own]])], names=["a", "b"])

        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            ids = np.stack([held.column(c).to_numpy() for c in cols])
            new = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))
            if len(new):  # the last group may go on in the next batch
                yield found(held.slice(0, int(new[-1]) + 1))
                held = held.slice(int(new[-1]) + 1)
        if held:
            yield found(held)

    return map_streams(sorted_rows, run, "a long, b long").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest id that it reaches) of every node of ``edges`` (a, b), by large-star and small-star rounds.

    Each round writes its edges into the shared folder. A hub is combined on the map side and its join can be split.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        e = e.filter("a != b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
        seen = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))) if both else e
        low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        near = seen.filter("v > u") if both else seen
        moved = near.join(low, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
        if not both:
            moved = moved.unionByName(low.select(F.col("u").alias("b"), F.col("m").alias("a")))
        return moved.filter("a != b").distinct()

    def sign(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(edges)
    before = sign(edges)
    while before[0]:
        edges = materialize(star(star(edges, True), False).select("a", "b"))
        now = sign(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 3, words_per_shingle: int = 3, n_pivots: int = 16) -> DataFrame:
    """key, fp and component_id of every row: the smallest id reachable over links of at most ``most`` differing bits.

    Rows of one fingerprint are one class, so copies cost nothing beyond their class. Null texts count as empty; texts without
    words have fingerprint 0 and are linked like any other. Null ids take no part in the choice of a smallest id, but their rows link others; a component
    of null ids alone has a null one. Repeated rows share a class. Other columns are ignored; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, text, key, words_per_shingle))
    return fps.join(named_classes(fps, key, most, n_pivots), "fp").select(key, "fp", "component_id")


def named_classes(fps: DataFrame, key: str, most: int, n_pivots: int) -> DataFrame:
    """fp and component_id of every distinct fingerprint. Classes are linked by their fingerprints, ids are attached after."""
    classes = materialize(fps.groupBy("fp").agg(F.min(key).alias("least")))
    found = components(links(classes.select(F.col("fp").alias("root"), "fp"), most, n_pivots))
    named = materialize(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "root").select("fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, in it; rows with a null id stay.

    Rows go by id and text, so a row that repeats an id with a text of another component stands for itself.
    """
    own = hidden(docs, "hash", "doc")
    held = docs.withColumns({own["hash"]: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), own["doc"]: F.col(key).cast("long")})
    cols = docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    fps = materialize(fingerprints(cols.withColumn("hash", F.xxhash64("text")), "text", "doc", how.get("words_per_shingle", 3), "hash"))
    named = named_classes(fps, "doc", how.get("most", 3), how.get("n_pivots", 16))
    gone = fps.join(named, "fp").filter(F.col("doc") != F.col("component_id")).select("doc", "hash").distinct()
    return held.join(gone, (held[own["doc"]] == gone["doc"]) & (held[own["hash"]] == gone["hash"]), "left_anti").select(*docs.columns)


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
