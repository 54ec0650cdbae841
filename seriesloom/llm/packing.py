"""Packing token pieces into sequences: a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches, map_streams, partitions, text_or_empty
from .tokens import tokenizer_path, worker_encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: its ids and the end id. Only longer ones are cut, from the end on, so the first may be shorter."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, out = worker_encoder(path).blob, []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blob = memoryview(encode(text) + end)
            total, at = len(blob) // 4, 0
            size = (total - 1) % capacity + 1
            for k in range(-(-total // capacity)):
                out.append((doc, k, at, size, zlib.crc32(blob[4 * at : 4 * (at + size)])))
                at, size = at + size, capacity
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty()), pieces, PIECE)


class Stock:
    """Free items by length. ``below[x]`` is the greatest free length up to x, or 0."""

    def __init__(self, lengths: list[int], items: list[int], capacity: int):
        self.held: dict[int, list[int]] = {}
        for i in items:
            self.held.setdefault(lengths[i], []).append(i)
        self.count = np.zeros(capacity + 1, np.int64)
        for size, held in self.held.items():
            self.count[size] = len(held)
        self.below = np.maximum.accumulate(np.where(self.count > 0, np.arange(capacity + 1), 0))

    def take(self, size: int) -> int:
        self.count[size] -= 1
        if not self.count[size]:
            self.below[size : np.searchsorted(self.below, size, "right")] = self.below[size - 1]
        return self.held[size].pop()

    def shortest(self) -> int:
        return int(np.argmax(self.count > 0))

    def best_two(self, room: int, single: float, uneven: float, rng: random.Random) -> tuple[int, int]:
        """The lengths of one (the second is 0) or two items that fill the room best. Of several, by chance ``single`` a single one, then by
        chance ``uneven`` those with the longest item, else any."""
        one = np.flatnonzero(self.count[: room + 1])
        two = self.below[room - one]
        two = np.where((two == one) & (self.count[one] == 1), self.below[one - 1], two)
        best = np.flatnonzero(one + two == (one + two).max())
        k = best[-1] if rng.random() < (uneven if two[best[-1]] else single) else best[rng.randrange(len(best))]
        return int(one[k]), int(two[k])


class Grouping:
    """One chromosome: bins of item numbers. Fewer bins are better, then more uneven fill, which leaves room to save a bin."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins or []
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]

    def fitness(self) -> tuple[int, int]:
        return len(self.bins), -sum(f * f for f in self.fill)

    def best_fit(self, items: list[int]) -> Grouping:
        """Put each item, longest first as given, where the least room remains. One bit for each amount of room finds the bin."""
        room: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.fill):
            room.setdefault(self.capacity - f, []).append(b)
            mask |= 1 << (self.capacity - f)
        for i in items:
            size = self.lengths[i]
            if fits := mask >> size:
                left = size + (fits & -fits).bit_length() - 1
                held = room[left]
                b = held.pop()
                if not held:
                    mask &= ~(1 << left)
            else:
                b, left = len(self.bins), self.capacity
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(i)
            self.fill[b] += size
            room.setdefault(left - size, []).append(b)
            mask |= 1 << (left - size)
        return self

    def complete(self, items: list[int], rng: random.Random) -> Grouping:
        """Put the items into new bins: the longest free item, then free ones until one or two of them fill the bin exactly, if any do."""
        stock, single, uneven = Stock(self.lengths, [i for i in items if self.lengths[i]], self.capacity), rng.random(), rng.random()
        while first := int(stock.below[-1]):
            held, room = [stock.take(first)], self.capacity - first
            while longest := int(stock.below[room]):
                sizes = (longest,)
                if 2 * longest >= room:
                    one, two = stock.best_two(room, single, uneven, rng)
                    if one + two == room or room < 3 * stock.shortest():
                        sizes = (one, two)
                held += [stock.take(size) for size in sizes if size]
                room -= sum(sizes)
            self.bins.append(held)
            self.fill.append(self.capacity - room)
        return self.best_fit([i for i in items if not self.lengths[i]])

    def cross(self, other: Grouping, rng: random.Random) -> Grouping:
        """Inherit the fullest bins of both that share no item, lose a share of them by chance, then complete or best-fit what is free."""
        ranked = sorted(((-f, rng.random(), b) for parent in (self, other) for f, b in zip(parent.fill, parent.bins)))
        lost, taken, kept = rng.choice((0.02, 0.05, 0.1, 0.2)), set(), []
        for f, chance, b in ranked:
            if chance >= (lost if f == -self.capacity else 0.5) and taken.isdisjoint(b):
                taken.update(b)
                kept.append(list(b))
        child, free = Grouping(self.lengths, self.capacity, kept), [i for i in range(len(self.lengths)) if i not in taken]
        if rng.random() < 0.5:
            return child.complete(free, rng)
        return child.best_fit(sorted(free, key=lambda i: -self.lengths[i]))

    def assignment(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def from_assignment(lengths: list[int], capacity: int, bins: list[int]) -> Grouping:
    held: list[list[int]] = [[] for _ in range(max(bins) + 1)]
    for i, b in enumerate(bins):
        held[b].append(i)
    return Grouping(lengths, capacity, held)


def least_bins(lengths: list[int], capacity: int) -> int:
    """No grouping has fewer bins: the greatest of bound L2 of Martello and Toth and of Fekete and Schepers' dual feasible functions.

    For each ``small`` up to half a bin, items longer than a bin less ``small`` have a bin each and shorter ones than ``small`` are left
    out. L2: of the rest, items of more than half a bin share none; the others go into what room these leave, or need further bins. The
    functions: of the rest, an item longer than c parts of k + 1 of a bin counts as c / k of a bin, as k of them at most go together.
    """
    half, size = capacity // 2, np.arange(capacity + 1)
    count = np.bincount(lengths, minlength=capacity + 1)
    small = np.arange(half + 1)
    number, total = np.cumsum(count), np.cumsum(count * size)
    alone = number[-1] - number[capacity - small]

    def between(sums: np.ndarray, low: np.ndarray | int, high: np.ndarray | int) -> np.ndarray:
        return sums[high] - np.where(low > 0, sums[low - 1], 0)

    shared = between(number, half + 1, capacity - small)
    rest = between(total, small, half) - (shared * capacity - between(total, half + 1, capacity - small))
    least = (alone + shared + np.maximum(0, -(-rest // capacity))).max()
    for k in range(2, 21):
        parts = (k + 1) * size
        worth = np.cumsum(count * np.where(parts % capacity == 0, k * size, parts // capacity * capacity))
        least = max(least, (alone + -(-between(worth, small, capacity - small) // (k * capacity))).max())
    return int(least)


def evolve(lengths: list[int], capacity: int, seed: int, known: list[list[int]], population: int, generations: int) -> list[int]:
    """One epoch of an island: start from known groupings, best-fit decreasing and completions in random ways, then replace the worst by crossings.

    It ends at the lower bound, or when ``generations`` crossings in a row have saved no bin.
    """
    rng, n, least = random.Random(seed), len(lengths), least_bins(lengths, capacity)
    people = [from_assignment(lengths, capacity, k) for k in known]
    if not people:
        people.append(Grouping(lengths, capacity).best_fit(sorted(range(n), key=lambda i: -lengths[i])))
    best, idle = min(len(p.bins) for p in people), 0
    while best > least and idle < generations:
        if len(people) < population:
            people.append(Grouping(lengths, capacity).complete(list(range(n)), rng))
        else:
            people.sort(key=Grouping.fitness)
            a, b = sorted(rng.sample(range(len(people)), 2))
            child = people[a].cross(people[b], rng)
            if child.fitness() < people[-1].fitness():
                people[-1] = child
            idle += 1
        if (now := min(len(p.bins) for p in people)) < best:
            best, idle = now, 0
    return min(people, key=Grouping.fitness).assignment()


SHARD = "part long, number long, doc array<long>, piece array<int>, start array<long>, length array<int>, crc array<long>"


def shards(pieces: DataFrame, size: int) -> DataFrame:
    """Consecutive pieces of a task, ``size`` to a row; no shuffle, and a row's size has a bound whatever the keys are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())

        def row(rows: pa.Table) -> pa.RecordBatch:
            lists = [pa.array([rows.column(c).to_pylist()], pa.list_(t)) for c, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), *lists], names=["part", "number", "doc", "piece", "start", "length", "crc"])

        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            while held.num_rows >= size:
                yield row(held.slice(0, size))
                held, number = held.slice(size), number + 1
        if held and held.num_rows:
            yield row(held)

    dealt = materialize(map_streams(pieces, run, SHARD))
    # One row for each task: shards are numbered without gaps, so that ids stay small whatever the number of tasks.
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.join(before, "part").withColumn("shard", F.col("before") + F.col("number")).drop("part", "number", "before")


def pack(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = 4096, islands: int = 2, population: int = 6, generations: int = 100) -> DataFrame:
    """``pieces`` (see PIECE, none longer than ``capacity``) with sequence_id and offset.

    Shards are packed apart (``pack_shards``). The pieces of sequences with more than ``capacity`` / 32 free then come together in new, full
    shards and are packed again, until they fit one shard or the number of their sequences doesn't shrink, so that the result hardly
    depends on how the rows lie in partitions. Of both packings of a round the one with fewer sequences counts.
    """
    how = (capacity, shard_pieces, islands, population, generations)
    packed = materialize(pack_shards(pieces, *how))
    done, base = [], 0
    while True:
        fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("n"))
        low = materialize(fills.filter(F.col("fill") < capacity - capacity // 32))
        before, n = low.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        top = packed.agg(F.max("sequence_id")).first()[0]
        if before < 2 or top // shard_pieces == base // shard_pieces:
            break
        loose = packed.join(low.select("sequence_id"), "sequence_id")
        again = loose.drop("sequence_id", "offset").repartition(max(1, n // shard_pieces), F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
        base = (top // shard_pieces + 1) * shard_pieces
        new = materialize(pack_shards(again, *how).withColumn("sequence_id", F.col("sequence_id") + base))
        if new.select("sequence_id").distinct().count() >= before:
            break
        done.append(packed.join(low.select("sequence_id"), "sequence_id", "left_anti"))
        packed = new
    cols = [c.split()[0] for c in PIECE.split(", ")] + ["sequence_id", "offset"]
    return reduce(DataFrame.unionByName, [part.select(*cols) for part in [*done, packed]])


def pack_shards(pieces: DataFrame, capacity: int, shard_pieces: int, islands: int, population: int, generations: int) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed shard by shard; ids of a shard lie between its number times ``shard_pieces`` and the next.

    Pieces are dealt into shards of a bounded size. On each shard ``islands`` populations evolve apart for an epoch; then every
    island's best grouping migrates to the next island of its shard, by a join, and the next epoch starts from both. A shard
    is done when it has no more sequences than its lower bound, or when a whole epoch has saved none. The best island's
    grouping counts. Pieces of full length fill a sequence of their own. Ties, nulls in ids and repeated rows
    don't matter: items are numbered inside their shard. An empty table gives an empty result.
    """
    dealt = materialize(shards(pieces, shard_pieces))
    state = dealt.select("shard", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.withColumns({"own": F.lit(None).cast("array<int>"), "guest": F.lit(None).cast("array<int>"), "before": F.lit(None).cast("int")})
    done, epoch = [], 0
    while True:

        def step(batch: pa.RecordBatch, epoch=epoch) -> pa.RecordBatch:
            best, bins, least = [], [], []
            for r in batch.to_pylist():
                seed = hash((r["shard"], r["island"], epoch))
                best.append(evolve(r["length"], capacity, seed, [x for x in (r["own"], r["guest"]) if x], population, generations))
                bins.append(max(best[-1]) + 1)
                least.append(least_bins(r["length"], capacity))
            columns = [*(batch.column(c) for c in ("shard", "island", "length", "before")), pa.array(best, pa.list_(pa.int32())), pa.array(bins, pa.int32()), pa.array(least, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "island", "length", "before", "own", "bins", "least"])

        spread = state.repartition(partitions(state.sparkSession), "shard", "island")
        after = "shard long, island int, length array<int>, before int, own array<int>, bins int, least int"
        state = materialize(map_batches(spread.select("shard", "island", "length", "own", "guest", "before"), step, after))
        shard = state.groupBy("shard").agg(F.min("bins").alias("best"), F.min_by("own", F.struct("bins", "island")).alias("bin"), F.max("least").alias("least"), F.max("before").alias("was"))
        more = (F.col("best") > F.col("least")) & (F.col("was").isNull() | (F.col("best") < F.col("was")))
        done.append(shard.filter(~more).select("shard", "bin"))
        going = shard.filter(more).select("shard", F.col("best").alias("before"))
        if going.isEmpty():
            break
        elite = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("own").alias("guest"))
        state, epoch = state.drop("before").join(going, "shard").join(elite, ["shard", "island"]), epoch + 1
    won = reduce(DataFrame.unionByName, done)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in batch.to_pylist():
            used: dict[int, int] = {}
            for doc, piece, start, length, crc, b in zip(r["doc"], r["piece"], r["start"], r["length"], r["crc"], r["bin"]):
                rows.append((doc, piece, start, length, crc, r["shard"] * shard_pieces + b, used.get(b, 0)))
                used[b] = used.get(b, 0) + length
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return map_batches(dealt.join(won, "shard"), place, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, **how) -> DataFrame:
    """Encode, cut and pack whole texts; null texts count as empty, so they give the end id alone. Other columns are ignored."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    return pack(cut_documents(docs, path, capacity, end_id), capacity, **how)
