"""Phrase collocations from weighted acyclic automata of n-gram counts."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches, map_streams, partitions, text_or_empty
from .resample import ranked

#: Words after which a shard is closed: its counts become automata, so a task's memory doesn't grow with its input. Long texts count on.
SHARD_WORDS = 2_000_000
#: Texts that are split into words at a time.
ADDED = 1000
#: The bounds of the prefix ranges come from about so many texts, so many runs of words of each, and so many runs in all, cut to so many bytes.
#: They only balance the ranges; every text is counted.
BOUND_DOCS, BOUND_RUNS, BOUND_KEYS, BOUND_BYTES = 20_000, 8, 16_384, 48
#: Bits of the filters: 16 for each n-gram that can be part of a phrase, as counted, and never more than 16 MB. Beyond that a filter lets more through; counts stay exact.
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: Tab is a space, stops and line ends are line ends, A-Z are small; all other bytes belong to words.
PIECES = bytes(32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


class CountAutomaton:
    """A minimal weighted acyclic automaton: the weights along a path add up to the count of its words.

    States are numbered from the leaves; state s has the arcs ``first[s]`` to ``first[s + 1]``, in ascending order of their labels (numbers
    of ``words``), each with a target and a weight, and a weight ``final[s]`` (-1: no n-gram ends there). The last state is the first to walk.
    """

    def __init__(self, words: list[bytes], first, label, target, weight, final):
        self.words, self.first, self.label, self.target, self.weight, self.final = words, first, label, target, weight, final

    @classmethod
    def build(cls, grams: Iterable[tuple[tuple[bytes, ...], int]]) -> CountAutomaton:
        """Incrementally from n-grams in ascending order: a state is closed, and merged with one of equal arcs, when the next n-gram leaves it.

        What all n-grams through a state have at least in common moves to the arc before it, so that states whose counts differ by
        a constant are one.
        """
        known: dict = {((), 0): 0}
        states: list = [((), 0)]
        numbers: dict[bytes, int] = {}

        def close(node: list) -> tuple[int, int]:
            arcs, final = node
            if not arcs:
                return 0, final
            least = min([w for _, _, w in arcs] + ([final] if final >= 0 else []), default=0)
            key = (tuple((a, t, w - least) for a, t, w in arcs), final - least if final >= 0 else -1)
            at = known.get(key)
            if at is None:
                at = known[key] = len(states)
                states.append(key)
            return at, least

        stack: list = [[[], -1]]
        last: tuple = ()
        for gram, count in grams:
            same = 0
            for a, b in zip(last, gram):
                if a != b:
                    break
                same += 1
            while len(stack) > same + 1:
                at, least = close(stack.pop())
                stack[-1][0].append((numbers.setdefault(last[len(stack) - 1], len(numbers)), at, least))
            for _ in gram[same:]:
                stack.append([[], -1])
            stack[-1][1] = count
            last = gram
        while len(stack) > 1:
            at, least = close(stack.pop())
            stack[-1][0].append((numbers.setdefault(last[len(stack) - 1], len(numbers)), at, least))
        states.append((tuple(stack[0][0]), stack[0][1]))
        return cls(list(numbers), *cls._arrays(states))

    @classmethod
    def build_rows(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> CountAutomaton:
        """The same for n-grams of one length as columns of word places (from 1), in ascending order: a prefix closes its state with all its arcs at once."""
        used, label = np.unique(rows, return_inverse=True)
        label = label.reshape(rows.shape)
        known: dict[bytes, int] = {b"": 0}  # a state by its arcs: label, target and weight of each
        target, weight = np.zeros(rows.shape[1], np.int64), np.asarray(counts, np.int64)
        for depth in range(len(rows) - 1, 0, -1):
            new = np.append(True, (label[:depth, 1:] != label[:depth, :-1]).any(axis=0))
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(weight, first)
            raw = np.stack([label[depth], target, weight - least[np.cumsum(new) - 1]], axis=1).tobytes()
            cuts = [*(24 * first).tolist(), len(raw)]
            target = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(cuts, cuts[1:])], np.int64)
            label, weight = label[:depth, new], least
        blocks = [*known, np.stack([label[0], target, weight], axis=1).tobytes()]
        flat = np.frombuffer(b"".join(blocks), np.int64).reshape(-1, 3)
        sizes = [len(x) // 24 for x in blocks]
        final = np.full(len(blocks), -1)
        final[0] = 0
        return cls([words[k - 1] for k in used.tolist()], np.cumsum([0, *sizes], dtype=np.int64), flat[:, 0], flat[:, 1], flat[:, 2], final)

    @staticmethod
    def _arrays(states: list) -> tuple[np.ndarray, ...]:
        first = np.cumsum([0, *(len(arcs) for arcs, _ in states)], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(arcs for arcs, _ in states)), np.int64).reshape(-1, 3)
        return first, flat[:, 0], flat[:, 1], flat[:, 2], np.array([f for _, f in states], np.int64)

    def grams(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """All n-grams with their counts, in ascending order."""
        first, label, target, weight, final = (x.tolist() for x in (self.first, self.label, self.target, self.weight, self.final))
        words = self.words

        def walk(state: int, path: tuple, total: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
            if final[state] >= 0:
                yield path, total + final[state]
            for k in range(first[state], first[state + 1]):
                to, step = target[k], (*path, words[label[k]])
                if first[to] == first[to + 1]:
                    yield step, total + weight[k] + final[to]
                else:
                    yield from walk(to, step, total + weight[k])

        return walk(len(final) - 1, (), 0) if len(self.label) else iter(())

    def compose(self, asked: CountAutomaton) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """The counts of the n-grams that ``asked`` accepts too: both automata walk the same words at once."""
        number = {w: k for k, w in enumerate(self.words)}
        shared = [number.get(w, -1) for w in asked.words]

        def walk(mine: int, its: int, path: tuple, total: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
            if asked.final[its] >= 0 and self.final[mine] >= 0:
                yield path, total + int(self.final[mine])
            a, b = self.first[mine], self.first[mine + 1]
            arcs = arc_of(mine, a, b)
            for k in range(asked.first[its], asked.first[its + 1]):
                at = arcs.get(shared[asked.label[k]])
                if at is not None:
                    yield from walk(int(self.target[at]), int(asked.target[k]), (*path, asked.words[asked.label[k]]), total + int(self.weight[at]))

        held: dict[int, dict[int, int]] = {}

        def arc_of(state: int, a: int, b: int) -> dict[int, int]:
            if state not in held:
                held[state] = dict(zip(self.label[a:b].tolist(), range(a, b)))
            return held[state]

        return walk(len(self.final) - 1, len(asked.final) - 1, (), 0)

    def dumps(self) -> bytes:
        parts = [b"\n".join(self.words), *(x.astype("<i4").tobytes() for x in (self.first, self.label, self.target)), self.weight.astype("<i8").tobytes(), self.final.astype("<i8").tobytes()]
        return zlib.compress(struct.pack("<6q", *map(len, parts)) + b"".join(parts), 1)

    @classmethod
    def loads(cls, blob: bytes) -> CountAutomaton:
        raw = zlib.decompress(blob)
        sizes, at, parts = struct.unpack_from("<6q", raw), 48, []
        for n in sizes:
            parts.append(raw[at : at + n])
            at += n
        kinds = ("<i4", "<i4", "<i4", "<i8", "<i8")
        return cls(parts[0].split(b"\n"), *(np.frombuffer(p, k) for p, k in zip(parts[1:], kinds)))


class Shard:
    """Words of one language as numbers, as they come; word 0 ends a piece."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, texts: list[str]) -> None:
        raw = "\n".join(texts).encode().translate(PIECES).replace(b"\n", b" \n ")
        coded = pc.split_pattern(pa.array([raw + b" \n"], pa.large_binary()), " ").flatten().dictionary_encode()
        known = self.numbers
        numbers = np.array([known.setdefault(w, len(known)) if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
        found = numbers[coded.indices.to_numpy()]
        self.parts.append(found[found >= 0])
        self.words += len(self.parts[-1])

    def ranked(self) -> tuple[list[bytes], np.ndarray]:
        """The words in ascending order (from 1), and the text as places in that order; 0 ends a piece."""
        words = sorted(w for w in self.numbers if w != b"\n")
        place = np.zeros(len(self.numbers), np.int64)
        place[[self.numbers[w] for w in words]] = np.arange(1, len(words) + 1)
        return words, place[np.concatenate(self.parts)]


def gram_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter([xxh64_intdigest(w) for w in words], np.uint64, len(words))


def join_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    out = hashes[0]
    for h in hashes[1:]:
        out = (out * MIX) ^ h
        out = out ^ (out >> np.uint64(29))
    return out


class GramFilter:
    """Bits of n-grams that can be part of a phrase. It never denies one of them."""

    def __init__(self, n: int):
        self.size = min(MOST_BITS, 1 << max(10, (FILTER_BITS * n - 1).bit_length()))
        self.bits = np.zeros(self.size // 8, np.uint8)

    def slots(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [(hashes * np.uint64(k)) >> np.uint64(64 - self.size.bit_length() + 1) for k in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, [(self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool) for slot in self.slots(hashes)])


def shard_grams(shard: Shard, lang: str, n: int, allowed) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a shard, and its n-grams as columns of word places in ascending order with their counts.

    Both (n-1)-grams of a longer one must pass the filter.
    """
    words, seq = shard.ranked()
    size = len(words) + 1
    if n == 1:
        return words, np.arange(1, size)[None], np.bincount(seq, minlength=size)[1:]
    at = np.arange(len(seq) - n + 1)
    for k in range(n):
        at = at[seq[at + k] > 0]
    salt = np.uint64(zlib.crc32(lang.encode()))
    hashes = np.append(np.uint64(0), gram_hashes(words)) ^ salt
    if n == 2:  # each word once
        fine = allowed.passed(hashes)
        at = at[fine[seq[at]] & fine[seq[at + 1]]]
    else:
        for k in (0, 1):
            at = at[allowed.passed(join_hashes([hashes[seq[at + k + j]] for j in range(n - 1)]))]
    if size**n < 1 << 63:  # a gram is one number
        code = reduce(lambda c, k: c * size + seq[at + k], range(1, n), seq[at])
        code, counts = np.unique(code, return_counts=True)
        return words, np.stack([code // size ** (n - 1 - k) % size for k in range(n)]), counts
    rows, counts = np.unique(np.stack([seq[at + k] for k in range(n)]), axis=1, return_counts=True)
    return words, rows, counts


def shards(docs: DataFrame, n: int, allowed, bounds, shard_words: int) -> DataFrame:
    """Count automata of the texts' n-grams, one row per shard, language and prefix range; n_words counts a shard's words once.

    ``docs``: lang, text.
    """

    def close(lang: str, shard: Shard) -> Iterator[tuple]:
        names, rows, counts = shard_grams(shard, lang, n, allowed.value if allowed else None)
        words = int(sum(np.count_nonzero(p) for p in shard.parts)) if n == 1 else 0
        cuts, total = bounds.value.get(lang, []), rows.shape[1]
        gram = lambda i: tuple(names[k - 1] for k in rows[:, i].tolist())
        at = [0, *(bisect_left(range(total), cut, key=gram) for cut in cuts), total]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            if a < b or (words and k == len(cuts)):
                made = CountAutomaton.build_rows(names, rows[:, a:b], counts[a:b]) if a < b else CountAutomaton.build([])
                yield lang, k, made.dumps(), words
                words = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            for row in close(lang, open_.pop(lang)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.binary(), pa.int64()))], names=["lang", "section", "automaton", "n_words"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for lang, body in zip(langs, texts):
                by.setdefault(lang, []).append(body)
            for lang, bodies in by.items():
                for at in range(0, len(bodies), ADDED):
                    shard = open_.setdefault(lang, Shard())
                    shard.add(bodies[at : at + ADDED])
                    if shard.words >= shard_words:
                        yield from rows(lang)
            while open_ and sum(s.words for s in open_.values()) > shard_words:  # many languages in one task
                yield from rows(max(open_, key=lambda k: open_[k].words))
        for lang in list(open_):
            yield from rows(lang)

    return map_streams(docs, run, "lang string, section int, automaton binary, n_words long")


def section(cuts: list[tuple[bytes, ...]], gram: tuple[bytes, ...]) -> int:
    """The prefix range of an n-gram: the number of bounds that are not beyond it."""
    return bisect_right(cuts, gram)


def unions(parts: DataFrame, least: int) -> DataFrame:
    """One automaton for each language and range: shards are read one by one, and sums below ``least`` go. n_words are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, words = None, {}, 0

        def row() -> pa.RecordBatch:
            grams = sorted((g, c) for g, c in total.items() if c >= least)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            made = (*key, words, len(grams), CountAutomaton.build(grams).dumps())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, kinds)], names=["lang", "section", "n_words", "n", "automaton"])

        for batch in batches:
            for at in range(batch.num_rows):
                lang, k, own, blob = (batch.column(c)[at].as_py() for c in range(4))
                if (lang, k) != key:
                    if key:
                        yield row()
                    key, total, words = (lang, k), {}, 0
                words += own
                for gram, count in CountAutomaton.loads(blob).grams():
                    total[gram] = total.get(gram, 0) + count
        if key:
            yield row()

    cols = parts.select("lang", "section", "n_words", "automaton").repartition(partitions(parts.sparkSession), "lang", "section").sortWithinPartitions("lang", "section")
    return map_streams(cols, run, "lang string, section int, n_words long, n long, automaton binary")


def range_bounds(docs: DataFrame, ranges: int, longest: int) -> dict[str, list[tuple[bytes, ...]]]:
    """For each language the keys that cut its n-grams into prefix ranges, by occurrences in a bounded draw of texts."""
    rate = min(1.0, BOUND_DOCS / max(1, docs.count()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, keys = [], []
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = body.encode().translate(PIECES).replace(b"\n", b" ").split(b" ")
            for k in range(BOUND_RUNS):
                at = k * len(words) // BOUND_RUNS
                if words[at]:
                    langs.append(lang)
                    keys.append(b" ".join(words[at : at + longest])[:BOUND_BYTES])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.binary())], names=["lang", "key"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    drawn = map_batches(some, run, "lang string, key binary").orderBy(F.xxhash64("lang", "key")).limit(BOUND_KEYS).collect()
    by: dict[str, list[tuple[bytes, ...]]] = {}
    for r in drawn:
        by.setdefault(r["lang"], []).append(tuple(bytes(r["key"]).split(b" ")))
    out = {}
    for lang, keys in by.items():
        keys.sort()
        n = ranges * len(keys) // len(drawn)
        out[lang] = sorted({keys[k * len(keys) // (n + 1)] for k in range(1, n + 1)})
    return out


def gram_filter(found: DataFrame) -> GramFilter:
    """The filter of all n-grams of the union automata; at most MOST_BITS / 64 numbers reach the driver."""
    out = GramFilter(found.agg(F.sum("n")).first()[0] or 0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = []
        for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            automaton = CountAutomaton.loads(blob)
            number, salt = {w: k for k, w in enumerate(automaton.words)}, np.uint64(zlib.crc32(lang.encode()))
            hashes = gram_hashes(automaton.words) ^ salt
            grams = np.array([[number[w] for w in g] for g, _ in automaton.grams()], np.int64)
            if len(grams):
                at += out.slots(join_hashes([hashes[c] for c in grams.T]))
        slots = np.unique(np.concatenate(at)) if at else np.zeros(0, np.uint64)
        cell, first = np.unique(slots >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first) if len(slots) else slots
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(bits.view(np.int64))], names=["cell", "bits"])

    cells = map_batches(found.select("lang", "automaton"), run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.bits.view("<u8")[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def part_counts(asked: DataFrame, counted: DataFrame, bounds) -> DataFrame:
    """lang, part, f: the counts of the asked n-grams, by composing an automaton of them with the count automaton of their range.

    ``asked``: lang, part, distinct. ``counted``: lang, size, section, automaton.
    """

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        grams = [tuple(p.encode().split(b" ")) for p in parts]
        at = [section(bounds.value.get(lang, []), g) for lang, g in zip(langs, grams)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in grams], pa.int32()), pa.array(at, pa.int32()), batch.column(1)], names=["lang", "size", "section", "part"])

    placed = map_batches(asked.select("lang", "part"), place, "lang string, size int, section int, part string").withColumn("automaton", F.lit(None).cast("binary"))
    held = counted.select("lang", F.col("size").cast("int"), "section", F.lit(None).cast("string").alias("part"), "automaton")
    keys = ["lang", "size", "section"]
    rows = placed.unionByName(held).repartition(partitions(asked.sparkSession), *keys).sortWithinPartitions(*keys, F.col("part").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, wanted = None, None, []

        def answers() -> pa.RecordBatch:
            asked = CountAutomaton.build((g, 0) for g in sorted(wanted))
            found = list(automaton.compose(asked)) if automaton and wanted else []
            names, counts = [b" ".join(g).decode() for g, _ in found], [c for _, c in found]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["lang", "part", "f"])

        for batch in batches:
            *place, parts, blobs = (c.to_pylist() for c in batch.columns)
            for at, part, blob in zip(zip(*place), parts, blobs):
                if at != key:
                    if key:
                        yield answers()
                    key, automaton, wanted = at, None, []
                if part is None:
                    automaton = CountAutomaton.loads(blob)
                else:
                    wanted.append(tuple(part.encode().split(b" ")))
        if key:
            yield answers()

    return map_streams(rows.select(*keys, "part", "automaton"), run, "lang string, part string, f long")


def candidates(counted: DataFrame) -> DataFrame:
    """lang, phrase, a (its count), cuts (k, first, rest) and inner (shorter phrases inside) of every n-gram of the automata."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for gram, count in CountAutomaton.loads(blob).grams():
                words = [w.decode() for w in gram]
                n = len(words)
                cuts = [{"k": k, "first": " ".join(words[:k]), "rest": " ".join(words[k:])} for k in range(1, n)]
                inner = list({" ".join(words[i : i + m]) for m in range(2, n) for i in range(n - m + 1)})
                rows.append((lang, " ".join(words), count, cuts, inner))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("k", pa.int32()), ("first", pa.string()), ("rest", pa.string())])), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["lang", "phrase", "a", "cuts", "inner"])

    schema = "lang string, phrase string, a long, cuts array<struct<k: int, first: string, rest: string>>, inner array<string>"
    return map_batches(counted.select("lang", "automaton"), run, schema)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of 2 to ``longest`` words of each language, with at least ``least`` occurrences.

    Texts are split at stops and line ends, then at spaces and tabs, A-Z in lower case. Tasks count n-grams in shards of a bounded number of words and
    send each shard as automata, one per prefix range; a range's automata are added up. Round n counts only n-grams whose two
    (n-1)-grams occur ``least`` times, which a phrase's parts always do; a filter of a bounded size says so, and lets some others through, whose sums
    fall below ``least``. Counts of phrases and parts are exact. A phrase's score is that of its weakest cut, floor(10^6 a a / (l r)), ties
    to the smallest k; it is exact while 10^6 a a has at most 38 digits. Phrases inside a longer candidate of ``percent`` of
    their count or more go. Order: score, count, then the phrase by bytes. Null texts count as empty, a null language as ``und``;
    repeated rows count each; other columns are ignored; an empty table, or one without phrases, gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    bounds = spark.sparkContext.broadcast(range_bounds(rows, 2 * partitions(spark), longest))
    counted, allowed = [], None
    for n in range(1, longest + 1):
        counted.append(materialize(unions(shards(rows, n, allowed, bounds, shard_words), least)))
        if n < longest:
            allowed = spark.sparkContext.broadcast(gram_filter(counted[-1]))
    found = materialize(candidates(reduce(DataFrame.unionByName, counted[1:])))
    parts = found.select("lang", "phrase", "a", F.explode("cuts").alias("c")).select("lang", "phrase", "a", "c.*")
    asked = parts.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    sized = reduce(DataFrame.unionByName, [c.withColumn("size", F.lit(k + 1)) for k, c in enumerate(counted[:-1])])
    known = materialize(part_counts(asked, sized, bounds))
    left, right = known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    big = {c: f"cast({c} as decimal(19,0))" for c in "alr"}
    score = F.expr(f"({big['a']} * {big['a']} * cast(1000000 as decimal(7,0))) div ({big['l']} * {big['r']})")
    cut = parts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    longer = found.select("lang", F.explode("inner").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    kept = materialize(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", (-F.col("cut.score")).alias("_score"), (-F.col("a")).alias("_a")))
    placed = materialize(ranked(kept, ["lang", "_score", "_a", "phrase"], "place"))
    firsts = placed.groupBy("lang").agg(F.min("place").alias("first"))
    best = placed.join(firsts, "lang").withColumn("rank", F.col("place") - F.col("first") + 1).filter(F.col("rank") <= top)
    words = counted[0].groupBy("lang").agg(F.sum("n_words").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
