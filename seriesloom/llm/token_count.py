"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_streams, partitions, text_or_empty, worker_state
from .tokens import PieceEncoder, tokenizer_path

#: Entries of the broadcast table. A pre-token group is what one space leads, see ``tokens``.
FREQUENT = 16_384
#: Entries that a task, or a merge of tasks' summaries, keeps while it counts.
SUMMARY = 8_192
#: Lengths that a worker remembers besides the table.
HELD = 300_000


def frequent_pieces(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent space-led pieces of all texts, by lossy counting.

    Each task sends one summary of a bounded size; summaries are merged in two rounds, and at most eight reach the driver.
    What a summary loses is looked up by the workers later, so only speed depends on it.
    """

    def trim(seen: Counter) -> Counter:
        return Counter(dict(seen.most_common(SUMMARY)))

    def summary(seen: Counter) -> pa.RecordBatch:
        top = trim(seen)
        return pa.RecordBatch.from_arrays([pa.array([list(top)], pa.list_(pa.string())), pa.array([list(top.values())], pa.list_(pa.int64()))], names=["pieces", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen.update(body.split(" ")[1:])
                if len(seen) > 16 * SUMMARY:
                    seen = trim(seen)
        yield summary(seen)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                seen.update(dict(zip(row["pieces"], row["counts"])))
                if len(seen) > 16 * SUMMARY:
                    seen = trim(seen)
        yield summary(seen)

    schema = "pieces array<string>, counts array<long>"
    found = map_streams(docs.select(text_or_empty(text)), count, schema)
    for width in (partitions(docs.sparkSession), 8):
        found = map_streams(found.repartition(width), merge, schema)
    total: Counter = Counter()
    for row in found.collect():
        total.update(dict(zip(row["pieces"], row["counts"])))
    return [p for p, _ in total.most_common(FREQUENT)]


def compact(lengths: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A table as one run of UTF-8 bytes, the pieces' ends, and their lengths in tokens."""
    raw = [p.encode() for p in lengths]
    return b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.uint32), np.fromiter(lengths.values(), np.uint32, len(lengths))


class Lengths(dict):
    """Tier one: the broadcast table. Tier two: what this worker had to encode, up to a bound."""

    def __init__(self, table: tuple[bytes, np.ndarray, np.ndarray], encoder: PieceEncoder):
        body, ends, lengths = table
        cuts = [0, *ends.tolist()]
        self.frequent = {body[a:b].decode(): n for a, b, n in zip(cuts, cuts[1:], lengths.tolist())}
        self.encoder = encoder
        super().__init__(self.frequent)

    def __missing__(self, piece: str) -> int:
        out = self[piece] = len(self.encoder.pieces[piece]) // 4
        return out

    def of(self, text: str) -> int:
        if self.encoder.kind == "whole" or (self.encoder.kind == "led" and "  " in text):
            return len(self.encoder.whole(text)) // 4
        if len(self) > HELD:
            self.clear()
            self.update(self.frequent)
            self.encoder.pieces.bound()
        head, *rest = text.split(" ")
        return (len(self.encoder.heads[head]) // 4 if head else 0) + sum(map(self.__getitem__, rest))


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row.

    Null texts count as empty: no bytes, no tokens. Special strings inside texts are what the library makes of them. Repeated
    rows and null keys give a row each; other columns are ignored; an empty table gives no rows.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    encoder = PieceEncoder(path)
    lengths = {p: len(encoder.pieces[p]) // 4 for p in frequent_pieces(docs, text)} if encoder.kind != "whole" else {}
    held = docs.sparkSession.sparkContext.broadcast(compact(lengths))
    number = held._jbroadcast.id()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = worker_state(("lengths", path, number), lambda: Lengths(held.value, PieceEncoder(path))).of
        n = [of(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    cols = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    return map_batches(cols, run, "key long, n_bytes long, n_tokens long").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
