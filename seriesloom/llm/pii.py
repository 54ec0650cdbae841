"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed forms find (email, ip, card, phone). The words around seeds become patterns; patterns and instances form
a graph that Spark scores in rounds; patterns of high confidence discover identifiers that no form covers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile("[0-9@]")

#: Further candidates: runs of digits and signs, and addresses with an at sign or a word for it.
NUMBER = re.compile(r"[0-9(+][0-9 ().:/-]*+")
NUMBER_ENDS = " ().:/-+"
PLACE = re.compile(r" ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9][A-Za-z0-9.-]*")
#: What a context is made of: runs of letters, or one sign.
CONTEXT = re.compile(r"[^\W\d_]+|[^\w\s]")
#: Characters on either side in which context is looked for.
REACH = 48


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part reaches back as far as it can, but not into the match before."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers, four parts at a time, each part at most 255."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, in order of start, then of KINDS."""
    if not SIGN.search(text):
        return []
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    out += [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def shapes(value: str) -> int:
    """Bits of the kinds that an unseen identifier may be, by its form alone."""
    n, out = len(digits_of(value)), 0
    if "@" in value or "at" in value:
        return 1
    if value.count(".") >= 3 or value.count(":") >= 2:
        out |= 2
    if 12 <= n <= 19:
        out |= 4
    if 7 <= n <= 15:
        out |= 8
    return out


def numbers(text: str) -> list[tuple[int, int]]:
    """Runs of digits and signs from a digit or an opening sign to a digit, seven characters or more, however long."""
    found = ((m.start(), m.start() + len(m[0].rstrip(NUMBER_ENDS))) for m in NUMBER.finditer(text))
    return [(a, b) for a, b in found if b - a >= 7]


def written_addresses(text: str) -> list[tuple[int, int]]:
    """Addresses with an at sign or a word for it; the local part reaches back as far as it can, but not into the one before."""
    out, free = [], 0
    for m in PLACE.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        while start < m.start() and text[start] in "._%+-":
            start += 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, shapes) of further candidates that touch no base span."""
    if not SIGN.search(text) and "at" not in text:
        return []
    found = numbers(text)
    if "@" in text or "at)" in text or "at]" in text:
        found += written_addresses(text)
    taken, out, k, free = sorted((a, b) for a, _, b in base), [], 0, 0
    for a, b in sorted(found):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k < len(taken) and taken[k][0] < b) or a < free:
            continue
        if kinds := shapes(text[a:b]):
            out.append((a, b, kinds))
            free = b
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns that a place supports: the two tokens before it, and the tokens on either side."""
    left = CONTEXT.findall(text[max(0, start - REACH) : start].lower())[-2:]
    right = CONTEXT.findall(text[end : end + REACH].lower())[:1]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[1] if len(left) > 1 else left[0]} _ {right[0]}")
    return out


PLACES = "array<struct<start: int, end: int, kind: int, shapes: int, inst: long, patterns: array<string>>>"


def places(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: row number, key, and its seeds (kind 0 to 3) and candidates (kind -1) with their contexts."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("shapes", pa.int32()), ("inst", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        def place(body: str, a: int, b: int, k: int, s: int) -> dict:
            inst = xxh64_intdigest(f"{body[a:b]}") - (1 << 63)
            return {"start": a, "end": b, "kind": k, "shapes": s, "inst": inst, "patterns": contexts(body, a, b)}

        out = []
        for body in batch.column(2).to_pylist():
            base = base_spans(body)
            out.append([*(place(body, a, b, k, 1 << k) for a, k, b in base), *(place(body, a, b, -1, s) for a, b, s in candidate_spans(body, base))])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["row", "key", "places"])

    cols = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), text_or_empty(text))
    return map_batches(cols, run, f"row long, key long, places {PLACES}")


def wilson(hits: Column, n: Column, z: float) -> Column:
    """An end of Wilson's interval for a share: the lower one for a positive ``z``, the upper one for a negative."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def bootstrap(found: DataFrame, support: int = 5, confidence: float = 0.6, z: float = 1.645) -> tuple[DataFrame, DataFrame]:
    """Score the graph of patterns and instances until nothing changes. Returns (pattern, kind, confidence) and (inst, kind, score), both new ones only.

    Seeds count 1, discovered instances their score, in the kind they are known as; the others are unlabelled. A pattern's
    confidence in a kind is the lower bound of the share of that kind among its known instances and its contradicted ones:
    unlabelled instances of the form that also stand in a context which denies the kind. A pattern denies a kind if it has
    ``support`` known instances and the upper bound of the kind's share of them is below a half. A pattern counts if it has
    ``support`` distinct known instances of the kind and reaches ``confidence``, which 5 seeds without a contradiction do (0.65);
    not if the upper bound of the kind's share of all instances, unlabelled ones included, is below a half. An instance scores as its best pattern. Patterns that count stay, so rounds end.
    Copies of a place count once. Frequent patterns and instances are combined on the map side, and joins put edges on the left.
    """
    spots = found.select(F.explode("places").alias("p")).select("p.inst", "p.kind", "p.shapes", F.explode("p.patterns").alias("pattern"))
    by_kind = spots.select("pattern", "inst", F.when(F.col("kind") >= 0, F.array("kind")).otherwise(F.filter(F.array(*[F.when(F.col("shapes").bitwiseAND(1 << k) > 0, k) for k in range(4)]), lambda x: x.isNotNull())).alias("kinds"), (F.col("kind") >= 0).cast("int").alias("seed"))
    edges = materialize(by_kind.select("pattern", "inst", "seed", F.explode("kinds").alias("kind")).groupBy("pattern", "inst", "kind").agg(F.max("seed").alias("seed")))
    spark = found.sparkSession
    known = spark.createDataFrame([], "inst long, kind int, score double")
    strong = spark.createDataFrame([], "pattern string, kind int, confidence double")
    while True:
        labelled = edges.join(known.select("inst", F.col("kind").alias("as"), F.col("score").alias("_score")), "inst", "left")
        score = F.when(F.col("seed") == 1, 1.0).when(F.col("as") == F.col("kind"), F.col("_score")).otherwise(0.0)
        scored = labelled.select("pattern", "inst", "kind", score.alias("score"), ((F.col("seed") == 0) & F.col("as").isNull()).alias("open"))
        sums = []
        for k in range(len(KINDS)):
            own = F.col("kind") == k
            sums += [F.sum(F.when(own, F.col("score")).otherwise(0.0)).alias(f"hits{k}"), F.count_if(own & (F.col("score") > 0)).alias(f"known{k}"), F.count_if(own & F.col("open")).alias(f"open{k}")]
        every = sum((F.col(f"known{k}") for k in range(1, len(KINDS))), F.col("known0"))
        each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"hits{k}").alias("hits"), F.col(f"known{k}").alias("known"), F.col(f"open{k}").alias("open"), every.alias("every")) for k in range(len(KINDS))])
        stats = scored.groupBy("pattern").agg(*sums).select("pattern", F.inline(each)).filter("known + open > 0")
        every, met = F.col("every").cast("double"), (F.col("every") + F.col("open")).cast("double")
        denies = F.when(F.col("every") >= support, wilson(F.col("hits"), every, -z) < 0.5).otherwise(F.lit(False))
        stats = materialize(stats.withColumns({"denies": denies, "rare": wilson(F.col("hits"), met, -z) < 0.5}))
        denied = scored.filter("open").join(stats.filter("denies").select("pattern", "kind"), ["pattern", "kind"]).select("inst", "kind").distinct()
        against = scored.filter("open").join(denied, ["inst", "kind"]).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("against"))
        able = stats.filter(~F.col("rare") & (F.col("known") >= support)).join(against, ["pattern", "kind"], "left")
        share = wilson(F.col("hits"), (F.col("every") + F.coalesce("against", F.lit(0))).cast("double"), z)
        fresh = materialize(able.select("pattern", "kind", share.alias("confidence")).filter(F.col("confidence") >= confidence).join(strong, ["pattern", "kind"], "left_anti"))
        if fresh.isEmpty():
            return strong, known
        strong = materialize(strong.unionByName(fresh))
        reached = edges.filter("seed = 0").join(strong, ["pattern", "kind"]).groupBy("inst").agg(F.max(F.struct(F.col("confidence").alias("score"), (-F.col("kind")).alias("k"))).alias("best"))
        known = materialize(reached.select("inst", (-F.col("best.k")).alias("kind"), "best.score"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """key, base (array of start, kind, end) and spans (base and discovered ones, in the same order) of every row.

    A discovered span takes the kind of its best pattern, ties the first of KINDS. Null texts count as empty and have no
    spans; repeated rows give repeated results, null keys are kept, other columns are ignored, an empty table gives no rows.
    """
    found = materialize(places(docs, text, key))
    _, known = bootstrap(found, **how)
    best = known.select("inst", "kind")
    spots = found.select("row", F.explode("places").alias("p")).filter("p.kind < 0").select("row", "p.start", "p.end", "p.inst")
    new = spots.join(best, "inst").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    base = F.transform(F.filter("places", lambda p: p["kind"] >= 0), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    rows = found.select("row", "key", base.alias("base")).join(new, "row", "left")
    spans = F.array_sort(F.when(F.col("new").isNull(), F.col("base")).otherwise(F.concat("base", "new")))
    return rows.select(F.col("key").alias(key), "base", spans.alias("spans"))
