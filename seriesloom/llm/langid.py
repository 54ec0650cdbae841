"""Language by cross-parsing entropy: the language whose labelled text describes a text's phrases at the least cost wins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hidden, map_batches, worker_state

#: Most characters of labelled text for each language, and most documents they come from.
SAMPLE_CHARS = 48_000
SAMPLE_DOCS = 200
#: Characters that one of these documents adds, at most, from a place drawn by its id.
DOC_CHARS = 2_000
#: Languages that are learned: those with the most labelled documents.
MOST_LANGUAGES = 64
UNKNOWN = "und"
#: A text is parsed in blocks of so many letters, side by side; a phrase ends with its block. Characters that are parsed at a time.
BLOCK, AT_A_TIME = 1024, 1 << 21
#: States times letters that one table can number.
MOST_KEYS = 1 << 31


class SuffixAutomaton:
    """All substrings of a text as paths; one dict holds every step as state * width + letter."""

    def __init__(self, text: str):
        self.codes = {c: k for k, c in enumerate(sorted(set(text)))}
        self.width = width = max(1, len(self.codes))
        length, link, out = [0], [-1], [{}]
        last = 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            out.append({})
            p = last
            while p >= 0 and c not in out[p]:
                out[p][c] = new
                p = link[p]
            if p >= 0:
                q = out[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    out.append(dict(out[q]))
                    while p >= 0 and out[p].get(c) == q:
                        out[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.step = {s * width + self.codes[c]: t for s, moves in enumerate(out) for c, t in moves.items()}

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every step as state, letter (code point) and next state."""
        letters = np.array([ord(c) for c in self.codes] or [0], np.int64)
        keys = np.fromiter(self.step, np.int64, len(self.step))
        return keys // self.width, letters[keys % self.width], np.fromiter(self.step.values(), np.int64, len(self.step))


def normal(text: str) -> str:
    """Small letters, everything else a space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


class Parser:
    """The automata of all languages as one table of steps, which many blocks of texts walk at once.

    A step is found by its key (state and letter) in an open hash table of arrays; the first steps of each language stand in a table of
    their own. ``letters`` gives every character's code: 0 for what is no letter, 1 for letters that no labelled text has.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n = len(tables)
        seen = np.unique(np.concatenate([t[1] for t in tables] or [np.zeros(0, np.int64)]))
        seen = seen[seen != 32]
        self.letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint16, 0x110000)
        self.letters[seen] = np.arange(2, len(seen) + 2)
        self.width, base, keys, targets = len(seen) + 2, 0, [], []
        self.roots = np.zeros(self.n, np.int64)
        for k, (state, letter, to) in enumerate(tables):
            keys.append((state + base) * self.width + self.letters[letter])
            targets.append(to + base)
            self.roots[k] = base
            base += int(to.max(initial=0)) + 1
        all_keys, all_to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, targets))
        if base * self.width >= MOST_KEYS:
            raise ValueError("the labelled text of a language has too many different letters")
        self.fill(all_keys, all_to)
        first = (self.roots[:, None] * self.width + np.arange(self.width)).ravel().astype(np.int32)
        self.first = self.second(first).reshape(self.n, self.width)
        met = self.table[self.place(first)]
        self.first = np.where((met >> 32) == first, met & 0x7FFFFFFF, self.first.ravel()).astype(np.int32).reshape(self.n, self.width)

    def fill(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Every key gets one of its two slots; a key that takes a slot sends the one in it to its other slot."""
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        while True:
            self.shift = np.uint32(32 - bits)
            small = keys.astype(np.int32)
            slots = np.stack([self.place(small, 0), self.place(small, 1)]).astype(np.int64)
            owner, side, left = np.full(1 << bits, -1), np.zeros(len(keys), np.int64), np.arange(len(keys))
            for _ in range(200):
                if not len(left):
                    break
                at = slots[side[left], left]
                out = owner[at]
                owner[at] = left
                left = np.unique(np.concatenate([left[owner[at] != left], out[out >= 0]]))
                side[left] ^= 1
            if not len(left):
                break
            bits += 1
        #: Key in the high half, next state in the low one; -1 where a slot is empty.
        self.table = np.where(owner >= 0, (keys << 32 | to)[owner] if len(keys) else -1, -1)

    def place(self, keys: np.ndarray, side: int = 0) -> np.ndarray:
        mixed = keys.view(np.uint32)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32((0x9E3779B1, 0x85EBCA77)[side])
        return mixed >> self.shift

    def second(self, keys: np.ndarray) -> np.ndarray:
        """The next states of keys that are not in their first slots, -1 where there is no such step."""
        held = self.table[self.place(keys, 1)]
        return np.where((held >> 32) == keys, held & 0x7FFFFFFF, -1).astype(np.int32)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The letters of all texts, a space before, between and after words, and where each text ends."""
        small = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 2 for t in small])
        raw = np.frombuffer("".join(f"\x00{t}\x00" for t in small).encode("utf-32-le", "surrogatepass"), "<u4")
        code = self.letters[raw]
        keep = code > 0
        at, before = np.flatnonzero(keep), np.append(0, np.cumsum(keep))
        starts = np.append(0, ends[:-1])
        last = at[before[ends[before[ends] > before[starts]]] - 1]  # the last letter of every text that has one
        keep[at - 1] = True
        keep[last + 1] = True
        # what stands before a letter is a letter or becomes the space before its word
        return code[keep], np.cumsum(keep)[ends - 1]

    def counts(self, texts: list[str]) -> np.ndarray:
        """One row per text: its phrases in every language, then its letters."""
        out = np.zeros((len(texts), self.n + 1), np.int64)
        if not texts:
            return out
        code, ends = self.codes(texts)
        starts = np.append(0, ends[:-1])
        sums = np.append(0, np.cumsum(code > 0))
        out[:, -1] = sums[ends] - sums[starts]
        blocks = -(-(ends - starts) // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner) or not self.n:
            return out
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + number * BLOCK
        size = np.minimum(BLOCK, ends[owner] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than each place
        roots = np.tile(self.roots.astype(np.int32), len(owner))
        state, n, width = roots.copy(), np.zeros(len(roots), np.int64), np.int32(self.width)
        lane = np.tile(np.arange(self.n), len(owner))
        for k in range(int(size[0])):
            m = int(active[k])
            letter, now = np.repeat(code[begin[:m] + k].astype(np.int32), self.n), state[: m * self.n]
            keys = now * width + letter
            held = self.table[self.place(keys)]
            to = (held & 0x7FFFFFFF).astype(np.int32)
            other = np.flatnonzero((held >> 32) != keys)
            found = self.second(keys[other])
            to[other] = found
            missed = other[found < 0]
            # a phrase ends before the letter; a letter that the language doesn't have is one of its own
            again = self.first[lane[missed], letter[missed]]
            strange = again < 0
            n[missed] += (now[missed] != roots[missed]).astype(np.int64) + strange
            to[missed] = np.where(strange, roots[missed], again)
            state[: m * self.n] = to
        n = (n + (state != roots)).reshape(-1, self.n)
        np.add.at(out[:, : self.n], owner, n)
        return out


def parsers(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[Parser]:
    """Parsers of all languages in turn, as few as the numbers of their steps allow."""
    out, states, letters = [[]], 0, set()
    for table in tables:
        states, letters = states + int(table[2].max(initial=0)) + 1, letters | set(table[1].tolist())
        if out[-1] and states * (len(letters) + 2) >= MOST_KEYS:
            out.append([])
            states, letters = int(table[2].max(initial=0)) + 1, set(table[1].tolist())
        out[-1].append(table)
    return [Parser(part) for part in out]


def parse(made: list[Parser], texts: list[str]) -> np.ndarray:
    """One row per text: its phrases in every language, then its letters. Some texts at a time, one of more characters alone."""
    parts, held, size = [], [], 0

    def counts() -> np.ndarray:
        found = [p.counts(held) for p in made]
        return np.concatenate([*(f[:, :-1] for f in found), found[0][:, -1:]], axis=1)

    for t in texts:
        if held and size + len(t) > AT_A_TIME:
            parts.append(counts())
            held, size = [], 0
        held.append(t)
        size += len(t)
    return np.concatenate([*parts, counts()])


def tables_of(samples: tuple[tuple[str, str], ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [SuffixAutomaton(text).steps() for _, text in samples]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, most: int = MOST_LANGUAGES) -> tuple[tuple[str, str], ...]:
    """(language, labelled text) from a bounded sample of the labelled rows, at most ``sample_chars`` characters for each.

    Rows are taken by the hash of their id, at a rate that gives about twice ``sample_docs`` for each language, and up to DOC_CHARS
    characters of each. Null texts and null languages teach nothing. Of more than ``most`` languages those with the most rows are
    learned. A language with less labelled text keeps all of it and shortens no other one.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    ordered = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang).limit(most)
    counts = {r[lang]: r["n"] for r in ordered.collect()}
    if not counts:
        return ()
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20))
    limit = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int(min(1.0, 2 * sample_docs / n) * (1 << 20)))])
    place = (1 + F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.greatest(F.lit(1), F.length(text) - DOC_CHARS + 1))).cast("int")
    taken = F.substr(F.col(text), place, F.lit(DOC_CHARS)).alias("text")
    rows = labelled.filter(draw < limit[F.col(lang)]).select(F.col(lang).alias("lang"), draw.alias("draw"), taken)
    rows = rows.orderBy("draw", "text").limit(4 * sample_docs * len(counts)).collect()
    held: dict[str, str] = dict.fromkeys(sorted(counts), "")
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], r["text"])):
        if len(held[r["lang"]]) < sample_chars:
            held[r["lang"]] += " " + " ".join(normal(r["text"]).split()) + " "
    held = {k: " ".join(v.split()) for k, v in held.items() if v.strip()}
    return tuple((k, f" {v[: sample_chars - 2]} ") for k, v in held.items())


def phrase_costs(samples: tuple[tuple[str, str], ...]) -> list[float]:
    """What a phrase costs in each language, as a share of the dearest.

    A phrase names a place of the labelled text or a letter, so it costs the logarithm of the number of both. Longer labelled
    texts have longer phrases that cost more each, which makes texts of unlike size comparable; the letters, counted over all
    languages, keep a text of a few characters from being cheap.
    """
    letters = len(set().union(*(text for _, text in samples)))
    costs = [math.log(len(text) + letters) for _, text in samples]
    return [c / max(costs) for c in costs]


def predicted(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str, own: dict[str, str]) -> DataFrame:
    """``docs`` with the columns ``own["lang"]`` and ``own["score"]``."""
    names, each = [k for k, _ in samples], np.array(phrase_costs(samples))
    held = docs.sparkSession.sparkContext.broadcast(tables_of(samples))
    number, columns = held._jbroadcast.id(), [*docs.columns, own["lang"], own["score"], own["known"]]
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = worker_state(("parsers", number), lambda: parsers(held.value))
        counts = parse(made, [t or "" for t in batch.column(at).to_pylist()])
        known = counts[:, -1] > 0
        if names:
            costs = counts[:, :-1] * each
            order = np.argsort(costs, axis=1, kind="stable")
            least = np.take_along_axis(costs, order[:, :2], axis=1)
            langs = [names[k] if ok else UNKNOWN for k, ok in zip(order[:, 0].tolist(), known.tolist())]
            score = 1 - least[:, 0] / np.maximum(least[:, 1], 1e-300) if len(names) > 1 else np.ones(len(langs))
            scores = np.where(known, score, 0.0)
        else:
            langs, scores = [UNKNOWN] * len(known), np.zeros(len(known))
        letters = pa.array(known, pa.bool_())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), letters], names=columns)

    schema = T.StructType([*docs.schema.fields, T.StructField(own["lang"], T.StringType()), T.StructField(own["score"], T.DoubleType()), T.StructField(own["known"], T.BooleanType())])
    return map_batches(docs, run, schema)


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score of every row.

    The running text is parsed: its letters in lower case, words a space apart, in blocks of BLOCK letters. All of it counts, and phrases are
    normalised for the size of the labelled texts (``phrase_costs``). The least cost wins, ties go to the first language by
    name. The score is the saving against the second language, as a share of its cost (0 to 1). Null texts, texts without a
    letter, and a model without languages give ``und`` with score 0. Repeated rows give repeated results, other columns are
    ignored, an empty table gives no rows.
    """
    cols = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = predicted(cols, samples, "text", {"lang": "lang_pred", "score": "score", "known": "known"})
    return found.select(F.col("key").alias(key), "lang_pred", "score")


def held_out(key: str = "doc_id"):
    """One in five, by the checksum of the id; rows with a null id are never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` in which a language can be told, with their columns; a null language becomes the predicted one.

    Rows with a letter stay, also when no row has a label to learn from; a null language stays null then.
    """
    samples = fit(docs.filter(~held_out(key)), text, lang, key, **how)
    own = hidden(docs, "lang", "score", "known")
    found = predicted(docs, samples, text, own).filter(F.col(own["known"]))
    told = F.coalesce(F.col(lang), F.nullif(F.col(own["lang"]), F.lit(UNKNOWN)))
    return found.withColumn(lang, told.cast(docs.schema[lang].dataType)).select(*docs.columns)
