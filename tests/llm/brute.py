"""Plain single-machine versions of the contracts, straight from their definitions."""

import collections
import hashlib
import re
import zlib

import numpy as np


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    twice = {c: sum(map(int, str(2 * int(c)))) for c in "0123456789"}
    return sum(twice[c] if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    text, digits = text or "", lambda s: re.sub("[^0-9]", "", s)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m[0]))


def contamination(docs, items):
    word, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), collections.defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes, out = {len(k) for k in windows}, []
    for doc, text in docs:
        w, hit, found = word.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(docs):
    ids = [d for d, _ in docs]
    f = np.array([fingerprint(t) for _, t in docs], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [(ids[i], f"{int(f[i]):016x}", min(groups[find(i)])) for i in range(len(ids))]


def exact_groups(docs):
    groups = collections.defaultdict(list)
    for doc, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    out = []
    for doc, text in docs:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[body])[1]
        out.append((doc, keep, len(groups[body]), doc == keep, hashlib.sha256(body.encode()).hexdigest()))
    return out


def ids_of(name, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if name not in TOKENIZERS:
        TOKENIZERS[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return TOKENIZERS[name].encode(text or "", add_special_tokens=False).ids


TOKENIZERS = {}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def pieces(docs, capacity=2048):
    out = {}
    for doc, text in docs:
        ids = [*ids_of("byte_bpe_50k.json", text), 0]
        n = -(-len(ids) // capacity)
        at, size = 0, len(ids) - capacity * (n - 1)
        for k in range(n):
            out[doc, k] = (at, size, crc(ids[at : at + size]))
            at, size = at + size, capacity
    return out


def stored_ids(docs):
    out, before = [], 0
    for doc, text in sorted(docs):
        ids = [*ids_of("word_bpe_49k.json", text), 1]
        out.append((doc, before, len(ids), crc(ids)))
        before += len(ids)
    return out
