"""Main text of web pages: every text block is labelled by a bidirectional LSTM that reads the whole page."""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty, worker_state

# Elements of HTML by role, and words of class and id attributes that name a part of a page.
BLOCK = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"br", "button", "label"}
SAME_CLOSES = set("li dt dd option tr td th".split())
MAIN_TAGS = set("article main".split())
MAIN_WORDS = set("article content entry main post story text".split())
OTHER_TAGS = set("nav aside footer header form button select textarea head title menu dialog".split())
OTHER_WORDS = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion footer header legal login masthead menu modal nav navbar navigation newsletter notice pagination popup promo related replies reply search share sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|object)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"""|<(/?)([a-z][^\s/<>"']*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
WORDS_IN_NAME = re.compile("[a-z]+")
PATH_SLOTS, WORD_SLOTS, PATH_DIM, WORD_DIM, HIDDEN = 2048, 4096, 24, 8, 16
#: Pages that the labeller is fitted on, epochs, and pages that it reads at once.
SAMPLE_PAGES, EPOCHS, FIT_BATCH = 240, 6, 24
#: Consecutive blocks of a page that an epoch reads, from another place of the whole page each time; shorter pages are read whole.
FIT_BLOCKS = 120


class Path:
    """All elements around a place, the innermost with a link to those around it, so that depth costs nothing.

    ``own`` has the names of the innermost element, each with its weight: 1 over the number of times that it is open by now. So a name counts
    by the logarithm of its repeats, and deep nesting does not drown the other names.
    """

    __slots__ = ("above", "own", "main", "other")

    def __init__(self, above: Path | None, own: list[tuple[str, float]]):
        self.above, self.own = above, own
        self.main = bool(above and above.main) or any(n in MAIN_TAGS or n[:1] == "." and n[1:] in MAIN_WORDS for n, _ in own)
        self.other = bool(above and above.other) or any(n in OTHER_TAGS or n[:1] == "." and n[1:] in OTHER_WORDS for n, _ in own)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path | tuple[str, ...], text: str, linked: float):
        self.path = path if isinstance(path, Path) else Path(None, [(n, 1.0) for n in path])
        self.text, self.linked = text, linked


def leaf_blocks(page: str) -> list[Block]:
    """Text blocks in page order, with the names of the elements around them: tag, then class, id and role words.

    Scripts, styles, comments and markup go. Inline elements stay inside their block. Character references are decoded and
    white space becomes one space. Unclosed and stray tags are taken as browsers do for paragraphs and list items.
    """
    top, stack = Path(None, []), []
    open_tags: dict[str, int] = {}
    open_names: dict[str, int] = {}
    found: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(stack[-1][1] if stack else top, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop(tag: str) -> None:
        while stack:
            last, path = stack.pop()
            open_tags[last] -= 1
            for name, _ in path.own:
                open_names[name] -= 1
            if last == tag:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(entities.unescape(text))
            if open_tags.get("a"):
                linked += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if (tag := m[3]) is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m[2]:
            if open_tags.get(tag):
                pop(tag)
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            pop("p")
        elif tag in SAME_CLOSES and stack and stack[-1][0] == tag:
            pop(tag)
        if tag in VOID or m[4].endswith("/"):
            continue
        words = [w for n in NAMED.findall(m[4]) for w in WORDS_IN_NAME.findall("".join(n).lower())] if "=" in m[4] else []
        own = []
        for name in (tag, *("." + w for w in words)):
            open_names[name] = open_names.get(name, 0) + 1
            own.append((name, 1 / open_names[name]))
        stack.append((tag, Path(stack[-1][1] if stack else top, own)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    add(page[at:])
    flush()
    return found


def teacher(block: Block) -> bool:
    """The weak label: inside a main element or one named so, and in no other part of the page."""
    return block.path.main and not block.path.other


def drawn(items: list, rng: np.random.Generator, most: int = FIT_BLOCKS) -> slice:
    """At most ``most`` consecutive ones, from anywhere; either end is as likely to be met as the middle."""
    if len(items) <= most:
        return slice(0, len(items))
    at = min(max(int(rng.integers(-most // 2, len(items) - most // 2)), 0), len(items) - most)
    return slice(at, at + most)


def rewrapped(blocks: list[Block], foreign: list[str], rng: np.random.Generator) -> str:
    """A page of the same texts in other elements, with other parts around and within the article."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    body = [b.text for b in blocks if teacher(b)] or [b.text for b in blocks if len(b.text) > 60]
    spare = [b.text for b in blocks if not teacher(b)] + foreign
    escape = entities.escape

    def other() -> str:
        text = "".join(f"<{t}>{escape(pick(spare))}</{t}>" for t in [pick(["p", "li", "span", "div", "h3"])] * int(rng.integers(1, 4))) if spare else ""
        if rng.random() < 0.4:
            tag = pick(sorted(OTHER_TAGS - {"head", "title", "select", "textarea"}))
            return f"<{tag}>{text}</{tag}>"
        tag, name = pick(["div", "section", "ul", "p", "span"]), pick(sorted(OTHER_WORDS))
        return f'<{tag} {pick(["class", "id"])}="{pick(["", "site-", "page "])}{name}">{text}</{tag}>'

    if rng.random() < 0.6:
        tag = pick(sorted(MAIN_TAGS))
        opened, closed = f"<{tag}>", f"</{tag}>"
    else:
        tag, name = pick(["div", "section"]), pick(sorted(MAIN_WORDS))
        opened, closed = f'<{tag} {pick(["class", "id"])}="{pick(["", "page-", "post "])}{name}">', f"</{tag}>"
    inner = [f"<h1>{escape(body[0][:60])}</h1>"] if body and rng.random() < 0.7 else []
    for text in body[drawn(body, rng)]:
        tag = pick(["p", "p", "p", "div", "li", "h2", "blockquote"])
        inner.append(f"<{tag}>{escape(text)}</{tag}>")
        if rng.random() < 0.08:
            inner.append(other())
    around = [other() for _ in range(int(rng.integers(1, 4)))], [other() for _ in range(int(rng.integers(1, 4)))]
    wraps = [int(rng.integers(30)) if rng.random() < 0.3 else 0 for _ in range(2)]
    opened, closed = "<div>" * wraps[0] + opened + "<div>" * wraps[1], "</div>" * wraps[1] + closed + "</div>" * wraps[0]
    return "<html><head><title>x</title></head><body>" + "".join(around[0]) + opened + "".join(inner) + closed + "".join(around[1]) + "</body></html>"


class WordSlots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = zlib.crc32(word.encode()) % WORD_SLOTS
        return out


class Labeller:
    """Hashed tag-path and word vectors, an LSTM in either direction, and a logistic output for every block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = PATH_DIM + WORD_DIM + 2
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.p = {"path": draw(PATH_SLOTS, PATH_DIM), "word": draw(WORD_SLOTS, WORD_DIM), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(wide, 4 * HIDDEN), f"U{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    @staticmethod
    def slots(blocks: list[Block]) -> tuple[tuple, list[np.ndarray], np.ndarray]:
        """Of every block its path, words and two numbers. Paths are nodes, each after the one above it: its own slots and weights."""
        number: dict[int, int] = {}
        above, own, at = [], [], []
        for b in blocks:
            path, line = b.path, []
            while path is not None and id(path) not in number:
                line.append(path)
                path = path.above
            for path in reversed(line):
                above.append(-1 if path.above is None else number[id(path.above)])
                number[id(path)] = len(own)
                own.append([(zlib.crc32(n.encode()) % PATH_SLOTS, w) for n, w in path.own])
            at.append(number[id(b.path)])
        node = np.repeat(np.arange(len(own)), [len(x) for x in own])
        flat = [x for part in own for x in part]
        paths = (above, node, np.array([k for k, _ in flat], np.int64), np.array([w for _, w in flat], np.float32), np.array(at, np.int64))
        known = worker_state("word slots", WordSlots)
        words = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in (b.text.lower().split() for b in blocks)]
        return paths, words, np.array([[np.log1p(len(w)) / 5, b.linked] for b, w in zip(blocks, words)], np.float32)

    def inputs(self, slots) -> np.ndarray:
        (above, node, slot, weight, at), words, extra = slots
        table = self.p["path"]
        sums = np.zeros((len(above), PATH_DIM), table.dtype)
        np.add.at(sums, node, table[slot] * weight[:, None])
        for k, up in enumerate(above):
            if up >= 0:
                sums[k] += sums[up]
        size = np.array([len(w) for w in words])
        means = np.add.reduceat(self.p["word"][np.concatenate(words)], np.append(0, np.cumsum(size)[:-1]), axis=0) / size[:, None]
        return np.concatenate([sums[at], means, extra], axis=1).astype(np.float32)

    @staticmethod
    def padded(pages: list[np.ndarray], back: bool) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, pages))
        x, mask = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32), np.zeros((longest, len(pages), 1), np.float32)
        for k, page in enumerate(pages):
            x[: len(page), k] = page[::-1] if back else page
            mask[: len(page), k] = 1
        return x, mask

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction; with ``keep`` also what the way back needs."""
        W, U, c0 = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        steps, n, _ = x.shape
        drive, h, c = x @ W + c0, np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, held = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = drive[t] + h @ U
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, new = (c, h), f * c + i * g
            c, squashed = new, np.tanh(new)
            h = o * squashed
            out[t] = h
            if keep:
                held.append((i, f, o, g, squashed, *before))
        return out, held

    def back(self, x, d, dh_all, held, grads):
        """Gradients through time for one direction; returns those of the inputs."""
        U, dx, dh, dc = self.p[f"U{d}"], np.empty_like(x), 0, 0
        for t in reversed(range(len(x))):
            i, f, o, g, squashed, c, h = held[t]
            dh = dh_all[t] + dh
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            grads[f"W{d}"] += x[t].T @ dz
            grads[f"U{d}"] += h.T @ dz
            grads[f"c{d}"] += dz.sum(0)
            dx[t] = dz @ self.p[f"W{d}"].T
            dh, dc = dz @ U.T, dc * f
        return dx

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The log odds that a block is main text, for each page's inputs."""
        both = []
        for d in "fb":
            x, _ = self.padded(pages, d == "b")
            both.append(self.run(x, d)[0])
        out = []
        for k, page in enumerate(pages):
            n = len(page)
            h = np.concatenate([both[0][:n, k], both[1][:n, k][::-1]], axis=1)
            out.append(h @ self.p["out"] + self.p["bias"])
        return out

    def step(self, slots: list, labels: list[np.ndarray], state: dict, rate: float) -> float:
        """One update by Adam on a batch of pages; returns the mean loss of a block."""
        pages = [self.inputs(s) for s in slots]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dx_pages, total, loss = [np.zeros_like(p) for p in pages], sum(map(len, pages)), 0.0
        kept = {d: (x := self.padded(pages, d == "b")[0], *self.run(x, d, True)) for d in "fb"}
        dh = {d: np.zeros_like(kept[d][1]) for d in "fb"}
        for k, (page, y) in enumerate(zip(pages, labels)):
            n = len(page)
            h = np.concatenate([kept["f"][1][:n, k], kept["b"][1][:n, k][::-1]], axis=1)
            p = 1 / (1 + np.exp(-(h @ self.p["out"] + self.p["bias"])))
            loss -= float(np.log(np.where(y, p, 1 - p) + 1e-9).sum())
            e = ((p - y) / total).astype(np.float32)
            grads["out"] += h.T @ e
            grads["bias"] += e.sum()
            back = e[:, None] * self.p["out"][None, :]
            dh["f"][:n, k], dh["b"][:n, k] = back[:, :HIDDEN], back[::-1, HIDDEN:]
        for d in "fb":
            x, _, held = kept[d]
            dx = self.back(x, d, dh[d], held, grads)
            for k, page in enumerate(pages):
                n = len(page)
                dx_pages[k] += dx[:n, k][::-1] if d == "b" else dx[:n, k]
        for (paths, words, _), dx in zip(slots, dx_pages):
            above, node, slot, weight, at = paths
            sums = np.zeros((len(above), PATH_DIM), np.float32)
            np.add.at(sums, at, dx[:, :PATH_DIM])
            for k in reversed(range(len(above))):
                if above[k] >= 0:
                    sums[above[k]] += sums[k]
            np.add.at(grads["path"], slot, sums[node] * weight[:, None])
            size = np.array([len(w) for w in words])
            np.add.at(grads["word"], np.concatenate(words), np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / size[:, None], size, axis=0))
        state["t"] = t = state.get("t", 0) + 1
        for k, g in grads.items():
            m, v = state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[k] = m, v
            self.p[k] = self.p[k] - (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return loss / total


def sample(pages: DataFrame, html: str, key: str, n: int) -> list[str]:
    """Of different (key, page) rows the ``n`` with the least hashes. Only hashes are ordered, from a share of the rows that a count
    gives; only the pages that are taken reach the driver."""
    hashes = pages.withColumns({"_a": F.xxhash64(key), "_b": F.xxhash64(html)})
    total = max(1, pages.count())
    upto = 2**64 * min(total, 4 * n) // total - 2**63 - 1

    def least(rows: DataFrame) -> list:
        return rows.select("_a", "_b").distinct().orderBy("_a", "_b").limit(n).collect()

    taken = least(hashes.filter(F.col("_a") <= upto))
    if len(taken) < n:  # a key that many rows have
        taken = least(hashes)
    rank = {(r["_a"], r["_b"]): k for k, r in enumerate(taken)}
    asked = hashes.filter(F.col("_a").isin([a for a, _ in rank]) & F.col("_b").isin([b for _, b in rank]))
    found = asked.groupBy("_a", "_b").agg(F.min(html).alias("page")).collect()
    return [r["page"] for r in sorted(found, key=lambda r: rank.get((r["_a"], r["_b"]), n)) if (r["_a"], r["_b"]) in rank]


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", sample_pages: int = SAMPLE_PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller | None:
    """Fit on a bounded sample: ``sample_pages`` pages by the hash of their key, each also in two other wrappings.

    Every epoch reads all blocks of a page, or FIT_BLOCKS consecutive ones from a place of the whole page that is drawn anew.
    """
    rows = sample(pages.filter(F.col(html) != "").select(key, html), html, key, sample_pages)
    real = [b for page in rows if (b := leaf_blocks(page))]
    if not real:
        return None
    rng, shown = np.random.default_rng(seed), list(real)
    texts = [b.text for page in real for b in page]
    for page in real:
        for _ in range(2):
            foreign = [texts[int(k)] for k in rng.integers(len(texts), size=6)]
            shown.append(leaf_blocks(rewrapped(page, foreign, rng)))
    shown = [page for page in shown if page]
    model, state = Labeller(seed), {}
    for epoch in range(epochs):
        order = rng.permutation(len(shown))
        for at in range(0, len(order), FIT_BATCH):
            part = [page[drawn(page, rng)] for page in (shown[int(k)] for k in order[at : at + FIT_BATCH])]
            model.step([Labeller.slots(page) for page in part], [np.array([teacher(b) for b in page]) for page in part], state, 0.02 / (1 + epoch))
    return model


def label_pages(model: Labeller, pages: list[list[Block]], most: int = 20_000) -> list[np.ndarray]:
    """Whether each block is main text. Pages of like length are read together, at most ``most`` padded blocks at once."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    group: list[int] = []

    def read() -> None:
        if group:
            inputs = [model.inputs(Labeller.slots(pages[k])) for k in group]
            for k, s in zip(group, model.scores(inputs)):
                out[k] = s > 0

    for k in order:
        if group and (len(group) + 1) * len(pages[k]) > most:
            read()
            group = []
        group.append(k)
    read()
    return out


def main_text(pages: DataFrame, model: Labeller | None, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text, n_chars of every row.

    Null or empty pages, and pages without main text, give an empty text. Every block is read and none is cut. Repeated rows
    and null keys give a row each, other columns are ignored, an empty table gives no rows.
    """
    held = pages.sparkSession.sparkContext.broadcast(model and model.p)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        labeller, texts = Labeller.__new__(Labeller), []
        labeller.p = held.value
        bodies = batch.column(2).to_pylist()
        for at in range(0, len(bodies), 400):
            blocks = [leaf_blocks(b) for b in bodies[at : at + 400]]
            chosen = label_pages(labeller, blocks) if labeller.p else [np.zeros(len(b), bool) for b in blocks]
            texts += [" ".join(b.text for b, y in zip(page, own) if y) for page, own in zip(blocks, chosen)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    cols = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), text_or_empty(html))
    return map_batches(cols, run, "key long, url string, text string, n_chars long").withColumnRenamed("key", key)
