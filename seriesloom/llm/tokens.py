"""Token ids of whole texts as the ``tokenizers`` library gives them, with a cache of space-led pieces.

Texts of Latin letters, ASCII signs and single spaces go to ``tiktoken`` whole, which is given the vocabulary of the very same file and a
pattern that equals the file's on such texts. Others are put together from pieces: a byte-level tokenizer without a normaliser, and the lower-casing one that drops white space, never join what stands on
both sides of a single space. So a text is cut before every space, each distinct piece is encoded once for a worker, and a
text's ids are the joined ids of its pieces. Pieces of letters, stops and line ends go through ``tiktoken``, too; every other piece, texts with two spaces in a row, and
tokenizers of any other make go to the library itself. The tests hold the ways against each other.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: Most pieces that a worker remembers in each of two generations; a piece that is used again moves to the younger one.
CACHE_PIECES = 100_000
#: Longer pieces are encoded anew each time, so a cache holds some 30 MB at most.
CACHE_LENGTH = 128
#: Letters of the Latin blocks that every Unicode version has, but for the dotted I, whose lower case is two characters; then ASCII signs but for the apostrophe, which can open a
#: contraction. Such a piece is one pre-token, or two.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
PLAIN = re.compile(rf"([{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")
#: Texts of these alone can go to ``tiktoken`` whole.
SIMPLE = re.compile(rf"[ -~\n{LETTERS}]*")
#: The pattern of the file that marks ends of words, and what it finds besides letters in a simple text whose white space is the mark.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = "\x01"
SIGNS = re.compile(rf"'(?:[sdmt]|ll|ve|re)|[0-9]|[^{MARK}0-9{LETTERS}]+")
#: The byte-level pattern where no white space follows white space.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
END_OF_WORD = "</w>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_engine(spec: dict, suffix: str | None, pattern: str = r"\S+", end: bytes = b"\xff"):
    """A ``tiktoken`` encoding with the file's ids as ranks, or None where ids don't follow the order of the merges.

    The end of a word is the byte 255, which UTF-8 never has, or another one that the texts in question don't have.
    """
    import tiktoken

    model, symbols = spec["model"], byte_symbols()
    vocab, special = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get("".join(m), -1) for m in merges]
    base = len(symbols) * (2 if suffix else 1)
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or made != list(range(base, base + len(made))):
        return None
    ranks = {}
    for token, i in vocab.items():
        if token not in special:
            word_end = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if word_end else token
            raw = bytes(symbols[c] for c in body)
            if not suffix or end not in raw:
                ranks[raw + end * word_end] = i
    if suffix:
        ranks[end] = max(vocab.values()) + 1  # never left alone: a word's last byte takes it first
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class PieceEncoder:
    """``blobs(texts)``: ids as little-endian unsigned 32-bit integers; no special tokens added, nothing truncated."""

    def __init__(self, path: str, capacity: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.capacity = capacity
        spec = json.loads(self.tok.to_str())
        self.kind = self._kind(spec)
        self.engine = None if self.kind == "whole" else merge_engine(spec, END_OF_WORD if self.kind == "bare" else None)
        self.texts = None
        if self.engine is not None and self.kind == "led":
            self.texts = merge_engine(spec, None, BYTE_PATTERN)
        elif self.engine is not None and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN}:
            self.texts = merge_engine(spec, END_OF_WORD, rf"[^{MARK}]+{MARK}", MARK.encode())
            vocabulary = spec["model"]["vocab"]
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.pieces = Pieces(self, " " if self.kind == "led" else "")
        self.heads = self.pieces if self.kind == "bare" else Pieces(self, "")
        self.stops = Stops(self, "")

    @staticmethod
    def _kind(spec: dict) -> str:
        """``led``: a word takes the space before it along; ``bare``: white space is dropped; ``whole``: anything else."""
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
            return "whole"
        suffix = spec["model"].get("end_of_word_suffix")
        if not norm and not suffix and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "led"
        parts = pre.get("pretokenizers", [])
        if (
            suffix == END_OF_WORD
            and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["behavior"] == "Removed"
            and parts[0]["invert"]
            and not parts[1]["use_regex"]
            and not parts[1]["add_prefix_space"]
        ):
            return "bare"
        return "whole"

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _slow(self, piece: str, space: str) -> bytes:
        """Pieces with line ends: line by line; anything else goes to the library."""
        if self.engine is not None and "\n" in piece:
            lines = piece.split("\n")
            if all(map(PLAIN.fullmatch, lines)):
                cut = self.stops["\n"] if self.kind == "led" else b""
                return cut.join([(self.pieces if space else self.heads)[lines[0]], *(self.heads[x] for x in lines[1:])])
        return self.whole(space + piece)

    def blobs(self, texts: list[str]) -> list[bytes]:
        return [self.blob(t) for t in texts]

    def simple(self, text: str) -> list[int] | None:
        """The ids of a simple text, or None for any other."""
        if self.texts is None or "<|" in text or not SIMPLE.fullmatch(text):
            return None
        if self.kind == "led":
            if "  " in text or "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text):
                return None
            return self.texts._core_bpe.encode_ordinary(text)
        return self.texts._core_bpe.encode_ordinary(self.marked(text) + MARK)

    @staticmethod
    def marked(text: str) -> str:
        """A simple text with a mark between its words and runs of signs."""
        return SIGNS.sub(rf"{MARK}\g<0>{MARK}", text.lower().replace(" ", MARK).replace("\n", MARK))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text ends."""
        plain = []
        if self.kind == "bare" and self.texts is not None:
            plain = [k for k, t in enumerate(texts) if "<|" not in t and SIMPLE.fullmatch(t)]
        ids, ends = self._by_words([texts[k] for k in plain]) if plain else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if len(plain) == len(texts):
            return ids, ends
        cuts = [0, *ends.tolist()]
        done = {k: ids[a:b].tobytes() for k, a, b in zip(plain, cuts, cuts[1:])}
        blobs = [done[k] if k in done else self.blob(t) for k, t in enumerate(texts)]
        return np.frombuffer(b"".join(blobs), "<u4"), np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word of the batch is encoded once; a token that ends a word tells where the next begins."""
        parts = pc.split_pattern(pa.array([self.marked(t) for t in texts], pa.large_string()), MARK)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = np.array(self.texts._core_bpe.encode_ordinary(MARK.join(w for w in words if w) + MARK), "<u4")
        if not any(words):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        last = np.flatnonzero(self.ends_word[ids]) + 1
        sizes = np.zeros(len(words), np.int64)
        sizes[[k for k, w in enumerate(words) if w]] = np.diff(np.append(0, last))
        first, at = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        lengths = sizes[at]
        stops = np.cumsum(lengths)
        flat = ids[np.repeat(first[at] - (stops - lengths), lengths) + np.arange(stops[-1])]
        return flat, np.append(0, stops)[parts.offsets.to_numpy()[1:]]

    def blob(self, text: str) -> bytes:
        if (ids := self.simple(text)) is not None:
            return array("I", ids).tobytes()
        if self.kind == "whole" or (self.kind == "led" and "  " in text):
            return self.whole(text)
        for held in (self.pieces, self.heads, self.stops):
            held.bound()
        head, *rest = text.split(" ")
        return (self.heads[head] if head else b"") + b"".join(map(self.pieces.__getitem__, rest))


class Pieces(dict):
    """Ids by piece, made where missing. ``words`` has the letters alone, so that a word's forms with stops are encoded once."""

    def __init__(self, encoder: PieceEncoder, space: str):
        self.encoder, self.space, self.words, self.old, self.old_words = encoder, space, {}, {}, {}
        self.single = encoder.engine and encoder.engine._core_bpe.encode_single_piece
        self.end = b"\xff" if encoder.kind == "bare" else b""

    def bound(self) -> None:
        """Between texts only: a text's own pieces stay while it is encoded."""
        if len(self) > self.encoder.capacity:
            self.old = dict(self)
            self.clear()
        if len(self.words) > self.encoder.capacity:
            self.words, self.old_words = {}, self.words

    def __missing__(self, piece: str) -> bytes:
        if (out := self.old.get(piece)) is not None:
            self[piece] = out
            return out
        m = PLAIN.fullmatch(piece) if self.single else None
        if m is None:
            out = self.encoder._slow(piece, self.space)
        else:
            word, stops = m.groups()
            if (out := self.words.get(word)) is None:
                if (out := self.old_words.get(word)) is None:
                    raw = (self.space + word.lower() if self.end else self.space + word).encode() + self.end
                    out = array("I", self.single(raw)).tobytes()
                if len(word) <= CACHE_LENGTH:
                    self.words[word] = out
            if stops:
                out += self.encoder.stops[stops]
        if len(piece) <= CACHE_LENGTH:
            self[piece] = out
        return out


class Stops(Pieces):
    """Runs of stops, and the single line end: one pre-token each."""

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = array("I", self.single(piece.encode() + self.end)).tobytes()
        return out


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder that this Python worker keeps."""
    return worker_state(("encoder", path), lambda: PieceEncoder(path))
