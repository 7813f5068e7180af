"""Byte-pair encoding with a given vocabulary, and decoding.

A pre-token is a doubly linked list of symbols; a priority queue holds its mergeable pairs by
rank, then position. Popped entries whose symbols have changed since are stale and skipped.
Decoding joins the vocabulary strings. The vocabulary is a file of the public format with word
ends (``</w>``); its path is a parameter. Work is per text, so documents need no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from storelens.llm.common import over_batches

# The splitting pattern, white space and word end that the vocabulary was made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t-\r \x85\xa0  -     　"
WORD_END = "</w>"
MARKS = frozenset(".,;:!?")  # after letters they are a pre-token of their own

CACHE_ENTRIES = 160_000  # pre-tokens of each of two generations, about 300 bytes each: one that is missed is merged anew
CHUNK_ENTRIES = 10_000  # pieces between white space, likewise: one that is missed is only cut into pre-tokens
CACHE_LENGTH = 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.ids: dict[str, int] = dict(vocab)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        merges = spec["model"]["merges"]
        self.new_id = [vocab[a + b] for a, b in merges]
        self.ranks: dict[int, int] = {}  # left id and right id in one number -> rank
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
        symbols = byte_symbols()
        self.inner = [vocab[c] for c in symbols]
        self.last = [vocab[c + WORD_END] for c in symbols]
        self.pretokens = regex.compile(SPLIT.replace(r"\s", SPACE))
        self.chunks = re.compile(f"[^{SPACE}]+")
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a symbol list, lowest rank first and leftmost among equals.

        A queue entry is rank and position in one number; it is stale if the pair now at that
        position has another rank, or none.
        """
        sym, n, rank_of, new_id = list(symbols), len(symbols), self.ranks.get, self.new_id
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return sym
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n or rank_of(sym[i] << 20 | sym[j]) != rank:
                continue
            new = sym[i] = new_id[rank]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 20 | sym[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            p = before[i]
            if p >= 0 and (r := rank_of(sym[p] << 20 | new)) is not None:
                heapq.heappush(heap, r << 32 | p)
        return [s for s in sym if s >= 0]

    def normalized(self, text: str) -> str:
        """NFC, then lower case of each character by itself."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Pieces between white space; Python's own white space has four control characters more."""
        return self.chunks.findall(text) if self.odd_space.search(text) else text.split()

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode()
        return self.merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a piece of normalized text without white space."""
        return [i for word in self.pretokens.findall(chunk) for i in self.encode_word(word)]

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """(special token?, piece) in order; the pieces between special tokens are normalized and hold no white space."""
        parts = self.specials.split(text) if self.specials and "<|" in text else [text]
        out = []
        for i, part in enumerate(parts):
            out += [(True, part)] if i % 2 else [(False, c) for c in self.split(self.normalized(part))]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for special, piece in self.pieces(text) for i in ([self.special[piece]] if special else self.encode_chunk(piece))]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, one space between them."""
        return " ".join(self.strings[i] for i in ids)


class _Cache(dict):
    """piece of text -> (ids as text, decoded text). When full, the older generation goes, so its memory is bounded."""

    def __init__(self, make, entries: int):
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, piece: str) -> tuple[str, str]:
        got = self.old.get(piece) or self.make(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class _Codec:
    """A vocabulary with its caches: of pre-tokens, and of pieces between white space."""

    of_path: dict[str, _Codec] = {}

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.words = _Cache(lambda word: self.of(self.bpe.encode_word(word)), CACHE_ENTRIES)
        self.chunks = _Cache(self.chunk, CHUNK_ENTRIES)

    @classmethod
    def at(cls, path: str) -> _Codec:
        """One vocabulary at a time per Python worker, kept for its later tasks."""
        if path not in cls.of_path:
            cls.of_path.clear()
            cls.of_path[path] = cls(path)
        return cls.of_path[path]

    def of(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.bpe.decode(ids)

    def chunk(self, chunk: str) -> tuple[str, str]:
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            words = [chunk[:-1], chunk[-1]]
        else:
            words = self.bpe.pretokens.findall(chunk)
            if len(words) == 1:
                return self.words[words[0]]
        ids, texts = zip(*map(self.words.__getitem__, words))
        return " ".join(ids), " ".join(texts)

    def code(self, text: str) -> tuple[str, str]:
        """Ids of a text in decimal, and its decoded text."""
        words, chunks = self.words, self.chunks
        if "<|" in text:
            got = [self.of([self.bpe.special[p]]) if special else chunks[p] for special, p in self.bpe.pieces(text)]
        else:  # letters alone are one pre-token
            got = [words[p] if p.isalpha() else chunks[p] for p in self.bpe.split(self.bpe.normalized(text))]
        if not got:
            return "", ""
        ids, texts = zip(*got)
        return " ".join(ids), " ".join(texts)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` to the other columns; ``text`` itself goes.

    ``keep_ids`` adds ``ids`` (array<int>), ``keep_text`` adds ``decoded`` (string). A null text is an empty one:
    no ids, an empty decoded text. Repeated rows each give a row. Older columns of those names are replaced.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256") + ("ids",) * keep_ids + ("decoded",) * keep_text
    rest = [c for c in docs.columns if c != text and c not in made]
    slim = docs.select(*rest, text)
    extra = ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    schema = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes if n != text) + extra

    def make():
        codec = _Codec.at(path)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f: batch.column(i) for i, f in enumerate(rest)}
            made: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for t in batch.column(batch.num_columns - 1).to_pylist():
                ids, decoded = codec.code(t or "")
                made["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                made["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    made["ids"].append(np.fromstring(ids, dtype=np.int32, sep=" ") if ids else np.empty(0, np.int32))  # four bytes a token
                if keep_text:
                    made["decoded"].append(decoded)
            return out | made

        return step

    return over_batches(slim, make, schema.lstrip(", "))
