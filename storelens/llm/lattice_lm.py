"""Language model scores from a subword lattice.

Text is a sequence of words and one end. The lattice of a word holds an arc for every piece of an
existing vocabulary, weighted by the vocabulary's own scores, and, where the word is known from the
training texts, one arc over the whole word, weighted by its discounted relative frequency. A
forward recursion in log space sums over all segmentations. The arcs add up to a proper
distribution:

    P(word) = max(c - d, 0) / N + (d V / N) sum over segmentations into pieces

Counts, pieces and scores are computed per distinct word, which Spark counts over the whole
corpus. The most frequent words, a fixed number, are broadcast; the rest of a document's words
meet their scores in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import saved

HEAD_WORDS = 150_000
FLUSH_WORDS = 250_000
DISCOUNT = 0.5
MARK = "▁"  # stands before the first piece of a word
_M = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x243F6A8885A308D3)
NONE = -np.inf


def tokens(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash(piece: str) -> int:
    h = _START
    with np.errstate(over="ignore"):
        for c in piece:
            h = h * _M + np.uint64(ord(c) + 1)
    return int(h)


@dataclass
class Pieces:
    """Hashes (sorted) and log weights of the first pieces of words and of those that go on; byte weights and the weight of the end."""

    first: np.ndarray
    first_log: np.ndarray
    on: np.ndarray
    on_log: np.ndarray
    bytes_log: np.ndarray
    stop_log: float
    longest: int


def load(path: str) -> Pieces:
    """The vocabulary with weights from its own scores: the n-th merge weighs 1 / (n + 10)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    first, on, of_bytes = {}, {}, np.zeros(256)
    for i in range(sp.vocab_size()):
        piece, weight = sp.id_to_piece(i), 1.0 / (10.0 - min(sp.get_score(i), 0.0))
        if sp.is_byte(i):
            of_bytes[int(piece[3:5], 16)] = 1e-5
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARK not in piece[1:]:
            (first if piece.startswith(MARK) else on)[_hash(piece.removeprefix(MARK))] = weight
    first.setdefault(_hash(""), 1e-3)
    a, b = np.array(sorted(first), dtype=np.uint64), np.array(sorted(on), dtype=np.uint64)
    w, v = np.array([first[k] for k in a.tolist()]), np.array([on[k] for k in b.tolist()])
    total = (v.sum() + of_bytes.sum()) / 0.7
    longest = max(len(sp.id_to_piece(i)) for i in range(sp.vocab_size()) if not sp.is_byte(i) and not sp.is_control(i))
    return Pieces(a, np.log(w / w.sum()), b, np.log(v / total), np.log(np.maximum(of_bytes, 1e-12) / total), float(np.log(0.3)), longest)


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted table, -1 where it is not in it."""
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


class Lattice:
    """The lattices of words of equal length: ``arcs[j, n]`` are the pieces for n characters from j on."""

    def __init__(self, words: list[str], p: Pieces):
        self.p, self.n, self.size = p, len(words), len(words[0])
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(self.n, self.size)
        h = np.full((self.n, self.size), _START, dtype=np.uint64)
        self.on: list[np.ndarray] = []
        self.first = [_find(p.first, np.full(self.n, _START, dtype=np.uint64))]
        for k in range(1, min(p.longest, self.size) + 1):
            h = h[:, : self.size - k + 1] * _M + (self.points[:, k - 1 :].astype(np.uint64) + np.uint64(1))
            self.on.append(_find(p.on, h))
            self.first.append(_find(p.first, h[:, 0]))
        # one character by its bytes
        chars, back = np.unique(self.points, return_inverse=True)
        raw = [list(chr(c).encode("utf-8", "surrogatepass")) for c in chars.tolist()]
        self.byte_log = np.array([p.bytes_log[r].sum() for r in raw])[back.reshape(self.points.shape)]

    def _arc(self, j: int, k: int) -> np.ndarray:
        """Log weights of the piece of k characters from j on."""
        at = self.on[k - 1][:, j]
        return np.where(at >= 0, self.p.on_log[at], NONE)

    def forward(self) -> np.ndarray:
        a = np.full((self.size + 1, self.n), NONE)
        for i in range(self.size + 1):
            terms = []
            if i < len(self.first):
                at = self.first[i]
                terms.append(np.where(at >= 0, self.p.first_log[at], NONE))
            for k in range(1, min(len(self.on), i) + 1):
                terms.append(a[i - k] + self._arc(i - k, k))
            if i:
                terms.append(a[i - 1] + self.byte_log[:, i - 1])
            a[i] = np.logaddexp.reduce(np.stack(terms), axis=0)
        return a

    def logs(self) -> np.ndarray:
        """Natural log of the probability of spelling each word."""
        return self.forward()[-1] + self.p.stop_log


def lattices(words: list[str], p: Pieces, cells: int = 1 << 19) -> Iterator[tuple[list[int], Lattice]]:
    """Lattices of the words by length, and which words they hold."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for size, rows in by.items():
        if size:
            most = max(1, cells // (size * min(size, p.longest)))
            for k in range(0, len(rows), most):
                some = rows[k : k + most]
                yield some, Lattice([words[i] for i in some], p)


def count_words(docs: DataFrame) -> DataFrame:
    """word, train, total over all rows; from columns text and train (boolean)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] + seen[1][w] for w in words], pa.int64())],
                                             names=["word", "train", "total"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[bool(train)].update(tokens(text))
                if len(seen[0]) + len(seen[1]) >= FLUSH_WORDS:
                    yield flush()
        yield flush()

    return docs.select("text", "train").mapInArrow(run, "word binary, train long, total long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def score(docs: DataFrame, path: str, folder: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``docs`` has doc_id, held_out and text; rows that are not held out are learnt from. A null text
    is empty: only its end is scored. Repeated rows each give a row and are each learnt from.
    Without training rows every word is spelled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text", (~F.col("held_out")).alias("train"))
    words = saved(count_words(rows), folder, "words")
    ends = rows.where("train").count()
    totals = words.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    n, v = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    pieces = load(path)
    room = DISCOUNT * v / n if n else 0.5
    end_base = float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1))))
    end_score = float(np.log10((ends - DISCOUNT) / n if ends else 0.5))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy().astype(np.float64)
            logs = np.full(len(c), NONE)
            for some, lattice in lattices([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], pieces):
                logs[some] = lattice.logs()
            seen = np.log(np.maximum(c - DISCOUNT, 0) / n) if n else np.full(len(c), NONE)
            both = np.logaddexp(seen, np.log(room) + logs) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(c > 0), pa.array(np.log10((c + 0.1) / (n + 0.1 * (v + 1)))), pa.array(both)], names=["word", "total", "known", "base", "score"])

    with np.errstate(divide="ignore"):
        scored = saved(words.select("word", "train", "total").mapInArrow(spell, "word binary, total long, known boolean, base double, score double"), folder, "scored")
    top = scored.orderBy(F.desc("total"), "word").limit(head_words).select("word", "known", "base", "score").toArrow()
    head = docs.sparkSession.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), zip(top["known"].to_pylist(), top["base"].to_pylist(), top["score"].to_pylist()))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, number = head.value, TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
        for batch in batches:
            out = []
            for doc, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                number += 1
                found = tokens(text)
                known, base, total = 0, end_base, end_score
                for word, k in Counter(found).items():
                    if (got := known_words.get(word)) is None:
                        out.append((number, None, None, None, None, None, None, word, k))
                    else:
                        known += k * got[0]
                        base += k * got[1]
                        total += k * got[2]
                out.append((number, doc, held, len(found) + 1, known + (ends > 0), base, total, None, None))
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, k long"
    names = [x.split()[0] for x in schema.split(", ")]
    parts = saved(rows.select("doc_id", "held_out", "text").mapInArrow(look, schema), folder, "parts")
    k = F.col("k")
    tail = parts.where("word is not null").select("row", "word", "k").join(scored.select("word", "known", "base", F.col("score").alias("s")), "word").groupBy("row").agg(
        F.sum(k * F.col("known").cast("long")).alias("tail_known"), F.sum(k * F.col("base")).alias("tail_base"), F.sum(k * F.col("s")).alias("tail_score"))
    whole = parts.where("word is null").join(tail, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select("doc_id", "held_out", "n_tokens", add("n_known", "tail_known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
                        add("base_score", "tail_base").alias("base_score"), add("score", "tail_score").alias("score"))
