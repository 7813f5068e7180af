"""Groups of spelling variants, by one-edit neighbourhoods over a reduced alphabet.

Words are counted over all texts (added up inside each task, then shuffled). Every letter is hashed
to one of a few symbols, which takes a word to a reduced word of the same length; one edit between
two words is at most one edit between their reduced words. So each reduced word's full
neighbourhood (itself and every word one insertion, deletion or replacement of a symbol away) is
generated (as hashes, in time linear in the word) and joined to the reduced vocabulary, and the
words behind the reduced words that meet are verified on their own letters.

Many words may share a reduced word. They are packed into lists of about equal length, and lists
meet lists, so a hot reduced word is spread over as many rows as its pairs of lists; pairs of
words are compared inside a row and only near ones leave it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import saved

RUN = re.compile("[a-zÀ-ÿ]+")
SYMBOLS = 5
SPREAD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
LIST = 128  # words of one reduced word in a row
HELD = 200_000  # distinct words a task adds up before it hands them on

Change = Callable[[int | None, str], str]


def lower(text: str) -> str:
    """A to Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", changes: Callable[[int | None], Callable[[str], str]] | None = None,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of letters with their number of occurrences; null texts have none.

    ``changes(key)`` gives the function applied to every distinct run of that row's text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not t.is_valid:
                    continue
                found = Counter(RUN.findall(lower(t.as_py())))
                change = changes(k) if changes else None
                for w, n in found.items():
                    w = change(w) if change else w
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reduced(word: str, symbols: int) -> np.ndarray:
    """The symbol of each letter, from 1: a hash of its code point."""
    letters = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return (letters * SPREAD >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def key_of(r: np.ndarray) -> int:
    """A polynomial hash of a reduced word, as a signed long."""
    return int((r * _powers(len(r))[::-1]).sum().view(np.int64))


def neighbourhood(r: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of all words at most one insertion, deletion or replacement of a symbol away from the reduced word, itself among them."""
    n = len(r)
    power = _powers(n + 2)
    ending = np.concatenate([np.cumsum((r * power[:n][::-1])[::-1])[::-1], np.zeros(1, np.uint64)])  # value of what follows each place
    whole, letters = ending[:1], np.arange(1, symbols + 1, dtype=np.uint64)[None, :]
    other = whole + (letters - r[:, None]) * power[:n][::-1][:, None]
    # with a symbol more, what precedes it moves up by a power; with one less, down
    more = ((whole - ending) * BASE)[:, None] + letters * power[: n + 1][::-1][:, None] + ending[:, None]
    gone = np.concatenate([np.zeros(1, np.uint64), np.cumsum(r[:-1] * power[: n - 1][::-1])]) + ending[1:] if n else whole
    return np.unique(np.concatenate([whole, gone, other.ravel(), more.ravel()])).view(np.int64)


def near_words(words: DataFrame, folder: str, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n_near, near_n, near): for each word with near words their number, and of those with largest n the smallest in code-point order.

    ``words`` has word and n; words are near that differ by exactly one inserted, deleted or replaced code point.
    """
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [reduced(w, symbols) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.astype(np.uint8).tobytes() for r in small], pa.binary()), pa.array([key_of(r) for r in small], pa.int64())],
                                             names=["word", "n", "reduced", "key"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, r in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                to = neighbourhood(np.frombuffer(r, dtype=np.uint8).astype(np.uint64), symbols)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([to], pa.list_(pa.int64()))], names=["key", "to"])

    small = saved(words.select("word", "n").mapInArrow(reduce, "word string, n long, reduced binary, key long"), folder, "reduced")
    sizes = saved(small.groupBy("key").agg(F.count("*").alias("k")), folder, "sizes")
    # the words of a key are dealt over lists by a hash; a list holds LIST words on average
    deal = F.pmod(F.xxhash64("word"), F.ceil(F.col("k") / LIST))
    lists = small.join(sizes, "key").groupBy("key", deal.alias("part")).agg(F.collect_list(F.struct("word", "n")).alias("words"))
    lists = saved(lists.select("key", "words"), folder, "lists")
    meets = small.select("reduced", "key").distinct().mapInArrow(around, "key long, to array<long>").select("key", F.explode("to").alias("to"))
    meets = saved(meets.join(sizes.select(F.col("key").alias("to")), "to").distinct(), folder, "meets")
    pairs = meets.join(lists.select("key", F.col("words").alias("here")), "key").join(lists.select(F.col("key").alias("to"), F.col("words").alias("there")), "to")
    one = lambda a, b: F.levenshtein(a, b, 1) == 1
    close = F.transform("here", lambda a: F.struct(a["word"].alias("word"), F.filter("there", lambda b: one(a["word"], b["word"])).alias("near")))
    found = pairs.select(F.explode(F.filter(close, lambda x: F.size(x["near"]) > 0)).alias("x"))
    best = F.array_min(F.transform("x.near", lambda b: F.struct((-b["n"]).alias("down"), b["word"].alias("word"))))
    found = found.select("x.word", F.size("x.near").cast("long").alias("k"), best.alias("best"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", (-F.col("best.down")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) for rows (word, form): the last word reached by following forms.

    Forms have larger counts than their words, so chains end. Every round jumps to the form's form;
    a chain of m forms takes about log2 m rounds, each a written table.
    """
    now = saved(forms.select("word", F.col("form").alias("root")), folder, "roots-0")
    turn = 0
    while True:
        turn += 1
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"roots-{turn}")
        now = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return now


def group_variants(words: DataFrame, folder: str, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row (word, n).

    ``form`` is the near word of largest n, the smallest in code-point order among equals, where that n is
    at least ``ratio`` (over 1) times the word's; else it is null, and so is ``form_n``. ``root`` is where following forms ends.
    Words have to be distinct. No words give no rows.
    """
    words = saved(words.select("word", "n"), folder, "words")
    near = near_words(words, folder, symbols)
    better = F.col("near_n") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.when(better, F.col("near")).alias("form"), F.when(better, F.col("near_n")).alias("form_n"))
    formed = saved(formed, folder, "forms")
    last = roots(formed.where("form is not null"), folder)
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
