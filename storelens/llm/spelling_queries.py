"""op13: spelling variants among the words of all documents, with misspellings planted by a hash."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import table, work_folder
from storelens.llm.registry import query
from storelens.llm.spelling import count_words, group_variants


def misspelt(key: int | None) -> Callable[[str], str] | None:
    """For a document, the function that deletes a letter of every word whose crc32 with the key is divisible by 97; without a key none is."""
    if key is None:
        return None
    start = zlib.crc32(f"{key}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        if h % 97:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


@query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), changes=misspelt)
    return group_variants(words, work_folder(spark)).select("word", "form", "root", "n", "n_near", "form_n")
