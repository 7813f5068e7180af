"""What the last pass of an operator holds, and shortcuts that must not change results."""

import sys

import regex

from storelens.llm import bpe, simhash_dedup
from storelens.llm.bpe_queries import vocabulary


def test_near_copies_leave_without_python_over_texts(spark, odd_docs, folder):
    """The last join reads the documents once; texts were sent through Python twice over before."""
    plan = simhash_dedup.keep_one(odd_docs, folder())._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_letters_and_marks_are_pre_tokens():
    letter = regex.compile(r"\p{L}")
    assert all(letter.match(x) for x in map(chr, range(sys.maxunicode + 1)) if x.isalpha())
    codec, words = bpe._Codec(vocabulary()), []
    codec.bpe.pretokens = type("Counted", (), {"findall": lambda self, x: words.append(x) or regex.findall(bpe.SPLIT, x)})()
    text = "the Água thé. the, don't x1 !? .!. a.b ''s été; ẞ."
    assert codec.code(text) == codec.of(bpe.WordBpe(vocabulary()).encode(text))
    assert set(words) == {"don't", "x1", "!?", ".!.", "a.b", "''s"}
