"""Quotes of statements against the texts of their source."""

import random

from storelens.operators import evidence as V


def texts(n):
    """Texts that share a long word in every sentence."""
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    return [(f"s{i % 2}", f"u{i}", " ".join(f"{name()} waterproof {name()}." for _ in range(8)) + f" {rng.getrandbits(128):032x}\n!! 😀{name()}") for i in range(n)]


def test_a_common_word_does_not_meet_every_text(spark):
    """Found before this: each quote met every text that holds its longest word."""
    rows = texts(200)
    quotes = spark.createDataFrame([(s, t[3:28]) for s, _, t in rows], "source string, quote string")
    keyed = V.quote_keys(quotes).filter("_h is not null")
    assert keyed.count() == 200
    assert V.quote_hits(keyed, spark.createDataFrame(rows, "source string, url string, text string")).count() < 1000


def test_quotes_of_all_kinds_equal_brute_force(spark):
    rng, rows = random.Random(3), texts(60)
    st = []
    for i in range(600):
        s, _, t = rng.choice(rows)
        a, n = rng.randrange(len(t)), rng.choice((1, 2, 3, 5, 7, 9, 13, 18, 25, 60))
        q = t[a : a + n] if i % 7 else t[-45:-20]
        st.append((i, None if i % 50 == 0 else s, q[:1], q + "§" * (i % 11 == 0)))
    want = {i: min(hit) for i, s, _, q in st if q.strip(" ") and (hit := [u for z, u, t in rows if z == s and q in t])}
    got = V.quoted_only(spark.createDataFrame(st, "row_id long, source string, value string, quote string"),
                        spark.createDataFrame(rows, "source string, url string, text string"))
    assert {r["row_id"]: r["url"] for r in got.collect()} == want
