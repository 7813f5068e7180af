"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

import __spark_entry__ as entry
from storelens.llm import periodic_runs as P
from storelens.llm.common import table

SF = "/root/testdata/sf0.001"


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[: len(w) - p])


def brute(w):
    """All runs by the definition: maximal stretches per period, kept where that period is the smallest."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if size >= max(6, 4 * p) and smallest_period(w[i : i + size]) == p:
                out.append((i, size, p))
            i = j
    return sorted(out)


def collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def runs_of(spark, folder, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = P.find_runs(rows, folder(), keep_text=True).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        w = texts[r["doc_id"]].split()
        runs = brute(w)
        assert [tuple(x) for x in r["runs"]] == runs, texts[r["doc_id"]][:200]
        left = " ".join(collapse(w, runs))
        assert r["collapsed"] == left and r["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest() and r["n_words"] == len(w)


def made_texts(r, count, most):
    for _ in range(count):
        letters = r.choice(["a", "ab", "abc", "abcdefgh"])
        w = []
        while len(w) < r.randint(0, most):
            part = [r.choice(letters) for _ in range(r.randint(1, 30))]
            if r.random() < 0.3 and w:
                part = [r.choice(letters) * r.randint(1, 2)] * r.randint(1, 9)
            w += part * r.choice([1, 1, 2, 3, 4, 5, 9])
        yield " ".join(w)


def test_random_texts(spark, folder):
    r = random.Random(4)
    runs_of(spark, folder, [*made_texts(r, 250, 60), *made_texts(r, 40, 900), "", "a", "a " * 5, "a " * 6, "a b c " * 3, "a b c " * 4, "x " + "a b " * 4 + "a y"])


def test_bundles_and_slices_end_anywhere(spark, folder, monkeypatch):
    monkeypatch.setattr(P, "BUNDLE", 8)
    monkeypatch.setattr(P, "CHARACTERS", 64)
    r = random.Random(9)
    runs_of(spark, folder, [*made_texts(r, 60, 400), "a " * 3000, "a b c d e f g " * 300, " ".join(f"w{i % 250}" for i in range(2100))])


def test_query_against_brute_force(spark):
    texts = {r[0]: (r[1] or "").encode().split() for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = entry.queries()["op12_periodic_runs"](spark, SF).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] > 0 for r in got) > 5
    for r in got:
        w = texts[r["doc_id"]]
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(collapse(w, runs))).hexdigest()


def test_odd_rows(spark, odd_docs, folder):
    clash = odd_docs.selectExpr("*", "1 as _n", "2 as runs", "'x' as _words", "3 as n_words", "4 as _tiles")
    got = P.find_runs(clash, folder()).collect()
    assert len(got) == 10 and set(got[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "score", "n_words", "runs", "collapsed_sha256"}
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[7]["n_words"] == 0 and by[1]["runs"] == [] and by[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [tuple(x) for x in by[3]["runs"]] == [(0, 20000, 5)] and by[6]["n_words"] == 6
    assert P.find_runs(odd_docs.limit(0), folder()).count() == 0
    same = spark.createDataFrame([(None, "a " * 9), (None, "b c " * 9), (1, "a " * 9), (1, "a " * 9)], "doc_id long, text string")
    assert sorted(r["runs"][0]["length"] for r in P.find_runs(same, folder()).collect()) == [9, 9, 9, 18]


@pytest.mark.parametrize("text, z", [("aabaab", [6, 1, 0, 3, 1, 0]), ("", []), ("aaaa", [4, 3, 2, 1])])
def test_z_function(text, z):
    assert P.z_function([*map(ord, text)]) == z
