"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import __spark_entry__ as entry
from storelens.llm import spelling as S
from storelens.llm.common import table

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(n):
    words, near = sorted(n), {w: [] for w in n}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    best = {w: min(ws, key=lambda x: (-n[x], x)) for w, ws in near.items() if ws}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def as_dict(rows):
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_brute_force(spark):
    n = Counter()
    for i, t in table(spark, SF, "documents").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    got = entry.queries()["op13_spelling"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_dict(got.collect()) == brute(n)


def test_hot_reduced_words_and_chains(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "LIST", 3)
    r = random.Random(2)
    n = {"".join(r.choice("abéz") for _ in range(r.randint(5, 7))): r.choice([3, 3, 4, 6, 8, 50]) for _ in range(900)}
    n |= {"q" * (5 + k): 3 * 2**k for k in range(12)} | {"q" * (5 + k) + "x": 3 * 2**k for k in range(12)}
    rows = spark.createDataFrame(sorted(n.items()), "word string, n long")
    for symbols in (1, 4):  # with one symbol all words of a length are one reduced word
        assert as_dict(S.group_variants(rows, folder(), symbols).collect()) == brute(n)


def test_counts(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "HELD", 1)
    rows = [(1, "Straße STRASSE ÀÀÀÀÀ ààààà ab1cdefg"), (None, "Straße, straße; Ābcdef"), (2, None), (3, ""), (1, "cdefg_cdefg " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "'k' as key")
    got = {r["word"]: r["n"] for r in S.count_words(docs, least_count=1).collect()}
    assert got == {"straße": 3, "strasse": 1, "À" * 5: 1, "à" * 5: 1, "cdefg": 5, "bcdef": 1}
    assert {r["word"] for r in S.count_words(docs).collect()} == {"straße", "cdefg"}
    assert S.group_variants(S.count_words(docs.limit(0)), folder()).count() == 0


def test_odd_rows(spark, odd_docs, folder):
    got = as_dict(S.group_variants(S.count_words(odd_docs), folder()).collect())
    assert got["lorem"][2] == 4000 and got["again"][:4] == (None, "again", 6, 0)
    assert max(map(len, got)) == 6
    long = "y" * 20000
    docs = spark.createDataFrame([(1, f"{long} {long} {long} short")], "doc_id long, text string")
    assert [r["n"] for r in S.count_words(docs).collect()] == [3]


def test_neighbourhood_is_every_word_one_edit_away():
    import itertools

    for n in range(5):
        for r in itertools.product((1, 2, 3), repeat=n):
            want = {w for m in (n - 1, n, n + 1) if m >= 0 for w in itertools.product((1, 2, 3), repeat=m) if w == r or one_edit(w, r)}
            got = S.neighbourhood(S.np.array(r, dtype=S.np.uint64), 3).tolist()
            assert sorted(S.key_of(S.np.array(w, dtype=S.np.uint64)) for w in want) == sorted(got), r
