"""Language, language model, toxicity and tokens against brute force, round trips and held-out accuracy."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storelens.llm import language_id as L
from storelens.llm import lattice_lm as M
from storelens.llm import toxicity as T
from storelens.llm.bpe import WordBpe, encode_documents
from storelens.llm.bpe_queries import vocabulary
from storelens.llm.common import held_out, table
from storelens.llm.lattice_lm_queries import vocabulary as pieces_path

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r[0]: r[1] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_language_of_held_out_documents(spark):
    got = entry.queries()["op1_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert len(got) == 200 and out and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.9 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark, odd_docs):
    model = L.fit(odd_docs)
    got = {r["doc_id"]: r for r in L.predict(odd_docs, model).collect()}
    assert L.predict(odd_docs, model).count() == 10
    assert [got[k]["lang_pred"] for k in (1, 2, 5, 7)] == ["und"] * 4 and got[1]["score"] == 0
    assert got[3]["lang_pred"] == "en"
    empty = odd_docs.limit(0)
    assert L.predict(empty, L.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in L.predict(odd_docs, L.fit(empty)).collect()} == {"und"}


def test_ids_equal_the_library(spark, odd_docs):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary()), WordBpe(vocabulary())
    some = [*texts(spark).values()][:80] + [r["text"] or "" for r in odd_docs.collect()] + ["ΟΔΟΣ I'LL <|endoftext|>é<|startoftext|>", "a" * 3000, "İ ½ x²"]
    for t in some:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in encode_documents(odd_docs.where("doc_id < 4"), vocabulary(), keep_ids=True, keep_text=True).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["decoded"] == own.decode(got[3]["ids"]) and len(got[3]["ids"]) == got[3]["n_tokens"]
    assert encode_documents(odd_docs.limit(0), vocabulary()).count() == 0


def test_language_model_base_and_proper_spelling(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op2_lattice_lm"](spark, SF).collect()}
    docs = {i: t.encode().lower().split() + [b"\0end"] for i, t in texts(spark).items()}
    train = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in docs.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["score"] < 0


def test_lattice_sums_over_all_segmentations():
    p = M.load(pieces_path())
    first, on = dict(zip(p.first.tolist(), p.first_log)), dict(zip(p.on.tolist(), p.on_log))
    for word in ("a", "then", "naïve", "zzq😀", "onesen"):
        spelled = 0.0

        def go(at, w):
            nonlocal spelled
            if at == len(word):
                spelled += math.exp(w + p.stop_log)
                return
            for z in range(at + 1, len(word) + 1):
                if (x := on.get(M._hash(word[at:z]))) is not None:
                    go(z, w + x)
            go(at + 1, w + sum(p.bytes_log[b] for b in word[at].encode()))

        for z in range(len(word) + 1):
            if (x := first.get(M._hash(word[:z]))) is not None:
                go(z, x)
        assert float(M.Lattice([word], p).logs()[0]) == pytest.approx(math.log(spelled), rel=1e-9)


def test_language_model_edge_cases(spark, odd_docs, folder):
    docs = odd_docs.withColumn("held_out", F.col("doc_id") == 3).fillna(False)
    got = M.score(docs, pieces_path(), folder()).collect()
    assert len(got) == 10 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 7)) == [1, 1, 1]
    few = M.score(docs, pieces_path(), folder(), head_words=3)
    assert sorted((r["doc_id"] or -1, round(r["score"], 6), r["n_known"]) for r in few.collect()) == sorted((r["doc_id"] or -1, round(r["score"], 6), r["n_known"]) for r in got)
    assert M.score(docs.limit(0), pieces_path(), folder()).count() == 0


def test_toxicity_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    model = entry.queries()["op8_toxicity"].__globals__["fitted"](spark, sf)
    labels = table(spark, sf, "labels").where(held_out("doc_id", 3, 1))
    docs = table(spark, sf, "documents").join(labels, "doc_id").where("toxic = 1 or doc_id % 5 = 0")
    got = T.score(docs.select("doc_id", "text", "toxic"), model).collect()
    bad, good = [r["score"] for r in got if r["toxic"] == 1], [r["score"] for r in got if r["toxic"] == 0]
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_toxicity_edge_cases(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1, 1), (3, 1, 0), (5, 0, 0), (6, 0, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    got = T.score(odd_docs, T.fit(odd_docs, labels)).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert T.fit(odd_docs, labels.limit(0)) is None
    assert {r["score"] for r in T.score(odd_docs, None).collect()} == {0.0}
    assert b"".join(w[1:-1] for w in T.windows("One two " * 50)).replace(b" ", b"") == b"onetwo" * 50


def test_many_distinct_words_are_merged_once():
    import public_tokenizers
    from storelens.llm.bpe import _Codec

    codec, merged = _Codec(public_tokenizers.path("word_bpe_49k.json")), []
    whole = codec.bpe.encode_word
    codec.bpe.encode_word = lambda w: merged.append(w) or whole(w)
    letters = "abcdefghij"
    text = " ".join("q" + "".join(letters[int(d)] for d in str(i)) for i in range(100_000))
    assert codec.code(text) == codec.code(text) and len(merged) == 100_000
