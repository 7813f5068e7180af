"""Near-duplicates, repeats and contamination against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from storelens.llm import bwt, decontamination, graph, simhash, simhash_dedup, spherical, suffix_dedup
from storelens.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def components(n, linked):
    up = list(range(n))
    for _ in range(n):
        new = [min([up[i]] + [up[j] for j in range(n) if linked(i, j)]) for i in range(n)]
        if new == up:
            return up
        up = new
    return up


def test_fingerprints_and_groups(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op9_simhash"](spark, SF).collect()}
    texts = {r[0]: (r[1] or "").encode() for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    ids = sorted(texts)
    fp = np.array([simhash.fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    root = components(len(ids), lambda i, j: near[i, j])
    assert all(got[i]["fingerprint"] == f"{int(f):016x}" and got[i]["component_id"] == ids[r] for i, f, r in zip(ids, fp, root))


def test_fingerprint_definition():
    import xxhash

    assert simhash.fingerprint(b" \t ") == 0
    assert simhash.fingerprint(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    h = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c d", b"b c d e", b"c d e f")]
    assert simhash.fingerprint(b"a b\nc d  e f") == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 3)


def test_links_within_radius_in_tiles(spark, folder, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(30)} | {0, (1 << 64) - 1}
    values = sorted(values)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    f = folder()
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(saved(spark.createDataFrame(rows, "doc_id long, fp long"), f, "in"), f).collect()}
    root = components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 4)
    assert got == dict(enumerate(root))


def test_simhash_edge_cases(spark, odd_docs, folder):
    f = folder()
    got = simhash.groups(saved(simhash.fingerprints(odd_docs), f, "m"), f).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fp"] == by[2]["fp"] == 0 and by[7]["component_id"] == by[2]["component_id"] == 1 and by[4]["component_id"] == 0
    f = folder()
    assert simhash.groups(saved(simhash.fingerprints(odd_docs.limit(0)), f, "m"), f).count() == 0


def test_near_copies_keep_one(spark, odd_docs, folder):
    words = [f"w{i}" for i in range(400)]
    r = random.Random(1)
    rows = []
    for k in range(12):
        base = r.sample(words, 80)
        for c in range(4):
            t = list(base)
            for _ in range(c):
                t[r.randrange(80)] = "edit"
            rows.append((100 * k + c, " ".join(t)))
    sets = [set(simhash_dedup.shingle_set(t.encode()).tolist()) for _, t in rows]
    root = components(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), folder())
    assert {r["doc_id"] for r in got.collect()} == {rows[i][0] for i in set(root)}
    odd = simhash_dedup.keep_one(odd_docs, folder())
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in odd.collect()) == [-1, 0, 1, 3, 5, 6] and odd.columns == odd_docs.columns
    assert simhash_dedup.keep_one(odd_docs.limit(0), folder()).count() == 0


def test_near_copies_with_a_repeated_line(spark, folder):
    """Copies that repeat a short line often have nearly the same shingle sets."""
    r = random.Random(5)
    rows = []
    for k in range(12):
        text = " ".join(f"u{r.randrange(10**6)}" for _ in range(300))
        line = " ".join(f"l{r.randrange(10**6)}" for _ in range(5))
        rows += [(10 * k, text), (10 * k + 1, text + (" " + line) * 200)]
    sets = [set(simhash_dedup.shingle_set(t.encode()).tolist()) for _, t in rows]
    root = components(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), folder())
    assert {r["doc_id"] for r in got.collect()} == {rows[i][0] for i in set(root)} == {10 * k for k in range(12)}


def test_meeting_places_of_a_common_line_grow_with_the_input(spark, folder, monkeypatch):
    """Tiles of a shingle that many texts share grew with the square of their number; copies are still found."""
    r, met, inner = random.Random(8), [], simhash_dedup.tiled
    monkeypatch.setattr(simhash_dedup, "TILE", 8)

    def counting(*args):
        out = inner(*args)
        met[-1] += out.count()
        return out

    monkeypatch.setattr(simhash_dedup, "tiled", counting)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    line = words(12)
    for count in (40, 160):
        rows = []
        for k in range(count):
            own = words(r.randint(15, 80))
            rows += [(10 * k + 1, " ".join(own + line))] + [(10 * k, " ".join(own + line + words(1)))] * (k % 4 == 0)
        rows += [(10**6 + k, " ".join(line + words(k))) for k in range(4)]  # common for the most part
        sets = [set(simhash_dedup.shingle_set(t.encode()).tolist()) for _, t in rows]
        root = components(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        met.append(0)
        got = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), folder())
        least = {c: min(rows[i][0] for i in range(len(rows)) if root[i] == c) for c in set(root)}
        assert {x["doc_id"] for x in got.collect()} == set(least.values())
    assert 0 < met[1] < 6 * met[0]


def cover_of_repeats(docs, length=100):
    """Which bytes of each document, a list of (doc_id, bytes), repeat strings of earlier places."""
    first = {}
    for i, b in docs:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, (1 << 70, 0)), (i, p))
    out = []
    for i, b in docs:
        flags = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (i, p):
                flags[p] += 1
                flags[p + length] -= 1
        out.append((i, b, np.cumsum(flags[:-1]) > 0))
    return out


def left_of(b, cover):
    return bytes(c for c, k in zip(b, cover) if not k)


def what_is_left(docs):
    return {i: (len(b), left_of(b, cover)) for i, b, cover in cover_of_repeats(docs)}


def brute_repeats(docs):
    return sorted((i, len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(left_of(b, cover)).hexdigest())
                  for i, b, cover in cover_of_repeats(docs))


@pytest.mark.parametrize("tile", [4, 4096])
def test_repeats_equal_brute_force(spark, odd_docs, folder, monkeypatch, tile):
    monkeypatch.setattr(suffix_dedup, "TILE", tile)
    r = random.Random(2)
    prose = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passage, other = prose(180), prose(130)
    rows = [(k, prose(r.randint(0, 150)) + (passage if k % 2 else "") + prose(r.randint(0, 60)) + (other if k % 3 == 0 else "") + prose(40)) for k in range(40)]
    rows += [(50, "ab" * 300), (51, "a" * 450), (52, "ab" * 120 + "c" + "a" * 160), (53, passage[:99]), (54, passage[5:150]), (55, passage + passage), (55, passage + passage), (56, None), (57, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.deduplicate(docs, folder()).collect())
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in rows])
    if tile == 4:
        odd = suffix_dedup.deduplicate(odd_docs, folder(), keep_text=True).collect()
        assert len(odd) == 10 and {x["n_bytes"] for x in odd if x["doc_id"] in (1, 2)} == {0}
        assert suffix_dedup.deduplicate(odd_docs.limit(0), folder()).count() == 0


def test_texts_without_id_and_equal_short_hashes(spark, folder):
    """Different texts of which 32 bits of a hash agree keep their own removal marks, also without an id."""
    import xxhash

    r = random.Random(12)
    passage, other = ("".join(r.choice("abcdefghij ") for _ in range(150)) for _ in range(2))
    seen = {xxhash.xxh32_intdigest(t.encode()): t for t in (f"{passage}{r.getrandbits(64):016x}" for _ in range(200_000))}
    b = next(t for t in (f"{other}{r.getrandbits(64):016x}" for _ in range(1_000_000)) if xxhash.xxh32_intdigest(t.encode()) in seen)
    rows = [(1, passage), (None, seen[xxhash.xxh32_intdigest(b.encode())]), (None, b)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), folder(), keep_text=True)
    assert sorted((x["n_removed"], x["kept"]) for x in got.collect()) == [(0, b), (0, passage), (150, rows[1][1][150:])]


def rows_compared(spark, docs, folder, monkeypatch):
    """What ``deduplicate`` gives, and how many rows are compared in tasks or as strings."""
    import os

    seen, inner = spark.sparkContext.accumulator(0), suffix_dedup._compare

    def counting(batches):
        def passed():
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return inner(passed())

    monkeypatch.setattr(suffix_dedup, "_compare", counting)
    where = folder()
    got = suffix_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), where).collect()
    strings = f"{where.removeprefix('file://')}/strings"
    return got, seen.value + (spark.read.parquet(strings).count() if os.path.exists(strings) else 0)


def test_work_on_a_hot_passage_grows_with_its_places(spark, folder, monkeypatch):
    """Tiles of a passage's variants grew with the square of their number."""
    monkeypatch.setattr(suffix_dedup, "TILE", 8)
    r = random.Random(5)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, compared = prose(130), []
    for count in (40, 160):
        with monkeypatch.context() as m:
            docs = [(k, prose(150) + passage + prose(150)) for k in range(count)]
            got, rows = rows_compared(spark, docs, folder, m)
        assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == brute_repeats([(i, t.encode()) for i, t in docs])
        compared.append(rows)
    assert 0 < compared[1] < 5 * compared[0]


def test_anchors_in_common_alone_are_not_compared(spark, folder, monkeypatch):
    """Texts with 50 bytes in common, which hold an anchor but no string of 100 bytes, went to the comparison."""
    r = random.Random(6)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = prose(50)
    got, rows = rows_compared(spark, [(k, prose(150) + passage + prose(150)) for k in range(40)], folder, monkeypatch)
    assert rows == 0 and {x["n_removed"] for x in got} == {0}


@pytest.mark.parametrize("tile", [2, 4096])
def test_equal_places_of_texts_without_id(spark, folder, monkeypatch, tile):
    """Strings at one start of different texts of one id are ordered by the texts' hashes; all of them stayed."""
    monkeypatch.setattr(suffix_dedup, "TILE", tile)
    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    texts = [passage + "".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(5)]
    got = suffix_dedup.deduplicate(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), folder(), keep_text=True)
    first = min(texts, key=lambda t: suffix_dedup.text_key(t.encode()))
    left = {x["kept"] for x in got.collect()}
    assert first in left and all(t == first or t not in left for t in texts)


def test_merged_transforms_equal_sorted_suffixes():
    r = np.random.default_rng(4)
    shards = [r.integers(97, 99, size=n).astype(np.uint8) for n in (300, 1, 77, 512)]
    got = np.concatenate(bwt.classes(shards, 12))
    want = np.concatenate([[bytes(np.roll(s, -i)[np.arange(12) % len(s)]) for i in range(len(s))] for s in shards])
    names = {w: k for k, w in enumerate(sorted(set(want.tolist())))}
    assert got.tolist() == [names[w] for w in want.tolist()]


@pytest.mark.parametrize("widest,depth,passes", [(8, 100, 13), (4, 100, 25), (2, 100, 50), (8, 12, 2), (8, 13, 2)])
def test_merge_by_wide_symbols(monkeypatch, widest, depth, passes):
    """Symbols of any width give the same classes, in as few passes as the width allows."""
    r = np.random.default_rng(8)
    base = r.integers(97, 123, size=700).astype(np.uint8)
    shards = [np.concatenate([base[:400], r.integers(97, 123, size=90).astype(np.uint8)]), base[100:650], base[:3], np.full(150, 97, dtype=np.uint8)]
    taken, merge = [], bwt.merge
    monkeypatch.setattr(bwt, "merge", lambda p: taken.append(len(p)) or merge(p))
    got = np.concatenate(bwt.classes(shards, depth, widest))
    want = np.concatenate([[bytes(s[(i + np.arange(depth)) % len(s)]) for i in range(len(s))] for s in shards])
    names = {w: k for k, w in enumerate(sorted(set(want.tolist())))}
    assert got.tolist() == [names[w] for w in want.tolist()] and taken == [passes]


def test_many_symbols_take_fewer_bytes():
    """Over 65 536 different eight-byte symbols: the merge goes on with four or two bytes, and finds the same."""
    r = np.random.default_rng(9)
    shards = [r.integers(0, 255, size=60_000).astype(np.uint8) for _ in range(2)]
    shards[1][500:700] = shards[0][100:300]
    a, b = bwt.classes(shards, 100)
    both = np.intersect1d(a, b)
    assert np.flatnonzero(np.isin(a, both)).tolist() == list(range(100, 201)) and (a[100:201] == b[500:601]).all()


def test_groups_are_taken_a_few_rows_at_a_time():
    """A batch of many rows is handed on in tables of about the asked number, a large group whole."""
    keys = np.concatenate([np.repeat(np.arange(1500), 2), np.full(1300, 1500), np.arange(1501, 2201)])
    got = [t.column("h").to_numpy() for t, _ in graph.whole_groups(iter([pa.RecordBatch.from_arrays([pa.array(keys)], names=["h"])]), ["h"], 500)]
    assert (np.concatenate(got) == keys).all() and sorted(map(len, got))[-2] <= 1000 and sum((g == 1500).any() for g in got) == 1


def test_contamination_equals_brute_force(spark, folder):
    r = random.Random(6)
    words = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([60, 60, 55, 30, 4, 1, 12])] + [(90, None), (91, " ,.")]
    docs = []
    for k in range(30):
        body = [r.choice(words) for _ in range(r.randint(0, 80))]
        item = items[k % 7][1].split()
        for _ in range(k // 10):
            item[r.randrange(len(item))] = "edit"
        at = r.randint(0, len(body))
        docs.append((k, " ".join([*body[:at], *item, *body[at:]]).upper().replace(" ", ", ", 3)))
    docs += [(40, items[0][1] + "."), (41, " ".join(items[1][1].split()[:58])), (42, None), (43, "")]
    toks = lambda t: [w for w in __import__("re").split(r"[^0-9a-z]+", (t or "").lower()) if w]
    want = {}
    for d, t in docs:
        w = toks(t)
        for i, it in items:
            q = toks(it)
            if not q:
                continue
            k = min(5, len(q))
            sh = lambda x: [tuple(x[p : p + k]) for p in range(len(x) - k + 1)]  # noqa: E731,B023
            a, b = sh(q), sh(w)
            for s in range(max(1, len(b) - len(a) + 1)) if b else ():
                win = b[s : s + len(a)]
                both = sum(min(win.count(x), a.count(x)) for x in set(win))
                if both and both >= 0.8 * (len(win) + len(a) - both) - 1e-12:
                    want[d, i] = max(want.get((d, i), 0), both / (len(win) + len(a) - both))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontamination.matches(*frames, folder(), radius=24).collect()}
    assert got == pytest.approx(want)
    shuffled = decontamination.matches(*frames, folder(), radius=24, broadcast_rows=0)
    assert {(x["doc_id"], x["item_id"]) for x in shuffled.collect()} == set(want)
    clean = decontamination.drop_contaminated(*frames, folder(), radius=24)
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.matches(frames[0], frames[1].limit(0), folder()).count() == 0


def test_contamination_at_the_similarity_with_defaults(spark, folder):
    """Pairs barely over the similarity, and windows with a repeated word, are found with the production settings."""
    r = random.Random(9)
    items = [(k, [f"x{r.randrange(10**7)}" for _ in range(58 if k < 300 else 200)]) for k in range(320)]
    docs, want = [], {}
    for k, w in items:
        if k < 300:
            docs.append((k, ["edit", *w[1:29], "edit", *w[30:]]))
            want[k, k] = 48 / 60
        else:
            docs.append((k, w[:180] + ["again"] * 20))
            want[k, k] = 176 / 216
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontamination.matches(*frames, folder()).collect()}
    assert len(got) == len(want) and got == pytest.approx(want)


def test_contamination_of_texts_shorter_than_the_item(spark, folder):
    """Items of 9 to 21 words against texts cut by some words: n shingles, of which the first m are left, give m / n."""
    items = [(n, [f"y{n}x{i}" for i in range(n)]) for n in range(9, 22)]
    docs = [(100 * n + cut, w[:-cut]) for n, w in items for cut in range(1, 5)]
    want = {(100 * n + cut, n): (n - 4 - cut) / (n - 4) for n, _ in items for cut in range(1, 5) if (n - 4 - cut) / (n - 4) >= 0.8}
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontamination.matches(*frames, folder()).collect()}
    assert len(got) == len(want) and got == pytest.approx(want)


def test_vectors_equal_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(spherical, "TILE", 16)
    monkeypatch.setattr(spherical, "DENSE", 12)
    r = np.random.default_rng(8)
    rows = []
    for k in range(40):
        c = r.standard_normal(64)
        for _ in range(1 + (k % 5) * 8):
            rows.append((len(rows), (c + r.standard_normal(64) * r.choice([0.0, 0.08, 0.15])).tolist(), int(k % 3)))
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [1e300] * 64, None), (904, [1e300] * 64, 7), (905, [1e-300] * 64, 7), (906, [1.0] * 3, 7), (907, [2.0] * 3, 7), (908, [], 7), (909, [None] + [1.0] * 63, 7)]
    got = {x["vec_id"]: x for x in spherical.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), folder()).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([k for _, _, k in rows])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
    root = components(len(rows), lambda i, j: near[i, j])
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(rows))]) > 0.97
    assert [got[i]["n_links"] for i in range(900, 910)] == [0, 0, 0, 0, 1, 1, 1, 1, 0, 0]
    assert got[905]["component_id"] == 904 and not got[905]["kept"] and got[901]["kept"]
    assert spherical.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), folder()).count() == 0


def test_vectors_that_share_an_id(spark, folder):
    a, b, far = [1.0, 0.0, 0.0], [1.0, 0.05, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 1), (1, far, 1), (2, b, 1), (3, [0.0, 0.02, 1.0], 1), (3, [0.0, 0.02, 1.0], 1), (0, far, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in spherical.near_duplicates(df, folder()).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]
