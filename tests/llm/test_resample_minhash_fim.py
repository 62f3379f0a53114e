"""Importance resampling, MinHash near-duplicates and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paymatch.llm import fill_in_middle, importance, minhash_dedup, star_components

EXTRA = "sig string, key int, cls string, n int, seq int, rank string, weight int, score double, label int, a int, b int, _p int, _digest int, h1 int, output string"
SCHEMA = f"doc_id bigint, text string, {EXTRA}"


def table(spark, texts, ids=None):
    extra = ("s", 1, "c", 2, 3, "r", 4, 0.5, 5, 6, 7, 8, 9, 10, "o")
    rows = [(i, t, *extra) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA)  # a repeated row


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéZ9") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(k))
    out = [None, "", " \n ", "One", "two words", "\x00 x\x00y", "𝒳 𝒴 z", "x" * 5000, "a " * 3000, text(4000), "İ ß K"]
    return out + [text(rng.randint(1, 120)) for _ in range(n)]


def plain_features(text, orders=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i:i + n]).encode()) for n in range(1, orders + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 19])
@pytest.mark.parametrize("orders", [1, 2, 3])
def test_batches_keep_runs_inside_their_text(size, orders):
    texts = corpus(n=10)
    words, sums = np.zeros(len(texts), np.int64), [Counter() for _ in texts]
    for n, found in importance.text_features(texts, orders, size):
        words += n
        for rows, crcs in found:
            for row, crc in zip(rows.tolist(), crcs.tolist()):
                sums[row][crc] += 1
    for text, n, got in zip(texts, words, sums):
        assert (n, got) == plain_features(text, orders)


def test_importance_resampling(spark):
    texts, target = corpus(), ["One of two words", None, "z z z zz", ""]
    docs, bench = table(spark, texts), spark.createDataFrame([(t,) for t in target], "text string")
    kept = [*texts, texts[-1]]
    s, t = Counter(), Counter()
    for side, all_ in ((s, kept), (t, target)):
        for text in all_:
            for crc, c in plain_features(text)[1].items():
                side[crc % 50] += c
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (s.total() + 50) / ((s[k] + 1) * (t.total() + 50)))) for k in range(50)}
    want = []
    for i, text in zip([*range(len(texts)), len(texts) - 1], kept):
        n, found = plain_features(text)
        weight = sum(c * gain[crc % 50] for crc, c in found.items())
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, found.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    order = sorted((r for r in want if r[5] >= 10), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(order[:len(order) * 30 // 100], 1):
        r[4] = rank
    got = importance.resample(docs, bench, percent=30, least_words=10, buckets=50)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)
    assert sum(r[4] is not None for r in want) > 10


def test_importance_of_odd_tables(spark):
    docs = table(spark, corpus(n=5))
    assert importance.resample(docs.limit(0), docs).count() == 0
    out = importance.resample(docs, docs.limit(0)).collect()
    assert len(out) == docs.count() and all(r.weight == 0 for r in out if r.n_features == 0)
    ties = spark.createDataFrame([(None, "w " * 30), (4, "w " * 30), (4, "w " * 30), (None, None)], "doc_id bigint, text string")
    out = importance.resample(ties, docs, percent=100).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3] and sum(r["rank"] is None for r in out) == 1


def plain_components(texts, size, num, den):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        return {tuple(w[i:i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(i, len(s), top(i), top(i) == i) for i, s in enumerate(sets)]


def near_copies(seed, edits, copies=12, words=80):
    """An original and copies with some words changed, and chains of which each link changes a few words more."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for k in range(4):
        base = [word() for _ in range(words)]
        chain = base
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(words)] = word()
            at = rng.randrange(words)
            chain = [*chain[:at], word(), *chain[at + 1:]]
            out += [" ".join(copy), " ".join(chain)]
    return out


@pytest.mark.parametrize("part, size, num, den", [(3, 4, 80, 100), (2048, 5, 80, 100), (3, 2, 3, 4)])
def test_minhash_components_equal_all_pairs(spark, monkeypatch, part, size, num, den):
    monkeypatch.setattr(minhash_dedup, "PART", part)
    texts = [*corpus(n=20), *near_copies(1, 3), *near_copies(2, 8), "two words", "TWO  words", "a b c d", "a b c d e"]
    random.Random(4).shuffle(texts)
    got = minhash_dedup.near_duplicates(table(spark, texts), size, num, den).distinct().collect()
    assert sorted(map(tuple, got)) == plain_components(texts, size, num, den)


def test_minhash_of_odd_tables(spark):
    docs = table(spark, corpus(n=5))
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "some words here to see"), (7, "some words here to see"), (None, None), (5, "one"), (5, "other text")], "doc_id bigint, text string")
    got = sorted(minhash_dedup.near_duplicates(rows).collect(), key=str)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(5, 5, True), (5, 5, True), (7, 7, True)]
    assert sorted((r.n_shingles, r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(0, True, True), (1, False, False)]


def test_minima_are_those_of_the_hash_functions():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, k, np.uint64)) for k in (1, 5, 40_000, 3, 20_000, 1)]
    got = minhash_dedup.minima(sets)
    for row, s in zip(got, sets):
        for f in (0, 77, 159):
            assert row[f] == (minhash_dedup.mix(s) * minhash_dedup._MULTIPLY[f] + minhash_dedup._ADD[f]).min() >> np.uint64(32)
    a, b = sets[2], sets[2][4000:]  # a similarity of 0.9
    x, y = minhash_dedup.minima([a, b])
    assert abs((x == y).mean() - 0.9) < 0.1


def test_star_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5300)] + [(9, 9)]
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = star_components.star_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.label for r in got} == {x: top(x) for x in linked} and len(got) == len(linked)
    assert star_components.star_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("units", [0, 1, 15, 16, 17, 256, 257, 5000])
def test_skip_list_reaches_every_rank(units):
    points = np.random.default_rng(units).integers(1, 9, units)
    lanes, want = fill_in_middle.SkipList(points), np.append(0, np.cumsum(points))
    assert [lanes.offset(r) for r in range(units + 1)] == want.tolist()
    assert all(lane[0].sum() == units and lane[1].sum() == points.sum() for lane in lanes.lanes) and len(lanes.lanes[-1][0]) <= fill_in_middle.FAN


def plain_fim(doc_id, text):
    text, d = text or "", hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", text, n, None, None
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", f"<S>{s}<P>{p}<M>{m}", n, a, b - a) if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}", n, a, b - a)


def test_fill_in_middle(spark):
    rng = random.Random(8)
    texts = [*corpus(n=20), "<P>", "a <S> b", "x<M>", *("".join(rng.choice("<PSM>é𝒳") for _ in range(rng.randint(1, 30))) for _ in range(300))]
    docs = table(spark, texts)
    out = {r.doc_id: r for r in fill_in_middle.with_restored(fill_in_middle.transform(docs)).collect()}
    assert {r.form for r in out.values()} == {"plain", "psm", "spm"}
    for i, text in enumerate(texts):
        r = out[i]
        assert (r.form, r.output, r.n, r.prefix_chars, r.middle_chars) == plain_fim(i, text) and r.restored == (text or "")
    digests = fill_in_middle.digests(docs).collect()
    assert len(digests) == docs.count()
    assert all(r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in digests)
    assert fill_in_middle.digests(docs.limit(0)).count() == 0
    none = fill_in_middle.transform(spark.createDataFrame([(None, "some text"), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted(len(r.output) for r in none)[0] == 0 and len(none) == 2


def test_fill_in_middle_of_words(spark):
    docs = spark.createDataFrame([(i, f"  uno dos  tres {'mm ' * i}fin ") for i in range(60)], "doc_id bigint, text string")
    for r in fill_in_middle.with_restored(fill_in_middle.transform(docs, unit=r"\S+")).collect():
        text = f"  uno dos  tres {'mm ' * r.doc_id}fin "
        assert r.restored == text and r.n == r.doc_id + 5
        if r.form != "plain":  # no word is cut
            for cut in (r.prefix_chars, r.prefix_chars + r.middle_chars):
                assert cut in (0, len(text)) or text[cut - 1] == " "


def test_fill_in_middle_holds_slices_and_restores_without_python():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["é" * 5000] * 1000})
    parts = fill_in_middle.slices(batch)
    assert len(parts) > 4 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in fill_in_middle.slices(batch.slice(0, 1))] == [1] and fill_in_middle.slices(batch.slice(0, 0)) == []


def test_fill_in_middle_restores_odd_pieces(spark):
    """Pieces that begin or end like marks; rebuilt by columns, with one Python worker a task."""
    docs = spark.createDataFrame([(i, t) for i in range(300) for t in ["<", "<P", "P>S><", "<P<S<M>"[:-1], "é<\U0001f600<S", "\n<M\n>"]], "doc_id bigint, text string")
    rows = fill_in_middle.with_restored(fill_in_middle.transform(docs, plain_percent=0)).join(docs, "doc_id").select("form", "output", "restored").collect()
    assert {r.form for r in rows} >= {"psm", "spm"}
    texts = {r.text for r in docs.collect()}
    assert {r.restored for r in rows} == texts
    plan = fill_in_middle.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
