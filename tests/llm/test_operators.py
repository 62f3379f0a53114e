"""Each operator against a plain version, over small tables with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from paymatch.llm import (
    components,
    decontamination,
    fingerprints,
    html_extract,
    ngram_join,
    packing,
    quality,
    secret_scan,
    substring_dedup,
    token_counts,
    warc_fixity,
)

EXTRA = "n_tokens int, row string, hash int, th string, cls string, n int, tree int, starts string, score double, start int, hot int, label string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=3, n=40):
    """Texts with copies, near copies, shared passages, a very long one, one without spaces, odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    out = [None, "", " \n\t ", "One", "two words", "a b c", "\x00 　x", "𝒳 𝒴 z", "a " * 4000, "x" * 9000, text(6000), "  lead  and   trail  "]
    for i in range(n):
        base = text(rng.randint(1, 160))
        out.append(base)
        if i % 4 == 0:
            out.append(base)
        if i % 3 == 0:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "Changed"
            out.append(" ".join(words))
        if i % 5 == 0:
            out.append(f"{text(20)}\n{passage} {text(10)}")
    out.append(f"{passage} {passage}")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus())


def table(spark, texts, ids=None, sources=None):
    extra = (1, "r", 2, "t", "c", 3, 4, "s", 0.5, 5, 6, "l")
    rows = [((ids or range(len(texts)))[i], t, "en" if i % 3 else None, (sources or ["s0", "s1", None])[i % 3], None if t is None else len(t), *extra)
            for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def odd(spark, docs):
    """An empty table, and one with a null id and two texts under one id."""
    return docs.limit(0), spark.createDataFrame([(None, "some words here to see"), (None, None), (5, "one text"), (5, "another text")], "doc_id bigint, text string")


def test_token_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = texts_of(docs)
    for pieces in (1 << 15, 50):
        out = token_counts.count_tokens(docs, limit=100, piece_chars=pieces, batch_bytes=500).collect()
        assert len(out) == docs.count()
        for r in out:
            n = len(model.encode(texts[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)
    empty, some = odd(spark, docs)
    assert token_counts.count_tokens(empty).count() == 0 and token_counts.count_tokens(some).count() == 4


ASSIGN = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?:w|W)(?:d|D))|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secret_scans(spark):
    key, hexes = "AKIA" + "Z9" * 9, "0a1b" * 8
    own = "Ab3" * 9
    texts = [f"𝒳 password = '{hexes}' and {key}", "secret=token:password1 Api_Key : abcdef", "AKIAAKIA" + "B" * 15 + "c", "token=abc token=", None, "",
             f"only here {own}", f"é {key} {key}", f"copy {hexes}", f"copy {hexes}!", f"copy {hexes}?", "PASSWD\"=\"long.value-1=" + "f" * 30]
    df = table(spark, texts)
    found = secret_scan.scan(df).collect()
    assert len(found) == df.count()
    for r in found:
        text = texts[r.doc_id] or ""
        assert r.base_sha256 == sha(plain_spans(text))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(plain_spans(text).count(k) for k in ("assign:", "access:", "hex:"))
        assert set(filter(None, plain_spans(text).split(","))) <= set(filter(None, r.spans.split(",")))
    by_id = {r.doc_id: r for r in found}
    assert by_id[6].spans == f"owned:10:{10 + len(own)}" and by_id[8].n_example == 1 and by_id[6].n_live == 1
    clean = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert clean[6].text == "only here [SECRET]" and clean[8].text == texts[8] and clean[4].text is None and clean[4].n_chars is None
    assert clean[1].text.count("[SECRET]") == 1 and clean[1].n_chars == len(clean[1].text) and clean[6].label == "l"
    assert secret_scan.redact(df).columns == df.columns and secret_scan.redact(df).count() == df.count()
    empty, some = odd(spark, df)
    assert secret_scan.scan(empty).count() == 0 and secret_scan.scan(some).count() == 4


def plain_hits(texts, items):
    windows = defaultdict(set)
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    for item, text in items:
        words = split(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i:i + 10])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in texts.items():
        words, hit, found = split(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i:i + n])]
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab ba cd dé E9".split())
    items = [(i, " ".join(word() for _ in range(k))) for i, k in enumerate([30, 12, 10, 25, 9, 5, 4, 3])]
    items += [(20, "Only."), (21, None), (22, ""), (23, "aa bb cc dd ee ff gg hh ii jj kk"), (1, items[1][1]), (24, items[0][1]), (25, "..;")]
    texts = ["AA, bb cc dd ee ff gg hh ii jj kk", "x aa bb cc dd ee ff gg hh ii", f"see {items[0][1].upper()} end", items[3][1] * 3, None, "", "?!",
             " ".join(word() for _ in range(3000)), "only", *(" ".join(word() for _ in range(40)) for _ in range(20)), items[5][1], items[4][1] + " tail"]
    df, tests = table(spark, texts), spark.createDataFrame(items, "item_id int, text string").withColumn("hash", ngram_join.F.lit("x"))
    want = plain_hits(texts_of(df), items)
    for gram in (5, 3, 10):
        out = decontamination.decontaminate(df, tests, gram=gram).collect()
        assert len(out) == df.count()
        for r in out:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id
    clean = decontamination.keep_clean(df, tests)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, w in want.items() if not w[4]}
    empty, some = odd(spark, df)
    assert decontamination.decontaminate(empty, tests).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(some, tests.limit(0)).collect())


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "in", "a", "theta", "omega"]) + str(rng.choice(["", "s", "ly"])) for _ in range(rng.randint(5, 80))) + "."
    texts = [None, "", "x" * 50_000] + [good() if i % 2 else good().upper().replace(" ", "!! ") for i in range(300)]
    df = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2 == 0 and 1 or 0, 0) for i in range(3, 303)] + [(4, 1, 0), (None, 1, 0), (9999, 0, 1), (7, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    labels = labels.where("doc_id is null or doc_id % 2 = 0 or quality = 0")
    out = quality.classify(df, labels, trees=4, sample_rows=150).collect()
    assert len(out) == df.count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [r for r in out if r.held_out and r.doc_id >= 3]
    assert len(judged) > 50 and sum(r.predicted == (r.doc_id % 2 == 0) for r in judged) / len(judged) > 0.95
    assert quality.keep_good(df, labels, trees=4).columns == df.columns
    empty, some = odd(spark, df)
    assert quality.classify(empty, labels, trees=2).count() == 0
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.classify(some, labels.limit(0)).collect())  # nothing to learn from


def test_tree_rules():
    text = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 1.25E-4)\n    Predict: 0.0\n   Else (feature 1 > 1.25E-4)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0"
    low, high = (0, "<=", 0.5), (1, "<=", 1.25e-4)
    assert quality.tree_rules(text) == [{low}, {low, high}, {low, (1, ">", 1.25e-4)}, {(0, ">", 0.5)}]


PAGES = [(i, f"http://{'big' if i % 3 else 'small'}.example.com/{i}",
          f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><nav><a href='/{i}'>menu</a></nav><!-- <p>no</p> -->"
          f"<article><h1>Head {i}</h1><p><b>Some &amp; text &lt;{i}&gt;<br><p>More\n  text</p><aside>side</aside><form>f<p>q</p></form><div class='comments'><div>c</div>x</div>"
          f"<p>{'word ' * (i * 50)}</p></article><div class=\"ad\">Buy {i}</div><footer>&copy;</footer></body></html>") for i in range(9)]
PAGES += [(20, "http://plain.example.com/", "<div id='m'>Menu</div><div class='text'><p>Hello &eacute;</p><p>there</p></div>"), (21, None, "no tags at all"), (22, "x", None),
          (23, "http://big.example.com/z", ""), (None, "http://big.example.com/n", "<article>null id</article>"), (8, PAGES[8][1], PAGES[8][2])]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "h", 1) for p in PAGES], "page_id bigint, url string, html string, host string, classes int")


def test_html_extraction(spark, pages):
    out = html_extract.extract(pages).collect()
    assert len(out) == len(PAGES)
    got = {r.page_id: r.text for r in out}
    for i in range(9):
        want = [f"Head {i}", f"Some & text <{i}>", "More text", " ".join(["word"] * (i * 50))]
        assert got[i] == "\n".join(w for w in want if w)
    assert got[20] == "Hello é\nthere" and got[22] == got[23] == "" and got[None] == "null id" and got[21] == "no tags at all"
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert html.unescape("&eacute;") == "é"


def test_html_template_decides(spark):
    """Slots come from the host's pages: no article element or telling class, two layouts, a constant notice, broken pages, implied ends."""
    def page(i, layout, end="</div>"):
        body = f"<h1>Title {i}</h1><div class=k0>Read our terms</div><p>first {'abc ' * (i + 3)}<p>second {i * 7}{'' if i % 2 else '<ul><li class=ad>buy</ul>'}"
        if layout == 0:
            return f"<html><body><div class=k1><b>Site</b></div><div class=k2 id=n{i}>{body}{end}<div class=k3>by {i % 5} <article>Top story {i}</article></div></body></html>"
        return f"<table class=k4><tr><td>Old site<td class=k5>{body}<tr><td>x{i % 3}</table>"

    rows = [(i, "http://one.example.com/", page(i, 0)) for i in range(30)]
    rows += [(30, "http://one.example.com/", page(30, 0, ""))]  # its slot is not closed
    rows += [(i, "http://one.example.com/", page(i, 1)) for i in range(40, 60)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in [*range(30), *range(40, 60)]:
        assert got[i].split("\n") == [f"Title {i}", f"first {'abc ' * (i + 3)}".strip(), f"second {i * 7}"]
    assert got[30].startswith("Title 30\nfirst abc") and "terms" not in got[30]


def test_warc_fixity(spark, pages):
    assert warc_fixity.audit(pages, pages).count() == 0 and warc_fixity.audit(pages.limit(0), pages.limit(0)).count() == 0
    changed = pages.where("page_id is null or page_id <> 3").withColumn("html", warc_fixity.F.expr("case when page_id = 5 then concat(html, 'x') else html end"))
    more = changed.unionByName(spark.createDataFrame([(70_000, "u", None, "h", 1)], pages.schema))
    out = {(r.page_id, r.status): r for r in warc_fixity.audit(pages, more).collect()}
    assert set(out) == {(3, "missing"), (5, "changed"), (70_000, "extra")}
    assert out[5, "changed"].replica_length == out[5, "changed"].length + 1 and out[70_000, "extra"].offset is None
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nWARC-Target-URI: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    before = sum(len(record.format(i, u, len(h.encode()), h).encode()) for i, u, h in PAGES[:3])
    assert out[3, "missing"].offset == before and out[3, "missing"].digest == sha(record.format(3, PAGES[3][1], len(PAGES[3][2].encode()), PAGES[3][2]))
    assert warc_fixity.audit(pages, pages.where("page_id is not null")).count() == 1
    assert warc_fixity.audit(pages, pages.dropDuplicates(["page_id", "html"])).count() == 1  # one copy of the repeated row is missing


def test_fingerprints(spark, docs):
    texts, ids = texts_of(docs), sorted(texts_of(docs))
    out = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert set(out) == set(ids)
    for at, i in enumerate(ids):
        text, after = texts[i], texts[ids[(at + 1) % len(ids)]]
        if i == ids[-1]:
            continue  # the last one, which occurs twice: both share one result and are followed by the first
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == 1 or r.edited_sections
        if len(text.split()) > 30 and len(set(text.split())) > 20:
            assert r.near_edited > 0.5
    by_text = defaultdict(set)
    for i, r in out.items():
        by_text[texts[i]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    empty, some = odd(spark, docs)
    assert fingerprints.fingerprints(empty).count() == 0 and fingerprints.fingerprints(some).count() == 4
    one = fingerprints.fingerprints(some.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def plain_components(texts, size, num, den):
    sets = {}
    for i, text in texts.items():
        words = re.findall("[^\x20\x09-\x0D]+", text.translate(LOW))
        sets[i] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    label = {i: i for i in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (2, 60, 100)])
def test_ngram_join(spark, docs, size, num, den):
    want = plain_components(texts_of(docs), size, num, den)
    out = ngram_join.jaccard_components(docs, size, num, den).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_ngram_join_common_shingles(spark, monkeypatch):
    """A large block of near copies, chains of them, and frequent shingles in most texts: nothing is lost, blocks are cut."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 5])):
            words[at] = f"e{rng.randrange(40)}"
        texts.append(" ".join(words))
    texts += [" ".join([f"u{i}_{k}" for k in range(20)] + base[:12]) for i in range(60)]
    df = table(spark, texts)
    monkeypatch.setattr(ngram_join, "PART", 40)
    monkeypatch.setattr(ngram_join, "_CHUNK", 1 << 9)
    want = plain_components(texts_of(df), 4, 70, 100)
    assert len({c for _, c in want.values()}) > 3
    out = ngram_join.jaccard_components(df, 4, 70, 100).collect()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in out)
    kept = ngram_join.keep_representatives(df, 4, 70, 100)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("part", [4096, 16])
def test_ngram_join_counts_all_links(spark, monkeypatch, part):
    """Every class of a large group of near copies is told all its links, not those alone that connect the group."""
    rng = random.Random(5)
    texts = []
    for _ in range(90):
        words = [f"w{i}" for i in range(80)]
        for at in rng.sample(range(80), rng.choice([0, 1, 2, 4])):
            words[at] = f"e{rng.randrange(30)}"
        texts.append(" ".join(words))
    df = table(spark, texts + texts[:5] + ["two words", ""])
    sets = {i: ngram_join.shingles(t, 4).tolist() for i, t in texts_of(df).items()}
    classes = {tuple(x): set(x) for x in sets.values() if x}
    want = {k: sum(100 * len(v & w) >= 80 * len(v | w) for m, w in classes.items() if m != k) for k, v in classes.items()}
    assert sum(want.values()) > 4 * len(want)
    monkeypatch.setattr(ngram_join, "PART", part)
    for r in ngram_join.jaccard_components(df, 4, 80, 100).collect():
        assert r.n_links == want.get(tuple(sets[r.doc_id]), 0)
    assert "n_links" not in ngram_join.jaccard_components(df, 4, 80, 100, every_link=False).columns


def test_ngram_join_repeated_rows(spark):
    """Rows repeated in several tasks, each of which gives the set of its document, and copies under other ids change no link."""
    rng = random.Random(9)
    texts = [" ".join(f"e{rng.randrange(20)}" if rng.random() < 0.02 else f"w{i}" for i in range(80)) for _ in range(25)]
    df = table(spark, texts + texts[:4])
    repeated = df.union(df).union(df).repartition(5, "n_chars", "text", warc_fixity.F.rand(1))
    for every_link in (True, False):
        once, more = (ngram_join.jaccard_components(x, 4, 80, 100, every_link).drop("n_copies").distinct().collect() for x in (df, repeated))
        assert {tuple(r) for r in once} == {tuple(r) for r in more} and len(once) == len(texts) + 4
    want = plain_components(texts_of(df), 4, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in more} == want


def test_ngram_join_odd_tables(spark, docs):
    empty, some = odd(spark, docs)
    assert ngram_join.jaccard_components(empty).count() == 0
    out = ngram_join.jaccard_components(some).collect()
    assert len(out) == 4 and {r.component_id for r in out if r.doc_id is None} == {None}


@pytest.mark.parametrize("seed", range(3))
def test_block_pairs_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    rule = ngram_join.Rule(70, 100)
    sets = []
    for _ in range(30):
        s = rng.integers(0, 2**63, rng.integers(3, 900), dtype=np.uint64)
        sets += [np.unique(s)] + [np.unique(np.append(rng.permutation(s)[: int(len(s) * f)], rng.integers(0, 2**63, 3, dtype=np.uint64))) for f in (0.95, 0.85, 0.75)]
    n, comp = np.array([len(s) for s in sets]), np.arange(len(sets))
    found = {tuple(sorted(p)) for p in zip(*ngram_join.block_pairs(n, comp, [ngram_join.signature(s) for s in sets], rule))}
    linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
              if rule.reached(len(np.intersect1d(sets[a], sets[b])), n[a] + n[b])}
    assert linked and linked <= {(int(a), int(b)) for a, b in found} and len(found) < 3 * len(linked)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (200, 200)]
    out = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = docs.unionByName(table(spark, ["a<|endoftext|>b <|endoftext|>", " " * 5000 + "x"], ids=[900, 901]).limit(2))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for window, block in ((2048, 1 << 22), (64, 500)):
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack(df, window=window, block_tokens=block).collect():
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
        for rows in sequences.values():
            at = 0
            for offset, length in sorted(rows):
                assert offset == at and length > 0
                at += length
            assert at <= window and at & (at - 1) == 0
        assert set(pieces) == set(texts)
        for doc, rows in pieces.items():
            ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], dtype="<u4")
            copies = defaultdict(list)
            for r in rows:
                copies[r.start].append(r)
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            assert sum(r.length for r in rows) == len(ids) * (2 if doc == len(texts) - 3 else 1)  # the repeated row is packed twice
    empty, some = odd(spark, docs)
    assert packing.pack(empty).count() == 0 and packing.pack(some).count() >= 4


def test_length_plans():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        lengths = rng.integers(1, 2048, n)
        rows = packing.plan(lengths, 2048)
        covered = defaultdict(list)
        for row in rows:
            size = sum(e - s for _, s, e in row)
            assert size <= 2048 and size & (size - 1) == 0
            for i, s, e in row:
                covered[i].append((s, e))
        for i, length in enumerate(lengths):
            ends = sorted(covered[i])
            assert ends[0][0] == 0 and ends[-1][1] == length and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    a = packing.combinations(16, 3)
    assert (a.T @ np.arange(1, 17) == 16).all() and a.sum(axis=0).max() == 3


def plain_dedup(rows, window):
    words = [(d, re.findall("[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    count = defaultdict(int)
    for _, w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i:i + window])] += 1
    out = {}
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("window", "gram"), [(35, 10), (12, 4), (10, 10)])
def test_substring_dedup(spark, docs, window, gram, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_CHUNK", 1 << 8)
    want = plain_dedup([(r.doc_id, r.text) for r in docs.collect()], window)
    out = substring_dedup.dedup_substrings(docs, window, gram).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
    empty, some = odd(spark, docs)
    assert substring_dedup.dedup_substrings(empty).count() == 0 and substring_dedup.dedup_substrings(some).count() == 4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = corpus(seed=8, n=30)
    item = "this benchmark item has more than ten words in it so that it is found"
    texts += [f"Intro words then {item.upper()} and more", "own token = abcdefghijklmnop", "LOUD!! WORDS!! ONLY!! HERE!!"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    source = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == source.columns, name
    kept = {r.doc_id: r.text for r in docs.collect()}
    groups = plain_components(texts_of(source), 5, 80, 100)
    leaks = plain_hits(texts_of(source), [(1, item)])
    assert set(kept) == {i for i, (_, c) in groups.items() if c == i and not leaks[i][4]}
    assert kept[len(texts) - 2] == "own [SECRET]"
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)
