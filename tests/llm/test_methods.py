"""The operators against brute force, the tokenizers library or planted cases."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accesslake.llm import html, jaccard, langid, linedup, rangejoin, topk
from accesslake.llm.bpe import TextCodec
from accesslake.llm.common import components
from accesslake.llm.mixing import mixing_rates
from accesslake.llm.queries import label_domains
from accesslake.llm.sharding import gapless, shard_documents

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
CODEC, LIBRARY = TextCodec(open(VOCAB).read()), Tokenizer.from_file(VOCAB)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aehinst '.!<|>ofdtx1é²_", max_size=80),
                          st.sampled_from(["<|endoftext|>", "a<|startoftext|>B", "ΣΑΣ İ", "é", "\x1c\x85 x", "ha" * 300])), max_size=8))
def test_bpe_is_the_library_s(texts):
    for (ids, decoded), wanted in zip(CODEC.encode_all(texts), LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids
        assert decoded == LIBRARY.decode(wanted.ids, skip_special_tokens=False)


def test_bpe_forgets_and_stays_right(monkeypatch):
    from accesslake.llm import bpe
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    c = TextCodec(open(VOCAB).read())
    texts = [" ".join(f"tok{i}en{j}" for j in range(40)) for i in range(20)]
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in itertools.chain(*(c.encode_all([t]) for t in texts))] == [
        e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_bpe_encodes_a_word_once_whatever_stands_around_it(monkeypatch):
    from accesslake.llm import bpe
    monkeypatch.setattr(bpe, "CACHED_WORDS", 1000)
    c = TextCodec(open(VOCAB).read())
    encode, seen = c.bpe.encode_words, []
    monkeypatch.setattr(c.bpe, "encode_words", lambda words: encode([seen.append(w) or w for w in words]))
    words = [a + b + d for a in ("er", "tion", "ou", "wh") for b in ("an", "in", "le", "re", "st") for d in ("ble", "ing", "ça", "é", "th")]
    texts = [" ".join(f % w for w in words) for f in ("%s", "%s,", "%s.", "(%s)", "%s;", "%s!?", "'%s'", "%s:", "%s...", "*%s*", "-%s", "%s#")]
    texts += [t.upper() for t in texts]
    for wanted, text in zip(LIBRARY.encode_batch(texts, add_special_tokens=False), texts):
        assert np.frombuffer(c.encode_all([text])[0][0], "<u4").tolist() == wanted.ids
    assert len(seen) == len(set(seen)) and set(words) <= set(seen)


def test_bpe_splits_plain_characters_as_the_library():
    from accesslake.llm import bpe
    plain = [x for x in map(chr, range(0x3000)) if bpe._PLAIN.fullmatch(x)]
    texts = [f"{x} {x}{x} a{x}b {x}'s 'LL{x}9{x}{y}_{y.upper()}{x}<|ENDOFTEXT|>{x}" for x, y in zip(plain, plain[1:] + plain)]
    texts += ["".join(plain), " ".join(plain), "I'm we'Re 'd'd ''ve !'s <|endoftext|>'t<|startoftext|>", "a" * 3000, "9" * 500, "?!" * 900]
    for (ids, decoded), wanted in zip(CODEC.encode_all(texts), LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids
        assert decoded == LIBRARY.decode(wanted.ids, skip_special_tokens=False)


def components_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [
        (5000, 5000 + i) for i in range(200)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = components_of(links, {x for p in links for x in p})
    assert all(got.get(n, n) == c for n, c in wanted.items()) and got.keys() <= wanted.keys()


def near_copies(seed=1):
    """Families of near copies around the threshold, short texts, shared passages, and texts of their own."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(40))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rnd.choice((6, 8, 9, 12, 14, 20, 30, 60, 120)))]
        for _ in range(60 if family < 3 else 6):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 12 + (rnd.random() < 0.3))):
                own[rnd.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(rnd.randrange(60))) for _ in range(60)]
    rows += [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6)] * 2
    return list(enumerate(rows))


@pytest.mark.parametrize("limit", [4, 32])
def test_jaccard_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "LIST", limit)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = near_copies()
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    wanted = components_of(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) > 500
    assert got == {i: (len(s), wanted[i]) for i, s in sets.items()}


def test_html_variants_and_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit(pages)
    right = wrong = 0
    for r in pages.filter("page_id % 3 = 0").collect():
        found = html.blocks(r.html)
        for b, keep in zip(found, model.label([html.vectors(found)])[0]):
            right += keep == ("article" in b.path)
            wrong += keep != ("article" in b.path)
    assert wrong <= 0.002 * right
    page = ("<body><header><div class=logo>My Site</div></header><div class='container'><div class='post-content'><h1>Title</h1><p>The first paragraph "
            "has a number of words, and it is long.</p><div class='advertisement'>Buy now</div><p>The second one &lt;ends&gt; here.</p></div>"
            "<section id=comments><div class=comment><p>I think that this is great, thanks for it.</p></div></section></div><footer>Rights</footer>")
    found = html.blocks(page)
    kept = [b.text for b, k in zip(found, model.label([html.vectors(found)])[0]) if k]
    assert kept == ["Title", "The first paragraph has a number of words, and it is long.", "The second one <ends> here."]


def test_odd_markup_loses_no_text():
    read = lambda page: [b.text for b in html.blocks(page)]
    assert read("<article><p data-n=O'Brien>One whole paragraph.</p><p>Two.</p><p>It's three.</p></article>") == [
        "One whole paragraph.", "Two.", "It's three."]
    assert read('<p><a href="x>broken</a> link</p><p class="y">Next "one" here</p>') == ["broken link", 'Next "one" here']
    assert read("<p title='a > b' data-x=\"<b>bold</b>\">text</p>") == ["text"]
    assert read('<p class = "a" id=b>x</p><p "stray>y</p>') == ["x", "y"]
    deep = "<div>" * 4000 + "core" + "</p>" * 4000 + "after" + "</div>" * 4000 + "end"
    start = time.perf_counter()
    assert read(deep) == ["core", "after", "end"]
    assert time.perf_counter() - start < 0.5
    assert read("<div><p>a</div>b</p>c</div>d") == ["a", "b", "c", "d"]


def test_gradients_of_the_labeller():
    model, r = html.Labeller(3), np.random.default_rng(0)
    x, mask = r.normal(size=(3, 5, html.INPUT)).astype(np.float32), np.ones((3, 5), np.float32)
    mask[0, 3:] = 0
    y = (r.random((3, 5)) < 0.5).astype(np.float32)

    def loss():
        z = model.logits(x, mask).astype(np.float64)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    grads = model.step(x, mask, y, mask)
    for name in ("wf", "ub", "bf", "out", "uf"):
        at = tuple(r.integers(s) for s in model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-2
        up = loss()
        model.p[name][at] = old - 1e-2
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 1e-3


@pytest.mark.parametrize("lines, keys", [(500_000, 500_000), (0, 500_000), (0, 0)])
def test_line_dedup_by_brute_force(spark, monkeypatch, lines, keys):
    monkeypatch.setattr(linedup, "BROADCAST_LINES", lines)
    monkeypatch.setattr(linedup, "BROADCAST_KEYS", keys)
    rnd = random.Random(5)
    line = lambda: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(rnd.randint(1, 12)))
    runs = [[line() for _ in range(rnd.randint(1, 6))] for _ in range(12)]
    rows = []
    for i in range(80):
        body = []
        for _ in range(rnd.randint(1, 4)):
            body += rnd.choice(runs) if rnd.random() < 0.6 else [line() for _ in range(3)]
            body += [""] * (rnd.random() < 0.3)
        rows.append((i, "\n".join(body)))
    least = 12
    docs = {i: [(k, x.strip()) for k, x in enumerate(t.split("\n")) if x.strip()] for i, t in rows}

    def window(lines, s):
        words = 0
        for e in range(s, len(lines)):
            words += len(lines[e][1].split())
            if words >= least:
                return tuple(x for _, x in lines[s:e + 1])

    first = {}
    for i, lines in docs.items():
        for s in range(len(lines)):
            if w := window(lines, s):
                first.setdefault(w, (i, s))
    wanted = {}
    for i, lines in docs.items():
        gone = set()
        for s in range(len(lines)):
            if (w := window(lines, s)) and first[w] != (i, s):
                j, s0 = first[w]
                low, high = s, s + len(w)
                while high < len(lines) and s0 + high - s < len(docs[j]) and lines[high][1] == docs[j][s0 + high - s][1]:
                    high += 1
                while low > 0 and low - s + s0 > 0 and lines[low - 1][1] == docs[j][low - 1 - s + s0][1]:
                    low -= 1
                if i == j:
                    low = max(low, s0 + 1)
                gone |= {k for k, _ in lines[low:high]}
        wanted[i] = len(gone)
    got = {r.doc_id: r.n_removed for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()}
    assert sum(wanted.values()) > 100 and got == wanted


@pytest.mark.parametrize("targets", [{"clean": 0.85, "junk": 0.08, "toxic": 0.07}, {"clean": 0.90, "junk": 0.07, "toxic": 0.03}])
def test_mixing_meets_its_targets(spark, targets):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing_rates(docs, label_domains(labels), targets).collect()
    p, n, rate = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    wanted = np.array([targets[d] for d in sorted(targets)]) * n.sum()
    assert np.allclose((rate * n) @ p, wanted, rtol=1e-3) and (rate >= 0).all()
    # a long plain descent gets no closer
    x, mass = np.ones(len(rows)), n @ p
    for _ in range(5000):
        x = np.maximum(0, x - p @ (((x * n) @ p - wanted) / mass))
    assert np.allclose((x * n) @ p, (rate * n) @ p, rtol=2e-3)
    known = {r.doc_id: r.domain for r in label_domains(labels).collect()}
    clean = [r.domain for r in rows if known.get(r.doc_id) == "clean"]
    assert clean.count("clean") >= 0.97 * len(clean)


def test_mixing_out_of_reach(spark):
    """With rates up to 1 and no weight on two domains: no allowed move of any rate lowers the loss."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing_rates(docs, label_domains(labels), {"clean": 1.0, "junk": 0.0, "toxic": 0.0}, max_rate=1.0).collect()
    p, n, rate = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    mass = n @ p
    wanted = np.array([mass[0], 0.0, 0.0])
    x = np.ones(len(rows))
    for _ in range(20000):
        x = np.clip(x - p @ (((x * n) @ p - wanted) / mass), 0, 1)
    loss = lambda r: ((((r * n) @ p - wanted) ** 2) / mass).sum()
    assert (rate >= 0).all() and (rate <= 1).all() and loss(rate) <= loss(x) * (1 + 1e-3) + 1e-6 * mass.sum()


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = langid.identify(docs.filter(held_out), langid.fit(docs.filter(~held_out))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_kernel_and_ridge_by_numpy(spark):
    """The fitted scores against the kernel and the ridge written out, over sets of hashed n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL").limit(120)
    docs = spark.createDataFrame(docs.select("doc_id", "text", "lang").collect(), "doc_id long, text string, lang string")
    model = langid.fit(docs, landmarks=10_000)  # every text is a landmark: the kernel is that of all of them
    rows = sorted(((r.lang, str(r.doc_id), r.text) for r in docs.collect()))
    has, letter = langid.presence([t for *_, t in rows])
    sets = [set(np.flatnonzero(h)) for h, l in zip(has, letter) if l]
    names = [n for (n, *_), l in zip(rows, letter) if l]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    got = model.kernel(has[letter]) @ model.weights
    # ridge regression in the space of the kernel's features, each language weighing the same
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-6 * values.max()
    features = vectors[:, keep] * np.sqrt(values[keep])
    y = np.array([[float(n == m) for m in model.languages] for n in names])
    share = (1 / y.sum(axis=0))[y.argmax(axis=1)][:, None]
    weights = np.linalg.solve(features.T @ (features * share) + langid.RIDGE * y.shape[1] / 10 * np.eye(keep.sum()), features.T @ (y * share))
    assert np.abs(got - features @ weights).max() < 2e-2 and (got.argmax(axis=1) == (features @ weights).argmax(axis=1)).all()


def test_language_of_very_many_names(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 30)
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('words of number ', id) AS text", "concat('l', id % 300) AS lang")
    assert 5 <= len(langid.fit(docs).languages) <= 80


@pytest.mark.parametrize("block, cells", [(7, 256), (7, 5), (2048, 16)])
def test_top_k_by_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "CELLS", cells)
    monkeypatch.setattr(topk, "SCAN_ROWS", 37)
    monkeypatch.setattr(topk, "SCAN_QUERIES", 11)
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(400, 6)), 1)  # many ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(q.query_id, q.rank): (q.vec_id, q.score) for q in topk.top_k(rows, rows.filter("vec_id % 20 = 0"), k=9).collect()}
    v = np.floor(64 * x).astype(int)
    for q in range(0, 400, 20):
        best = sorted(((-int(v[q] @ v[c]), c) for c in range(400) if c != q))[:9]
        assert [got[q, k + 1] for k in range(9)] == [(c, -s) for s, c in best]


@pytest.mark.parametrize("block", [50, 8192])
def test_range_join_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rangejoin, "BLOCK", block)
    r = np.random.default_rng(6)
    centres = r.normal(size=(9, 5))
    x = centres[r.integers(9, size=500)] + r.normal(size=(500, 5)) * r.choice((0.05, 0.3, 1.0), size=(500, 1))
    x[100:130] = x[99]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    root = components_of(zip(*map(np.ndarray.tolist, np.nonzero(hit))), range(500))
    got = {q.vec_id: (q.n_links, q.component_id) for q in rangejoin.range_join(rows, 0.9).collect()}
    assert got == {i: (int(hit[i].sum()), root[i]) for i in range(500)}


def test_range_join_stores_a_vector_once(spark, monkeypatch, tmp_path):
    """However many cells it may have links in, and in whatever blocks it is compared."""
    monkeypatch.setattr(rangejoin, "BLOCK", 100)
    monkeypatch.setattr(rangejoin, "PIVOTS", (16, 16))
    r = np.random.default_rng(8)
    x = r.normal(size=(2000, 32)).astype(np.float32)
    x[1000:] = x[:1000] + r.normal(size=(1000, 32)) * 0.05
    x[700:705], x[705] = x[699], -0.0 - x[699] * 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(rangejoin, "work_dir", lambda _, name: str(tmp_path / name))
    shuffled = []
    monkeypatch.setattr(rangejoin, "materialise", lambda df, name, real=rangejoin.materialise: shuffled.append((name, df.schema)) or real(df, name))
    got = {q.vec_id: (q.n_links, q.component_id) for q in rangejoin.range_join(rows, 0.9).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    root = components_of(zip(*map(np.ndarray.tolist, np.nonzero(hit))), range(2000))
    assert got == {i: (int(hit[i].sum()), root[i]) for i in range(2000)} and hit.sum() > 1500
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    assert sum(len(b.x) for b in blocks.select("x").collect()) == 4 * 32 * len(np.unique(u.round(12), axis=0))  # as singles, as they came
    assert blocks.count() > 16 and not any("array" in f.dataType.simpleString() for _, schema in shuffled for f in schema)


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"text {i if i % 3 else i // 30}") for i in range(900)] + [(1000 + i, "a hot text") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_documents(docs, 10).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 10
    assert (got.groupby("shard").slot.max() == sizes - 1).all() and (got.groupby("shard").slot.nunique() == sizes).all()
    text = dict(rows)
    got["digest"] = [hashlib.md5(text[i].encode()).hexdigest() for i in got.doc_id]
    hot = got[got.digest == hashlib.md5(b"a hot text").hexdigest()].groupby("shard").size().sort_values()
    assert hot.iloc[-4:].sum() >= 0.7 * 450  # a third of all rows fills more than three shards
    small = got[got.digest.map(got.digest.value_counts()).isin((10, 11))].groupby("digest").shard.nunique()
    assert len(small) == 30 and (small == 1).sum() >= 15


def test_gapless(spark):
    rows = gapless(spark.range(1000).withColumn("k", F.col("id") % 7), "k", "id").collect()
    assert [r.position for r in sorted(rows, key=lambda r: (r.k, r.id))] == list(range(1000))


def test_top_k_lengths_and_repeated_rows(spark):
    rows = [(0, []), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [2.0]), (4, [1.0]), (3, [0.0, 2.0]), (5, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted = set()
    for q in {i for i, x in rows if x}:
        near = sorted((-int(64 * np.array(x) @ np.array(y) * 64), j) for i, x in rows for j, y in rows if i == q != j and x and len(x) == len(y))
        wanted |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(near[:4])}
    got = topk.top_k(vectors, vectors, k=4).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_threshold_of_very_long_lists():
    shared = np.arange(95_871, 96_471, 3)  # exactly at 75 percent with 7 / 3 of their number as sizes
    total = shared // 3 * 7
    assert jaccard._reaches(shared.astype(np.float32), total, 75).all()
    assert not jaccard._reaches(shared.astype(np.float32), total + 1, 75).any()
