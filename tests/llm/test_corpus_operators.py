"""SimHash, decontamination, mixing, language, main text and the pipeline."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from weekcast.llm import decontam, html_blocks, langid, mixing, simhash
from weekcast.llm.oracle import ORACLE
from weekcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(map(repr, want))


# ------------------------------------------------------------------------- simhash

def near_texts(rng, n):
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", "one", "One", "a b c", "A  b\tc", " ".join(vocab)]
    while len(texts) < n:
        if rng.random() < 0.5:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 200))))
        else:
            w = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    return texts


def test_simhash_matches_brute_force(spark, make_docs):
    texts = near_texts(random.Random(4), 120)
    fps = [brute.fingerprint(t) for t in texts]
    roots = brute.component_of(fps)
    ids = [500 - i for i in range(len(texts))]
    ids[0] = None
    least = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    docs = make_docs(texts + texts[:3], ids=ids + ids[:3])
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    want = [(ids[i], f"{fps[i]:016x}", least[roots[i]]) for i in [*range(len(texts)), 0, 1, 2]]
    assert got == sorted(want, key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    keep = sorted(r.doc_id for r in kept.collect())
    assert keep == sorted(least[r] for r in set(roots))


def test_simhash_tiles_and_large_groups(spark):
    rng = random.Random(9)
    center = [rng.getrandbits(64) for _ in range(3)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
                for c in center for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute.component_of(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    group = {}
    for f, r in zip(signed, want):
        group.setdefault(r, []).append(f)
    for blocks, most in ((5, 8), (6, 20)):
        edges = simhash.linked_edges(frame, tile=32, blocks=blocks)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        for members in group.values():
            assert {roots.get(f, f) for f in members} == {min(members)}
        assert edges.count() < most * len(fps)
    assert [simhash.block_count(10 ** k) for k in (5, 6, 9, 11, 15)] == [5, 5, 6, 7, 8]


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    for i in range(100, 200):
        fps[i] = fps[i - 100] ^ sum((np.uint64(1) << np.uint64(b)) for b in rng.choice(64, i % 10, replace=False))
    words = np.zeros(256, dtype=np.uint64)
    words[:200] = fps
    valid = np.array([~np.uint64(0)] * 3 + [np.uint64(0xFF)], dtype=np.uint64)
    q, w = np.repeat(np.arange(200), 4), np.tile(np.arange(4), 200)
    item, lane = simhash.near_lanes(simhash._planes(words.reshape(-1, 64)), fps[q], w, valid, radius)
    want = {(i, j) for i in range(200) for j in range(200) if bin(int(fps[i] ^ fps[j])).count("1") <= radius}
    assert set(zip(q[item].tolist(), lane.tolist())) == want


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")],
                                 "doc_id long, text string, _w_fp long, root string")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b", 3, "x")]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# ------------------------------------------------------------------- decontamination

def test_decontamination_matches_brute_force(spark, make_docs):
    rng = random.Random(3)
    word = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(word) for _ in range(rng.randint(5, 60)))) for i in range(25)]
    items += [(90, "Short Item"), (91, ""), (92, None), (93, "x"), (25, items[0][1]), (None, "null id of five words")]
    texts = [None, "", "x", "a short  ITEM here", "null id of five words"]
    for i in range(80):
        w = [rng.choice(word) for _ in range(rng.randint(0, 900))]
        passage = (rng.choice(items)[1] or "").upper().split()
        for _ in range(rng.randint(0, 3)):  # some fall below the threshold
            if passage:
                passage[rng.randrange(len(passage))] = "changed"
        at = rng.randint(0, len(w))
        texts.append(" ".join(w[:at]) + "\n" + ", ".join(passage) + ". " + " ".join(w[at:]))
    docs = make_docs(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.leaks(enumerate(texts), items), key=repr)
    got = [tuple(r)[:4] for r in decontam.contaminated(docs, bench).collect()]
    assert sorted(got, key=repr) == want and len(want) > 30
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {x[0] for x in want})
    assert decontam.remove_contaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_benchmark_in_several_blocks(spark, make_docs, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(40)]
    docs = make_docs([f"before {t} after" for _, t in items[::2]] + ["clean text of some words"])
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.item_id for r in decontam.contaminated(docs, bench).collect()) == list(range(0, 40, 2))
    assert [r.text for r in decontam.remove_contaminated(docs, bench).collect()] == ["clean text of some words"]


def test_word_hashes_of_long_words(monkeypatch):
    text = b"ab " + b"x" * 300_000 + b" ab " + b"y" * 10 + b" " + b"x" * 300_000
    hashes = decontam.word_hashes(text)[3]
    assert len(hashes) == 5 and hashes[0] == hashes[2] and hashes[1] == hashes[4]
    assert len(set(hashes.tolist())) == 3


# --------------------------------------------------------------------------- mixing

def test_mixing_targets_and_takes(spark):
    rng = random.Random(1)
    rows = []
    for k, (name, n) in enumerate((("b", 300), ("a", 40), (None, 60), ("é", 10), ("c", 900), ("zero", 3))):
        for i in range(n):
            size = 0 if name == "zero" else int(rng.paretovariate(1.2) * 20)
            rows.append((1000 * k + i, None if i == 7 else " ".join(["w"] * size), name))
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, (5, 2, 1) * 3))
    total, cut = sum(sizes.values()), set()
    while True:
        factor = (total - sum(3 * sizes[s] for s in cut)) / sum(weight[s] for s in sizes if s not in cut)
        more = {s for s in sizes if s not in cut and weight[s] * factor > 3 * sizes[s]}
        if not more:
            break
        cut |= more
    taken = {}
    for r in got:
        want = 3 * sizes[r.source] if r.source in cut else weight[r.source] * factor
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        taken[r.source, 0] = r.target
    for s in sizes:
        assert abs(taken[s] - taken[s, 0]) <= max(25, 0.02 * taken[s, 0])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs.limit(0)).count() == 0


# ------------------------------------------------------------------------- language

def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 4, 0, 6, 2])
    scores = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32)
    labels = langid.viterbi(scores, counts, 1.5)

    def value(s, path):
        return s[np.arange(len(path)), path].sum() - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

    at = 0
    for n in counts:
        s, mine = scores[at:at + n], labels[at:at + n].tolist()
        best = max((value(s, list(p)) for p in np.ndindex(*[3] * n)), default=0)
        assert not n or value(s, mine) == pytest.approx(best)
        at += n


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_language"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_mixed_and_odd_texts(spark, make_docs):
    a, b = "the cat and the dog went there with them ", "der Hund und die Katze gehen nicht weiter "
    docs = make_docs([a * 9] * 5 + [b * 9] * 5 + ["привет мир как дела " * 9] * 2,
                     langs=["en"] * 5 + ["de"] * 5 + ["ru"] * 2)
    model = langid.train(docs, "text", "lang", "doc_id")
    texts = [None, "", "12 + 3!", a * 3 + b * 2, "привет the", "🙂🙂", "\U00010400\U00010401", "漢字"]
    lang, score, spans = langid.predict(texts, model)
    assert lang[:4] == ["und", "und", "und", "en"] and lang[4] == "ru" and lang[5] == "und"
    assert lang[6] in ("de", "en", "ru") and lang[7] in ("de", "en", "ru")
    first, second = spans[3].split(",")
    assert first.startswith("en:0:") and second.startswith("de:") and int(second.split(":")[1]) == len(a * 3)
    assert all(0 <= s <= 1 for s in score)
    got = langid.identify(make_docs(texts), model).collect()
    assert [r[5] for r in got] == lang
    none = langid.train(docs.limit(0), "text", "lang", "doc_id")
    assert langid.predict(["some text"], none)[0] == ["und"]


# ------------------------------------------------------------------------ main text

def test_main_text_of_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op2_main_text"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    for k, r in got.items():
        inner = pages[k].html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(__import__("html").unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split())
                 for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text) and r.url == pages[k].url


FORMS = """<html><head><title>T</title><script>if (a < b) { x("<p>no</p>"); }</script></head><body>
<div class="page"><header><a href="/">Site</a></header><ul class="menu"><li><a href="/a">Home</a></ul>
<main><h1>Title &amp; more</h1><p>First real   text with <b>bold</b> and <a href="x">a link</a>,&nbsp;and words.
<p>Second <!-- no --> paragraph of the story follows here.<aside class="sidebar">Side</aside>
<div class="comments"><p>A reader says this.</p></div><form>Name <input><button>Send</button></form></main>
<footer>&copy; foot</footer></div></body></html>"""


def test_main_text_of_other_forms(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_blocks.train(pages, "html", "page_id")
    odd = [None, "", "plain words", "<p", "<p class='x", "<!-- open", "<script>x", "<a" * 2000, "<p>" * 3000, FORMS]
    texts = html_blocks.extract_batch(odd, weights)
    assert texts[-1] == ("Title & more\n\nFirst real text with bold and a link, and words.\n\n"
                         "Second paragraph of the story follows here.")
    assert texts[0] == "" and texts[1] == "" and all(isinstance(t, str) for t in texts)
    assert html_blocks.extract_batch(["<article><p>word " + "x " * 100_000 + "</article>"], weights)[0].count("x") == 100_000
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_blocks.extract(empty).count() == 0


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in html_blocks._new_weights(rng).items()}
    x = rng.normal(size=(2, 5, html_blocks.DIMS))
    up = rng.normal(size=(2, 5, html_blocks.HIDDEN))
    for side in "fb":
        _, trace = html_blocks._read(w, side, x, True)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        html_blocks._read_back(w, side, x, trace, up, grad)
        for name in ("x", "h", "b"):
            key, at = side + name, tuple(rng.integers(s) for s in w[side + name].shape)
            value = []
            for step in (1e-5, -1e-5):
                moved = dict(w, **{key: w[key].copy()})
                moved[key][at] += step
                value.append((html_blocks._read(moved, side, x, False)[0] * up).sum())
            assert grad[key][at] == pytest.approx((value[0] - value[1]) / 2e-5, rel=1e-4, abs=1e-7)


# ------------------------------------------------------------------------- pipeline

def test_pipeline_matches_brute_force(spark):
    from test_line_runs import brute as dedup

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{SF}/documents.parquet")

    kept = [d for d in docs if (s := brute.stats(d[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    got = stages["quality_rules"](spark, frame, SF)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == kept  # no host is guilty here

    clean = dedup([(d[0], d[1]) for d in kept], 50)
    kept = [(d[0], t, *d[2:]) for d, t in zip(kept, clean)]
    roots = brute.component_of([brute.fingerprint(d[1]) for d in kept])
    kept = [d for i, d in enumerate(kept) if roots[i] == i]
    bad = {x[0] for x in brute.leaks([(d[0], d[1]) for d in kept], items)}
    kept = [d for d in kept if d[0] not in bad]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {k: r.size for k, r in rows.items()} == {d[0]: len(brute.words(d[1])) for d in kept}
    frame = spark.createDataFrame(kept, frame.schema)
    assert sorted(map(tuple, rows.values())) == sorted(map(tuple, stages["mix_sources"](spark, frame, SF).collect()))


def test_registration():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(ORACLE) <= set(entry.oracle_sql())


def test_operator_names_do_not_clash(spark, make_docs):
    docs = make_docs(["a b", None]).withColumn("score", F.lit(1)).withColumn("spans", F.lit("x"))
    model = langid.train(docs, "text", "lang", "doc_id")
    assert langid.identify(docs, model).columns[:7] == docs.columns
