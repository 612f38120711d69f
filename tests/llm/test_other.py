"""Neighbours, URL filters, main text, media, mixing, packing and the pipeline."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import ann, common, html, media, mixing, packing, url_filter
from placewise.llm.common import table

from .brute_html import classes, extract, skeleton, slot, template_texts
from .conftest import DATA


def test_neighbours_recall(spark):
    got = ann.op2_nearest(spark, DATA).toPandas()
    rows = table(spark, DATA, "embeddings").select("vec_id", "embedding").toPandas()
    x, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert own.score.to_numpy() == pytest.approx(np.array([s[ids == v][0] for v in own.vec_id]), abs=1e-12)
        hits += len(set(own.vec_id) & set(ids[np.argsort(-s)[:20]]))
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, nan]), (6, [1.0, inf]), (7, [1.0, None]), (8, [1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (None, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("part", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_balanced_parts():
    x = np.random.default_rng(0).standard_normal((400, 8))
    own = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 8)
    assert np.bincount(own, minlength=8).max() <= np.ceil(400 / 8 * ann.SLACK)


def test_parts_grow_with_rows():
    sizes = [0, 1, 2_000, 16_000, 51_282, 1_000_000, 10**8, 10**12]
    parts = [first * small for first, small in map(ann.parts_for, sizes)]
    assert parts == sorted(parts) and parts[0] == ann.PARTS and parts[4] == 57 and ann.parts_for(4_000_000) == (500, 1)
    assert ann.parts_for(10**8) == (512, 5) and parts[-1] >= 10**6 / ann.ROOT


def test_draw_is_the_least_hashes(spark):
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"))
    want = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(100).collect()
    assert ann.draw(rows, 20_000, 100).collect() == want
    assert ann.draw(rows.limit(50), 50, 100).count() == 50


def test_few_ids_often_repeated(spark):
    rows = spark.range(12_000).select(F.when(F.col("id") < 6000, 20).otherwise(7).cast("long").alias("vec_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"))
    got = ann.nearest(rows, rows.where("vec_id = 20"), k=3).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(20, i, 7) for i in (1, 2, 3)]


def test_many_parts_find_the_neighbours(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    few, many, twice = ({(r.query_id, r.vec_id) for r in ann.nearest(rows, rows.where("vec_id % 20 = 0"), parts=p).collect()} for p in (1, 60, (6, 8)))
    assert len(few) == len(many) == len(twice) and len(few & many) >= 0.9 * len(few) and len(few & twice) >= 0.9 * len(few)


def test_tree_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    net = lambda p: ann.Router([r.standard_normal((8, ann.UNITS)), np.zeros(ann.UNITS), r.standard_normal((ann.UNITS, p)), np.zeros(p)])
    tree, x = ann.Tree(net(5), 4, {0: net(4), 2: net(3), 3: net(4)}), r.standard_normal((50, 8))
    p = tree.probabilities(x)
    assert p.shape == (50, 20) and p.sum(axis=1) == pytest.approx(np.ones(50))
    own = tree.own(x)
    assert (own // 4 == tree.top.probabilities(x).argmax(axis=1)).all() and own.max() < 20


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{DATA}/pages.parquet'")
    want = sorted(con.sql(url_filter.OP4_SQL).fetchall(), key=repr)
    assert sorted((tuple(r) for r in url_filter.op4_url_filter(spark, DATA).collect()), key=repr) == want


def test_url_rules(spark):
    cases = {
        "http://Example.ORG/es/x": ("block", "example.org/es/"), "http://a.example.org/en/12": ("block", "example.org/en/1"), "http://example.org/en/2": ("allow", "org/"),
        "http://xexample.org/es/": ("allow", "org/"), "http://b.com/fr/1": ("allow", "com/fr/"), "http://b.com/de/?q": ("block", "com/de/"), "http://b.com/en/": ("allow", None),
        "http://org": ("allow", None), "http://org/?x=/es/": ("allow", "org/"), "no scheme": ("allow", None), None: ("allow", None), "": ("allow", None), "x://" + "a." * 5000 + "org/": ("allow", "org/"),
        "http://example.org#/es/": ("allow", None),
    }
    df = spark.createDataFrame([(u, "clash", "kept") for u in [*cases, None]], "url string, rule string, _best string")
    for r in url_filter.judge_urls(df, url_filter.RULES).collect():
        assert (r.verdict, r.rule, r["_best"]) == (*cases[r.url], "kept"), r.url
    assert url_filter.judge_urls(df.limit(0), url_filter.RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.array(F.concat(F.lit("k"), F.col("id"))).alias("keys"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("key")).unionByName(spark.createDataFrame([(None,), ("elsewhere",)], "key string"))
    c = url_filter.Cascade.build(universe, "keys", listed)
    assert len(c.levels) > 2
    got = universe.select(F.explode("keys").alias("k")).where(c.contains(F.col("k"))).count()
    right = universe.select(F.explode("keys").alias("k")).where(c.contains(F.col("k")) == (F.substring("k", 2, 9).cast("int") % 7 == 0)).count()
    assert got == 429 and right == 3000
    assert universe.where(url_filter.Cascade().contains(F.col("keys")[0])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><script>if (a</b/.test("<p>")) {{}}</script></head><body class="home menu">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<{main}><h1>Title {n} &amp; more</h1><p>First&nbsp;block {n}<br>goes   on <b>bold</b>.<p>Second {n}</p><ul><li>one {n}<li>two</ul><div class="advert">Buy</div>
<pre>x &lt; y {n}</pre><table><tr><td>a</td><td>b{n}</td></tr></table></{main}><aside>Side {n}</aside><section id="comments"><p>Nice {n}</p></section>
<form><p>Mail</p><input></form><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize("main", ["article", "main", "div"])
def test_main_text(main):
    pages = [PAGE.format(n=n, main=main) for n in range(8)]
    for n, got in enumerate(extract(pages)):
        assert got.split("\n\n") == [f"Title {n} & more", f"First block {n} goes on bold.", f"Second {n}", f"one {n}", "two", f"x < y {n}", f"a b{n}"]


def test_layout_words_and_lone_pages():
    inside = "<article><header><h1>T</h1></header><p>Body text.</p></article>"
    for outer in ('<html class="nav-open"><body>{}</body>', '<body><div class="page with-sidebar">{}</div><div class="sidebar">s</div>', '<div id="widget-area">{}</div>', '<div role="main">{}</div><div class="topbar">x</div>'):
        assert extract([outer.format(inside)]) == ["T\n\nBody text."], outer
    assert extract([f"{inside}<div class='comments'><article><p>Nice!</p></article></div>"]) == ["T\n\nBody text."]
    assert extract(["<div class=content><p>One</p><div class=share>x</div></div><div class=menu>y</div>"]) == ["One"]


def test_main_text_odd_pages(spark):
    rows = [(1, "http://a/x", None), (2, None, ""), (3, "http://a/y", "plain text only"), (4, "http://a/y", "<p>cut off <b"), (5, "http://b/", "<article><p>x</p>" + "<p>long words here</p>" * 20_000), (5, "http://b/", "<article><p>twice"), (6, "http://c", "<div " + "a" * 100_000), (None, "http://c", "<article>&#x41;&lt;b&gt; &bogus; &#0;</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("salt", F.lit(1))
    got = {(r.page_id, r.n_chars): r.text for r in html.main_texts(df).collect()}
    assert len(got) == 8 and all(n == len(t) for (_, n), t in got.items())
    text = {i: t for (i, n), t in got.items() if i != 5}
    assert (text[1], text[2], text[3], text[4]) == ("", "", "plain text only", "cut off")
    assert text[None].startswith("A<b> &bogus;")
    assert sorted(t.count("\n\n") for (i, _), t in got.items() if i == 5) == [0, 20_000]
    assert html.main_texts(df.limit(0)).count() == 0


def test_equivalence_classes():
    pages = [html.Page(f"<body><div><h1>a</h1><ul>{'<li>x' * k}</ul></div></body>") for k in (1, 2, 3)]
    found = classes(pages)
    assert {t.rpartition(">")[2] for t in found[(1, 1, 1)]} == {"", "body", "div", "h1", "ul"}
    assert [t.rpartition(">")[2] for t in found[(1, 2, 3)]] == ["li"]
    # tokens that swap places are not valid, those around them are
    swapped = [html.Page(f"<body><h1>t</h1>{a}<p>x</p></body>") for a in ("<div class=a>1</div><div class=b>2</div>", "<div class=b>2</div><div class=a>1</div>")]
    assert {t.rpartition(">")[2] for t in skeleton(swapped)} == {"", "body", "h1", "p"}


def test_classes_choose_the_slot_beside_an_article():
    # the article holds a teaser; the text that differs is elsewhere, so the article isn't the main slot
    page = "<body><article><p>Hint {n}</p></article><div class=text><p>" + "long {n} words {n} here " * 20 + "</p><p>end {n}</p></div></body>"
    for n, got in enumerate(extract([page.format(n=n) for n in range(8)])):
        assert got.endswith(f"end {n}") and f"long {n} words" in got
    pages = [html.Page(PAGE.format(n=n, main="article")) for n in range(8)]
    main, told = slot(pages)
    assert told and main in skeleton(pages) and main.endswith(">article")
    # pages of another template in the chunk change nothing
    mixed = [PAGE.format(n=n, main="article") for n in range(8)] + ["<body class=start><p>Welcome</p></body>"]
    assert extract(mixed)[:8] == extract(mixed[:8]) and extract(mixed)[8] == "Welcome"

def test_slot_holds_all_that_differs():
    page = "<body><div class=content><h1>Title {n}</h1><div class=lead>Lead {n}</div><div class=text><p>" + "word{n} " * 60 + "</p><p>End {n}</p></div></div></body>"
    for n, got in enumerate(extract([page.format(n=n) for n in range(8)])):
        assert got.split("\n\n") == [f"Title {n}", f"Lead {n}", " ".join([f"word{n}"] * 60), f"End {n}"]
    page = "<body><div class=x><h1>Title {n}</h1><p>" + "word{n} " * 60 + "</p></div></body>"
    assert all(got.startswith(f"Title {n}\n\n") for n, got in enumerate(extract([page.format(n=n) for n in range(8)])))
    for n, got in enumerate(extract([PAGE.format(n=n, main="div") for n in range(8)])):
        assert got.split("\n\n") == [f"Title {n} & more", f"First block {n} goes on bold.", f"Second {n}", f"one {n}", "two", f"x < y {n}", f"a b{n}"]

def test_copies_are_no_template():
    text = "<h1>The title</h1><p>" + " ".join(f"w{i}" for i in range(60)) + "</p><p>last words</p>"
    page = "<body><div class=day>day {n}</div><div class=content>{text}</div></body>"
    want = extract([f"<body><div class=content>{text}</div></body>"])[0]
    copies = [page.format(n=n, text=text) for n in range(52)]
    others = [page.format(n=n, text=f"<h1>Title {n}</h1><p>" + " ".join(f"v{n}x{i}" for i in range(40)) + "</p>") for n in range(52, 64)]
    for chunk in (copies[:5], copies, copies + others):
        for got, _ in zip(extract(chunk), copies, strict=False):
            assert want in got
    # near copies share the title and most words
    near = [page.format(n=n, text=text.replace("w7 ", f"z{n} ")) for n in range(8)]
    assert all("The title" in got and got.endswith("last words") for got in extract(near))
    # what pages that differ have in common is the template still
    common = [p.replace("<body>", "<body><div class=top>Welcome to us</div>") for p in others]
    assert all("Welcome" not in got and f"Title {n}" in got for n, got in enumerate(extract(common), 52))


def _hosts() -> dict[str, list[str]]:
    """Pages of several hosts, for the rules above and for templates that differ by host."""
    teaser = "<body><article><p>Hint {n}</p></article><div class=text><p>" + "long {n} words {n} here " * 20 + "</p><p>end {n}</p></div></body>"
    deep = "<body><div class=content><h1>Title {n}</h1><div class=lead>Lead {n}</div><div class=text><p>" + "word{n} " * 60 + "</p><p>End {n}</p></div></div></body>"
    day = "<body><div class=top>Welcome to us</div><div class=day>day {n}</div><div class=content>{text}</div><div class=low>See you</div></body>"
    copy = "<h1>The title</h1><p>" + " ".join(f"w{i}" for i in range(60)) + "</p><p>last words</p>"
    swap = ["<div class=a>one {n}</div><div class=b>two {n}</div>", "<div class=b>two {n}</div><div class=a>one {n}</div>"]
    return {
        "main": [PAGE.format(n=n, main=m) for m in ("article", "main", "div") for n in range(8)], "teaser": [teaser.format(n=n) for n in range(8)], "deep": [deep.format(n=n) for n in range(70)],
        "copies": [day.format(n=n, text=copy) for n in range(52)] + [day.format(n=n, text=f"<h1>T {n}</h1><p>" + " ".join(f"v{n}x{i}" for i in range(40)) + "</p>") for n in range(52, 64)],
        "swap": ["<body><h1>Same</h1>" + swap[n % 2].format(n=n) + "<p>fixed</p></body>" for n in range(10)], "same": ["<body><p>alike</p><div>on all</div></body>"] * 7,
        "lone": ["<div class=content><p>One</p></div>"], "empty": ["", "<nav>x</nav>"], "mixed": [PAGE.format(n=n, main="article") for n in range(8)] + ["<body class=start><p>Welcome</p></body>"],
    }


def test_main_texts_against_whole_hosts(spark, monkeypatch):
    """The sums over all pages give what the rules give page by page; also where templates are hot, and on the test table."""
    hosts = _hosts()
    rows = [(f"{h}{i}", f"http://{h}/{i}", s) for h, pages in hosts.items() for i, s in enumerate(pages)]
    want = {f"{h}{i}": t for h, pages in hosts.items() for i, t in enumerate(extract(pages))}
    df = spark.createDataFrame(rows, "page_id string, url string, html string").withColumns({"row": F.lit("clash"), "key": F.lit("clash")}).repartition(5)
    for hot in (1000, 5):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "HOT_KEYS", 10**9)
        got = html.main_texts(df).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    pages = table(spark, DATA, "pages")
    by_host = {}
    for r in pages.withColumn("h", url_filter.url_parts(F.col("url"))[0]).collect():
        by_host.setdefault(r.h, []).append((r.page_id, r.html))
    want = {i: t for own in by_host.values() for (i, _), t in zip(own, extract([s for _, s in own]), strict=True)}
    assert {r.page_id: r.text for r in html.op5_main_text(spark, DATA).collect()} == want
    # without article elements the classes find the same texts
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    assert {r.page_id: r.text for r in html.main_texts(plain).collect()} == want


def test_media_round_trip(spark, odd_docs, no_docs):
    got = [r for r in media.audio_digests(odd_docs).collect()]
    texts = {r["doc_id"]: r["text"] for r in odd_docs.select("doc_id", "text").collect()}
    assert len(got) == 14
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.store(want)).hexdigest() and r.media_bytes == len(media.store(want)) and media.read(media.store(want)) == want
    by = {r["doc_id"]: r.feature for r in got}
    assert by[1] == by[7] and by[2] == by[3] and media.audio_digests(no_docs).count() == 0
    for full in media.audio_columns(odd_docs).collect():
        stored, spans = media.read_features(bytes(full.features))
        made, made_spans = media.features(bytes(full.media))
        again, _ = media.read_features(media.store_features(made, made_spans))
        assert again.equals(made) and stored.type == media.TENSOR and spans == made_spans
        assert stored.to_numpy_ndarray() == pytest.approx(made.to_numpy_ndarray(), abs=1e-4)  # another process may add up in another order
        assert media.read(bytes(full.media)) == media.payload(texts[full.doc_id])[0]
    assert media.audio_columns(odd_docs, keep_media=False).where("media IS NOT NULL OR features IS NULL").count() == 0


def test_media_features():
    t = np.arange(32000) / media.RATE
    tone = np.sin(2 * np.pi * 1000 * t) * np.where((t > 0.5) & (t < 1.0), 1.0, 0.05)
    half = media.resample(tone.astype(np.float32))
    assert len(half) == 16000 and np.abs(half[5000:7000]).max() == pytest.approx(1, abs=0.02)
    assert np.abs(media.resample(np.sin(2 * np.pi * 7000 * t).astype(np.float32))[100:-100]).max() < 0.02  # above half the new rate
    direct = np.convolve(np.pad(tone, 24, mode="edge"), media._LOWPASS[::-1], "valid")[::2]
    assert half == pytest.approx(direct, abs=1e-4)
    mels, energy = media.log_mel(half)
    [(a, b)] = media.segments(energy)
    assert a * media.OFFSET / media.TO_RATE == pytest.approx(0.5, abs=0.05) and b * media.OFFSET / media.TO_RATE == pytest.approx(1.0, abs=0.05)
    clip = media.store(((tone * 0.9 + 1) * 127).astype(np.uint8).tobytes())
    tensors, spans = media.features(clip)
    assert tensors.type == media.TENSOR and tensors.to_numpy_ndarray().shape == (len(spans), media.PATCH, media.MELS)
    assert mels.shape == (len(energy), media.MELS)


def _targets(sizes):
    """Shares by weight, capped, the excess reshared again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    got = mixing.op7_mixing(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source"), "doc_id").toPandas()
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = _targets(sizes)
    again = mixing.op7_mixing(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").taken
    assert (got.set_index("doc_id").taken.sort_index() == again.sort_index()).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for s, own in got.groupby("source"):
        assert own.target.iloc[0] == pytest.approx(want[s]) and own.source_size.iloc[0] == sizes[s]
        assert abs(own.taken.sum() - want[s]) <= max(0.01 * want[s], own["size"].max())


def test_balance_solves_the_dual(spark):
    r = np.random.default_rng(0)
    rows = [("sa", i, int(s)) for i, s in enumerate(r.lognormal(5, 1, 400))] + [("sb", i, int(s)) for i, s in enumerate(r.lognormal(4, 1.5, 300))] + [("sc", 1, 10)]
    params, _ = mixing.balance(spark.createDataFrame(rows, "key string, doc_id long, size long"))
    found = 0
    for p in params.collect():
        if not p.full:
            size = np.array([s for k, _, s in rows if k == p.key], float)
            rate = np.minimum(2, np.exp(p.lam * size / p.scale))
            assert (rate * size).sum() == pytest.approx(p.target, rel=1e-6)
            found += 1
    assert found


def test_mixing_odd_rows(odd_docs, no_docs):
    got = mixing.mix_counts(odd_docs).toPandas()
    assert len(got) == 14 and (got.taken <= 2 * got["size"]).all()
    assert got[got.doc_id.isin([2, 3, 4])][["size", "taken"]].to_numpy().sum() == 0
    assert mixing.mix_counts(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == got.taken.sum()


def _one_by_one(count, capacity):
    """Best-two-fit, bin after bin."""
    left, n = count.copy(), 0
    while left.sum():
        own = packing.fill(left, capacity)[0][0]
        for s in own:
            left[s] -= 1
        n += 1
    return n


def test_best_two_fit():
    count = np.zeros(11, np.int64)
    count[[6, 3, 2]] = [1, 1, 2]  # greedy takes 6 + 3; the 3 gives way to both 2s
    assert packing.fill(count, 10)[0] == ([6, 2, 2], 1)
    r = np.random.default_rng(1)
    for _ in range(20):
        count = np.zeros(101, np.int64)
        for s in r.integers(1, 101, 80):
            count[s] += 1
        bins = packing.fill(count, 100)
        used = np.zeros(101, np.int64)
        for own, times in bins:
            assert sum(own) <= 100 and times > 0
            for s in own:
                used[s] += times
        assert (used == count).all()
        assert sum(t for _, t in bins) == _one_by_one(count, 100)


def test_packing(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "PART", 3)
    docs = table(spark, DATA, "documents").select("doc_id", "text").unionByName(odd_docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path).toPandas()
    want = []
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if r.doc_id is None else r.doc_id, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    assert sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.02 + 1
    assert packing.pack(no_docs, path).count() == 0


def test_word_ids():
    """Word by word gives what the tokenizer gives for the whole text: capitals, marks, bars, special tokens, odd spaces; also while words are let go."""
    parts = [*"aAbHhTWIiſÅéßİıΣσς.,'|<>-!?012ªº中 \t\n\x0b\x1c\x85\xa0\u200b\u2003\u0331\u0308\u030a\u0307\u0323", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", ", ", ". ", "word", "Word", "WORD,", "don't."]
    ids, r = packing.WordIds(packing.tokenizer_path()), np.random.default_rng(5)
    for _ in range(300):
        texts = ["".join(r.choice(parts, r.integers(0, 12))) for _ in range(16)]
        want = [np.array(e.ids, "<u4").tobytes() for e in ids.of.encode_batch(texts, add_special_tokens=False)]
        assert ids([t.encode() for t in texts], 200) == want
    with pytest.raises(UnicodeDecodeError):
        ids([b"fine \xff"])
    assert ids([b"fine"]) == [np.array(ids.of.encode("fine", add_special_tokens=False).ids, "<u4").tobytes()]
