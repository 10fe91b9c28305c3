import numpy as np
import pytest

from scenespark.llm import cotrain, html_blocks

PAGE = """<html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<article><h1>A &amp; B</h1><p>First
 paragraph &eacute;&#233; with <b>bold</b> text.<p>Second, not closed.<br>After a break.<ul><li>Item one<li>Item two</ul>
<div class="ad">Buy this now.</div><p>Last 1 &lt; 2.</p></article>
<aside class=sidebar><h3>Related</h3><ul><li><a href=/x>Some other story</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice article, thanks.</p></div></section>
<form><label>Search</label><p>Type a word.</p></form><footer>&copy; 2024 Site.</footer><!-- <p>hidden</p> -->"""


def test_page_with_everything(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x", 3), (None, None, None, "x", 3), (2, "v", "", "x", 3), (3, "w", "<p", "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_blocks.main_text(df).collect()}
    assert got[1].text.split("\n") == ["A & B", "First paragraph éé with bold text.", "Second, not closed. After a break.", "Item one", "Item two", "Last 1 < 2."]
    assert got[1].n_chars == len(got[1].text) and [got[k].text for k in (None, 2)] == ["", ""] and len(got) == 4
    assert html_blocks.main_text(df.limit(0)).count() == 0


def test_held_out_pages():
    model = html_blocks.trained()
    data = html_blocks._labelled(np.random.default_rng(4321), 150)
    wrong = sum(int((o != (y > 0)).sum()) for o, (_, y) in zip(html_blocks.label(model, [x for x, _ in data]), data))
    assert wrong / sum(len(y) for _, y in data) < 0.02


def test_articles_of_the_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_blocks.main_text(rows).collect()}
    for r in rows.collect():
        assert got[r.page_id] == "\n".join(t for path, t, _ in html_blocks.leaf_blocks(r.html) if path and "article" in path)


def test_long_and_broken_pages():
    deep = "<div>" * 3000 + "x" + "<p>y" * 3000
    assert len(html_blocks.leaf_blocks(deep)) == 3001
    assert [t for _, t, _ in html_blocks.leaf_blocks('a < b <p title="x>y">c</p> <!-- d')] == ["a < b", "c"]
    assert html_blocks.leaf_blocks("<script>x") == [] and html_blocks.leaf_blocks("<" * 5000 + '"' * 5000)


@pytest.mark.parametrize("inner", ['<svg class="i"/>', "<title-bar>", "<select-menu>x</select-menu>", "<svg>", "<object>", "<template>", "<svg><path/></svg>", "<select-menu/>", "<TITLE>t</TITLE >"])
def test_nothing_is_swallowed(inner):
    got = [t for _, t, _ in html_blocks.leaf_blocks(f"<article><p>One.</p>{inner}<p>Two.</p></article>")]
    assert [t for t in got if t != "x"] == ["One.", "Two."]


def test_deep_and_many_blocks():
    import tracemalloc

    tracemalloc.start()
    deep = html_blocks.leaf_blocks("<div class='x y'>a" * 12_000)
    assert len(deep) == 12_000 and tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    model = html_blocks.trained()
    page = html_blocks.leaf_blocks("<article>" + "<p>Some words of prose, and more.</p>" * 700 + "</article><footer>&copy; 2024</footer>")
    whole = html_blocks.label(model, [html_blocks.features(page)])[0]
    assert (html_blocks.label_long(model, page, 64) == whole).all() and whole[:-1].all() and not whole[-1]
    assert [list(x) for x in html_blocks.main_blocks(model, [page, [], page[:3]], 64)] == [list(whole), [], [True] * 3]


# written by hand; the training pages were varied more after the first of these had failed, so the two
# are no measure, and JUDGED, which was written and run once after that, is one: 12 of its 14 blocks are right
OTHER = [
    (
        """<html lang=de><body class="home blog"><div id="top-bar"><a href="/">Zeitung</a> | <a href="/abo">Abo</a></div><div id="page"><div class="post single" id="post-12"><h1 class="title">Der Fluss</h1>
        <div class="meta"></div><p>Der Fluss ist nach dem Regen wieder gestiegen, und die Stadt hat die Brücke gesperrt.</p><p>Am Abend war das Wasser noch im Park.</p></div>
        <div id="sidebar"><h3>Weitere Artikel</h3><ul><li><a href=/1>Das Wetter</a><li><a href=/2>Der Markt</a></ul></div></div><div id="footer">Impressum &copy; 2024 Alle Rechte vorbehalten</div></body></html>""",
        ["Der Fluss", "Der Fluss ist nach dem Regen wieder gestiegen, und die Stadt hat die Brücke gesperrt.", "Am Abend war das Wasser noch im Park."],
    ),
    (
        """<body><header role=banner><nav role=navigation><a href=/>Home</a><a href=/n>News</a></nav></header><main><section class="article-body"><h2>On bees</h2><p>The hive was moved in the spring, when it was still cold.</p>
        <blockquote><p>It is the first time that we have done this.</p></blockquote><p>They have been there since.</p></section></main><section id="comments"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>Thanks, great article!</p></li></ol></section>
        <div class="newsletter-signup"><p>Subscribe to our newsletter.</p></div><footer role=contentinfo><p>Terms</p></footer></body>""",
        ["On bees", "The hive was moved in the spring, when it was still cold.", "It is the first time that we have done this.", "They have been there since."],
    ),
]


JUDGED = [
    (
        """<html lang=fr><body class="recipe-template"><div class="navbar"><ul class="nav"><li><a href=/>Accueil</a></li><li><a href=/r>Recettes</a></li></ul></div>
        <div class="container"><div class="col-8"><h1 itemprop=name>Tarte aux pommes</h1><p>Une tarte simple, que tout le monde aime bien.</p><h2>Préparation</h2><ol><li>Faire la pâte et la laisser une heure.</li><li>Mettre les pommes dessus.</li></ol></div>
        <div class="col-4 widget-area"><h4>Articles populaires</h4><ul><li><a href=/2>Le gâteau au chocolat</a></li></ul></div></div><div class="site-footer"><p>Tous droits réservés</p></div></body></html>""",
        ["Tarte aux pommes", "Une tarte simple, que tout le monde aime bien.", "Préparation", "Faire la pâte et la laisser une heure.", "Mettre les pommes dessus."],
    ),
    (
        """<body><table id=header><tr><td><a href=/>Daily</a></td></tr></table><div id=story><p>Rain fell for two days before the roads were opened.</p><p>No one was hurt.</p></div><div class="share-buttons"><a href=#>Share</a></div></body>""",
        ["Rain fell for two days before the roads were opened.", "No one was hurt."],
    ),
]


@pytest.mark.parametrize("page, main", OTHER)
def test_pages_of_other_make(page, main):
    blocks = html_blocks.leaf_blocks(page)
    keep = html_blocks.main_blocks(html_blocks.trained(), [blocks])[0]
    assert [t for (_, t, _), k in zip(blocks, keep) if k] == main


def test_judged_pages():
    """Wrong are the heading of a list of other articles and a header made as a table."""
    wrong = 0
    for page, main in JUDGED:
        blocks = html_blocks.leaf_blocks(page)
        keep = html_blocks.main_blocks(html_blocks.trained(), [blocks])[0]
        wrong += sum((t in main) != k for (_, t, _), k in zip(blocks, keep))
    assert wrong <= 2


def test_words_count():
    """Blocks in one and the same element, told apart by their words only."""
    model = html_blocks.trained()
    score = lambda text: html_blocks._scores(model, *html_blocks._batch([html_blocks.features(html_blocks.leaf_blocks(f"<body><div><p>{text}</p></div></body>"))]))[0][0, 0]
    assert score("The work of the city that was new had been there for some time.") > score("Subscribe newsletter cookies accept consent privacy policy settings agree partners browser.")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep string"


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 3 <> 0")
    got = {r.doc_id: r for r in cotrain.classify(docs, seen).collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    assert len(got) == docs.count()
    assert np.mean([got[r.doc_id].keep == (r.quality == 1) for r in held]) > 0.99
    assert all(got[r.doc_id].keep for r in held if r.quality == 1)


def test_quality_odd_rows(spark):
    rows = [(i, "words go here and there." if i % 2 else "%%% ### $$$ &&&", "en", "s", 20, "x", "y") for i in range(60)]
    rows += [(100, None, None, None, None, "x", "y"), (None, "", "en", "s", 0, "x", "y"), (1, rows[1][1], "en", "s", 20, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 7)], "doc_id long, quality int")
    got = cotrain.classify(df, labels).collect()
    assert len(got) == 63 and all(r.keep == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 60)
    assert all(r.keep and r.score == 1 for r in cotrain.classify(df, labels.limit(0)).collect())
    assert cotrain.classify(df.limit(0), labels).count() == 0


def test_all_unlabelled_rows_can_teach(spark):
    """The surest of each task and of all are the surest by brute force."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, cotrain.HASHED + cotrain.SHAPE + cotrain.META))
    y = (x[:, 0] > 0).astype(float)
    t = cotrain.HASHED + cotrain.SHAPE
    models = [cotrain.Logistic(v, y, np.ones(len(y))) for v in (x[:, :t], x[:, t:] + y[:, None])]
    half = x.astype("<f2")
    df = spark.createDataFrame([(i, bytes(r.tobytes())) for i, r in enumerate(half)], "key long, view binary").repartition(7)
    state = spark.sparkContext.broadcast((models, [5, 9], np.array([3, 4])))
    from functools import partial

    got = df.mapInArrow(partial(cotrain._surest, state=state), "teacher int, label int, sure double, key long, view binary").collect()
    z = [m.logit(v) for m, v in zip(models, (half[:, :t].astype(float), half[:, t:].astype(float)))]
    for k in (0, 1):
        for label, n in ((0, 5), (1, 9)):
            sure = z[k] if label else -z[k]
            want = [i for i in np.argsort(-sure, kind="stable") if i not in (3, 4) and sure[i] > cotrain.SURE][:n]
            mine = sorted((r for r in got if (r.teacher, r.label) == (k, label)), key=lambda r: (-r.sure, r.key))[:n]
            assert [r.key for r in mine] == want


def test_co_training_teaches_the_other_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000).astype(float)
    view = lambda: np.hstack([y[:, None] * 1.6 + rng.normal(size=(4000, 1)), rng.normal(size=(4000, 6))])
    a, b = view(), view()
    pool = np.hstack([a[200:3000], b[200:3000]])

    def surest(models, share):
        out = []
        for k in (0, 1):
            z = models[k].logit(pool[:, :7] if k == 0 else pool[:, 7:])
            order = np.argsort(z)
            out.append([pool[order[:40][z[order[:40]] < -cotrain.SURE]], pool[order[-40:][z[order[-40:]] > cotrain.SURE]]])
        return out

    model = cotrain.co_train(a[:200], b[:200], y[:200], surest)
    p, q, both = cotrain.probabilities(model, a[3000:], b[3000:])
    right = [((x > 0.5) == (y[3000:] > 0.5)).mean() for x in (p, q, both)]
    assert right[2] > max(right[:2]) and right[2] > 0.84


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = p.quality(spark, docs, d)
    ids = {r.doc_id for r in cotrain.classify(docs, spark.read.parquet(f"{d}/labels.parquet")).where("keep").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids and kept.columns == p.COLUMNS
    lined = p.line_dedup(spark, kept, d)
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    single = p.near_duplicates(spark, lined, d)
    from test_documents import brute_components, words

    comp = brute_components([(r.doc_id, r.text) for r in lined.collect()])
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(i for i, (_, c) in comp.items() if c == i)
    mixed = p.mixed(spark, single, d)
    assert mixed.columns == p.COLUMNS
    total = sum(len(words(r.text)) for r in single.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) < 0.02 * total
    out = p.packed(spark, mixed, d)
    assert out.groupBy("sequence_id").sum("length").where("sum(length) > 4096").count() == 0
    n = {r.doc_id: r.doc_tokens for r in out.collect()}
    assert sum(r.length for r in out.collect()) == sum(n[r.doc_id] for r in mixed.select("doc_id").collect())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, empty texts and columns with names that the stages use."""
    import corpus_pipeline as p

    long = " ".join(f"w{i}" for i in range(80))
    line = "this very line is in more than five of the documents here"
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (None, long, None, None, None), (2, long + " x", "en", "t", 5), (2, None, None, "s", None), (None, None, None, None, None), (3, "", "en", None, 0)]
    rows += [(10 + i, f"{line}\nown {i} and some words {i * 7} of its own {i}", "en", "s", 9) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, component_id long, n_lines int, __drop int, __doc int, __id int"
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, 1) for r in rows], schema)
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    d = f"file://{tmp_path}"
    kept = p.quality(spark, docs, d)
    assert kept.count() == len(rows)  # too few labels to learn from
    lined = p.line_dedup(spark, docs, d).collect()
    assert sum(line in (r.text or "") for r in lined) == 1 and all(r.n_chars == len(r.text) for r in lined)
    single = p.near_duplicates(spark, docs, d)
    got = sorted(((r.doc_id or 0, r.text or "") for r in single.collect()))
    assert got == sorted([(1, long), (2, ""), (0, ""), (3, "")] + [(r[0], r[1]) for r in rows[7:]])
    mixed = p.mixed(spark, docs, d)
    total = sum(len((r[1] or "").split()) for r in rows)
    assert mixed.columns == p.COLUMNS and abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * total) <= 81
    pieces = p.packed(spark, docs, d).collect()
    assert len(pieces) == len(rows) and sum(r.doc_id is None for r in pieces) == 2
    for stage in (p.quality, p.line_dedup, p.near_duplicates, p.mixed, p.packed):
        assert stage(spark, docs.limit(0), d).count() == 0

