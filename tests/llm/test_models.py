import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import cotrain, langid, urls

ALPHABETS = {"en": "the and of to in", "de": "der die und das nicht", "fr": "le la les des pour"}


def speech(lang, seed, n):
    rnd = np.random.default_rng(seed)
    return " ".join(rnd.choice(ALPHABETS[lang].split(), n))


def test_languages_of_pages(spark):
    train = spark.createDataFrame([(i, speech(x, i, 200), x) for i, x in enumerate(["en", "de", "fr"] * 10)], "doc_id long, text string, lang string")
    page = lambda i, url, lang, text: (i, url, f'<html lang="{lang}"><script>var the;</script><body>{text}</body></html>')
    rows = [page(i, f"http://www.{x}.example/{i}", x, speech(x, 100 + i, 80)) for i, x in enumerate(["en", "de", "fr"] * 20)]
    # Nothing but the host, nothing but the declared language, a wrong declaration, nothing at all.
    rows += [(100, "http://www.de.example/x", "<html><body></body></html>"), (101, "http://new.host/", '<html lang="FR-fr"></html>')]
    rows += [page(102, "http://www.de.example/y", "en", speech("de", 7, 300)), (103, None, None), (103, "no scheme", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "host", "score", "ll")})
    got = {r["page_id"]: r for r in langid.identify(pages, train).collect()}
    assert all(got[i]["lang"] == x for i, x in enumerate(["en", "de", "fr"] * 20))
    assert (got[100]["lang"], got[101]["lang"], got[102]["lang"]) == ("de", "fr", "de")
    assert got[103]["host"] == "" and got[103]["lang"] in ALPHABETS
    assert langid.identify(pages, train).count() == len(rows)
    assert langid.identify(pages.limit(0), train).count() == 0
    assert {r["lang"] for r in langid.identify(pages, train.limit(0)).collect()} == {None}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 200")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    pages = held.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.concat(F.lit("<html><p>"), "text").alias("html"), F.col("lang").alias("truth"))
    found = langid.identify(pages, train).join(held.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("truth")), "page_id").collect()
    assert np.mean([r["lang"] == r["truth"] for r in found]) > 0.97


def test_url_terms():
    assert urls.count_terms("http://a.net/Free-SEX?free=1") == (0, 2)
    assert urls.count_terms("http://xxx.net/") == (1, 0)
    assert urls.count_terms("http://essex.net/freedom/winner/xxxl") == (0, 0)
    assert urls.count_terms(None) == (0, 0)
    assert urls.count_terms("éxxxé") == (1, 0)


def test_urls(spark):
    cases = [
        ("http://A.example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net", "example.net", "", None, "allow"),
        ("https://b.net/", "b.net", "/", "net/", "block"),
        ("https://net/x", "net", "/x", "net/", "block"),
        ("x://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("x://myexample.com/de/1", "myexample.com", "/de/1", None, "allow"),
        ("x://c.org/fr/xxx", "c.org", "/fr/xxx", "org/fr/", "allow"),
        ("x://c.org/it/xxx", "c.org", "/it/xxx", None, "block"),
        ("x://c.com?free=sex", "c.com", "", None, "block"),
        ("x://c.com/free/free", "c.com", "/free/free", None, "allow"),
        ("c.com/porn", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://y.com/a://z.net/", "y.com", "/a://z.net/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge_urls(pages).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_cotraining_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = cotrain.quality_scores(docs, labels.where("doc_id % 2 = 0"))
    held = scores.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    rank, good = held["score"].rank(), held["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97
    assert scores.count() == docs.count()


def test_cotraining_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    found = cotrain.quality_scores(odd_docs, labels).collect()
    assert len(found) == odd_docs.count()
    assert {r["score"] for r in found} == {0.5}
    assert cotrain.quality_scores(no_docs, labels).count() == 0


def test_views_teach_each_other():
    rnd = np.random.default_rng(1)
    y = np.arange(60) % 2
    view = lambda labels: labels[:, None] * 2.0 + rnd.normal(0, 1, (len(labels), 5))
    truth = np.arange(3000) % 2
    fitted = cotrain.co_train((view(y), view(y)), y, (view(truth), view(truth)))
    p = fitted.scores(view(truth), view(truth))[2]
    assert ((p > 0.5) == truth).mean() > 0.97


def test_cotraining_equals_a_computation_in_memory(spark):
    """The same rounds in numpy: every unlabelled row is scored, and those of the least keys are handed over."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in cotrain.quality_scores(docs, labels).collect()}
    rows = docs.collect()
    t = {r["doc_id"]: cotrain.text_features(r["text"]).astype("<f4") for r in rows}
    p = {r["doc_id"]: cotrain.page_features(r["lang"], r["source"], r["n_chars"]).astype("<f4") for r in rows}
    table = spark.createDataFrame([(i, bytearray(t[i].tobytes()), bytearray(p[i].tobytes())) for i in t], "id long, t binary, p binary")
    keys = {r["id"]: (r["k"], r["o"]) for r in table.select("id", F.xxhash64("id", "t", "p").alias("k"), F.xxhash64("id").alias("o")).collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in t}
    known = sorted(quality, key=lambda i: (keys[i][1], i))
    pool = [i for i in t if i not in quality]
    stack = lambda f, ids: np.stack([f[i].astype(np.float64) for i in ids])
    sure = cotrain.sure_of_arrays(stack(t, pool), stack(p, pool), np.array([keys[i][0] for i in pool]))
    fitted = cotrain.co_train((stack(t, known), stack(p, known)), np.array([quality[i] for i in known]), sure)
    want = dict(zip(t, fitted.scores(stack(t, list(t)), stack(p, list(t)))[2], strict=True))
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_rows_that_repeat_a_labelled_id(spark):
    docs = spark.createDataFrame([(i % 7, f"word{i} " * (i % 30), "en", "s", i) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    assert cotrain.quality_scores(docs, labels).count() == 600


def test_fusion_equals_plain_arithmetic(spark):
    train = spark.createDataFrame([(i, speech(x, i, 100), x) for i, x in enumerate(["en", "de", "fr"] * 5)], "doc_id long, text string, lang string")
    hosts = ["a.x.de", "b.x.de", "c.org", "c.org", "y.fr", ""]
    rows = [(i, f"http://{hosts[i % 6]}/p" if hosts[i % 6] else None, f'<html lang="{("en", "de", "fr", "xx")[i % 4]}">{speech(("en", "de", "fr")[i % 3], 50 + i, 6)}</html>') for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["lang"], r["probability"]) for r in langid.identify(pages, train).collect()}
    languages, logs = langid.train(train)
    ll, declared, host = {}, {}, {}
    for r in pages.select("page_id", langid.visible_text(F.col("html")).alias("t"), langid.declared_language(F.col("html")).alias("d"), urls.host_of(F.col("url")).alias("h")).collect():
        score = logs @ langid.trigram_counts(r["t"], langid.BITS) * langid.TEMPER
        ll[r["page_id"]], declared[r["page_id"]], host[r["page_id"]] = score - score.max(), r["d"], r["h"]
    soft = {i: np.exp(v) / np.exp(v).sum() for i, v in ll.items()}
    suffix, domain = {i: h.split(".")[-1] for i, h in host.items()}, {i: ".".join(h.split(".")[-2:]) for i, h in host.items()}
    total = lambda key, value: sum(soft[i] for i in soft if key[i] == value)
    everything, k = sum(soft.values()), len(languages)
    for i in ll:
        prior = (everything + 1 / k) / (everything.sum() + 1)
        d = total(domain, domain[i]) - soft[i]
        prior = (np.maximum(d, 0) + langid.STRENGTH * prior) / (d.sum() + langid.STRENGTH)
        h = total(host, host[i]) - soft[i]
        prior = (np.maximum(h, 0) + langid.STRENGTH * prior) / (h.sum() + langid.STRENGTH)
        likely = lambda key: np.log((np.maximum(total(key, key[i]) - soft[i], 0) + 0.5) / (everything + 0.5 * len(set(key.values()))))  # noqa: E731, B023
        score = ll[i] + likely(declared) + likely(suffix) + np.log(prior)
        p = 1 / np.exp(score - score.max()).sum()
        assert got[i][0] == languages[int(np.argmax(score))]
        assert abs(got[i][1] - p) < 1e-9


def test_ordinary_parameters_do_not_block():
    for url in ("http://a.com/?ref=feed", "http://a.com/?utm_source=feed&ref=x", "http://a.com/free/", "http://a.com/free?win=1"):
        strict, soft = urls.count_terms(url)
        assert strict == 0 and sum(urls.SOFT[t] for s, t in urls.found_terms(url) if not s) < urls.SOFT_LIMIT


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "terms.tsv").write_text("badword\tstrict\nsoftly\t2\nmaybe\t1\n# a note\n")
    strict, soft = urls.load_vocabulary(str(tmp_path / "terms.tsv"))
    assert (strict, soft) == (("badword",), {"softly": 2, "maybe": 1})
    pages = spark.createDataFrame([(0, "x://a.com/badword"), (1, "x://a.com/softly-maybe"), (2, "x://a.com/softly"), (2, "x://a.com/" + "maybe/" * 5000), (None, None)], "page_id long, url string")
    found = sorted((r["page_id"] is None, r["page_id"], r["verdict"]) for r in urls.judge_urls(pages, strict=strict, soft=soft).collect())
    assert [f[2] for f in found] == ["block", "block", "allow", "allow", "allow"]
