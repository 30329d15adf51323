"""The fitted models against their definitions, and edge cases of scans."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import langid, lengths, licenses, quality, urlfilter


def grams(text):
    """Blended spectrum of a text: n-grams of orders 1 to 4 over lower-cased letters, other runs as one blank."""
    body = np.frombuffer(text.encode(), dtype=np.uint8)
    letters = [b if langid._LETTER[b] else 32 for b in langid.LOWER[body].tolist()]
    x = [32]
    for b in letters:
        if b != 32 or x[-1] != 32:
            x.append(b)
    x.append(32)
    return {tuple(x[i : i + n]) for n in langid.ORDERS for i in range(len(x) - n + 1)}


def test_kernel_is_the_blended_spectrum():
    """Presence vectors give the kernel of the n-gram sets, but for hash collisions."""
    texts = ["the river and the garden", "der fluss und der garten", "el rio, y el jardin!", "Größe und Übermut", "a"]
    _, _, x, letters = next(langid.vectors(pa.array(texts, pa.string())))
    assert letters.all()
    f = x.astype(float)
    got = f @ f.T / np.sqrt(np.outer(f.sum(axis=1), f.sum(axis=1)))
    sets = [grams(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.abs(got - want).max() < 0.03


def test_ridge_with_all_landmarks_is_kernel_ridge():
    """With every text a landmark the Nystroem map is exact, so scores are those of kernel ridge regression with an intercept."""
    rng = np.random.default_rng(0)
    x = (rng.random((24, langid.BUCKETS)) < 0.01).astype(np.uint8)
    x[:12, :300] |= (rng.random((12, 300)) < 0.5).astype(np.uint8)
    y = ["a"] * 12 + ["b"] * 12
    model = langid.fit(x, y, landmarks=24, ridge=0.1)
    f = x.astype(float)
    k = f @ f.T / np.sqrt(np.outer(f.sum(axis=1), f.sum(axis=1)))
    centre = np.eye(24) - 1 / 24
    target = np.array([[v == c for c in "ab"] for v in y], dtype=float)
    alpha = np.linalg.solve(centre @ k @ centre + 0.1 * np.eye(24), centre @ target)
    want = centre @ k @ centre @ alpha + target.mean(axis=0)
    assert np.abs(model.scores(x) - want).max() < 1e-3


def test_cumulative_link_is_fitted():
    """On one feature the fitted tails follow the shares of the grades, and grow with it."""
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 600)
    rows = [np.array([5] if rng.random() < 0.2 + 0.3 * g else [9]) for g in grade]
    model = quality.fit(rows, grade, lasso=0.0)
    with_, without = model.tails([np.array([5]), np.array([9])])
    assert (with_ > without).all() and with_[0] > with_[1] and without[0] > without[1]
    balance = 1 / np.bincount(grade)[grade]
    has = np.array([r[0] == 5 for r in rows])
    for tail, mine in ((with_, has), (without, ~has)):
        for k in (1, 2):
            assert abs(tail[k - 1] - balance[mine & (grade >= k)].sum() / balance[mine].sum()) < 0.08


def test_languages_beyond_the_bound(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "en" if i % 2 else "es") for i in range(40)] + [(100 + i, "word", f"dirty{i}") for i in range(30)]
    docs = spark.createDataFrame(rows + [(1, None, "en"), (None, "x", "en"), (7, "alpha again", "en")], "doc_id long, text string, lang string")
    assert langid.train(docs, max_langs=2).langs == ["en", "es"]
    assert len(langid.train(docs).langs) == 32
    clash = docs.withColumn("score", F.lit("s")).withColumn("_text", F.lit("t")).withColumn("lang_pred", F.lit("p"))
    out = langid.identify(spark, clash, langid.train(docs, max_langs=2))
    assert out.columns == ["doc_id", "text", "lang", "_text", "lang_pred", "score"] and out.filter("_text = 't'").count() == 73
    assert {r.lang_pred for r in out.filter("text = 'uno dos tres'").collect()} == {"es"}


def test_posterior_bound_decides(spark):
    """Hosts with much bad evidence are blocked, few bad pages are not enough, and hosts without labels follow their domain."""
    pages = [(f"https://bad.example.net/en/{i}", i) for i in range(60)] + [(f"https://good{i % 6}.example.net/en/{100 + i}", 100 + i) for i in range(120)]
    pages += [(f"https://a.spam.info/x/{300 + i}", 300 + i) for i in range(40)] + [(f"https://b.spam.info/x/{400 + i}", 400 + i) for i in range(40)] + [("https://new.spam.info/x/zzz", 900), ("https://once.fine.info/x/950", 950)]
    labels = [(i, 0, 0) for i in range(60)] + [(100 + i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(80)] + [(400 + i, 0, 1) for i in range(40)] + [(950, 1, 0)]
    frame = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(pages)], "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "mean", "bound", "doc", "bad", "n", "pages"):
        frame = frame.withColumn(name, F.lit(name))
    got = {r.host: r.verdict for r in urlfilter.judge(spark, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {h for h, v in got.items() if v == "block"} >= {"bad.example.net", "a.spam.info", "b.spam.info"}
    assert all(got[f"good{i}.example.net"] == "allow" for i in range(6)) and got["once.fine.info"] == "allow"


def test_long_runs_and_clashing_columns(spark):
    """One unbroken run of letters, very long texts, and columns named like the operators' own."""
    texts = ["a" * 20000, "中" * 5000, "word " * 60000, "under the mit license " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("n_tokens", "n_docs", "block", "rid", "w", "spans", "template", "label", "p", "x"):
        docs = docs.withColumn(name, F.lit(name))
    with open(lengths.VOCABULARY, "rb") as f:
        encode = lengths.encoder(f.read()).encode_ordinary
    assert {r.doc_id: r.n_tokens for r in lengths.encoded_lengths(spark, docs).collect()} == {i: len(encode(t)) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_words, r.n_base, r.labels) for r in licenses.digest(licenses.scan(spark, docs)).collect()}
    assert got == {0: (1, 0, ""), 1: (1, 0, ""), 2: (60000, 0, ""), 3: (12000, 3000, "mit")}


def test_language_fit_keeps_sums_only(monkeypatch):
    """Packed rows in blocks of any size give the same model, and the fit holds little more than the rows themselves."""
    import tracemalloc

    rng = np.random.default_rng(1)
    y = [f"l{i % 40:02d}" for i in range(4000)]
    mean = rng.random((40, langid.BUCKETS)) < 0.02
    x = (mean[[int(v[1:]) for v in y]] & (rng.random((4000, langid.BUCKETS)) < 0.5)).astype(np.uint8)
    bits = np.packbits(x, axis=1)
    whole = langid.fit(x, y)
    monkeypatch.setattr(langid, "BLOCK", 300)
    tracemalloc.start()
    parts = langid.fit(bits, y, packed=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts.langs == whole.langs and np.allclose(parts.weights, whole.weights, atol=1e-3) and np.allclose(parts.bias, whole.bias, atol=1e-4)
    assert peak < 120 << 20 < x.nbytes * 2
    assert (parts.scores(x[:200]).argmax(axis=1) == [parts.langs.index(v) for v in y[:200]]).mean() > 0.95


def test_languages_beyond_the_bound_are_logged(spark, caplog):
    rows = spark.createDataFrame([(i, f"text {i}", f"l{i % 3}") for i in range(30)] + [(99, "more", "l0")], "doc_id long, text string, lang string")
    with caplog.at_level("WARNING"):
        assert langid.train(rows, max_langs=2).langs == ["l0", "l1"]
    assert "1 languages with 10 labelled rows" in caplog.text
