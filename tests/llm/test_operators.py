"""Every operator against brute force, and on nulls, empty texts, repeats, empty tables and clashing extra columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontam, langid, lengths, licenses, neardup, packing, pii, quality, queries, shared, topk, urlfilter

from ..conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(x):
    return WORD.findall((x or "").translate({c: c + 32 for c in range(65, 91)}))


def edge_docs(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " .,;\n", "en", "a", 5), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (5, "Größe ÄÖ 中文 word", "de", "b", 3), (6, "long " * 30000, "en", "b", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("row", "xh", "tid", "rid", "score", "lang_pred", "bucket", "t", "h1", "n"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(same, name):
    assert same(queries.queries()[name], queries.oracle_sql()[name]) > 0


def test_decontamination(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 5, 9, 10, 11, 25, 40])] + [(90, None), (91, "..")]
    docs = [(0, None), (1, "")]
    for i in range(2, 30):
        body = rng.choices(vocabulary, k=rng.randrange(1, 80))
        if i % 2:
            part = words(rng.choice(bench[:7])[1])
            at, cut = rng.randrange(len(body)), rng.randrange(max(1, len(part) - 9))
            body[at:at] = part[cut : cut + rng.randrange(8, 40)]
        docs.append((i, " ".join(body).upper()))
    items = {i: words(t) for i, t in bench if words(t)}
    windows = {(i, tuple(w[j : j + min(10, len(w))])) for i, w in items.items() for j in range(max(1, len(w) - 9))}
    want = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, win in windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
        want[d] = (len(w), len(hit), sorted(found))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.report(spark, frame, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    clean = decontam.decontaminate(spark, edge_docs(spark), spark.createDataFrame(bench, "item_id long, text string"))
    assert clean.columns == edge_docs(spark).columns and clean.count() == 7
    assert decontam.report(spark, frame, spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


def test_surrogates(spark):
    card = "4785380592391139"
    texts = [
        f"Mail Foo.Bar@x.example.com or FOO.BAR@X.EXAMPLE.COM, card {card}, ip 152.143.123.131, tel +1 (743) 555-3824",
        'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" Herr Karl Schmidt and Mrs. Anna Schmidt, foo.bar@x.example.com',
        "plain text with 12 and 3.5 only",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(8, None), (9, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark, rows, "k").collect()}
    again = {r.doc_id: r.text for r in pii.pseudonymise(spark, rows.repartition(3), "k").collect()}
    assert got == again and got[2] == texts[2] and got[8] is None and got[9] == ""
    for secret in ("Foo.Bar@", "FOO.BAR@", card, "152.143.123.131", "743", "2321bac4", "Karl", "Schmidt", "Anna"):
        assert secret not in got[0] + got[1]
    mails = re.findall(r"\S+@[\w.]+", got[0] + " " + got[1])
    assert len({m.lower().rstrip(",") for m in mails}) == 1
    new = re.search(r"card (\d{16})", got[0])[1]
    assert new[0] == "4" and (sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(new[::-1])) % 10 == 0) == (sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(card[::-1])) % 10 == 0)
    surname = re.findall(r"(?:Herr|Mrs\.) \w+ (\w+)", got[1])
    assert len(set(surname)) == 1
    out = pii.pseudonymise(spark, edge_docs(spark), "k")
    assert out.columns == edge_docs(spark).columns and out.count() == 7
    many = spark.createDataFrame([(i, f"ip 10.0.{i // 250}.{i % 250}") for i in range(600)], "doc_id long, text string")
    assert len({r.text for r in pii.pseudonymise(spark, many, "k").collect()}) == 600


def test_topk_ties_and_faults(spark):
    vectors = [(i, [0.5, 0.25]) for i in range(12)] + [(20, None), (21, [float("nan"), 0.0]), (22, [None, 1.0]), (23, []), (24, [-1.0, 0.5])]
    rows = spark.createDataFrame(vectors, "vec_id long, e array<float>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
    asked = rows.filter("vec_id in (0, 20, 24)").withColumnRenamed("vec_id", "query_id")
    got = sorted(tuple(r) for r in topk.search(spark, asked, rows, 5, slices=2, shard=4, block=1).collect())
    same = 128 * 128 + 64 * 64
    assert got[:5] == [(0, r, r, same) for r in range(1, 6)]
    assert [g[2] for g in got[5:]] == [0, 1, 2, 3, 4] and len(got) == 10
    assert topk.search(spark, asked, rows.filter("vec_id = 24"), 5, slices=2).count() == 1
    assert topk.search(spark, asked.filter("false"), rows, 5).count() == 0


def brute_topk(asked, offered, k):
    out = []
    for q, v in asked:
        held = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        scores = sorted((-held(sum(a * b for a, b in zip(v, c))), i) for i, c in offered if i != q and len(c) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_topk_against_brute_force(spark):
    """Unequal lengths, repeated queries and candidates, huge components (beyond 2**53 and beyond a long), clustered and equal vectors."""
    rng = random.Random(5)
    centre = [[rng.randrange(-99, 99) for _ in range(16)] for _ in range(4)]
    near = [(i, [x + rng.randrange(-9, 9) for x in rng.choice(centre)]) for i in range(160)]
    mixed = [(200 + i, [rng.randrange(-9, 9) for _ in range(1 + i % 3)]) for i in range(40)]
    huge = [(300 + i, [rng.randrange(1 << 40, 1 << 41) for _ in range(5)]) for i in range(12)] + [(320 + i, [rng.randrange(1 << 27, 1 << 28) for _ in range(6)]) for i in range(12)]
    equal = [(400 + i, [1] * 7) for i in range(30)]
    offered = near + mixed + huge + equal + near[:5]
    asked = near[::20] + mixed[:6] + huge[::4] + equal[:2] + near[:1]
    schema = lambda name: f"{name} long, v array<bigint>, block string, shard string, dim string"
    wide = lambda rows: [(i, v, "x", "y", "z") for i, v in rows]
    queries_, rows = spark.createDataFrame(wide(asked + [(None, [1])]), schema("query_id")), spark.createDataFrame(wide(offered + [(None, [1]), (999, None), (998, [])]), schema("vec_id"))
    for shard, block in ((4096, 1024), (16, 3)):
        got = sorted(tuple(r) for r in topk.search(spark, queries_, rows, 5, shard=shard, block=block).collect())
        assert got == brute_topk(asked, offered, 5)


def test_topk_prunes():
    """Against a cutoff of the best scores few pairs of clustered vectors are left after the first slice, and none of the best is out."""
    rng = np.random.default_rng(3)
    c = np.repeat(rng.integers(-200, 200, (64, 32)), 32, axis=0) + rng.integers(-5, 5, (2048, 32))
    cell, names, ids = topk.Cell(c[:32], c, 4), np.arange(2048), np.arange(32)
    full = (c[:32] @ c.T).astype(float)
    full[np.arange(32), np.arange(32)] = -np.inf
    best = np.sort(full, axis=1)[:, -5:]
    first = cell.q[0] @ cell.c[0].T + sum(cell.nq[s][:, None] * cell.nc[s] for s in range(1, 4))
    assert (first >= best[:, :1]).mean() < 0.05
    _, _, score = topk._collect(cell, names, ids, best[:, 0], 5)
    assert sorted(score.tolist()) == sorted(best.ravel().astype(int).tolist())


def test_language_held_out(spark):
    rows = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    model = langid.train(edge_docs(spark))
    got = langid.identify(spark, edge_docs(spark), model, keep=["doc_id"]).collect()
    assert len(got) == 7 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    none = langid.train(edge_docs(spark).filter("false"))
    assert {r.lang_pred for r in langid.identify(spark, edge_docs(spark), none).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(2)
    kinds = {(1, 0): ["river", "science", "garden"], (0, 0): ["junk", "spam", "click"], (1, 1): ["river", "vile", "garden"], (0, 1): ["junk", "vile", "awful"]}
    pairs = list(kinds)
    docs = [(i, " ".join(rng.choices(kinds[pairs[i % 4]] + ["the", "of"], k=30))) for i in range(200)]
    labels = spark.createDataFrame([(i, *pairs[i % 4]) for i in range(140)] + [(140, None, None), (None, 1, 0), (141, 1, None), (142, 7, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.train(frame, quality.grades(labels))
    assert model.thresholds[0] < model.thresholds[1]
    for r in quality.score(spark, frame.filter("doc_id >= 140"), model).collect():
        good, toxic = pairs[r.doc_id % 4]
        assert (r.toxic, r.keep) == (bool(toxic), (good, toxic) == (1, 0)), r
        assert math.isclose(r.expected_grade, r.p_some + r.p_good)
    empty = quality.train(frame, quality.grades(labels.filter("false")))
    assert quality.score(spark, edge_docs(spark).withColumn("keep", F.lit(1)).withColumn("grade", F.lit(1)), empty).count() == 7
    assert quality.score(spark, frame.filter("false"), model).count() == 0


def test_quality_held_out(spark):
    """On real labels that were not learned: grades in order, toxic rows found, good ones kept."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rated = quality.grades(labels)
    out = langid.held_out(F.col("doc_id"))
    model = quality.train(docs, rated.filter(~out))
    scored = quality.score(spark, docs.join(rated.filter(out), "doc_id"), model).withColumnRenamed("toxic", "flagged")
    rows = scored.join(rated, "doc_id").join(labels.select("doc_id", "quality"), "doc_id").collect()
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert len(rows) > 800 and mean[0] < mean[1] < mean[2]
    toxic = [r for r in rows if r.toxic == 1]
    assert np.mean([r.flagged for r in toxic]) > 0.6 and np.mean([r.flagged for r in rows if r.toxic == 0]) < 0.02
    assert np.mean([r.keep for r in rows if r.grade == 2]) > 0.93 and np.mean([r.keep for r in rows if r.quality == 0]) < 0.15 and np.mean([r.keep for r in toxic]) < 0.35


def test_url_rules(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?q#f"), (4, "http://example.org/en/12"), (5, "https://x.org?z"), (6, "http://a.com/fr/1"), (7, "http://a.com/de/1"), (8, "http://notexample.org/es/"), (9, "http://h.net"), (9, "http://h.net")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark, pages, labels).collect()}
    assert got[1] == ("", "", None, got[1][3]) and got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][:3] == ("x.org", "", None)
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("org/", "allow")
    known = spark.createDataFrame([(f"h{i % 5}.net", int(i % 5 == 0)) for i in range(200)], "host string, bad int")
    bound = {r.host: r.bound for r in urlfilter.reputation(known).collect()}
    assert bound["h0.net"] > urlfilter.MAX_BAD > max(v for k, v in bound.items() if k != "h0.net")
    assert urlfilter.judge(spark, pages.filter("false"), labels).count() == 0


def test_packing(spark):
    docs = edge_docs(spark)
    rows = packing.pack(docs, capacity=100).collect()
    real = Counter()
    for r in rows:
        real[r.doc_id] += r.n_tokens
    assert real[6] == 30000 and real[1] == 0 and real[4] == 4
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.offset, r.offset + r.n_tokens))
    for spans in bins.values():
        spans.sort()
        assert spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert packing.pack(docs.filter("false")).count() == 0
    rng = random.Random(3)
    length = [rng.randrange(1, 60) for _ in range(200)]
    source, cluster = [rng.choice([None, "a", "b", "c", "d"]) for _ in length], [str(rng.randrange(80)) for _ in length]
    placed = packing.pack_shard(length, source, cluster, [0] * 200, 100)
    left, held = [], []
    for i in sorted(range(200), key=lambda i: (-length[i], cluster[i], 0, source[i] or "", i)):
        fits = [(room, b) for b, room in enumerate(left) if room >= length[i] and (source[i] is None or source[i] not in held[b][0]) and cluster[i] not in held[b][1]]
        room, b = min(fits) if fits else (100, len(left))
        if not fits:
            left.append(100)
            held.append((set(), set()))
        left[b] -= length[i]
        held[b][0].add(source[i])
        held[b][1].add(cluster[i])
        assert placed[i] == (b, 100 - room)


def weighted_jaccard(a, b):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_unbiased():
    a, b = np.arange(1, 61, dtype=np.uint64), np.arange(21, 81, dtype=np.uint64)
    weight = {int(x): 1 + int(x) % 5 for x in range(1, 81)}
    item, doc = np.concatenate((a, b)) * np.uint64(0x9E3779B97F4A7C15), np.repeat([0, 1], 60)
    w = np.array([weight[int(x)] for x in a] + [2 * weight[int(x)] for x in b])
    sig = neardup.signatures(doc, item, w, 2, 4096)
    low = sum(min(weight[x] * (x <= 60), 2 * weight[x] * (x >= 21)) for x in weight)
    high = sum(max(weight[x] * (x <= 60), 2 * weight[x] * (x >= 21)) for x in weight)
    assert abs((sig[0] == sig[1]).mean() - low / high) < 0.03


def test_near_duplicates(spark):
    rng = random.Random(4)
    docs = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 200]))]
        for copy in range(rng.randrange(1, 6)):
            body = list(base)
            for _ in range(copy % 3):
                body[rng.randrange(len(body))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(body)))
    docs += [(100, None), (101, ""), (102, "..."), (103, docs[0][1].upper() + "!"), (104, docs[0][1]), (104, docs[0][1])]
    ids, parent = [d for d, _ in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = words(docs[i][1]), words(docs[j][1])
            if a and b and weighted_jaccard(a, b) >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = sorted((ids[i], ids[root(i)]) for i in range(len(docs)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("xh", F.lit("x")).withColumn("row", F.lit(1))
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(spark, frame).collect()) == want
    kept = neardup.deduplicate(spark, frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({b for _, b in want})
    assert neardup.classes(spark, frame.filter("false")).count() == 0


def test_token_counts(spark):
    docs = edge_docs(spark).limit(6)
    with open(lengths.VOCABULARY, "rb") as f:
        encode = lengths.encoder(f.read()).encode_ordinary
    n = [len(encode(r.text or "")) for r in docs.collect()]
    counts = lengths.histogram(lengths.encoded_lengths(spark, docs))
    rows = {r.n_tokens: r for r in lengths.answers(counts).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(n)
    for limit, r in rows.items():
        assert (r.total_docs, r.total_tokens, r.docs_longer, r.kept_tokens) == (len(n), sum(n), sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert [tuple(r) for r in lengths.truncated(counts, [3]).collect()] == [(3, sum(min(x, 3) for x in n), sum(x > 3 for x in n))]
    assert lengths.answers(counts.filter("false")).count() == 0


def test_licenses(spark):
    """Base phrases against a plain scan; every licence text with one insertion, loss and substitution; notices word for word."""
    rng = random.Random(11)
    filler = ["alpha", "mit", "license", "under", "the", "version", "2"]
    bodies = [(label, words(text)) for label, text in licenses.BODIES]
    notices = [(label, words(text)) for label, text in licenses.NOTICES]
    texts, want = ["x under the MIT license, under the mit license", "Apache License Version 2.0 and cc-by-nc", "under the mit", None, ""], {}
    for label, w in bodies:
        at = len(w) // 2
        for edited in (w, w[:at] + ["indeed"] + w[at:], w[:at] + w[at + 1 :], w[:at] + ["indeed"] + w[at + 1 :]):
            want[len(texts)] = label
            texts.append(" ".join(rng.choices(["alpha", "beta"], k=7) + edited + rng.choices(["alpha", "beta"], k=7)))
    for label, w in notices:
        want[len(texts)] = label
        texts.append("alpha " + ", ".join(w).upper() + " beta")
    for _ in range(40):
        parts = [rng.choice([list(map(str, p.split())) for p in licenses.PHRASES] + [[f] for f in filler]) for _ in range(rng.randrange(1, 20))]
        texts.append(" ".join(w for part in parts for w in part))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(spark, frame)).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        base = sorted((p, label) for phrase, label in licenses.PHRASES.items() for n in [len(phrase.split())] for p in range(len(w) - n + 1) if w[p : p + n] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(base), ",".join(sorted({x for _, x in base})))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert {x for _, x in base} <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert not [(i, label, got[i].labels) for i, label in want.items() if label not in got[i].labels.split(",")]
    for (label, w), at in zip(bodies, range(5, 5 + 4 * len(bodies), 4), strict=True):
        assert all({"bsd-2", "bsd-3"} - {label} - set(got[at + j].labels.split(",")) for j in range(4) if label.startswith("bsd"))
    assert licenses.scan(spark, edge_docs(spark)).count() == 7
    assert licenses.scan(spark, frame.filter("false")).count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage against brute force on a small fixture; edge cases keep their columns."""
    import corpus_pipeline

    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    table = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in bench if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    now = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    now = shared.materialise(spark, steps["language_id"](spark, now, SF))
    assert ids(now) == {i for i, r in table.items() if r.text and any(c.isalpha() for c in r.text)}
    told = sorted(ids(now))
    now = shared.materialise(spark, steps["near_duplicates"](spark, now, SF))
    kept = ids(now)
    text = {i: words(table[i].text) for i in told}
    root = {i: i for i in told}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(told):
        for j in told[n + 1 :]:
            if min(len(text[i]), len(text[j])) >= 0.7 * max(len(text[i]), len(text[j])) and find(i) != find(j) and (text[i] == text[j] != [] or weighted_jaccard(text[i], text[j]) >= 0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert kept == {i for i in told if find(i) == i}
    now = shared.materialise(spark, steps["decontamination"](spark, now, SF))
    dirty = {i for i in kept if any(tuple(text[i][p : p + n]) in windows for n in sizes for p in range(len(text[i]) - n + 1))}
    assert ids(now) == kept - dirty
    clean = shared.materialise(spark, steps["surrogates"](spark, now, SF))
    assert ids(clean) == kept - dirty
    mail = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    for r in clean.collect():
        old = mail.findall(table[r.doc_id].text)
        assert not set(old) & set(mail.findall(r.text)) and len(old) == len(mail.findall(r.text))
    packed = steps["best_fit_packing"](spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == kept - dirty
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, packed))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i + 1, i) for i in range(300, 330)] + [(500, i) for i in range(501, 700)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for part in (edges, edges[-199:], []):
        nodes = {n for a, b in part for n in (a, b) if a != b}
        found = shared.components(spark, spark.createDataFrame(part, "a long, b long")).collect()
        assert len(found) == len(nodes) and {r.node: r.root for r in found} == {n: find(n) for n in nodes}
