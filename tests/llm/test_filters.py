import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from fleetbump.llm import decontaminate, html_text, license_scan, perplexity, toxicity, url_filter
from fleetbump.llm.words import words_of
from fleetbump.session import shared_folder

INSULTS = ["idiot", "scum", "moron", "stupid", "trash"]


def test_toxicity_catches_hidden_insults_and_leaves_clean_texts(spark, texts):
    rows, labels = [], []
    for i in range(400):
        text = texts[i % 60]
        if i % 4 == 0:
            words = text.split(" ")
            words[5] = INSULTS[i // 4 % 5]
            words[9] = INSULTS[(i // 4 + 1) % 5] + "!!"
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marked)
    cases = [
        (0, texts[1] + " You i.d.i.o.t you.", 1),
        (1, texts[2] + " What st-upid text.", 1),
        (2, texts[3] + " s c u m of all.", 1),
        (3, texts[4] + " Such a morxon here.", 1),
        (4, texts[5], 0),
        (5, None, 0),
        (6, "", 0),
        (7, "to be or at it is on", 0),
        (None, " ".join(texts * 2), 0),
        (8, " ".join(texts * 2) + " trash", 1),
    ]
    asked = spark.createDataFrame(cases, "doc_id long, text string, want int")
    found = {r.doc_id: r for r in toxicity.score(asked, model).collect()}
    assert [found[i].predicted for i, _, _ in cases] == [want for _, _, want in cases]
    assert toxicity.keep_clean(asked, model).count() == sum(not want for _, _, want in cases)
    held = toxicity.score(docs, model).where("held_out").collect()
    assert len(held) > 50 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    none = toxicity.train(docs, marked.where("toxic = 0"))
    assert toxicity.score(docs, none).agg({"predicted": "max"}).first()[0] == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_in_every_language(spark):
    from fleetbump.llm import queries

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op5_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").join(docs, "doc_id")
    caught, toxic = {}, {}
    for r in found.where("toxic = 1").groupBy("lang").agg({"predicted": "sum", "*": "count"}).collect():
        caught[r.lang], toxic[r.lang] = r["sum(predicted)"], r["count(1)"]
    assert set(toxic) == {"de", "en", "es", "fr"}
    assert all(caught[lang] >= 0.75 * toxic[lang] for lang in toxic)
    assert sum(caught.values()) >= 0.88 * sum(toxic.values())
    clean = found.where("toxic = 0").agg({"predicted": "avg"}).first()[0]
    assert clean < 0.005


def test_toxicity_on_odd_tables(spark, texts):
    rows = [(i, f"{texts[i % 60]} {'scum ' * (i % 2)}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1]), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert model.landmarks == again.landmarks
    plain = sorted(map(tuple, toxicity.score(docs, model).collect()), key=str)
    named = docs.selectExpr("*", "'x' AS score", "'x' AS toxic", "'x' AS predicted", "'x' AS unit", "'x' AS near")
    assert sorted(map(tuple, toxicity.score(named, toxicity.train(named, labels)).collect()), key=str) == plain
    assert len(plain) == 202
    for nothing in (docs.limit(0), docs.where("doc_id IS NULL")):
        scores = toxicity.score(nothing, toxicity.train(nothing, labels)).collect()
        assert len(scores) == nothing.count() and all(0 <= r.score <= 1 for r in scores)
    # Of equal texts the label of the smallest id counts.
    same = spark.createDataFrame([(i, f"{texts[i % 60]} scum") for i in range(60)] + [(100 + i, f"{texts[i % 60]} scum") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)], "doc_id long, toxic int")
    kept = toxicity._sample(same, marks, toxicity.Settings()).collect()
    assert all(r.toxic == 1 for r in kept if r.doc_id < 100) and len({r.text for r in kept}) == len(kept)


def test_string_kernel_equals_its_definition():
    def brute(s, t, order, decay):
        def spans(x):
            from itertools import combinations

            out = Counter()
            for at in combinations(range(len(x)), order):
                out["".join(x[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
            return out

        a, b = spans(s), spans(t)
        return sum(v * b[k] for k, v in a.items())

    units = ["idiot", "idxiot", "ab", "tidiots", "toidi"]
    found = toxicity.kernel(units, ["idiot"], 3, 0.6)
    assert np.allclose(found, [brute(u, "idiot", 3, 0.6) for u in units])
    assert np.allclose(toxicity.kernel(units, units, 3, 0.6), [brute(u, u, 3, 0.6) for u in units])


def brute_kn(trusted, text):
    """log10 probability of a text by modified Kneser-Ney, straight from its definition."""
    tri = Counter()
    for t in trusted:
        w = ["<s>", "<s>", *t.lower().split(), "</s>"]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - (2 * y * n[2] / n[1] if n[1] else 0.5), 2 - (3 * y * n[3] / n[2] if n[2] else 0.5), 3 - (4 * y * n[4] / n[3] if n[3] else 0.5)]
        return [min(max(r, 0.1), i - 0.1) for i, r in enumerate(raw, 1)]

    d1, d2, d3 = discounts(uni), discounts(bi), discounts(tri)

    def off(n, d):
        return d[min(n, 3) - 1]

    total = sum(uni.values())
    unknown = sum(off(n, d1) for n in uni.values()) / total / (len(uni) + 1)

    def p1(w):
        return unknown + ((uni[w] - off(uni[w], d1)) / total if uni[w] else 0)

    def p(h, w, counts, d, lower):
        own = {k: n for k, n in counts.items() if k[:-1] == h}
        if not own:
            return lower
        t = sum(own.values())
        n = counts.get((*h, w), 0)
        return (n - off(n, d) if n else 0) / t + sum(off(x, d) for x in own.values()) / t * lower

    w = ["<s>", "<s>", *text.lower().split(), "</s>"]
    return sum(math.log10(p((u, v), x, tri, d3, p((v,), x, bi, d2, p1(x)))) for u, v, x in zip(w, w[1:], w[2:], strict=False))


def test_words_met_are_kept_in_eight_bytes_each(documents, monkeypatch):
    text = documents.select("text").toArrow().column("text").combine_chunks()
    marks, powers = ["idiot", "stupid", "bakede"], np.array([1.0, 3.0, 3.0])
    whole = toxicity.Scorer(marks, powers, toxicity.Settings())
    want = whole.features(text)
    monkeypatch.setattr(toxicity, "LEARNT", 7)
    some = toxicity.Scorer(marks, powers, toxicity.Settings())
    found = [some.features(text.slice(at, 13)) for at in range(0, len(text), 13)]
    assert np.array_equal(np.concatenate(found), want)
    words = {w.lower() for t in text.to_pylist() for w in (t or "").encode().split()}
    for scorer in (whole, some):
        assert scorer.known.nbytes == 8 * len(words)
        assert (np.diff(scorer.known.astype(object)) > 0).all()


def test_perplexity_equals_brute_force(spark):
    good = ["a b c d", "a b c e", "b c d a b", "c c c", "a b a b c d", "d e f"]
    other = ["a b c d", "x y z", "", "a b x c d", "f e d c b a"]
    docs = spark.createDataFrame(
        [*enumerate(good), *((100 + i, t) for i, t in enumerate(other)), (200, None)], "doc_id long, text string"
    ).selectExpr("*", "'en' lang")
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id long, quality int")
    left = {r.id for r in perplexity._trusted(labels).where(perplexity.measured("id")).collect()}
    trained = [t for i, t in enumerate(good) if i not in left]
    for table in (1, 400_000):
        found = perplexity.perplexities(docs, labels, perplexity.Settings(table=table)).collect()
        for r in found:
            text = dict(enumerate(good)).get(r.doc_id, other[r.doc_id - 100] if 100 <= r.doc_id < 200 else "")
            assert math.isclose(r.log10_prob, brute_kn(trained, text), rel_tol=1e-9)
            assert r.n_tokens == len(text.split()) + 1


def test_model_counts_every_trusted_document(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "concat('w', id) text", "'en' lang")
    labels = docs.selectExpr("doc_id", "1 quality")
    trained = docs.where(~perplexity.measured("doc_id")).count()
    model, _, _ = perplexity.train(docs, labels)
    # A word, a bigram with each end and two trigrams for each text; the end and its like are shared.
    assert model.count() == 5 * trained + 1 and trained > 4000
    keys, values = perplexity._frequent(model, 10)
    assert len(keys) == len(values) == 1
    assert not len(perplexity._frequent(model, 0)[0])


def test_split_shards_and_rounds_change_no_score(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "_LEAST", 8)
    monkeypatch.setattr(perplexity, "_ROUND", 0)
    rng = random.Random(3)
    good = [" ".join(rng.choices("abcdefghij", [30, 9, 6, 4, 3, 2, 2, 1, 1, 1], k=rng.randint(1, 25))) for _ in range(40)]
    rows = [*enumerate(good), *((100 + i, t) for i, t in enumerate([*good[:5], "a z b", "J a a", "", None, "q"]))]
    rows += [(None, good[0]), (3, good[3]), (200, "A  A"), (201, "a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id long, quality int")
    left = {r.id for r in perplexity._trusted(labels).where(perplexity.measured("id")).collect()}
    trained = [t for i, t in rows if i is not None and i < 100 and i not in left]
    known = {w for t in trained for w in t.split()} | {"</s>"}
    for table in (1, 400_000):
        settings = perplexity.Settings(table=table, shard=16, rounds=3)
        model = perplexity.fit(docs, labels, settings)
        assert model.plan.rounds == 3 and model.plan.parts.max() > 3 and (model.rare is None) == (table > 1)
        found = perplexity.perplexities(docs, labels, settings).collect()
        assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
        texts = {i: t or "" for i, t in rows}
        for r in found:
            assert math.isclose(r.log10_prob, brute_kn(trained, texts[r.doc_id]), rel_tol=1e-9)
            assert r.n_tokens == len(texts[r.doc_id].split()) + 1
    grams = [Counter(), Counter(), Counter()]
    for t in trained:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        for i in range(2, len(w)):
            grams[0][w[i]] += 1
            grams[1][w[i - 1], w[i]] += 1
            grams[2][w[i - 2], w[i - 1], w[i]] += 1
    assert set(grams[0]) == known
    model, unknown, begin = perplexity.train(docs, labels, settings)
    model = {r.ngram: r for r in model.collect()}
    assert sorted(r.seen for r in model.values()) == sorted(n for g in grams for n in g.values())
    words = words_of(pa.array(["a b a"])).hashes
    w = np.concatenate([[perplexity._START] * 2, words, [perplexity._END]])
    uv, vw = perplexity._pair(w[:-2], w[1:-1]), perplexity._pair(w[1:-1], w[2:])
    hashes = np.concatenate([perplexity._word(w[2:]), vw, perplexity._triple(uv, w[2:])]).view(np.int64)
    total = begin + 4 * unknown + sum(model[h].value for h in hashes.tolist() if h in model)
    assert math.isclose(total, brute_kn(trained, "a b a"), rel_tol=1e-9)


def test_quality_filter_keeps_no_table_of_ngrams(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(1000)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(2000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    folder = Path(shared_folder(spark))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(key), set(folder.iterdir())
    assert perplexity.classify(docs, docs.selectExpr("doc_id", "1 quality")).count() == 2000
    assert spark.conf.get(key) == before
    staged = sum(p.stat().st_size for new in set(folder.iterdir()) - there for p in new.rglob("*.parquet"))
    # Some 156,000 different trigrams of trusted texts: 24 bytes each, and more, where they were written.
    assert staged < 0.3 * sum(map(len, texts))


def test_sent_words_return(documents):
    words = np.unique(words_of(documents.select("text").toArrow().column("text").combine_chunks()).hashes)
    assert (perplexity._unmixed(perplexity.mix(words)) == words).all()
    rng = np.random.default_rng(1)
    places = [words[rng.integers(0, len(words), 500)] for _ in range(3)]
    for common in (words[:0], words[::3], words):
        names = perplexity._SHARED
        rows = pa.RecordBatch.from_pylist([dict(zip(names, perplexity._sent(common, *places), strict=True))])
        assert all((a == b).all() for a, b in zip(places, perplexity._read(rows, common), strict=True))


def test_quality_filter_keeps_clean_documents(spark, documents, texts, nothing):
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    found = perplexity.classify(documents, labels)
    assert found.count() == documents.count()
    none = perplexity.classify(documents, labels.where("quality = 0"))
    assert none.where("kept").count() == documents.count()
    assert perplexity.classify(nothing, labels).count() == 0


def test_search_equals_brute_force_bm25(spark, texts):
    s = decontaminate.Settings()
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])], "item_id long, text string")
    (index,) = decontaminate.indexes(items, s)
    mixed = [" ".join(texts[i].split(" ")[:60] + texts[i + 5].split(" ")[10:50]) for i in range(30)]
    words = words_of(pa.array([*mixed, None, "", texts[50]]))
    found = decontaminate.retrieved(words, index, s)
    best = {}
    for row in range(len(words.first) - 1):
        own = words.hashes[words.first[row] : words.first[row + 1]]
        for start in range(-2 * s.stride, len(own), s.stride):
            window = own[max(start, 0) : start + 3 * s.stride]
            for segment, (terms, impacts) in enumerate(zip(index.segment_words, index.segment_impacts, strict=True)):
                score = impacts[np.isin(terms, window)].sum()
                if score >= s.threshold:
                    key = row, int(index.segment_item[segment])
                    best[key] = max(score, best.get(key, 0))
    assert found.keys() == best.keys() and len(best) >= 30
    assert all(math.isclose(found[k], best[k]) for k in best)


def test_contaminated_documents(spark, texts, clashing):
    item = "What is the name of the tall grey tower by the old north harbour? Answer: lighthouse seven."
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (None, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (10, texts[1] + " " + item.upper() + "\n" + texts[2]),
            (11, texts[3]),
            (12, " ".join(texts * 4) + " " + item),
            (None, item),
            (13, None),
            (14, texts[0]),
            (15, "the old north harbour is what it is"),
        ],
        "doc_id long, text string",
    )
    found = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (10, 12, None) for i in (1, 2)} | {(14, None), (12, None)}
    kept = decontaminate.keep_clean(docs, items)
    assert {r.doc_id for r in kept.collect()} == {11, 13, 15}
    assert decontaminate.keep_clean(clashing, items.limit(0)).count() == clashing.count()
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    small = decontaminate.Settings(shard_postings=20)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, small).collect()} == {
        (r.doc_id, r.item_id) for r in found
    }


def test_license_scan_equals_brute_force(spark, texts):
    lines = [
        "Licensed under CC BY-NC 4.0.",
        "All rights reserved.",
        "Released under the MIT license, all rights\nreserved",
        "This work is licensed under the GNU General Public License, version 3.",
        "accc by bycc by",
        "cc BY cc-by CC\nby",
        "Licensed under the Apache License, Version 2.0. No more.",
        None,
        "",
        "mit license",
    ]
    rows = [(i, None if x is None else texts[i] + "\n" + x + "\n" + texts[i + 1]) for i, x in enumerate(lines)]
    rows += [(3, rows[3][1]), (None, rows[0][1]), (2, texts[9])]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter()
    for doc_id, text in rows:
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(license_scan.WORD, norm)
        starts, base, best = [], set(), 0.0
        for phrase, label in license_scan.PHRASES:
            own = [i for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
            starts += own
            base |= {label} if own else set()
        all_ = set(base)
        for line in norm.split("\n"):
            held = set(re.findall(license_scan.WORD, line))
            for label, template in license_scan.template_words():
                share = len(held & set(template)) / len(template)
                if share >= license_scan.CONTAINMENT:
                    all_.add(label)
                    best = max(best, share)
        want[
            doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(all_)), 1.0 if base else best,
        ] += 1
    assert Counter(tuple(r) for r in found) == want
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_url_rules_and_templates(spark):
    urls = [
        ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://WWW.Example.com/en/1?x=/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("x://b.com/de/2#f", "b.com", "/de/2", "com/", "allow"),
        ("http://b.net/es/3", "b.net", "/es/3", "net/es/", "block"),
        ("http://mycom/es/3", "mycom", "/es/3", None, "allow"),
        ("http://b.com", "b.com", "", None, "allow"),
        ("http://b.com?u=http://c.net/es/", "b.com", "", None, "allow"),
        ("no scheme/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_templates_generalise_and_learn(spark):
    rows = [f"http://h{i % 3}.net/es/{i}" for i in range(90)] + [f"http://h{i % 3}.net/item/{i}.html" for i in range(30)]
    rows += [f"http://h0.org/es/{i}" for i in range(30)] + [f"http://h1.com/item/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    found = [r for r in url_filter.judge(pages).collect()]
    by = {(r.host, r.template): r.verdict for r in found}
    assert by["h0.org", "/es/*"] == "block" and by["h0.net", "/item/*"] == "allow" and by["h1.com", "/item/*"] == "allow"
    assert len(found) == len(rows)


def test_html_text(spark):
    article = "<article><h1>A &lt;title&gt;</h1><p>One   para&shy;graph,\nwith <b>bold</b> text.<br>More of it.<p>Second &amp; last, of text.</article>"
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a>"
        f"</ul></nav><header><p>Name of the site</p></header>{article}<div class='comments'><p>A reader, who says much, and at length."
        "</p></div><form><p>Your name</p></form><aside><p>Other text, which is long. And more.</p></aside><footer>&copy; all</footer><p"
    )
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p"), (3, "w", "<p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = html_text.train(pages)
    found = html_text.extract(pages, model).collect()
    assert len(found) == 5
    text = next(r.text for r in found if r.page_id == 1)
    want = "A <title>\nOne para\xadgraph, with bold text. More of it.\nSecond & last, of text."
    assert text == want
    assert all(r.n_chars == len(r.text) for r in found) and sum(r.text == "" for r in found) == 4
    assert html_text.extract(pages.limit(0), html_text.train(pages.limit(0))).count() == 0


def test_marginals_equal_enumeration():
    from itertools import product

    model = html_text.fitted({}, html_text.Settings())
    nodes, _ = html_text.parse("<body><div><p>Some text, here.</p><ul><li>x</ul></div><nav><p>y</p></nav></body>")
    told = html_text.features(nodes)
    unary = [sum(model.weights.get(f, 0) for f in t) if i else -20.0 for i, t in enumerate(told)]
    total, one = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        log = sum(u for u, x in zip(unary, labels, strict=True) if x)
        for i, node in enumerate(nodes[1:], 1):
            log += model.edges[html_text.kind(nodes[node.parent])][labels[node.parent]][labels[i]]
        total += math.exp(log)
        for i, x in enumerate(labels):
            one[i] += x * math.exp(log)
    assert np.allclose([x / total for x in one], html_text.marginals(nodes, model))
