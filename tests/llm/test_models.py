import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bitslice, hmm, html_text, licences, mixing, packing, queries, toxicity


def brute_segments(scores):
    """Ruzzo and Tompa's recursive definition: the best segment, then the same left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    a, b = max(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda p: (round(sums[p[1]] - sums[p[0]], 9), -(p[1] - p[0]), -p[0]))
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b, sums[b] - sums[a])] + [(x + b, y + b, s) for x, y, s in right]


def test_segments_are_all_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-1.0, -1.0, -1.0, 0.37, 1.71, 2.93]) for _ in range(rng.randrange(1, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        found = toxicity.segments(at, [scores[i] for i in at], 1.0)
        assert [(a, b, round(s, 6)) for a, b, s in found] == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "st", "ing"]) for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        words, toxic = [word() for _ in range(60)], i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vilest", "scoundrel", "wretchxx" + word()])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    extra = labels + [(None, 1, 1), (3, 1, None), (10_000, 0, 1), (6, 0, 0)]
    return make(rows), spark.createDataFrame(extra, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted for r in held if truth[r.doc_id]) >= 0.9 * sum(truth[r.doc_id] for r in held)
    assert not any(r.predicted for r in held if not truth[r.doc_id])


def test_toxicity_awkward(labelled, awkward, nothing):
    _, labels, _ = labelled
    assert {r.score for r in toxicity.toxicity(awkward, labels).collect()} == {0.0}  # no labelled row of either class
    assert toxicity.toxicity(nothing, labels).count() == 0
    model = toxicity.train(labelled[0], labels, F.lit(True))
    found = toxicity.apply(awkward, model).collect()
    assert len(found) == 12 and len({round(r.score, 9) for r in found}) == 1
    assert toxicity.keep_clean(awkward, model).columns == awkward.columns and toxicity.keep_clean(awkward, model).count() == 12
    assert toxicity.toxicity(awkward, labels.limit(0)).where("score > 0").count() == 0


def test_best_fit_matches_plain_search():
    rng = random.Random(3)
    for _ in range(100):
        sizes = sorted((rng.randrange(0, 30) for _ in range(40)), reverse=True)
        sources, clusters = [1 << rng.randrange(4) for _ in sizes], [rng.choice([0, 0, 1, 2, 4]) for _ in sizes]
        bins, expected = [], []  # residual, sources, clusters
        for n, s, c in zip(sizes, sources, clusters, strict=True):
            fits = [(r, i) for i, (r, bs, bc) in enumerate(bins) if r >= n and not bs & s and not bc & c]
            i = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append((30, 0, 0))
            r, bs, bc = bins[i]
            bins[i] = (r - n, bs | s, bc | c)
            expected.append(i)
        assert packing.best_fit(sizes, sources, clusters, 30) == expected


def test_packing(make, corpus, awkward, nothing, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    packed = packing.pack(make(corpus), capacity=64).collect()
    tokens, bins = Counter(), {}
    for p in packed:
        tokens[p.doc_id] += p.n_tokens
        bins.setdefault(p.bin_id, []).append(p)
    assert tokens == Counter({i: len(t.split()) for i, t in corpus})  # nothing is lost
    for own in bins.values():
        assert sum(p.n_tokens for p in own) <= 64
        named = [p.source for p in own if p.source is not None]
        assert len(named) == len(set(named))
    found = packing.pack(awkward, capacity=2048)
    assert found.where("doc_id = 4").agg(F.sum("n_tokens")).head()[0] == 30_000 and found.where("doc_id = 2").head().n_tokens == 0
    assert packing.pack(nothing).count() == 0
    assert packing.bins(found).agg(F.max("n_tokens")).head()[0] <= 2048


def test_raking_meets_marginals():
    rng = np.random.default_rng(0)
    tokens = rng.integers(100, 1000, (4, 3, 2)).astype(float)
    targets = [np.array([0.3, 0.2, 0.3, 0.2]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    kept = mixing.rake(tokens, targets, 0.2) * tokens
    for axis, goal in enumerate(targets):
        assert np.allclose(kept.sum(axis=tuple(i for i in range(3) if i != axis)), goal * 0.2 * tokens.sum(), rtol=1e-3)
    p = mixing.rake(tokens, targets, 0.95)
    assert p.max() <= 1 + 1e-12 and p.min() > 0


def test_mixing(make, corpus, awkward, nothing):
    docs = make(corpus)
    found = mixing.mix(docs, share=0.5).collect()
    assert len(found) == len(corpus) and all(r.kept == (r.u < r.p_keep) for r in found)
    assert abs(sum(r.p_keep * len(r.text.split()) for r in found) / sum(len(r.text.split()) for r in found) - 0.5) < 0.05
    assert {r.doc_id for r in mixing.mix(docs, share=0.5).where("kept").collect()} == {r.doc_id for r in found if r.kept}
    given = mixing.mix(docs, share=0.3, targets={"source": {"a": 1, "b": 1}}).collect()
    share = Counter()
    for r in given:
        share[r.source] += r.p_keep * len(r.text.split())
    assert abs(share["a"] - share["b"]) < 0.02 * share["a"] and share[None] == 0
    assert mixing.mix(awkward).count() == 12 and mixing.mix(nothing).count() == 0


def test_likelihood_and_counts_against_all_paths():
    rng = np.random.default_rng(0)
    k, m = 3, 5
    model = hmm.Model(np.array([0.5, 0.3, 0.2]), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k).T)
    sequences = [[0, 1, 4], [2], [3, 3, 1, 0, 4], [1, 4]]
    bounds, syms = np.cumsum([0] + [len(s) for s in sequences]), np.array(sum(sequences, []))
    start, move, emit, logs = np.zeros(k), np.zeros((k, k)), np.zeros((m, k)), []
    for s in sequences:
        paths = list(itertools.product(range(k), repeat=len(s)))
        p = np.array([model.start[z[0]] * model.emit[s[0], z[0]] * math.prod(model.move[z[i - 1], z[i]] * model.emit[s[i], z[i]] for i in range(1, len(s))) for z in paths])
        logs.append(math.log(p.sum()))
        for w, z in zip(p / p.sum(), paths, strict=True):
            start[z[0]] += w
            for i, x in enumerate(s):
                emit[x, z[i]] += w
                if i:
                    move[z[i - 1], z[i]] += w
    assert np.allclose(model.log_likelihood(syms, bounds), logs)
    assert np.allclose(model.expected(syms, bounds), np.concatenate([start, move.ravel(), emit.ravel()]))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    syms = np.concatenate([rng.integers(0, 5, 3000), rng.integers(5, 10, 3000)])
    bounds = np.arange(0, 6001, 50)
    model, before = hmm.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), rng.dirichlet(np.ones(10), 2).T), -np.inf
    for _ in range(5):
        now = model.log_likelihood(syms, bounds).sum()
        assert now > before
        before, model = now, hmm.Model.from_counts(model.expected(syms, bounds), 2, np.full(10, 0.1), weight=0.01)


@pytest.mark.parametrize("frequent", [32_000, 20])
def test_language_model(make, corpus, frequent, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    found = {r.doc_id: r for r in hmm.score(make(corpus), states=3).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus}
    counts = Counter(w for i, t in corpus if not held[i] for w in [*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in corpus:
        own, r = [*t.encode().lower().split(), None], found[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    if frequent > 1000:
        assert sum(r.score for r in found.values() if r.held_out) > sum(r.base_score for r in found.values() if r.held_out)


def test_language_model_awkward(awkward, nothing, make):
    found = hmm.score(awkward).collect()
    assert len(found) == 12 and {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {1} and all(math.isfinite(r.score) for r in found)
    assert hmm.score(nothing).count() == 0
    alone = next(i for i in range(99) if hmm.is_held_out(i, 7, 2))
    (r,) = hmm.score(make([(alone, "a b")])).collect()  # nothing to learn from
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score


def test_bit_slices_against_sorting():
    rng = np.random.default_rng(0)
    for n, k, wide, far in ((1, 3, 3, 0), (5, 20, 3, 1), (300, 20, 40, 9), (1000, 7, 1, 0)):
        values = np.floor(rng.normal(size=(n, 8)) * wide).astype(np.int64)
        values[:far] *= 1 << 40
        ids, numbers = np.sort(rng.integers(0, 10_000, n)), rng.permutation(n)
        index, asked = bitslice.Index(ids, numbers, values), values[:20]
        slices = index.sums(np.where(bitslice.is_wide(asked)[:, None], 0, asked))
        for j in range(len(asked)):
            best, scores = index.best(asked[j], numbers[j], None if bitslice.is_wide(asked[j : j + 1])[0] else slices, j, k)
            exact = lambda v: sum(a * b for a, b in zip(v.tolist(), asked[j].tolist(), strict=True))
            assert [(-s, index.ids[i]) for s, i in zip(scores, best, strict=True)] == sorted((-exact(v), i) for at, (v, i) in enumerate(zip(values, ids, strict=True)) if at != j)[:k]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.choice([-1.5, -0.25, 0.1, 0.3, 2.0], 6)], 0) for i in range(300)] + [(i, [0.5] * 6, 0) for i in range(300, 400)]
    bad = [(500, None, 0), (520, [1.0, None], 0), (540, [float("nan")], 0), (560, [float("inf")], 0), (None, [1.0], 0), (580, [], 0)]
    # components beyond 2^24 once quantised, as candidates and queries, and rows that share an id
    odd = [(0, [0.7] * 6, 1), (7, rows[7][1], 1), (600, [3e6, -1e6] * 3, 0), (601, [3e6, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (603, [1e7, 1.5, 0.0, 0.0, 0.0, 0.0], 0), (620, [262144.5] * 6, 0)]
    df = spark.createDataFrame(rows + bad + odd, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).withColumn("rank", F.lit("x"))
    found = {}
    for r in bitslice.top_k(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    sound = [(i, [math.floor(64 * x) for x in v] + [0] * (6 - len(v))) for i, v, _ in rows + bad + odd if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wanted = {}
    for a, (i, v) in enumerate(sound):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(sound) if a != b)[:20]
            wanted.setdefault(i, []).extend((n, *x) for n, x in enumerate(best, 1))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in wanted.items()} and len(found[0]) == 40
    assert bitslice.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_in_rounds_copies_no_vectors(spark, monkeypatch):
    for name, value in (("BLOCK", 50), ("ROUND", 7), ("TOGETHER", 3)):
        monkeypatch.setattr(bitslice, name, value)
    rng = np.random.default_rng(6)
    whole = rng.integers(-3, 4, (400, 5))
    df = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in enumerate(whole.tolist())], "vec_id long, embedding array<double>").repartition(3)
    out = bitslice.top_k(df, F.col("vec_id") % 20 == 0, k=6)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # each block was copied for each part of the queries
    found = {}
    for r in out.collect():
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for q in range(0, 400, 20):
        best = sorted((-int(s), j) for j, s in enumerate(whole @ whole[q]) if j != q)[:6]
        assert sorted(found.pop(q)) == [(n, *x) for n, x in enumerate(best, 1)]
    assert not found and bitslice.top_k(df, F.lit(False)).count() == 0


def test_automaton_gives_matching_statistics():
    rng = random.Random(1)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        automaton, text = licences.Automaton(sequences), [rng.randrange(4) for _ in range(30)]
        for i, (state, length) in enumerate(automaton.statistics(text)):
            known = [k for k in range(i + 2) if k == 0 or any(text[i + 1 - k : i + 1] == s[e - k : e] for s in sequences for e in range(k, len(s) + 1))]
            assert length == max(known)
            if length:
                assert automaton.ends[state] == {(j, e) for j, s in enumerate(sequences) for e in range(length, len(s) + 1) if s[e - length : e] == text[i + 1 - length : i + 1]}


def test_licences(make, awkward, nothing):
    texts = [
        "foo Licensed under the Apache License, Version 2.0. bar Released under the MIT License. under the mit license", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "nothing here of the license", "UNDER\nTHE  MIT-license", "under thé mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and the associated documentation files (the Software) to deal in the Software without any restriction",
    ]
    found = [r for r in licences.licence_scan(make(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found] == [
        (3, 4, 15, "apache-2,mit", "apache-2,mit"), (1, 2, 2, "cc-by-nc", "cc-by-nc"), (0, None, None, "", "gpl-3"), (0, None, None, "", ""), (1, 0, 0, "mit", "mit"), (0, None, None, "", ""), (0, None, None, "", "mit"),
    ]
    assert all(0 <= r.score <= 1 for r in found) and [r.n_words for r in found][:3] == [19, 7, 12]
    edge = licences.licence_scan(awkward).collect()
    assert len(edge) == 12 and {r.labels for r in edge} == {""} and licences.licence_scan(nothing).count() == 0


def test_licence_versions_and_kinds(make):
    wanted = {
        "This work is licensed under the GNU General Public License version 2": "gpl-2", "This work is licensed under the GNU General Public License version 3.": "gpl-3",
        "Licensed under the Apache License, Version 1.0": "apache-1", "Licensed under the Apache License, Version 2.0": "apache-2", "licensed under the apache license version 7": "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    }
    for kind in ("", "NonCommercial", "NonCommercial ShareAlike", "NonCommercial NoDerivatives", "ShareAlike", "NoDerivatives"):
        label = "cc-by" + "".join("-" + {"NonCommercial": "nc", "ShareAlike": "sa", "NoDerivatives": "nd"}[k] for k in kind.split())
        wanted[f"This work is licensed under a Creative Commons Attribution {kind} 4.0 International License."] = label
    gnu = "You can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License"
    wanted |= {gnu.format("Lesser"): "lgpl-3", gnu.format("Affero"): "agpl-3", gnu.format(""): "gpl-3"}
    texts = list(wanted)
    rows = licences.licence_scan(make([(i, f"word and {t} end here") for i, t in enumerate(texts)])).collect()
    assert {texts[r.doc_id]: r.labels for r in rows} == wanted


def test_matches_of_each_template_against_plain_search():
    scanner, rng = licences.Scanner(), random.Random(3)
    for _ in range(40):
        text = [w for _ in range(3) for t in [rng.choice(scanner.templates)] for a in [rng.randrange(len(t))] for w in t[a : a + rng.randrange(1, 14)]]
        for (state, length), i in zip(scanner.automaton.statistics(text), range(1, len(text) + 1), strict=True):
            now = {end: min(size, length) for end, size in scanner.reached(state).items() if min(size, length) >= licences.LEAST}
            plain = {}
            for t, own in enumerate(scanner.templates):
                for past in range(1, len(own) + 1):
                    n = 0
                    while n < min(i, past) and own[past - 1 - n] == text[i - 1 - n]:
                        n += 1
                    if n >= licences.LEAST:
                        plain[t, past] = n
            assert now == plain


def test_licence_base_against_plain_search(make):
    rng = random.Random(6)
    pool = "under the mit license apache version 2 cc by nc foo".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(200))) for i in range(40)]
    for r in licences.licence_scan(make(rows)).collect():
        words = rows[r.doc_id][1].split()
        hits = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert r.n_base == len(hits) and r.first_word == min((i for i, _ in hits), default=None) and r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header>Site <a href=/>home</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this</div><div id="cookie-notice">We use cookies</div>
%s<aside>More</aside><div class="comments"><p>nice post</p></div><form>Name <input></form><footer>&copy; us</footer></body></html>"""


def test_html_main_text():
    article = "<article><h1>Title &amp; more</h1><p><b>First&nbsp;<i>para</i>graph\n here<br><p>Second.</p><ul><li>one<li>two</ul><p>x</p></article>"
    wanted = "Title & more\nFirst paragraph here\nSecond.\none\ntwo\nx"
    assert html_text.main_text(PAGE % article) == wanted
    plain = article.replace("<article>", "<div class='content'>").replace("</article>", "</div>").replace("Second.", "Second " + "word " * 30 + "end.")
    assert html_text.main_text(PAGE % plain) == wanted.replace("Second.", "Second " + "word " * 30 + "end.")
    assert html_text.main_text(PAGE % "") == "" and html_text.main_text(None) == "" and html_text.main_text("<p>unclosed <b") == ""
    cut = (PAGE % article).split("</body>")[0]
    assert html_text.main_text(cut) == wanted


def test_html_unmarked_pages_keep_short_text():
    assert html_text.main_text("<div id='content'><h1>Notice</h1><p>Closed on Monday.</p></div>") == "Notice\nClosed on Monday."
    words = "word " * 40 + "end."
    dull = "<div class='ad'>Buy</div><form>Name</form><div class='share'>Share</div><div class='promo'>More</div>"
    assert html_text.main_text(PAGE % f"<div class='content'><h1>Title</h1><p>{words}</p>{dull}<p>Bye.</p></div>") == f"Title\n{words}\nBye."
    links = "<ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a><li><a href=/4>Four</a></ul>"
    assert html_text.main_text(f"<div>{links}</div><div><p>{words}</p><p>See <a href=/r>the whole report</a>.</p>{links}<p>Bye.</p></div><div>{links}</div>") == f"{words}\nSee the whole report.\nBye."


def test_html_wrappers_are_not_furniture():
    for start in ("div class='layout has-sidebar'", "div id='no-sidebar'", "div class='social-impact'", "section class='related-work'"):
        name = start.split()[0]
        assert html_text.main_text(f"<body><{start}><p>Some text.</p></{name}><p>Other text that is longer.</p></body>") == "Some text.\nOther text that is longer."
    for mark in ("container with-sidebar", "sidebar", "page-widget"):
        page = f"<div class='{mark}'><article><p>Text.</p><div class='ad'>Buy</div></article><div class='comments'><article>nice</article></div></div>"
        assert html_text.main_text(page) == "Text."
    most = "Most of the text of this page. " * 3 + "End."
    assert html_text.main_text(f"<div class='widget'><p>{most}</p></div><p>Short.</p>") == f"{most}\nShort."
    assert html_text.main_text("<article><p>Text.</p></article><div class='related-posts'><article>Another one, rather long</article></div>") == "Text."


@pytest.mark.parametrize(("page", "wanted"), [
    ("<article><video-player src=x></video-player><p>Text after it.</p></article>", "Text after it."), ("<article><object-card>Card text.</object-card><p>More of it.</p></article>", "Card text.\nMore of it."),
    ("<article><p>Before it.</p><svg width=1 /><p>After it.</p></article>", "Before it.\nAfter it."), ("<article><p data-x=it's>Some text.</p></article>", "Some text."),
    ('<article><p class="x>Hello there.</p><p class="y">Second one.</p></article>', "Hello there.\nSecond one."), ("<article><p class='share-price'>Price is 3.</p><p id='comment-on-law'>On law.</p></article>", "Price is 3.\nOn law."),
    ("<article><p title='a > b'>If a < b then c.</p><canvas>no end<p>Last one.</p></article>", "If a < b then c.\nno end\nLast one."), ("<article><p>Text here.</p><script>if (a</b) '<p>'</SCRIPT ><p>End of it.</p></article>", "Text here.\nEnd of it."),
    ("<article><p>One <!-- > --> two.</p><!doctype x><?php y ?><p>Three four.</article", "One two.\nThree four."),
])
def test_html_odd_markup(page, wanted):
    assert html_text.main_text(page) == wanted


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a x='", "<svg>", "<!--", "</", "<a x=\"y'", "<", "<p class=\"a\"b\""])
def test_html_scan_is_linear(piece):
    def steps(n):
        began = time.perf_counter()
        list(html_text.Scanner(piece * n + '"').tags())
        return time.perf_counter() - began

    assert steps(100_000) < 6.0  # a quadratic scan takes minutes


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE % "<main><p>a</p></main>", "x"), (1, "u", PAGE % "<main><p>a</p></main>", "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("", 0), ("a", 1), ("a", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_queries_cover_all_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
