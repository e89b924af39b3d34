import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, html, language, quality, toxicity

from . import cases


@pytest.fixture(scope="module")
def labelled(spark):
    rows, marks = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = cases.prose(1000 + i, 60)
        if toxic:
            text += f" you scoundrel{i % 7} fool and blockhead{i % 5}"
        if bad:
            text = "*** ".join(text.upper().split())
        rows.append((1000 + i, text, "en", None, None, 0.0, "k"))
        if i % 2 == 0 or i % 3 == 0:
            marks.append((1000 + i, int(not bad), int(toxic), 1.0))
    docs = spark.createDataFrame(rows, cases.SCHEMA).unionByName(cases.documents(spark))
    return docs.cache(), spark.createDataFrame(marks, "doc_id long, quality int, toxic int, score double").cache()


def check(docs, labels, scored, column):
    assert scored.count() == docs.count()
    rows = scored.join(labels.select("doc_id", F.col(column).alias("mark")), "doc_id").collect()
    right = np.mean([(r["chance"] >= 0.7) == (r["mark"] == 1) for r in rows])
    assert right >= 0.95, right
    assert scored.filter("chance is null or chance < 0 or chance > 1").count() == 0


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, common.remainder("doc_id", 4) != 2)
    check(docs, labels, quality.with_score(docs, model, "chance").select("doc_id", "chance"), "quality")
    positive_only = quality.fit(docs, labels.filter("quality = 1"), F.lit(True))
    assert positive_only is not None
    assert quality.fit(docs, labels.filter("quality = 0"), F.lit(True)) is None
    assert quality.fit(cases.empty(spark), labels, F.lit(True)) is None
    assert quality.with_score(docs, None).filter("score <> 0.5").count() == 0


def test_toxicity_knows_new_spellings(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, common.remainder("doc_id", 3) != 1)
    check(docs, labels, toxicity.with_score(docs, model, "chance").select("doc_id", "chance"), "toxic")
    clean, new, empty = model.score([cases.prose(5, 60), cases.prose(5, 60) + " scoundrelly scoundrells foolz", ""])
    assert new > clean and 0 <= empty <= 1
    assert toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True)) is None


def test_language_word_first_then_ngrams(spark):
    words = {"aa": ["kala", "mala", "tala", "bena"], "bb": ["wrok", "strok", "plux", "grux"]}
    draw = np.random.default_rng(3)
    rows = [(200 + i, " ".join(draw.choice(words[lang], 12)), lang, None, None, 0.0, "k") for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, cases.SCHEMA).unionByName(cases.documents(spark))
    model = language.fit(docs, common.remainder("doc_id", 3) != 1)
    found = {r.doc_id: r for r in language.with_language(docs, model).collect()}
    assert all(found[d].lang_pred == lang for d, _, lang, *_ in rows)
    assert found[1].lang_pred == found[2].lang_pred == found[5].lang_pred == "und" and found[1].score == 0
    best, chance = model.predict(["kalama talala", "wroxtrok", "12 😀"])
    assert [model.languages[i] for i in best[:2]] == ["aa", "bb"] and best[2] == -1 and 0 < chance[0] <= 1
    assert language.fit(cases.empty(spark), F.lit(True)) is None


def test_small_languages_are_learned_from_a_skewed_table(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS", 200)
    monkeypatch.setattr(language, "WORDS", 40)
    monkeypatch.setattr(language, "NGRAMS", 60)
    draw = np.random.default_rng(4)
    large = ["".join(draw.choice(list("aeklmt"), 6)) for _ in range(300)]
    rows = [(i, " ".join(draw.choice(large, 20)), "aa") for i in range(6000)]
    rows += [(9000 + i, "plux grux wrok plux strok wrok grux strok", "bb") for i in range(2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["aa", "bb"] and len(model.keys[0]) <= 40 and all(len(k) <= 60 for k in model.keys[1:])
    best, _ = model.predict(["wrok plux strok", "gruxwrok", *(t for _, t, _ in rows[:50])])
    assert [model.languages[i] for i in best] == ["bb", "bb"] + ["aa"] * 50


PAGE = """<html><head><title>t</title><script>if (a < b) { "</p>" }</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<article><h1>Head &amp; shoulders</h1><p><b>First  line,
with a break.<br>And more of it.<p>Second one. {n}</article><div class="ad">Buy this.</div><footer>&copy; us</footer></body></html>"""


def test_blocks_follow_the_markup():
    texts = [b.text for b in html.blocks(PAGE)]
    assert texts == ["Site", "Home", "Head & shoulders", "First line, with a break. And more of it.", "Second one. {n}", "Buy this.", "© us"]
    assert html.blocks("") == [] and [b.text for b in html.blocks("a < b &lt; c <p")] == ["a < b < c <p"]


def test_code_in_silent_tags_does_not_swallow_the_page():
    codes = ["<script>for(i=0;i<n;i++){f(i)}</script>", "<SCRIPT>var c = '<!--';</Script >", "<style>a:before{content:'<b \"'}</style>",
             "<head><script>if(i<n){'</head>'}</script><!-- </head> --><title>a <b \"</title></head>", "<noscript><p>on<style>x<y'</style></noscript>",
             "<script>'</scripted>'; i<n;</script\n>", "<svg><title>c <d '</title><path/></svg>", "<textarea><p <!-- </textarea>"]
    for code in codes:
        texts = [b.text for b in html.blocks(f"<p>Before.{code}<p>After.<p>Last.")]
        assert texts == ["Before.", "After.", "Last."], code
    assert [b.text for b in html.blocks("<head><!-- </head> --><p>Open.")] == ["Open."]
    assert [b.text for b in html.blocks("<p>One.</p><script>cut</script")] == ["One."]


def test_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", PAGE.replace("{n}", cases.prose(i, 20)), "x") for i in range(40)] + [(90, "u", None, "x"), (91, None, "", "x"), (92, "u", "<p>", "x")],
                                  "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(got) == 43
    for i in range(40):
        want = ["Head & shoulders", "First line, with a break. And more of it.", "Second one. " + cases.prose(i, 20)]
        assert got[i].text == "\n\n".join(want) and got[i].n_chars == len(got[i].text)
    assert got[90].text == got[91].text == got[92].text == "" and got[90].n_chars == 0
    assert html.extract(pages.limit(0)).count() == 0


def test_chain_likelihood_and_viterbi_agree_with_enumeration():
    from itertools import product

    seq = html.blocks(PAGE)
    model = html.Model({"tag=p": 1.0, "in=article": 0.7, "bias": -0.4}, np.array([[0.3, -0.5], [-0.2, 0.6]]), np.array([0.1, -0.1]))
    gains = [sum(model.weight.get(f, 0.0) for f in own) for own in html.features(seq)]

    def value(path):
        total = model.start[path[0]] + gains[0] * path[0]
        return total + sum(model.stay[a, b] + g * b for a, b, g in zip(path, path[1:], gains[1:]))

    best = max(product((0, 1), repeat=len(seq)), key=value)
    assert [int(x) for x in model.decode(seq)] == list(best)


def test_broken_and_deep_pages_take_linear_time():
    """200 kB pages that a scan from every bracket, or a walk over all ancestors, would not get through."""
    parts = ["<a ", "<!", "<div>x", '<a "', "<svg><script>", "<x\"y'z", "<b>", "</b><p>", "<ul class=c><li>"]
    start = time.process_time()
    for part in parts:
        page = part * (200_000 // len(part))
        html.features(html.blocks(page))
        html.features(html.blocks(page + ">" + "</div>" * 1000 + '"'))
    assert time.process_time() - start < 60
    deep = "<nav>" + "<div>" * 100 + "Home" + "</div>" * 100 + "</nav><article><p>Text <b>here</b></article>"
    own = html.features(html.blocks(deep))
    assert "in=nav" in own[0] and "other" in own[0] and "in=nav" not in own[1]
    assert [b.text for b in html.blocks('<p title="a > b">one<p>two <i>x</i><!-- <p> --><br>y</p> <b>z')] == ["one", "two x y", "z"]


def test_sample_of_pages_is_bounded_under_repeats(spark):
    rows = [(i, f"u{i}", "<body><nav>menu</nav><article><p>same</p></article></body>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = html.fit(pages, bound=20)
    assert {r.text for r in html.extract(pages, model).collect()} == {"same"}


def test_chain_gradient_equals_enumeration():
    """One step of training against the gradient summed over all labelings."""
    from itertools import product

    seq = html.blocks("<nav>a</nav><p>b c.</p><p>d, e</p>")
    pages = [(seq, [False, True, True]), (seq[1:], [True, False])]
    names = [[html.features(s) for s, _ in pages]]
    known = [f for f, n in Counter(f for own in names[0] for fs in own for f in fs).items() if n > 1]

    def score(flat, own, labels):
        w, stay, first = flat[:-6], flat[-6:-2].reshape(2, 2), flat[-2:]
        gain = sum(w[known.index(f)] for fs, y in zip(own, labels) if y for f in fs if f in known)
        return gain + first[labels[0]] + sum(stay[a, b] for a, b in zip(labels, labels[1:]))

    def loss(flat):
        total = 0.0
        for own, (_, labels) in zip(names[0], pages):
            z = np.logaddexp.reduce([score(flat, own, y) for y in product((0, 1), repeat=len(labels))])
            total += z - score(flat, own, [int(y) for y in labels])
        return total / sum(len(labels) for _, labels in pages) + 0.5 * 1e-4 * (flat @ flat)

    def flat_of(model):
        return np.concatenate([[model.weight[f] for f in known], model.stay.reshape(-1), model.start])

    # Adam's first step is the sign of the gradient; after it, a second step shows the gradient's size
    one = flat_of(html.train(pages, rounds=1, rate=1e-3))
    at = np.zeros(len(known) + 6)
    numeric = np.array([(loss(at + e) - loss(at - e)) / 2e-5 for e in 1e-5 * np.eye(len(at))])
    moved = np.abs(numeric) > 1e-6
    assert (np.sign(one[moved]) == -np.sign(numeric[moved])).all()
    two = flat_of(html.train(pages, rounds=2, rate=1e-3))
    later = np.array([(loss(one + e) - loss(one - e)) / 2e-5 for e in 1e-5 * np.eye(len(at))])
    first, second = (0.9 * 0.1 * numeric + 0.1 * later) / (1 - 0.81), (0.999 * 0.001 * numeric ** 2 + 0.001 * later ** 2) / (1 - 0.999 ** 2)
    want = one - 1e-3 * first / (np.sqrt(second) + 1e-8)
    assert np.allclose(two[moved], want[moved], atol=1e-6)


def test_language_scores_equal_plain_dictionaries(spark):
    """Word-first backoff with dictionaries of strings instead of hash tables."""
    draw = np.random.default_rng(8)
    syllables = {"aa": ["ka", "la", "ta", "né", "mi"], "bb": ["stro", "wok", "plu", "xi", "ka"], "cc": ["on", "ün", "the", "ka", "r"]}
    word = lambda lang: "".join(draw.choice(syllables[lang], draw.integers(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(9)).title() + ", 12!", lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    letters = lambda text: "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = lambda w, n: [w[i:i + n] for i in range(len(w))] if n == 1 else [f"#{w}#"[i:i + n] for i in range(len(w) + 3 - n)]
    counts = [{lang: Counter() for lang in model.languages} for _ in range(language.LONGEST + 1)]
    for _, text, lang in rows:
        for w in letters(text):
            counts[0][lang][w] += 1
            for n in range(1, language.LONGEST + 1):
                counts[n][lang].update(grams(w, n))
    tables = []
    for by in counts:
        total = sum(by.values(), Counter())
        kept = [k for k, n in total.items() if n > 1]
        n = np.array([[by[lang][k] for lang in model.languages] for k in kept], float)
        tables.append(dict(zip(kept, np.log((n + language.SMOOTH) / (n.sum(axis=0) + language.SMOOTH * len(kept))))))

    def weight(w):
        if w in tables[0]:
            return tables[0][w]
        for n in range(language.LONGEST, 0, -1):
            hits = [tables[n][g] for g in grams(w, n) if g in tables[n]]
            if hits:
                return np.mean(hits, axis=0)
        return np.zeros(len(model.languages))

    asked = [" ".join(word(lang) + draw.choice(["", "q", "ny"]) for _ in range(draw.integers(1, 20))) for lang in ("aa", "bb", "cc") * 20] + ["zzz 9", "7"]
    best, chance = model.predict(asked)
    for text, b, c in zip(asked, best, chance):
        own = letters(text)
        if not own:
            assert b == -1 and c == 0
            continue
        mean = np.mean([weight(w) for w in own], axis=0)
        assert np.isclose(mean[b], mean.max())
        assert np.isclose(c, 1 / np.exp((mean - mean.max()) * min(len(own), language.SURE)).sum())


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_quality_steps_follow_the_gradient_of_the_risk(prior):
    draw = np.random.default_rng(2)
    positive, unlabelled = draw.normal(1, 1, (30, quality.MEASURES)).astype(np.float32), draw.normal(0, 1, (50, quality.MEASURES)).astype(np.float32)
    shape = quality._fit(positive, unlabelled, prior, rounds=0)

    def risk(flat):
        model = quality.Model(shape.edges, flat[:-1].reshape(shape.weights.shape), float(flat[-1]))
        p, u = model.score(positive), model.score(unlabelled)
        rest = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
        decay = 0.5e-4 * (flat[:-1] @ flat[:-1])
        return (prior * -np.log(p).mean() + rest if rest >= 0 else -rest) + decay

    def numeric(flat, places):
        return np.array([(risk(flat + e) - risk(flat - e)) / 2e-4 for e in (1e-4 * np.eye(len(flat))[i] for i in places)])

    flat_of = lambda m: np.append(m.weights.reshape(-1), m.bias)
    places = np.append(np.arange(0, shape.weights.size, 7), shape.weights.size)
    rate = 1e-3
    one, two = (flat_of(quality._fit(positive, unlabelled, prior, rounds=n, rate=rate)) for n in (1, 2))
    g1 = numeric(np.zeros(len(one)), places)
    sure = np.abs(g1) > 1e-5
    assert sure.sum() > 20 and np.allclose(one[places][sure], -rate * np.sign(g1[sure]), rtol=1e-2)
    g2 = numeric(one, places)
    first, second = (0.09 * g1 + 0.1 * g2) / (1 - 0.81), (0.999e-3 * g1 ** 2 + 1e-3 * g2 ** 2) / (1 - 0.999 ** 2)
    assert np.allclose((two - one)[places][sure], (-rate * first / (np.sqrt(second) + 1e-8))[sure], rtol=1e-2, atol=1e-7)
