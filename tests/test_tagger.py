import random
from itertools import product

import numpy as np

from threadloom.operators import tagger

FIRST = ["Anil", "Ravi", "Meera", "Tara", "Joan", "Piet", "Olga", "Sven", "Ines", "Kofi", "Zeno", "Élan"]
LAST = ["Rao", "Das", "Shah", "Berg", "Lopez", "Mensah", "Novak", "Okoye", "Quist", "Wuori"]
TOWNS = ["Pune", "Goa", "Oslo", "Lyon", "Accra", "Delhi", "Turin", "Bergen", "Malmö", "Cusco"]
FORMS = ["{a} called {b} from the depot on Monday.", "Police saw {a} near {t} at noon.", "{a} met {b} in {t}.", "The van left {t} before {a} came.",
         "Mr. {a} uses phone 98765.", "Nobody came to the old Market Hall.", "The Ledger was closed, said {b}."]


def sentences(seed, n, people, towns):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, t = draw.choice(people), draw.choice(people), draw.choice(towns)
        form = draw.choice(FORMS)
        truth = {("Person", a)} if "{a}" in form else set()
        truth |= {("Person", b)} if "{b}" in form else set()
        truth |= {("Location", t)} if "{t}" in form else set()
        rows.append((i, form.format(a=a, b=b, t=t), truth))
    return rows


def test_names_outside_the_dictionary_are_found(spark):
    known = [f"{f} {x}" for f, x in product(FIRST[:6], LAST[:5])]
    new = [f"{f} {x}" for f, x in product(FIRST[6:], LAST[5:])]
    rows = sentences(1, 600, known, TOWNS[:5])
    table = lambda data: spark.createDataFrame([(i, s) for i, s, _ in data], "doc_id int, sentence string")
    names = spark.createDataFrame([(n,) for n in known], "name string")
    places = spark.createDataFrame([(n,) for n in TOWNS[:5]], "name string")
    model = tagger.fit(table(rows), names, places, bound=400)
    held = sentences(2, 300, new, TOWNS[5:])
    odd = [(900, None, set()), (901, "", set()), (902, " ", set()), (903, "!?", set())]
    got = {}
    for r in tagger.tagged_mentions(table(held + odd), model).collect():
        got.setdefault(r.doc_id, set()).add((r.label, r.value))
    hits = sum(len(truth & got.get(i, set())) for i, _, truth in held)
    precision, recall = hits / sum(map(len, got.values())), hits / sum(len(t) for _, _, t in held)
    f1 = 2 * precision * recall / (precision + recall)
    print("held-out F1", f1)
    assert f1 > 0.9 and not got.keys() & {900, 901, 902, 903}
    assert tagger.tagged_mentions(table(held).limit(0), model).count() == 0


def test_best_path_equals_enumeration():
    draw = np.random.default_rng(5)
    n = len(tagger.TAGS)
    model = tagger.Model(np.zeros((1, n)), draw.normal(size=(n + 1, n)))
    gains = draw.normal(size=(6, 4, n))
    lengths = np.array([1, 2, 3, 4, 4, 2])
    for tags, own, size in zip(model.paths(gains, lengths), gains, lengths):
        score = lambda p: sum(own[i, t] + model.step[p[i - 1] if i else n, t] for i, t in enumerate(p))
        assert tuple(tags[:size]) == max(product(range(n), repeat=int(size)), key=score)


def test_tables_without_names_train_an_empty_model(spark):
    none = spark.createDataFrame([], "doc_id int, sentence string")
    names = spark.createDataFrame([("Anil Rao",)], "name string")
    model = tagger.fit(none, names, names)
    some = spark.createDataFrame([(1, "Anil Rao left.")], "doc_id int, sentence string")
    assert not model.weight.any() and tagger.tagged_mentions(some, model).count() == 0


def test_tokens_are_counted_before_they_are_shaped(spark):
    rows = [("Anil Rao called Anil Rao.",), ("anil X9-a",), ("",), (None,), ("'’ ÉLAN",)]
    found = tagger.feature_counts(spark.createDataFrame(rows * 3, "sentence string"))
    got = {(r.shape, r.ending, r.before): r.n for r in found.collect()}
    assert got == {
        ("Aa", "nil", "<s>"): 3, ("Aa", "rao", "anil"): 6, ("a", "led", "rao"): 3, ("Aa", "nil", "called"): 3, (".", ".", "rao"): 3,
        ("a", "nil", "<s>"): 3, ("A9-a", "9-a", "anil"): 3, ("'", "'", "<s>"): 3, ("’", "’", "'"): 3, ("A", "lan", "’"): 3}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[plan.index("\n", plan.rindex("Aggregate")):]


def test_equal_sentences_and_windows_are_tagged_once(spark, monkeypatch):
    draw = np.random.default_rng(7)
    model = tagger.Model(draw.normal(size=(tagger.SLOTS, len(tagger.TAGS))).astype(np.float32), draw.normal(size=(len(tagger.TAGS) + 1, len(tagger.TAGS))).astype(np.float32))
    texts = ["a", "b a", "a a a a a", "a b a b a b", "b b a c", "c", "a b", "c a b a"]
    own = [(t.split(), ["a"] * len(t.split())) for t in texts]
    plain = [np.array([model.weight[tagger._features(*s, j)].sum(axis=0) for j in range(len(s[0]))]) for s in own]
    known = {}
    assert np.allclose(model.gains(own, known), np.concatenate(plain), atol=1e-5) and len(known) < sum(map(len, plain))
    asked, features = [], tagger._features
    monkeypatch.setattr(tagger, "_features", lambda *place: asked.append(place) or features(*place))
    assert len(model.tag(own * 3, known)) == 24 and not asked
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id int, sentence string")
    got = sorted(map(tuple, tagger.tagged_mentions(table, model).collect()))
    assert got and [(i + 8, *rest) for i, *rest in got if i < 8] == [r for r in got if r[0] >= 8]
