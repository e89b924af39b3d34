import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, fingerprints, minhash, oracle, pii

from . import cases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_decontamination_equals_sql_and_brute_force(spark):
    item = cases.prose(50, 25)
    texts = [f"{cases.prose(51, 9)} {item.upper()} tail", " ".join(item.split()[3:14]), " ".join(item.split()[:9]), "short item", "a short, Item!"]
    docs = cases.documents(spark, texts)
    items = spark.createDataFrame([(1, item, "x"), (2, "Short item", "x"), (2, "Short item", "x"), (3, None, "x"), (None, "tail", "x"), (10, item, "x")],
                                  "item_id long, text string, kind string")
    found = decontaminate.report(decontaminate.scan(docs, items))
    split = decontaminate.report(decontaminate.scan(docs, items, block_words=20))
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    assert key(found.collect()) == key(split.collect()) == key(con.sql(oracle.OP1).fetchall())
    assert key([(r.doc_id,) for r in found.filter("contaminated").collect()]) == key([(100,), (101,), (103,), (104,)])
    kept = decontaminate.remove_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert item.upper() in texts[0] and " ".join(item.upper().split()[2:8]) not in cut[100] and cut[100].endswith(" tail") and cut[1] is None
    assert decontaminate.scan(cases.empty(spark), items).count() == 0
    assert decontaminate.report(decontaminate.scan(docs, items.limit(0))).filter("contaminated").count() == 0


def components(sets, percent):
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: top(d) for d in sets}


def test_near_duplicates_equal_brute_force(spark):
    base = cases.prose(60, 200).split()
    chain = [" ".join(base[4 * i:4 * i + 120]) for i in range(12)]
    copies = [" ".join(base[:100]) + f" end{i}" for i in range(25)]
    docs = cases.documents(spark, [*chain, *copies, "two words", "TWO  words", "one"])
    for k in (2, 5):
        sets = {}
        for r in docs.filter("doc_id is not null").collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))
            sets[r.doc_id] = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
        want = components(sets, 80)
        rows = minhash.near_duplicates(docs, k, 80).collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and not r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = minhash.drop_duplicates(docs, 2)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == set(components_of(docs, 2).values())
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("tile_rows", [2048, 100])
def test_a_large_group_about_the_threshold_keeps_every_link(spark, tile_rows):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(600):
        words = list(base)
        for _ in range(draw.randrange(1, 5)):
            words[draw.randrange(60)] = f"x{draw.randrange(40)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {d: {(a, b) for a, b in zip(t.split(), t.split()[1:])} for d, t in texts.items()}
    want = components(sets, 85)
    assert 20 < len(set(want.values())) < 590
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2, 85, tile_rows).collect()}
    assert got == want


def test_set_sizes_by_products_equal_set_sizes_one_by_one():
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 400, draw.integers(0, 90))).astype(np.uint64) for _ in range(30)]
    sets = minhash._Sets(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows))
    left, right = np.arange(0, 12), np.arange(5, 30)
    for width in (7, 4096):
        got = sets.all_common(left, right, width)
        assert all(got[i, j] == len(np.intersect1d(rows[a], rows[b])) == sets.common(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if a != b)


def components_of(docs, k):
    return {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k, 80).collect() if r.doc_id is not None}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for rank, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data_base_and_bootstrap(spark):
    odd = "a@b.c_d@e.f x@y.z.,1.2.3.4.5 001.02.3.4 256.1.1.1 4111 1111 1111 1111 4111-1111-1111-11111 +1 (234) 567-8901. ++12345678901 é😀 a@b.co"
    seeds = [f"reach host 10.{i}.3.4 now" for i in range(120, 132)]
    docs = cases.documents(spark, [odd, "1" * 3000 + "@" + "+1" * 500, *seeds, "reach host 99.999.3.4 now", "other 99.999.3.4x text"])
    rows = {(r.doc_id, r.text or "") for r in docs.collect()}
    text = dict(rows)
    found = pii.find(docs).collect()
    assert len(found) == docs.count()
    added = {}
    for r in found:
        base = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        more = set(r.spans.split(",")) - set(base.split(","))
        if more:
            added[r.doc_id] = more
    assert added == {100 + 2 + len(seeds): {"ip:11:21"}}
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert len(masked) == len({d for d, _ in rows}) and masked[102].text == "reach host <IP> now" and masked[102].n_chars == 19
    assert masked[100 + 2 + len(seeds)].text == "reach host <IP> now" and masked[1].text is None
    assert pii.find(cases.empty(spark)).count() == 0


def test_personal_data_learns_from_whole_spans(spark):
    letters = "abcdefgh"
    texts = [f"call +1 (017) 555-771{i} today" for i in range(8)] + [f"mail {c}x@{c}y.example today" for c in letters]
    texts += [f"10:0{i}:00 10.{120 + i}.3.4 seen" for i in range(8)]
    card = lambda i: next(d for d in (f"4111 1111 11{i}1 111{k}" for k in range(10)) if luhn(d.replace(" ", "")))
    texts += [f"card {card(i)} used" for i in range(8)]
    new = {"call +1 (017) 555-7719 123456 now": "phone:5:22", "mail j\u00f6rg@b\u00fccher.example now": "email:5:24",
           "11:22:33 99.999.3.4 seen": "ip:9:19", "card 4111 1111 1121 1110 2024 2025 used": "card:5:24"}
    docs = cases.documents(spark, [*texts, *new])
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert [found[100 + len(texts) + i] for i in range(len(new))] == list(new.values())
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[100 + len(texts)] == "call <PHONE> 123456 now"


def spots(text):
    words = re.findall(r"[^\W_]+", text.lower())
    runs, run = [], []
    for w in [*words, None]:
        if w is None or w in fingerprints.ANCHORS:
            runs.append(run)
            run = []
        else:
            run.append(w)
    first, *rest = runs
    runs = [first, *[r for i, r in enumerate(rest) if r or i == len(rest) - 1]]
    out = set()
    for i in range(1, len(runs)):
        out.add(" ".join([w for r in runs[i:i + 3] for w in r][:3]))
    for r in runs:
        if len(r) > fingerprints.LONG:
            out |= {" ".join(r[j:j + 3]) for j in range(len(r) - 2)}
    return out - {""} or ({text} if text else set())


def test_fingerprints_and_next_documents(spark):
    texts = [cases.prose(i, 30 + 20 * i) for i in range(14)] + ["plain content words only " * 20, "the of and"]
    docs = cases.documents(spark, texts)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    got = {}
    for r in fingerprints.compare(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    like = lambda a, b: (len(a & b) / len(a | b)) if a | b else 1.0
    by_text = {}
    for i, (some, doc, text) in enumerate(rows):
        follows = rows[(i + 1) % len(rows)][2]
        k = len(text) // 4
        changed = text[: len(text) - k] + follows[:k]
        r = next(x for x in got[doc if some else None] if x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest())
        assert r.n_chars == len(text)
        assert abs(r.near_next - like(spots(text), spots(follows))) < 1e-9, doc
        assert abs(r.near_edited - like(spots(text), spots(changed))) < 1e-9, doc
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert fingerprints.compare(cases.empty(spark)).count() == 0
    pairs = {(r.a, r.b) for r in fingerprints.near_pairs(docs.unionByName(docs.filter("doc_id = 110").selectExpr(
        "999 doc_id", "concat(text, ' the market closed today') text", "lang", "source", "n_chars", "score", "kind")), 0.8).collect()}
    assert (110, 999) in pairs


def test_near_pairs_equal_brute_force(spark):
    draw = random.Random(11)
    base = cases.prose(300, 400).split()
    texts = []
    for _ in range(40):
        words = base[: draw.randrange(120, 400)]
        for _ in range(draw.randrange(0, 12)):
            words[draw.randrange(len(words))] = f"word{draw.randrange(50)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = {i: spots(t) for i, t in enumerate(texts)}
    first = {}
    for i in own:
        first.setdefault(frozenset(own[i]), i)
    for floor in (0.5, 0.8, 1.0):
        want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in combinations(sorted(first.values()), 2)}
        want = {pair: like for pair, like in want.items() if like >= floor}
        got = fingerprints.near_pairs(docs, floor).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.likeness for r in got} == want
        assert floor > 0.6 or len(want) > 20


def test_running_sums_and_maxima(spark):
    rows = [(n, [(7 * i) % 11 - 3 for i in range(n)]) for n in (0, 1, 31, 32, 33, 500, 3_000)]
    df = spark.createDataFrame(rows, "n int, xs array<int>")
    got = df.select("n", "xs", pii.running(F.col("xs"), lambda x: x, lambda a, b: a + b, 0).alias("sums"),
                    pii.running(F.col("xs"), lambda x: x * 2, F.greatest, -100).alias("most")).collect()
    for r in got:
        assert r.sums == [sum(r.xs[:i]) for i in range(r.n)]
        assert r.most == [max([-100, *(2 * x for x in r.xs[:i])]) for i in range(r.n)]


def test_personal_data_of_texts_with_very_many_spans(spark):
    """200 kB and more with a span every few characters: same spans, same masking (quadratic steps would not end)."""
    numbers = " ".join(f"{i}" for i in range(20_000, 24_000))
    mails = " ".join(f"a{i}@b{i}.example" for i in range(2_000)) + " é😀 end"
    phones = "é" + "+1 234 567 8901, x" * 1_500
    docs = spark.createDataFrame([(1, numbers), (2, mails), (3, phones), (4, "z" * 300_000 + " a@b.co z")], "doc_id long, text string")
    text = {r.doc_id: r.text for r in docs.collect()}
    found = docs.withColumn("base", pii.base_spans("text")).withColumn("masked", pii.masked("text", "base")).collect()
    for r in found:
        assert ",".join(f"{x.kind}:{x.start}:{x.stop}" for x in r.base) == base_spans(text[r.doc_id])
    masked = {r.doc_id: r.masked for r in found}
    assert masked[2] == " ".join(["<EMAIL>"] * 2_000) + " é😀 end" and masked[4] == "z" * 300_000 + " <EMAIL> z"
    assert masked[3] == "é" + "<PHONE>, x" * 1_500
