"""Name resolution against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from threadloom.functions.scoring import name_score
from threadloom.operators import edits as ed, resolve as rs

FIRST = ["Rahul", "Rohan", "Anil", "R.", "A.", "RAHUL", "R.K.", "anil kumar", "Anil Kumar Dev Prasad"]
LAST = ["Sharma", "sharma", "Rao", "Kumar", "Rao Singh"]


def score(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 100.0
    x, y = set(a.split()), set(b.split())
    ratio = SequenceMatcher(None, a, b).ratio() * 100
    if not x or not y:
        return ratio
    return ratio * 0.4 + len(x & y) / max(len(x), len(y)) * 100 * 0.6


def initials_hit(name, known):
    """Names in ``known`` with the surname and the leading initials of ``name``."""
    tokens = name.replace(".", " ").split()
    if len(tokens) < 2:
        return []
    want = [t[0].lower() for t in tokens[:-1]]
    fits = []
    for other in known:
        parts = other.split()
        if len(parts) >= 2 and parts[-1].lower() == tokens[-1].lower():
            if [p[0].lower() for p in parts[:-1]][: len(want)] == want:
                fits.append(other)
    return fits


def one_by_one(name, known, threshold=85):
    if name in known:
        return name
    best = max(known, key=lambda k: score(name, k), default=None)
    if best is not None and score(name, best) >= threshold:
        return best
    fits = initials_hit(name, known)
    if len(fits) == 1:
        return fits[0]
    if len(name.split()) == 1:
        ends = [k for k in known if k.split() and k.split()[-1].lower() == name.lower()]
        if len(ends) == 1:
            return ends[0]
    return name


def list_order(names):
    return sorted(names, key=lambda n: (-len(n.split()), n))


def random_names(rng, n):
    return list({f"{rng.choice(FIRST)} {rng.choice(LAST)}" if rng.random() < 0.8 else rng.choice(LAST) for _ in range(n)})


def test_scores(spark):
    pairs = [("Rahul Sharma", "rahul sharma"), ("Rahul Sharma", "Sharma Rahul"), ("Anil Kumar Rao", "Rao Anil Kumar"),
             ("R. Sharma", "Rohan Sharma"), ("", "x")]
    table = spark.createDataFrame(pairs, "a string, b string")
    for row in table.select("a", "b", name_score(F.col("a"), F.col("b")).alias("s")).collect():
        assert row.s == pytest.approx(score(row.a, row.b))


@pytest.mark.parametrize("threshold", [60.0, 75.0, 85.0, 93.0])
def test_blocking_loses_nothing(spark, threshold):
    rng = random.Random(int(threshold))
    words = ["anil", "kumar", "rao", "dev", "lal", "ram", "das"]
    lows = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(90)})
    table = spark.createDataFrame([(w,) for w in lows], "low string")
    got = {(r.low_a, r.low_b): r.score for r in rs.similar_names(table, threshold).collect()}
    want = {(a, b): score(a, b) for a in lows for b in lows if a != b and score(a, b) >= threshold}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_threshold_bounds(spark):
    with pytest.raises(ValueError):
        rs.similar_names(spark.createDataFrame([("a",)], "low string"), 30.0)


def test_resolve_matches_brute_force(spark):
    rng = random.Random(3)
    known = {f"c{i}": random_names(rng, 6) for i in range(25)}
    asked = {c: random_names(rng, 8) for c in known}
    k = spark.createDataFrame([(c, n) for c, ns in known.items() for n in ns], "case_id string, known string")
    m = spark.createDataFrame([(c, n) for c, ns in asked.items() for n in ns], "case_id string, name string")
    got = {(r.case_id, r.raw_name): r.canonical_name for r in rs.resolve(m, k).collect()}
    want = {(c, n): one_by_one(n, list_order(known[c])) for c, ns in asked.items() for n in ns}
    assert got == want


def test_fold_matches_brute_force(spark):
    rng = random.Random(11)
    asked = {f"c{i}": random_names(rng, 12) for i in range(25)}
    known = {c: random_names(rng, 3) if i % 2 else [] for i, c in enumerate(asked)}
    m = spark.createDataFrame([(c, n) for c, ns in asked.items() for n in ns], "case_id string, name string")
    k = spark.createDataFrame([(c, n) for c, ns in known.items() for n in ns], "case_id string, known string")
    done, after = rs.resolve_and_insert(spark, m, k)
    want, grown = {}, {}
    for c, names in asked.items():
        people = list_order(known[c])
        for n in list_order(set(names)):
            want[c, n] = one_by_one(n, people)
            if want[c, n] not in people:
                people.append(want[c, n])
        grown[c] = set(people)
    assert {(r.case_id, r.raw_name): r.canonical_name for r in done.collect()} == want
    got = {}
    for r in after.collect():
        got.setdefault(r.case_id, set()).add(r.known)
    assert got == {c: p for c, p in grown.items() if p}


def test_cross_case_links(spark):
    rows = [("a", "Person", "Anil Kumar Rao"), ("b", "Person", "rao anil kumar"), ("b", "Person", "Anil Kumar Rao"), ("a", "Person", "ANIL KUMAR RAO"),
            ("a", "Phone", "1"), ("b", "Phone", "1"), ("c", "Phone", "1"), ("a", "Location", "x"), ("b", "Location", "x")]
    table = spark.createDataFrame(rows, "case_id string, label string, id string")
    links = rs.cross_case_links(table).collect()
    phones = {(r.case_a, r.case_b) for r in links if r.type == "Phone"}
    assert phones == {("a", "b"), ("a", "c"), ("b", "c")}
    people = sorted((c, i) for c, l, i in rows if l == "Person")
    want = {(x, y) for i, x in enumerate(people) for y in people[i + 1:] if x[0] != y[0] and score(x[1], y[1]) >= 85}
    assert {((r.case_a, r.id_a), (r.case_b, r.id_b)) for r in links if r.type == "Person"} == want
    assert rs.exact_links(table, ["a", "b"]).count() == 1
    assert rs.link_groups(table).first().link_count == 3


def test_merges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    rows = spark.sparkContext.parallelize([("c", "Person", f"n{i}", f"n{i + 1}") for i in range(5)], 2).map(counted)
    merges = spark.createDataFrame(rows, "case_id string, label string, keep_id string, merge_id string")
    got = {(r.keep_id, r.merge_id) for r in ed.collapse_merges(merges).collect()}
    assert got == {("n0", f"n{i + 1}") for i in range(5)} and seen.value == 5
