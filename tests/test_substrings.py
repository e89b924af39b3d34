import random

import pytest

from threadloom.operators import relate as rl
from threadloom.operators.substrings import held_values

PATHS = [{}, {"near_bytes": 0}, {"near_bytes": 0, "block": 3, "share": 2}]


@pytest.mark.parametrize("how", PATHS)
def test_overlapping_values_match_brute_force(spark, how):
    draw = random.Random(7)
    make = lambda n: "".join(draw.choice("abé😀 ") for _ in range(n))
    texts = [(draw.choice("xyz"), i, make(draw.randrange(0, 40))) for i in range(120)] + [("x", 500, None), (None, 501, "ab"), ("q", 502, "ab")]
    values = [(draw.choice("xy"), make(draw.randrange(1, 5)), draw.choice("PQ")) for _ in range(150)]
    odd = [("x", "", "P"), ("x", None, "P"), (None, "ab", "P"), ("z", "never there", None), ("x", values[0][1], None)]
    rows = spark.createDataFrame(texts, "case_id string, no int, body_text string")
    table = spark.createDataFrame(values + odd + values[:9], "group string, value string, tag string")
    got = [tuple(r) for r in held_values(rows, table, "case_id", "body_text", **how).select("no", "case_id", "value", "tag").collect()]
    want = {(no, c, v, tag) for c, no, text in texts for g, v, tag in values + odd if c and c == g and v and text is not None and v in text}
    assert len(got) == len(want) and set(got) == want
    assert held_values(rows.limit(0), table, "case_id", "body_text", **how).count() == 0
    assert held_values(rows, table.limit(0), "case_id", "body_text", **how).count() == 0


@pytest.mark.parametrize("how", [{"near_bytes": 1 << 30}, {"near_bytes": 0, "block": 20_000, "share": 500}])
def test_a_case_of_many_values(spark, how):
    values = spark.range(100_000).selectExpr("'big' AS group", "concat('9', lpad(id * 7919 % 1000000007, 9, '0')) AS value", "'Phone' AS tag")
    rows = spark.range(2_000).selectExpr(
        "'big' AS case_id", "id AS no", "concat('rang 9', lpad(id * 50 * 7919 % 1000000007, 9, '0'), ' twice, then 9', lpad(id, 9, '5')) AS sentence")
    got = held_values(rows, values, "case_id", "sentence", **how)
    want = rows.selectExpr("no", "explode(regexp_extract_all(sentence, '9[0-9]{9}', 0)) AS value").join(values, "value", "left_semi").select("no", "value")
    assert sorted(map(tuple, got.select("no", "value").collect())) == sorted(map(tuple, want.distinct().collect()))
    assert got.filter("tag = 'Phone'").count() >= 2_000


def test_sentences_stay_where_they_are(spark):
    """Below the bound the only shuffle is that of the hits."""
    sentences = spark.createDataFrame([("x", "d", 0, "P12 and P13")], "case_id string, doc_id string, sent_no int, sentence string")
    values = spark.createDataFrame([("x", "Phone", "P12"), ("x", "Vehicle", "P12"), ("y", "Phone", "P13")], "case_id string, label string, value string")
    held = rl.sentences_holding(sentences, values)
    assert sorted((r.label, r.value) for r in held.collect()) == [("Phone", "P12"), ("Vehicle", "P12")]
    plan = held.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "sentence" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
