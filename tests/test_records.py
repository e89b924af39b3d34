"""Skew helpers, upserts, edits, audit chain, ingest, store and streams."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions.chain import json_object, json_string
from threadloom.operators import audit as au, edits as ed, mentions as mn, relate as rl, skew, upsert as up
from threadloom.operators.cutting import Workspace
from threadloom.operators.ingest import ingest_reports
from threadloom.plans import catalog_text
from threadloom.sources import delimited as dl
from threadloom.sources.store import CaseStore
from threadloom.streaming import calls as sc, chained
from threadloom.streaming.audit import AuditStream
from threadloom.streaming.chained import ChainedStream
from threadloom.streaming.reports import ReportStream

EDGE = "src_case string, src_label string, src_id string, rel string, dst_case string, dst_label string, dst_id string, confidence double"


def edge_table(spark, rows):
    table = spark.createDataFrame([(a, "Person", b, r, c, "Person", d, w) for a, b, r, c, d, w in rows], EDGE)
    for name in ("source_sentence", "last_timestamp", "last_duration"):
        table = table.withColumn(name, F.lit(None).cast("string"))
    return table


def people(spark, keys):
    return up.entity_rows(spark.createDataFrame([(c, "Person", i) for c, i in keys], "case_id string, label string, id string"), "test")


def as_dict(edges):
    return {(r.src_case, r.src_id, r.rel, r.dst_case, r.dst_id): r.confidence for r in edges.collect()}


def test_hot_keys_are_split_exactly(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 3}", i, rng.randint(1, 9)) for i in range(200)]
    table = spark.createDataFrame(rows, "k string, m int, v int")
    pairs = {(r.k, r.m_a, r.m_b) for r in skew.tiled_pairs(table, ["k"], "m", chunk=7).collect()}
    assert pairs == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    sums = skew.salted_running_sum(table, ["k"], "m", "v", "before", chunk=9).collect()
    for key in {r[0] for r in rows}:
        spans = sorted((r.before, r.before + r.v) for r in sums if r.k == key)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    numbered = skew.bucketed_row_number(table, ["k"], F.floor(F.col("m") / 10), ["m"], "n")
    for key in {r[0] for r in rows}:
        got = [r.m for r in sorted((r for r in numbered.collect() if r.k == key), key=lambda r: r.n)]
        assert got == sorted(r[1] for r in rows if r[0] == key)
    gapped = table.filter("m % 7 <> 3 AND (m < 50 OR m > 120)")
    lagged = {(r.k, r.m): r.p for r in skew.bucketed_lag(gapped, "k", "m", "m", "p", width=10).collect()}
    for (key, m), before in lagged.items():
        assert before == max((x for k, x in lagged if k == key and x < m), default=None)


def test_merge_keeps_confidence_and_drops_self(spark):
    ents = people(spark, [("c", x) for x in "abkm"] + [("d", "z")])
    edges = edge_table(spark, [("c", "m", "R", "c", "a", 2.0), ("c", "k", "R", "c", "a", 3.0), ("c", "b", "R", "c", "m", None),
                               ("c", "m", "R", "c", "k", 5.0), ("c", "m", "R", "d", "z", 4.0), ("c", "a", "S", "c", "b", None)])
    merge = spark.createDataFrame([("c", "Person", "k", "m")], "case_id string, label string, keep_id string, merge_id string")
    left, moved = ed.merge_entities(ents, edges, merge)
    assert as_dict(moved) == {("c", "k", "R", "c", "a"): 5.0, ("c", "b", "R", "c", "k"): 1.0, ("c", "a", "S", "c", "b"): None}
    assert left.count() == 4
    _, kept = ed.merge_entities(ents, edges, merge, keep_cross_case=True)
    assert as_dict(kept)["c", "k", "R", "d", "z"] == 4.0
    reasons = ed.check_merged(merge.union(spark.createDataFrame([("c", "Person", "k", "k"), ("c", "Ghost", "k", "m"), ("c", "Person", "k", "nobody")], merge.schema)), ents)
    assert sorted(r.reason or "" for r in reasons.collect()) == ["", "not found", "self-merge", "unknown label"]


def test_merge_chains_end_at_the_last_target(spark):
    merges = spark.createDataFrame([("c", "Person", "b", "a"), ("c", "Person", "z", "b"), ("d", "Person", "q", "p")],
                                   "case_id string, label string, keep_id string, merge_id string")
    got = {(r.case_id, r.merge_id, r.keep_id) for r in ed.collapse_merges(merges).collect()}
    assert got == {("c", "a", "z"), ("c", "b", "z"), ("d", "p", "q")}


def test_rename_relationship_overwrites(spark):
    edges = edge_table(spark, [("c", "a", "OLD", "c", "b", 7.0), ("c", "a", "NEW", "c", "b", 2.0), ("c", "b", "OLD", "c", "a", None)])
    edits = edges.select(*schema.EDGE_KEY).filter("rel = 'OLD'").withColumn("new_rel", F.lit("new"))
    assert as_dict(ed.rename_relationships(edges, edits)) == {("c", "a", "NEW", "c", "b"): 7.0, ("c", "b", "NEW", "c", "a"): 1.0}


def test_upserts(spark):
    ents = people(spark, [("c", "a"), ("c", "b")])
    old = edge_table(spark, [("c", "a", "R", "c", "b", 2.0)])
    new = edge_table(spark, [("c", "a", "R", "c", "b", 1.0), ("c", "a", "R", "c", "ghost", 1.0)])
    assert as_dict(up.add_edges(old, new, ents)) == {("c", "a", "R", "c", "b"): 3.0}
    rows = new.withColumn("ord", F.lit(1)).union(new.withColumn("confidence", F.lit(0.0)).withColumn("ord", F.lit(2)))
    assert [r.confidence for r in up.replace_edges(rows, ents).collect()] == [1.0]


def test_json_text_matches_python(spark):
    odd = ['plain', 'quo"te', 'back\\slash', 'né ü', 'tab\there', 'emoji \U0001f600', 'del\x7f', 'ctl\x01', None]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string")
    got = [r[0] for r in table.orderBy("i").select(json_object(b=json_string(F.col("s")), a=F.lit("1"))).collect()]
    assert got == [json.dumps({"a": 1, "b": s}, sort_keys=True) for s in odd]


def chain_events(spark, n=40):
    rows = [(f"c{i % 3}", f"t{i:03d}", "ADD", json.dumps({"id": f"n{i}", "type": "Phone"}, sort_keys=True), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "case_id string, ts string, action string, details string, n int")


def test_chain_parity_and_tampering(spark):
    rows, events = chain_events(spark)
    empty = spark.createDataFrame([], schema.AUDIT)
    first = au.append(empty, events.filter("n < 25"), ["n"])
    chain = first.unionByName(au.append(first, events.filter("n >= 25"), ["n"]))
    want = {}
    for case, ts, action, details, _ in rows:
        seq, before = want.get(case, (-1, "GENESIS"))[0] + 1, want.get(case, (-1, "GENESIS"))[1]
        payload = json.dumps({"timestamp": ts, "action": action, "details": json.loads(details)}, sort_keys=True) + before
        want[case] = (seq, hashlib.sha256(payload.encode()).hexdigest())
    got = {r.case_id: (r.tip_seq, r.tip_hash) for r in au.tips(chain).collect()}
    assert got == want
    assert all(r.valid for r in au.verify(chain).collect())
    bad = chain.withColumn("details", F.when((F.col("case_id") == "c1") & (F.col("seq") == 4), F.lit("{}")).otherwise(F.col("details")))
    cases = spark.createDataFrame([("c0",), ("c1",), ("c9",)], "case_id string")
    assert {(r.case_id, r.valid, r.broken_seq) for r in au.verify(bad, cases).collect()} == {("c0", True, None), ("c1", False, 4), ("c9", True, None)}
    holed = chain.filter("seq <> 5")
    assert {r.broken_seq for r in au.verify(holed).collect()} == {6}
    assert {r.broken_seq for r in au.verify(chain.filter("seq > 0"), check_gaps=True).collect()} == {1}


def test_seed_shaped_report(spark):
    text = ("On 14 September, Mahesh Joshi was seen at Surat Bus Stand before wiring funds to Kiran Desai. Mahesh Joshi contacted Kiran Desai. "
            "Mahesh Joshi transferred Rs. 55,000 to Kiran Desai via UPI. Mahesh Joshi, who owns car GJ05AB1234, left. "
            "Mahesh Joshi uses phone 9012345678. Kiran Desai uses phone 9321876543. Malabar Traders arranged it with Kiran Desai.")
    docs = spark.createDataFrame([("c", "1", text)], "case_id string, doc_id string, text string")
    names = spark.createDataFrame([("Mahesh Joshi",), ("Kiran Desai",)], "name string")
    towns = spark.createDataFrame([("Surat Bus Stand",)], "name string")
    done = ingest_reports(docs, names, towns, fold_aliases=True)
    assert {(r.label, r.id) for r in done.entities.collect()} == {
        ("Person", "Mahesh Joshi"), ("Person", "Kiran Desai"), ("Location", "Surat Bus Stand"), ("Vehicle", "GJ05AB1234"),
        ("Phone", "9012345678"), ("Phone", "9321876543"), ("Organization", "Malabar Traders")}
    got = {(r.rel, r.src_id, r.dst_id): r.confidence for r in done.edges().collect()}
    pair = ("Kiran Desai", "Mahesh Joshi")
    assert got == {
        ("SPOTTED_AT", "Mahesh Joshi", "Surat Bus Stand"): 1, ("SPOTTED_AT", "Kiran Desai", "Surat Bus Stand"): 1,
        ("CDR_LINK", *pair): 1, ("FINANCIAL_TRAIL", *pair): 1, ("OWNS_VEHICLE", "Mahesh Joshi", "GJ05AB1234"): 1,
        ("USES_DEVICE", "Mahesh Joshi", "9012345678"): 1, ("USES_DEVICE", "Kiran Desai", "9321876543"): 1,
        ("ASSOCIATED_WITH", "Kiran Desai", "Malabar Traders"): 1}
    turned = {(r.rel, r.src_id, r.dst_id) for r in done.edges(direction="mention_order").collect()}
    assert ("FINANCIAL_TRAIL", "Mahesh Joshi", "Kiran Desai") in turned


def test_substring_join_matches_brute_force(spark):
    texts = ["+91-9876543210 rang", "98765432101234", "plate KA05MH1234x", "see P12 and Om Sai", "year 2025 only", "a b", "xAcme Cox"]
    values = ["9876543210", "KA05MH1234", "P12", "Acme Co", "b", "20251", "Om Sai", "43210"]
    s = spark.createDataFrame([(c, "d", i, t) for c in "xy" for i, t in enumerate(texts)], "case_id string, doc_id string, sent_no int, sentence string")
    v = spark.createDataFrame([("x", "Phone", w) for w in values] + [("y", "Phone", "P12")], "case_id string, label string, value string")
    got = {(r.case_id, r.sent_no, r.value) for r in rl.sentences_holding(s, v).collect()}
    want = {("x", i, w) for i, t in enumerate(texts) for w in values if w in t} | {("y", 3, "P12")}
    assert got == want


def test_store_replaces_only_given_cases(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "store"))
    assert store.read("entities").count() == 0
    store.append("entities", people(spark, [("a", "1"), ("b", "2")]))
    store.replace_cases("entities", people(spark, [("a", "9")]))
    assert {(r.case_id, r.id) for r in store.read("entities").collect()} == {("a", "9"), ("b", "2")}


def test_store_forgets_emptied_cases(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "store"))
    many = [(f"c{i}", str(i)) for i in range(200)]
    store.append("entities", people(spark, many))
    gone = spark.createDataFrame([("c0",), ("c7",)], "case_id string")
    store.replace_cases("entities", people(spark, [("c1", "new")]), gone)
    want = {(c, i) for c, i in many if c not in ("c0", "c1", "c7")} | {("c1", "new")}
    assert {(r.case_id, r.id) for r in store.read("entities").collect()} == want
    single = CaseStore(spark, str(tmp_path / "single"))
    single.append("entities", people(spark, [("k", "1")]))
    single.replace_cases("entities", people(spark, [("k", "1")]).limit(0), spark.createDataFrame([("k",)], "case_id string"))
    assert single.read("entities").count() == 0


def one_at_a_time(ids, edges, steps):
    """Edits replayed singly: steps are (from, to, is_rename)."""
    for src, dst, rename in steps:
        if src == dst or src not in ids or not (rename or dst in ids):
            continue
        merge, after = dst in ids, {}
        for (a, rel, b), n in edges.items():
            if src not in (a, b):
                after[a, rel, b] = after.get((a, rel, b), 0) + n
        for (a, rel, b), n in edges.items():
            if src in (a, b):
                x, y = (dst if a == src else a), (dst if b == src else b)
                if not (merge and x == y):
                    after[x, rel, y] = after.get((x, rel, y), 0) + n
        ids, edges = (ids - {src}) | {dst}, after
    return ids, edges


def test_edit_batches_equal_one_edit_at_a_time(spark):
    draw = random.Random(5)
    cases = {}
    for case in range(25):
        ids = set("abcdefg")
        edges = {(a, draw.choice("RS"), b): float(draw.randint(1, 9)) for a, b in [draw.sample(sorted(ids), 2) for _ in range(9)]}
        rename = case % 2 == 0
        steps = [(draw.choice("abcdefg"), draw.choice("abcdefgXY"), rename) for _ in range(5)]
        cases[f"c{case}"] = (ids, edges, steps, rename)
    ents = people(spark, [(c, i) for c, (ids, *_) in cases.items() for i in ids])
    table = edge_table(spark, [(c, a, r, c, b, n) for c, (_, edges, *_) in cases.items() for (a, r, b), n in edges.items()])
    for rename, names in ((True, ["old_id", "new_id"]), (False, ["merge_id", "keep_id"])):
        own = {c: x for c, x in cases.items() if x[3] == rename}
        edits = spark.createDataFrame([(c, "Person", i, a, b) for c, (_, _, steps, _) in own.items() for i, (a, b, _) in enumerate(steps)],
                                      f"case_id string, label string, ord long, {names[0]} string, {names[1]} string")
        act = ed.rename_entities if rename else ed.merge_entities
        left, moved = act(ents, table, edits)
        got_ids, got_edges = {(r.case_id, r.id) for r in left.collect()}, {}
        for r in moved.collect():
            assert (r.src_case, r.src_id, r.rel, r.dst_id) not in got_edges
            got_edges[r.src_case, r.src_id, r.rel, r.dst_id] = r.confidence
        for c, (ids, edges, steps, _) in own.items():
            want_ids, want_edges = one_at_a_time(set(ids), dict(edges), steps)
            assert {i for k, i in got_ids if k == c} == want_ids, (c, steps)
            assert {k[1:]: n for k, n in got_edges.items() if k[0] == c} == want_edges, (c, steps)


def test_clear_and_delete_cases(spark):
    tables = {"entities": people(spark, [("a", "1"), ("b", "2")]), "edges": edge_table(spark, [("b", "2", "R", "a", "1", 1.0), ("b", "2", "R", "b", "2", 1.0)]),
              "audit": spark.createDataFrame([("a",), ("b",)], "case_id string"), "cases": spark.createDataFrame([("a",), ("b",)], "case_id string")}
    left = up.delete_cases(tables, spark.createDataFrame([("a",)], "case_id string"))
    assert {k: t.count() for k, t in left.items()} == {"entities": 1, "edges": 1, "audit": 1, "cases": 1}


def test_streams_equal_batch(spark, tmp_path):
    rows = [("c", i, f"P{i % 3}", f"P{i % 2}", f"t{i:02d}" if i % 4 else "", "5") for i in range(30)]
    calls = spark.createDataFrame(rows, "case_id string, row_no bigint, caller string, called string, ts_raw string, duration_raw string")
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sc.write_partials(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, sc.read_edges(spark, str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, rl.intercepted_calls(calls).collect()), key=str)
    query = (sc.running_edges(stream.withColumn("ts", F.timestamp_seconds(F.col("row_no") + 1_700_000_000)))
             .writeStream.format("memory").queryName("running").outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "cp2")).start())
    query.awaitTermination()
    best = spark.table("running").groupBy("caller", "called").agg(F.max("confidence").alias("n"))
    assert {(r.caller, r.called): r.n for r in best.collect()} == {(r.src_id, r.dst_id): r.confidence for r in rl.intercepted_calls(calls).collect()}


def test_audit_stream_continues_chains(spark, tmp_path):
    _, events = chain_events(spark)
    events.repartitionByRange(3, "n").sortWithinPartitions("n").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = AuditStream(spark, str(tmp_path / "chain"), ["n"])
    stream.start(source, str(tmp_path / "cp")).awaitTermination()
    assert stream.rows().count() == 40
    assert all(r.valid for r in au.verify(stream.rows(), check_prev_hash=True, check_gaps=True).collect())


def test_keyed_audit_stream_equals_batch_over_restarts_and_a_repeated_batch(spark, tmp_path):
    _, events = chain_events(spark)
    parts = [r.n for r in events.select("n").orderBy("n").collect()]
    cuts = [parts[0], parts[len(parts) // 3], parts[2 * len(parts) // 3], parts[-1] + 1]
    stream = ChainedStream(spark, str(tmp_path / "chained"), ["n"])

    def run():
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.start(source).awaitTermination()

    provider = spark.conf.get(chained.PROVIDER)
    for low, high in zip(cuts, cuts[1:]):  # each run is a restart from the checkpoint
        events.filter((F.col("n") >= low) & (F.col("n") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert spark.conf.get(chained.PROVIDER) == provider
    none = spark.createDataFrame([], schema.AUDIT)
    want = sorted(map(tuple, au.append(none, events, ["n"]).collect()))
    assert sorted(map(tuple, stream.rows().collect())) == want
    commits = sorted((tmp_path / "chained" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for crc in (tmp_path / "chained" / "checkpoint" / "commits").glob(".*.crc"):
        crc.unlink()
    commits[-1].unlink()  # the last batch was not committed: it runs again
    run()
    assert sorted(map(tuple, stream.rows().collect())) == want


def test_report_stream_resolves_against_stored(spark, tmp_path):
    docs = spark.createDataFrame([("c", "1", "Anil Rao called Ravi Das from 9012345678."), ("c", "2", "Ravi Das called Anil Rao.")],
                                 "case_id string, doc_id string, text string")
    docs.repartitionByRange(2, "doc_id").write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([("Anil Rao",), ("Ravi Das",)], "name string")
    stream = ReportStream(spark, str(tmp_path / "store"), names, spark.createDataFrame([("Goa",)], "name string"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "cp")).awaitTermination()
    assert {r.id for r in stream.entities().collect()} == {"Anil Rao", "Ravi Das", "9012345678"}
    assert {(r.rel, r.confidence) for r in stream.edges().collect() if r.dst_label == "Person"} == {("CDR_LINK", 2.0)}


def test_a_batch_of_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from threadloom.streaming import reports

    tasks, ingest = [], reports.ingest_reports
    monkeypatch.setattr(reports, "ingest_reports", lambda docs, *rest: tasks.append(docs.rdd.getNumPartitions()) or ingest(docs, *rest))
    docs = spark.createDataFrame([("c", "1", "Anil Rao left."), ("c", "2", "Anil Rao came.")], "case_id string, doc_id string, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([("Anil Rao",)], "name string")
    stream = ReportStream(spark, str(tmp_path / "store"), names, spark.createDataFrame([("Goa",)], "name string"))
    stream.start(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert tasks == [spark.sparkContext.defaultParallelism] and tasks[0] > 1
    assert {r.id for r in stream.entities().collect()} == {"Anil Rao"}


@pytest.mark.parametrize("name", ["src3", "fmt4", "ext2", "res4", "rel11", "view11", "edit2", "edit4", "aud4", "gr8", "res8", "ext3_list"])
def test_registered_queries_match_sql(spark, name):
    import duckdb

    from threadloom.plans import registry
    from threadloom.plans.domain import Domain

    root = "/root/testdata/sf0.001"
    run, sql = registry.entries()[name]
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    frame = run(Domain(spark, root))
    columns = sorted(frame.columns)
    cursor = con.execute(sql)
    at = [[c[0] for c in cursor.description].index(c) for c in columns]

    def plain(row):
        return tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in row)

    want = sorted(plain([r[i] for i in at]) for r in cursor.fetchall())
    assert sorted(plain(r) for r in frame.select(*columns).collect()) == want


def test_submitted_call_tables_stay_bounded_and_whole(spark):
    rows = [("a", i, f"P{i}", "P0", "2024-01-01", "5") for i in range(1, 2501)] + [("b", 7, "P1", "P2", "2024-01-01", "5")]
    calls = spark.createDataFrame(rows, "case_id string, row_no long, caller string, called string, ts_raw string, duration_raw string")
    tables = catalog_text._call_tables(calls)
    assert max(r.text.count("\n") for r in tables.collect()) == 1000
    routed, loose = dl.route_documents(tables)
    assert loose.count() == 0
    found = dl.call_rows(routed.select("case_id", "doc_id", "text")).select("case_id", "caller", "called").collect()
    assert sorted(map(tuple, found)) == sorted((c, a, b) for c, _, a, b, *_ in rows)


def test_append_keeps_a_case_together_when_tips_are_joined_by_shuffle(spark):
    """With many tips the join is planned as a shuffle and turned into a broadcast at run time, which reads shuffles locally."""
    events = spark.range(0, 4000, 1, 6).selectExpr(
        "cast(id % 7 as string) AS case_id", "lpad(cast(id as string), 6, '0') AS ts", "'view' AS action", "'{}' AS details")
    whole = au.append(spark.createDataFrame([], schema.AUDIT), events, ["ts"])
    want = {(r.case_id, r.seq): r.hash for r in whole.collect()}
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions",
             "spark.sql.adaptive.coalescePartitions.enabled")
    old = {k: spark.conf.get(k, None) for k in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        first = Workspace(spark, "audit").cut(au.append(spark.createDataFrame([], schema.AUDIT), events.filter("ts < '001000'"), ["ts"]), "first")
        second = au.append(first, events.filter("ts >= '001000'"), ["ts"]).collect()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    got = [((r.case_id, r.seq), r.hash) for r in [*first.collect(), *second]]
    assert len(got) == 4000 and dict(got) == want


def test_report_lines_are_shuffled_once_and_dealt_in_proportion(spark, monkeypatch):
    """With buyers and parts beyond a broadcast, only the order key moves the lines; more lines, more tasks."""
    from threadloom.plans import domain

    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "10k")
    try:
        plain = domain.Domain(spark, "/root/testdata/sf0.01").report_parts
        assert "hashpartitioning(l_suppkey" not in plain._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(domain, "ROWS_A_TASK", 5_000)
        many = domain.Domain(spark, "/root/testdata/sf0.01")
        assert many.line_tasks == 12 and many.report_parts.rdd.getNumPartitions() >= 12
        trade = many.trade
        assert "REPARTITION_BY_NUM" in trade._jdf.queryExecution().executedPlan().toString()
        assert many.report_parts.count() == plain.count() and many.report_parts.exceptAll(plain).isEmpty()
    finally:
        spark.conf.set(key, old)


def test_dictionary_of_few_names_out_of_a_large_table_is_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "500k")
    try:
        names = spark.range(200_000).select(F.concat(F.lit("Anil Rao"), F.col("id") % 5).alias("name"))
        docs = spark.createDataFrame([("a", "Anil Rao3 met Anil Rao9's son.")], "doc_id string, sentence string")
        found = mn.dictionary_mentions(docs, names)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert [r["name"] for r in found.collect()] == ["Anil Rao3"]
    finally:
        spark.conf.set(key, old)


def test_lines_are_cut_once_for_the_route(spark, tmp_path):
    rows = [("a", "1", "x,y\n1,2"), ("a", "2", "x,y\n1;2"), ("a", "3", "x;y,z\n \n1;2,3"), ("a", "4", None), ("a", "5", ""), ("a", "6", "x|y"), ("a", "7", "no\n1,2")]
    spark.createDataFrame(rows, "case_id string, doc_id string, text string").write.parquet(f"{tmp_path}/docs")
    tables, prose = dl.route_documents(spark.read.parquet(f"{tmp_path}/docs"))
    assert {(r.doc_id, r.delimiter) for r in tables.collect()} == {("1", ","), ("3", ",")}
    assert {r.doc_id for r in prose.collect()} == {"2", "4", "5", "6", "7"}
    for part in (tables, prose):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
