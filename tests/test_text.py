"""Text and table functions against plain Python on small inputs."""

import random
import re

from pyspark.sql import functions as F

from threadloom import rules
from threadloom.functions import tabular, text as tx
from threadloom.operators import mentions as mn
from threadloom.sources import delimited as dl

SAMPLES = [
    "Call +91 9876543210 or +91-98765-43210, 022-12345678, 9012345678.",
    "KA-05-MH-1234 KA05MH1234 KA 05 MH 1234 22 BH 1234 AB ka05mh1234",
    "no digits at all", "", "é9876543210 and ९८७६५४३२१०", "012-345678 12-9876543210", "x1234567890y 1234567890",
    "Om Sai Finance Corp and Malabar Traders met.", "AB123456 pays 12345678 sent", "A" * 50 + " 5555555555 " + "b" * 50,
]


def column(spark, expr, rows=SAMPLES):
    table = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, text string")
    return [r[0] for r in table.select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def test_patterns_match_python_classes(spark):
    got = column(spark, tx.phone_mentions(F.col("text")))
    for sample, found in zip(SAMPLES, got):
        want = {m.strip() for p in rules.PHONE_PATTERNS for m in re.findall(p, sample) if len(re.sub(r"\D", "", m)) >= 10}
        assert set(found) == want and len(found) == len(want), sample
    got = column(spark, tx.plate_mentions(F.col("text")))
    for sample, found in zip(SAMPLES, got):
        assert set(found) == {m for p in rules.PLATE_PATTERNS for m in re.findall(p, sample)}
    got = column(spark, tx.plate_mentions_wide(F.col("text")))
    for sample, found in zip(SAMPLES, got):
        assert set(found) == {m.strip().upper() for p in rules.PLATE_PATTERNS_WIDE for m in re.findall(p, sample, re.I)}
    got = column(spark, tx.account_mentions(F.col("text")))
    for sample, found in zip(SAMPLES, got):
        assert set(found) == {m for p in rules.ACCOUNT_PATTERNS for m in re.findall(p, sample, re.I)}


def _pieced_texts(n=600):
    """Texts of pieces that make, cut short or join numbers and plates, in and out of ASCII."""
    draw = random.Random(7)
    pieces = ["KA05MH1234", "ka 05 mh 1234", "KA-05-MH-1234", "22 BH 1234 AB", "ABC 123", "123abc", "a1b", "AB12345", "12345678", "AB123456",
              "+91 98765-43210", "+91-9876543210", "022-12345678", "12-9876543210", "(022) 555-1234", "022-555-1234", "+1 5551234567", "0",
              "7", "12", "1234", "K", "xy", "XYZ", "word", "longer words, and more of them. ", "é", "ſ", "\u212a", "\u0301", "९८७६", "_", "-", " ", " ",
              "\n", "\u00a0", "\u0001", ".", "+", "(", "日本語", "\U0001d7d8"]
    return ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 25))) for _ in range(n)]


def test_searching_near_digits_finds_what_whole_texts_hold(spark):
    rows, text = SAMPLES + _pieced_texts(), F.col("text")
    trimmed = lambda found: F.array_distinct(F.transform(found, tx.strip))
    upper = lambda found: F.array_distinct(F.transform(found, lambda x: F.upper(tx.strip(x))))
    ten = lambda found: F.filter(found, lambda x: F.length(F.regexp_replace(x, r"(?U)\D", "")) >= 10)
    for got, want in [
        (tx.phone_mentions(text), trimmed(ten(tx.find_all(text, rules.PHONE_PATTERNS)))),
        (tx.phone_mentions_wide(text), trimmed(ten(tx.find_all(text, rules.PHONE_PATTERNS_WIDE)))),
        (tx.plate_mentions(text), trimmed(tx.find_all(text, rules.PLATE_PATTERNS))),
        (tx.plate_mentions_wide(text), upper(tx.find_all(text, rules.PLATE_PATTERNS_WIDE, "(?iU)"))),
        (tx.account_mentions(text), F.filter(trimmed(tx.find_all(text, rules.ACCOUNT_PATTERNS, "(?iU)")), lambda x: F.length(x) >= 4)),
    ]:
        assert column(spark, got, rows) == column(spark, want, rows)


def test_plate_patterns_are_not_tried_on_whole_texts(spark):
    docs = spark.createDataFrame([("KA05MH1234",)], "text string")
    plan = docs.select(tx.plate_mentions_wide(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(" in plan and "regexp_extract_all(text" not in plan


def test_equal_parts_of_a_case_are_searched_once(spark):
    rows = [(f"c{i % 3}", i, t + " via Malabar Traders" if i % 5 == 1 else t) for i, t in enumerate(_pieced_texts(200) + [None])]
    docs = spark.createDataFrame(rows, "case_id string, doc_id int, text string")
    found = mn.pattern_mentions_by(docs, "case_id")
    want = mn.pattern_mentions(docs).select("case_id", "label", "value").distinct()
    assert sorted(found.distinct().collect()) == sorted(want.collect()) and want.count() > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    searched = max(i for i, line in enumerate(plan) if "regexp_extract_all" in line)
    assert any("Aggregate" in line for line in plan[searched:])


def test_overlapping_phone_forms_stay_distinct(spark):
    assert column(spark, tx.phone_mentions(F.col("text")), ["+91 9876543210"]) == [["+91 9876543210", "9876543210"]]


def test_dates_and_names(spark):
    dates = ["14th September", "September 14", "14/09/2025", "2025-09-14", "14th", "  14TH "]
    assert column(spark, tx.is_probable_date(F.col("text")), dates) == [True] * len(dates)
    assert column(spark, tx.is_probable_date(F.col("text")), ["Anil Kumar", "14"]) == [False, False]
    assert column(spark, tx.clean_person(F.col("text")), ["Mr. Anil Rao", "Shri.Anil’s", "Anil Rao's"]) == ["Anil Rao", "Anil", "Anil Rao"]
    assert column(spark, tx.normalise_phone(F.col("text")), ["+91 98-76"]) == ["+919876"]


def test_sentences_keep_abbreviations(spark):
    got = column(spark, tx.sentences(F.col("text")), ["Mr. R. Rao paid Rs. 55,000 today. He left! Why?  Gone"])
    assert got == [["Mr. R. Rao paid Rs. 55,000 today.", "He left!", "Why?", "Gone"]]


def test_triggers_are_substrings(spark):
    rows = ["All officers.", "It was arranged", "A simple plan"]
    assert column(spark, tx.has_trigger(F.col("text"), "FINANCIAL_TRAIL"), rows) == [True, False, False]
    assert column(spark, tx.has_trigger(F.col("text"), "CDR_LINK"), rows) == [False, True, False]
    assert column(spark, tx.has_trigger(F.col("text"), "CDR_LINK", whole_word=True), rows) == [False, False, False]


def test_relationship_names(spark):
    rows = [" met with! ", "2nd deal", "--", "a" * 80]
    assert column(spark, tx.relationship_name(F.col("text")), rows) == ["MET_WITH", "REL_2ND_DEAL", None, "A" * 60]


def test_delimiter_rules(spark):
    texts = ["a,b\n1,2", "a,b\n1,2,3", "a,b", "a;b,c\n1;2,3", "a|b\n\n1|2\n", "a\tb\n1\t2"]
    lines = tabular.text_lines(F.col("text"))
    assert column(spark, tabular.delimiter_of(lines), texts) == [",", None, None, ",", "|", "\t"]
    long = "\n".join(["a,b"] * 6 + ["ragged"])
    assert column(spark, tabular.delimiter_of(lines, rules.DELIMITERS_HEAD, 5), [long]) == [","]
    assert column(spark, tabular.delimiter_of(lines), [long]) == [None]


def test_line_count_is_splitlines(spark):
    texts = ["a\nb", "a\nb\n", "a\r\nb\x0bc d", "", "\n\n"]
    assert column(spark, tabular.line_count(F.col("text")), texts) == [len(t.splitlines()) for t in texts]


def test_call_rows_headers_quotes_and_short_rows(spark):
    docs = spark.createDataFrame([
        ("c", "1", 'From,To,Time,Duration\n"11""1",22,t1,5\n33,,t,6\n44,55,,7'),
        ("c", "2", "11|22|t|5\n33|44|t|6"),
        ("c", "3", "called;caller\n1;2"),
        ("c", "4", "Only, prose here.\nNothing else"),
    ], "case_id string, doc_id string, text string")
    got = {(r.doc_id, r.caller, r.called, r.ts_raw, r.duration_raw) for r in dl.call_rows(docs).collect()}
    assert got == {
        ("1", '11"1', "22", "t1", "5"), ("1", "44", "55", "", "7"),
        ("2", "11", "22", "t", "5"), ("2", "33", "44", "t", "6"), ("3", "2", "1", None, None),
    }
    tables, prose = dl.route_documents(docs)
    assert tables.count() == 3 and [r.doc_id for r in prose.collect()] == ["4"]


def test_quoted_cells(spark):
    rows = ['a,"b,c",d', '"x ""y""",z', ',"",', 'plain,row']
    got = column(spark, tabular.cells_of(F.col("text"), F.lit(",")), rows)
    assert got == [["a", "b,c", "d"], ['x "y"', "z"], ["", "", ""], ["plain", "row"]]


def test_aliases_are_tried_per_row(spark):
    table = spark.createDataFrame([(" ", "x", "9"), ("c", "y", "1,000")], "Caller_No string, source string, Total_Value string")
    assert [r.caller for r in dl.map_calls(table).orderBy("caller").collect()] == ["c", "x"]
    money = dl.map_transfers(table)
    assert {r.currency for r in money.collect()} == {"USD"}
    assert [r.amount for r in dl.transactions(money).collect()] == [9.0]


def test_table_files_and_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("caller;called;duration\n1;2;3\n4;5;6\n ; ; \n")
    (tmp_path / "b.csv").write_text("some prose\nmore; prose\n")
    found = {r.path.rsplit("/", 1)[1]: r.delimiter for r in dl.sniff_files(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": ";", "b.csv": None}
    rows = dl.read_call_table(spark, str(tmp_path / "a.csv"), ";").collect()
    assert {(r.caller, r.called, r.duration_raw) for r in rows} == {("1", "2", "3"), ("4", "5", "6")}


def test_reports_from_files_and_bytes(spark, tmp_path):
    from threadloom.sources import reports as rp

    (tmp_path / "u.txt").write_bytes("né\nà".encode())
    (tmp_path / "l.txt").write_bytes("né".encode("latin-1"))
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in rp.read_bytes(spark, str(tmp_path)).collect()}
    assert texts == {"u.txt": "né\nà", "l.txt": "né"}
    assert rp.read_reports(spark, str(tmp_path / "u.txt")).first().line_count == 2
    inline = spark.createDataFrame([("a", " "), ("a", None), ("b", "x"), ("b", "")], "case_id string, text string")
    assert [r.case_id for r in rp.blank_submissions(inline).collect()] == ["a"]


def test_many_reports_share_a_file(spark, tmp_path):
    from threadloom.sources import reports as rp

    texts = ["a\nb\n", "", "\n", None, "x\r\ny\rz", "\n--\n--0--\n", "\u00e9\u0001 " * 900, "\ufefflast"] * 25
    reports = spark.createDataFrame(list(enumerate(texts)), "name int, text string").repartition(2)
    path = str(tmp_path / "reports")
    mark = rp.write_reports(reports, path)
    assert len(list((tmp_path / "reports").glob("part-*"))) <= 2
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        read = rp.read_reports(spark, path, mark)
        got = {int(r.path): (r.text, r.line_count) for r in read.collect()}
        assert read.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert got == {i: (t, None if t is None else len(t.splitlines())) for i, t in enumerate(texts)}


def test_dictionary_and_candidate_people(spark):
    names = spark.createDataFrame([("Rahul Sharma",), ("R. Sharma",), ("Anil Kumar Rao",)], "name string")
    sentences = spark.createDataFrame([
        ("c", "1", 0, "Rahul Sharma's car and R. Sharma met Anil Kumar Rao"), ("c", "1", 1, "rahul sharma left"),
    ], "case_id string, doc_id string, sent_no int, sentence string")
    got = {(r.sent_no, r.name) for r in mn.dictionary_mentions(sentences, names).collect()}
    assert got == {(0, "Rahul Sharma"), (0, "R. Sharma"), (0, "Anil Kumar Rao")}
    docs = spark.createDataFrame([("c", "Later Mr. Anil Kumar met Deepak Rao near Goa.")], "case_id string, text string")
    assert {r.name for r in mn.candidate_people(docs).collect()} >= {"Deepak Rao"}


def test_triggers_do_not_lower_a_sentence_for_each_of_them(spark):
    from threadloom.operators.relate import fired_triggers

    rows = spark.createDataFrame([("He CALLED and Transferred it",), ("",), (None,)], "sentence string")
    found = rows.select(fired_triggers(F.col("sentence")).alias("fired"))
    assert "exists(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [r.fired for r in found.collect()]
    assert "FINANCIAL_TRAIL" in got[0] and got[1] == [] and got[2] == []


def test_people_are_folded_without_a_pass_over_the_texts(spark, monkeypatch):
    from threadloom.operators.cutting import Workspace
    from threadloom.operators.ingest import ingest_reports

    plans, cut = {}, Workspace.cut

    def seen(self, df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString())
        return cut(self, df, tag)

    monkeypatch.setattr(Workspace, "cut", seen)
    docs = spark.createDataFrame([("c", str(i), "Asha Rao called 9876543210 from Goa.") for i in range(3)], "case_id string, doc_id string, text string")
    names = spark.createDataFrame([("Asha Rao",)], "name string")
    done = ingest_reports(docs, names, spark.createDataFrame([("Goa",)], "name string"))
    assert {(r.label, r.id) for r in done.entities.collect()} == {("Person", "Asha Rao"), ("Location", "Goa"), ("Phone", "9876543210")}
    assert "regexp_extract_all" not in plans["asked"]


def test_accounts_of_a_text_are_searched_once(spark, tmp_path):
    from threadloom.operators.relate import narrative_transfers

    rows = [("c", "1", "Sent 12345678 to ab1234567."), ("c", "2", "12345678 and 123456789"), ("c", "3", "transfer of 12345678"), ("c", "4", None)]
    spark.createDataFrame(rows, "case_id string, doc_id string, text string").write.parquet(f"{tmp_path}/docs")
    found = narrative_transfers(spark.read.parquet(f"{tmp_path}/docs"))
    assert [(r.doc_id, r.src_id, r.dst_id) for r in found.collect()] == [("1", "12345678", "ab1234567")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("{8,20}") == 1


def test_equal_sentences_of_a_case_are_read_once(spark):
    from threadloom.operators.ingest import ingest_reports

    texts = [("c", "1"), ("c", "2"), ("d", "1"), ("c", "3"), ("c", "3"), ("c", None)]
    docs = spark.createDataFrame([(c, d, "Asha Rao called Ravi Das from Goa. Asha Rao left.") for c, d in texts], "case_id string, doc_id string, text string")
    names = spark.createDataFrame([("Asha Rao",), ("Ravi Das",)], "name string")
    done = ingest_reports(docs, names, spark.createDataFrame([("Goa",)], "name string"))
    # documents 1 and 2 share a row; one that stands twice and one without an id are left to the joins by document
    assert sorted((r.case_id, r.n, r.last.doc_id) for r in done.said.collect()) == [("c", 2, "2"), ("c", 2, "2"), ("d", 1, "1"), ("d", 1, "1")]
    found = {(r.src_case, r.rel, r.dst_id): r.confidence for r in done.edges().collect() if r.src_id == "Asha Rao"}
    assert found[("c", "CDR_LINK", "Ravi Das")] == 4 and found[("d", "CDR_LINK", "Ravi Das")] == 1
    assert {r.source_sentence for r in done.edges(rels=["CDR_LINK"]).collect()} == {"Asha Rao called Ravi Das from Goa."}
    assert {r.rel for r in done.edges(rels=["SPOTTED_AT"]).collect()} == {"SPOTTED_AT"}
    present = [(r.case_id, r.doc_id, r.sent_no, r.value) for r in done.present.collect()]
    assert present.count(("c", "1", 0, "Ravi Das")) == 1 and present.count(("c", "2", 1, "Asha Rao")) == 1


def test_texts_are_cut_and_words_joined_outside_the_generator(spark, tmp_path):
    spark.createDataFrame([("c", "1", "Asha Rao left.")], "case_id string, doc_id string, text string").write.parquet(f"{tmp_path}/docs")
    cut = mn.sentence_table(spark.read.parquet(f"{tmp_path}/docs"))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Rs|Mr|Mrs") == 2 and "Generate posexplode(_sentences" in plan
    names = spark.createDataFrame([("Asha Rao",)], "name string")
    plan = mn.dictionary_mentions(cut, names)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_keys" in plan and plan.count("zip_with") == 1


def test_mentions_of_a_document_take_one_pass(spark, tmp_path):
    rows = [("c", "1", "Asha Rao called 9876543210 from Goa. Asha Rao owns KA05MH1234."), ("c", "2", "Nobody came."), ("c", "3", "Om Sai Finance Corp"),
            ("c", "4", None), ("c", "5", "Ravi Das left."), ("c", "5", "Asha Rao came to Goa.")]
    spark.createDataFrame(rows, "case_id string, doc_id string, text string").write.parquet(f"{tmp_path}/docs")
    names = spark.createDataFrame([("Asha Rao",), ("Ravi Das",), ("Mr",)], "name string")
    found = mn.document_mentions(spark.read.parquet(f"{tmp_path}/docs"), names, spark.createDataFrame([("Goa",)], "name string"))
    got = {r.doc_id: (r.people, r.locations, r.vehicles, r.phones, r.organizations) for r in found.collect()}
    assert got == {
        "1": (["Asha Rao"], ["Goa"], ["KA05MH1234"], ["9876543210"], []), "3": ([], [], [], [], ["Om Sai Finance Corp"]),
        "5": (["Asha Rao", "Ravi Das"], ["Goa"], [], [], [])}
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(f"{tmp_path}/docs") == 1
