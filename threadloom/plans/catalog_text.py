"""Queries on mentions, name resolution and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import scoring, text as tx
from threadloom.operators import boundaries as bd
from threadloom.operators import mentions as mn
from threadloom.operators import relate as rl
from threadloom.operators import resolve as rs
from threadloom.operators import tagger
from threadloom.operators import upsert as up
from threadloom.operators.cutting import Workspace
from threadloom import schema
from threadloom.operators.ingest import ingest_reports, submit
from threadloom.plans.domain import Domain
from threadloom.plans.sqlbase import query
from threadloom.rules import ACCOUNT_PATTERNS, DATE_PATTERNS, PERSON_STOP_WORDS, PHONE_PATTERNS_WIDE, PLACE_NOISE, PLATE_PATTERNS_WIDE, WATCH_LIST

# ---------------------------------------------------------------- mentions


def _prose(d: Domain):
    return d.reports.unionByName(d.texts)


def _values(docs, found):
    return docs.select("case_id", "doc_id", F.explode(found).alias("value"))


def _ingest(d: Domain):
    """The reports of the data folder, stored with their mentions and entities."""
    def build():
        work = Workspace(d.spark, "reports")
        return ingest_reports(
            work.cut(d.reports, "reports"), work.cut(d.person_names, "names"), work.cut(d.gazetteer, "places"))

    return d.stored("ingest", build)


def _sql_list(patterns, flag=""):
    return "list_concat(" + ", ".join(f"regexp_extract_all(plain, '{flag}{p}')" for p in patterns) + ")"


def ext3_list(d: Domain):
    """The watch list and all nations and regions as one table of names."""
    listed = d.spark.createDataFrame([(name,) for name in WATCH_LIST], "name string")
    names = listed.unionByName(d.gazetteer).unionByName(d.table("region").select(F.col("r_name").alias("name")))
    return mn.listed_mentions(_prose(d), names).select("case_id", "doc_id", F.col("name").alias("value"))


def ext4_tagged(d: Domain):
    """People and places of all reports by a tagger that half of the names and places have taught."""
    split = Workspace(d.spark, "tagger").cut(mn.sentence_table(d.reports), "sentences")
    half = lambda names: names.filter(F.pmod(F.crc32("name"), F.lit(2)) == 0)
    model = tagger.fit(split, half(d.person_names), half(d.gazetteer))
    return tagger.tagged_mentions(split, model).select("case_id", "doc_id", "sent_no", "label", "value")


def ext6(d: Domain):
    forms = F.array(*[F.concat(F.lit(a), F.initcap("p_name"), F.lit(b)) for a, b in FORMS])
    return d.table("part").select("p_partkey", F.posexplode(forms).alias("form", "raw")).select(
        "p_partkey", "form", tx.clean_person(F.col("raw")).alias("name"))


FORMS = [("Mr. ", ""), ("Smt.", "'s"), ("", "’s"), ("Mrs.  ", " "), ("Dr. ", "")]


def _texts_to_judge(d: Domain):
    """Names, noise words and dates in several spellings."""
    day = F.col("o_orderdate")
    shapes = F.array(
        F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MMMM d"),
        F.concat(F.date_format(day, "d"), F.lit("th")), F.concat(F.date_format(day, "d"), F.lit("TH "), F.date_format(day, "MMMM")),
        F.date_format(day, "d MMMM yyyy"), F.col("o_orderpriority"),
    )
    dates = d.table("orders").select(F.explode(shapes).alias("value"))
    words = F.array(*[F.lit(w) for w in PERSON_STOP_WORDS + PLACE_NOISE + ["", "  ", "Up", "Goa"]])
    names = d.table("part").select(F.explode(F.concat(F.array(F.initcap("p_name")), words)).alias("value"))
    return dates.unionByName(names).distinct()


JUDGED = f"""
    SELECT DISTINCT value FROM (
        SELECT unnest([strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%B %-d'),
            strftime(o_orderdate, '%-d') || 'th', strftime(o_orderdate, '%-d') || 'TH ' || strftime(o_orderdate, '%B'),
            strftime(o_orderdate, '%-d %B %Y'), o_orderpriority]) AS value FROM orders
        UNION ALL SELECT name FROM titled
        UNION ALL SELECT unnest({PERSON_STOP_WORDS + PLACE_NOISE + ["", "  ", "Up", "Goa"]}) FROM part)"""
IS_DATE = "(" + " OR ".join(f"regexp_matches(trim(value), '{p}')" for p in DATE_PATTERNS) + ")"


def ext16(d: Domain):
    lists = mn.document_mentions(d.reports, d.person_names, d.gazetteer)
    return lists.select("case_id", "doc_id", *[
        F.array_join(c, "|").alias(c) for c in ("people", "locations", "vehicles", "phones", "organizations")])


# ---------------------------------------------------------------- resolution


def res1(d: Domain):
    parts = F.split("p_name", " ")
    forms = F.array(F.upper("p_name"), F.concat(F.get(parts, F.lit(1)), F.lit(" "), F.get(parts, F.lit(0))), F.concat(F.lit(" "), "p_name"))
    pairs = d.table("part").select("p_name", F.explode(forms).alias("other")).distinct()
    return pairs.select("p_name", "other", F.round(scoring.name_score(F.col("p_name"), F.col("other")), 6).alias("score"))


def res5(d: Domain):
    done, _ = rs.resolve_and_insert(d.spark, d.aliases, d.name_lists)
    return done.select("case_id", "raw_name", "canonical_name", "resolution_type")


def res7(d: Domain):
    found = mn.pattern_mentions_by(d.reports, "case_id")
    vehicles = d.sellers.select(F.col("seller_case").alias("case_id"), F.lit("Vehicle").alias("label"), F.col("plate").alias("id"))
    return rs.new_values(found, vehicles)


ALIASES = """
    SELECT DISTINCT p_brand || '/' || p_size AS case_id, unnest([upper(p_name), upper(w1[1]) || '. ' || upper(w2[1]) || w2[2:],
        upper(w2[1]) || w2[2:], upper(w2[1]) || w2[2:] || ' ' || upper(w1[1]) || w1[2:], name]) AS name FROM titled"""
KNOWN = "SELECT DISTINCT p_brand || '/' || p_size AS case_id, name AS known, lower(w2) AS surname, lower(w1[1]) AS initial FROM titled"
INITIALS = """
    SELECT a.case_id, a.name, min(k.known) AS known FROM aliases a JOIN known k ON a.case_id = k.case_id
     AND lower(string_split(replace(a.name, '.', ''), ' ')[2]) = k.surname AND lower(a.name[1]) = k.initial
    WHERE contains(a.name, ' ') GROUP BY ALL HAVING count(*) = 1"""
SURNAMES = """
    SELECT a.case_id, a.name, min(k.known) AS known FROM aliases a JOIN known k ON a.case_id = k.case_id AND lower(a.name) = k.surname
    WHERE NOT contains(a.name, ' ') GROUP BY ALL HAVING count(*) = 1"""
NAMES = {"aliases": ALIASES, "known": KNOWN, "by_initials": INITIALS, "by_surname": SURNAMES}
PERSONS = """
    SELECT DISTINCT p_brand AS case_id, CASE WHEN p_type = 'ECONOMY' THEN upper(p_name) ELSE name END AS id FROM titled"""


# ---------------------------------------------------------------- relationships


def _rel(rel: str):
    def run(d: Domain):
        return _ingest(d).edges(rels=[rel]).select("src_case", "src_label", "src_id", "dst_label", "dst_id", "confidence", "source_sentence")

    sql = query(f"""
        SELECT case_id AS src_case, src_label, src_id, dst_label, dst_id, CAST(count(*) AS DOUBLE) AS confidence,
               max_by(sentence, (doc_id, sent_no)) AS source_sentence FROM
        (SELECT s.*, CASE WHEN rel IN ('ASSOCIATE_OF', 'FINANCIAL_TRAIL', 'CDR_LINK') THEN sentence END AS shown FROM sightings s)
        WHERE rel = '{rel}' GROUP BY ALL""".replace("max_by(sentence,", "max_by(shown,"))
    return run, sql


def rel1(d: Domain):
    edges = _ingest(d).edges(rels=["ASSOCIATE_OF", "FINANCIAL_TRAIL", "CDR_LINK"])
    return edges.select("src_case", "src_id", "rel", "dst_id", "confidence", "source_sentence")


def rel8(d: Domain):
    return _ingest(d).edges().groupBy("src_case", "rel").agg(
        F.count(F.lit(1)).alias("edge_count"), F.sum("confidence").alias("sightings"))


#: Ids of calls that share a submitted table.
TABLE_CALLS = 1000


def _call_tables(calls):
    """Calls as tables of a bounded number of lines; the header makes a table of a single call too."""
    line = F.concat_ws(",", "caller", "called", "ts_raw", "duration_raw")
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    tables = calls.groupBy("case_id", F.floor(F.col("row_no") / TABLE_CALLS).cast("string").alias("doc_id")).agg(
        F.concat(F.lit("caller,called,timestamp,duration\n"), lines).alias("text"))
    return tables.withColumn("doc_kind", F.lit("cdr"))


def _submitted(d: Domain):
    """All reports as narratives and all calls as tables of lines, submitted to a store that holds other rows."""
    tables = _call_tables(d.calls)
    reports = d.reports.select("case_id", "doc_id", "text").withColumn("doc_kind", F.lit("fir"))
    rows = tables.unionByName(reports).withColumn("append", F.col("case_id") == "view")
    old = d.spark.createDataFrame([("view", "Phone", "0"), ("other", "Phone", "0")], "case_id string, label string, id string")
    entities = up.entity_rows(old, "manual")
    none = lambda shape: d.spark.createDataFrame([], shape)
    stored = {"entities": entities, "edges": none(schema.EDGES), "audit": none(schema.AUDIT)}
    return submit(rows, d.person_names, d.gazetteer, stored, F.lit("2024-01-01T00:00:00"))


def ingest(d: Domain):
    """Summed confidence of edges and number of audited relationships, per case and relationship."""
    done = _submitted(d)
    edges = done["edges"].groupBy(F.col("src_case").alias("case_id"), "rel").agg(F.sum("confidence").alias("n")).withColumn("kind", F.lit("edge"))
    logged = done["audit"].filter("action = 'ADD_RELATIONSHIP'").groupBy(
        "case_id", F.get_json_object("details", "$.type").alias("rel")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("kind", F.lit("audit"))
    return edges.unionByName(logged)


def rel9(d: Domain):
    return _ingest(d).present


def rel10(d: Domain):
    split = mn.sentence_table(_prose(d))
    fired = rl.fired_triggers(F.col("sentence"))
    return split.select("case_id", "doc_id", "sent_no", F.explode(fired).alias("rel"))


def rel15(d: Domain):
    """A second pass over the same reports doubles every count."""
    done = _ingest(d)
    both = up.add_edges(done.edges(), done.edges(), done.entities)
    return both.groupBy("src_case", "rel").agg(F.sum("confidence").alias("sightings"))


ALL_SENTENCES = {"reports": """
    SELECT case_id, doc_id, text FROM (SELECT case_id, doc_id, a || ' called ' || b || ' from ' || phone_a || ' on 14/09/2025. ' || a || ' transferred Rs. ' || n
           || ',000 to ' || b || ' via ' || org || '. ' || a || ', who owns car ' || plate || ', was seen at ' || place
           || '. Mr. ' || b || ' uses phone ' || phone_b || '.' AS text FROM report_parts) UNION ALL SELECT * FROM texts"""}

_TYPE = r"regexp_replace(regexp_replace(lower({0}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g'), '[^\p{{L}}\p{{N}}]+$', '')".format
_LOGS = "({hits} * ln({p}) + ({misses}) * ln(1 - {p}))".format
_SOME = "CASE WHEN {p} > 0 AND {p} < 1 THEN {logs} ELSE 0 END".format


def _part(hits: str, misses: str, p: str) -> str:
    return _SOME(p=f"({p})", logs=_LOGS(hits=hits, misses=misses, p=f"({p})"))


LEARNED = {
    "all_tokens": r"SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM reports",
    "seen_words": rf"""
        SELECT {_TYPE('token')} AS word, count(*) AS n,
               count(*) FILTER (regexp_matches(regexp_replace(lower(token), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g'), '[\p{{L}}\p{{N}}]\.$')) AS n_period
        FROM all_tokens WHERE regexp_matches({_TYPE('token')}, '\p{{L}}') GROUP BY 1""",
    "token_totals": "SELECT sum(n)::DOUBLE AS tokens, sum(n_period)::DOUBLE AS periods, periods / tokens AS p FROM seen_words",
    "scored": """
        SELECT word, n, n_period, 2 * (n_period * ln(CAST(0.99 AS DOUBLE)) + (n - n_period) * ln(1 - CAST(0.99 AS DOUBLE)) - n_period * ln(p) - (n - n_period) * ln(1 - p))
               * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1)
               * pow(length(replace(word, '.', ''))::DOUBLE, -(n - n_period)) AS score
        FROM seen_words, token_totals WHERE n_period > 0""",
    "short_words": "SELECT list(word) AS known FROM scored WHERE score >= 0.3",
    "word_lists": r"SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ts FROM reports WHERE text IS NOT NULL",
    "word_pairs": "SELECT ts[i] AS here, ts[i - 1] AS before FROM (SELECT ts, unnest(range(2, len(ts) + 1)) AS i FROM word_lists)",
    "first_words": rf"""
        SELECT {_TYPE('here')} AS word, count(*)::DOUBLE AS ab FROM word_pairs, short_words
        WHERE regexp_matches(before, '[.!?]$') AND regexp_matches(here, '^\p{{Lu}}') AND NOT list_contains(known, {_TYPE('before')}) GROUP BY 1""",
    "first_scored": f"""
        SELECT word, 2 * ({_part('ab', 'a - ab', 'ab / a')} + {_part('(b - ab)', 't - a - b + ab', '(b - ab) / (t - a)')}
                          - {_part('ab', 'a - ab', 'b / t')} - {_part('(b - ab)', 't - a - b + ab', 'b / t')}) AS ratio
        FROM (SELECT f.word, ab, n::DOUBLE AS b, periods AS a, tokens AS t FROM first_words f JOIN seen_words USING (word), token_totals)
        WHERE ab / a > (b - ab) / (t - a)""",
    "start_words": "SELECT list(word) AS begin_words FROM first_scored WHERE ratio >= 30",
    "cut_texts": r"SELECT case_id, doc_id, string_split(regexp_replace(text, '([.!?]+)(\s+)', '\1\2' || chr(2), 'g'), chr(2)) AS ps FROM reports WHERE text IS NOT NULL",
    "closed_texts": rf"""
        SELECT case_id, doc_id, array_to_string(list_transform(ps, lambda p, i: p || CASE
            WHEN regexp_matches(regexp_extract(p, '(\S+)\s*$', 1), '[\p{{L}}\p{{N}}]\.$')
                 AND (list_contains(known, {_TYPE(r"regexp_extract(p, '(\S+)\s*$', 1)")}) OR regexp_matches({_TYPE(r"regexp_extract(p, '(\S+)\s*$', 1)")}, '^\p{{L}}$'))
                 AND NOT (coalesce(regexp_matches(ps[i + 1], '^\s*\p{{Lu}}'), false)
                          AND coalesce(list_contains(begin_words, {_TYPE(r"regexp_extract(ps[i + 1], '^\s*(\S+)', 1)")}), false)
                          AND NOT regexp_matches({_TYPE(r"regexp_extract(p, '(\S+)\s*$', 1)")}, '^\p{{L}}$')) THEN '' ELSE chr(2) END), '') AS joined
        FROM cut_texts, short_words, start_words""",
    "learned": r"""
        SELECT case_id, doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS sent_no FROM (
            SELECT case_id, doc_id, list_filter(list_transform(string_split(joined, chr(2)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS parts
            FROM closed_texts)""",
}


def ext17_abbreviations(d: Domain):
    scored = bd.abbreviations(Workspace(d.spark, "words").cut(bd.word_counts(_prose(d)), "words"))
    return scored.select("word", "n", "n_period", F.round("score", 3).alias("score"))


ENTRIES = {
    "ext1": (lambda d: _values(_prose(d), tx.phone_mentions(F.col("text"))), query("SELECT case_id, doc_id, value FROM phones", **ALL_SENTENCES)),
    "ext2": (lambda d: _values(_prose(d), tx.plate_mentions(F.col("text"))), query("SELECT case_id, doc_id, value FROM plates", **ALL_SENTENCES)),
    "ext3": (lambda d: _values(_prose(d), tx.watch_list_mentions(F.col("text"))), query("SELECT case_id, doc_id, value FROM orgs", **ALL_SENTENCES)),
    "ext3_list": (ext3_list, query("""
        SELECT case_id, doc_id, name AS value FROM (SELECT * FROM reports UNION ALL SELECT * FROM texts) r
        JOIN (SELECT unnest([%s]) AS name UNION SELECT n_name FROM nation UNION SELECT r_name FROM region) n ON contains(r.text, n.name)""" % ", ".join(
            repr(o) for o in WATCH_LIST))),
    "ext4": (lambda d: mn.people(mn.sentence_table(d.reports), d.person_names), query("SELECT case_id, doc_id, sent_no, name FROM people_in")),
    "ext5": (lambda d: mn.places(mn.sentence_table(d.reports), d.gazetteer), query("SELECT case_id, doc_id, sent_no, place AS name FROM places_in")),
    "ext4_features": (lambda d: tagger.feature_counts(mn.sentence_table(d.reports)), query(r"""
        SELECT shape_of(ts[i]) AS shape, lower(right(ts[i], 3)) AS ending, coalesce(lower(ts[i - 1]), '<s>') AS before, count(*) AS n
        FROM (SELECT ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT regexp_extract_all(sentence, '%s') AS ts FROM sentences)) GROUP BY ALL""".replace(
            "shape_of(ts[i])", "replace(regexp_replace(regexp_replace(regexp_replace(ts[i], '\\p{Lu}+', chr(1), 'g'), '\\p{L}+', 'a', 'g'), '\\p{N}+', '9', 'g'), chr(1), 'A')"
        ) % tagger.TOKEN.replace("'", "''"))),
    "ext4_tagged": (ext4_tagged, None),
    "ext6": (ext6, query("""
        SELECT p_partkey, form, CASE WHEN form = 4 THEN 'Dr. ' || name ELSE name END AS name FROM titled, (SELECT unnest(range(5)) AS form)""")),
    "ext7": (
        lambda d: _texts_to_judge(d).select("value", tx.is_valid_person(F.col("value")).alias("valid")),
        query(f"SELECT value, trim(value) <> '' AND value NOT IN ({', '.join(repr(w) for w in PERSON_STOP_WORDS)}) AND NOT {IS_DATE} AS valid FROM judged", judged=JUDGED)),
    "ext8": (
        lambda d: _texts_to_judge(d).select("value", tx.is_valid_place(F.col("value")).alias("valid")),
        query(f"SELECT value, length(value) > 2 AND value NOT IN ({', '.join(repr(w) for w in PLACE_NOISE)}) AND NOT {IS_DATE} AS valid FROM judged", judged=JUDGED)),
    "ext9": (
        lambda d: _texts_to_judge(d).select("value", tx.is_probable_date(F.col("value")).alias("is_date")),
        query(f"SELECT value, {IS_DATE} AS is_date FROM judged", judged=JUDGED)),
    "ext10": (lambda d: _values(_prose(d), tx.phone_mentions_wide(F.col("text"))), query(rf"""
        SELECT DISTINCT case_id, doc_id, value FROM (SELECT case_id, doc_id, trim(unnest({_sql_list(PHONE_PATTERNS_WIDE)})) AS value
            FROM (SELECT case_id, doc_id, plain FROM plain_texts UNION ALL SELECT case_id, doc_id, text FROM reports))
        WHERE length(regexp_replace(value, '\D', '', 'g')) >= 10""")),
    "ext11": (lambda d: _values(_prose(d), tx.plate_mentions_wide(F.col("text"))), query(rf"""
        SELECT DISTINCT case_id, doc_id, upper(trim(unnest({_sql_list(PLATE_PATTERNS_WIDE, '(?i)')}))) AS value
        FROM (SELECT case_id, doc_id, plain FROM plain_texts UNION ALL SELECT case_id, doc_id, text FROM reports)""")),
    "ext12": (lambda d: _values(_prose(d), tx.account_mentions(F.col("text"))), query(rf"""
        SELECT DISTINCT case_id, doc_id, unnest({_sql_list(ACCOUNT_PATTERNS, '(?i)')}) AS value
        FROM (SELECT case_id, doc_id, plain FROM plain_texts UNION ALL SELECT case_id, doc_id, text FROM reports)""")),
    "ext13": (
        lambda d: d.sellers.select("s_name", tx.normalise_plate(F.concat(F.lit(" "), F.lower("plate"), F.lit("\t x"))).alias("plate")),
        query("SELECT s_name, plate || 'X' AS plate FROM sellers")),
    "ext14": (
        lambda d: d.report_parts.select("doc_id", tx.normalise_phone(F.col("phone_a")).alias("a"), tx.normalise_phone(F.col("phone_b")).alias("b")),
        query("SELECT doc_id, replace(phone_a, ' ', '') AS a, replace(phone_b, '-', '') AS b FROM report_parts")),
    "ext15": (
        lambda d: d.table("part").select("p_partkey", tx.normalise_text(F.concat(F.lit("\t "), F.upper("p_name"), F.lit("\n"))).alias("name")),
        "SELECT p_partkey, p_name AS name FROM part"),
    "ext16": (ext16, query("""
        SELECT case_id, doc_id, coalesce(string_agg(value, '|' ORDER BY value) FILTER (label = 'Person'), '') AS people,
               coalesce(string_agg(value, '|' ORDER BY value) FILTER (label = 'Location'), '') AS locations,
               coalesce(string_agg(value, '|' ORDER BY value) FILTER (label = 'Vehicle'), '') AS vehicles,
               coalesce(string_agg(value, '|' ORDER BY value) FILTER (label = 'Phone'), '') AS phones,
               coalesce(string_agg(value, '|' ORDER BY value) FILTER (label = 'Organization'), '') AS organizations
        FROM (SELECT DISTINCT * FROM (
            SELECT case_id, doc_id, 'Person' AS label, name AS value FROM people_in UNION ALL SELECT case_id, doc_id, 'Location', place FROM places_in
            UNION ALL SELECT case_id, doc_id, 'Phone', value FROM phones UNION ALL SELECT case_id, doc_id, 'Vehicle', value FROM plates
            UNION ALL SELECT case_id, doc_id, 'Organization', value FROM orgs)) GROUP BY case_id, doc_id""")),
    "ext17": (lambda d: mn.sentence_table(_prose(d)), query("SELECT case_id, doc_id, sent_no, sentence FROM sentences", **ALL_SENTENCES)),
    "ext17_abbreviations": (ext17_abbreviations, query("SELECT word, n, n_period, round(score, 3) + 0 AS score FROM scored", **ALL_SENTENCES, **LEARNED)),
    "ext17_learned": (lambda d: bd.learned_sentences(_prose(d)), query("SELECT case_id, doc_id, sent_no, sentence FROM learned", **ALL_SENTENCES, **LEARNED)),
    "res1": (res1, query("""
        SELECT DISTINCT p_name, other, round(CASE WHEN lower(trim(other)) = p_name THEN 100
            ELSE 0.4 * 100 * 2 * greatest(length(w1), length(w2)) / (2 * length(p_name)) + 60 END, 6) AS score
        FROM (SELECT p_name, w1, w2, unnest([upper(p_name), w2 || ' ' || w1, ' ' || p_name]) AS other FROM titled)""")),
    "res2": (lambda d: rs.match_initials(d.aliases.distinct(), d.name_lists), query("SELECT * FROM by_initials", **NAMES)),
    "res3": (lambda d: rs.match_surname(d.aliases.distinct(), d.name_lists), query("SELECT * FROM by_surname", **NAMES)),
    "res4": (
        lambda d: rs.resolve(d.aliases, d.name_lists),
        query("""
            SELECT a.case_id, a.name AS raw_name, coalesce(e.known, f.known, i.known, s.known, a.name) AS canonical_name,
                   CASE WHEN e.known IS NOT NULL OR f.known IS NOT NULL THEN CAST(100 AS DOUBLE) END AS score,
                   CASE WHEN e.known IS NOT NULL THEN 'exact' WHEN f.known IS NOT NULL THEN 'fuzzy' WHEN i.known IS NOT NULL THEN 'initials'
                        WHEN s.known IS NOT NULL THEN 'surname' ELSE 'new' END AS resolution_type
            FROM aliases a LEFT JOIN known e ON e.case_id = a.case_id AND e.known = a.name
            LEFT JOIN known f ON f.case_id = a.case_id AND lower(f.known) = lower(a.name)
            LEFT JOIN by_initials i ON i.case_id = a.case_id AND i.name = a.name
            LEFT JOIN by_surname s ON s.case_id = a.case_id AND s.name = a.name""", **NAMES)),
    "res5": (res5, None),
    "res6": (lambda d: rs.known_values(d.entities, "Phone"), query("SELECT case_id, id AS known FROM entities WHERE label = 'Phone'")),
    "res7": (res7, query("""
        SELECT * FROM (SELECT DISTINCT case_id, 'Phone' AS label, value FROM phones UNION ALL SELECT DISTINCT case_id, 'Organization', value FROM orgs
            UNION ALL SELECT DISTINCT case_id, 'Vehicle', value FROM plates) x
        WHERE NOT EXISTS (SELECT 1 FROM sellers s WHERE x.label = 'Vehicle' AND s.seller_case = x.case_id AND s.plate = x.value)""")),
    "res8": (
        lambda d: rs.exact_links(d.entities).drop("score", "match_kind"),
        query("SELECT type, case_a, id_a, case_b, id_b FROM exact_links")),
    "res9": (
        lambda d: rs.person_links(d.brand_persons, threshold=85).drop("type"),
        query("""
            SELECT a.case_id AS case_a, a.id AS id_a, b.case_id AS case_b, b.id AS id_b, 'fuzzy' AS match_kind, CAST(100 AS DOUBLE) AS score
            FROM persons a JOIN persons b ON lower(a.id) = lower(b.id) AND a.case_id < b.case_id""", persons=PERSONS)),
    "res9_loose": (
        lambda d: rs.person_links(d.brand_persons.unionByName(
            d.table("part").select(F.col("p_brand").alias("case_id"), F.lit("Person").alias("label"),
                                   F.concat_ws(" ", F.reverse(F.split("p_name", " "))).alias("id")).distinct()), threshold=75)
        .groupBy(F.lower("id_a").alias("name_a"), F.lower("id_b").alias("name_b"), F.round("score", 6).alias("score"))
        .agg(F.count(F.lit(1)).alias("n")),
        query("""
            SELECT lower(a.id) AS name_a, lower(b.id) AS name_b, round(CASE WHEN lower(a.id) = lower(b.id) THEN 100
                ELSE 0.4 * 100 * 2 * greatest(length(string_split(a.id, ' ')[1]), length(string_split(a.id, ' ')[2])) / (2 * length(a.id)) + 60 END, 6) AS score,
                count(*) AS n
            FROM everyone a JOIN everyone b ON a.case_id < b.case_id AND
                (lower(a.id) = lower(b.id) OR lower(a.id) = lower(string_split(b.id, ' ')[2] || ' ' || string_split(b.id, ' ')[1]))
            WHERE lower(a.id) = lower(b.id) OR
                0.4 * 100 * 2 * greatest(length(string_split(a.id, ' ')[1]), length(string_split(a.id, ' ')[2])) / (2 * length(a.id)) + 60 >= 75
            GROUP BY ALL""", persons=PERSONS,
              everyone="SELECT * FROM persons UNION SELECT DISTINCT p_brand, w2 || ' ' || w1 FROM titled")),
    "res10": (
        lambda d: rs.exact_links(d.entities, d.table("nation").filter("n_regionkey < 2").select(F.col("n_name").alias("case_id"))).drop("score", "match_kind"),
        query("""
            SELECT type, case_a, id_a, case_b, id_b FROM exact_links JOIN nation x ON x.n_name = case_a AND x.n_regionkey < 2
            JOIN nation y ON y.n_name = case_b AND y.n_regionkey < 2""")),
    "res_groups": (
        lambda d: rs.link_groups(d.entities),
        query("""
            SELECT label, id, count(*) AS case_count, min(case_id) AS first_case, max(case_id) AS last_case, count(*) * (count(*) - 1) // 2 AS link_count
            FROM entities WHERE label IN ('Phone', 'Vehicle', 'Organization') GROUP BY label, id HAVING count(*) > 1""")),
    "rel1": (rel1, query("""
        SELECT case_id AS src_case, src_id, rel, dst_id, CAST(count(*) AS DOUBLE) AS confidence, max_by(sentence, (doc_id, sent_no)) AS source_sentence
        FROM sightings WHERE rel IN ('ASSOCIATE_OF', 'FINANCIAL_TRAIL', 'CDR_LINK') GROUP BY ALL""")),
    "rel2": _rel("SPOTTED_AT"),
    "rel3": _rel("ASSOCIATED_WITH"),
    "rel4": _rel("OWNS_VEHICLE"),
    "rel5": _rel("USES_DEVICE"),
    "rel6": _rel("INTERCEPTED_CALL"),
    "rel7": _rel("CAMERA_LOG"),
    "rel8": (rel8, query("""
        SELECT src_case, rel, count(*) AS edge_count, CAST(sum(n) AS DOUBLE) AS sightings FROM (
            SELECT case_id AS src_case, rel, src_label, src_id, dst_label, dst_id, count(*) AS n FROM sightings GROUP BY ALL) GROUP BY ALL""")),
    "rel9": (rel9, query("SELECT case_id, doc_id, sent_no, label, value FROM present")),
    "rel10": (rel10, query("SELECT case_id, doc_id, sent_no, rel FROM fired WHERE rel <> 'SPOTTED_AT'", **ALL_SENTENCES)),
    "rel11": (
        lambda d: rl.intercepted_calls(d.calls).select("src_case", "src_id", "rel", "dst_id", "confidence", "last_timestamp", "last_duration"),
        query("""
            SELECT case_id AS src_case, caller AS src_id, 'INTERCEPTED_CALL' AS rel, called AS dst_id, CAST(count(*) AS DOUBLE) AS confidence,
                   max_by(ts_raw, row_no) AS last_timestamp, max_by(duration_raw, row_no) AS last_duration FROM calls GROUP BY ALL""")),
    "rel12": (
        lambda d: rl.call_made(d.calls).select("src_case", "src_id", "rel", "dst_id", "last_timestamp", "last_duration"),
        query("""
            SELECT case_id AS src_case, caller AS src_id, 'CALL_MADE' AS rel, called AS dst_id,
                   max_by(ts_raw, row_no) AS last_timestamp, max_by(duration_raw, row_no) AS last_duration FROM calls GROUP BY ALL""")),
    "ingest": (ingest, query("""
        SELECT case_id, rel, n, kind FROM (
            SELECT case_id, rel, CAST(count(*) AS DOUBLE) AS n FROM sightings GROUP BY ALL
            UNION ALL SELECT case_id, 'INTERCEPTED_CALL', CAST(count(*) AS DOUBLE) FROM calls GROUP BY ALL), (SELECT unnest(['edge', 'audit']) AS kind)""")),
    "rel11_nodes": (
        lambda d: rl.call_entities(d.calls).select("case_id", "label", "id", "value", "source"),
        query("""
            SELECT DISTINCT case_id, 'Phone' AS label, id, id AS value, 'tabular_cdr' AS source
            FROM (SELECT case_id, unnest([caller, called]) AS id FROM calls) WHERE id <> ''""")),
    "rel11_stored": (
        lambda d: up.with_both_ends(rl.intercepted_calls(d.calls), rl.call_entities(d.calls)).select("src_case", "src_id", "dst_id", "confidence"),
        query("SELECT case_id AS src_case, caller AS src_id, called AS dst_id, CAST(count(*) AS DOUBLE) AS confidence FROM calls GROUP BY ALL")),
    "rel13_nodes": (
        lambda d: rl.transfer_entities(d.transactions).select("case_id", "label", "id", "value", "source"), """
            SELECT DISTINCT o_orderpriority AS case_id, 'BankAccount' AS label, id, id AS value, 'financial_csv' AS source
            FROM (SELECT o_orderpriority, unnest(['C' || o_custkey, CASE WHEN l_returnflag <> 'R' THEN 'S' || l_suppkey END]) AS id
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE id IS NOT NULL"""),
    "rel13": (
        lambda d: rl.transferred_to(d.transactions).select("src_case", "src_id", "dst_id", "amount", "currency", "last_timestamp", "description"),
        """
            SELECT o_orderpriority AS src_case, 'C' || o_custkey AS src_id, 'S' || l_suppkey AS dst_id, l_extendedprice AS amount, 'USD' AS currency,
                   CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_timestamp,
                   'order ' || max_by(l_orderkey, (l_shipdate, l_orderkey)) AS description
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY o_orderpriority, o_custkey, l_suppkey, l_extendedprice"""),
    "rel14": (lambda d: rl.narrative_transfers(_prose(d)), query(rf"""
        SELECT case_id, doc_id, accounts[1].account AS src_id, accounts[2].account AS dst_id, 'TRANSFERRED_TO' AS rel, CAST(0.75 AS DOUBLE) AS confidence FROM (
            SELECT case_id, doc_id, text, list_sort(list_transform(list_distinct({_sql_list(ACCOUNT_PATTERNS, '(?i)')}),
                   lambda a: {{'at': instr(text, a), 'account': a}})) AS accounts
            FROM (SELECT case_id, doc_id, text, plain FROM plain_texts UNION ALL SELECT case_id, doc_id, text, text FROM reports)
            WHERE contains(lower(text), 'transfer') OR contains(lower(text), 'sent'))
        WHERE len(accounts) >= 2""")),
    "rel15": (rel15, query("SELECT case_id AS src_case, rel, CAST(2 * count(*) AS DOUBLE) AS sightings FROM sightings GROUP BY ALL")),
}
