"""SQL twins of the domain tables, for the oracle queries."""

from __future__ import annotations

import re

from threadloom import rules

_ORGS = ", ".join(f"'{o}'" for o in rules.WATCH_LIST)

FRAGMENTS = {
    "calls": """
        SELECT event_type AS case_id, event_id AS row_no, 'P' || user_id AS caller,
               'P' || regexp_extract(props, '[0-9]+') AS called,
               CAST(ts AS VARCHAR) AS ts_raw, CAST(value AS VARCHAR) AS duration_raw FROM events""",
    "call_graph": "SELECT DISTINCT case_id AS graph, caller AS src, called AS dst FROM calls",
    "subscribers": "SELECT DISTINCT case_id AS graph, caller AS v FROM calls",
    "closest_calls": """
        SELECT graph, src, dst FROM (
            SELECT case_id AS graph, caller AS src, called AS dst,
                   row_number() OVER (PARTITION BY case_id, caller ORDER BY count(*) DESC, called) AS rn
            FROM calls GROUP BY case_id, caller, called) WHERE rn = 1""",
    "sales": """
        SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "nation_flows": """
        SELECT o_orderpriority AS graph, 'N' || c_nationkey AS src, 'N' || s_nationkey AS dst,
               sum(l_extendedprice) AS total FROM sales GROUP BY ALL""",
    "main_flows": """
        SELECT graph, src, dst FROM (
            SELECT *, row_number() OVER (PARTITION BY graph, src ORDER BY total DESC) AS rn FROM nation_flows)
        WHERE rn = 1""",
    "cases": """
        SELECT n_name AS case_id, 'Case ' || n_name AS name,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(n_nationkey) AS created_at FROM nation""",
    "buyers": """
        SELECT c_custkey, c_name, c_mktsegment, c_acctbal, n_name AS case_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "sellers": """
        SELECT s_suppkey, s_name, s_acctbal, n_name AS seller_case,
               'KA' || lpad(CAST((s_suppkey // 10000) % 100 AS VARCHAR), 2, '0') || 'MH'
                    || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS plate
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "trade": """
        SELECT case_id, c_name, s_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN buyers ON o_custkey = c_custkey JOIN sellers ON l_suppkey = s_suppkey GROUP BY ALL""",
    "event_pairs": "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events",
    "phone_owners": """
        SELECT k, case_id, c_name, 'P' || k AS phone FROM
            (SELECT user_id AS k FROM event_pairs UNION SELECT k FROM event_pairs) JOIN buyers ON k = c_custkey""",
    "entities": """
        SELECT case_id, 'Person' AS label, c_name AS id FROM buyers
        UNION ALL SELECT DISTINCT case_id, 'Organization', s_name FROM trade
        UNION ALL SELECT DISTINCT case_id, 'Location', 'Market ' || c_mktsegment FROM buyers
        UNION ALL SELECT seller_case, 'Vehicle', plate FROM sellers
        UNION ALL SELECT case_id, 'Phone', phone FROM phone_owners""",
    "edges": """
        SELECT case_id AS src_case, 'Person' AS src_label, c_name AS src_id, 'FINANCIAL_TRAIL' AS rel,
               case_id AS dst_case, 'Organization' AS dst_label, s_name AS dst_id, CAST(n AS DOUBLE) AS confidence,
               CAST(NULL AS VARCHAR) AS last_timestamp, CAST(NULL AS VARCHAR) AS last_duration FROM trade
        UNION ALL SELECT case_id, 'Person', c_name, 'SPOTTED_AT', case_id, 'Location', 'Market ' || c_mktsegment, 1.0,
               NULL, NULL FROM buyers
        UNION ALL SELECT case_id, 'Person', c_name, 'OWNS_VEHICLE', seller_case, 'Vehicle', plate, 1.0, NULL, NULL
               FROM buyers JOIN sellers ON c_custkey = s_suppkey
        UNION ALL SELECT o.case_id, 'Person', o.c_name, 'USES_DEVICE', o.case_id, 'Phone', o.phone, u.n, NULL, NULL
               FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u JOIN phone_owners o ON u.user_id = o.k
        UNION ALL SELECT a.case_id, 'Phone', a.phone, 'INTERCEPTED_CALL', b.case_id, 'Phone', b.phone, p.n, p.ts, p.dur
               FROM (SELECT user_id, k, count(*) AS n, CAST(max_by(ts, event_id) AS VARCHAR) AS ts,
                            CAST(max_by(value, event_id) AS VARCHAR) AS dur FROM event_pairs GROUP BY user_id, k) p
               JOIN phone_owners a ON p.user_id = a.k JOIN phone_owners b ON p.k = b.k""",
    "incident": """
        SELECT src_case AS case_id, src_label AS label, src_id AS id, 'out' AS direction, rel, dst_label AS other_label,
               dst_id AS other_id, dst_case AS other_case, confidence FROM edges
        UNION ALL SELECT dst_case, dst_label, dst_id, 'in', rel, src_label, src_id, src_case, confidence FROM edges""",
    "holders": """
        SELECT label, id, list_sort(list(case_id)) AS held FROM entities WHERE label IN ('Phone', 'Vehicle', 'Organization')
        GROUP BY label, id HAVING count(*) > 1""",
    "exact_links": """
        SELECT type, case_a, id AS id_a, case_b, id AS id_b FROM (
            SELECT type, id, case_a, unnest(later) AS case_b FROM (
                SELECT label AS type, id, held[i] AS case_a, held[i + 1:] AS later FROM
                    (SELECT label, id, held, unnest(range(1, len(held))) AS i FROM holders)))
        WHERE case_a < case_b""",
    "all_edges": """
        SELECT 'all' AS graph, src_case || ':' || src_id AS src, dst_case || ':' || dst_id AS dst, rel, confidence FROM edges
        UNION ALL SELECT 'all', case_a || ':' || id_a, case_b || ':' || id_b, 'SAME_' || upper(type), 1.0 FROM exact_links""",
    "texts": """
        SELECT source AS case_id, 'd' || doc_id AS doc_id, text FROM documents
        UNION ALL SELECT 'pages', 'p' || page_id, html FROM pages
        UNION ALL SELECT 'conversations', 'c' || conv_id || '-' || turn, text FROM conversations""",
    # RE2 knows ASCII word borders only: other letters become an underscore, which is a word character
    "plain_texts": r"""
        SELECT case_id, doc_id, text,
               regexp_replace(text, '[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02FF}]', '_', 'g') AS plain
        FROM texts""",
    "titled": """
        SELECT p_partkey, p_name, p_brand, p_type, p_size, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2,
               upper(w1[1]) || w1[2:] || ' ' || upper(w2[1]) || w2[2:] AS name FROM part""",
    "report_parts": f"""
        SELECT u.case_id, o_orderkey || '-' || l_suppkey AS doc_id, a.name AS a, b.name AS b, n, seller_case AS place,
               '+91 9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS phone_a,
               '022-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS phone_b,
               'KA05MH' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS plate,
               [{_ORGS}][l_suppkey % 6 + 1] AS org
        FROM (SELECT o_orderkey, o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
        JOIN titled a ON a.p_partkey = o_custkey JOIN titled b ON b.p_partkey = l_suppkey
        JOIN buyers u ON u.c_custkey = o_custkey JOIN sellers ON s_suppkey = l_suppkey""",
    "reports": """
        SELECT case_id, doc_id, a || ' called ' || b || ' from ' || phone_a || ' on 14/09/2025. ' || a || ' transferred Rs. ' || n
               || ',000 to ' || b || ' via ' || org || '. ' || a || ', who owns car ' || plate || ', was seen at ' || place
               || '. Mr. ' || b || ' uses phone ' || phone_b || '.' AS text FROM report_parts""",
    "sentences": r"""
        SELECT case_id, doc_id, text, unnest(parts) AS sentence, unnest(range(len(parts))) AS sent_no FROM (
            SELECT case_id, doc_id, text, list_filter(list_transform(string_split(
                regexp_replace(regexp_replace(text, '(^|\s)(Rs|Mr|Mrs|Smt|Shri|[A-Z])\.', '\1\2' || chr(1), 'g'),
                               '([.!?]+)\s+', '\1' || chr(2), 'g'), chr(2)),
                lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '') AS parts FROM reports)""",
    "people_in": """
        SELECT case_id, doc_id, sent_no, name FROM sentences JOIN (SELECT DISTINCT name FROM titled) ON contains(sentence, name)""",
    "places_in": r"""
        SELECT case_id, doc_id, sent_no, n_name AS place FROM sentences
        JOIN nation ON regexp_matches(sentence, '\b' || n_name || '\b')""",
    "phones_found": r"""
        SELECT DISTINCT case_id, doc_id, unnest(list_concat(regexp_extract_all(text, '\+91[-\s]?\d{10}\b'),
            regexp_extract_all(text, '\+91[-\s]?\d{5}[-\s]?\d{5}\b'), regexp_extract_all(text, '\b0\d{2,4}[-\s]?\d{6,8}\b'),
            regexp_extract_all(text, '\b\d{10}\b'), regexp_extract_all(text, '\b\d{2}-\d{10}\b'))) AS value FROM reports""",
    "phones": "SELECT case_id, doc_id, value FROM phones_found WHERE length(regexp_replace(value, '\\D', '', 'g')) >= 10",
    "plates": r"""
        SELECT DISTINCT case_id, doc_id, unnest(list_concat(regexp_extract_all(text, '\b[A-Z]{2}-\d{2}-[A-Z]{1,2}-\d{4}\b'),
            regexp_extract_all(text, '\b[A-Z]{2}\d{2}[A-Z]{1,2}\d{4}\b'), regexp_extract_all(text, '\b[A-Z]{2}\s\d{2}\s[A-Z]{1,2}\s\d{4}\b'),
            regexp_extract_all(text, '\b\d{2}\s?BH\s?\d{4}\s?[A-Z]{1,2}\b'))) AS value FROM reports""",
    "orgs": f"SELECT case_id, doc_id, value FROM reports JOIN (SELECT unnest([{_ORGS}]) AS value) ON contains(text, value)",
    "found": """
        SELECT DISTINCT case_id, label, value FROM (
            SELECT case_id, 'Person' AS label, name AS value FROM people_in UNION ALL SELECT case_id, 'Location', place FROM places_in
            UNION ALL SELECT case_id, 'Phone', value FROM phones UNION ALL SELECT case_id, 'Vehicle', value FROM plates
            UNION ALL SELECT case_id, 'Organization', value FROM orgs)""",
    "held": """
        SELECT case_id, doc_id, sent_no, label, value FROM sentences JOIN found USING (case_id)
        WHERE label IN ('Phone', 'Vehicle', 'Organization') AND contains(sentence, value)""",
    "present": """
        SELECT DISTINCT * FROM (SELECT case_id, doc_id, sent_no, 'Person' AS label, name AS value FROM people_in
            UNION ALL SELECT case_id, doc_id, sent_no, 'Location', place FROM places_in UNION ALL SELECT * FROM held)""",
    "triggers": "SELECT * FROM (VALUES " + ", ".join(
        f"('{rel}', '{word}')" for rel, words in rules.TRIGGERS.items() for word in words
    ) + ") t(rel, word)",
    "fired": """
        SELECT DISTINCT case_id, doc_id, sent_no, sentence, rel FROM sentences JOIN triggers ON contains(lower(sentence), word)""",
    "sightings": """
        SELECT f.rel, a.case_id, a.doc_id, a.sent_no, a.label AS src_label, a.value AS src_id, b.label AS dst_label, b.value AS dst_id, f.sentence
        FROM present a JOIN present b USING (case_id, doc_id, sent_no) JOIN fired f USING (case_id, doc_id, sent_no)
        WHERE (a.label = 'Person' AND b.label = 'Person' AND a.value < b.value AND f.rel IN ('ASSOCIATE_OF', 'FINANCIAL_TRAIL', 'CDR_LINK'))
           OR (a.label = 'Person' AND b.label = 'Vehicle' AND f.rel = 'OWNS_VEHICLE')
           OR (a.label = 'Person' AND b.label = 'Phone' AND f.rel = 'USES_DEVICE')
           OR (a.label = 'Phone' AND b.label = 'Phone' AND a.value < b.value AND f.rel = 'INTERCEPTED_CALL')
        UNION ALL
        SELECT r.rel, a.case_id, a.doc_id, a.sent_no, a.label, a.value, b.label, b.value, NULL
        FROM present a JOIN present b USING (case_id, doc_id, sent_no)
        JOIN (VALUES ('SPOTTED_AT', 'Person', 'Location'), ('ASSOCIATED_WITH', 'Person', 'Organization'),
                     ('CAMERA_LOG', 'Vehicle', 'Location')) r(rel, x, y) ON a.label = r.x AND b.label = r.y""",
    "audit_events": """
        SELECT CAST(user_id AS VARCHAR) AS case_id, CAST(ts AS VARCHAR) AS ts, event_type AS action, props AS details,
               event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events""",
    "payloads": """
        SELECT *, '{"action": "' || action || '", "details": ' || details || ', "timestamp": "' || ts || '"}' AS payload
        FROM audit_events""",
    "chain": """
        SELECT case_id, seq, ts, action, details, payload, 'GENESIS' AS prev_hash, sha256(payload || 'GENESIS') AS hash, value
        FROM payloads WHERE seq = 0
        UNION ALL SELECT p.case_id, p.seq, p.ts, p.action, p.details, p.payload, c.hash, sha256(p.payload || c.hash), p.value
        FROM chain c JOIN payloads p ON p.case_id = c.case_id AND p.seq = c.seq + 1""",
}


#: Fragments that several others read; they are computed once a query.
KEPT = {"entities", "holders", "exact_links", "edges", "trade"}


def query(body: str, **extra: str) -> str:
    """``body`` with every fragment it needs, in order, as common table expressions."""
    pool = {**FRAGMENTS, **extra}
    needed: list[str] = []

    def visit(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in pool:
            if name in needed or name in inside or not re.search(rf"(?<![.\w']){name}(?![\w'])", text):
                continue
            visit(pool[name], (*inside, name))
            if name not in needed:
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({pool[n]})" for n in needed) + "\n" + body


# ---------------------------------------------------------------- graph questions over any edge query


def graph_ctes(edges: str) -> dict[str, str]:
    """Collapsed edges, vertices and sizes of an edge table (graph, src, dst)."""
    return {
        "ge": f"SELECT DISTINCT graph, src, dst FROM {edges}",
        "gv": "SELECT DISTINCT graph, v FROM (SELECT graph, src AS v FROM ge UNION ALL SELECT graph, dst FROM ge)",
        "gn": "SELECT graph, count(*) AS n FROM gv GROUP BY graph",
        "gd": "SELECT graph, src, count(*) AS d FROM ge GROUP BY graph, src",
        "gu": "SELECT DISTINCT graph, src AS u, dst AS w FROM ge WHERE src <> dst UNION SELECT graph, dst, src FROM ge WHERE src <> dst",
    }


PAGERANK = {
    "pr": """
        SELECT 0 AS it, gv.graph, gv.v, CAST(1.0 AS DOUBLE) / n AS rank, CAST(1e9 AS DOUBLE) AS err FROM gv JOIN gn USING (graph)
        UNION ALL
        SELECT it + 1, graph, v, fresh, sum(abs(fresh - rank)) OVER (PARTITION BY graph) FROM (
            SELECT p.it, p.graph, p.v, p.rank,
                   CAST(0.15 AS DOUBLE) / gn.n + CAST(0.85 AS DOUBLE) * (coalesce(c.s, 0) + h.hang / gn.n) AS fresh
            FROM pr p JOIN gn USING (graph)
            JOIN (SELECT x.graph, sum(CASE WHEN gd.d IS NULL THEN x.rank ELSE 0 END) AS hang FROM pr x
                  LEFT JOIN gd ON gd.graph = x.graph AND gd.src = x.v GROUP BY x.graph) h ON h.graph = p.graph
            LEFT JOIN (SELECT ge.graph, ge.dst, sum(y.rank / gd.d) AS s FROM pr y JOIN gd ON gd.graph = y.graph AND gd.src = y.v
                       JOIN ge ON ge.graph = y.graph AND ge.src = y.v GROUP BY ge.graph, ge.dst) c
                   ON c.graph = p.graph AND c.dst = p.v
            WHERE p.err >= gn.n * 1e-6 AND p.it < 100)""",
    "final_rank": "SELECT graph, v, rank, it FROM pr QUALIFY it = max(it) OVER (PARTITION BY graph)",
}


def betweenness_ctes(depth: int) -> dict[str, str]:
    """Breadth-first levels with path counts, unrolled to ``depth``, and the pair-sum of shares."""
    out = {"lv0": "SELECT graph, v AS s, v, 0 AS d, CAST(1 AS DOUBLE) AS paths FROM gv"}
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT graph, s, v FROM lv{j}" for j in range(i))
        out[f"lv{i}"] = f"""
            SELECT l.graph, l.s, e.dst AS v, {i} AS d, sum(l.paths) AS paths FROM lv{i - 1} l
            JOIN ge e ON e.graph = l.graph AND e.src = l.v
            ANTI JOIN ({seen}) z ON z.graph = l.graph AND z.s = l.s AND z.v = e.dst GROUP BY l.graph, l.s, e.dst"""
    out["reached"] = " UNION ALL ".join(f"SELECT * FROM lv{i}" for i in range(depth + 1))
    out["shares"] = """
        SELECT a.graph, a.v, sum(a.paths * b.paths / c.paths) AS total FROM reached a
        JOIN reached b ON b.graph = a.graph AND b.s = a.v AND b.d > 0
        JOIN reached c ON c.graph = a.graph AND c.s = a.s AND c.v = b.v AND c.d = a.d + b.d
        WHERE a.d > 0 GROUP BY a.graph, a.v"""
    out["between"] = """
        SELECT gv.graph, gv.v, coalesce(total, 0) / ((n - 1) * (n - 2)) AS betweenness
        FROM gv JOIN gn USING (graph) LEFT JOIN shares s ON s.graph = gv.graph AND s.v = gv.v"""
    return out


# where every vertex has one way on, the walk from each source is its only path
SINGLE_WALK = {
    "walks": """
        SELECT graph, v AS s, v, 0 AS d, [v] AS seen FROM gv
        UNION ALL SELECT w.graph, w.s, e.dst, w.d + 1, list_append(w.seen, e.dst) FROM walks w
        JOIN ge e ON e.graph = w.graph AND e.src = w.v WHERE NOT list_contains(w.seen, e.dst)""",
    "reached": "SELECT graph, s, v, d, CAST(1 AS DOUBLE) AS paths FROM walks",
}

LABELS = {
    "lab": """
        SELECT 0 AS it, graph, v, v AS l, 1 AS moved FROM gv
        UNION ALL
        SELECT it + 1, graph, v, nl, max(CASE WHEN nl <> l THEN 1 ELSE 0 END) OVER () FROM (
            SELECT x.it, x.graph, x.v, x.l, least(x.l, coalesce(m.l, x.l)) AS nl FROM lab x
            LEFT JOIN (SELECT gu.graph, gu.u, min(y.l) AS l FROM gu JOIN lab y ON y.graph = gu.graph AND y.v = gu.w
                       GROUP BY gu.graph, gu.u) m ON m.graph = x.graph AND m.u = x.v
            WHERE x.moved = 1)""",
    "comp": "SELECT graph, v, l AS component FROM lab QUALIFY it = max(it) OVER ()",
}

# components of the graph without each candidate in turn
CUTS = {
    "cand": """
        SELECT 0 AS it, a.graph, a.v AS c, b.v, b.v AS l, 1 AS moved FROM gv a JOIN gv b ON a.graph = b.graph AND a.v <> b.v
        UNION ALL
        SELECT it + 1, graph, c, v, nl, max(CASE WHEN nl <> l THEN 1 ELSE 0 END) OVER () FROM (
            SELECT x.it, x.graph, x.c, x.v, x.l, least(x.l, coalesce(m.l, x.l)) AS nl FROM cand x
            LEFT JOIN (SELECT gu.graph, y.c, gu.u, min(y.l) AS l FROM gu
                       JOIN cand y ON y.graph = gu.graph AND y.v = gu.w AND y.c <> gu.u
                       GROUP BY gu.graph, y.c, gu.u) m ON m.graph = x.graph AND m.c = x.c AND m.u = x.v
            WHERE x.moved = 1)""",
    "cut_vertices": """
        SELECT graph, c AS v FROM (
            SELECT cand.graph, cand.c, count(DISTINCT l) AS k FROM cand
            SEMI JOIN gu ON gu.graph = cand.graph AND gu.u = cand.c
            WHERE it = (SELECT max(it) FROM cand) GROUP BY cand.graph, cand.c)
        JOIN (SELECT graph, count(DISTINCT component) AS base FROM comp GROUP BY graph) USING (graph) WHERE k > base""",
}


def cycle_ctes(max_len: int | None) -> dict[str, str]:
    bound = "" if max_len is None else f" AND len(path) < {max_len}"
    return {
        "walk": f"""
            SELECT graph, src AS first, dst AS last, [src, dst] AS path FROM ge WHERE dst > src
            UNION ALL
            SELECT w.graph, w.first, e.dst, list_append(w.path, e.dst) FROM walk w JOIN ge e ON e.graph = w.graph AND e.src = w.last
            WHERE e.dst > w.first AND NOT list_contains(w.path, e.dst){bound}""",
        "cyc": """
            SELECT graph, [src, dst] AS cycle, 1 AS length FROM ge WHERE src = dst
            UNION ALL SELECT w.graph, list_append(w.path, w.first), len(w.path) FROM walk w
            JOIN ge e ON e.graph = w.graph AND e.src = w.last AND e.dst = w.first""",
    }
