"""DuckDB SQL for the rows of the registered queries, written apart from their Spark code."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_HITS = f"""
items AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM docs_in),
hits AS (
  SELECT DISTINCT rid, i, d.k, item
  FROM (SELECT rid, k, i, list_slice(w, i, i + k - 1) AS win
        FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i
              FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)) d
  JOIN wins ON d.k = wins.k AND d.win = wins.win
)"""

OP1 = f"""
WITH docs_in AS (SELECT doc_id, text FROM documents),
{OP1_HITS},
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

# crc32 of bytes (a list of numbers) by the table of its polynomial; `crc` has one row
CRC = """crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM range(256) r(i)))"""


def crc32(code_points: str) -> str:
    """SQL for the crc32 of a string of code points under U+0100."""
    as_bytes = f"flatten(list_transform({code_points}, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 192 THEN [194, c] ELSE [195, c - 64] END))"
    step = "lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])"
    return f"xor(list_reduce({as_bytes}, {step}, 4294967295), 4294967295)"


def points(text: str) -> str:
    return f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT)"


def field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def tree(name: str, leaves: str) -> str:
    """CTEs of the tree over (tree, i, d): all levels, and (tree, levels) with the root."""
    return f"""
{name} AS (
  SELECT tree, 0 AS lvl, i, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, min(lvl) + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (min(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, i // 3
),
{name}_runs AS (SELECT tree, lvl, i // 3 AS run, list(d ORDER BY i) AS ds FROM {name} WHERE n > 1 GROUP BY ALL),
{name}_roots AS (SELECT tree, d AS root FROM {name} WHERE n = 1)"""


def climb(name: str, walk: str, start: str) -> str:
    """CTE that takes (rid, tree, i, proof, fold) from the leaves of a tree to its root."""
    own = "ds[(i % 3 + 1)::INT]"
    left, right = "array_to_string(ds[1:(i % 3)::INT], '')", "array_to_string(ds[(i % 3 + 2)::INT:], '')"
    return f"""
{walk} AS (
  SELECT rid, tree, 0 AS lvl, i, proof, fold FROM {start}
  UNION ALL
  SELECT rid, w.tree, w.lvl + 1, w.i // 3, proof || {left} || {right}, sha256({left} || fold || {right})
  FROM {walk} w JOIN {name}_runs r ON w.tree = r.tree AND w.lvl = r.lvl AND w.i // 3 = r.run
),
{walk}_end AS (SELECT rid, tree, arg_max(proof, lvl) AS proof, arg_max(fold, lvl) AS fold FROM {walk} GROUP BY ALL)"""


OP11 = f"""
WITH RECURSIVE {CRC},
rows AS (
  SELECT *, {leaf('text')} AS d, {leaf("replace(text, chr(10), '')")} AS without,
         {crc32(points("coalesce(doc_id::VARCHAR, '')"))} % 2 = 0 AS tampered FROM documents, crc
),
leaves AS (
  SELECT row_number() OVER () AS rid, coalesce('s' || source, '') AS tree, doc_id, d, CASE WHEN tampered THEN without ELSE d END AS fold,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i, '' AS proof FROM rows
),
{tree('low', 'leaves')},
tops AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, root AS d FROM low_roots),
{tree('high', 'tops')},
{climb('low', 'up', 'leaves')},
halfway AS (SELECT rid, t.tree, t.i, proof, fold FROM up_end JOIN tops t ON up_end.tree = t.source),
{climb('high', 'top', 'halfway')}
SELECT doc_id, l.d AS leaf, low_roots.root AS subroot, high_roots.root AS root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root,
       e.fold = high_roots.root AS verified
FROM leaves l JOIN top_end e USING (rid) JOIN low_roots ON l.tree = low_roots.tree JOIN high_roots ON high_roots.tree = ''
"""

OP12 = """
SELECT doc_id, max(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW own AS (PARTITION BY coalesce(text, ''))
"""

RUN = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13 = rf"""
WITH RECURSIVE {CRC},
runs AS (
  SELECT doc_id, {RUN} AS run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
),
drawn AS (SELECT run, n, {crc32(points("doc_id || ':' || run"))} AS h FROM runs, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM drawn)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
cuts AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
named AS (SELECT word, n_near, most, min(encode(near)) AS near FROM best JOIN near USING (word) WHERE n = most GROUP BY ALL),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN decode(near) END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN named USING (word)
),
chain AS (
  SELECT word, word AS spot, 0 AS k FROM words
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c.spot = f.word WHERE f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(spot, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)
"""
