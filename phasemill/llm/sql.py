"""DuckDB twins of the operators' queries."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(text: str, pattern: str, lower: bool = True) -> str:
    t = f"coalesce({text}, '')"
    return f"regexp_extract_all({_LOWER.format(t) if lower else t}, {pattern})"


def decontaminate(width: int, percent: int) -> str:
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark),
g AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), {width}) AS k, array_to_string(w[i:i + {width - 1}], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM g),
p AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)
),
m AS MATERIALIZED (SELECT doc_id, i, p.k, item_id FROM p JOIN g ON p.phrase = g.phrase AND p.k = g.k),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id
),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
       sha256(coalesce(ids.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 100 * coalesce(hit.n, 0) >= {percent} * len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""


def url_filter(rules, many: int, rare: int, similar: float, prior: float, reject: float) -> str:
    def case(values) -> str:
        ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
        when = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{values(v, h, p)}'"
            for v, h, p in ordered
        )
        return f"CASE {when} END"

    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
q AS (
  SELECT page_id, {_LOWER.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
),
r AS MATERIALIZED (
  SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{16,}}', '{{h}}', 'g'),
           '[0-9]+', '{{n}}', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') AS shape
  FROM q
),
s AS (
  SELECT host, shape, count(*) AS n, count(*) FILTER (ruled = 'block') AS b, count(*) FILTER (ruled IS NOT NULL) AS l,
         string_split(shape, '/') AS parts
  FROM r GROUP BY host, shape
),
n AS MATERIALIZED (
  SELECT host, shape, n, b, l, parts, pos, parts[pos + 1] AS segment, array_to_string(parts[1:pos], '/') AS parent,
         len(parts) - pos AS below
  FROM (SELECT *, unnest(range(0, len(parts))) AS pos FROM s)
),
c AS (
  SELECT *, b * 2 > l AS mostly, l > 0 AS labelled
  FROM (SELECT host, pos, parent, segment, sum(n) AS n, sum(b) AS b, sum(l) AS l, min(below) AS lo, max(below) AS hi
        FROM n GROUP BY ALL)
),
k AS (
  SELECT *, count(*) OVER lev AS n_children, sum(n) OVER lev AS n_level, count(*) OVER kin AS n_kin,
         sum(b) OVER kin / greatest(sum(l) OVER kin, 1) AS rate
  FROM c WINDOW lev AS (PARTITION BY host, pos, parent),
                kin AS (PARTITION BY host, pos, parent, lo, hi, labelled, mostly)
),
names AS (
  SELECT host, pos, parent, segment,
         CASE WHEN n_children >= {many} AND n_level < n_children * {rare} AND n < {rare} THEN '**'
              WHEN n_kin > 1 AND abs(b / greatest(l, 1) - rate) <= sqrt(rate * (1 - rate) / greatest(l, 1)) * {similar} + 1e-12
              THEN CASE WHEN labelled THEN '*' ELSE '+' END
              ELSE segment END AS name
  FROM k
),
t AS (
  SELECT host, shape, n.b, n.l, string_agg(name, '/' ORDER BY pos) AS template
  FROM n JOIN names USING (host, pos, parent, segment) GROUP BY host, shape, n.b, n.l
),
v AS (SELECT host, template, sum(b) / (sum(l) + {prior}) AS purity FROM t GROUP BY host, template)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN t USING (host, shape) JOIN v USING (host, template)"""


def near_duplicates(shingle: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _SPACED)} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) i
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other
),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


def mix_sources(weights, share_percent: int, most: int) -> str:
    pick = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len({_words('text', _SPACED, False)}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE rank % {len(weights)} {pick} END::DOUBLE AS w, (source_size * {most})::DOUBLE AS cap,
         sum(source_size) OVER () * {share_percent} / 100 AS total FROM s
),
o AS (SELECT *, cap / w AS level, row_number() OVER (ORDER BY cap / w, rank) - 1 AS k FROM w),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o
),
best AS (SELECT arg_min((total - fixed) / free, k) AS shared, min(k) AS k FROM f WHERE (total - fixed) / free < level),
t AS (
  SELECT source, source_size,
         CASE WHEN best.k IS NOT NULL AND f.k >= best.k THEN shared * w ELSE cap END AS target FROM f, best
),
r AS (
  SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""


def line_dedup(min_chars: int) -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = _LOWER.format(f"trim(line, {white})")
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
),
k AS MATERIALIZED (SELECT doc_id, line, i, {key} AS key FROM l),
f AS (SELECT key, min(doc_id) AS head FROM k WHERE length(key) >= {min_chars} GROUP BY key),
m AS (SELECT k.*, coalesce(doc_id > head, FALSE) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def repetition(limits, line_limit: float, least_words: int, percent: int) -> str:
    parts = []
    for n in limits:
        parts.append(f"""
g{n} AS MATERIALIZED (
  SELECT doc_id, sum(length(word)) AS chars, count(*) AS words FROM (
    SELECT DISTINCT x.doc_id, pos FROM (
      SELECT doc_id, unnest(range(i, i + {n})) AS pos FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
        FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d))) WHERE c > 1) x) y
  JOIN p USING (doc_id, pos) GROUP BY doc_id)""")
    joins = " ".join(f"LEFT JOIN g{n} ON g{n}.doc_id = t.doc_id" for n in limits)
    within = " AND ".join(f"coalesce(g{n}.chars, 0) / greatest(word_chars, 1) <= {x}" for n, x in limits.items())
    failed = f"(n_words < {least_words} OR 100 * coalesce(g5.words, 0) > {percent} * n_words)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {_words('text', _SPACED, False)} AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
l AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
  WHERE regexp_matches(line, {_SPACED})
),
dup AS (
  SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars
  FROM l WHERE nth > 1 GROUP BY doc_id
),
t AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d
),{','.join(parts)}
SELECT t.doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
       coalesce(g5.words, 0) AS n_repeat_words, {failed} AS base_failed,
       NOT {failed} AND {within} AND coalesce(dup.chars, 0) / greatest(word_chars, 1) <= {line_limit} AS kept
FROM t LEFT JOIN dup ON dup.doc_id = t.doc_id {joins}"""


def tool_calls(most_chars: int) -> str:
    return f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, length(text) AS n, conv_id || '-' AS k FROM conversations),
a AS (
  SELECT conv_id, turn, text, n, CASE WHEN n % 17 = 0 THEN NULL WHEN n % 11 = 5 THEN k || (turn - 2) ELSE k || turn END AS id,
         CASE n % 4 WHEN 0 THEN [k || (turn + 2)] WHEN 1 THEN [k || (turn - 2)] WHEN 2 THEN [k || (turn + 2), k || (turn - 4)] ELSE [] END AS after
  FROM m WHERE role = 'assistant'
),
b AS (SELECT conv_id, turn, text AS content, k || (turn + CASE WHEN n % 13 = 2 THEN 1 ELSE -1 END) AS id FROM m WHERE role = 'user'),
calls AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) AS nth FROM a),
results AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) AS nth FROM b),
c AS MATERIALIZED (SELECT * FROM calls WHERE nth = 1 AND id IS NOT NULL),
known AS MATERIALIZED (
  SELECT c.conv_id, c.id, d.id AS dep, d.turn >= c.turn AS ahead
  FROM (SELECT conv_id, id, turn, unnest(after) AS dep FROM c) c JOIN c d ON d.conv_id = c.conv_id AND d.id = c.dep
),
sizes AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
walk(conv_id, id, tip, steps) AS (
  SELECT conv_id, id, id, 0 FROM c
  UNION
  SELECT w.conv_id, w.id, k.dep, steps + 1 FROM walk w JOIN known k ON k.conv_id = w.conv_id AND k.id = w.tip
  JOIN sizes s ON s.conv_id = w.conv_id WHERE steps < s.n
),
depth AS (
  SELECT w.conv_id, w.id, CASE WHEN w.conv_id NOT IN (SELECT conv_id FROM known WHERE ahead) THEN 0 WHEN max(steps) < any_value(s.n) THEN max(steps) END AS level
  FROM walk w JOIN sizes s ON s.conv_id = w.conv_id GROUP BY w.conv_id, w.id
),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, level, coalesce(c.turn, r.turn) AS turn, coalesce(c.id, r.id) AS id, text, c.n, content, c.turn IS NOT NULL AS called,
         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN level IS NULL THEN 'cyclic' WHEN r.turn IS NULL THEN 'unanswered'
              WHEN r.turn < c.turn THEN 'misplaced' ELSE 'linked' END AS status
  FROM (SELECT * FROM c JOIN depth USING (conv_id, id)) c FULL JOIN (SELECT * FROM results WHERE nth = 1) r ON r.conv_id = c.conv_id AND r.id = c.id
),
e AS (
  SELECT * FROM linked
  UNION ALL SELECT conv_id, NULL, turn, id, text, n, NULL, true, CASE WHEN id IS NULL THEN 'nameless' ELSE 'repeated' END FROM calls WHERE nth > 1 OR id IS NULL
  UNION ALL SELECT conv_id, NULL, turn, id, NULL, NULL, content, false, 'repeated' FROM results WHERE nth > 1
)
SELECT conv_id, CAST(coalesce(level, -1) AS INTEGER) AS level, turn, id, status,
       CASE WHEN called THEN n % 7 <> 3 AND n BETWEEN 1 AND {most_chars} END AS valid,
       sha256('{{' || CASE WHEN called THEN '"arguments":{{"chars":' || CASE WHEN n % 7 = 3 THEN '"' || n || '"' ELSE n::VARCHAR END || ',"text":' || to_json(text) || '}},' ELSE '' END
         || '"id":' || coalesce(to_json(id)::VARCHAR, 'null') || CASE WHEN called THEN ',"name":"reply"' ELSE '' END
         || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END
         || ',"status":"' || status || '"}}') AS line_sha256
FROM e"""


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}), 4294967295::BIGINT)"


def prefix_trie() -> str:
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    return f"""
WITH t AS MATERIALIZED (
  SELECT conv_id, list({{'r': {role}, 'x': {text}}} ORDER BY turn NULLS FIRST, md5(strlen({role}) || ':' || {role} || {text})) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (SELECT conv_id, w, {_crc32('conv_id::VARCHAR')} % 9 AS h FROM t),
r AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(b.w, [])[1:h], h.w[h + 1:len(h.w)]) AS w
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5
),
p AS MATERIALIZED (SELECT conv_id, w, d, w[1:d] AS p FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM r)),
n AS MATERIALIZED (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(w[d].x)) END AS size,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(w) = d), '') AS ends
  FROM p GROUP BY d, p
),
k AS MATERIALIZED (
  SELECT n.*, coalesce(c.n, 0) AS n_children
  FROM n LEFT JOIN (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2) c USING (d, p)
),
s AS (
  SELECT a AS d, p[1:a] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM k) GROUP BY 1, 2
)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s USING (d, p) LEFT JOIN n u ON u.d = k.d - 1 AND u.p = k.p[1:k.d - 1] AND k.d > 0"""


def secret_scan(rules: list[tuple[str, str, int, int]], n_base: int) -> str:
    matches = " UNION ALL ".join(
        f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i,
         list_sum(list_transform(list_concat(m[1:i], g[1:i]), lambda x: length(x)))::BIGINT AS stop, length(m[i]) AS size, length(v[i]) >= {least} AS holds
  FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g, regexp_extract_all(text, {p}, {value}) AS v FROM d)"""
        for place, (kind, pattern, value, least) in enumerate(rules, 1)
        for p in ["'" + pattern.replace("'", "''") + "'"]
    )
    listed = "string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, place)"
    counts = ", ".join(f"count(s.kind) FILTER (WHERE s.kind = '{kind}') AS n_{kind}" for kind, *_ in rules[:n_base])
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED (SELECT * FROM ({matches}) WHERE holds)
SELECT d.doc_id, {counts}, sha256(coalesce({listed} FILTER (WHERE place <= {n_base}), '')) AS base_sha256,
       coalesce({listed}, '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
