"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from llm import licenses, mixing

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
low AS (SELECT x AS r, min(doc_id) AS low FROM reach JOIN w ON w.r = reach.y GROUP BY x),
k AS (SELECT x AS r, count(*) AS k FROM e GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, coalesce(k, 0) AS n_links
FROM w LEFT JOIN n USING (r) LEFT JOIN low USING (r) LEFT JOIN k USING (r)
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 2 AS cap, (SELECT CAST(sum(source_size) AS DOUBLE) * 3 / 2 FROM s) AS goal FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM w),
c AS (SELECT *, weight * (goal - before) > cap * onward AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (goal - (SELECT coalesce(sum(cap), 0) FROM c WHERE capped)) / (SELECT sum(weight) FROM c WHERE NOT capped) END AS target FROM c),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
x AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole FROM q),
r AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, x.quota - x.whole * x.source_size AS extra, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS past FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - past)) AS BIGINT) AS taken FROM r
"""
assert mixing.WORD == r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM t) GROUP BY r),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(list_distinct(w)) AS n_distinct,
         length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest
  FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_distinct < 10 * n_words OR 100 * n_digits > 20 * word_chars OR longest > 1000) AS kept
FROM b
"""


def _op5() -> str:
    """Single-sentence and multi-sentence rules over the known sentences of each document, in order."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    rules = []
    for k, (name, ids) in enumerate(licenses.RULES):
        joins = " ".join(f"JOIN hit h{j} ON h{j}.r = h0.r AND h{j}.at = h0.at + {j} AND h{j}.sid = '{sid}' AND h{j}.place - h{j - 1}.place <= {licenses.GAP + 1}" for j, sid in enumerate(ids) if j)
        rules.append(f"SELECT h0.r, h0.doc_id, h0.at, '{name}' AS license, {k} AS rule, {len(ids)} AS n, h0.place AS first_sentence, h{len(ids) - 1}.place AS last_sentence FROM hit h0 {joins} WHERE h0.sid = '{ids[0]}'")
    text = f"""
WITH known(s, sid) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(text, '{licenses.CUT}') AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT r, doc_id, i AS place, lower(trim(regexp_replace(s[i + 1], '{licenses.NOT_WORD}', ' ', 'g'))) AS s FROM (SELECT r, doc_id, s, unnest(range(len(s))) AS i FROM d)),
hit AS (SELECT r, doc_id, CAST(place AS INT) AS place, sid, row_number() OVER (PARTITION BY r ORDER BY place) AS at FROM c JOIN known USING (s)),
m AS ({" UNION ALL ".join(rules)}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, at ORDER BY n DESC, rule) AS k FROM m) WHERE k = 1)
SELECT doc_id, license, CAST(rule AS INT) AS rule, first_sentence, last_sentence FROM best b
WHERE NOT EXISTS (SELECT 1 FROM best o WHERE o.r = b.r AND o.at < b.at AND o.at + o.n >= b.at + b.n)
"""
    return text.replace(".at", '."at"').replace(" AS at", ' AS "at"').replace(" at ORDER", ' "at" ORDER')


ORACLES = {"op1_ngram_join": OP1, "op3_mixing": OP3, "op4_quality_rules": OP4, "op5_license_scan": _op5()}
