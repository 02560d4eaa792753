"""SQL that gives the operators' results, or those of their columns that SQL can say, on the same tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"


def _words(column: str) -> str:
    return f"regexp_extract_all({column}, '{_WORD}')"


#: Shingles of every text, links by exact overlaps, and the closure of the links.
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id"""

#: Sizes and checksums of sharding; its slots have no gaps.
SHARD_SIZES = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, 'bytes' AS law FROM documents"

#: The counts and the unigram base of LM scoring, for documents held out by doc_id modulo 7.
UNIGRAM_BASE = f"""WITH t AS (SELECT doc_id, unnest(list_append({_words(_LOWER)}, ' ')) AS w FROM documents),
c AS (SELECT w, count(*) AS c FROM t WHERE doc_id % 7 <> 2 GROUP BY w),
g AS (SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS words FROM c)
SELECT doc_id, doc_id % 7 = 2 AS held_out, count(*) AS n_tokens, count(c.w) AS n_known, any_value(total) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1e0) / (total + words + 1))), 5) AS base_score FROM t LEFT JOIN c ON c.w = t.w, g GROUP BY doc_id"""

#: Windows of 100 bytes that also start earlier, the spans they cover, and what is left between these.
REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(b[p:p + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
k AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 100 THEN 0 ELSE 1 END AS new FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM k) GROUP BY doc_id, i),
x AS (SELECT doc_id, a, e FROM s UNION ALL SELECT doc_id, n + 1, n + 1 FROM d),
y AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a, e), 1) AS at FROM x),
z AS (SELECT y.doc_id, string_agg(CASE WHEN y.a > y.at THEN hex(b[y.at:y.a - 1]) ELSE '' END, '' ORDER BY y.a, y.e) AS kept, CAST(sum(y.e - y.a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans FROM y JOIN d ON d.doc_id = y.doc_id GROUP BY y.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN z ON z.doc_id = d.doc_id"""

#: Targets of a mix by the closed form: sources in order of cap / weight, the first whose cap isn't reached sets the level.
MIX_TARGETS = f"""WITH d AS (SELECT source, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, ([5e0, 2e0, 1e0])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight, 3e0 * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER a, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER a, 0)) AS level FROM w WINDOW a AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, cap / weight) AS level FROM v WHERE cap > level * weight)
SELECT source, CAST(source_size AS BIGINT) AS source_size, round(CASE WHEN cap > f.level * weight THEN f.level * weight ELSE cap END, 3) AS target, n FROM v, f"""

#: All counts of the quality rules, the hosts' rates against the prior of their moments, and the verdict.
QUALITY = f"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id, line),
lines AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_lines, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines FROM ll GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM gg WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM cover GROUP BY doc_id),
m AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols > 0.1e0 * word_chars OR n_dup_lines > 0.3e0 * n_lines AS soft_failed, n_symbols > 0.2e0 * word_chars OR n_dup_lines > 0.6e0 * n_lines AS strong_failed FROM m),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed OR soft_failed) AS DOUBLE) AS failed FROM r GROUP BY host),
z AS (SELECT sum(n / (n + 20)) AS s, sum(n / (n + 20) * failed / n) AS a, sum(n / (n + 20) * (failed / n) * (failed / n)) AS q FROM h),
p AS (SELECT a / s AS m, greatest(q / s - (a / s) * (a / s), 0) AS v FROM z),
b AS (SELECT m, least(greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, 1e6), 1), 1e6) AS k FROM p),
j AS (SELECT host, n, m, k, (failed + m * k) / (n + k) AS rate FROM h, b),
i AS (SELECT host, rate, m, rate - 2e0 * sqrt(greatest(rate * (1 - rate), 0) / (n + k + 1)) AS low FROM j)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT strong_failed AND NOT (soft_failed AND low * (1 - m) > 2e0 * m * (1 - low)) AS kept, round(rate, 9) AS host_rate FROM r JOIN i ON r.host IS NOT DISTINCT FROM i.host"""
