"""DuckDB SQL for the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from .rules import MARKS, RULES, STOP_WORDS, SYMBOLS

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _quality() -> str:
    checks = " AND ".join(
        f"(CASE WHEN {w} = 0 THEN 0.0::DOUBLE ELSE {r.part}::DOUBLE / {w} END) BETWEEN {r.low}::DOUBLE AND {r.high}::DOUBLE" for r in RULES for w in ["1" if r.whole == "one" else r.whole]
    )
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    chars = lambda found: f"(length(body) - length(regexp_replace(body, '[{found}]', '', 'g')))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '{WORD}') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
wins AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win
         FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) >= 2),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(body, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
             {chars(SYMBOLS)} AS n_symbols, {chars(MARKS)} AS n_marks, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: length(x) <= 6 AND lower(rtrim(x, '.,!')) IN ({stop})))::BIGINT AS n_stop,
             len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1]))::BIGINT AS n_echo
      FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {checks} AS kept FROM b"""


EXACT = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)"""

_HASH = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                            floor({_HASH.format("'mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))")} * 4096)::BIGINT AS step FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
fill(round, shares) AS (
  SELECT 0, (SELECT list({{'source': source, 'size': source_size, 'w': w, 'target': NULL::DOUBLE}}) FROM s)
  UNION ALL
  SELECT round + 1, list_transform(shares, lambda x: CASE
           WHEN x.target IS NULL AND 2.0 * x.size * list_sum(list_transform(list_filter(shares, lambda y: y.target IS NULL), lambda y: y.w))
                <= (1.5 * list_sum(list_transform(shares, lambda y: y.size)) - coalesce(list_sum(list_transform(shares, lambda y: y.target)), 0)) * x.w
           THEN {{'source': x.source, 'size': x.size, 'w': x.w, 'target': (2.0 * x.size)::DOUBLE}} ELSE x END)
  FROM fill WHERE round <= len(shares)),
capped AS (SELECT unnest(shares, recursive := true) FROM (SELECT shares FROM fill ORDER BY round DESC LIMIT 1)),
t AS (SELECT source, size AS source_size, coalesce(target,
        (1.5::DOUBLE * (SELECT sum(size) FROM capped) - coalesce((SELECT sum(target) FROM capped), 0)) * w / (SELECT sum(w) FROM capped WHERE target IS NULL)) AS target
      FROM capped),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate FROM t),
won AS (SELECT source, step + 1 AS stop, sum(sum(size)) OVER (PARTITION BY source ORDER BY step) AS words FROM d GROUP BY source, step
        UNION ALL SELECT source, 0, 0 FROM s),
best AS (SELECT r.*, arg_min(stop, {{'miss': abs(words - (rate - floor(rate)) * source_size), 'stop': stop}}) AS stop
         FROM won JOIN r ON won.source IS NOT DISTINCT FROM r.source GROUP BY ALL)
SELECT d.doc_id, d.size, best.source_size, best.target, (d.size * (floor(rate) + (d.step < best.stop)::INT))::BIGINT AS taken
FROM d JOIN best ON d.source IS NOT DISTINCT FROM best.source"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '{ENDS}', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, min(doc_id) AS home FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, home IS NOT NULL AND doc_id <> home AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r"""

QUALITY = _quality()

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha256(body)) AS response FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM h"""

CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
a AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns, count(*) AS n FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT md5(turns[1:k]::VARCHAR) AS key FROM (SELECT turns, unnest(range(1, n)) AS k FROM a)),
m AS (SELECT min(conv_id) AS conv_id, any_value(turns) AS turns, any_value(n) AS n_turns, count(*) AS n_logs
      FROM a GROUP BY md5(turns::VARCHAR)
      HAVING md5(any_value(turns)::VARCHAR) NOT IN (SELECT key FROM p)),
s AS (SELECT *, unnest(range((n_turns + 255) // 256)) AS segment FROM m)
SELECT conv_id, segment, n_turns, n_logs, 256 * segment + 1 AS first_turn, least(256, n_turns - 256 * segment) AS turns,
       array_to_string(list_transform(turns[256 * segment + 1 : 256 * segment + 256], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10)), '') AS rendered
FROM s"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
wins AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
         FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY h) >= 2),
gone AS (SELECT DISTINCT r, i + k AS pos FROM twice, (SELECT unnest(range(35)) AS k)),
w AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM w ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(size, 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (size + v)::HUGEINT)::BIGINT AS p,
             (1 + (1000000000::HUGEINT * (total + 1)) // (lang_size + v)::HUGEINT)::BIGINT AS q
      FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

INTERACTIONS = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(body, '{WORD}') AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM d),
m AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body))::INT
             + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS here, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, here,
             sum(CASE WHEN failed & (here | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failed & here <> 0 AND failed & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN failed & here <> 0 AND failed & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = here THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN failed & here <> 0 AND failed & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failed & here <> 0 AND failed & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM h, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley FROM r"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(rule_host, rule_path, said) AS (VALUES {listed}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
best AS (SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
         FROM s JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM s LEFT JOIN best USING (r)"""
