"""DuckDB SQL for the corpus queries, over the same tables."""

#: Words of a text, for DuckDB.
WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

SQL = {}

SQL["op2_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(text, '')) AS content FROM documents),
q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS quality FROM labels GROUP BY doc_id),
b AS (
  SELECT d.*, -ln((('0x' || left(md5(concat(coalesce(d.doc_id::VARCHAR, ''), chr(31), content)), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(quality, 1.0::DOUBLE) AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS size FROM b GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * size AS cap FROM s),
f AS (
  SELECT *, (sum(size) OVER () - coalesce(sum(cap) OVER lo, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER lo, 0))::DOUBLE AS level
  FROM w WINDOW lo AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM f WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, size AS source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l) * weight, cap::DOUBLE)) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT *, round(target - epochs * source_size)::BIGINT AS budget FROM e),
r AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, g.epochs, g.budget,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY key, b.doc_id, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, budget - run)))::BIGINT AS taken FROM r"""

SQL["op5_line_dedup"] = """
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place, row_id
  FROM (SELECT *, row_number() OVER () AS row_id FROM documents)),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
h AS (SELECT source, bare, count(DISTINCT row_id) AS pages FROM k WHERE bare <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT h.source, h.bare, true AS bad FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source WHERE pages >= 3 AND pages > 0.05::DOUBLE * total),
m AS (SELECT k.*, coalesce(b.bad, false) AS bad FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.bare = b.bare),
o AS (SELECT row_id, doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT bad), '') AS kept FROM m GROUP BY ALL)
SELECT doc_id, n_lines, n_dropped, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM o
UNION ALL SELECT doc_id, 0, 0, NULL, sha256('') FROM documents WHERE text IS NULL"""

SQL["op9_near_duplicates"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT g.b, r.seen FROM r JOIN g ON g.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

SQL["op10_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {WORDS} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
k AS (SELECT row_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS k FROM w WHERE len(words) >= 3),
v AS (SELECT row_id, i FROM k QUALIFY count(*) OVER (PARTITION BY row_id, k) > 1),
c AS (SELECT row_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM v) GROUP BY row_id),
m AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (row_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (n_words < 50)::INT + (100 * n_repeat_words > 50 * n_words)::INT + (word_chars < 3 * n_words)::INT + (word_chars > 12 * n_words)::INT + (10 * n_symbols > n_words)::INT + (100 * n_dup_lines > 30 * n_words)::INT AS rules_failed
  FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (rules_failed > 0) AS failed FROM f GROUP BY source),
a AS (SELECT sum(failed)::DOUBLE AS f, sum(docs)::DOUBLE AS d, sum(failed * failed / docs::DOUBLE) AS sq, count(*) AS hosts FROM h),
b AS (SELECT f / greatest(d, 1) AS p, (sq - d * (f / greatest(d, 1)) * (f / greatest(d, 1)) - greatest(hosts - 1, 0) * (f / greatest(d, 1)) * (1 - f / greatest(d, 1))) / greatest(d, 1) AS between FROM a),
q AS (SELECT p, greatest(20.0::DOUBLE, CASE WHEN between > 0 THEN least(p * (1 - p) / between - 1, 1e6::DOUBLE) ELSE 1e6::DOUBLE END) AS weight FROM b),
j AS (SELECT source, round((failed + p * weight) / (docs + weight), 9) AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.6::DOUBLE AS kept, rules_failed, host_rate
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source"""

#: Words of letters and digits, A-Z as a-z, as the contamination rule takes them.
PLAIN = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

SQL["op3_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {PLAIN} AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {PLAIN} AS words FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT DISTINCT item, least(13, len(words)) AS n, unnest(list_transform(range(1, len(words) - least(13, len(words)) + 2), lambda i: array_to_string(words[i:i + least(13, len(words)) - 1], ' '))) AS k
  FROM b WHERE len(words) > 0),
n AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT row_id, n.n, unnest(range(1, len(words) - n.n + 2)) AS i, unnest(list_transform(range(1, len(words) - n.n + 2), lambda i: array_to_string(words[i:i + n.n - 1], ' '))) AS k
  FROM d, n WHERE len(words) >= n.n),
m AS (SELECT row_id, i, g.n, item FROM g JOIN w ON g.n = w.n AND g.k = w.k),
c AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY row_id),
t AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM m) GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (row_id) LEFT JOIN t USING (row_id)"""

SQL["op4_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS first FROM p GROUP BY payload),
h AS (SELECT p.page_id, strlen(p.payload) AS payload_bytes, sha1(p.payload) AS hex, g.first FROM p JOIN g USING (payload))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h"""

SQL["op6_format_chats"] = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '(<|\[)(\\*)(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|/INST\]|INST\])', '\1\\\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(role) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

SQL["op8_repeated_substrings"] = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS words FROM documents),
w AS (SELECT row_id, unnest(range(1, len(words) - 33)) AS i, unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS k FROM d WHERE len(words) >= 35),
r AS (SELECT row_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
c AS (SELECT DISTINCT row_id, unnest(range(i, i + 35)) AS place FROM r),
x AS (SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
k AS (SELECT row_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM x ANTI JOIN c USING (row_id, place) GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row_id)"""

#: CRC-32 of a list of bytes `b`, for DuckDB: after each byte the register is shifted eight times.
CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform({b}, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"

SQL["op13_periodic_runs"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS words,
    {CRC32.format(b="list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} AS h FROM documents),
p AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN h // 10 % len(words) END AS a FROM d),
q AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM p),
t AS (SELECT row_id, doc_id, CASE WHEN a IS NULL THEN words ELSE list_transform(range(0, n), lambda i: words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) END AS words FROM q),
w AS (SELECT row_id, len(words) AS n, unnest(range(0, len(words))) AS i, unnest(words) AS word FROM t),
m AS (SELECT row_id, i, word, n FROM w QUALIFY count(*) OVER (PARTITION BY row_id, word) >= 4),
e AS (SELECT x.row_id, y.i - x.i AS period, x.i - row_number() OVER (PARTITION BY x.row_id, y.i - x.i ORDER BY x.i) AS island, x.i FROM m x JOIN m y ON x.row_id = y.row_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT row_id, period, min(i) AS start, count(*) + period AS length FROM e GROUP BY row_id, period, island HAVING count(*) + period >= greatest(6, 4 * period)),
r AS (SELECT row_id, start, length, min(period) AS period FROM s GROUP BY ALL),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
l AS (SELECT row_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM r GROUP BY row_id),
o AS (SELECT DISTINCT row_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT row_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN o USING (row_id, i) GROUP BY row_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (row_id) LEFT JOIN l USING (row_id) LEFT JOIN k USING (row_id)"""

SQL["op12_resample"] = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {PLAIN} AS words FROM documents),
b AS (SELECT {PLAIN} AS words FROM benchmark),
x AS (SELECT row_id, words FROM d UNION ALL SELECT NULL, words FROM b),
f AS (
  SELECT row_id, unnest(words) AS feature FROM x
  UNION ALL SELECT row_id, unnest(list_transform(range(1, len(words)), lambda i: concat(words[i], ' ', words[i + 1]))) FROM x WHERE len(words) > 1
  UNION ALL SELECT row_id, unnest(list_transform(range(1, len(words) - 1), lambda i: concat(words[i], ' ', words[i + 1], ' ', words[i + 2]))) FROM x WHERE len(words) > 2),
n AS (SELECT row_id, feature, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT feature, hex(feature) AS bytes FROM n),
h AS (SELECT feature, {CRC32.format(b="list_transform(range(0, strlen(feature)), lambda i: ('0x' || substr(bytes, (2 * i + 1)::BIGINT, 2))::BIGINT)")} % 10000 AS bucket FROM u),
m AS (SELECT row_id, bucket, sum(n)::BIGINT AS n FROM n JOIN h USING (feature) GROUP BY ALL),
a AS (SELECT bucket, coalesce(sum(n) FILTER (row_id IS NOT NULL), 0)::BIGINT AS s, coalesce(sum(n) FILTER (row_id IS NULL), 0)::BIGINT AS t FROM m GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM a),
w AS (SELECT row_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM m JOIN g USING (bucket) WHERE row_id IS NOT NULL GROUP BY row_id),
s AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256(concat('42:', doc_id)), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (row_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS most FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM r"""
