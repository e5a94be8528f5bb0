"""DuckDB statements for the queries that SQL can express, from their definitions."""

from __future__ import annotations

from churnlens.llm.mixing import OFFSETS, SEED, UNIT

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format('text'))} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_ALNUM.format(_LOWER.format('text'))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, s, s + least(len(w), 13) - 1) AS words
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS words
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, item, s, n FROM dw JOIN bw USING (n, words)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size FROM documents),
s AS (SELECT source, place, source_size, n_docs, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM (
        SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
               row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source)),
-- share by weight, cap who is above, share the rest again
share AS (
  SELECT 0 AS turn, place, FALSE AS capped, (SELECT sum(source_size) FROM s) AS rest, (SELECT sum(weight) FROM s) AS open_weight,
         weight, source_size FROM s
  UNION ALL
  SELECT turn + 1, place, capped_now, (total - sum(CASE WHEN capped_now THEN 3 * source_size ELSE 0 END) OVER ())::HUGEINT,
         (sum(CASE WHEN capped_now THEN 0 ELSE weight END) OVER ())::HUGEINT, weight, source_size
  FROM (SELECT *, capped OR rest * weight > 3 * source_size * open_weight AS capped_now, sum(source_size) OVER () AS total FROM share)
  WHERE turn < (SELECT count(*) FROM s)
),
t AS (SELECT s.*, CASE WHEN capped THEN (3 * s.source_size)::DOUBLE
                       ELSE rest::DOUBLE * s.weight / open_weight::DOUBLE END AS target
      FROM s JOIN share USING (place) WHERE turn = (SELECT max(turn) FROM share)),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT})::BIGINT ELSE 0 END AS step,
                ('0x' || substr(md5(CASE WHEN source IS NULL THEN '{SEED}:' ELSE '{SEED}=' || source END), 1, 12))::BIGINT
                  % {UNIT} AS first_offset FROM t),
placed AS (SELECT d.doc_id, d.size, p.*, row_number() OVER (PARTITION BY p.place ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS k
           FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
tried AS (SELECT *, (((k % {UNIT}) * (step % {UNIT}) + first_offset + o * {UNIT // OFFSETS}) % {UNIT} + step) // {UNIT} AS copies
          FROM placed, range({OFFSETS}) r(o)),
best AS (SELECT place, o FROM (SELECT place, o, row_number() OVER (
           PARTITION BY place ORDER BY abs(sum(copies * size)::DOUBLE - any_value(target)), o) AS n FROM tried GROUP BY place, o)
         WHERE n = 1)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM tried JOIN best USING (place, o)
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, source, lang, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
                  hex(encode(coalesce(text, ''))) AS h FROM documents),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
  FROM range(256) r(i))),
summed AS (SELECT d.* EXCLUDE (h), xor(list_reduce(
    list_transform(range(0, length(h), 2), lambda p: ('0x' || substr(h, p + 1, 2))::BIGINT),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS crc FROM d, crc_table),
n AS (SELECT count(*) AS n FROM d),
cells AS (
  SELECT summed.*, sc, lc, least((length(bin(size)) - 1) * 8 + (size * 8 // pow(2, length(bin(size)) - 1)::BIGINT) % 8, 255) AS zc
  FROM summed
  JOIN (SELECT source AS s, (coalesce(sum(count(*)) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               * 256 // (SELECT n FROM n))::BIGINT AS sc FROM d GROUP BY source) a ON a.s IS NOT DISTINCT FROM source
  JOIN (SELECT lang AS l, (coalesce(sum(count(*)) OVER (ORDER BY lang NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               * 256 // (SELECT n FROM n))::BIGINT AS lc FROM d GROUP BY lang) b ON b.l IS NOT DISTINCT FROM lang),
turned AS (SELECT *, list_reduce(list_transform(range(21), lambda k: [k]), lambda x, kk: [
    xor(x[1], CASE WHEN x[kk[1] % 3 + 1] & (1 << (7 - kk[1] // 3)) != 0 THEN (1 << (7 - kk[1] // 3)) - 1
                   ELSE xor(x[1], x[kk[1] % 3 + 1]) & ((1 << (7 - kk[1] // 3)) - 1) END),
    xor(x[2], CASE WHEN kk[1] % 3 = 1 AND x[2] & (1 << (7 - kk[1] // 3)) = 0
                   THEN xor(x[1], x[2]) & ((1 << (7 - kk[1] // 3)) - 1) ELSE 0 END),
    xor(x[3], CASE WHEN kk[1] % 3 = 2 AND x[3] & (1 << (7 - kk[1] // 3)) = 0
                   THEN xor(x[1], x[3]) & ((1 << (7 - kk[1] // 3)) - 1) ELSE 0 END)],
    [sc, lc, zc]) AS x FROM cells),
coded AS (SELECT *, x[1] AS g1, xor(x[1], x[2]) AS g2, xor(xor(x[1], x[2]), x[3]) AS g3 FROM turned),
flipped AS (SELECT *, list_reduce([g3 >> 1, g3 >> 2, g3 >> 3, g3 >> 4, g3 >> 5, g3 >> 6, g3 >> 7], lambda a, b: xor(a, b)) AS f FROM coded),
curved AS (SELECT *, list_sum(list_transform(range(8), lambda b:
    (((xor(g1, f) >> b) & 1) << (3 * b + 2)) + (((xor(g2, f) >> b) & 1) << (3 * b + 1)) + (((xor(g3, f) >> b) & 1) << (3 * b)))) AS curve
  FROM flipped),
placed AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id NULLS LAST) - 1 AS p FROM curved)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (p * 8 // (SELECT n FROM n))::INTEGER AS shard,
       p - ((p * 8 // (SELECT n FROM n)) * (SELECT n FROM n) + 7) // 8 AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, s, s + least(len(w), 3) - 1) AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY shingle) AS shingle FROM g),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM numbered a JOIN numbered b
          ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN parts USING (doc_id)
"""

_ESCAPED = "replace(coalesce({}, ''), '\\', '\\\\')"
for _control, _code in zip(("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"), "abcdef"):
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '\\{_code}')"

_OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS taught,
             sum(length('<s>') + length(replace({_ESCAPED.format('role')}, chr(10), '\\n')) + 1 + length({_ESCAPED.format('text')})
                 + length('</s>')) AS n
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(taught)::BIGINT AS loss_chars, sha256(taught) AS loss_sha256,
       n::BIGINT AS formatted_chars FROM g
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
k AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
first_doc AS (SELECT h, min(doc_id) AS first_id FROM k GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT doc_id, unnest(range(s, s + 50)) AS p FROM k JOIN first_doc USING (h) WHERE doc_id > first_id)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page IS NULL OR first_page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_page = page_id THEN NULL ELSE first_page END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_OP9 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
k AS (SELECT *, {_LOWER.format(_STRIP.format('line'))} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(k.doc_id > first_id, FALSE) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# steps as text: 0 and the sibling to the right, 1 and the sibling to the left, 2 for none
_STEP = "CASE WHEN o.node IS NULL THEN '2' ELSE (t.slot % 2)::VARCHAR || o.node END"

_OP12 = f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
  FROM range(256) r(i))),
d AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS crc
      FROM documents, crc_table),
l AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
             CASE WHEN crc % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS tampered FROM d),
s AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS run, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM l),
t AS (SELECT 0 AS level, run, slot, n, leaf AS node FROM s
      UNION ALL
      SELECT level + 1, run, slot // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY slot)) FROM t WHERE n > 1
      GROUP BY level, run, slot // 2, n),
u AS (SELECT 0 AS level, run AS slot, (SELECT count(DISTINCT run) FROM s) AS n, node FROM t WHERE n = 1
      UNION ALL
      SELECT level + 1, slot // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY slot)) FROM u WHERE n > 1
      GROUP BY level, slot // 2, n),
low AS (SELECT s.run, s.slot, list({_STEP} ORDER BY t.level) AS steps
        FROM s JOIN t ON t.run = s.run AND t.slot = s.slot >> t.level AND t.n > 1
        LEFT JOIN t o ON o.run = t.run AND o.level = t.level AND o.slot = xor(t.slot, 1) GROUP BY ALL),
up AS (SELECT r.run, list({_STEP} ORDER BY t.level) AS steps
       FROM (SELECT DISTINCT run FROM s) r JOIN u t ON t.slot = r.run >> t.level AND t.n > 1
       LEFT JOIN u o ON o.level = t.level AND o.slot = xor(t.slot, 1) GROUP BY ALL),
p AS (SELECT s.*, list_concat(coalesce(low.steps, []), coalesce(up.steps, [])) AS steps
      FROM s LEFT JOIN low USING (run, slot) LEFT JOIN up USING (run)),
f AS (SELECT p.*, sha256(coalesce(array_to_string(list_transform(list_filter(steps, lambda x: x <> '2'), lambda x: x[2:]), ''), '')) AS proof_sha256,
             list_reduce(steps, lambda a, x: sha256(CASE x[1] WHEN '0' THEN a || x[2:] WHEN '1' THEN x[2:] || a ELSE a END),
                         tampered) AS folded_root FROM p)
SELECT doc_id, leaf, t.node AS subroot, u.node AS root, proof_sha256, folded_root, folded_root = u.node AS verified
FROM f JOIN t ON t.run = f.run AND t.n = 1 JOIN u ON u.n = 1
"""

_OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": _OP1, "op2_mix": _OP2, "op3_shard": _OP3, "op4_neardup": _OP4, "op5_chat": _OP5,
    "op6_substrings": _OP6, "op7_warc": _OP7, "op9_lines": _OP9,
    "op12_merkle": _OP12, "op13_hardneg": _OP13,
}
