"""DuckDB SQL of the operators that SQL can express."""

#: Temperature mixing with MixConfig()'s defaults: two bisections as recursions, then cuts by running sums.
TEMPERATURE_MIX = r"""
WITH RECURSIVE n AS (SELECT greatest(256, floor(sqrt(count(*)))::BIGINT) blocks FROM documents),
d AS (SELECT doc_id, source, coalesce(source, 'null') named, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) tokens, coalesce(doc_id::VARCHAR, 'null') ident FROM documents),
p AS (SELECT *, ('0x' || substr(md5('mix-doc|' || ident), 1, 12))::BIGINT at_doc, ('0x' || substr(md5('mix-deal|' || ident), 1, 12))::BIGINT % (SELECT blocks FROM n) block_no FROM d),
q AS (SELECT *, ('0x' || substr(md5('mix-block|' || named || '|' || block_no), 1, 12))::BIGINT at_block FROM p),
src AS (SELECT source, sum(tokens)::BIGINT tokens FROM q GROUP BY 1),
tot AS (SELECT sum(tokens)::BIGINT total, list(tokens ORDER BY tokens) FILTER (tokens > 0) counts FROM src),
sh AS (SELECT total, list_transform(counts, lambda c: c::DOUBLE / total::DOUBLE) s, ln(len(counts)::DOUBLE) * 0.95::DOUBLE target FROM tot),
flat AS (SELECT 0 i, 0.0::DOUBLE lo, 1.0::DOUBLE hi UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT i, lo, hi, mid, ln(z) - mid * w / z >= target ok FROM
    (SELECT i, lo, hi, mid, target, list_sum(list_transform(s, lambda x: pow(x, mid))) z, list_sum(list_transform(s, lambda x: pow(x, mid) * ln(x))) w FROM (SELECT i, lo, hi, (lo + hi) / 2 mid FROM flat WHERE i < 48), sh))),
tame AS (SELECT 0 i, 0.0::DOUBLE lo, 1.0::DOUBLE hi UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END FROM (SELECT i, lo, hi, mid, pow(list_min(s), mid - 1) / list_sum(list_transform(s, lambda x: pow(x, mid))) > 4.0 AS over FROM (SELECT i, lo, hi, (lo + hi) / 2 mid FROM tame WHERE i < 48), sh)),
a AS (SELECT total, s, CASE WHEN len(s) < 2 THEN 1.0::DOUBLE ELSE round(greatest(
    CASE WHEN -list_sum(list_transform(s, lambda x: x * ln(x))) >= target THEN 1.0::DOUBLE ELSE (SELECT lo FROM flat WHERE i = 48) END,
    CASE WHEN pow(list_min(s), -1) / len(s) <= 4.0 THEN 0.0::DOUBLE ELSE (SELECT hi FROM tame WHERE i = 48) END), 6) END alpha FROM sh),
b AS (SELECT total, alpha, list_sum(list_transform(s, lambda x: pow(x, alpha))) z FROM a),
plan AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN floor(round(pow(tokens::DOUBLE / total::DOUBLE, alpha) / z, 9) * total::DOUBLE + 0.5)::BIGINT ELSE 0 END quota FROM src, b),
cp AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END copies, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END remainder FROM plan),
blk AS (SELECT source, at_block, sum(tokens)::BIGINT tokens FROM q GROUP BY 1, 2),
reach AS (SELECT blk.*, remainder, sum(blk.tokens) OVER (PARTITION BY blk.source ORDER BY at_block) upto FROM blk JOIN cp ON cp.source IS NOT DISTINCT FROM blk.source),
cut AS (SELECT source, min(at_block) cut_block, arg_min(remainder - upto + tokens, at_block) room FROM reach WHERE upto > remainder GROUP BY 1),
ins AS (SELECT q.source, room, at_doc, sum(tokens) tokens FROM q JOIN cut ON cut.source IS NOT DISTINCT FROM q.source AND at_block = cut_block WHERE room > 0 GROUP BY 1, 2, 3),
stop AS (SELECT source, min(at_doc) stop_doc FROM (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY at_doc) upto FROM ins) WHERE upto > room GROUP BY 1),
times AS (SELECT q.doc_id, q.source, copies + CASE WHEN cut_block IS NULL THEN 0 WHEN at_block < cut_block THEN 1 WHEN at_block > cut_block THEN 0 WHEN room <= 0 THEN 0 WHEN stop_doc IS NULL OR at_doc < stop_doc THEN 1 ELSE 0 END k
  FROM q JOIN cp ON cp.source IS NOT DISTINCT FROM q.source LEFT JOIN cut ON cut.source IS NOT DISTINCT FROM q.source LEFT JOIN stop ON stop.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, unnest(range(0, k)) epoch FROM times WHERE k > 0
"""

#: Prefix-target expansion: lengths of all prefixes that end in a reply, and digests of what they hold.
PREFIX_TARGETS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, row_number() OVER w i, count(*) OVER (PARTITION BY conv_id) n,
  sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1) OVER (w ROWS UNBOUNDED PRECEDING) upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT formatted_chars
FROM t GROUP BY conv_id
"""

#: Importance resampling with ResampleConfig()'s defaults; CRC-32 by its byte table, once a distinct word.
IMPORTANCE_RESAMPLING = r"""
WITH tab AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM (SELECT unnest(range(256)) i))),
words AS (SELECT 1 side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w FROM documents
  UNION ALL SELECT 2, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
spelt AS (SELECT w, hex(w) x FROM (SELECT DISTINCT w FROM words)),
crc AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 bucket FROM spelt, tab),
n AS (SELECT bucket, count(*) FILTER (side = 1) s, count(*) FILTER (side = 2) t FROM words JOIN crc USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT gain FROM n),
d AS (SELECT doc_id, count(*) n_features, sum(gain)::BIGINT weight FROM words JOIN crc USING (w) JOIN gain USING (bucket) WHERE side = 1 GROUP BY 1),
sc AS (SELECT doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT score
  FROM (SELECT doc_id FROM documents) LEFT JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 drawn FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM r
"""
