"""SQL for DuckDB that asks the same as some of the queries."""

from __future__ import annotations

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 3 * source_size AS bound,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
  FROM sums
), prefixes AS (
  SELECT *,
         (sum(source_size) OVER ())::BIGINT AS total,
         (sum(weight) OVER ())::BIGINT AS weights,
         coalesce(sum(bound) OVER before, 0)::BIGINT AS bounds_before,
         coalesce(sum(weight) OVER before, 0)::BIGINT AS weights_before
  FROM weighted
  WINDOW before AS (ORDER BY bound::DOUBLE / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(bound::DOUBLE,
               max((total - bounds_before)::DOUBLE / (weights - weights_before)) OVER () * weight
         ) AS target
  FROM prefixes
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM rated
"""


OP4 = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM rows
), windows AS (
  SELECT r, i, words[i : i + 7] AS eight
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM cut)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, eight) > 1
), covered AS (
  SELECT r, count(DISTINCT i + j) AS n
  FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY r
), measured AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaim,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered,
         len(list_filter(range(2, len(words) + 1), lambda x: words[x] = words[x - 1])) AS n_same
  FROM cut LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
         + 4 * (100 * n_symbols > 30 * n_words)::BIGINT
         + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
         + 16 * (100 * n_upper > 60 * n_letters)::BIGINT
         + 32 * (100 * n_exclaim > 50 * n_words)::BIGINT
         + 64 * (100 * n_lettered < 50 * n_words)::BIGINT
         + 128 * (100 * n_same > 30 * n_words)::BIGINT
         + 256 * (word_chars > 20 * n_words)::BIGINT
         + 512 * (2 * word_chars < 4 * n_words)::BIGINT AS failed
  FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed = 0 AS kept, failed::BIGINT AS failed
FROM judged
"""


OP11 = r"""
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])), 0)::BIGINT
           AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.r <> b.r
  WHERE a.label IS NOT NULL AND b.label IS NOT NULL
), positives AS (
  SELECT anchor, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor, p.r
                           ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r))::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


OP13 = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
           list_concat([n], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hashes AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(
           list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), bits
), numbered AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT c, 0 AS part, place, said FROM hashes JOIN numbered ON conv_id = base AND place <= h
  UNION ALL
  SELECT c, 1, place, said FROM hashes JOIN numbered ON conv_id = c AND place > h
), told AS (
  SELECT hashes.c, coalesce(said, []) AS said
  FROM hashes
  LEFT JOIN (SELECT c, list(said ORDER BY part, place) AS said FROM rebuilt GROUP BY c) s ON s.c = hashes.c
), steps AS (
  SELECT c, d AS depth, len(said) = d AS ends, said[1 : d] AS path
  FROM (SELECT c, said, unnest(range(len(said) + 1)) AS d FROM told)
), nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY path, depth
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[1 : n.depth] = n.path)
           AS n_children,
         (n.n_convs - 1) * coalesce(octet_length(encode(n.path[n.depth].t)), 0) AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1 : n.depth - 1]
), sums AS (
  SELECT path[1 : d] AS top, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
         sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY top
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums ON top = path
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": OP4,
        "op6_mixing": OP6,
        "op11_hard_negatives": OP11,
        "op13_prefix_trie": OP13,
    }
