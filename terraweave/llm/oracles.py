"""DuckDB SQL for the queries whose rows SQL can say: op4, op5, op8 and op10.

The mix draws random numbers, fingerprints need XXH64, tokens need a tokenizer and the two classifiers
their training, so op1, op2, op3, op6, op7 and op9 have none.
"""

from __future__ import annotations

from terraweave.llm import feistel, line_quality

WORDS = r"'[^\x20\x09-\x0D]+'"


def suffix_dedup(length: int = 50) -> str:
    """Every string of ``length`` bytes with the smallest document it starts in."""
    return f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM d),
 s AS (SELECT doc_id, i, hex(b[i:i]) AS x, CASE WHEN i + {length - 1} <= octet_length(b) THEN b[i:i + {length - 1}] END AS s FROM p),
 m AS (SELECT doc_id, i, x, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS twin FROM s),
 c AS (SELECT doc_id, i, x, bool_or(twin) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
 e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM c),
 g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
 SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
 FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def line_rules() -> str:
    q = line_quality
    text = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    count = lambda pattern: f"len(regexp_extract_all(line, {text(pattern)}))"
    fails = f"""(parts >= 2 AND n < 5 * (parts + 1) OR n <= 30 AND regexp_matches(line, {text(q.BOILERPLATE)})
 OR NOT regexp_matches(line, {text(q.ENDED)}) AND NOT (n >= {q.PARAGRAPH} AND regexp_matches(line, {text(q.INNER_END)})) OR shouts > 1 AND 2 * shouts > n)"""
    around = f"PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {q.WINDOW - 1} FOLLOWING"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, unnest(regexp_extract_all(t, {WORDS})) AS w, generate_subscripts(regexp_extract_all(t, {WORDS}), 1) AS i FROM d),
 v AS (SELECT r, i, CASE WHEN count(*) OVER ({around}) = {q.WINDOW} THEN string_agg(w, ' ') OVER ({around}) END AS v FROM w),
 twin AS (SELECT r, i, v IS NOT NULL AND count(*) OVER (PARTITION BY r, v) > 1 AS twin FROM v),
 rep AS (SELECT r, count(*) FILTER (c) AS n FROM (SELECT r, bool_or(twin) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {q.WINDOW - 1} PRECEDING AND CURRENT ROW) AS c FROM twin) GROUP BY r),
 l AS (SELECT r, line, len(regexp_extract_all(line, {WORDS})) AS n, {count(q.BETWEEN)} AS parts, {count(q.SHOUTS)} AS shouts FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
 lines AS (SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER ({fails}), 0)::BIGINT AS lost FROM l WHERE n > 0 GROUP BY r),
 m AS (SELECT doc_id, len(regexp_extract_all(t, {WORDS})) AS n_words, length(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
 coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_words FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN lines ON d.r = lines.r)
 SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed,
 NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words) AND 100 * lost_words <= {q.MAX_LOST} * n_words AS kept FROM m"""


TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def shards(shards: int, seed: int) -> str:
    """The network's rounds written out, walked by a recursive query; CRC-32 byte by byte."""
    p = feistel.PRIME
    rounds, left, right, m = [], "l0", "r0", ("a", "b")
    for i, k in enumerate(feistel.round_keys(seed), 1):
        rounds.append(f"({right} + {k}) % {p} AS t{i}, ({left} + (t{i} * t{i}) % {p} * t{i} % {p}) % {m[0]} AS r{i}")
        left, right, m = right, f"r{i}", m[::-1]
    net = f"x % a AS l0, x // a AS r0, {', '.join(rounds)}, {left} + {right} * a AS y"
    step = "CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    crc = "list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda z: ('0x' || z)::BIGINT)), lambda c, z: xor(c >> 8, crc[xor(c & 255, z) + 1]))"
    return f"""WITH RECURSIVE bits AS (SELECT k, k AS c, 0 AS n FROM range(256) r(k) UNION ALL SELECT k, {step}, n + 1 FROM bits WHERE n < 8),
 crc AS (SELECT list(c ORDER BY k) AS crc FROM bits WHERE n = 8),
 s AS (SELECT doc_id, octet_length(encode(t))::BIGINT + 1 AS size, xor({crc}, 4294967295)::BIGINT AS text_crc32 FROM (SELECT doc_id, coalesce(text, '') AS t, crc FROM documents, crc)),
 n AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1 AS a FROM (SELECT count(*) AS n FROM documents))),
 o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i FROM s),
 walk AS (SELECT i, n, a, b, y FROM (SELECT *, {net} FROM (SELECT i, i AS x, n, a, b FROM o, n)) UNION ALL SELECT i, n, a, b, y FROM (SELECT *, {net} FROM (SELECT i, n, a, b, y AS x FROM walk WHERE y >= n)))
 SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {shards})::INT AS shard, (y // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM o JOIN walk ON o.i = walk.i WHERE y < n"""
