"""SQL twins of the numbered queries that SQL can express, for DuckDB."""

from __future__ import annotations


def centroids(dimensions: int = 64, clusters: int = 40, rounds: int = 5) -> str:
    """Every round spelled out: distances, nearest centroid, floor of the mean."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM
 (SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, v LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS b FROM
 (SELECT r, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN
 (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM
  (SELECT b.k AS k, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{i}, range(1, {dimensions + 1}) AS t(i) GROUP BY ALL) GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON b.k = c{rounds}.k"""


#: crc32 of a decimal number: bytes and their bits by two nested folds
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len({0}) + 1), lambda k: CAST(ascii({0}[k]) AS BIGINT))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))))"""

#: all pairs of equal words of a text; islands of one lag are diagonals
PERIODIC = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT *, len(w) AS n, {_CRC32.format("s")} AS h FROM t),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM h),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
x AS MATERIALIZED (SELECT r, n, i, w[i + 1] AS w FROM d, unnest(range(n)) AS t(i)),
m AS (SELECT x.r, x.i, x.i - y.i AS lag FROM x JOIN x AS y ON x.r = y.r AND x.w = y.w AND y.i < x.i AND x.i - y.i <= x.n // 2),
islands AS (SELECT r, lag, i, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS island FROM m),
diagonals AS (SELECT r, lag, min(i) - lag AS start, count(*) + lag AS length FROM islands GROUP BY r, lag, island HAVING count(*) >= lag AND count(*) + lag >= 12),
runs AS MATERIALIZED (SELECT r, start, length, min(lag) AS period FROM diagonals GROUP BY ALL),
per AS (SELECT r, count(*) AS n_runs, min(struct_pack(a := -length, b := start, c := period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.b AS BIGINT) AS start, CAST(-best.a AS BIGINT) AS length, CAST(best.c AS BIGINT) AS period,
       CAST(1000 * -best.a // best.c AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""


def perplexity(order: int = 5) -> str:
    """Base measures, the interpolated model over bytes (from hexadecimal digits) order by order, and the bands."""
    space, word = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"
    parts = [f"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents)""",
             """lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
 WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r)""",
             "win AS (SELECT r, i, w[i : i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i))",
             """rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win), range(0, 3) AS t(k) WHERE c > 1 GROUP BY r)""",
             """b AS MATERIALIZED (SELECT d.*, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
 FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r))""",
             "units AS (SELECT r, regexp_extract_all(hex(encode(' ' || array_to_string(w, ' '))), '..') AS u FROM d WHERE len(w) > 0)",
             "bytes AS (SELECT r, unnest(list_transform(u, lambda x: CAST('0x' || x AS BIGINT))) AS b, generate_subscripts(u, 1) AS i FROM units)",
             f"""grams AS MATERIALIZED (SELECT r, g FROM (SELECT r, i, {' + '.join(f'lag(b, {j}) OVER one * {256 ** j}' for j in range(order))} AS g
 FROM bytes WINDOW one AS (PARTITION BY r ORDER BY i)) WHERE i >= {order})""",
             f"g{order} AS MATERIALIZED (SELECT g, count(*) AS c FROM grams GROUP BY g)"]
    for k in range(order - 1, 0, -1):
        parts.append(f"g{k} AS MATERIALIZED (SELECT g % {256 ** k} AS g, count(*) AS c FROM g{k + 1} GROUP BY ALL)")
    for k in range(1, order + 1):
        parts.append(f"""n{k} AS (SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM g{k})""")
        parts.append(f"""y{k} AS (SELECT 1 - 2 * y * n2 / n1 AS d1, 2 - 3 * y * n3 / n2 AS d2, 3 - 4 * y * n4 / n3 AS d3, least(n1, n2, n3, n4) AS least_n
 FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM n{k}))""")
        parts.append(f"""d{k} AS MATERIALIZED (SELECT CASE WHEN ok THEN d1 ELSE 0.5 END AS d1, CASE WHEN ok THEN d2 ELSE 1.0 END AS d2, CASE WHEN ok THEN d3 ELSE 1.5 END AS d3
 FROM (SELECT *, least_n > 0 AND d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3 AS ok FROM y{k}))""")
        parts.append(f"""x{k} AS (SELECT g, c, CAST(CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS DOUBLE) AS gone, g // 256 AS h FROM g{k}, d{k})""")
        own = f"(SELECT g, (c - gone) / sum(c) OVER (PARTITION BY h) AS own, sum(gone) OVER (PARTITION BY h) / sum(c) OVER (PARTITION BY h) AS free FROM x{k})"
        if k == 1:
            parts.append(f"p1 AS MATERIALIZED (SELECT g, own + free / 256 AS p FROM {own})")
        else:
            parts.append(f"p{k} AS MATERIALIZED (SELECT z.g, own + free * p{k - 1}.p AS p FROM {own} z JOIN p{k - 1} ON z.g % {256 ** (k - 1)} = p{k - 1}.g)")
    parts += [f"""lp AS (SELECT r, -sum(ln(p)) / greatest(count(*) FILTER (g % 256 BETWEEN 48 AND 57 OR g % 256 BETWEEN 65 AND 90 OR g % 256 BETWEEN 97 AND 122 OR g % 256 > 127), 1) AS lp
 FROM grams JOIN p{order} USING (g) GROUP BY r)""",
              "s AS MATERIALIZED (SELECT b.*, lp, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b LEFT JOIN lp USING (r))",
              "v AS MATERIALIZED (SELECT lang, round(lp, 3) AS lp FROM (SELECT DISTINCT lang, n_words, round(lp, 6) AS lp FROM s WHERE NOT base_failed AND lp IS NOT NULL))",
              "mid AS (SELECT lang, quantile_cont(lp, 0.5) AS mid FROM v GROUP BY lang)",
              "band AS (SELECT v.lang, mid, quantile_cont(abs(lp - mid), 0.5) AS mad FROM v JOIN mid ON v.lang IS NOT DISTINCT FROM mid.lang GROUP BY ALL)"]
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(lp BETWEEN mid - greatest(0.3, 14 * mad) AND mid + greatest(0.15, 7 * mad), true) AS kept
FROM s LEFT JOIN band ON s.lang IS NOT DISTINCT FROM band.lang"""
