"""SQL of the operators whose statements are built from repeated parts."""

#: Unsigned CRC-32 of an ASCII text, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT)"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, c - c % 5 AS base, {CRC32.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM t)
), s AS (
  SELECT h.c, i, x, b FROM h JOIN t ON t.c = h.base AND i <= h.h UNION ALL SELECT h.c, 1000 + i, x, b FROM h JOIN t ON t.c = h.c AND i > h.h
), p AS (
  SELECT c, row_number() OVER o AS d, string_agg(x, '') OVER o AS path, b FROM s WINDOW o AS (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', 0 FROM h
), l AS (
  SELECT c, max(d) AS d FROM p GROUP BY c
), g AS (
  SELECT path, any_value(d) AS d, min(c) AS conv_id, count(*) AS n, any_value(b) AS b FROM p GROUP BY path
), e AS (
  SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM p JOIN l USING (c, d) GROUP BY path
), k AS (
  SELECT left(path, 64 * (d - 1)) AS path, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1
), u AS (
  SELECT left(g.path, 64 * a) AS path, sum((n - 1) * b) AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves
  FROM g LEFT JOIN k USING (path), unnest(generate_series(0, d)) AS x(a) GROUP BY 1
)
SELECT g.conv_id, g.d::BIGINT AS depth, up.conv_id AS parent_conv_id, g.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM g JOIN u USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path) LEFT JOIN g up ON g.d > 0 AND up.path = left(g.path, 64 * (g.d - 1))
"""


def centroids(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    nearest = """SELECT v.n, v.vec_id, v.v, arg_min(c.c, ROW(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.c)) AS c,
  min(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v, c{0} c GROUP BY ALL"""
    steps = []
    for r in range(rounds):
        steps += [f"a{r} AS ({nearest.format(r)})", f"""m{r} AS (SELECT c, list(x ORDER BY j) AS v FROM (
  SELECT c, j, floor(sum(x)::DECIMAL(38, 0) / count(*))::BIGINT AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY c, j) GROUP BY c)""",
            f"c{r + 1} AS (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"]
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({dims} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k})
), {", ".join(steps)}, f AS ({nearest.format(rounds)})
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(w.v, ',')) AS centroid_sha256
FROM f JOIN c{rounds} w USING (c)
"""
