"""Checking SQL of the queries that need more than a few lines of it."""

from __future__ import annotations


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds of assignment and floored means, a pair of CTEs each; the same arithmetic in plain integers."""
    steps = [
        f"""
        kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        comp AS MATERIALIZED (
            SELECT vec_id, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS j, v[i] AS x
            FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)
        ),
        book_0 AS MATERIALIZED (
            SELECT p, e, j, x AS c
            FROM comp JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}
            ) USING (vec_id)
        )"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
        near_{r} AS MATERIALIZED (
            SELECT vec_id, p, min(d * {entries} + e) AS m
            FROM (
                SELECT vec_id, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d
                FROM comp JOIN book_{r} USING (p, j) GROUP BY ALL
            ) GROUP BY ALL
        )"""
        )
        if r < rounds:
            steps.append(
                f"""
        book_{r + 1} AS MATERIALIZED (
            SELECT p, e, j, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c) AS c
            FROM book_{r} LEFT JOIN (
                SELECT p, m % {entries} AS e, j, sum(x) AS s, count(*) AS n
                FROM comp JOIN near_{r} USING (vec_id, p) GROUP BY ALL
            ) USING (p, e, j)
        )"""
            )
    return f"""
    WITH {",".join(steps)},
    coded AS (
        SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code,
               CAST(sum(m // {entries}) AS BIGINT) AS error
        FROM near_{rounds} GROUP BY vec_id
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM book_{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)
    """


def repeats(length: int = 100) -> str:
    """Every string of ``length`` bytes with its first place, in hexadecimal; then the bytes that repeats cover."""
    wide = 2 * length
    return f"""
    WITH docs AS MATERIALIZED (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
    ),
    strings AS MATERIALIZED (
        SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, {wide})) AS s
        FROM (SELECT doc_id, h, unnest(range(1, n - {length - 2})) AS i FROM docs WHERE n >= {length})
    ),
    later AS MATERIALIZED (
        SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
    ),
    runs AS MATERIALIZED (
        SELECT doc_id, min(i) AS a, max(i) + {length - 1} AS b
        FROM (
            SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM (
                SELECT doc_id, i,
                       CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh
                FROM later
            )
        ) GROUP BY doc_id, run
    ),
    gaps AS (
        SELECT doc_id, b + 1 AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1 AS b FROM runs
        UNION ALL SELECT doc_id, 1, min(a) - 1 FROM runs GROUP BY doc_id
    ),
    pieces AS (
        SELECT doc_id, string_agg(substr(h, 2 * a - 1, 2 * (coalesce(b, n) - a + 1)), '' ORDER BY a) AS kept
        FROM gaps JOIN docs USING (doc_id) WHERE coalesce(b, n) >= a GROUP BY doc_id
    ),
    sums AS (SELECT doc_id, sum(b - a + 1) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
    FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN pieces USING (doc_id)
    """


def collocations(min_count: int = 30, longest: int = 4, share: int = 80, top: int = 2000) -> str:
    """Phrases as joined words, counted by grouping; cuts, inner phrases and ranks as in the contract."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sizes = "\n        UNION ALL ".join(
        f"SELECT lang, {n} AS size, array_to_string(w[i : i + {n - 1}], ' ') AS phrase, count(*) AS f\n"
        f"        FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces) GROUP BY ALL"
        for n in range(1, longest + 1)
    )
    return f"""
    WITH pieces AS MATERIALIZED (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w
        FROM (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        )
    ),
    every AS MATERIALIZED (
        {sizes}
    ),
    counts AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f FROM every WHERE f >= {min_count}),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM every WHERE size = 1 GROUP BY lang),
    cuts AS (
        SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
        JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
        JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
    ),
    worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(f) AS f
        FROM (
            SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM counts WHERE size > 2)
        ) GROUP BY ALL
    ),
    kept AS (
        SELECT worst.* FROM worst LEFT JOIN inside USING (lang, phrase)
        WHERE inside.f IS NULL OR 100 * inside.f < {share} * a
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= {top}
    """
