"""The queries that SQL can express, for DuckDB."""

#: op2: running sums in the order of the Pareto rank, over all documents of a source.
MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN length(text) >= 1000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS level,
    (('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS lim FROM s
), r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), o AS (
  SELECT *, first_value(CASE WHEN level * weight <= lim THEN level END IGNORE NULLS)
    OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open
  FROM r
), t AS (
  SELECT source, source_size, coalesce(least(lim, open * weight), lim) AS target FROM o
), b AS (
  SELECT source, level, sum(size)::DOUBLE AS words FROM d GROUP BY source, level
), k AS (
  SELECT b.*, source_size, target, (target - 2.0::DOUBLE
    * coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(level * words) OVER (PARTITION BY b.source ORDER BY level DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS share
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT *, first_value(CASE WHEN share * level <= 2 THEN share END IGNORE NULLS)
    OVER (PARTITION BY source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open
  FROM k
), n AS (
  SELECT source, level, source_size, target,
    CASE WHEN source_size = 0 THEN 0.0 ELSE coalesce(least(2.0::DOUBLE, open * level), 2.0::DOUBLE) END AS expected
  FROM m
), e AS (
  SELECT d.*, source_size, target, expected
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source AND d.level = n.level
), p AS (
  SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS p FROM e
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p
), c AS (
  SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS rest,
    sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached
  FROM q
), x AS (
  SELECT *, odds IS NOT NULL AND reached <= rest AS drawn FROM c
), f0 AS (
  SELECT *, drawn AS got, rest - sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source) AS room FROM x
)""" + "".join(f"""
, g{i} AS (
  SELECT *, NOT got AND odds IS NOT NULL AND size > 0 AND size <= room AS fits FROM f{i}
), h{i} AS (
  SELECT * EXCLUDE (fits), fits AND row_number() OVER (PARTITION BY source, fits ORDER BY size DESC, odds, doc_id) = 1 AS fills FROM g{i}
), f{i + 1} AS (
  SELECT * EXCLUDE (fills) REPLACE (got OR fills AS got, room - sum(CASE WHEN fills THEN size ELSE 0 END) OVER (PARTITION BY source) AS room) FROM h{i}
)""" for i in range(4)) + """
SELECT doc_id, source, size, source_size, target,
  (certain + got::BIGINT)::BIGINT AS copies, ((certain + got::BIGINT) * size)::BIGINT AS taken
FROM f4
"""

#: op5: base32 digits are 5 bits each of the hexadecimal SHA-1, four of them from five digits.
ARCHIVE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM h
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM g
"""

#: op8: all pairs of documents that share a shingle, and what they reach.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ways AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_ways JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

#: op13: every order of the five filters, applied to all documents one after another.
AUDIT = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t
), f AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS own, substr(filter_order, 1, step::INT - 1) AS before
  FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS fails_own,
    len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone
  FROM c, s
), a AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_own), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails_own), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a
"""
