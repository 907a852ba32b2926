"""DuckDB SQL with the same rows as the queries of this subpackage."""

from __future__ import annotations

from . import imatch, line_dedup, quality, vector_codes

_SPACE = r"[\x20\x09-\x0D]+"


def _norm(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '{_SPACE}', ' ', 'g')))"


def _frequent(ratio: float, least: int) -> str:
    return f"""
pages AS (SELECT DISTINCT coalesce('h' || source, '') AS host, text FROM documents WHERE text IS NOT NULL),
held AS (SELECT DISTINCT host, text, {_norm('unnest(string_split(text, chr(10)))')} AS line FROM pages),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
bad AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM held WHERE line <> '' GROUP BY host, line)
        JOIN totals USING (host) WHERE n > {least} AND n > CAST({ratio} AS DOUBLE) * pages)"""


OP2 = f"""
WITH {_frequent(line_dedup.RATIO, line_dedup.MIN_PAGES)},
own AS (SELECT doc_id, coalesce('h' || source, '') AS host, string_split(text, chr(10)) AS ls FROM documents),
cut AS (SELECT doc_id, host, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM own),
kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text, count(*) AS n
         FROM cut WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.host = cut.host AND bad.line = {_norm('cut.l')}) GROUP BY doc_id)
SELECT own.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_dropped,
       CASE WHEN ls IS NULL THEN NULL ELSE coalesce(text, '') END AS text
FROM own LEFT JOIN kept USING (doc_id)"""

OP9 = f"""
WITH {_frequent(quality.RATIO, quality.MIN_DOCS)},
own AS (SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS ws,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: {_norm('l')} <> '') AS ls FROM documents),
base AS (SELECT doc_id, host, ws, ls, len(ws) AS n_words, length(list_aggregate(ws || [''], 'string_agg', '')) AS word_chars,
                length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM own),
seen AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + {quality.WINDOW}], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(0, n_words - {quality.WINDOW - 1})) AS i FROM base)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM seen) WHERE n > 1),
rep AS (SELECT doc_id, sum(least({quality.WINDOW}, i - last)) AS n FROM (SELECT doc_id, i, lag(i, 1, -{quality.WINDOW}) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM twice) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(len(list_filter(regexp_split_to_array(l, '{_SPACE}'), lambda w: w <> ''))) AS n
         FROM (SELECT doc_id, host, unnest(ls) AS l FROM base) AS x JOIN bad ON bad.host = x.host AND bad.line = {_norm('x.l')} GROUP BY doc_id),
res AS (SELECT base.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
               coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (n_words - coalesce(gone.n, 0))::BIGINT AS n_left_words
        FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
fin AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM res)
SELECT *, NOT base_failed AND 100 * n_left_words >= {quality.MIN_LEFT_PERCENT} * n_words AS kept FROM fin"""

OP13 = rf"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
nxt AS (SELECT doc_id, text, n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS t, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid FROM own WINDOW w AS (ORDER BY doc_id DESC)),
ids AS (SELECT doc_id, n, nid, left(text, n - n // 3) || left(t, n // 3) AS edited, text FROM nxt),
texts AS (SELECT 2 * doc_id AS id, text AS t FROM ids UNION ALL SELECT 2 * doc_id + 1, edited FROM ids),
cut AS (SELECT id, t, list_distinct(list_filter(regexp_split_to_array(lower(t), '{imatch.BETWEEN}'), lambda x: x <> '')) AS ts FROM texts),
held AS (SELECT id, unnest(ts) AS term, len(ts) AS m FROM cut),
band AS (SELECT term FROM held WHERE id % 2 = 0 GROUP BY term HAVING count(*) * {imatch.COMMON} <= (SELECT count(*) FROM own) AND count(*) * {imatch.RARE} >= (SELECT count(*) FROM own)),
known AS (SELECT id, term, md5(term) AS h, greatest(0, ceil(log2(m / {imatch.LOAD}.0)))::INT AS j FROM held SEMI JOIN band USING (term)),
levels AS (SELECT *, unnest([0, 1]) AS more FROM known),
kept AS (SELECT id, term, j + more AS j, h[9:9] || translate(h[10:10], '0123456789abcdef', '0000111122223333') AS slot FROM levels
         WHERE j + more = 0 OR ('0x' || h[1:8])::BIGINT < 4294967296 // (1::BIGINT << (j + more))),
marks AS (SELECT id, printf('%02X', j) || slot || md5(string_agg(term, ' ' ORDER BY term))[1:6] AS e FROM kept GROUP BY id, j, slot),
prints AS (SELECT id, coalesce(es, ['ff' || md5(t)[1:8]]) AS es FROM cut LEFT JOIN (SELECT id, list(e ORDER BY e) AS es FROM marks GROUP BY id) USING (id)),
pairs AS (SELECT doc_id, 0 AS k, a.es AS a, b.es AS b FROM ids JOIN prints AS a ON a.id = 2 * doc_id JOIN prints AS b ON b.id = 2 * doc_id + 1
          UNION ALL SELECT doc_id, 1, a.es, b.es FROM ids JOIN prints AS a ON a.id = 2 * doc_id JOIN prints AS b ON b.id = 2 * nid),
alike AS (SELECT doc_id, k, a, b, list_intersect(list_transform(a, lambda z: left(z, 2)), list_transform(b, lambda z: left(z, 2))) AS c FROM pairs),
shared AS (SELECT doc_id, k, list_filter(a, lambda z: list_contains(c, left(z, 2))) AS a, list_filter(b, lambda z: list_contains(c, left(z, 2))) AS b FROM alike),
sized AS (SELECT doc_id, k, len(list_intersect(a, b)) AS same, len(list_distinct(list_transform(list_concat(a, b), lambda z: left(z, 4)))) AS n FROM shared),
near AS (SELECT doc_id, max(same / n) FILTER (k = 0) AS e, max(same / n) FILTER (k = 1) AS x FROM sized WHERE n > 0 GROUP BY doc_id)
SELECT ids.doc_id, ids.n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a.es, '') AS fingerprint, array_to_string(b.es, '') AS edited_fingerprint,
       coalesce(near.e, 0.0) AS near_edited, coalesce(near.x, 0.0) AS near_next
FROM ids JOIN prints AS a ON a.id = 2 * ids.doc_id JOIN prints AS b ON b.id = 2 * ids.doc_id + 1 LEFT JOIN near ON near.doc_id = ids.doc_id"""


_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DISTANCE = "(list_inner_product({a}, {a}) - 2 * list_inner_product({a}, {b}) + list_inner_product({b}, {b}))::BIGINT"


def _codes() -> str:
    """Rounds of the full search, unrolled."""
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    d = _DISTANCE.format(a="cut.x", b="c.x")
    steps = [f"""own AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_WHOLE}),
cut AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM (SELECT *, unnest(range({parts})) AS p FROM own)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut WHERE vec_id IN (SELECT vec_id FROM own ORDER BY vec_id LIMIT {entries}))"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT vec_id, label, p, any_value(cut.x) AS x, min({d} * {entries} + e) AS m FROM cut JOIN c{i} AS c USING (p) GROUP BY vec_id, label, p)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS x FROM (SELECT p, m % {entries} AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY ALL) GROUP BY p, e),
c{i + 1} AS (SELECT p, e, coalesce(s{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN s{i} USING (p, e))""")
    return f"""
WITH {', '.join(steps)},
book AS (SELECT sha256(string_agg(v, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS i, unnest(x)::BIGINT::VARCHAR AS v FROM c{rounds})),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', (m % {entries})::INT), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, book"""


OP11 = _codes()

OP12 = f"""
WITH own AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
             FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
scored AS (SELECT a.id AS anchor_id, c.id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM own AS a JOIN own AS c ON a.id <> c.id WHERE a.id % 100 = 0),
good AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM scored WHERE same) WHERE n <= 5),
bad AS (SELECT good.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY good.anchor_id, positive_id ORDER BY score DESC, id) AS rank
        FROM good JOIN scored ON good.anchor_id = scored.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM bad WHERE rank <= 10"""

ORACLE = {"op2_line_dedup": OP2, "op9_quality_rules": OP9, "op11_vector_codes": OP11, "op12_hard_negatives": OP12, "op13_imatch_fingerprints": OP13}
