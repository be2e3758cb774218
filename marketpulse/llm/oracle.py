"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

#: The word class of the contracts: anything but ASCII white space.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: A text is covered where a window of 20 words occurs twice in it, and its
#: longest repeat is over 100 words if a window of 101 words occurs twice.
_OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, {_WORDS} AS ws FROM d),
p AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) >= 4),
g3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(ws, i, i + 2)) AS n FROM p WHERE i + 2 <= len(ws)),
g20 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(list_slice(ws, i, i + 19), ' ')) AS n
        FROM p WHERE i + 19 <= len(ws)),
g101 AS (SELECT rid FROM (SELECT rid, md5(array_to_string(list_slice(ws, i, i + 100), ' ')) AS h FROM p WHERE i + 100 <= len(ws))
         GROUP BY rid, h HAVING count(*) > 1),
c3 AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS j FROM g3 WHERE n > 1) GROUP BY rid),
c20 AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 20)) AS j FROM g20 WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(l.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(c20.n, 0) AS n_covered_words,
             w.rid IN (SELECT rid FROM g101) AS long_repeat
      FROM w LEFT JOIN l USING (rid) LEFT JOIN c3 USING (rid) LEFT JOIN c20 USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 20 * n_words AND NOT long_repeat AS kept,
       n_covered_words
FROM f"""

_OP2 = r"""
WITH r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
m AS (SELECT rid, page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC) AS k
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""

def _letters(word: str) -> str:
    """Each letter in either case, spelled out (a case flag would fold other alphabets in)."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: (kind, pattern, group whose length counts, least length); base kinds first.
_SECRETS = (
    ("assign", "(" + "|".join(map(_letters, ("password", "passwd", "secret", "token", "api_?key")))
     + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)


def _matches(k: int) -> str:
    kind, pattern, group, least = _SECRETS[k]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {k} AS k, '{kind}' AS kind, {least} AS least, generate_subscripts(ms, 1) AS i, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m, unnest(vs) AS v
FROM (SELECT rid, regexp_split_to_array(text, {quoted}) AS gaps, regexp_extract_all(text, {quoted}) AS ms, regexp_extract_all(text, {quoted}, {group}) AS vs
      FROM d WHERE regexp_matches(text, {quoted}))"""


_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({' UNION ALL '.join(_matches(k) for k in range(len(_SECRETS)))}),
e AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM a),
s AS (SELECT rid, k, kind, (stop - length(m))::BIGINT AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span
      FROM e WHERE length(v) >= least),
f AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
      FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (rid)"""

_OP8 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text FROM documents),
f AS (SELECT min(rid) AS rid FROM d GROUP BY host, coalesce(text, '')),
e AS (SELECT rid, host, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT rid, host, string_split(text, chr(10)) AS ls FROM d)),
b AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
n AS (SELECT host, bare, count(DISTINCT rid) AS n FROM b JOIN f USING (rid) WHERE bare <> '' GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
t AS (SELECT host, count(*) AS pages FROM d JOIN f USING (rid) GROUP BY host),
bad AS (SELECT host, bare FROM n JOIN t USING (host) WHERE 100 * n > 6 * pages),
k AS (SELECT b.rid, count(*) AS n_lines, count(bad.bare) AS n_dropped,
             string_agg(b.line, chr(10) ORDER BY i) FILTER (WHERE bad.bare IS NULL) AS kept
      FROM b LEFT JOIN bad ON b.host = bad.host AND b.bare = bad.bare GROUP BY b.rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""

_OP12 = r"""
WITH RECURSIVE lower_map AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM documents, lower_map),
q AS (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(text, big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
      FROM benchmark, lower_map),
qt AS (SELECT iid, item_id, t, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
p AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS t FROM d)
      WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, n_docs),
x AS (SELECT rid, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))) AS impact
      FROM p JOIN w USING (t), s),
r AS (SELECT iid, item_id, rid, doc_id, sum(times * impact)::BIGINT AS score FROM x JOIN qt USING (t) GROUP BY ALL HAVING sum(times * impact) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM r)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""

_OP13 = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT rid, vec_id, x FROM e WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c <> 0)) > 0
      AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
l AS (SELECT a.rid AS u, b.rid AS w FROM v a JOIN v b ON a.rid <> b.rid AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(u, w) AS (SELECT rid, rid FROM e UNION SELECT reach.u, l.w FROM reach JOIN l ON reach.w = l.u),
g AS (SELECT reach.u AS rid, min(o.vec_id) AS component_id FROM reach JOIN e o ON reach.w = o.rid GROUP BY reach.u),
n AS (SELECT u AS rid, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN g USING (rid) LEFT JOIN n USING (rid)"""

ORACLE: dict[str, str] = {
    "op2_url_filter": _OP2,
    "op4_repetition_quality": _OP4,
    "op7_secret_scan": _OP7,
    "op8_line_dedup": _OP8,
    "op12_lexical_search": _OP12,
    "op13_embedding_dedup": _OP13,
}
