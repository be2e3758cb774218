"""DuckDB SQL for the registered queries (the independent oracle).

Every string runs on DuckDB with the driver's tables registered as views.
Adapter views (FIXTURES.md part B) are spelled out as CTEs so each query is
self-contained.  Parameters mirror the constants in ``checks/queries.py``.
"""

from __future__ import annotations

from checks.queries import (
    BATCH_FEEDS, CLOSED_BEFORE, DEFAULT_TITLE_PREFIX, LOADED_FEEDS, NOW_EPOCH, PRICE_CUTOFF, QUESTION_TEMPLATES,
    WANTED_SYMBOLS,
    SYMBOL_MAP, WINDOW_DAYS,
)

# Fixed values, written out here so that a wrong constant in the library fails.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
               "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
COIN_TRANSLATION = [("比特幣", "BTC"), ("以太幣", "ETH"), ("以太坊", "ETH"), ("狗狗幣", "DOGE"), ("柴犬幣", "SHIB"), ("幣安幣", "BNB"),
                    ("瑞波幣", "XRP"), ("索拉納", "SOL"), ("波卡", "DOT"), ("萊特幣", "LTC")]
TICKERS = ["BTC", "ETH", "BNB", "XRP", "SOL", "ADA", "DOGE", "TRX", "LTC", "XLM", "HBAR", "SHIB", "DOT"]
POPULAR = ["BTC", "ETH", "SOL"]
DEFAULT_COINS = ["BTC", "ETH"]
EXCLUSION_WORDS = ["除了", "BESIDES", "EXCEPT", "OTHER THAN"]
LISTING_EXCLUDED = [f"Customer#{k:09d}" for k in range(1, 9)]
WHITESPACE_CLASS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD_PATTERN = f"[^{WHITESPACE_CLASS}]+"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_lit(x) for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join(_lit(x) for x in xs) + ")"


def _feed_in(feeds) -> str:
    return f"split_part(keywords, '|', 1) IN {_in(feeds)}"


WP = _lit(WORD_PATTERN)
TOKENS = _in(NULL_TOKENS)
FLOOR_EPOCH = NOW_EPOCH - WINDOW_DAYS * 86400.0

PRICES_V = """prices_v AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS "Date",
         round(sum(o_totalprice), 2) AS "Close", count(*)::DOUBLE AS "Volume"
  FROM orders GROUP BY 1, 2)"""

NEWS_V = """news_v AS (
  SELECT doc_id, t AS title, b AS body,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id::BIGINT) AS published_at,
         'https://news.example/' || doc_id::VARCHAR AS url,
         concat_ws('|', lang, source) AS keywords,
         md5(t || b) AS id
  FROM (SELECT *, split_part(text, chr(10), 1) AS t,
               substr(text, length(split_part(text, chr(10), 1)) + 2) AS b
        FROM documents))"""

NEWS_FIRST = """news_first AS (
  SELECT id, arg_min(doc_id, doc_id) AS doc_id, arg_min_null(url, doc_id) AS url,
         arg_min_null(keywords, doc_id) AS keywords
  FROM news_v GROUP BY id)"""

VECTORS_V = """vectors_v AS (
  SELECT e.vec_id, n.id AS id, n.title, concat_ws(chr(10), n.title, n.body) AS content,
         e.embedding, strftime(n.published_at, '%Y-%m-%d %H:%M:%S') AS published_time,
         epoch(n.published_at)::DOUBLE AS "timestamp"
  FROM embeddings e JOIN news_v n ON e.vec_id = n.doc_id
  QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY e.vec_id) = 1)"""

QUESTIONS_V = """questions_v AS (
  SELECT vec_id AS qid, embedding AS qvec FROM embeddings)"""

QTEXT = f"""qtext AS (
  SELECT doc_id AS qid,
         {_list(QUESTION_TEMPLATES)}[doc_id % {len(QUESTION_TEMPLATES)} + 1] || text
           AS question
  FROM documents)"""

CHAT_V = """chat_v AS (
  SELECT 'm-' || conv_id::VARCHAR || '-' || turn::VARCHAR AS id,
         's-' || conv_id::VARCHAR AS session_id,
         CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'bot' ELSE role END AS sender,
         text AS message,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id::BIGINT) + to_minutes(turn::BIGINT) AS created_at,
         conv_id, turn
  FROM conversations)"""

SESSIONS_V = """sessions_v AS (
  SELECT 's-' || conv_id::VARCHAR AS id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id::BIGINT) AS created_at,
         CASE WHEN conv_id % 3 = 0 THEN '新對話 ' || (conv_id // 3 + 1)::VARCHAR
              ELSE first_text END AS title
  FROM (SELECT conv_id, arg_min_null(text, turn) AS first_text FROM conversations GROUP BY conv_id))"""

KNOWN_SESSIONS = f"""known AS (SELECT * FROM sessions_v WHERE NOT starts_with(title, {_lit(DEFAULT_TITLE_PREFIX)}))"""

LISTINGS_V = """listings_v AS (
  SELECT c_name AS symbol, c_acctbal AS market_cap, c_custkey AS pos FROM customer)"""

PRICE_ROWS = """price_rows AS (
  SELECT symbol, "Close"::DECIMAL(20,8) AS price,
         CASE WHEN "Volume" <> 0 THEN "Volume"::DECIMAL(20,8) END AS volume,
         "Date" AS recorded_at
  FROM prices_v)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _wr(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# --- indicator building blocks -------------------------------------------

P_IDX = """p AS (
  SELECT symbol, "Date", "Close", row_number() OVER (PARTITION BY symbol ORDER BY "Date") - 1 AS i
  FROM prices_v WHERE "Close" IS NOT NULL)"""

DELTAS = """d AS (
  SELECT *, "Close" - lag("Close") OVER (PARTITION BY symbol ORDER BY i) AS dl FROM p)"""

STATS = """s AS (
  SELECT symbol, "Date", i, dl,
         CASE WHEN dl > 0 THEN dl ELSE 0 END AS gn,
         CASE WHEN dl < 0 THEN -dl ELSE 0 END AS ls,
         avg(CASE WHEN dl > 0 THEN dl ELSE 0 END) OVER w14 AS g,
         avg(CASE WHEN dl < 0 THEN -dl ELSE 0 END) OVER w14 AS l,
         avg("Close") OVER w20 AS m, stddev_samp("Close") OVER w20 AS sd
  FROM d
  WINDOW w14 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
         w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _a(span: int) -> str:
    return f"(2.0::DOUBLE / {span + 1})"


def _r(span: int) -> str:
    return f"(1 - 2.0::DOUBLE / {span + 1})"


EMA_REC = f"""e(symbol, i, e12, e26, sig) AS (
  SELECT symbol, i, "Close", "Close", 0.0::DOUBLE FROM p WHERE i = 0
  UNION ALL
  SELECT p.symbol, p.i,
         e.e12 * {_r(12)} + p."Close" * {_a(12)},
         e.e26 * {_r(26)} + p."Close" * {_a(26)},
         e.sig * {_r(9)}
           + ((e.e12 * {_r(12)} + p."Close" * {_a(12)})
              - (e.e26 * {_r(26)} + p."Close" * {_a(26)})) * {_a(9)}
  FROM e JOIN p ON p.symbol = e.symbol AND p.i = e.i + 1)"""

RSI_EXPR = """CASE WHEN s.i < 13 THEN NULL WHEN s.l = 0 THEN (CASE WHEN s.g > 0 THEN 100.0 END)
                  ELSE 100.0 - 100.0 / (1.0 + s.g / s.l) END"""

IND_RAW = f"""ind_raw AS (
  SELECT s.symbol, s."Date",
         {RSI_EXPR} AS rsi_14,
         e.e12 - e.e26 AS macd, e.sig AS macd_signal,
         CASE WHEN s.i >= 19 THEN s.m + 2 * s.sd END AS bb_upper,
         CASE WHEN s.i >= 19 THEN s.m END AS bb_middle,
         CASE WHEN s.i >= 19 THEN s.m - 2 * s.sd END AS bb_lower
  FROM s JOIN e ON s.symbol = e.symbol AND s.i = e.i)"""

IND_CTES = [PRICES_V, P_IDX, DELTAS, STATS, EMA_REC, IND_RAW]

INDICATORS = _wr(*IND_CTES) + """
SELECT symbol, "Date", round(rsi_14, 4) AS rsi_14, round(macd, 4) AS macd,
       round(macd_signal, 4) AS macd_signal, round(bb_upper, 4) AS bb_upper,
       round(bb_middle, 4) AS bb_middle, round(bb_lower, 4) AS bb_lower
FROM ind_raw"""

# indicator table rows as stored: RSI to 4 places, the rest to 8 (half-even)
IND_ROWS = """ind_rows AS (
  SELECT symbol, "Date" AS recorded_at,
         round_even(rsi_14, 4) AS rsi_14, round_even(macd, 8) AS macd,
         round_even(macd_signal, 8) AS macd_signal, round_even(bb_upper, 8) AS bb_upper,
         round_even(bb_middle, 8) AS bb_middle, round_even(bb_lower, 8) AS bb_lower
  FROM ind_raw)"""

ORACLE: dict[str, str] = {}

ORACLE["w12_indicators"] = INDICATORS

ORACLE["w4_rsi"] = _w(PRICES_V, P_IDX, DELTAS, STATS) + f"""
SELECT symbol, "Date", round(dl, 4) AS delta, round(gn, 4) AS gain, round(ls, 4) AS loss,
       round(CASE WHEN i >= 13 THEN g END, 4) AS avg_gain,
       round(CASE WHEN i >= 13 THEN l END, 4) AS avg_loss,
       round({RSI_EXPR.replace('s.', '')}, 4) AS rsi
FROM s"""

ORACLE["w9_bollinger"] = _w(PRICES_V, P_IDX, DELTAS, STATS) + """
SELECT symbol, "Date", round(CASE WHEN i >= 19 THEN m END, 4) AS mean,
       round(CASE WHEN i >= 19 THEN sd END, 4) AS sd,
       round(CASE WHEN i >= 19 THEN m + 2 * sd END, 4) AS upper,
       round(CASE WHEN i >= 19 THEN m - 2 * sd END, 4) AS lower
FROM s"""

ORACLE["w7_macd"] = _wr(PRICES_V, P_IDX, EMA_REC) + """
SELECT p.symbol, p."Date", round(e12 - e26, 4) AS macd, round(sig, 4) AS signal,
       round(e12 - e26 - sig, 4) AS hist
FROM p JOIN e ON p.symbol = e.symbol AND p.i = e.i"""

ORACLE["w5_ema"] = _wr(PRICES_V, P_IDX, EMA_REC) + """
SELECT p.symbol, p."Date", round(e12, 4) AS ema_12, round(e26, 4) AS ema_26
FROM p JOIN e ON p.symbol = e.symbol AND p.i = e.i"""

# bars with null closes: every row counts, averages carry over the gaps
_GAPPED = """gapped AS (SELECT symbol, "Date", CASE WHEN "Volume"::BIGINT % 4 <> 0 THEN "Close" END AS x FROM prices_v),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "Date") - 1 AS i FROM gapped),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY symbol ORDER BY i) AS dl FROM p),
s AS (SELECT symbol, "Date", i, x, count(x) OVER w20 AS n20, avg(x) OVER w20 AS m, stddev_samp(x) OVER w20 AS sd,
             avg(CASE WHEN dl > 0 THEN dl ELSE 0 END) OVER w14 AS g, avg(CASE WHEN dl < 0 THEN -dl ELSE 0 END) OVER w14 AS l
      FROM d
      WINDOW w14 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
             w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _carried(span: int, e: str) -> str:
    old = f"pow({_r(span)}, e.gap + 1)"
    return f"CASE WHEN p.x IS NULL THEN {e} WHEN {e} IS NULL THEN p.x ELSE ({old} * {e} + {_a(span)} * p.x) / ({old} + {_a(span)}) END"


_CARRIED_REC = f"""e(symbol, i, gap, e12, e26, sig) AS (
  SELECT symbol, i, CASE WHEN x IS NULL THEN 1 ELSE 0 END, x, x, x - x FROM p WHERE i = 0
  UNION ALL
  SELECT symbol, i, gap, e12, e26, CASE WHEN sig IS NULL THEN e12 - e26 ELSE sig * {_r(9)} + (e12 - e26) * {_a(9)} END
  FROM (SELECT p.symbol, p.i, CASE WHEN p.x IS NULL THEN e.gap + 1 ELSE 0 END AS gap,
               {_carried(12, 'e.e12')} AS e12, {_carried(26, 'e.e26')} AS e26, e.sig
        FROM e JOIN p ON p.symbol = e.symbol AND p.i = e.i + 1))"""
_CARRIED_INDICATORS = _wr(PRICES_V, _GAPPED, _CARRIED_REC) + f"""
SELECT s.symbol, s."Date", round({RSI_EXPR}, 4) AS rsi_14, round(e12 - e26, 2) AS macd, round(sig, 2) AS macd_signal,
       round(CASE WHEN n20 = 20 THEN m + 2 * sd END, 4) AS bb_upper, round(CASE WHEN n20 = 20 THEN m END, 4) AS bb_middle,
       round(CASE WHEN n20 = 20 THEN m - 2 * sd END, 4) AS bb_lower
FROM s JOIN e ON s.symbol = e.symbol AND s.i = e.i"""
ORACLE["w12_indicators_carry"] = _CARRIED_INDICATORS
ORACLE["w12_indicators_carry_blocks"] = _CARRIED_INDICATORS
ORACLE["w5_ema_carry"] = _wr(PRICES_V, _GAPPED, _CARRIED_REC) + """
SELECT symbol, "Date", round(e12, 2) AS ema_12, round(e26, 2) AS ema_26 FROM e JOIN p USING (symbol, i)"""
ORACLE["w7_macd_carry"] = _wr(PRICES_V, _GAPPED, _CARRIED_REC) + """
SELECT symbol, "Date", round(e12 - e26, 2) AS macd, round(sig, 2) AS signal, round(e12 - e26 - sig, 2) AS hist FROM e JOIN p USING (symbol, i)"""
ORACLE["w9_bollinger_carry"] = _w(PRICES_V, _GAPPED) + """
SELECT symbol, "Date", round(CASE WHEN n20 = 20 THEN m END, 4) AS mean, round(CASE WHEN n20 = 20 THEN sd END, 4) AS sd,
       round(CASE WHEN n20 = 20 THEN m + 2 * sd END, 4) AS upper, round(CASE WHEN n20 = 20 THEN m - 2 * sd END, 4) AS lower
FROM s"""

ORACLE["w10_first_per_key"] = _w(NEWS_V) + """
SELECT title, min(doc_id) AS doc_id, arg_min_null(id, doc_id) AS id FROM news_v GROUP BY title"""

ORACLE["w11_triples"] = """WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS text FROM parts),
t AS (SELECT doc_id, pos, text AS "Youtuber",
             lead(text, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS "Date",
             lead(text, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS "Title"
      FROM lines)
SELECT * FROM t WHERE "Title" IS NOT NULL AND regexp_matches("Date", '^.{0,12}$')"""

ORACLE["w13_number_titles"] = _w(SESSIONS_V, """new AS (
  SELECT 'n-' || conv_id::VARCHAR AS id,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(conv_id::BIGINT) AS created_at,
         CASE WHEN bool_or(role = 'system') THEN 'kept title' END AS title
  FROM conversations GROUP BY conv_id)""", """n0 AS (SELECT count(*) AS n FROM sessions_v WHERE title LIKE '新對話 %')""") + """
SELECT id, created_at,
       coalesce(title, '新對話 ' || ((SELECT n FROM n0) + row_number() OVER (ORDER BY created_at, id))::VARCHAR)
         AS title
FROM new"""

ORACLE["p4_price_rows"] = _w(PRICES_V, PRICE_ROWS) + "SELECT * FROM price_rows"

ORACLE["p5_quantize_half_even"] = _w(PRICES_V) + """
SELECT symbol, "Date", round_even("Close" / 7.0::DOUBLE, 4)::DECIMAL(10,4) AS q4,
       round_even("Close" / 7.0::DOUBLE, 8)::DECIMAL(20,8) AS q8
FROM prices_v"""

ORACLE["c2_new_prices"] = _w(PRICES_V, PRICE_ROWS, f"""mx AS (
  SELECT symbol, max(recorded_at) AS m FROM price_rows WHERE recorded_at < TIMESTAMP '{PRICE_CUTOFF}'
  GROUP BY symbol)""") + """
SELECT r.* FROM price_rows r LEFT JOIN mx USING (symbol)
WHERE (m IS NULL OR recorded_at > m) AND recorded_at < TIMESTAMP '1998-06-01'"""

ORACLE["c3_new_indicators"] = _wr(*IND_CTES, IND_ROWS, f"""mx AS (
  SELECT symbol, max(recorded_at) AS m FROM ind_rows WHERE recorded_at < TIMESTAMP '{PRICE_CUTOFF}'
  GROUP BY symbol)""") + """
SELECT symbol, recorded_at, round(rsi_14, 4) AS rsi_14, round(macd, 4) AS macd,
       round(macd_signal, 4) AS macd_signal, round(bb_upper, 4) AS bb_upper,
       round(bb_middle, 4) AS bb_middle, round(bb_lower, 4) AS bb_lower
FROM ind_rows LEFT JOIN mx USING (symbol) WHERE m IS NULL OR recorded_at > m"""

ORACLE["a1_max_per_key"] = _w(PRICES_V) + 'SELECT symbol, max("Date") AS max_ts FROM prices_v GROUP BY symbol'
ORACLE["a2_global_max"] = _w(NEWS_V) + "SELECT max(published_at) AS max_ts FROM news_v"
ORACLE["a5_first_trade"] = _w(PRICES_V) + 'SELECT symbol, min("Date") AS first_date FROM prices_v GROUP BY symbol'
ORACLE["a5_first_trade_or_now"] = _w(PRICES_V, """syms AS (
  SELECT DISTINCT symbol FROM (SELECT c_mktsegment AS symbol FROM customer UNION ALL SELECT o_orderpriority FROM orders))""") + """
SELECT symbol, coalesce(min("Date"), TIMESTAMP '2024-01-01 12:00:00') AS first_date
FROM syms LEFT JOIN prices_v USING (symbol) GROUP BY symbol"""
ORACLE["l3_latest"] = _w(PRICES_V) + """
SELECT symbol, max("Date") AS "Date", arg_max_null("Close", "Date") AS "Close",
       arg_max_null("Volume", "Date") AS "Volume" FROM prices_v GROUP BY symbol"""
ORACLE["j2_attach_latest"] = _w(PRICES_V, """syms AS (
  SELECT DISTINCT symbol FROM (SELECT c_mktsegment AS symbol FROM customer
                               UNION ALL SELECT o_orderpriority FROM orders))""") + """
SELECT symbol, max("Date") AS "Date", arg_max_null("Close", "Date") AS "Close",
       arg_max_null("Volume", "Date") AS "Volume"
FROM prices_v WHERE symbol IN (SELECT symbol FROM syms) GROUP BY symbol"""

ORACLE["c7_top_pairs"] = f"""
SELECT c_custkey AS pos, c_name || 'USDT' AS pair FROM customer
WHERE c_name NOT IN {_in(LISTING_EXCLUDED)} ORDER BY c_custkey LIMIT 10"""

ORACLE["c7_top_pairs_by_response"] = f"""
SELECT page, pos, pair FROM (
  SELECT c_custkey // 100 AS page, c_custkey AS pos, c_name || 'USDT' AS pair,
         row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS k
  FROM customer WHERE c_name NOT IN {_in(LISTING_EXCLUDED)}) WHERE k <= 10"""

ORACLE["l4_rank_by_cap"] = f"""
SELECT c_name AS symbol, c_acctbal AS market_cap, c_name || 'USDT' AS pair FROM customer
WHERE c_name NOT IN {_in(LISTING_EXCLUDED)} ORDER BY c_acctbal DESC, c_name LIMIT 10"""

ORACLE["l1_top_k"] = """
SELECT * FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders) WHERE rank <= 3"""

ORACLE["f2_by_key"] = _w(CHAT_V) + "SELECT id, sender, message FROM chat_v WHERE session_id = 's-7'"
ORACLE["f3_since"] = _w(NEWS_V, VECTORS_V) + \
    f'SELECT vec_id, "timestamp" FROM vectors_v WHERE "timestamp" >= {FLOOR_EPOCH!r}'
ORACLE["f3_since_ts"] = _w(NEWS_V) + \
    "SELECT doc_id, published_at FROM news_v WHERE published_at >= TIMESTAMP '2024-01-01 06:00:00'"
ORACLE["f4_exclude"] = _w(LISTINGS_V) + f"SELECT * FROM listings_v WHERE symbol NOT IN {_in(LISTING_EXCLUDED)}"
ORACLE["x1_exclude_table"] = _w(LISTINGS_V) + \
    "SELECT * FROM listings_v WHERE symbol NOT IN (SELECT c_name FROM customer WHERE c_acctbal < 0)"
ORACLE["f5_title_prefix"] = _w(SESSIONS_V) + "SELECT * FROM sessions_v WHERE title LIKE '新對話 %'"
ORACLE["a4_count_default_titles"] = _w(SESSIONS_V) + \
    "SELECT count(*) AS n_default FROM sessions_v WHERE title LIKE '新對話 %'"
ORACLE["f6_require_rejected"] = _w(NEWS_V) + """
SELECT doc_id, title FROM news_v
WHERE title IS NULL OR title = '' OR body IS NULL OR body = ''"""
ORACLE["f7_short_text"] = f"""
SELECT doc_id, len(regexp_extract_all(text, {WP})) AS n_words,
       len(regexp_extract_all(text, {WP})) < 30 AS short FROM documents"""
ORACLE["s1_null_tokens_dropna"] = _w(NEWS_V) + f"""
SELECT doc_id FROM news_v WHERE published_at IS NOT NULL
  AND title NOT IN {TOKENS} AND body NOT IN {TOKENS}"""
ORACLE["q1_not_null"] = _w(NEWS_V) + f"""
SELECT * FROM (
  SELECT doc_id, list_filter([CASE WHEN title IS NULL THEN 'title' END,
                              CASE WHEN body IS NULL OR body IN {TOKENS} THEN 'body' END],
                             lambda x: x IS NOT NULL) AS violations
  FROM news_v) WHERE len(violations) > 0"""
ORACLE["q2_unique"] = _w(NEWS_V) + "SELECT id, count(*) AS n FROM news_v GROUP BY id HAVING count(*) > 1"
ORACLE["q3_domain"] = _w(CHAT_V) + \
    "SELECT id, sender FROM chat_v WHERE sender IS NOT NULL AND sender NOT IN ('user', 'bot')"
ORACLE["q4_fk"] = _w(CHAT_V, SESSIONS_V, KNOWN_SESSIONS) + """
SELECT id, session_id FROM chat_v
WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT id FROM known)"""
ORACLE["q5_fits_varchar"] = "SELECT n_name FROM nation WHERE length(n_name) > 8"
ORACLE["q5_fits_decimal"] = """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE TRY_CAST(l_extendedprice * 1e7 AS DECIMAL(20,8)) IS NULL"""
ORACLE["q6_partition_list"] = _w(PRICES_V, "m(symbol, ticker) AS (VALUES " + ", ".join(
    f"({_lit(a)}, {_lit(b)})" for a, b in SYMBOL_MAP) + ")") + """
SELECT coalesce(ticker, p.symbol) AS symbol, "Date"
FROM prices_v p LEFT JOIN m ON p.symbol = m.symbol
WHERE coalesce(ticker, p.symbol) NOT IN ('BTC', 'ETH', 'SOL', 'DOGE')"""

# --- keyed tables ----------------------------------------------------------

ORACLE["j3_newer_than"] = _w(NEWS_V) + f"""
SELECT doc_id FROM news_v
WHERE published_at > (SELECT max(published_at) FROM news_v WHERE {_feed_in(LOADED_FEEDS)})"""
ORACLE["j3_newer_than_by_key"] = _w(PRICES_V, f"""mx AS (
  SELECT symbol, max("Date") AS m FROM prices_v WHERE "Date" < TIMESTAMP '{PRICE_CUTOFF}' GROUP BY symbol)""") + """
SELECT symbol, "Date" FROM prices_v LEFT JOIN mx USING (symbol) WHERE m IS NULL OR "Date" > m"""
ORACLE["j4_insert_absent"] = _w(PRICES_V, PRICE_ROWS) + \
    "SELECT * FROM price_rows WHERE day(recorded_at) > 15"
ORACLE["x3_append_rows"] = _w(PRICES_V, PRICE_ROWS) + "SELECT * FROM price_rows"


def _upsert_sql(target: str, batch: str) -> str:
    return f"""t AS ({target}),
b0 AS ({batch}),
b AS (
  SELECT id, arg_min_null(title, doc_id) AS title, arg_min_null(body, doc_id) AS body,
         arg_min_null(published_at, doc_id) AS published_at,
         arg_min_null(created_at, doc_id) AS created_at,
         arg_max_null(url, doc_id) AS url, arg_max_null(keywords, doc_id) AS keywords
  FROM b0 GROUP BY id)
SELECT coalesce(t.id, b.id) AS id,
       CASE WHEN t.id IS NOT NULL THEN t.title ELSE b.title END AS title,
       CASE WHEN t.id IS NOT NULL THEN t.body ELSE b.body END AS body,
       CASE WHEN t.id IS NOT NULL THEN t.published_at ELSE b.published_at END AS published_at,
       CASE WHEN b.id IS NOT NULL THEN b.url ELSE t.url END AS url,
       CASE WHEN b.id IS NOT NULL THEN b.keywords ELSE t.keywords END AS keywords,
       CASE WHEN t.id IS NOT NULL THEN t.created_at ELSE b.created_at END AS created_at
FROM t FULL OUTER JOIN b ON t.id = b.id"""


NEWS_TABLE = """news_t AS (
  SELECT id, title, body, published_at, url, keywords, NULL::TIMESTAMP AS created_at, doc_id FROM news_v)"""

ORACLE["j5_upsert"] = _w(NEWS_V, NEWS_TABLE) + ", " + _upsert_sql(
    f"SELECT * EXCLUDE (doc_id) FROM news_t WHERE {_feed_in(LOADED_FEEDS)}",
    "SELECT id, title, body, published_at + INTERVAL 1 DAY AS published_at, url || '?v2' AS url, "
    f"keywords, created_at, doc_id FROM news_t WHERE {_feed_in(BATCH_FEEDS)}")

ORACLE["c1_merge_news"] = _w(NEWS_V, NEWS_TABLE) + ", " + _upsert_sql(
    f"SELECT * EXCLUDE (doc_id) FROM news_t WHERE {_feed_in(LOADED_FEEDS)}",
    "SELECT id, title, body, published_at, url, keywords || '|new' AS keywords, created_at, doc_id "
    f"FROM news_t WHERE published_at > (SELECT max(published_at) FROM news_t WHERE {_feed_in(LOADED_FEEDS)})")

ORACLE["s10_ensure_columns"] = _w(NEWS_V) + \
    "SELECT id, title, doc_id, NULL::VARCHAR AS url, NULL::VARCHAR AS keywords FROM news_v"
ORACLE["a3_title_exists"] = _w(NEWS_V, """asked AS (
  SELECT title FROM news_v UNION ALL SELECT title || ' (draft)' FROM news_v)""") + """
SELECT title, title IN (SELECT title FROM news_v WHERE """ + _feed_in(LOADED_FEEDS) + """) AS "exists" FROM asked"""

# --- conversations -----------------------------------------------------------

FLAGGED = "flagged AS (SELECT DISTINCT session_id AS id FROM chat_v WHERE sender = 'system')"
ORACLE["j6_delete_sessions"] = _w(CHAT_V, SESSIONS_V, FLAGGED) + \
    "SELECT * FROM sessions_v WHERE id NOT IN (SELECT id FROM flagged)"
ORACLE["j6_delete_messages"] = _w(CHAT_V, FLAGGED) + \
    "SELECT id, session_id FROM chat_v WHERE session_id NOT IN (SELECT id FROM flagged)"
ORACLE["j7_rename_sessions"] = _w(SESSIONS_V) + """
SELECT s.id, s.created_at,
       coalesce('renamed ' || c.conv_id::VARCHAR || ' ' || c.turn::VARCHAR, s.title) AS title
FROM sessions_v s
LEFT JOIN (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role <> 'system' AND length(text) >= 40 GROUP BY conv_id) c
  ON s.id = 's-' || c.conv_id::VARCHAR"""
ORACLE["l5_histories"] = _w(CHAT_V) + """
SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS pos
FROM chat_v"""
ORACLE["l5_history_one"] = _w(CHAT_V) + \
    """SELECT row_number() OVER (ORDER BY created_at, id) AS pos, sender, message, created_at
FROM chat_v WHERE session_id = 's-3'"""
ORACLE["l6_list_sessions"] = _w(SESSIONS_V) + """
SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos, id, title, created_at FROM sessions_v"""
ORACLE["c6_rejected_messages"] = _w(CHAT_V, SESSIONS_V, KNOWN_SESSIONS) + """
SELECT * FROM (
  SELECT id, CASE
      WHEN coalesce(session_id, '') = '' OR coalesce(sender, '') = '' OR coalesce(message, '') = ''
        THEN 'missing field'
      WHEN sender NOT IN ('user', 'bot') THEN 'bad sender'
      WHEN session_id NOT IN (SELECT id FROM known) THEN 'unknown session' END AS reason
  FROM chat_v) WHERE reason IS NOT NULL"""
ORACLE["c6_append_messages"] = _w(CHAT_V, SESSIONS_V, KNOWN_SESSIONS) + """
SELECT id, session_id, sender, message, created_at FROM chat_v WHERE created_at < TIMESTAMP '2024-01-03 00:00:00'
UNION ALL
SELECT id, session_id, sender, message, created_at FROM chat_v WHERE created_at >= TIMESTAMP '2024-01-03 00:00:00'
  AND coalesce(session_id, '') <> '' AND coalesce(sender, '') <> '' AND coalesce(message, '') <> ''
  AND sender IN ('user', 'bot') AND session_id IN (SELECT id FROM known)"""
ORACLE["c6_create_sessions"] = _w(SESSIONS_V, """new AS (
  SELECT 'n-' || conv_id::VARCHAR AS id,
         TIMESTAMP '2024-03-01 00:00:00' + to_hours(conv_id::BIGINT) AS created_at
  FROM conversations GROUP BY conv_id)""", """n0 AS (SELECT count(*) AS n FROM sessions_v WHERE title LIKE '新對話 %')""") + """
SELECT id, created_at, title FROM sessions_v
UNION ALL
SELECT id, created_at,
       '新對話 ' || ((SELECT n FROM n0) + row_number() OVER (ORDER BY created_at, id))::VARCHAR AS title
FROM new"""
ORACLE["a6_join_lines"] = """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id"""

# --- scalars -------------------------------------------------------------------

ORACLE["p1_content_key"] = _w(NEWS_V) + "SELECT doc_id, md5(title || body) AS key FROM news_v"
ORACLE["p2_document_text"] = _w(NEWS_V) + """
SELECT doc_id, md5(title || chr(10) || body) AS text_md5, length(title || chr(10) || body) AS text_len
FROM news_v"""
ORACLE["p3_pair_symbol"] = "SELECT c_name AS symbol, c_name || 'USDT' AS pair FROM customer"
ORACLE["p6_volume_or_null"] = _w(PRICES_V) + """
SELECT symbol, "Date", CASE WHEN "Volume" - 1.0 <> 0 THEN "Volume" - 1.0 END AS v FROM prices_v"""
ORACLE["p8_to_epoch"] = _w(NEWS_V) + """
SELECT doc_id, epoch(timezone('Asia/Taipei', published_at)) AS epoch,
       strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_time
FROM news_v"""
ORACLE["p9_epoch_to_local"] = """
SELECT o_orderkey,
       strftime(timezone('Asia/Taipei', to_timestamp(epoch(o_orderdate) + o_orderkey * 37)),
                '%Y-%m-%d %H:%M:%S') AS local_time
FROM orders"""
ORACLE["p10_millis_to_date"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS d_utc,
       strftime(timezone('Asia/Taipei', timezone('UTC', ts)), '%Y-%m-%d') AS d_taipei
FROM events"""
ORACLE["p12_or_default"] = _w(NEWS_V) + """
SELECT doc_id, coalesce(CASE WHEN body <> '' THEN title END, '無標題') AS title FROM news_v"""


def _translate(expr: str) -> str:
    for src, dst in COIN_TRANSLATION:
        expr = f"replace({expr}, {_lit(src)}, {_lit(dst)})"
    return expr


ORACLE["p13_translate"] = _w(QTEXT) + f"SELECT qid, md5({_translate('question')}) AS translated_md5 FROM qtext"
ORACLE["p14_short_date"] = """
SELECT o_orderkey,
       regexp_matches(strftime(o_orderdate, '%-m/%-d/%y'), '^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/\\d{2}$') AS m_a,
       regexp_matches(strftime(o_orderdate, '%m/%d/%y'), '^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/\\d{2}$') AS m_b,
       regexp_matches(strftime(o_orderdate, '%-d/%-m/%y'), '^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/\\d{2}$') AS m_c,
       regexp_matches(strftime(o_orderdate, '%-m/%-d/%Y'), '^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/\\d{2}$') AS m_e
FROM orders"""
ORACLE["p15_word_count"] = f"""
SELECT conv_id, turn, len(regexp_extract_all(text, {WP})) AS n_words FROM conversations"""
ORACLE["p16_indicator_line"] = _w(PRICES_V) + """
SELECT symbol, "Date",
       symbol || '（' || strftime("Date", '%Y-%m-%d') || '）：RSI=' || "Volume"::DECIMAL(10,4)::VARCHAR
       || ', MACD=' || "Close"::DECIMAL(20,8)::VARCHAR || ', Signal=None'
       || ', BB(上/中/下)=' || "Close"::DECIMAL(20,8)::VARCHAR || '/' || "Volume"::DECIMAL(20,8)::VARCHAR
       || '/None' AS line
FROM prices_v"""
ORACLE["p17_source_line"] = _w(NEWS_V) + "SELECT doc_id, title || ' : ' || url AS line FROM news_v"
ORACLE["p18_iso_timestamp"] = """
SELECT event_id,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
       strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso_s
FROM events"""
ORACLE["p20_preview"] = "SELECT doc_id, md5(substr(text, 1, 200)) AS preview_md5 FROM documents"
ORACLE["p21_strip"] = f"""
SELECT conv_id, turn,
       md5(regexp_replace(' ' || chr(9) || text || chr(10) || ' ',
                          '^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+$', '', 'g')) AS stripped_md5
FROM conversations"""

# --- retrieval -------------------------------------------------------------------

SCORED = """scored AS (
  SELECT q.qid, v.id, v.title, v."timestamp",
         list_sum(list_transform(list_zip(q.qvec, v.embedding),
                                 lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ^ 2)) AS distance
  FROM questions_v q CROSS JOIN {src} v)"""
RANKED = """hits AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM scored
  QUALIFY rank <= 5)"""

KNN = _w(NEWS_V, VECTORS_V, QUESTIONS_V, SCORED.format(src="vectors_v"), RANKED) + """
SELECT qid, id, round(distance, 6) AS distance, rank FROM hits"""
ORACLE["j8_knn"] = KNN
ORACLE["j8_knn_tiles"] = KNN
ORACLE["l2_newest_first"] = _w(NEWS_V, VECTORS_V, QUESTIONS_V, SCORED.format(src="vectors_v"), RANKED) + """
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY "timestamp" DESC, distance, id) AS pos FROM hits"""
ORACLE["j1_attach_sources"] = _w(NEWS_V, VECTORS_V, QUESTIONS_V, SCORED.format(src="vectors_v"), RANKED,
                                 NEWS_FIRST, """tbl AS (
  SELECT id, CASE WHEN NOT """ + _feed_in(["de"]) + """ THEN url END AS url FROM news_first
  WHERE NOT """ + _feed_in(["es"]) + ")") + """
SELECT h.qid, h.id,
       CASE WHEN t.id IS NULL THEN '無連結' ELSE coalesce(t.url, 'None') END AS url_text,
       coalesce(h.title, '無標題') || ' : ' ||
         (CASE WHEN t.id IS NULL THEN '無連結' ELSE coalesce(t.url, 'None') END) AS source
FROM hits h LEFT JOIN tbl t ON h.id = t.id"""
ORACLE["c4_search"] = _w(NEWS_V, VECTORS_V, QUESTIONS_V, SCORED.format(src="vectors_v"), RANKED) + """
SELECT h.qid, h.id, coalesce(v.title, '無標題') AS title, coalesce(v.content, '無內容') AS content,
       coalesce(v.published_time, '未知時間') AS published_time, round(h.distance, 6) AS score, h.rank
FROM hits h JOIN vectors_v v ON h.id = v.id"""
ORACLE["c4_get_by_id"] = _w(NEWS_V, VECTORS_V) + """
SELECT id, coalesce(title, '無標題') AS title, coalesce(content, '無內容') AS content,
       coalesce(published_time, '未知時間') AS published_time
FROM vectors_v WHERE id IN (SELECT id FROM news_v JOIN labels USING (doc_id) WHERE toxic = 1)"""
ORACLE["c5_delete_vectors"] = _w(NEWS_V, VECTORS_V) + """
SELECT vec_id FROM vectors_v WHERE id NOT IN (SELECT id FROM news_v JOIN labels USING (doc_id) WHERE toxic = 1)"""


def _coins_sql(text: str) -> str:
    up = f"upper({_translate(text)})"
    ment = (f"list_filter({_list(TICKERS)}, lambda t: regexp_matches({up}, "
            f"'(^|[^A-Z0-9])' || t || '([^A-Z0-9]|$)'))")
    besides = " OR ".join(f"contains({up}, {_lit(w)})" for w in EXCLUSION_WORDS)
    return (f"CASE WHEN len({ment}) = 0 THEN {_list(DEFAULT_COINS)} "
            f"WHEN {besides} THEN list_filter({_list(POPULAR)}, lambda p: NOT list_contains({ment}, p)) "
            f"ELSE {ment} END")


COINS = f"""coins AS (
  SELECT qid, unnest(range(0, len(cs))) AS pos, unnest(cs) AS symbol
  FROM (SELECT qid, {_coins_sql('question')} AS cs FROM qtext))"""

ORACLE["p19_coins_from_json"] = """
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS qid, unnest([0, 1]) AS pos, unnest([upper(role), 'ETH']) AS symbol
FROM conversations WHERE turn % 2 = 0
UNION ALL
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS qid, 0 AS pos, 'BTC' AS symbol FROM conversations WHERE turn % 2 <> 0"""

ORACLE["u4_tag_coins"] = _w(QTEXT, COINS) + "SELECT qid, pos, symbol FROM coins"

_TICKER_MAP = "tmap(symbol, ticker) AS (VALUES " + ", ".join(
    f"({_lit(a)}, {_lit(b)})" for a, b in SYMBOL_MAP) + ")"


def _prompts_sql() -> str:
    ctes = [*IND_CTES, IND_ROWS, _TICKER_MAP, """tind AS (
  SELECT m.ticker AS symbol, r.recorded_at,
         round_even(r.rsi_14, 2)::DECIMAL(20,2) AS rsi_14, round_even(r.macd, 2)::DECIMAL(20,2) AS macd,
         round_even(r.macd_signal, 2)::DECIMAL(20,2) AS macd_signal,
         round_even(r.bb_upper, 2)::DECIMAL(20,2) AS bb_upper,
         round_even(r.bb_middle, 2)::DECIMAL(20,2) AS bb_middle,
         round_even(r.bb_lower, 2)::DECIMAL(20,2) AS bb_lower
  FROM ind_rows r JOIN tmap m ON r.symbol = m.symbol)""", """latest AS (
  SELECT symbol, max(recorded_at) AS recorded_at,
         arg_max_null(rsi_14, recorded_at) AS rsi_14, arg_max_null(macd, recorded_at) AS macd,
         arg_max_null(macd_signal, recorded_at) AS macd_signal,
         arg_max_null(bb_upper, recorded_at) AS bb_upper, arg_max_null(bb_middle, recorded_at) AS bb_middle,
         arg_max_null(bb_lower, recorded_at) AS bb_lower
  FROM tind GROUP BY symbol)""", NEWS_V, VECTORS_V, QTEXT, """questions_v AS (
  SELECT e.vec_id AS qid, e.embedding AS qvec FROM embeddings e
  JOIN qtext t ON e.vec_id = t.qid WHERE coalesce(t.question, '') <> '')""",
            f"""recent AS (SELECT * FROM vectors_v WHERE "timestamp" >= {FLOOR_EPOCH!r})""",
            SCORED.format(src="recent"), RANKED, NEWS_FIRST, """src AS (
  SELECT h.qid,
         row_number() OVER (PARTITION BY h.qid ORDER BY h."timestamp" DESC, h.distance, h.id) AS pos,
         coalesce(h.title, '無標題') || ' : ' ||
           (CASE WHEN n.id IS NULL THEN '無連結' ELSE coalesce(n.url, 'None') END) AS source
  FROM hits h LEFT JOIN news_first n ON h.id = n.id)""", """ctx AS (
  SELECT qid, string_agg(source, chr(10) ORDER BY pos) AS context, count(*) AS n_hits FROM src GROUP BY qid)""",
            COINS.replace("FROM qtext", "FROM qtext WHERE qid IN (SELECT qid FROM questions_v)"), """names AS (
  SELECT qid, string_agg(symbol, ', ' ORDER BY pos) AS coin_names FROM coins GROUP BY qid)""", """lines AS (
  SELECT c.qid, c.pos,
         c.symbol || '（' || strftime(l.recorded_at, '%Y-%m-%d') || '）：RSI=' || coalesce(l.rsi_14::VARCHAR, 'None')
         || ', MACD=' || coalesce(l.macd::VARCHAR, 'None') || ', Signal=' || coalesce(l.macd_signal::VARCHAR, 'None')
         || ', BB(上/中/下)=' || coalesce(l.bb_upper::VARCHAR, 'None') || '/' || coalesce(l.bb_middle::VARCHAR, 'None')
         || '/' || coalesce(l.bb_lower::VARCHAR, 'None') AS line
  FROM coins c JOIN latest l ON c.symbol = l.symbol)""", """itext AS (
  SELECT qid, string_agg(line, chr(10) ORDER BY pos) AS indicators_text FROM lines GROUP BY qid)"""]
    from marketpulse.plans.prompts import (
        SYSTEM_PROMPT, USER_HEAD, USER_INDICATORS, USER_NEWS, USER_QUESTION,
    )
    body = f"""
SELECT q.qid, t.question, {_lit(SYSTEM_PROMPT)} AS system,
       {_lit(USER_HEAD)} || coalesce(nm.coin_names, '') || {_lit(USER_NEWS).replace(chr(10), "' || chr(10) || '")}
       || coalesce(c.context, '') || {_lit(USER_INDICATORS).replace(chr(10), "' || chr(10) || '")}
       || coalesce(it.indicators_text, '') || {_lit(USER_QUESTION).replace(chr(10), "' || chr(10) || '")}
       || t.question AS "user",
       coalesce(c.n_hits, 0) AS n_hits
FROM questions_v q JOIN qtext t ON q.qid = t.qid
LEFT JOIN ctx c ON q.qid = c.qid LEFT JOIN names nm ON q.qid = nm.qid LEFT JOIN itext it ON q.qid = it.qid"""
    return _wr(*ctes) + body


ORACLE["u5_build_prompts"] = _prompts_sql()

ORACLE["u1_summarize"] = _w(NEWS_V) + f"""
SELECT doc_id, md5(CASE WHEN len(regexp_extract_all(body, {WP})) < 30 THEN body
                        ELSE array_to_string(regexp_extract_all(body, {WP})[1:50], ' ') END) AS summary_md5
FROM news_v"""

_LABEL = "CASE length({0}) % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'Neutral' END"
ORACLE["f9_enriched_news"] = _w(NEWS_V, f"""s AS (
  SELECT published_at, title, CASE WHEN len(regexp_extract_all(body, {WP})) < 30 THEN body
                                   ELSE 'summary: ' || substr(body, 1, 80) END AS summary FROM news_v)""") + f"""
SELECT strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_time, md5(title) AS title_md5, md5(summary) AS summary_md5,
       {_LABEL.format('summary')} AS sentiment
FROM s"""
ORACLE["u2_classify"] = f"SELECT doc_id, {_LABEL.format('text')} AS label FROM documents"
# the public 32-bit MurmurHash3 of a token's UTF-8 bytes, seed 42 (fixed values: its constants), modulo 1024
_M32 = 0xFFFFFFFF


def _times(x: str, c: int) -> str:
    return f"(({x})::HUGEINT * {c} % 4294967296)::BIGINT"


def _rotated(x: str, n: int) -> str:
    return f"((({x}) << {n}) & {_M32} | (({x}) >> {32 - n}))"


def _word(k: str) -> str:
    return _times(_rotated(_times(k, 0xCC9E2D51), 15), 0x1B873593)


def _octet(at: str) -> str:
    return f"('0x' || substr(hx, 2 * ({at}) + 1, 2))::BIGINT"


_BUCKETS = f"""tok AS (SELECT t, hex(encode(t)) AS hx, octet_length(encode(t))::BIGINT AS n FROM (SELECT DISTINCT t FROM tf)),
wrd AS (SELECT t, hx, n, list_transform(range(0, n // 4), lambda i: {_octet('4 * i')} + 256 * {_octet('4 * i + 1')}
                         + 65536 * {_octet('4 * i + 2')} + 16777216 * {_octet('4 * i + 3')}) AS ks FROM tok),
h0 AS (SELECT t, hx, n, list_reduce(list_prepend(42::BIGINT, ks),
                         lambda h, k: ({_times(_rotated(f"xor(h, {_word('k')})", 13), 5)} + 3864292196) & {_M32}) AS h FROM wrd),
h1 AS (SELECT t, n, CASE WHEN n % 4 = 0 THEN h ELSE xor(h, {_word(
    f"({_octet('n // 4 * 4')} + CASE WHEN n % 4 > 1 THEN 256 * {_octet('n // 4 * 4 + 1')} ELSE 0 END + CASE WHEN n % 4 > 2 THEN 65536 * {_octet('n // 4 * 4 + 2')} ELSE 0 END)")}) END AS h FROM h0),
h2 AS (SELECT t, xor(h, n) AS h FROM h1),
h3 AS (SELECT t, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM h2),
h4 AS (SELECT t, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM h3),
bkt AS (SELECT t, xor(h, h >> 16) & 1023 AS b FROM h4)"""
ORACLE["u3_embed"] = f"""WITH tf AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WP})) AS t FROM documents) GROUP BY ALL),
{_BUCKETS},
v AS (SELECT doc_id, b, sum(c) AS c FROM tf JOIN bkt USING (t) GROUP BY ALL),
i AS (SELECT b, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM v GROUP BY b),
w AS (SELECT doc_id, c * idf AS x FROM v JOIN i USING (b)),
s AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm, count(*) FILTER (WHERE x <> 0) AS n_set, max(x) AS top, sum(x) AS total FROM w GROUP BY doc_id)
SELECT doc_id, 1024 AS dim, CASE WHEN nrm > 0 THEN 1.0 ELSE 0.0 END AS norm, coalesce(n_set, 0)::INTEGER AS n_set,
       coalesce(round(top / nrm, 3), 0.0) AS greatest, coalesce(round(total / nrm, 2), 0.0) AS total
FROM documents LEFT JOIN s USING (doc_id)"""
_VECTOR_ROWS = """
SELECT id, md5(title || chr(10) || body) AS content_md5, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_time,
       epoch(published_at) AS "timestamp", (length(title || chr(10) || body) % 1000)::DOUBLE AS e1,
       ((length(title || chr(10) || body) - length(replace(title || chr(10) || body, 'a', ''))) % 1000)::DOUBLE AS e2
FROM """
ORACLE["s11_rebuild_vectors"] = _w(NEWS_V) + _VECTOR_ROWS + "news_v"
ORACLE["c1_run_vectors"] = _w(NEWS_V, """first AS (
  SELECT * FROM news_v QUALIFY row_number() OVER (PARTITION BY title ORDER BY published_at) = 1)""") + _VECTOR_ROWS + "first"

ORACLE["c9_sql"] = """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000.0"""

# --- sources -----------------------------------------------------------------------

ORACLE["s1_read_news"] = _w(NEWS_V) + f"""
SELECT md5(title || chr(1) || body) AS row_md5, epoch(published_at)::BIGINT AS "timestamp", published_at,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE url END AS url, keywords
FROM news_v
WHERE doc_id % 11 <> 0 AND title NOT IN {TOKENS} AND body NOT IN {TOKENS}"""

ORACLE["s4_decode_articles"] = _w(NEWS_V) + """
SELECT epoch(published_at)::BIGINT AS "timestamp",
       strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS published_time,
       md5(title || body) AS id, url,
       CASE WHEN doc_id % 7 IN (0, 1, 2) THEN 'N/A' ELSE keywords END AS keywords
FROM news_v"""

ORACLE["s5_decode_candles"] = _w(PRICES_V) + """
SELECT symbol, strftime("Date", '%Y-%m-%d') AS "Date", round("Close" - 1, 2) AS "Open", round("Close" + 2, 2) AS "High",
       round("Close" - 2, 2) AS "Low", "Close", "Volume"
FROM prices_v"""

ORACLE["s6_decode_listings"] = """
SELECT c_custkey // 100 AS page, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS pos, c_name AS symbol
FROM customer"""

_PAGE_TEXTS = f"""o AS (SELECT o_orderkey % 97 AS k, min(o_orderdate) AS d FROM orders GROUP BY 1),
t AS (SELECT conv_id AS page_id, turn, role || ' < 9' AS author, coalesce(strftime(d, '%-m/%-d/%y'), '1/2/24') AS day,
             regexp_replace(coalesce(text, ''), '^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+$', '', 'g') AS title,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n
      FROM conversations LEFT JOIN o ON conv_id % 97 = k)"""
ORACLE["s7_extract_texts"] = f"""WITH {_PAGE_TEXTS}
SELECT page_id, 3 * n AS pos, md5(author) AS text_md5 FROM t
UNION ALL SELECT page_id, 3 * n + 1, md5(day) FROM t
UNION ALL SELECT page_id, 3 * n + 2, md5(title) FROM t"""
ORACLE["c8_extract_triples"] = f"""WITH {_PAGE_TEXTS}
SELECT page_id, 3 * n AS pos, author AS "Youtuber", day AS "Date", md5(title) AS title_md5 FROM t
QUALIFY row_number() OVER (PARTITION BY title ORDER BY page_id, n) = 1"""

# --- streaming -----------------------------------------------------------------------

ORACLE["t1_stream_ingest"] = _w(NEWS_V) + """
SELECT id, arg_min_null(title, doc_id) AS title, arg_min_null(body, doc_id) AS body,
       arg_min_null(published_at, doc_id) AS published_at,
       arg_max_null(url, doc_id) AS url, arg_max_null(keywords, doc_id) AS keywords,
       NULL::TIMESTAMP AS created_at
FROM news_v GROUP BY id"""
ORACLE["t1_stream_dedup"] = _w(NEWS_V) + "SELECT doc_id, id, url, published_at FROM news_v"
ORACLE["t1_stream_prices"] = _w(PRICES_V, PRICE_ROWS) + \
    f"SELECT * FROM price_rows WHERE recorded_at < TIMESTAMP '{CLOSED_BEFORE:%Y-%m-%d}'"

BARS_V = """prices_v AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS "Date", arg_max(value, ts) AS "Close"
  FROM events GROUP BY 1, 2)"""

ORACLE["t2_stream_indicators"] = INDICATORS.replace(PRICES_V, BARS_V)
ORACLE["t2_stream_from_state"] = ORACLE["t2_stream_indicators"]


# --- files and table sinks ---------------------------------------------------

BARS_FULL = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS "Date",
         arg_min(value, ts) AS "Open", max(value) AS "High", min(value) AS "Low",
         arg_max(value, ts) AS "Close", count(*)::DOUBLE AS "Volume"
  FROM events GROUP BY 1, 2)"""
ORACLE["s3_read_prices"] = _w(BARS_FULL) + "SELECT * FROM bars"
ORACLE["s3_missing_symbols"] = f"""
SELECT symbol FROM (VALUES {', '.join(f'({_lit(s)})' for s in WANTED_SYMBOLS)}) w(symbol)
WHERE symbol NOT IN (SELECT DISTINCT event_type FROM events) AND symbol <> 'LEO'"""
ORACLE["s2_read_news_strict"] = _w(NEWS_V) + """
SELECT title, published_at, md5(body) AS body_md5 FROM (
  SELECT title, published_at, coalesce(body, '') AS body,
         row_number() OVER (PARTITION BY title ORDER BY published_at) AS rn
  FROM news_v) WHERE rn = 1"""
ORACLE["s2_read_news_newest_first"] = _w(NEWS_V) + """
SELECT title, TIMESTAMP '2024-01-01 00:00:00' AS published_at, md5(coalesce(body, '')) AS body_md5 FROM (
  SELECT title, body, row_number() OVER (PARTITION BY title ORDER BY doc_id * 8 // (last + 1), doc_id DESC) AS rn
  FROM news_v, (SELECT max(doc_id) AS last FROM news_v)) WHERE rn = 1"""
ORACLE["s10_merge_schema"] = _w(NEWS_V) + """
SELECT doc_id, id, title, CASE WHEN keywords NOT LIKE 'en|%' THEN url END AS url,
       CASE WHEN keywords NOT LIKE 'en|%' THEN keywords END AS keywords, NULL::TIMESTAMP AS created_at FROM news_v"""
ORACLE["c1_run_vectors_twice"] = _w(NEWS_V) + """,
early AS (SELECT DISTINCT ON (title) id, title, body FROM news_v WHERE published_at < TIMESTAMP '2024-01-01 06:00:00' ORDER BY title, doc_id),
every AS (SELECT DISTINCT ON (title) id, title, body FROM news_v ORDER BY title, doc_id)
SELECT id, length(title || chr(10) || body) AS size, 1 AS load FROM early
UNION ALL SELECT id, length(title || chr(10) || body), 2 FROM every WHERE id NOT IN (SELECT id FROM early)"""
ORACLE["s9_partitioned_table"] = _w(PRICES_V, PRICE_ROWS) + "SELECT * FROM price_rows"
ORACLE["a7_rows_written"] = _w(PRICES_V, NEWS_V) + """
SELECT 'prices' AS load, 1 AS run, count(*) AS n_rows FROM prices_v
UNION ALL SELECT 'prices', 2, 0
UNION ALL SELECT 'news', 1, count(*) FROM news_v WHERE published_at < TIMESTAMP '2024-01-01 06:00:00'
UNION ALL SELECT 'news', 2, count(*) FROM news_v WHERE published_at >= TIMESTAMP '2024-01-01 06:00:00'
UNION ALL SELECT 'news', 3, 0"""
ORACLE["s12_create_tables"] = _w(PRICES_V) + """
SELECT name, CASE name WHEN 'crypto_prices' THEN (SELECT count(*) FROM prices_v) ELSE 0 END AS n_rows
FROM (VALUES ('news'), ('crypto_prices'), ('crypto_indicators'), ('chat_sessions'), ('chat_messages')) t(name)"""
ORACLE["c1_run_news_twice"] = _w(NEWS_V) + f"""
SELECT id, arg_min(published_at, doc_id) AS published_at, arg_max(url, doc_id) AS url, arg_max(keywords, doc_id) AS keywords
FROM news_v WHERE title NOT IN {TOKENS} AND body NOT IN {TOKENS} GROUP BY id"""
ORACLE["c2_run_prices_twice"] = _w(PRICES_V, PRICE_ROWS) + "SELECT * FROM price_rows"
ORACLE["c3_run_indicators_twice"] = _wr(*IND_CTES, IND_ROWS) + """
SELECT symbol, recorded_at, round(rsi_14::DECIMAL(10,4), 4) AS rsi_14,
       round(macd::DECIMAL(20,8), 4) AS macd, round(macd_signal::DECIMAL(20,8), 4) AS macd_signal,
       round(bb_upper::DECIMAL(20,8), 4) AS bb_upper, round(bb_middle::DECIMAL(20,8), 4) AS bb_middle,
       round(bb_lower::DECIMAL(20,8), 4) AS bb_lower
FROM ind_rows"""
