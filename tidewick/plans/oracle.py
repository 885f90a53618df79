"""DuckDB SQL of the registered queries, over the generated tables."""

from __future__ import annotations

AS_OF = "2024-01-30 12:02:30"
AS_OF_ALIGNED = "2024-01-30 12:00:00"
LENGTHS = (5, 15, 60, 240, 1440)

TRADES = """trades AS (
  SELECT event_id AS id, event_type || '/usd' AS market_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS order_type,
         value::DECIMAL(18,2) AS price, ((props->>'$.k')::INT + 1)::DECIMAL(18,0) AS amount,
         (value::DECIMAL(18,2) * ((props->>'$.k')::INT + 1)::DECIMAL(9,0))::DECIMAL(28,2) AS quote,
         date_trunc('second', ts) AS executed_at, user_id::VARCHAR AS maker, ((user_id * 7 + 3) % 150)::VARCHAR AS taker, event_id % 10 <> 0 AS done
  FROM events)"""

#: The candle after one more trade ``x``: the rules that depend on the order of trades.
_LOW, _HIGH = "CASE WHEN a.lo = 0 OR x.p < a.lo THEN x.p ELSE a.lo END", "CASE WHEN a.hi = 0 OR x.p > a.hi THEN x.p ELSE a.hi END"
_STEP = f"""{{'p': x.p, 'b': x.b, 'q': x.q, 'lo': {_LOW}, 'hi': {_HIGH},
  'bv': CASE WHEN a.zero THEN x.b ELSE (a.bv + x.b)::DECIMAL(38,2) END, 'qv': CASE WHEN a.zero THEN x.q ELSE (a.qv + x.q)::DECIMAL(38,2) END,
  'zero': CASE WHEN a.zero OR {_LOW} = {_HIGH} THEN x.p = 0 ELSE a.qv + x.q = 0 END,
  'av': CASE WHEN a.zero OR {_LOW} = {_HIGH} THEN x.p::DOUBLE ELSE (a.qv + x.q)::DOUBLE / (a.bv + x.b)::DOUBLE END}}"""
_FRESH = "{'p': %s, 'b': %s, 'q': %s, 'lo': 0::DECIMAL(18,2), 'hi': 0::DECIMAL(18,2), 'bv': 0::DECIMAL(38,2), 'qv': 0::DECIMAL(38,2), 'zero': true, 'av': 0::DOUBLE}"
_NONE = _FRESH % ("0::DECIMAL(18,2)", "0::DECIMAL(38,2)", "0::DECIMAL(38,2)")
_TRADE = _FRESH % ("price", "amount::DECIMAL(38,2)", "quote::DECIMAL(38,2)")

CANDLES = f"""keyed AS (SELECT *, time_bucket(to_minutes(m), executed_at, TIMESTAMP '1970-01-01') AS start_at FROM trades, (SELECT unnest({list(LENGTHS)}) AS m)),
plain AS (
  SELECT market_id, m, start_at, min(price) AS lo, max(price) AS hi, arg_min(price, (epoch_us(executed_at), id)) AS op, arg_max(price, (epoch_us(executed_at), -id)) AS cl,
         sum(amount) AS bv, sum(quote) AS qv, min(price) <= 0 OR min(quote) <= 0 AS dusty
  FROM keyed GROUP BY ALL),
folds AS (
  SELECT market_id, m, start_at, list_reduce(list_prepend({_NONE}, list({_TRADE} ORDER BY executed_at, id)), lambda a, x: {_STEP}) AS f
  FROM keyed SEMI JOIN (SELECT * FROM plain WHERE dusty) USING (market_id, m, start_at) GROUP BY ALL),
candles AS (
  SELECT market_id, m AS length, start_at, coalesce(f.lo, lo) AS lo, coalesce(f.hi, hi) AS hi, op, cl, coalesce(f.bv, bv) AS bv, coalesce(f.qv, qv) AS qv, f.av AS av
  FROM plain LEFT JOIN folds USING (market_id, m, start_at))"""

MARKETS = """markets AS (
  SELECT k.id, k.base || '/usd' AS market_id, k.base, coalesce(first, TIMESTAMP '2024-01-01') AS created
  FROM (VALUES (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'view'), (6, 'idle')) k(id, base)
  LEFT JOIN (SELECT market_id, min(executed_at) - INTERVAL 1 MINUTE AS first FROM trades GROUP BY 1) t ON t.market_id = k.base || '/usd')"""

ORDERS = """book AS (
  SELECT ['click', 'error', 'purchase', 'signup', 'view'][l_orderkey % 5 + 1] || '/usd' AS market_id,
         CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS order_type, l_extendedprice::DECIMAL(18,2) AS price, sum(l_quantity::DECIMAL(18,0)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY ALL)"""

LAST = """last AS (
  SELECT market_id, arg_max(price, (epoch_us(executed_at), -id)) AS last_price FROM trades
  WHERE executed_at > TIMESTAMP '{as_of}' - INTERVAL 24 HOUR GROUP BY 1)"""

CANDLE_COLUMNS = """market_id, length, start_at, start_at + to_minutes(length) AS end_at, lo::DOUBLE AS lowest_price, op::DOUBLE AS open_price,
  coalesce(av, CASE WHEN lo = hi THEN lo::DOUBLE ELSE qv::DOUBLE / bv::DOUBLE END) AS average_price, hi::DOUBLE AS highest_price, cl::DOUBLE AS close_price, bv::DOUBLE AS base_volume, qv::DOUBLE AS quote_volume"""


def shown(column: str) -> str:
    text = f"{column}::DECIMAL(38,18)::VARCHAR"
    return f"rtrim(rtrim({text}, '0'), '.')"


def candles(length: int | None = None) -> str:
    return f"WITH {TRADES}, {CANDLES} SELECT {CANDLE_COLUMNS} FROM candles" + (f" WHERE length = {length}" if length else "")


def _filled(as_of: str, length: int, limit: int) -> str:
    begin = f"greatest(TIMESTAMP '{as_of}' - to_minutes({limit * length}), created)"
    return f"""{TRADES}, {CANDLES}, {MARKETS},
r AS (SELECT market_id, {begin} AS begin FROM markets),
held AS (SELECT c.*, row_number() OVER (PARTITION BY market_id ORDER BY start_at DESC) AS place FROM candles c JOIN r USING (market_id) WHERE length = {length} AND start_at >= begin),
cut AS (SELECT * FROM held WHERE place <= {limit}),
full_markets AS (SELECT market_id FROM cut GROUP BY 1 HAVING count(*) = {limit}),
calendar AS (SELECT market_id, unnest(generate_series(time_bucket(to_minutes({length}), begin + to_minutes({length}) - INTERVAL 1 SECOND, TIMESTAMP '1970-01-01'),
               time_bucket(to_minutes({length}), TIMESTAMP '{as_of}', TIMESTAMP '1970-01-01'), to_minutes({length}))) AS start_at FROM r WHERE market_id NOT IN (SELECT market_id FROM full_markets)),
filled AS (SELECT market_id, {length} AS length, start_at, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, coalesce(op, 0) AS op, coalesce(cl, 0) AS cl, coalesce(bv, 0) AS bv, coalesce(qv, 0) AS qv, av FROM calendar LEFT JOIN cut USING (market_id, start_at)
  UNION ALL SELECT market_id, length, start_at, lo, hi, op, cl, bv, qv, av FROM cut WHERE market_id IN (SELECT market_id FROM full_markets))"""


def gapfilled(as_of: str, length: int, limit: int) -> str:
    return f"WITH {_filled(as_of, length, limit)} SELECT {CANDLE_COLUMNS} FROM filled"


def trading_view(as_of: str, length: int, limit: int) -> str:
    return f"""WITH {_filled(as_of, length, limit)} SELECT market_id, epoch(start_at)::BIGINT AS time, lo::DOUBLE AS low, op::DOUBLE AS open, hi::DOUBLE AS high, cl::DOUBLE AS close, bv::DOUBLE AS value FROM filled"""


_TICKERS = f"""{TRADES}, {CANDLES}, {MARKETS}, {ORDERS}, {LAST.format(as_of=AS_OF)},
best AS (SELECT market_id, max(price) FILTER (order_type = 'buy') AS bid, min(price) FILTER (order_type = 'sell') AS ask FROM book GROUP BY 1),
day AS (SELECT market_id, sum(bv) AS bv, sum(qv) AS qv, max(hi) AS hi, min(lo) AS lo, arg_min(op, start_at) AS op FROM candles
        WHERE length = 5 AND start_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1),
tickers AS (SELECT base, 'usd' AS quote, market_id, coalesce(last_price, 0)::DOUBLE AS last_price, coalesce(bv, 0)::DOUBLE AS base_volume, coalesce(qv, 0)::DOUBLE AS quote_volume,
  coalesce(bid, 0)::DOUBLE AS bid, coalesce(ask, 0)::DOUBLE AS ask, coalesce(hi, 0)::DOUBLE AS high, coalesce(lo, 0)::DOUBLE AS low, coalesce(op, 0)::DOUBLE AS open_price,
  round(CASE WHEN last_price IS NULL OR op IS NULL OR op <= 0 THEN 0.0::DOUBLE ELSE (last_price - op)::DOUBLE / op::DOUBLE * 100 END * 100) / 100 AS change
  FROM markets LEFT JOIN last USING (market_id) LEFT JOIN best USING (market_id) LEFT JOIN day USING (market_id))"""

_HISTORY = "id AS order_id, {p} AS price, {a} AS base_volume, {q} AS quote_volume, epoch_ms(executed_at)::VARCHAR AS executed_at, order_type, maker, taker".format(p=shown("price"), a=shown("amount"), q=shown("quote"))

_LEVELS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY market_id, order_type ORDER BY CASE WHEN order_type = 'buy' THEN -price ELSE price END) AS place FROM book),
levels AS (SELECT *, CASE WHEN order_type = 'buy' THEN count(*) OVER (PARTITION BY market_id, order_type) - place + 1 ELSE place END AS position FROM ranked WHERE {keep})"""

_NATION = "'u' || lower(replace(n_name, ' ', ''))"
_UNITS = f"units AS (SELECT {_NATION} AS denom, CASE WHEN n_nationkey <> 24 THEN n_nationkey % 7 + 3 END AS exponent FROM nation)"

_CONVERTED = f"""WITH {_UNITS},
n AS (SELECT n_nationkey AS k, {_NATION} AS denom FROM nation),
raw AS (SELECT l_orderkey * 10 + l_linenumber AS id, b.denom AS base, q.denom AS quote, ub.exponent AS be, uq.exponent AS qe,
        (l_extendedprice::DECIMAL(18,2) * 100)::BIGINT AS p4, l_quantity::BIGINT * 12345 AS amount,
        CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS order_type
        FROM lineitem JOIN n b ON b.k = l_suppkey % 24 JOIN n q ON q.k = l_partkey % 24 JOIN units ub ON ub.denom = b.denom JOIN units uq ON uq.denom = q.denom),
c AS (SELECT id, base || '/' || quote AS market_id, p4, amount, be, qe, order_type FROM raw)"""

_CHECKS = """checks AS (SELECT lower(c_mktsegment) || c_custkey AS address, c_custkey % 1000 * 500 AS min_amount, CASE WHEN c_custkey % 5 = 0 THEN 'uother' ELSE 'uusd' END AS denom,
    CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE trunc(abs(c_acctbal * 100))::BIGINT END AS amount FROM customer),
p(prefix, endpoint) AS (VALUES ('auto', 'a'), ('automobile1', 'a1'), ('build', 'b'), ('furn', 'f'), ('house', 'h')),
routed AS (SELECT c.*, (SELECT max(prefix) FROM p WHERE starts_with(c.address, prefix)) AS prefix FROM checks c),
checked AS (SELECT address, denom, CASE WHEN prefix IS NULL THEN 'no endpoint found for provided address'
    WHEN amount < min_amount THEN 'balance [' || amount || '] is less than min amount [' || min_amount || ']' ELSE '' END AS error FROM routed)"""

_NODES = """nodes AS (SELECT n_name AS name, CASE WHEN n_nationkey % 12 <> 11 THEN 100 + n_nationkey % 5 END::BIGINT AS height FROM nation),
lags AS (SELECT b.name AS behind, a.name AS ahead, b.height AS height_behind, a.height AS height_ahead FROM nodes a JOIN nodes b ON a.height - b.height > 2 AND a.name <> b.name)"""

_SUPPLY = f"""{_UNITS}, n AS (SELECT n_nationkey AS k, {_NATION} AS denom FROM nation),
coins AS (SELECT denom, sum(trunc(abs(s_acctbal) * 1000000)::BIGINT)::DOUBLE AS amount FROM supplier JOIN n ON k = s_nationkey GROUP BY 1),
pool AS (SELECT denom, sum(trunc(abs(c_acctbal) * 1000)::BIGINT)::DOUBLE AS held FROM customer JOIN n ON k = c_nationkey GROUP BY 1),
total AS (SELECT denom, exponent, printf('%.2f', amount / pow(10.0, exponent)) AS total FROM coins JOIN units USING (denom) WHERE exponent IS NOT NULL)"""

_ITEMS = """items AS (SELECT page_id AS position, 'Page ' || page_id AS title, url AS link,
  CASE WHEN page_id % 5 = 0 THEN '<img alt="x" src="https://cdn.example/' || page_id || '.png">' WHEN page_id % 5 = 1 THEN '<img src="https://else.example/x.png">' ELSE '' END || html AS body,
  CASE WHEN page_id % 2 = 0 THEN 'author ' || page_id ELSE '' END AS author FROM pages)"""


def _strip(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"


def _visible(column: str) -> str:
    """Markup of the forms that pages have, also if the page's end cuts it, and the references that they have."""
    bodies = f"regexp_replace({column}, '(?is)<(script|style)\\b[^>]*>.*?(</(script|style)\\s*>|\\z)|<!--.*?(-->|\\z)', '', 'g')"
    text = f"regexp_replace({bodies}, '(?s)<[/!a-zA-Z][^>]*(>|\\z)', '', 'g')"
    for found, shown in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')):
        text = f"replace({text}, '{found}', '{shown}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def _short(column: str) -> str:
    head = f"substr({column}, 1, list_max(list_filter(range(0, 151), lambda k: strlen(substr({column}, 1, k)) <= 150)))"
    return f"CASE WHEN strlen({column}) > 150 THEN {head} || '...' ELSE {column} END"


_IMAGE = """CASE WHEN contains(regexp_extract(body, '<img[^>]+src="([^">]+)"', 1), 'https://cdn') THEN regexp_extract(body, '<img[^>]+src="([^">]+)"', 1) ELSE '' END"""

ORACLES = {
    **{f"candles_{n}m": candles(n) for n in LENGTHS},
    "candles_all_lengths": candles(),
    "candles_since": f"WITH {TRADES}, {CANDLES} SELECT {CANDLE_COLUMNS} FROM candles WHERE length = 60 AND start_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR",
    "trading_view_all": f"WITH {TRADES}, {CANDLES} SELECT market_id, length, epoch(start_at)::BIGINT AS time, lo::DOUBLE AS low, op::DOUBLE AS open, hi::DOUBLE AS high, cl::DOUBLE AS close, bv::DOUBLE AS value FROM candles",
    "intervals_gapfilled": gapfilled(AS_OF, 5, 500),
    "intervals_gapfilled_aligned": gapfilled(AS_OF_ALIGNED, 60, 10),
    "intervals_gapfilled_days": gapfilled(AS_OF, 1440, 5000),
    "charts_stored": gapfilled(AS_OF, 15, 100),
    "intervals_tradingview": trading_view(AS_OF, 15, 500),
    "tickers_24h": f"WITH {_TICKERS} SELECT * FROM tickers",
    "tickers_coingecko": f"""WITH {_TICKERS} SELECT base || '_' || quote AS ticker_id, base AS base_currency, quote AS target_currency, market_id AS pool_id, last_price, base_volume,
  quote_volume AS target_volume, bid, ask, high, low FROM tickers""",
    "tickers_json_round_trip": f"WITH {_TICKERS} SELECT * FROM tickers",
    "candles_trimmed": f"""WITH {TRADES}, {CANDLES} SELECT market_id, length, start_at, {shown('lo')} AS lowest_price, {shown('op')} AS open_price, {shown('hi')} AS highest_price, {shown('cl')} AS close_price,
  {shown('bv')} AS base_volume, {shown('qv')} AS quote_volume FROM candles""",
    "time_buckets": f"""WITH {TRADES} SELECT id, {', '.join(f"time_bucket(to_minutes({n}), executed_at, TIMESTAMP '1970-01-01') AS start_{n}" for n in LENGTHS)},
  time_bucket(to_minutes(60), executed_at, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS end_60, epoch_ms(executed_at) AS millis, executed_at AS again FROM trades""",
    "price_change": f"""WITH {TRADES}, {CANDLES} SELECT market_id, length, start_at, round(CASE WHEN op <= 0 THEN 0.0::DOUBLE ELSE (cl - op)::DOUBLE / op::DOUBLE * 100 END * 100) / 100 AS change FROM candles""",
    "last_price_per_market": f"WITH {TRADES}, {MARKETS}, {LAST.format(as_of=AS_OF)} SELECT id, market_id, base, 'usd' AS quote, last_price::DOUBLE AS last_price FROM markets LEFT JOIN last USING (market_id)",
    "market_lookup": f"WITH {TRADES}, {MARKETS} SELECT id, market_id, base, created AS i_created_at FROM markets WHERE market_id = 'view/usd'",
    "first_trade_per_market": f"WITH {TRADES} SELECT market_id, min(executed_at) AS first_trade FROM trades GROUP BY 1",
    "oldest_unprocessed": f"WITH {TRADES} SELECT market_id, min(executed_at) AS first_trade FROM trades WHERE NOT done GROUP BY 1",
    "trades_since": f"WITH {TRADES} SELECT id, market_id, price::DOUBLE AS price, executed_at FROM trades WHERE executed_at >= TIMESTAMP '2024-01-15'",
    "dirty_days": f"WITH {TRADES} SELECT market_id, date_trunc('day', min(executed_at))::TIMESTAMP AS since FROM trades WHERE NOT done GROUP BY 1",
    "order_book_depth": f"WITH {ORDERS}, {_LEVELS.format(keep='place <= 10')} SELECT market_id, order_type, position, price::DOUBLE AS price, amount::DOUBLE AS amount FROM levels",
    "order_book_full": f"WITH {ORDERS}, {_LEVELS.format(keep='true')} SELECT market_id, order_type, position, price::DOUBLE AS price, amount::DOUBLE AS amount FROM levels",
    "order_book_documents": f"""WITH {ORDERS}, {_LEVELS.format(keep='place <= 10')} SELECT market_id, string_agg({shown('price')} || ':' || {shown('amount')}, ',' ORDER BY position) FILTER (order_type = 'buy') AS bids,
  string_agg({shown('price')} || ':' || {shown('amount')}, ',' ORDER BY position) FILTER (order_type = 'sell') AS asks, epoch(TIMESTAMP '{AS_OF}')::BIGINT::VARCHAR AS timestamp FROM levels GROUP BY market_id""",
    "order_book_coingecko": f"""WITH {ORDERS}, {_LEVELS.format(keep='place <= 5')} SELECT replace(market_id, '/', '_') AS ticker_id, string_agg({shown('price')} || ':' || {shown('amount')}, ',' ORDER BY position) FILTER (order_type = 'buy') AS bids,
  string_agg({shown('price')} || ':' || {shown('amount')}, ',' ORDER BY position) FILTER (order_type = 'sell') AS asks, epoch(TIMESTAMP '{AS_OF}')::BIGINT::VARCHAR AS timestamp FROM levels GROUP BY market_id""",
    "best_bid_ask": f"WITH {ORDERS} SELECT market_id, max(price) FILTER (order_type = 'buy')::DOUBLE AS bid, min(price) FILTER (order_type = 'sell')::DOUBLE AS ask FROM book GROUP BY 1",
    "history_filtered": f"WITH {TRADES} SELECT {_HISTORY} FROM trades WHERE market_id = 'view/usd' AND order_type = 'buy' AND executed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY trades.executed_at DESC, id DESC LIMIT 1000",
    "history_default": f"WITH {TRADES} SELECT {_HISTORY} FROM trades WHERE market_id = 'click/usd' ORDER BY trades.executed_at DESC, id DESC LIMIT 500",
    "history_by_address": f"WITH {TRADES} SELECT {_HISTORY} FROM trades WHERE maker = '17' OR taker = '17' ORDER BY trades.executed_at DESC, id DESC LIMIT 1000",
    "history_all_markets": f"WITH {TRADES} SELECT {_HISTORY} FROM trades ORDER BY trades.executed_at DESC, id DESC LIMIT 700",
    "history_buy_sell": f"""WITH {TRADES}, h AS (SELECT * FROM trades WHERE market_id = 'click/usd' ORDER BY executed_at DESC, id DESC LIMIT 500)
SELECT id AS trade_id, {shown('price')} AS price, {shown('amount')} AS base_volume, {shown('quote')} AS target_volume, epoch_ms(executed_at)::VARCHAR AS trade_timestamp, order_type AS type FROM h""",
    "history_arrays": f"""WITH {TRADES}, h AS (SELECT *, epoch_ms(executed_at) AS t FROM trades WHERE market_id = 'click/usd' ORDER BY executed_at DESC, id DESC LIMIT 500)
SELECT string_agg(id::VARCHAR, ',' ORDER BY t DESC, id DESC) FILTER (order_type = 'buy') AS buys, string_agg(id::VARCHAR, ',' ORDER BY t DESC, id DESC) FILTER (order_type <> 'buy') AS sells FROM h""",
    "market_health": f"""WITH {TRADES}, {MARKETS} SELECT market_id, coalesce(max(executed_at) > TIMESTAMP '2024-01-29 06:00:00' - INTERVAL 10 MINUTE, false) AS is_healthy, max(executed_at) AS last_trade
  FROM markets LEFT JOIN trades USING (market_id) GROUP BY 1""",
    "aggregator_health": f"""WITH {TRADES} SELECT coalesce(max(executed_at) > TIMESTAMP '2024-01-29 06:00:00' - INTERVAL 720 MINUTE, false) AS is_healthy, max(executed_at) AS last_sync
  FROM trades WHERE executed_at BETWEEN TIMESTAMP '2024-01-29 06:00:00' - INTERVAL 720 MINUTE AND TIMESTAMP '2024-01-29 06:00:00'""",
    "node_lag": f"WITH {_NODES} SELECT * FROM lags",
    "node_health": f"""WITH {_NODES}, e AS (SELECT 0 AS kind, name, '' AS other, 'failed to query: ' || name || ';' AS error FROM nodes WHERE height IS NULL
  UNION ALL SELECT 1, ahead, behind, behind || ' is behind ' || ahead || '. Expected height ' || height_ahead || ', found ' || height_behind FROM lags)
SELECT count(*) = 0 AS is_healthy, coalesce(string_agg(error, '' ORDER BY kind, name, other), '') AS errors FROM e""",
    "balance_checks": f"WITH {_CHECKS} SELECT address, denom, error = '' AS is_healthy, error FROM checked",
    "balance_health": f"WITH {_CHECKS} SELECT bool_and(error = '') AS is_healthy, coalesce(string_agg('[' || address || ']: [' || error || ']', '; ' ORDER BY address, denom) FILTER (error <> ''), '') AS errors FROM checked",
    "supply_total": f"WITH {_SUPPLY} SELECT denom, total FROM total",
    "supply_circulating": f"""WITH {_SUPPLY} SELECT denom, CASE WHEN denom <> 'unation_7' THEN total WHEN held IS NULL THEN '0' ELSE printf('%.2f', total::DOUBLE - held / pow(10.0, exponent)) END AS circulating
  FROM total LEFT JOIN pool USING (denom)""",
    "prices_flatten": "SELECT lower(n_name) AS denom, n_nationkey * 2.0::DOUBLE AS price, 'eur' AS price_denom FROM nation WHERE n_nationkey % 2 = 0",
    "asset_units": f"WITH {_UNITS} SELECT denom, substr(denom, 2) AS display, exponent FROM units",
    "unit_conversion": f"""{_CONVERTED} SELECT id, market_id, CASE WHEN be - qe >= 4 THEN p4::DOUBLE * pow(10.0, be - qe - 4) ELSE p4::DOUBLE / pow(10.0, 4 - be + qe) END AS price, amount::DOUBLE / pow(10.0, be) AS amount FROM c""",
    "unit_conversion_compat": f"""{_CONVERTED} SELECT market_id, count(*) AS trades,
  max(CASE WHEN be - qe <= -3 THEN 0.0 WHEN be - qe >= 4 THEN p4::DOUBLE * pow(10.0, be - qe - 4) ELSE p4::DOUBLE / pow(10.0, 4 - be + qe) END) AS highest,
  max(CASE WHEN be - qe <= -3 THEN 0.0 ELSE ((p4::HUGEINT * amount) // 10000)::DOUBLE / pow(10.0, qe) END) AS largest FROM c GROUP BY market_id""",
    "quote_amount": f"""{_CONVERTED} SELECT id, market_id, ((p4::HUGEINT * amount) // 10000)::DOUBLE / pow(10.0, qe) AS quote_amount FROM c""",
    "order_conversion": f"""{_CONVERTED}, s AS (SELECT *, CASE WHEN be - qe >= 4 THEN p4::DOUBLE * pow(10.0, be - qe - 4) ELSE p4::DOUBLE / pow(10.0, 4 - be + qe) END AS price FROM c)
SELECT market_id, order_type, count(*) AS levels, min(price) AS lowest, max(price) AS highest FROM s GROUP BY ALL""",
    "unit_conversion_compat_rows": f"""{_CONVERTED} SELECT id, market_id, amount::DOUBLE / pow(10.0, be) AS amount,
  CASE WHEN be - qe <= -3 THEN 0.0 WHEN be - qe >= 4 THEN p4::DOUBLE * pow(10.0, be - qe - 4) ELSE p4::DOUBLE / pow(10.0, 4 - be + qe) END AS price,
  CASE WHEN be - qe <= -3 THEN 0.0 ELSE ((p4::HUGEINT * amount) // 10000)::DOUBLE / pow(10.0, qe) END AS i_quote_amount FROM c""",
    "order_conversion_rows": f"""{_CONVERTED}, s AS (SELECT *, CASE WHEN be - qe >= 4 THEN p4::DOUBLE * pow(10.0, be - qe - 4) ELSE p4::DOUBLE / pow(10.0, 4 - be + qe) END AS shown FROM c)
SELECT id, market_id, order_type, shown AS price, amount::DOUBLE / pow(10.0, be) AS amount,
  CASE WHEN shown = 0 THEN 0.0 ELSE ((p4::HUGEINT * amount) // 10000)::DOUBLE / pow(10.0, qe) END AS i_quote_amount FROM s""",
    "strip_html": f"SELECT page_id, {_strip('html')} AS text FROM pages",
    "visible_text": f"SELECT page_id, {_visible('html')} AS text FROM pages",
    "short_description": f"WITH s AS (SELECT page_id, {_strip('html')} AS t FROM pages) SELECT page_id, {_short('t')} AS description FROM s",
    "shorten_documents": f"SELECT doc_id, {_short('text')} AS short FROM documents",
    "img_extract": f"WITH {_ITEMS} SELECT position, {_IMAGE} AS picture_url FROM items",
    "articles": f"""WITH {_ITEMS}, f AS (SELECT *, {_strip('body')} AS t FROM items ORDER BY position LIMIT 6)
SELECT title, link AS url, {_short('t')} AS description, TIMESTAMP '2024-01-01' AS publish_date, author AS author_name, {_IMAGE} AS picture_url FROM f""",
    "event_dispatch": f"""WITH {TRADES}, {MARKETS}, e AS (SELECT DISTINCT event_type FROM events),
k(event_type, process) AS (VALUES ('click', 'orders'), ('error', 'orders'), ('purchase', 'history'), ('purchase', 'candles'), ('purchase', 'orders'), ('view', 'orders'))
SELECT event_type || '/usd' AS market_id, process FROM e JOIN k USING (event_type) WHERE event_type <> 'error'
UNION ALL SELECT NULL, 'markets' FROM e WHERE event_type = 'signup'""",
    "event_listen": """SELECT 'chain.trade.' || kind AS type, market_id, sum(n)::BIGINT AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'OrderSavedEvent' WHEN 'error' THEN 'OrderCanceledEvent' WHEN 'purchase' THEN 'OrderExecutedEvent' WHEN 'view' THEN 'OrderSavedEvent' END AS kind,
         CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END || '/usd' AS market_id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS n FROM events WHERE event_type <> 'signup') GROUP BY ALL""",
    "event_listen_rows": """WITH heard AS (SELECT event_id::VARCHAR AS event_id, event_type,
  'chain.trade.' || CASE event_type WHEN 'error' THEN 'OrderCanceledEvent' WHEN 'purchase' THEN 'OrderExecutedEvent' ELSE 'OrderSavedEvent' END AS type,
  CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END || '/usd' AS market_id FROM events WHERE event_type <> 'signup')
SELECT event_id, type, market_id FROM heard UNION ALL SELECT event_id, type, market_id FROM heard WHERE event_type = 'purchase'""",
    "upsert_candles": f"""WITH {TRADES}, {CANDLES}, o AS (SELECT * FROM candles WHERE length = 60 AND start_at < TIMESTAMP '2024-01-20'), n AS (SELECT * FROM candles WHERE length = 60 AND start_at >= TIMESTAMP '2024-01-10')
SELECT market_id, start_at, cl::DOUBLE AS close_price, CASE WHEN o.market_id IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{AS_OF}' END AS i_created_at,
  CASE WHEN o.market_id IS NOT NULL AND n.market_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS i_updated_at FROM o FULL JOIN n USING (market_id, start_at, cl)""",
    "replace_trades": f"""WITH {TRADES} SELECT id, market_id, executed_at, done AND executed_at < TIMESTAMP '2024-01-20' AS i_added_to_interval FROM trades""",
    "replace_books": f"""WITH {ORDERS} SELECT market_id, order_type, price::DOUBLE AS price, CASE WHEN market_id IN ('click/usd', 'view/usd') THEN amount * 2 ELSE amount END::DOUBLE AS amount FROM book
  WHERE market_id NOT IN ('click/usd', 'view/usd') OR order_type = 'buy'""",
    "mark_processed": f"WITH {TRADES} SELECT id, done OR order_type = 'buy' AS i_added_to_interval FROM trades",
    "upsert_markets": f"""WITH {TRADES}, {MARKETS} SELECT id, market_id, CASE WHEN id <= 4 THEN 'genesis' ELSE 'sync' END AS created_by, CASE WHEN id >= 3 THEN TIMESTAMP '{AS_OF}' ELSE created END AS i_created_at FROM markets""",
    "candles_streamed": candles(),
    "candles_held": candles(),
    "book_request": f"""WITH {ORDERS}, {_LEVELS.format(keep='place <= 5')} SELECT replace(market_id, '/', '_') AS ticker_id, string_agg({shown('price')} || ':' || {shown('amount')}, ',' ORDER BY position) FILTER (order_type = 'buy') AS bids,
  string_agg({shown('price')} || ':' || {shown('amount')}, ',' ORDER BY position) FILTER (order_type = 'sell') AS asks, epoch(TIMESTAMP '{AS_OF}')::BIGINT::VARCHAR AS timestamp FROM levels WHERE market_id = 'view/usd' GROUP BY market_id""",
    "chart_request": f"""WITH {_filled(AS_OF, 60, 100)}, rows AS (SELECT {CANDLE_COLUMNS} FROM filled) SELECT * RENAME (length AS minutes) FROM rows WHERE market_id = 'click/usd'""",
    "candles_latest": f"""WITH {TRADES}, {CANDLES} SELECT market_id, start_at, (CASE WHEN start_at >= TIMESTAMP '2024-01-10' THEN cl + 1 ELSE cl END)::DOUBLE AS close_price,
  CASE WHEN start_at >= TIMESTAMP '2024-01-10' THEN TIMESTAMP '{AS_OF}' END AS i_updated_at FROM candles WHERE length = 60""",
    "market_creation": f"WITH {TRADES} SELECT market_id, min(executed_at) - INTERVAL 1 MINUTE AS i_created_at FROM trades GROUP BY 1",
    "listener_streamed": f"""WITH {TRADES}, {CANDLES}, {MARKETS}, {ORDERS}
SELECT 'markets' AS stored, market_id, id::BIGINT AS number, created AS at, NULL::DOUBLE AS price, NULL::DOUBLE AS amount FROM markets
UNION ALL SELECT 'trades', market_id, id, executed_at, price::DOUBLE, amount::DOUBLE FROM trades
UNION ALL SELECT 'candles', market_id, length, start_at, cl::DOUBLE, bv::DOUBLE FROM candles
UNION ALL SELECT 'orders', market_id, (price * 100)::BIGINT, NULL, price::DOUBLE, amount::DOUBLE FROM book""",
}
