"""The SQL each query is checked against, written for DuckDB.

Common table expressions are named once in ``CTES`` with the ones they build on;
``_sql`` puts together those a query needs.
"""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (tuple(needs.split()), sql)


def _sql(needs: str, body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in needs.split():
        visit(name)
    # Written out once each: an engine that inlines them would repeat the shared ones in every reader.
    head = ",\n".join(f"{n} AS {'' if _recursive(n) else 'MATERIALIZED '}({CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {head}\n{body}" if head else body


def _recursive(name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", CTES[name][1]) is not None


def _out(columns: str) -> str:
    """Select list from ``name[=expr]@kind``: r real, 2 or 4 real with so many places, x exact real, i whole, t time, d day."""
    parts = []
    for item in columns.split(";"):
        item = item.strip()
        spec, _, kind = item.rpartition("@") if "@" in item else (item, "", "")
        name, _, expr = spec.partition("=")
        name, expr = name.strip(), (expr or name).strip()
        form = {
            "r": "round(CAST({} AS DOUBLE), 6) + 0.0",
            "2": "round(CAST({} AS DOUBLE), 2) + 0.0",
            "4": "round(CAST({} AS DOUBLE), 4) + 0.0",
            "x": "CAST({} AS DOUBLE)",
            "i": "CAST({} AS BIGINT)",
            "t": "strftime(CAST({} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')",
            "d": "strftime(CAST({} AS DATE), '%Y-%m-%d')",
            "": "{}",
        }[kind].format(expr)
        parts.append(f'{form} AS "{name}"')
    return ", ".join(parts)


def _oracle(name: str, needs: str, columns: str, tail: str) -> None:
    ORACLES[name] = _sql(needs, f"SELECT {_out(columns)} {tail}")


# --- inputs --------------------------------------------------------------------

_cte(
    "inst",
    "",
    """SELECT s_suppkey AS instrument, s_name AS ticker, r_name AS sector
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
_cte(
    "bars",
    "inst",
    """SELECT i.ticker, i.sector, b.* FROM (
         SELECT l_suppkey AS instrument, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
                arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume
         FROM (SELECT *, l_extendedprice / l_quantity AS px, l_quantity AS q,
                      row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem)
         GROUP BY 1, 2) b JOIN inst i USING (instrument)""",
)
_cte(
    "ticks",
    "",
    """SELECT event_id, 'T' || CAST(user_id % 20 AS VARCHAR) AS ticker, ts, value AS price FROM events
       WHERE event_type IN ('click', 'view', 'purchase') AND value > 0""",
)
_cte(
    "ibars",
    "ticks",
    """SELECT ticker, date_trunc('hour', ts)::TIMESTAMP AS hour, arg_min(price, row(ts, event_id)) AS open,
              max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close,
              CAST(count(*) AS DOUBLE) AS volume
       FROM ticks GROUP BY 1, 2""",
)
_cte(
    "news",
    "",
    """SELECT event_id, 'T' || CAST(user_id % 20 AS VARCHAR) AS ticker, ts AS public_ts,
              ts + INTERVAL 45 SECOND AS usable_ts,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) / 49.5 - 1.0 AS sent,
              0.1 + 0.9 * CAST(event_id % 10 AS DOUBLE) / 9.0 AS cred
       FROM events WHERE event_type IN ('signup', 'error')""",
)
_cte(
    "lc",
    "inst",
    """SELECT i.ticker, i.instrument, f + INTERVAL 90 DAY AS ipo_date,
              CASE WHEN i.instrument % 3 = 0 THEN l - INTERVAL 90 DAY END AS delist_date, i.sector
       FROM (SELECT l_suppkey AS instrument, min(l_shipdate) AS f, max(l_shipdate) AS l FROM lineitem GROUP BY 1) s
       JOIN inst i USING (instrument) WHERE i.instrument % 10 <> 9""",
)

# --- sources, contracts, universe -------------------------------------------------

_oracle(
    "store_roundtrip",
    "ibars",
    "ticker;timestamp=hour@t;open@x;high@x;low@x;close@x;volume@x;year=year(hour)@i;month=month(hour)@i",
    "FROM ibars",
)
_oracle(
    "store_range_read",
    "ibars",
    "ticker;timestamp=hour@t;close@x;volume@x",
    """FROM ibars WHERE hour >= TIMESTAMP '2024-01-08 00:00:00' AND hour <= TIMESTAMP '2024-01-15 12:00:00'
       AND ticker IN ('T1', 'T2', 'T7')""",
)


_oracle("store_csv_roundtrip", "ibars", "ticker;timestamp=hour@t;open@x;high@x;low@x;close@x;volume@x", "FROM ibars")
_oracle(
    "store_union_slices",
    "ibars",
    "ticker;timestamp=hour@t;close@x;volume=CASE WHEN hour >= TIMESTAMP '2024-01-15' THEN volume END@x",
    "FROM ibars",
)


def _contract(name: str, needs: str, source: str, rules: list[tuple[str, str]]) -> None:
    body = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS violations FROM {source}"
        for rule, bad in rules
    )
    ORACLES[name] = _sql(needs, body)


_contract(
    "contract_market",
    "bars",
    "bars",
    [(f"{o} is null", f"{c} IS NULL") for o, c in (("timestamp", "ts"), *[(x, x) for x in ("ticker", "open", "high", "low", "close", "volume")])]
    + [(f"{c} must be positive", f"NOT ({c} > 0)") for c in ("open", "high", "low", "close")]
    + [
        ("volume must not be negative", "NOT (volume >= 0)"),
        ("high must be >= low", "high < low"),
        ("high must be >= close", "high < close"),
    ],
)
_contract(
    "contract_news",
    "news",
    "news",
    [
        (f"{o} is null", f"{c} IS NULL")
        for o, c in (
            ("ticker", "ticker"),
            ("article_public_ts", "public_ts"),
            ("usable_after_ts", "usable_ts"),
            ("headline_sentiment", "sent"),
            ("credibility", "cred"),
        )
    ]
    + [
        ("headline_sentiment must be in [-1, 1]", "sent < -1 OR sent > 1"),
        ("credibility must be in [0, 1]", "cred < 0 OR cred > 1"),
        ("usable_after_ts must be after article_public_ts", "usable_ts <= public_ts"),
    ],
)

_oracle(
    "session_filter",
    "ticks",
    "event_id@i;ticker;timestamp=ts@t",
    """FROM ticks WHERE isodow(ts) <= 5
       AND CAST(ts AS TIME) >= TIME '09:30:00' AND CAST(ts AS TIME) < TIME '16:00:00'""",
)
_oracle("bars_from_ticks", "ibars", "ticker;timestamp=hour@t;open@x;high@x;low@x;close@x;volume@x", "FROM ibars")
_oracle("bars_daily", "bars", "ticker;sector;timestamp=ts@t;open@x;high@x;low@x;close@x;volume@x", "FROM bars")
_oracle(
    "bar_activity_flag",
    "bars lc",
    "ticker=b.ticker;timestamp=b.ts@t;is_active=(l.delist_date IS NULL OR b.ts < l.delist_date)",
    "FROM bars b LEFT JOIN lc l ON l.ticker = b.ticker",
)
_oracle(
    "news_usable_after", "news", "event_id@i;ticker;article_public_ts=public_ts@t;usable_after_ts=usable_ts@t", "FROM news"
)
_ALIVE = "{t} >= l.ipo_date AND (l.delist_date IS NULL OR {t} <= l.delist_date)"
_oracle(
    "universe_as_of",
    "lc",
    "as_of=d@t;ticker=l.ticker",
    f"""FROM lc l JOIN (VALUES (TIMESTAMP '1996-01-01'), (TIMESTAMP '1998-07-01'), (TIMESTAMP '2001-09-01')) v(d)
        ON {_ALIVE.format(t='d')}""",
)
_oracle(
    "universe_filter",
    "bars lc",
    "ticker=b.ticker;timestamp=b.ts@t;close=b.close@x",
    f"FROM bars b LEFT JOIN lc l ON l.ticker = b.ticker WHERE l.ticker IS NULL OR ({_ALIVE.format(t='b.ts')})",
)
_oracle(
    "universe_filter_strict",
    "bars lc",
    "ticker=b.ticker;timestamp=b.ts@t;close=b.close@x",
    f"FROM bars b JOIN lc l ON l.ticker = b.ticker WHERE {_ALIVE.format(t='b.ts')}",
)
_oracle("universe_delisted", "lc", "ticker", "FROM lc WHERE delist_date IS NOT NULL")
_oracle(
    "universe_upsert",
    "lc",
    "ticker;ipo_date@t;delist_date=CASE WHEN instrument % 2 <> 0 THEN delist_date END@t;sector",
    "FROM lc",
)

# --- features -------------------------------------------------------------------


def _rolling(fn: str, col: str, over: str, least: int) -> str:
    return f"CASE WHEN count({col}) OVER {over} >= {least} THEN {fn}({col}) OVER {over} END"


def _feature_ctes(prefix: str, source: str, ts: str) -> None:
    """Return and technical features of a bar table; the clock column is renamed to ts."""
    w = "(PARTITION BY ticker ORDER BY ts)"

    def back(a: int, b: int = 1) -> str:
        return f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"

    changes = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    extra = ", instrument, sector" if source == "bars" else ""
    _cte(
        f"{prefix}1",
        source,
        f"""SELECT ticker, {ts} AS ts, open, high, low, close, volume{extra},
                   ln(close / lag(close) OVER w) AS log_return,
                   ln(lag(close, 1) OVER w / lag(close, 6) OVER w) AS momentum_5,
                   ln(lag(close, 1) OVER w / lag(close, 21) OVER w) AS momentum_20,
                   ln(lag(close, 1) OVER w / lag(close, 61) OVER w) AS momentum_60,
                   lag(close, 1) OVER w - lag(close, 2) OVER w AS delta,
                   {_rolling('avg', 'volume', back(20), 5)} AS adv,
                   (high - low) / greatest(close, 1e-8) AS hl_spread,
                   {_rolling('avg', 'close', back(60), 10)} AS zm,
                   {_rolling('stddev_samp', 'close', back(60), 10)} AS zs
            FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY {ts})""".replace(
            "ORDER BY ts", f"ORDER BY {ts}"
        ),
    )
    _cte(
        f"{prefix}2",
        f"{prefix}1",
        f"""SELECT *, {_rolling('stddev_samp', 'log_return', back(20), 5)} AS realized_vol,
                   {_rolling('avg', 'gain', changes, 14)} AS g, {_rolling('avg', 'loss', changes, 14)} AS l
            FROM (SELECT *, CASE WHEN delta > 0 THEN delta WHEN delta IS NOT NULL THEN 0.0 END AS gain,
                         CASE WHEN delta < 0 THEN -delta WHEN delta IS NOT NULL THEN 0.0 END AS loss
                  FROM {prefix}1)""",
    )
    _cte(
        prefix,
        f"{prefix}2",
        f"""SELECT *, log_return / CASE WHEN realized_vol IS NOT NULL THEN greatest(realized_vol, 1e-8) END
                        AS vol_norm_return,
                   100.0 - 100.0 / (1.0 + g / CASE WHEN l IS NOT NULL THEN greatest(l, 1e-8) END) AS rsi_14,
                   (close - zm) / CASE WHEN zs IS NOT NULL THEN greatest(zs, 1e-8) END AS z_price
            FROM {prefix}2""",
    )
    _cte(
        f"{prefix}_matrix",
        prefix,
        f"SELECT * FROM {prefix} WHERE realized_vol IS NOT NULL AND momentum_60 IS NOT NULL",
    )


_feature_ctes("feat", "bars", "ts")
_feature_ctes("ifeat", "ibars", "hour")

for _name, _cols in {
    "feat_log_return": "log_return@r",
    "feat_realized_vol": "realized_vol@r",
    "feat_vol_norm_return": "vol_norm_return@r",
    "feat_momentum": "momentum_5@r;momentum_20@r;momentum_60@r",
    "feat_adv": "adv@r",
    "feat_hl_spread": "hl_spread@r",
    "feat_rsi": "rsi_14@r",
    "feat_z_price": "z_price@r",
}.items():
    _oracle(_name, "feat", f"ticker;timestamp=ts@t;{_cols}", "FROM feat")

_MATRIX = (
    "ticker=f.ticker;timestamp=f.ts@t;close@x;log_return@r;realized_vol@r;vol_norm_return@r;momentum_5@r;momentum_20@r;"
    "momentum_60@r;adv@r;hl_spread@r;rsi_14@r;z_price@r;"
)
_oracle(
    "feature_matrix",
    "feat_matrix",
    _MATRIX + "weighted_sentiment=0.0@r;sentiment_count=0@i;max_credibility=0.0@r",
    "FROM feat_matrix f",
)
_contract(
    "contract_features",
    "feat_matrix",
    "feat_matrix",
    [
        ("timestamp is null", "ts IS NULL"),
        ("ticker is null", "ticker IS NULL"),
        ("close is null", "close IS NULL"),
        ("regime is null", "FALSE"),
        ("weighted_sentiment is null", "FALSE"),
        ("close must be positive", "NOT (close > 0)"),
        ("realized_vol must not be negative", "realized_vol < 0"),
        ("rsi_14 must be in [0, 100]", "rsi_14 < 0 OR rsi_14 > 100"),
        ("regime must not be negative", "FALSE"),
        ("weighted_sentiment must be in [-1, 1]", "FALSE"),
    ],
)

_cte(
    "bar_step",
    "ibars",
    """SELECT coalesce(quantile_cont(m, 0.5), 300.0) AS bar_seconds FROM (
         SELECT ticker, coalesce(quantile_cont(gap, 0.5), 300.0) AS m FROM (
           SELECT ticker, epoch_us(hour) / 1e6 - lag(epoch_us(hour) / 1e6) OVER (PARTITION BY ticker ORDER BY hour) AS gap
           FROM ibars) GROUP BY ticker)""",
)
_oracle("bar_interval", "bar_step", "bar_seconds@r", "FROM bar_step")


def _sentiment_cte(name: str, source: str, ts: str, step: str) -> None:
    """Sentiment per bar by a plain range join."""
    _cte(
        name,
        f"{source} news {step}",
        f"""SELECT ticker, {ts} AS ts,
                   coalesce(CASE WHEN sum(w) > 1e-10 THEN sum(w * sent) / sum(w) END, 0.0) AS weighted_sentiment,
                   count(w) AS sentiment_count, coalesce(max(cred), 0.0) AS max_credibility
            FROM (SELECT b.ticker, b.{ts}, n.sent, n.cred,
                         exp(-3.0 * (epoch_us(b.{ts}) - epoch_us(n.usable_ts)) / 1e6 / greatest(s.bar_seconds * 12, 1.0))
                           * n.cred AS w
                  FROM {source} b CROSS JOIN {step} s LEFT JOIN news n ON n.ticker = b.ticker
                   AND epoch_us(b.{ts}) BETWEEN epoch_us(n.usable_ts) AND epoch_us(n.usable_ts) + s.bar_seconds * 12e6)
            GROUP BY 1, 2""",
    )


_sentiment_cte("senti", "ibars", "hour", "bar_step")
_oracle(
    "sentiment_merge",
    "senti",
    "ticker;timestamp=ts@t;weighted_sentiment@r;sentiment_count@i;max_credibility@r",
    "FROM senti",
)
_oracle(
    "feature_matrix_news",
    "ifeat_matrix senti",
    _MATRIX + "weighted_sentiment@r;sentiment_count@i;max_credibility@r",
    "FROM ifeat_matrix f JOIN senti s ON s.ticker = f.ticker AND s.ts = f.ts",
)


def _grid_cte(name: str, value: str, stat: str) -> None:
    """A rolling statistic on the dense timestamps x tickers grid, averaged over tickers."""
    over = "(PARTITION BY k.ticker ORDER BY t.ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    _cte(
        name,
        "gfeat",
        f"""SELECT ts, avg(r) AS v FROM (
              SELECT t.ts, CASE WHEN count(f.{value}) OVER {over} >= 30 THEN {stat}(f.{value}) OVER {over} END AS r
              FROM (SELECT DISTINCT ts FROM gfeat WHERE {value} IS NOT NULL) t
              CROSS JOIN (SELECT DISTINCT ticker FROM gfeat) k
              LEFT JOIN gfeat f ON f.ts = t.ts AND f.ticker = k.ticker)
            GROUP BY ts""",
    )


_cte("gbars", "ticks", CTES["ibars"][1].replace("date_trunc('hour', ts)", "time_bucket(INTERVAL 4 HOUR, ts)"))
_feature_ctes("gfeat", "gbars", "hour")
_grid_cte("grid_vol", "realized_vol", "avg")
_grid_cte("grid_dev", "log_return", "stddev_samp")
_oracle(
    "regime_inputs",
    "grid_vol grid_dev",
    "timestamp=a.ts@t;mean_vol=a.v@r;mean_corr_proxy=b.v@r",
    "FROM grid_vol a JOIN grid_dev b ON a.ts = b.ts WHERE a.v IS NOT NULL AND b.v IS NOT NULL",
)

# --- labels ---------------------------------------------------------------------

_cte(
    "series",
    "bars",
    """SELECT *, CASE WHEN count(lr) OVER v >= 5 THEN stddev_samp(lr) OVER v END AS vol FROM (
         SELECT ticker, instrument, sector, ts, close, ln(close / lag(close) OVER w) AS lr,
                row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n
         FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))
       WINDOW v AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
_cte(
    "cand",
    "series",
    """SELECT *, greatest(vol, 1e-4) AS sigma FROM series
       WHERE n >= 30 AND pos >= 20 AND pos < greatest(n - 6, 20) AND (pos - 20) % 20 = 0""",
)
_cte(
    "ends",
    "cand",
    """SELECT c.ticker, c.pos, max(f.pos) AS last_pos,
              min(f.pos) FILTER (WHERE f.close >= c.close * (1.0 + 1.0 * c.sigma)
                                    OR f.close <= c.close * (1.0 - 0.45 * c.sigma)) AS hit_pos
       FROM cand c JOIN series f ON f.ticker = c.ticker AND f.pos BETWEEN c.pos + 1 AND c.pos + 5 GROUP BY 1, 2""",
)
_cte(
    "ev",
    "ends",
    """SELECT ticker, instrument, sector, t0, t1, ret AS return_at_touch, kind AS barrier_type, sigma AS sigma_t0,
              CASE kind WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE CAST(sign(ret) AS BIGINT) END AS label,
              abs(ret) * CASE kind WHEN 'vertical' THEN 0.5 ELSE 1.0 END AS raw_weight,
              date_diff('day', DATE '1970-01-01', CAST(t0 AS DATE)) AS day_no
       FROM (SELECT c.ticker, c.instrument, c.sector, c.ts AS t0, x.ts AS t1, (x.close - c.close) / c.close AS ret, c.sigma,
                    CASE WHEN e.hit_pos IS NULL THEN 'vertical'
                         WHEN x.close >= c.close * (1.0 + 1.0 * c.sigma) THEN 'upper' ELSE 'lower' END AS kind
             FROM cand c JOIN ends e ON e.ticker = c.ticker AND e.pos = c.pos
             JOIN series x ON x.ticker = c.ticker AND x.pos = coalesce(e.hit_pos, e.last_pos))""",
)
_oracle("label_events", "cand", "ticker;timestamp=ts@t;bar_no=pos@i", "FROM cand")
_oracle(
    "triple_barrier",
    "ev",
    "ticker;t0@t;t1@t;label@i;return_at_touch@r;barrier_type;sigma_t0@r;raw_weight@r",
    "FROM ev",
)
for _scope, _same in (("", ""), ("_per_ticker", " AND b.ticker = a.ticker")):
    _cte(
        f"uniq{_scope}",
        "ev",
        f"""SELECT a.ticker, a.t0, a.t1, 1.0 / count(*) AS u FROM ev a
            JOIN ev b ON b.t0 <= a.t1 AND b.t1 >= a.t0{_same} GROUP BY 1, 2, 3""",
    )
    _oracle(f"label_uniqueness{_scope}", f"uniq{_scope}", "ticker;t0@t;t1@t;uniqueness_weight=u@r", f"FROM uniq{_scope}")
_cte(
    "weighted",
    "uniq",
    """SELECT *, CASE WHEN sum(w) OVER () > 1e-12 THEN w / sum(w) OVER () ELSE w END AS sample_weight FROM (
         SELECT e.*, q.u, q.u * e.raw_weight AS w FROM ev e JOIN uniq q ON q.ticker = e.ticker AND q.t0 = e.t0)""",
)
_oracle("label_weights", "weighted", "ticker;t0@t;sample_weight_ppm=sample_weight * 1e6@r", "FROM weighted")
_oracle(
    "label_universe",
    "weighted",
    "ticker;t0@t;t1@t;label@i;return_at_touch@r;barrier_type;sigma_t0@r;raw_weight@r;uniqueness_weight=u@r;"
    "sample_weight_ppm=sample_weight * 1e6@r",
    "FROM weighted",
)
_oracle("label_distribution", "ev", "label@i;barrier_type;n=count(*)@i", "FROM ev GROUP BY label, barrier_type")
_contract(
    "contract_labels",
    "weighted",
    "weighted",
    [(f"{c} is null", f"{c} IS NULL") for c in ("t0", "t1", "ticker", "label", "return_at_touch", "sample_weight")]
    + [
        ("label must be -1, 0 or 1", "label NOT IN (-1, 0, 1)"),
        ("sample_weight must be positive", "NOT (sample_weight > 0)"),
        ("t1 must be after t0", "t1 <= t0"),
    ],
)

# --- features at events -----------------------------------------------------------

_oracle(
    "event_feature_lookup",
    "ev feat_matrix",
    "ticker=e.ticker;t0=e.t0@t;vol_norm_return=coalesce(f.vol_norm_return, 0.0)@r;regime=0@i",
    "FROM ev e LEFT JOIN feat_matrix f ON f.ticker = e.ticker AND f.ts = e.t0",
)
_cte(
    "listed", "bars lc", f"SELECT b.* FROM bars b JOIN lc l ON l.ticker = b.ticker WHERE {_ALIVE.format(t='b.ts')}"
)
_oracle(
    "encode_ids",
    "listed",
    "ticker=b.ticker;sector=b.sector;timestamp=b.ts@t;ticker_id=coalesce(t.id, 0)@i;sector_id=coalesce(s.id, 0)@i",
    """FROM bars b
       LEFT JOIN (SELECT ticker, dense_rank() OVER (ORDER BY ticker) - 1 AS id FROM (SELECT DISTINCT ticker FROM listed)) t
         ON t.ticker = b.ticker
       LEFT JOIN (SELECT sector, dense_rank() OVER (ORDER BY sector) - 1 AS id FROM (SELECT DISTINCT sector FROM listed)) s
         ON s.sector = b.sector""",
)
_cte(
    "seq_rows",
    "ev feat_matrix",
    """SELECT e.ticker, e.t0, f.log_return, f.realized_vol, f.momentum_5, f.rsi_14,
              row_number() OVER (PARTITION BY e.ticker, e.t0 ORDER BY f.ts DESC) AS back
       FROM ev e JOIN feat_matrix f ON f.ticker = e.ticker AND f.ts < e.t0""",
)
_cte(
    "seq_events",
    "seq_rows",
    "SELECT ticker, t0, least(max(back), 30) AS n_rows FROM seq_rows GROUP BY 1, 2 HAVING max(back) >= 15",
)
_oracle(
    "sequence_windows",
    "seq_events",
    "ticker=e.ticker;t0=e.t0@t;n_rows=e.n_rows@i;step=s.step@i;log_return=coalesce(CAST(r.log_return AS FLOAT), 0)@r;"
    "realized_vol=coalesce(CAST(r.realized_vol AS FLOAT), 0)@r;momentum_5=coalesce(CAST(r.momentum_5 AS FLOAT), 0)@r;"
    "rsi_14=coalesce(CAST(r.rsi_14 AS FLOAT), 0)@r",
    """FROM seq_events e CROSS JOIN range(30) s(step)
       LEFT JOIN seq_rows r ON r.ticker = e.ticker AND r.t0 = e.t0 AND r.back = 30 - s.step""",
)
_oracle(
    "batch_score",
    "seq_events",
    "ticker=e.ticker;t0=e.t0@t;p10=sum(CAST(CAST(r.log_return AS FLOAT) AS DOUBLE)) / 30 - sum(CAST(CAST(r.realized_vol AS FLOAT) AS DOUBLE)) / 30@r;"
    "p50=sum(CAST(CAST(r.log_return AS FLOAT) AS DOUBLE)) / 30@r;"
    "p90=sum(CAST(CAST(r.log_return AS FLOAT) AS DOUBLE)) / 30 + sum(CAST(CAST(r.realized_vol AS FLOAT) AS DOUBLE)) / 30@r",
    """FROM seq_events e JOIN seq_rows r ON r.ticker = e.ticker AND r.t0 = e.t0 AND r.back <= 30
       GROUP BY e.ticker, e.t0""",
)

# --- guards -----------------------------------------------------------------------

_oracle(
    "guard_feature_time",
    "ticks news",
    "event_id=n.event_id@i;timestamp=n.public_ts@t;t0=t.ts@t",
    "FROM news n JOIN ticks t ON t.event_id + 1 = n.event_id WHERE n.public_ts > t.ts",
)
_oracle(
    "guard_horizon",
    "",
    "l_orderkey@i;violations=count(*)@i",
    """FROM lineitem JOIN (SELECT l_orderkey, min(l_shipdate) AS t1 FROM lineitem GROUP BY 1) USING (l_orderkey)
       WHERE t1 <= l_shipdate GROUP BY l_orderkey""",
)
_oracle(
    "guard_news_latency",
    "ibars news",
    "ticker=b.ticker;violations=count(*)@i",
    "FROM ibars b JOIN news n ON n.ticker = b.ticker AND b.hour > n.public_ts AND b.hour < n.usable_ts GROUP BY b.ticker",
)
_cte("early", "news", "SELECT l_suppkey % 20 AS k, l_shipdate AS ts FROM lineitem")
_oracle(
    "guard_report",
    "news",
    "guard;violations@i",
    """FROM (
         SELECT 'late_features' AS guard, count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey
         WHERE l_shipdate > o_orderdate + INTERVAL 30 DAY
         UNION ALL SELECT 'bad_horizons', count(*) FROM orders WHERE o_orderkey % 60 <= 30
         UNION ALL SELECT 'early_news', count(*) FROM lineitem JOIN news n
           ON n.ticker = 'T' || CAST(l_suppkey % 20 AS VARCHAR) AND l_shipdate > n.public_ts AND l_shipdate < n.usable_ts)""",
)
_oracle(
    "guard_monotonic",
    "",
    "ticker=CAST(o_custkey AS VARCHAR);arrival=o_orderkey@i;timestamp=o_orderdate@t;previous_ts=prev@t",
    """FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)
       WHERE prev > o_orderdate""",
)

# --- validation -------------------------------------------------------------------

_cte(
    "placed",
    "ev",
    """SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
                      ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS own_fold
       FROM (SELECT *, row_number() OVER (ORDER BY t0, ticker) - 1 AS pos, count(*) OVER () AS n FROM ev)""",
)
_oracle("cv_folds", "placed", "ticker;t0@t;pos@i;own_fold@i", "FROM placed")
_cte(
    "fold_bounds",
    "placed",
    """SELECT f.own_fold AS fold, f.a, f.b, f.lo, f.hi, f.t0_hi, p.t1 AS threshold FROM (
         SELECT own_fold, min(pos) AS a, max(pos) AS b, min(t0) AS lo, max(t0) AS t0_hi, max(t1) AS hi
         FROM placed GROUP BY 1) f LEFT JOIN placed p ON p.pos = f.a - 1""",
)
for _mode, _purge in (
    ("compat", "p.pos < f.a AND p.t1 >= f.threshold"),
    ("strict", "p.t0 <= f.hi AND p.t1 >= f.lo"),
):
    _cte(
        f"roles_{_mode}",
        "fold_bounds",
        f"""SELECT f.fold, p.*, CASE WHEN p.own_fold = f.fold THEN 'test'
                     WHEN p.pos > f.b AND p.pos <= f.b + ceil(0.01 * p.n) THEN 'embargo'
                     WHEN {_purge} THEN 'purged' ELSE 'train' END AS role
            FROM placed p CROSS JOIN fold_bounds f""",
    )
    _oracle(f"cv_purged_{_mode}", f"roles_{_mode}", "fold@i;pos@i;ticker;t0@t;role", f"FROM roles_{_mode}")
_oracle(
    "cv_fold_sizes",
    "roles_compat",
    "fold@i;train_size=count(*) FILTER (role = 'train')@i;test_size=count(*) FILTER (role = 'test')@i;"
    "purged_count=count(*) FILTER (role NOT IN ('train', 'test'))@i",
    "FROM roles_compat GROUP BY fold",
)
_oracle(
    "guard_fold_overlap",
    "roles_compat",
    "fold=f.fold@i;violations=count(*) FILTER (r.role = 'train' AND r.t0 <= f.t0_hi AND r.t1 >= f.lo)@i",
    "FROM fold_bounds f JOIN roles_compat r ON r.fold = f.fold GROUP BY f.fold",
)
_cte(
    "mean_pred",
    "roles_strict",
    """SELECT t.fold, t.pos, t.ticker, t.t0, t.return_at_touch, m.prediction FROM roles_strict t
       JOIN (SELECT fold, avg(return_at_touch) AS prediction FROM roles_strict WHERE role = 'train' GROUP BY 1) m
         ON m.fold = t.fold WHERE t.role = 'test'""",
)
_oracle(
    "cv_evaluate_mean_model", "mean_pred", "fold@i;pos@i;ticker;t0@t;return_at_touch@r;prediction@r", "FROM mean_pred"
)
_oracle(
    "cv_metric_summary",
    "mean_pred",
    "mse_mean=avg(mse)@r;mae_mean=avg(mae)@r;mse_std=stddev_pop(mse)@r;mae_std=stddev_pop(mae)@r",
    """FROM (SELECT fold, avg((return_at_touch - prediction) ** 2) AS mse, avg(abs(return_at_touch - prediction)) AS mae
             FROM mean_pred GROUP BY fold)""",
)
_oracle(
    "cv_oof",
    "placed mean_pred",
    "ticker=p.ticker;t0=p.t0@t;pos=p.pos@i;oof_prediction=coalesce(m.prediction, 0.0)@r;oof_mask=(m.pos IS NOT NULL)",
    "FROM placed p LEFT JOIN mean_pred m ON m.pos = p.pos AND m.fold > 0",
)
_cte(
    "parts",
    "roles_strict",
    """SELECT *, CASE WHEN role = 'test' THEN 'test' WHEN own_fold = 3 THEN 'calibration' ELSE 'train' END AS part
       FROM roles_strict WHERE fold = 4 AND (role IN ('test', 'train') OR own_fold = 3)""",
)
_oracle("cv_cal_test_split", "parts", "ticker;t0@t;pos@i;part", "FROM parts")

# --- models -----------------------------------------------------------------------

_BASE = "momentum_5 momentum_20 momentum_60 rsi_14 hl_spread z_price realized_vol adv".split()
_oracle(
    "label_feature_join",
    "ev feat_matrix",
    "ticker=e.ticker;t0=e.t0@t;label@i;"
    + ";".join(f"{c}=f.{c}@r" for c in _BASE if c != "adv")
    + ";weighted_sentiment=0.0@r;sentiment_count=0@i;max_credibility=0.0@r;regime=0@i;adv=f.adv@r",
    "FROM ev e JOIN feat_matrix f ON f.ticker = e.ticker AND f.ts = e.t0 WHERE "
    + " AND ".join(f"f.{c} IS NOT NULL" for c in _BASE),
)


def _prob(j: int, i: int) -> str:
    """Entry i of member j's fixed probability row: a rotation of (1, 2, 5) / 8."""
    return f"list_extract([0.125::DOUBLE, 0.25::DOUBLE, 0.625::DOUBLE], CAST((((instrument * {j + 1} + day_no) % 3) + {i}) % 3 + 1 AS INT))"


_cte(
    "members",
    "ev",
    "SELECT *, "
    + ", ".join(f"({' + '.join(_prob(j, i) for j in range(3))}) / 3 AS q{i}" for i in range(3))
    + f", ({' + '.join(_prob(j, 2) for j in range(3))}) / 3 AS act FROM ev",
)
_ARGMAX = "CASE WHEN {0}0 >= {0}1 AND {0}0 >= {0}2 THEN -1 WHEN {0}1 >= {0}2 THEN 0 ELSE 1 END"
_oracle(
    "ensemble_predict",
    "members",
    f"ticker;t0@t;p_down=q0@r;p_flat=q1@r;p_up=q2@r;prediction={_ARGMAX.format('q')}@i",
    "FROM members",
)
_oracle(
    "meta_ensemble_decision",
    "members",
    "ticker;t0@t;meta_proba=act@r;meta_decision=CASE WHEN act >= 0.5 THEN 1 ELSE 0 END@i",
    "FROM members",
)
_cte(
    "class_pred",
    "placed",
    f"""SELECT *, {_ARGMAX.format('p')} AS prediction,
               CASE label WHEN -1 THEN p0 WHEN 0 THEN p1 ELSE p2 END / (p0 + p1 + p2) AS p_true
        FROM (SELECT *, {_prob(0, 0)} AS p0, {_prob(0, 1)} AS p1, {_prob(0, 2)} AS p2 FROM placed)""",
)
_cte(
    "class_metrics",
    "class_pred",
    """SELECT own_fold AS fold, count(*) AS n_test, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS accuracy,
              avg(-ln(p_true)) AS log_loss, any_value(r.bal) AS bal_accuracy
       FROM class_pred JOIN (
         SELECT own_fold, avg(recall) AS bal FROM (
           SELECT own_fold, label, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS recall
           FROM class_pred GROUP BY 1, 2) GROUP BY 1) r USING (own_fold)
       GROUP BY 1""",
)
_oracle("multiclass_metrics", "class_metrics", "fold@i;n_test@i;accuracy@r;bal_accuracy@r;log_loss@r", "FROM class_metrics")
_oracle(
    "fold_summary",
    "class_metrics",
    "fold;accuracy@r;bal_accuracy@r;log_loss@r",
    """FROM (SELECT CAST(fold AS VARCHAR) AS fold, accuracy, bal_accuracy, log_loss FROM class_metrics
             UNION ALL SELECT 'mean', avg(accuracy), avg(bal_accuracy), avg(log_loss) FROM class_metrics)""",
)
_P50 = "(0.01 * ((instrument * 7 + day_no) % 21 - 10))"
_cte("pred", "ev", f"SELECT *, {_P50} AS p50, {_P50} - 0.3 AS p10, {_P50} + 0.3 AS p90 FROM ev")
_cte("sig_train", "roles_strict", f"SELECT *, {_P50} AS signal FROM roles_strict WHERE fold = 4 AND role = 'train'")
_cte("sig_test", "roles_strict", f"SELECT *, {_P50} AS signal FROM roles_strict WHERE fold = 4 AND role = 'test'")
_cte(
    "cuts",
    "sig_train",
    "SELECT unnest(quantile_cont(signal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS c FROM sig_train",
)
for _part in ("train", "test"):
    _cte(
        f"dec_{_part}",
        f"sig_{_part} cuts",
        f"""SELECT s.*, (SELECT count(*) FROM cuts WHERE c < s.signal) AS decile FROM sig_{_part} s""",
    )
_Q3 = ", ".join(f"quantile_cont(return_at_touch, {q}) AS {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
_oracle(
    "quantile_forecast",
    "dec_train dec_test",
    "ticker=t.ticker;t0=t.t0@t;decile=t.decile@i;"
    + ";".join(f"{q}=CASE WHEN a.n IS NOT NULL THEN a.{q} WHEN b.n IS NOT NULL THEN b.{q} ELSE c.{q} END@r" for q in ("p10", "p50", "p90")),
    f"""FROM dec_test t
        LEFT JOIN (SELECT sector, decile, count(*) AS n, {_Q3} FROM dec_train GROUP BY 1, 2 HAVING count(*) >= 20) a
          ON a.sector = t.sector AND a.decile = t.decile
        LEFT JOIN (SELECT sector, count(*) AS n, {_Q3} FROM dec_train GROUP BY 1 HAVING count(*) >= 20) b
          ON b.sector = t.sector
        CROSS JOIN (SELECT {_Q3} FROM dec_train) c""",
)


def _pin(c: str, q: float) -> str:
    err = f"(return_at_touch - {c})"
    return f"avg(CASE WHEN {err} >= 0 THEN {q} * {err} ELSE ({q} - 1.0) * {err} END * raw_weight)"


_PINS = {c: _pin(c, q) for c, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))}
_oracle(
    "pinball_loss",
    "pred",
    ";".join(f"loss_{c}={p}@r" for c, p in _PINS.items()) + f";pinball_loss=({' + '.join(_PINS.values())}) / 3@r",
    "FROM pred",
)
_oracle(
    "quantile_crossing",
    "pred",
    "n=count(*)@i;crossings=count(*) FILTER (CASE WHEN instrument % 3 = 0 THEN p50 + 0.1 ELSE p10 END > p50 OR p50 > p90)@i",
    "FROM pred",
)

# --- conformal --------------------------------------------------------------------

_cte(
    "cal",
    "parts",
    f"""SELECT *, greatest(p50 - 0.3 - return_at_touch, return_at_touch - (p50 + 0.3)) AS score
        FROM (SELECT *, {_P50} AS p50 FROM parts WHERE part = 'calibration')""",
)


def _q_hat_cte(name: str, keys: str) -> None:
    """The interpolated quantile from sorted ranks, as the level depends on the count."""
    by = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    _cte(
        name,
        "cal",
        f"""SELECT {head}any_value(cnt) AS n,
                   greatest(0.0, max(score) FILTER (r = floor(h)) + (max(score) FILTER (r = ceil(h))
                     - max(score) FILTER (r = floor(h))) * any_value(h - floor(h))) AS q_hat
            FROM (SELECT *, (cnt - 1) * least(ceil((1.0 - 0.1) * (cnt + 1)) / cnt, 1.0) AS h FROM (
                    SELECT *, row_number() OVER ({by} ORDER BY score) - 1 AS r,
                           CAST(count(*) OVER ({by}) AS DOUBLE) AS cnt FROM cal)) {group}""",
    )


_q_hat_cte("q_hat", "")
_q_hat_cte("q_hat_sector", "sector")
_oracle("conformal_fit", "q_hat", "n@i;q_hat@r", "FROM q_hat")
_oracle("conformal_fit_by_sector", "q_hat_sector", "sector;n@i;q_hat@r", "FROM q_hat_sector")
_cte(
    "banded",
    "parts q_hat",
    f"""SELECT *, p10 - q_hat AS p10_adj, p90 + q_hat AS p90_adj FROM (
          SELECT *, {_P50} - 0.3 AS p10, {_P50} + 0.3 AS p90 FROM parts WHERE part = 'test') CROSS JOIN (SELECT q_hat FROM q_hat)""",
)
_oracle(
    "conformal_apply",
    "banded",
    "ticker;t0@t;p10@r;p90@r;p10_adj@r;p90_adj@r;band_width=p90_adj - p10_adj@r",
    "FROM banded",
)
_oracle(
    "conformal_coverage",
    "banded",
    "n=count(*)@i;raw_coverage=avg(CASE WHEN return_at_touch BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END)@r;"
    "adj_coverage=avg(CASE WHEN return_at_touch BETWEEN p10_adj AND p90_adj THEN 1.0 ELSE 0.0 END)@r",
    "FROM banded",
)

# --- meta-labels ------------------------------------------------------------------

_cte(
    "meta0",
    "pred",
    """SELECT *, p90 - p10 AS band_width,
              CASE WHEN sign(p50) = sign(return_at_touch) AND abs(return_at_touch) > 5.0 / 10000.0 + 2.0 / 10000.0
                   THEN 1 ELSE 0 END AS meta_label FROM pred""",
)
_BACK20 = "(PARTITION BY ticker ORDER BY t0 ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_cte(
    "meta",
    "meta0",
    f"""SELECT *, coalesce({_rolling('avg', 'meta_label', _BACK20, 5)}, 0.5) AS recent_hit_rate,
               row_number() OVER (PARTITION BY ticker ORDER BY t0) AS k FROM meta0""",
)
_oracle("meta_labels", "meta0", "ticker;t0@t;band_width@r;meta_label@i", "FROM meta0")
_oracle("meta_hit_rate", "meta", "ticker;t0@t;recent_hit_rate@r", "FROM meta")
_oracle(
    "meta_hit_rate_resolved",
    "meta",
    "ticker=a.ticker;t0=a.t0@t;recent_hit_rate=CASE WHEN count(b.k) >= 5 THEN avg(b.meta_label) ELSE 0.5 END@r",
    """FROM meta a LEFT JOIN meta b ON b.ticker = a.ticker AND b.k BETWEEN a.k - 20 AND a.k - 1 AND b.t1 <= a.t0
       GROUP BY a.ticker, a.t0""",
)
_oracle(
    "meta_lag_context",
    "ev feat",
    "ticker;t0@t;vol_norm_return=v@r;vol_norm_return_lag1=coalesce(lag(v) OVER (PARTITION BY ticker ORDER BY t0), 0.0)@r",
    """FROM (SELECT e.ticker, e.t0, coalesce(f.vol_norm_return, 0.0) AS v
             FROM ev e LEFT JOIN feat f ON f.ticker = e.ticker AND f.ts = e.t0)""",
)
_cte(
    "scored",
    "placed",
    f"""SELECT own_fold AS fold, ((instrument * 13 + day_no) % 100) / 100.0 AS proba,
               CASE WHEN sign(p50) = sign(return_at_touch) AND abs(return_at_touch) > 5.0 / 10000.0 + 2.0 / 10000.0
                    THEN 1 ELSE 0 END AS y FROM (SELECT *, {_P50} AS p50 FROM placed)""",
)
_oracle(
    "binary_metrics",
    "scored",
    "fold=m.fold@i;n_test@i;accuracy@r;precision=CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END@r;"
    "recall=CASE WHEN pos > 0 THEN tp / pos ELSE 0.0 END@r;"
    "f1=CASE WHEN tp + fp + pos > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0.0 END@r;act_rate@r;auc_roc=a.auc@r",
    """FROM (SELECT fold, count(*) AS n_test, avg(CASE WHEN (proba >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
                    CAST(count(*) FILTER (proba >= 0.5 AND y = 1) AS DOUBLE) AS tp,
                    CAST(count(*) FILTER (proba >= 0.5 AND y = 0) AS DOUBLE) AS fp,
                    CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos,
                    avg(CASE WHEN proba >= 0.5 THEN 1.0 ELSE 0.0 END) AS act_rate FROM scored GROUP BY fold) m
       LEFT JOIN (SELECT p.fold, avg(CASE WHEN p.proba > q.proba THEN 1.0 WHEN p.proba = q.proba THEN 0.5 ELSE 0.0 END) AS auc
                  FROM scored p JOIN scored q ON q.fold = p.fold AND p.y = 1 AND q.y = 0 GROUP BY p.fold) a ON a.fold = m.fold""",
)

# --- sizing, execution, backtest ----------------------------------------------------

_cte(
    "signals",
    "meta0 feat",
    """SELECT m.*, m.meta_label AS meta_decision, f.close, f.adv, f.realized_vol
       FROM meta0 m LEFT JOIN feat f ON f.ticker = m.ticker AND f.ts = m.t0""",
)
_oracle("signal_join", "signals", "ticker;t0@t;p50@r;close@x;adv@r;realized_vol@r", "FROM signals")


def _sized_cte(name: str, frac: str, source: str) -> None:
    """Sizes with impact coefficient 0.01 and a portfolio of 10,000."""
    cost = "(3.0 / 10000.0 + 5.0 / 10000.0)"
    _cte(
        name,
        source,
        f"""SELECT *, CASE WHEN meta_decision = 0 OR confidence < 0.1
                            OR coalesce(net_expected_ret < impact_cost_est + {cost}, FALSE)
                            OR greatest(band_width, 0.0) > 10.0 THEN 0.0
                           WHEN adv_size_limit IS NULL THEN raw_size_frac
                           ELSE least(raw_size_frac, adv_size_limit) END AS final_size_frac
            FROM (SELECT *, 0.01 * realized_vol * sqrt(greatest(raw_size_frac / greatest(adv_size_limit, 1e-8), 0.0))
                              AS impact_cost_est
                  FROM (SELECT *, {cost} AS total_cost_est, abs(p50) - {cost} AS net_expected_ret,
                               adv * close * 0.01 / 10000.0 AS adv_size_limit, confidence * {frac} AS raw_size_frac,
                               CAST(sign(p50) AS BIGINT) AS direction
                        FROM (SELECT *, 1.0 / (1.0 + greatest(band_width, 0.0)) AS confidence FROM {source})))""",
    )


_sized_cte("sized", "0.05", "signals")
_oracle(
    "position_sizes",
    "sized",
    "ticker;t0@t;confidence@r;total_cost_est@r;net_expected_ret@r;adv_size_limit@r;impact_cost_est@r;raw_size_frac@r;"
    "final_size_frac@r;direction@i;final_size_dollars=final_size_frac * 10000.0@r",
    "FROM sized",
)
_oracle(
    "sizing_summary",
    "sized",
    "total_signals=count(*)@i;acted=count(*) FILTER (final_size_frac > 0)@i;skipped=count(*) FILTER (final_size_frac = 0)@i;"
    "act_rate=count(*) FILTER (final_size_frac > 0) / count(*)@r;"
    "mean_size_frac=coalesce(avg(final_size_frac) FILTER (final_size_frac > 0), 0.0)@r;mean_confidence=avg(confidence)@r",
    "FROM sized",
)
_oracle(
    "asof_entry",
    "news ibars",
    "event_id=n.event_id@i;ticker=n.ticker;t0=n.public_ts@t;t1=n.usable_ts@t;entry_price=b.close@x",
    "FROM news n ASOF LEFT JOIN ibars b ON b.ticker = n.ticker AND n.public_ts <= b.hour",
)
_oracle(
    "asof_exit",
    "news ibars",
    "event_id=n.event_id@i;ticker=n.ticker;t0=n.public_ts@t;t1=n.usable_ts@t;exit_price=b.close@x",
    "FROM news n ASOF LEFT JOIN ibars b ON b.ticker = n.ticker AND n.usable_ts >= b.hour",
)


def _trades_cte(name: str, source: str) -> None:
    """Entry and exit by as-of join, then the result of each trade."""
    cost = "(3.0 + 5.0) / 10000.0"
    _cte(
        name,
        f"{source} bars",
        f"""SELECT *, gross_pnl + cost_pnl AS net_pnl FROM (
              SELECT *, (exit_price - entry_price) * direction * shares AS gross_pnl, -{cost} * abs(notional) AS cost_pnl,
                     -{cost} * notional AS entry_cost, CAST(t0 AS DATE) AS open_day,
                     greatest(CAST(t0 AS DATE) + 1,
                              CAST(t1 AS DATE) - CASE WHEN t1 = date_trunc('day', t1) THEN 1 ELSE 0 END) AS close_day
              FROM (SELECT s.* EXCLUDE (close), final_size_frac * 10000.0 AS notional,
                           final_size_frac * 10000.0 / a.close AS shares, a.close AS entry_price,
                           coalesce(b.close, a.close * (1.0 + s.return_at_touch)) AS exit_price
                    FROM (SELECT * FROM {source} WHERE final_size_frac > 0) s
                    ASOF LEFT JOIN bars a ON a.ticker = s.ticker AND s.t0 <= a.ts
                    ASOF LEFT JOIN bars b ON b.ticker = s.ticker AND s.t1 >= b.ts))""",
    )


_trades_cte("single_trades", "sized")
_oracle(
    "trade_pnl",
    "single_trades",
    "ticker;t0@t;t1@t;entry_price@x;exit_price@x;direction@i;notional@r;shares@r;gross_pnl@r;cost_pnl@r;net_pnl@r;entry_cost@r",
    "FROM single_trades",
)
_cte(
    "grid_signals",
    "signals",
    "SELECT s.*, g.strategy_id, g.frac FROM signals s CROSS JOIN (VALUES (0, 0.02::DOUBLE), (1, 0.05::DOUBLE), (2, 0.10::DOUBLE)) g(strategy_id, frac)",
)
_sized_cte("book", "frac", "grid_signals")
_trades_cte("opened", "book")
_cte(
    "span",
    "opened",
    "SELECT strategy_id, CAST(min(t0) AS DATE) AS a, CAST(max(t1) AS DATE) AS b FROM opened GROUP BY 1",
)
_cte("log", "span", "SELECT o.* FROM opened o JOIN span s ON s.strategy_id = o.strategy_id AND o.close_day <= s.b")
_oracle(
    "backtest_trades",
    "log",
    "strategy_id@i;ticker;t0@t;t1@t;open_day@d;close_day@d;notional@r;net_pnl@r",
    "FROM log",
)
# The account of each strategy with at most five open positions, signal by signal:
# positions whose closing day has come are let go, then there is room or there is not.
_cte(
    "queue",
    "opened",
    "SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY t0, ticker) AS k FROM opened",
)
_HELD = "list_filter(w.held, lambda x: x > q.open_day)"
_cte(
    "walk",
    "queue span",
    f"""SELECT strategy_id, CAST(0 AS BIGINT) AS k, CAST([] AS DATE[]) AS held, FALSE AS taken FROM span
        UNION ALL
        SELECT q.strategy_id, q.k, CASE WHEN len({_HELD}) < 5 THEN list_append({_HELD}, q.close_day) ELSE {_HELD} END,
               len({_HELD}) < 5
        FROM walk w JOIN queue q ON q.strategy_id = w.strategy_id AND q.k = w.k + 1""",
)
_oracle(
    "backtest_trades_capped",
    "walk",
    "strategy_id=q.strategy_id@i;ticker=q.ticker;t0=q.t0@t;t1=q.t1@t;open_day=q.open_day@d;close_day=q.close_day@d;"
    "notional=q.notional@r;net_pnl=q.net_pnl@r",
    """FROM queue q JOIN walk w ON w.strategy_id = q.strategy_id AND w.k = q.k AND w.taken
       JOIN span s ON s.strategy_id = q.strategy_id AND q.close_day <= s.b""",
)
_cte(
    "flows",
    "log",
    """SELECT strategy_id, day, sum(sum(cash)) OVER (PARTITION BY strategy_id ORDER BY day) AS cash FROM (
         SELECT strategy_id, open_day AS day, entry_cost AS cash FROM opened
         UNION ALL SELECT strategy_id, close_day, net_pnl FROM log) GROUP BY 1, 2""",
)
# a day without cash flows keeps the equity of the last day with one, to the last bit
_cte(
    "equity",
    "flows span",
    """SELECT d.strategy_id, d.day, 10000.0 + coalesce(f.cash, 0.0) AS equity
       FROM (SELECT strategy_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span) d
       ASOF LEFT JOIN flows f ON f.strategy_id = d.strategy_id AND d.day >= f.day""",
)
_oracle("equity_curve", "equity", "strategy_id@i;day@d;equity@2", "FROM equity")
_cte(
    "drets",
    "equity",
    """SELECT strategy_id, day, ret FROM (
         SELECT *, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY day) - 1.0 AS ret FROM equity)
       WHERE ret IS NOT NULL""",
)
_oracle(
    "backtest_no_trades",
    "",
    "strategy_id@i;day@d;equity=10000.0@2",
    """FROM (VALUES (0), (1), (2)) s(strategy_id),
       (SELECT unnest(generate_series(CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE), INTERVAL 1 DAY)) AS day FROM lineitem)""",
)
_oracle("daily_returns", "drets", "strategy_id@i;day@d;ret@r", "FROM drets")
_oracle(
    "performance_summary",
    "drets",
    "strategy_id=c.strategy_id@i;sharpe_ratio=CASE WHEN sd >= 1e-10 THEN m / sd * sqrt(252.0) ELSE 0.0 END@4;"
    "sortino_ratio=CASE WHEN dn > 1e-10 THEN m / dn * sqrt(252.0) ELSE 0.0 END@4;"
    "calmar_ratio=CASE WHEN abs(mdd) > 1e-10 THEN m * 252 / abs(mdd) ELSE 0.0 END@4;max_drawdown=mdd@r;win_rate=wr@r;"
    "n_trades=nt@i;total_return=tr@r",
    """FROM (SELECT strategy_id, min((equity - peak) / greatest(peak, 1e-8)) AS mdd,
                    arg_max(equity, day) / arg_min(equity, day) - 1.0 AS tr
             FROM (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY day) AS peak FROM equity) GROUP BY 1) c
       JOIN (SELECT strategy_id, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dn
             FROM drets GROUP BY 1) r ON r.strategy_id = c.strategy_id
       JOIN (SELECT strategy_id, count(*) AS nt, avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END) AS wr
             FROM log GROUP BY 1) t ON t.strategy_id = c.strategy_id""",
)
_cte(
    "reg_trades",
    "log",
    """SELECT (isodow(t0) - 1) % 3 AS regime, net_pnl, net_pnl / greatest(notional, 1.0) AS ret FROM log""",
)
_oracle(
    "regime_split",
    "reg_trades",
    "regime@i;n_trades=count(*)@i;win_rate=avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END)@r;mean_ret=avg(ret)@r;"
    "sharpe=CASE WHEN stddev_samp(ret) > 1e-10 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0) ELSE 0.0 END@r",
    "FROM reg_trades GROUP BY regime",
)
_oracle(
    "regime_breakdown",
    "reg_trades",
    "regime@i;n_trades=count(*)@i;win_rate=avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END)@r;mean_ret=avg(ret)@r;"
    "std_ret=stddev_samp(ret)@r;sharpe=avg(ret) / greatest(stddev_samp(ret), 1e-10) * sqrt(252.0)@r;"
    "ann_return=avg(ret) * 252@r",
    "FROM reg_trades GROUP BY regime",
)

# --- evaluation -------------------------------------------------------------------

_cte(
    "matrix",
    "feat",
    "SELECT ts AS t, sector AS strategy_id, avg(log_return) AS ret FROM feat WHERE log_return IS NOT NULL GROUP BY 1, 2",
)
# Normal quantiles at 1 - 1/50 and 1 - 1/(50 e), mixed by the Euler-Mascheroni constant.
_TOP = "((1.0 - 0.5772156649) * 2.053748910631822 + 0.5772156649 * 2.4393139538578943)"


def _phi(name: str, source: str, z: str) -> None:
    """Normal distribution function of z by its power series, one row per strategy."""
    _cte(
        name,
        source,
        f"""SELECT strategy_id, 0.5 + any_value(sign(z)) * exp(-any_value(z * z) / 2) / sqrt(2 * pi())
                     * sum(exp((2 * n + 1) * ln(abs(z)) - lgamma(2 * n + 2.0) + n * ln(2.0) + lgamma(n + 1.0))) AS p
            FROM (SELECT strategy_id, {z} AS z FROM {source}) CROSS JOIN range(0, 150) r(n) GROUP BY 1""",
    )


def _evaluation_ctes(p: str, source: str, subsets: int) -> None:
    """Moments, deflated Sharpe ratio and overfitting of (t, strategy_id, ret); names begin with ``p``."""
    _cte(
        f"{p}moments",
        source,
        f"""SELECT strategy_id, count(*) AS n, any_value(m) AS m, stddev_samp(ret) AS sd,
                  avg((ret - m) ** 3) / avg((ret - m) ** 2) ** 1.5 AS skew,
                  avg((ret - m) ** 4) / avg((ret - m) ** 2) ** 2 - 3.0 AS kurt
           FROM (SELECT *, avg(ret) OVER (PARTITION BY strategy_id) AS m FROM {source}) GROUP BY 1""",
    )
    _cte(
        f"{p}dsr",
        f"{p}moments",
        f"""SELECT *, m / sd AS sr,
                  greatest(sqrt((1.0 - skew * (m / sd) + (kurt + 1.0) * (m / sd) ** 2 / 4.0) / (n - 1)), 1e-10) AS sr_sd
           FROM {p}moments""",
    )
    _phi(f"{p}psr", f"{p}dsr", "sr / sr_sd")
    _phi(f"{p}ddsr", f"{p}dsr", f"(sr - {_TOP} * sr_sd) / sr_sd")
    _cte(
        f"{p}blocks",
        source,
        f"""SELECT strategy_id, block, CAST(count(*) AS DOUBLE) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM (
             SELECT m.*, (dense_rank() OVER (ORDER BY t) - 1) // ((SELECT count(DISTINCT t) FROM {source}) // {subsets}) AS block
             FROM {source} m) WHERE block < {subsets} GROUP BY 1, 2""",
    )
    _cte(
        f"{p}split_sr",
        f"{p}blocks",
        f"""SELECT mask, strategy_id, coalesce(max(CASE WHEN inside THEN sr END), 0.0) AS sr_in,
                  coalesce(max(CASE WHEN NOT inside THEN sr END), 0.0) AS sr_out
           FROM (SELECT mask, strategy_id, inside,
                        CASE WHEN n >= 2 AND sqrt(greatest((q - s * s / n) / (n - 1), 0.0)) >= 1e-12
                             THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252.0) ELSE 0.0 END AS sr
                 FROM (SELECT x.mask, b.strategy_id, (x.mask >> CAST(b.block AS INT)) & 1 = 1 AS inside,
                              sum(n) AS n, sum(s) AS s, sum(q) AS q
                       FROM {p}blocks b
                       CROSS JOIN (SELECT CAST(range AS BIGINT) AS mask FROM range({2**subsets})
                                   WHERE bit_count(range) = {subsets // 2}) x
                       GROUP BY 1, 2, 3))
           GROUP BY 1, 2""",
    )
    _cte(
        f"{p}deltas",
        f"{p}split_sr",
        f"SELECT mask, arg_min(sr_out, row(-sr_in, strategy_id)) - quantile_cont(sr_out, 0.5) AS d FROM {p}split_sr GROUP BY 1",
    )


_DSR = (
    "sr=d.sr * sqrt(252.0)@r;sr_per_period=d.sr@r;psr=p.p@r;dsr=q.p@r;"
    f"e_max_sr={_TOP} * d.sr_sd * sqrt(252.0)@r;skewness=d.skew@r;excess_kurtosis=d.kurt@r"
)
_PBO = (
    "pbo@r;median_oos_delta_sr=med@r;n_combinations=n@i;"
    "logit_pbo=ln(least(greatest(pbo, 1e-6), 1 - 1e-6) / (1.0 - least(greatest(pbo, 1e-6), 1 - 1e-6)))@r;is_overfit=(pbo > 0.5)"
)


def _pbo_of(deltas: str) -> str:
    return f"FROM (SELECT avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END) AS pbo, quantile_cont(d, 0.5) AS med, count(*) AS n FROM {deltas})"


_evaluation_ctes("", "matrix", 16)
_oracle(
    "sharpe_moments", "moments", "strategy_id;n_obs=n@i;mean=m@r;std=sd@r;skewness=skew@r;excess_kurtosis=kurt@r", "FROM moments"
)
_oracle(
    "deflated_sharpe",
    "psr ddsr",
    f"strategy_id=d.strategy_id;n_obs=d.n@i;{_DSR};n_trials=50@i;is_significant=(q.p > 0.95)",
    "FROM dsr d JOIN psr p ON p.strategy_id = d.strategy_id JOIN ddsr q ON q.strategy_id = d.strategy_id",
)
_oracle("pbo", "deltas", _PBO, _pbo_of("deltas"))


def _cells(section: str, source: str, metrics: str, who: str = "CAST(strategy_id AS VARCHAR)", suffix: str = "''") -> str:
    return " UNION ALL ".join(
        f"SELECT {who} AS strategy_id, '{section}' AS section, '{m}' || {suffix} AS metric, round(CAST({m} AS DOUBLE), 4) + 0.0 AS value"
        f" FROM {source}"
        for m in metrics.split()
    )


_cte("b_matrix", "drets", "SELECT day AS t, strategy_id, ret FROM drets")
_evaluation_ctes("b_", "b_matrix", 4)
_cte("b_basic", "", ORACLES["performance_summary"])
_cte(
    "b_sharpe",
    "b_psr b_ddsr",
    f"SELECT d.strategy_id, {_out(_DSR)}, q.p > 0.95 AS is_significant FROM b_dsr d"
    " JOIN b_psr p ON p.strategy_id = d.strategy_id JOIN b_ddsr q ON q.strategy_id = d.strategy_id",
)
_cte(
    "b_regime",
    "log",
    """SELECT strategy_id, (isodow(t0) - 1) % 3 AS regime, count(*) AS n_trades,
              avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(r) AS mean_ret, stddev_samp(r) AS std_ret,
              avg(r) / CASE WHEN stddev_samp(r) IS NOT NULL THEN greatest(stddev_samp(r), 1e-10) END * sqrt(252.0) AS sharpe,
              avg(r) * 252 AS ann_return
       FROM (SELECT *, net_pnl / greatest(notional, 1.0) AS r FROM log) GROUP BY 1, 2""",
)
_cte("b_pbo", "b_deltas", f"SELECT {_out(_PBO)} {_pbo_of('b_deltas')}")
ORACLES["evaluation_report"] = _sql(
    "b_basic b_sharpe b_regime b_pbo",
    " UNION ALL ".join(
        [
            _cells("basic", "b_basic", "sharpe_ratio sortino_ratio calmar_ratio max_drawdown win_rate n_trades total_return"),
            _cells(
                "deflated_sharpe",
                "b_sharpe",
                "sr sr_per_period psr dsr e_max_sr skewness excess_kurtosis is_significant",
            ),
            _cells(
                "regime",
                "b_regime",
                "n_trades win_rate mean_ret std_ret sharpe ann_return",
                suffix="'_' || CAST(regime AS VARCHAR)",
            ),
            _cells("overfitting", "b_pbo", "pbo logit_pbo median_oos_delta_sr n_combinations is_overfit", who="'all'"),
        ]
    ),
)
_oracle(
    "strategy_candidates",
    "matrix",
    "t=x.t@t;strategy_id=v.id@i;ret=x.r * v.m - (v.m - 1.0) * (5.0 / 10000.0) * 0.05@r",
    """FROM (SELECT t, avg(ret) AS r FROM matrix GROUP BY 1) x
       CROSS JOIN (VALUES (0, 0.6::DOUBLE), (1, 0.8::DOUBLE), (2, 1.0::DOUBLE), (3, 1.2::DOUBLE), (4, 1.4::DOUBLE)) v(id, m)""",
)
