"""The registered queries as SQL for an independent engine. Recurrences are row loops (recursive common table expressions)."""

from __future__ import annotations

from candlewick.sources.bars import CONSTITUENTS

_WALK = """
t AS (SELECT event_type AS ticker, ts, event_id, CAST(round(value * 100) AS BIGINT) - 5000 AS step FROM events),
w AS (SELECT *, CAST(5000000 + sum(step) OVER (PARTITION BY ticker ORDER BY ts, event_id) AS DOUBLE) / CAST(50000 AS DOUBLE) AS px FROM t),
bars0 AS (SELECT ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS date, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low,
                 arg_max(px, (ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume FROM w GROUP BY 1, 2)"""


def _lines(price: str) -> str:
    return f"""
p AS (SELECT *, {price} AS px, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
bars0 AS (SELECT p_brand AS ticker, l_shipdate AS date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
                 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM p GROUP BY 1, 2)"""


BARS = {"walk": _WALK, "brand": _lines("l_extendedprice / l_quantity"), "calm": _lines("1000 + l_extendedprice / l_quantity / 1000")}
_S = "PARTITION BY ticker ORDER BY date"


def bars(kind: str, more: str = "", recursive: bool = False, where: str = "true") -> str:
    """WITH clause that ends in ``bars``, its rows numbered from 0."""
    tail = f", bars AS MATERIALIZED (SELECT *, close AS adj_close, row_number() OVER ({_S}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars0 WHERE {where})"
    return f"WITH {'RECURSIVE ' if recursive else ''}{BARS[kind]}{tail}{', ' + more if more else ''} "


def labels(n: int, source: str = "bars") -> str:
    """``raw`` and ``lab``; a signal like the last raw one before it becomes Hold."""
    f = f"({_S} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""
ext AS (SELECT *, CASE WHEN count(adj_close) OVER {f} = {n} THEN min(adj_close) OVER {f} END AS prev_min,
               CASE WHEN count(adj_close) OVER {f} = {n} THEN max(adj_close) OVER {f} END AS prev_max FROM {source}),
raw AS (SELECT *, CASE WHEN adj_close <= prev_min THEN 2 WHEN adj_close >= prev_max THEN 0 ELSE 1 END AS raw_id FROM ext),
lab AS MATERIALIZED (SELECT *, CASE WHEN raw_id = last_value(CASE WHEN raw_id <> 1 THEN raw_id END IGNORE NULLS) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               THEN 1 ELSE raw_id END AS Label_id FROM raw)"""


NAME = "CASE Label_id WHEN 2 THEN 'Buy' WHEN 1 THEN 'Hold' ELSE 'Sell' END"
_UP = f"({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def positions(sell: int) -> str:
    return f"""
pos AS MATERIALIZED (SELECT *, coalesce(last_value(CASE Label_id WHEN 2 THEN 1 WHEN 0 THEN {sell} END IGNORE NULLS) OVER {_UP}, 0) AS position,
               coalesce(lead(adj_close) OVER ({_S}) / adj_close - 1, 0) AS fwd, coalesce(adj_close / lag(adj_close) OVER ({_S}) - 1, 0) AS ret FROM lab)"""


_EXECUTED = f"""
exe AS MATERIALIZED (SELECT *, abs(executed - coalesce(lag(executed) OVER ({_S}), 0)) AS turn
        FROM (SELECT *, coalesce(lag(position) OVER ({_S}), 0) AS executed FROM pos))"""
LOGS = f"""
lg AS MATERIALIZED (SELECT *, ln(greatest(open, 1e-12)) AS log_open, ln(greatest(high, 1e-12)) AS log_high, ln(greatest(low, 1e-12)) AS log_low, ln(greatest(close, 1e-12)) AS log_close,
  ln(greatest(adj_close, 1e-12)) AS log_adj_close, {', '.join(f"ln({c} / lag({c}) OVER ({_S})) AS {c}_ret" for c in ("open", "high", "low", "close", "adj_close"))},
  ln(1 + volume) - ln(1 + lag(volume) OVER ({_S})) AS volume_ret FROM bars)"""


def _rolling(fn: str, x: str, n: int) -> str:
    f = f"({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN {fn}({x}) OVER {f} END"


WINDOWED = f"""
wf AS MATERIALIZED (SELECT *, volume / {_rolling('avg', 'volume', 10)} AS volume_relatif, {_rolling('stddev_samp', 'adj_close_ret', 10)} AS volatility_10,
  CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - log_close) / (hh - ll) END AS williams, log_high - log_low AS range_log, log_close - log_open AS body_log,
  log_high - greatest(log_open, log_close) AS upper_wick_log, least(log_open, log_close) - log_low AS lower_wick_log
  FROM (SELECT *, {_rolling('max', 'log_high', 14)} AS hh, {_rolling('min', 'log_low', 14)} AS ll FROM lg))"""

#: Row loop of RSI's and MACD's averages: the seeds are means, then each row blends with the one before.
SMOOTHED = f"""
d AS MATERIALIZED (SELECT *, log_adj_close - lag(log_adj_close) OVER ({_S}) AS ch FROM lg),
sd AS MATERIALIZED (SELECT ticker, sum(CASE WHEN i BETWEEN 1 AND 14 THEN greatest(ch, 0) END) / 14 AS up0, sum(CASE WHEN i BETWEEN 1 AND 14 THEN greatest(-ch, 0) END) / 14 AS dn0,
              avg(CASE WHEN i BETWEEN 14 AND 25 THEN log_adj_close END) AS f0, avg(CASE WHEN i BETWEEN 0 AND 25 THEN log_adj_close END) AS s0 FROM d GROUP BY ticker),
osc AS (SELECT d.ticker, i, date, up0 AS up, dn0 AS dn, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS s FROM d JOIN sd USING (ticker) WHERE i = 14
        UNION ALL
        SELECT d.ticker, d.i, d.date, (13 * up + greatest(ch, 0)) / 14, (13 * dn + greatest(-ch, 0)) / 14,
               CASE WHEN d.i = 25 THEN f0 WHEN d.i > 25 THEN f + (d.log_adj_close - f) * 2 / 13 END, CASE WHEN d.i = 25 THEN s0 WHEN d.i > 25 THEN s + (d.log_adj_close - s) * 2 / 27 END
        FROM osc JOIN d ON d.ticker = osc.ticker AND d.i = osc.i + 1 JOIN sd ON sd.ticker = d.ticker)"""
RSI = "CASE WHEN up + dn = 0 THEN 0 ELSE 100 * up / (up + dn) END"
MACD = "CASE WHEN i >= 33 THEN f - s END"
FEATURES = ("open_ret", "high_ret", "low_ret", "close_ret", "adj_close_ret", "volume_ret", "rsi", "macd", "williams", "range_log", "body_log", "upper_wick_log", "lower_wick_log", "volume_relatif", "volatility_10")
ALL_FEATURES = f"""{LOGS}, {WINDOWED}, {SMOOTHED},
ft AS MATERIALIZED (SELECT wf.*, {RSI} AS rsi, {MACD} AS macd FROM wf LEFT JOIN osc USING (ticker, i))"""


def split(source: str, train: float = 0.7, val: float = 0.15) -> str:
    a, b = f"least(greatest(floor(m * CAST({train!r} AS DOUBLE)), 1), m - 2)", f"floor(m * CAST({train + val!r} AS DOUBLE))"
    return f"""
sp AS MATERIALIZED (SELECT *, CASE WHEN k < {a} THEN 'train' WHEN k < least(greatest({b}, {a} + 1), m - 1) THEN 'val' ELSE 'test' END AS split
       FROM (SELECT *, row_number() OVER ({_S}) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS m FROM {source}) WHERE m >= 3)"""


def backtest_loop(fee: float, cap: float, sell: int, cell: str = "ticker", source: str = "pos") -> str:
    """``run``: after each bar the capital, the position held, trades so far and whether it is over."""
    on = " AND ".join(f"q.{c} = run.{c}" for c in cell.split(", "))
    sig = f"CASE q.Label_id WHEN 2 THEN 1 WHEN 0 THEN {sell} ELSE hp END"
    grown = "run.cap * (1 + hp * q.ret)"
    return f"""
run AS (SELECT {cell}, CAST(-1 AS BIGINT) AS i, CAST({cap} AS DOUBLE) AS cap, 0 AS hp, CAST(0 AS BIGINT) AS trades, false AS over FROM {source} GROUP BY {cell}
        UNION ALL
        SELECT {', '.join('q.' + c for c in cell.split(', '))}, q.i,
               CASE WHEN run.over OR {grown} <= 0 OR {grown} - {fee} * abs({sig} - hp) <= 0 THEN 0 ELSE {grown} - {fee} * abs({sig} - hp) END,
               {sig}, run.trades + CASE WHEN run.over OR {grown} <= 0 THEN 0 ELSE abs({sig} - hp) END,
               run.over OR {grown} <= 0 OR {grown} - {fee} * abs({sig} - hp) <= 0
        FROM run JOIN {source} q ON {on} AND q.i = run.i + 1)"""


def grid_cells(windows: tuple, buffers: tuple, source: str = "bars", zero: bool = False) -> str:
    """``lab`` for every window and buffer pair, by the same rule as ``labels``. With ``zero`` a return from a price of 0 is 0."""
    f = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    parts = []
    for n in windows:
        g = f.format(n=n)
        parts.append(f"SELECT *, {n} AS \"window\", CASE WHEN count(adj_close) OVER {g} = {n} THEN min(adj_close) OVER {g} END AS lo, CASE WHEN count(adj_close) OVER {g} = {n} THEN max(adj_close) OVER {g} END AS hi FROM {source}")
    own = "PARTITION BY ticker, \"window\", buy_buffer, sell_buffer ORDER BY date"
    last = f"nullif(lag(adj_close) OVER ({own}), 0)" if zero else f"lag(adj_close) OVER ({own})"
    values = ", ".join(f"({b!r})" for b in buffers)
    return f"""
ext AS ({' UNION ALL '.join(parts)}),
bb AS (SELECT CAST(v AS DOUBLE) AS buy_buffer FROM (VALUES {values}) AS x(v)), sb AS (SELECT CAST(v AS DOUBLE) AS sell_buffer FROM (VALUES {values}) AS y(v)),
raw AS (SELECT *, CASE WHEN adj_close <= lo * (1 - buy_buffer) THEN 2 WHEN adj_close >= hi * (1 + sell_buffer) THEN 0 ELSE 1 END AS raw_id FROM ext, bb, sb),
pos AS MATERIALIZED (SELECT *, CASE WHEN raw_id = last_value(CASE WHEN raw_id <> 1 THEN raw_id END IGNORE NULLS) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE raw_id END AS Label_id,
               coalesce(adj_close / {last} - 1, 0) AS ret FROM raw)"""


#: A fixed score of each labelled row, so that measures can be compared: softmax of three scaled features.
SCORED = f"""
z AS (SELECT ticker, date, lab.Label_id AS y_true, 300 * (adj_close / open - 1) AS a, 200 * (high / low - 1) AS b, 250 * (open / close - 1) AS c FROM lab),
e AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM z),
sc AS MATERIALIZED (SELECT ticker, date, y_true, round(ea / (ea + eb + ec), 6) AS p_sell, round(eb / (ea + eb + ec), 6) AS p_hold, round(ec / (ea + eb + ec), 6) AS p_buy FROM e)"""


def predicted(buy: str = "0.75", sell: str = "0.75") -> str:
    return f"CASE WHEN p_buy > p_sell AND p_buy > p_hold AND p_buy >= {buy} THEN 2 WHEN p_sell >= p_hold AND p_sell >= p_buy AND p_sell >= {sell} THEN 0 ELSE 1 END"


def measures(source: str, by: str = "") -> str:
    """SELECT of the nine measures from rows with y_true and y_pred."""
    sums = ", ".join(f"count(*) FILTER (y_true = {k} AND y_pred = {k}) AS tp{k}, count(*) FILTER (y_pred = {k}) AS p{k}, count(*) FILTER (y_true = {k}) AS t{k}" for k in range(3))
    pr = lambda k: f"CASE WHEN p{k} > 0 THEN tp{k} / p{k} ELSE 0 END"
    rc = lambda k: f"CASE WHEN t{k} > 0 THEN tp{k} / t{k} ELSE 0 END"
    f1 = lambda k: f"CASE WHEN ({pr(k)}) + ({rc(k)}) > 0 THEN 2 * ({pr(k)}) * ({rc(k)}) / (({pr(k)}) + ({rc(k)})) ELSE 0 END"
    named = ", ".join(f"round({pr(k)}, 8) AS precision_{n}, round({rc(k)}, 8) AS recall_{n}" for k, n in enumerate(("sell", "hold", "buy")))
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {by + ', ' if by else ''}round(r / n, 8) AS acc, round(({rc(0)} + {rc(1)} + {rc(2)}) / 3, 8) AS bal_acc, round(({f1(0)} + {f1(1)} + {f1(2)}) / 3, 8) AS macro_f1, {named}
FROM (SELECT {by + ', ' if by else ''}count(*) AS n, count(*) FILTER (y_true = y_pred) AS r, {sums} FROM {source}{group})"""


def context_rows(length: int) -> str:
    """``cw``: labelled context rows with their part, windows over whole series."""
    frame = f"({_S} ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    return f"""{labels(20)}, {ALL_FEATURES},
ok AS (SELECT ft.ticker, ft.date, ft.adj_close, {', '.join(FEATURES)}, lab.Label_id FROM ft JOIN lab ON ft.ticker = lab.ticker AND ft.date = lab.date WHERE {' AND '.join(f'{x} IS NOT NULL' for x in FEATURES)}),
{split('ok')}, cx AS (SELECT ticker, date, adj_close, Label_id, split, flatten(list([{', '.join(FEATURES)}]) OVER {frame}) AS context FROM sp),
cw AS MATERIALIZED (SELECT * FROM cx WHERE len(context) = {length * len(FEATURES)})"""


def net_rows(net, length: int) -> str:
    """``ns``: scaled context rows with the net's probabilities."""
    n = length * len(FEATURES)
    vector = lambda v: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in v) + "]"
    hidden = ", ".join(f"greatest(0, list_dot_product(z, {vector(w)}) + {float(b)!r}::DOUBLE)" for w, b in zip(net.w0.T, net.b0, strict=True))
    logits = ", ".join(f"list_dot_product(h, {vector(w)}) + {float(b)!r}::DOUBLE AS {name}" for w, b, name in zip(net.w1.T, net.b1, "abc", strict=True))
    return f"""
mo AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS std FROM (SELECT unnest(context) AS x, generate_subscripts(context, 1) AS pos FROM cw WHERE split = 'train') GROUP BY pos),
ml AS (SELECT list(mean ORDER BY pos) AS means, list(std ORDER BY pos) AS stds FROM mo),
nz AS (SELECT cw.*, list_transform(range(1, {n + 1}), lambda j: (context[j] - means[j]) / stds[j]) AS z FROM cw, ml),
nh AS (SELECT *, [{hidden}] AS h FROM nz), nl AS (SELECT *, {logits} FROM nh),
ne AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM nl),
ns AS MATERIALIZED (SELECT ticker, date, adj_close, split, Label_id AS y_true, ea / (ea + eb + ec) AS p_sell, eb / (ea + eb + ec) AS p_hold, ec / (ea + eb + ec) AS p_buy FROM ne)"""


def fit_epochs(net, alpha: float, epochs: int) -> str:
    """``losses`` and weights of full gradient steps from ``net`` on the scaled training rows ``nz``: the chain rule written
    out, sums of products row by row."""
    vector = lambda v: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in v) + "]"
    matrix = lambda m: "[" + ", ".join(vector(v) for v in m) + "]"
    hidden = f"range(1, {net.w0.shape[1] + 1})"
    parts = [f"""
tc AS (SELECT Label_id AS y, count(*) AS c FROM nz WHERE split = 'train' GROUP BY 1),
tw AS MATERIALIZED (SELECT row_number() OVER () AS r, z, Label_id AS y, (SELECT sum(c) FROM tc) / (3.0 * c) AS w FROM nz JOIN tc ON y = Label_id WHERE split = 'train'),
q0 AS (SELECT {matrix(net.w0.T)} AS w0, {vector(net.b0)} AS b0, {matrix(net.w1)} AS w1, {vector(net.b1)} AS b1)"""]
    for e in range(1, epochs + 1):
        q, f = f"q{e - 1}", f"f{e}"
        parts.append(f"""
{f}h AS (SELECT r, z, y, w, w1, b1, list_transform({hidden}, lambda j: greatest(0, list_dot_product(z, w0[j]) + b0[j])) AS h FROM tw, {q}),
{f}l AS (SELECT *, list_transform([1, 2, 3], lambda c: b1[c] + list_sum(list_transform({hidden}, lambda j: h[j] * w1[j][c]))) AS l FROM {f}h),
{f}e AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS x FROM {f}l),
{f}p AS (SELECT *, list_transform(x, lambda v: v / list_sum(x)) AS p FROM {f}e),
{f}d AS (SELECT *, list_transform([1, 2, 3], lambda c: (p[c] - CASE WHEN c = y + 1 THEN 1 ELSE 0 END) * w) AS dz FROM {f}p),
{f} AS MATERIALIZED (SELECT *, list_transform({hidden}, lambda j: CASE WHEN h[j] > 0 THEN list_dot_product(dz, w1[j]) ELSE 0 END) AS da FROM {f}d),
t{e} AS (SELECT sum(w) AS t, -sum(w * ln(p[y + 1] + 1e-12)) / sum(w) AS loss FROM {f}),
u{e} AS (SELECT r, z, h, dz, j, da[j] AS da, h[j] AS hj FROM (SELECT r, z, h, dz, da, unnest({hidden}) AS j FROM {f})),
a{e} AS (SELECT j, i, sum(z[i] * da) AS g FROM (SELECT z, da, j, unnest(range(1, {net.w0.shape[0] + 1})) AS i FROM u{e}) GROUP BY j, i),
b{e} AS (SELECT j, list(g ORDER BY i) AS g FROM a{e} GROUP BY j),
c{e} AS (SELECT j, sum(da) AS gb, [sum(hj * dz[1]), sum(hj * dz[2]), sum(hj * dz[3])] AS gw FROM u{e} GROUP BY j),
q{e} AS MATERIALIZED (SELECT list_transform({hidden}, lambda j: list_transform(range(1, {net.w0.shape[0] + 1}), lambda i: w0[j][i] - {alpha!r} * g0[j][i] / t)) AS w0,
  list_transform({hidden}, lambda j: b0[j] - {alpha!r} * gb[j] / t) AS b0, list_transform({hidden}, lambda j: list_transform([1, 2, 3], lambda c: w1[j][c] - {alpha!r} * g1[j][c] / t)) AS w1,
  list_transform([1, 2, 3], lambda c: b1[c] - {alpha!r} * gz[c] / t) AS b1
  FROM {q}, t{e}, (SELECT list(g ORDER BY j) AS g0 FROM b{e}), (SELECT list(gb ORDER BY j) AS gb, list(gw ORDER BY j) AS g1 FROM c{e}), (SELECT [sum(dz[1]), sum(dz[2]), sum(dz[3])] AS gz FROM {f}))""")
    return ",".join(parts)


def net_job(kind: str, net, length: int, thresholds: str, record: str, short: bool, fee: float, where: str = "true") -> str:
    """Test measures and portfolio of a net whose thresholds are the best on the validation rows."""
    rows = f"gr AS (SELECT CAST(buy_threshold AS DOUBLE) AS buy_threshold, CAST(sell_threshold AS DOUBLE) AS sell_threshold, y_true, {predicted('buy_threshold', 'sell_threshold')} AS y_pred FROM ns, bt, st WHERE split = 'val')"
    chosen = f"me AS ({measures('gr', 'buy_threshold, sell_threshold')}), be AS (SELECT buy_threshold, sell_threshold FROM me ORDER BY macro_f1 DESC, buy_threshold, sell_threshold LIMIT 1)"
    te = f"te AS MATERIALIZED (SELECT ticker, date, adj_close, y_true, {predicted('buy_threshold', 'sell_threshold')} AS y_pred, y_pred AS Label_id, row_number() OVER ({_S}) - 1 AS i FROM ns, be WHERE split = 'test')"
    pos = positions(-1 if short else 0).replace("FROM lab", "FROM te")
    executed = _EXECUTED if short else _EXECUTED.replace(f"coalesce(lag(position) OVER ({_S}), 0) AS executed", "position AS executed")
    loop = f"""share AS (SELECT 10000.0 / count(DISTINCT ticker) AS share FROM exe),
run AS (SELECT ticker, CAST(-1 AS BIGINT) AS i, CAST((SELECT share FROM share) AS DOUBLE) AS cap FROM exe GROUP BY ticker
        UNION ALL SELECT e.ticker, e.i, greatest(cap * (1 + executed * fwd) - {fee} * turn, 0) FROM run JOIN exe e ON e.ticker = run.ticker AND e.i = run.i + 1),
c AS (SELECT ticker, arg_max(cap, i) AS m FROM run GROUP BY ticker), hh AS (SELECT ticker, count(*) AS k, product(1 + fwd) * (SELECT share FROM share) AS h FROM exe GROUP BY ticker),
s AS (SELECT (SELECT share FROM share) * count(*) AS start, sum(m) AS m, sum(h) AS h FROM c JOIN hh USING (ticker) WHERE k >= 2)"""
    more = f"{context_rows(length)}, {net_rows(net, length)}, {thresholds}, {rows}, {chosen}, {te}, {pos}, {executed}, {loop}, mt AS ({measures('te')}), rc AS (SELECT {record} FROM s)"
    return bars(kind, more, True, where) + "SELECT mt.*, rc.*, be.* FROM mt, rc, be"


def oracle_sql(grid_windows: tuple, grid_buffers: tuple, net, length: int, single: str, brand: str, alpha: float) -> dict[str, str]:
    ohlc = "SELECT ticker, date, open, high, low, close, volume FROM bars"
    two = lambda x: f"round({x}, 2)"
    names = ", ".join("('{}', '{}')".format(*(v.replace("'", "''") for v in pair)) for pair in CONSTITUENTS)
    record = f"{two('start')} AS initial_capital, {two('m')} AS model_final_capital, {two('h')} AS buy_hold_final_capital, {two('m - start')} AS model_pnl, {two('h - start')} AS buy_hold_pnl, {two('m - h')} AS outperformance"
    lab20 = labels(20)
    last = "arg_max(cap, i)"
    ends = lambda cell: f"SELECT {cell}, {two(last)} AS final_capital, arg_max(trades, i) AS n_trades, bool_or(over) AS stopped_early, {two(last + ' - 10000')} AS pnl FROM run GROUP BY {cell}"
    raw_ends = lambda cell: f"SELECT {cell}, {last} AS final_capital, arg_max(trades, i) AS n_trades FROM run GROUP BY {cell}"
    cellq = 'ticker, "window", buy_buffer, sell_buffer'
    hold = "hold AS (SELECT ticker, 10000 * product(1 + ret) AS h FROM (SELECT ticker, coalesce(adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS ret FROM bars) GROUP BY ticker)"

    hold0 = hold.replace("lag(adj_close) OVER (PARTITION BY ticker ORDER BY date)", "nullif(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), 0)")

    def grid(sell: int, windows: tuple = grid_windows, buffers: tuple = grid_buffers, part: str = "", zero: bool = False) -> str:
        """Every cell of the grid; with ``part`` on that part of each series, with ``zero`` a return from a price of 0 is 0."""
        source = "own" if part else "bars"
        own = f"{split('bars')}, own AS MATERIALIZED (SELECT * EXCLUDE (i), row_number() OVER ({_S}) - 1 AS i FROM sp WHERE split = '{part}'), " if part else ""
        more = f"{own}{grid_cells(windows, buffers, source, zero)}, {(hold0 if zero else hold).replace('FROM bars', f'FROM {source}')}, {backtest_loop(2.0, 10000.0, sell, cellq)}, g AS ({raw_ends(cellq)})"
        listed = lambda values: "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]"
        index = f"(list_position([{', '.join(map(str, windows))}], \"window\") - 1) * {len(buffers) ** 2} + (list_position({listed(buffers)}, buy_buffer) - 1) * {len(buffers)} + list_position({listed(buffers)}, sell_buffer) - 1"
        return bars("walk", more, True) + f"SELECT g.ticker, CAST({index} AS INTEGER) AS grid_index, \"window\", buy_buffer, sell_buffer, round(final_capital - h, 2) AS score, round(final_capital, 2) AS final_capital, round(final_capital - 10000, 2) AS pnl, n_trades FROM g JOIN hold USING (ticker)"

    port = lambda n: f"""{labels(n)}, {positions(0)}, c AS (SELECT ticker, count(*) AS k, product(1 + position * fwd) AS m, product(1 + fwd) AS h FROM pos GROUP BY ticker),
s AS (SELECT 10000.0 / count(*) * count(*) FILTER (k >= 2) AS start, 10000.0 / count(*) * sum(m) FILTER (k >= 2) AS m, 10000.0 / count(*) * sum(h) FILTER (k >= 2) AS h FROM c)"""  # noqa: E731
    ctx = 5
    small = ("body_log", "volume_relatif", "williams")
    lists = f"flatten(list([{', '.join(small)}]) OVER ({_S} ROWS BETWEEN {ctx - 1} PRECEDING AND CURRENT ROW))"
    contexts = f"{LOGS}, {WINDOWED}, ok AS (SELECT * FROM wf WHERE body_log IS NOT NULL AND volume_relatif IS NOT NULL AND williams IS NOT NULL), cx AS MATERIALIZED (SELECT ticker, date, {lists} AS context FROM ok), cw AS MATERIALIZED (SELECT * FROM cx WHERE len(context) = {ctx * 3})"
    moments = "mo AS MATERIALIZED (SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS std FROM (SELECT unnest(context) AS x, generate_subscripts(context, 1) - 1 AS pos FROM cw) GROUP BY pos)"
    thresholds = "bt AS (SELECT unnest([0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85]) AS buy_threshold), st AS (SELECT unnest([0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]) AS sell_threshold)"
    grid_rows = f"gr AS (SELECT CAST(buy_threshold AS DOUBLE) AS buy_threshold, CAST(sell_threshold AS DOUBLE) AS sell_threshold, y_true, {predicted('buy_threshold', 'sell_threshold')} AS y_pred FROM sc, bt, st)"
    weights = "cw AS (SELECT y_true, (SELECT count(*) FROM sc) / (3.0 * count(*)) AS weight FROM sc GROUP BY y_true)"
    r8 = lambda *c: ", ".join(f"round({x}, 8) AS {x}" for x in c)
    features = ", ".join(f"round({x}, {3 if x in ('rsi', 'williams') else 7}) AS {x}" for x in FEATURES)
    return {
        **{f"bars_{k}": bars(k) + ohlc for k in BARS},
        "bars_quality": bars("calm") + "SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(coalesce(sum(c) FILTER (ticker IS NULL), 0) AS BIGINT) AS null_tickers, CAST(coalesce(sum(c) FILTER (date IS NULL), 0) AS BIGINT) AS null_dates, count(*) FILTER (c > 1) AS duplicate_keys FROM (SELECT ticker, date, count(*) AS c FROM bars GROUP BY 1, 2)",
        "prev_extrema": bars("calm", lab20) + "SELECT ticker, date, prev_min, prev_max FROM ext",
        "raw_labels": bars("calm", lab20) + "SELECT ticker, date, raw_id FROM raw",
        "labels": bars("calm", lab20) + f"SELECT ticker, date, Label_id, {NAME} AS Label FROM lab",
        "label_stats": bars("calm", lab20) + "SELECT ticker, count(*) FILTER (Label_id = 2) AS n_buy, count(*) FILTER (Label_id = 1) AS n_hold, count(*) FILTER (Label_id = 0) AS n_sell FROM lab GROUP BY ticker",
        "positions": bars("calm", f"{lab20}, {positions(-1)}") + "SELECT ticker, date, position FROM pos",
        "forward_returns": bars("calm", f"{lab20}, {positions(0)}") + f"SELECT ticker, date, {r8('fwd').replace('AS fwd', 'AS forward_return')}, round(ret, 8) AS simple_return FROM pos",
        "strategy_curve": bars("walk", f"{lab20}, {positions(0)}") + f"SELECT ticker, date, round(10000 * product(1 + position * fwd) OVER {_UP}, 2) AS model_capital FROM pos",
        "buy_hold_curve": bars("walk", f"{lab20}, {positions(0)}") + f"SELECT ticker, date, round(10000 * product(1 + fwd) OVER {_UP}, 2) AS buy_hold_capital FROM pos",
        "label_pnl_portfolio": bars("calm", port(20)) + f"SELECT {record} FROM s",
        "benchmark_log": bars("calm", LOGS) + "SELECT ticker, round(10000 * exp(coalesce(sum(adj_close_ret), 0)), 4) AS benchmark FROM lg GROUP BY ticker",
        "benchmark_simple": bars("calm", hold) + "SELECT ticker, round(h, 4) AS benchmark FROM hold",
        "split_assign": bars("calm", split("bars")) + "SELECT ticker, date, split FROM sp",
        "split_sizes": bars("calm", split("bars")) + "SELECT ticker, split, count(*) AS n_rows FROM sp GROUP BY 1, 2",
        "log_returns": bars("calm", LOGS) + f"SELECT ticker, date, {r8(*FEATURES[:6])} FROM lg",
        "candle_features": bars("calm", f"{LOGS}, {WINDOWED}") + f"SELECT ticker, date, {r8('range_log', 'body_log', 'upper_wick_log', 'lower_wick_log')} FROM wf",
        "relative_volume": bars("calm", f"{LOGS}, {WINDOWED}") + f"SELECT ticker, date, {r8('volume_relatif')} FROM wf",
        "volatility": bars("calm", f"{LOGS}, {WINDOWED}") + f"SELECT ticker, date, {r8('volatility_10')} FROM wf",
        "williams_r": bars("calm", f"{LOGS}, {WINDOWED}") + "SELECT ticker, date, round(williams, 3) AS williams FROM wf",
        "rsi": bars("calm", f"{LOGS}, {SMOOTHED}", True) + f"SELECT bars.ticker, bars.date, round({RSI}, 3) AS rsi FROM bars LEFT JOIN (SELECT ticker, i, up, dn FROM osc) o ON o.ticker = bars.ticker AND o.i = bars.i",
        "macd": bars("calm", f"{LOGS}, {SMOOTHED}", True) + "SELECT bars.ticker, bars.date, round(CASE WHEN bars.i >= 33 THEN f - s END, 7) AS macd FROM bars LEFT JOIN (SELECT ticker, i, f, s FROM osc) o ON o.ticker = bars.ticker AND o.i = bars.i",
        "feature_table": bars("calm", ALL_FEATURES, True) + f"SELECT ticker, date, {features} FROM ft WHERE {' AND '.join(f'{x} IS NOT NULL' for x in FEATURES)}",
        "executed_positions": bars("calm", f"{lab20}, {positions(-1)}, {_EXECUTED}") + "SELECT ticker, date, executed FROM exe",
        "turnover": bars("calm", f"{lab20}, {positions(-1)}, {_EXECUTED}") + "SELECT ticker, date, turn AS turnover FROM exe",
        "fee_curve": bars("walk", f"""{lab20}, {positions(-1)}, {_EXECUTED},
run AS (SELECT ticker, CAST(-1 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS date, CAST(10000 AS DOUBLE) AS cap FROM exe GROUP BY ticker
        UNION ALL SELECT e.ticker, e.i, e.date, greatest(cap * (1 + executed * fwd) - 2.0 * turn, 0) FROM run JOIN exe e ON e.ticker = run.ticker AND e.i = run.i + 1)""", True) + "SELECT ticker, date, round(cap, 2) AS model_capital FROM run WHERE i >= 0",
        "strategy_record": bars("calm", f"{lab20}, {positions(0)}, c AS (SELECT ticker, 10000.0 AS start, 10000 * product(1 + position * fwd) AS m, 10000 * product(1 + fwd) AS h FROM pos GROUP BY ticker HAVING count(*) >= 2)") + f"SELECT ticker, {record} FROM c",
        "portfolio_long_short": bars("walk", f"""{lab20}, {positions(-1)}, {_EXECUTED}, share AS (SELECT 10000.0 / count(DISTINCT ticker) AS share FROM exe),
run AS (SELECT ticker, CAST(-1 AS BIGINT) AS i, CAST((SELECT share FROM share) AS DOUBLE) AS cap FROM exe GROUP BY ticker
        UNION ALL SELECT e.ticker, e.i, greatest(cap * (1 + executed * fwd) - 2.0 * turn, 0) FROM run JOIN exe e ON e.ticker = run.ticker AND e.i = run.i + 1),
c AS (SELECT ticker, arg_max(cap, i) AS m FROM run GROUP BY ticker), hh AS (SELECT ticker, count(*) AS k, product(1 + fwd) * (SELECT share FROM share) AS h FROM exe GROUP BY ticker),
s AS (SELECT (SELECT share FROM share) * count(*) AS start, sum(m) AS m, sum(h) AS h FROM c JOIN hh USING (ticker) WHERE k >= 2)""", True) + f"SELECT {record} FROM s",
        "predictions_aligned": bars("calm", f"{lab20}, {SCORED}") + f"SELECT ticker, date, close, CAST({predicted()} AS INTEGER) AS y_pred FROM sc JOIN bars USING (ticker, date)",
        "best_thresholds": bars("calm", f"{lab20}, {SCORED}, {thresholds}, {grid_rows.replace('y_true,', 'y_true, ticker,', 1)}, me AS ({measures('gr', 'ticker, buy_threshold, sell_threshold')})") + "SELECT ticker, buy_threshold, sell_threshold, macro_f1, bal_acc FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY macro_f1 DESC, buy_threshold, sell_threshold) AS place FROM me) WHERE place = 1",
        "backtest_long": bars("calm", f"{lab20}, {positions(0)}, {backtest_loop(2.0, 10000.0, 0)}", True) + ends("ticker"),
        "backtest_long_short": bars("calm", f"{lab20}, {positions(-1)}, {backtest_loop(2.0, 10000.0, -1)}", True) + ends("ticker"),
        "backtest_bankrupt": bars("brand", f"{lab20}, {positions(-1)}, {backtest_loop(2.0, 10000.0, -1)}", True) + ends("ticker"),
        "label_grid_long": grid(0, zero=True),
        "label_grid_long_short": grid(-1, zero=True),
        "label_grid_best": f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, grid_index) AS place FROM ({grid(-1, zero=True)})) WHERE place = 1",
        "context_windows": bars("calm", contexts) + "SELECT ticker, date, CAST(len(context) AS INTEGER) AS size, round(list_sum(list_transform(context, lambda x, k: x * k)), 4) AS weighted FROM cw",
        "feature_moments": bars("calm", f"{contexts}, {moments}") + "SELECT CAST(pos AS INTEGER) AS pos, round(mean, 6) AS mean, round(std, 6) AS std FROM mo",
        "standardized": bars("calm", f"{contexts}, {moments}, sx AS (SELECT ticker, date, pos, (x - mean) / std AS v FROM (SELECT ticker, date, unnest(context) AS x, generate_subscripts(context, 1) - 1 AS pos FROM cw) JOIN mo USING (pos))") + "SELECT ticker, date, round(sum(v * (pos + 1)), 4) AS weighted FROM sx GROUP BY 1, 2",
        "class_weights": bars("calm", f"{lab20}, {SCORED}, {weights}") + "SELECT CAST(k AS INTEGER) AS Label_id, round(coalesce(weight, (SELECT count(*) FROM sc) / 3.0), 8) AS weight FROM (SELECT unnest([0, 1, 2]) AS k) LEFT JOIN cw ON y_true = k",
        "scored_rows": bars("calm", f"{lab20}, {SCORED}") + "SELECT ticker, date, CAST(y_true AS INTEGER) AS y_true, p_sell, p_hold, p_buy FROM sc",
        "threshold_predict": bars("calm", f"{lab20}, {SCORED}") + f"SELECT ticker, date, CAST({predicted()} AS INTEGER) AS y_pred FROM sc",
        "confusion": bars("calm", f"{lab20}, {SCORED}, pr AS (SELECT y_true, {predicted()} AS y_pred FROM sc)") + "SELECT CAST(k AS INTEGER) AS y_true, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1, count(*) FILTER (y_pred = 2) AS pred_2 FROM (SELECT unnest([0, 1, 2]) AS k) LEFT JOIN pr ON y_true = k GROUP BY k",
        "metrics": bars("calm", f"{lab20}, {SCORED}, pr AS (SELECT ticker, y_true, {predicted()} AS y_pred FROM sc)") + measures("pr", "ticker"),
        "cross_entropy": bars("calm", f"{lab20}, {SCORED}, {weights}") + "SELECT round(-sum(weight * ln(CASE y_true WHEN 0 THEN p_sell WHEN 1 THEN p_hold ELSE p_buy END + 1e-12)) / sum(weight), 6) AS cross_entropy FROM sc JOIN cw USING (y_true)",
        "threshold_grid": bars("calm", f"{lab20}, {SCORED}, {thresholds}, {grid_rows}") + f"SELECT buy_threshold, sell_threshold, acc, bal_acc, macro_f1 FROM ({measures('gr', 'buy_threshold, sell_threshold')})",
        "last_n_signals": bars("calm", lab20) + "SELECT ticker, date, adj_close, Label_id = 2 AS is_buy, Label_id = 0 AS is_sell FROM lab WHERE n - i <= 160",
        "wide_to_long": bars("walk") + "SELECT date, ticker, open, high, low, close, adj_close, CAST(volume AS DOUBLE) AS volume FROM bars",
        "constituents_join": bars("calm") + "SELECT ticker, date, 'Co ' || ticker AS company FROM bars",
        "dataset_summary": bars("calm") + "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers FROM bars",
        "label_grid_full": grid(-1, tuple(range(2, 61)), (0.0, 0.001, 0.002, 0.005), "val", True),
        "label_grid_long_full": grid(0, tuple(range(5, 61)), (0.0, 0.001, 0.002, 0.005), "val", True),
        "top_cells": f"SELECT * FROM ({grid(-1)}) ORDER BY score DESC, grid_index, ticker LIMIT 20",
        "train_single_long": net_job("walk", net, length, thresholds, record, False, 0.0, f"ticker = '{single}'"),
        "train_single_long_short": net_job("walk", net, length, thresholds, record, True, 0.0, f"ticker = '{single}'"),
        "train_multi_long": net_job("calm", net, length, thresholds, record, False, 0.0),
        "train_multi_long_short": net_job("calm", net, length, thresholds, record, True, 1.0),
        "model_score": bars("calm", f"{context_rows(length)}, {net_rows(net, length)}", True) + "SELECT ticker, date, round(p_sell, 6) AS p_sell, round(p_hold, 6) AS p_hold, round(p_buy, 6) AS p_buy FROM ns WHERE split = 'test'",
        "model_fit": bars("calm", f"{context_rows(length)}, {net_rows(net, length)}, {fit_epochs(net, alpha, 3)}", True) + " UNION ALL ".join(f"SELECT CAST({e} AS INTEGER) AS epoch, round(loss, 6) AS loss, round(list_sum(flatten(w0)), 6) AS w0, round(list_sum(b0), 6) AS b0, round(w1[1][1], 6) AS w1, round(b1[3], 6) AS b1 FROM t{e}, q{e}" for e in (1, 2, 3)),
        "history_contexts": bars("calm", context_rows(length), True) + "SELECT ticker, date, split, CAST(Label_id AS INTEGER) AS Label_id, round(list_sum(list_transform(context, lambda x, k: x * k)), 2) AS weighted FROM cw",
        "ticker_filter": bars("calm") + f"{ohlc} WHERE ticker = '{brand}'",
        "null_tickers_dropped": bars("calm", port(20), where=f"ticker <> '{brand}'") + f"SELECT {record} FROM s",
        "text_dates": bars("calm", port(20)) + f"SELECT {record} FROM s",
        "scalars": bars("calm", lab20) + """SELECT ticker, date, CAST(Label_id AS INTEGER) AS label_code, CAST(Label_id = 0 AS INTEGER) AS hot_0, CAST(Label_id = 1 AS INTEGER) AS hot_1, CAST(Label_id = 2 AS INTEGER) AS hot_2,
  round(greatest(close / open - 1, 0), 8) AS gain, CASE WHEN close / open - 1 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slope, abs(close - open) <= 5.0 + 0.00001 * abs(open) AS near,
  CAST(date AS DATE) AS day, CAST(date AS DATE) + 1 AS day_after, CAST(NULL AS DATE) AS no_day FROM lab""",
        "ingest": bars("walk") + "SELECT ticker, date, 'Co ' || ticker AS company, open, high, low, close, adj_close, CAST(volume AS DOUBLE) AS volume FROM bars",
        "csv_round_trip": bars("calm") + ohlc,
        "partitioned_scan": bars("calm") + f"SELECT ticker, date, close, volume FROM bars WHERE ticker = '{brand}'",
        "save_auto": bars("calm") + "SELECT ticker, count(*) AS n_rows, CAST(sum(volume) AS BIGINT) AS volume, max(close) AS top FROM bars GROUP BY ticker",
        "labels_chunked": bars("calm", lab20) + f"SELECT ticker, date, Label_id, {NAME} AS Label FROM lab",
        "features_chunked": bars("calm", ALL_FEATURES, True) + f"SELECT ticker, date, {features} FROM ft WHERE {' AND '.join(f'{x} IS NOT NULL' for x in FEATURES)}",
        "backtest_chunked": bars("calm", f"{lab20}, {positions(-1)}, {backtest_loop(2.0, 10000.0, -1)}", True) + ends("ticker"),
        "bankrupt_chunked": bars("brand", f"{lab20}, {positions(-1)}, {backtest_loop(2.0, 10000.0, -1)}", True) + ends("ticker"),
        "labels_bucketed": bars("calm", lab20) + "SELECT ticker, date, Label_id FROM lab",
        "constituents": bars("calm", f"nm AS (SELECT ticker, company, row_number() OVER (ORDER BY ticker) AS place FROM (VALUES {names}) AS c(ticker, company)), br AS (SELECT ticker AS brand, row_number() OVER (ORDER BY ticker) AS place FROM bars GROUP BY ticker)") + "SELECT nm.ticker, date, nm.company, close FROM bars JOIN br ON bars.ticker = brand JOIN nm USING (place)",
        "ingest_order": bars("calm", f"st AS (SELECT ticker, date < lag(date) OVER (PARTITION BY ticker ORDER BY n - i > 10, date) AS back FROM bars)") + "SELECT ticker, count(*) AS n_rows, count(*) FILTER (back) AS n_backward FROM st GROUP BY ticker",
        "date_range": bars("calm") + "SELECT ticker, date, close FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1997-01-01'",
    }
