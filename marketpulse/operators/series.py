"""Ordered-series building blocks that never put a whole series in one task.

A daily price series per symbol is the natural unit of the indicator work,
but at scale one symbol may hold a large share of all rows.  Windows
partitioned by ``symbol`` alone would then run that share in one task.  The
helpers here split every series into fixed-size row blocks:

* :func:`index_series` numbers the rows of each series (0-based) with a
  deterministic plan: quantiles of each series' times cut it into buckets of
  a bounded number of rows, row counts per (key, bucket) give each bucket its
  offset, and a window over (key, bucket) numbers rows inside it.
* :func:`halo_blocks` copies the last ``halo`` rows of each block into the
  next block, so ROWS-framed windows of up to ``halo + 1`` rows are exact
  inside ``partitionBy(key, block)``.
* :func:`ema` evaluates the recursive exponential average as a block scan:
  a windowed sum inside each block plus a carry from the earlier blocks.

All three are plain DataFrame plans (aggregate, window, join, explode).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDX = "_i"
BLK = "_blk"
HALO = "_halo"

# Default sizes.  A bucket should hold what one task sorts comfortably; one
# pass cuts a series into CUTS buckets at most, and longer series are cut in
# further passes; a block is the unit of the window work (its length also
# bounds r**-j in the EMA scan, see _block_for).
DEFAULT_BUCKET_ROWS = 1 << 18
CUTS = 128
DEFAULT_BLOCK_ROWS = 1024


# The expressions below are written as Spark SQL text (``F.expr`` /
# ``selectExpr``): the JVM parses a whole expression in one call, where
# building it node by node from Python costs a round trip per operator.
def _q(name: str) -> str:
    """Quoted column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def _d(v: float) -> str:
    """Exact double literal for SQL text."""
    return f"{float(v)!r}D"


def _over(part: Sequence[str], order: str, frame: str | None = None) -> str:
    w = f"PARTITION BY {', '.join(_q(c) for c in part)} ORDER BY {order}"
    return f"OVER ({w}{' ROWS BETWEEN ' + frame if frame else ''})"


def _order_seconds(df: DataFrame, order: str) -> str:
    """SQL for seconds since 1970 of ``order``, increasing with the column's
    own order and independent of the session time zone (a wall-clock value
    is never mapped through a zone, so no DST gap can reorder it)."""
    t = df.schema[order].dataType
    c = _q(order)
    if isinstance(t, T.TimestampNTZType):
        # from the wall-clock fields: no conversion through a zone
        return (f"(unix_date(CAST({c} AS DATE)) * 86400 + hour({c}) * 3600"
                f" + minute({c}) * 60 + second({c}))")
    if isinstance(t, T.TimestampType):
        return f"unix_seconds({c})"
    if isinstance(t, T.DateType):
        return f"unix_date({c}) * 86400"
    return f"CAST({c} AS BIGINT)"


def shares(n: int) -> str:
    """SQL for the constant array of k / n, 0 < k < n: one expression to analyse, not n."""
    return f"CAST(split('{','.join(repr(k / n) for k in range(1, n))}', ',') AS ARRAY<DOUBLE>)"


def _cut(df: DataFrame, by: Sequence[str], value: str, rows: int, cuts: int, name: str) -> DataFrame:
    """Add ``name``: 0 up to ``cuts - 1``, growing with the SQL ``value`` inside
    each ``by`` group.  A group of n rows gets ceil(n / rows) numbers, at most
    ``cuts``, changing at quantiles of its values."""
    stats = df.groupBy(*by).agg(F.expr(f"percentile_approx({value}, {shares(cuts)}, {100 * cuts}) AS _cuts"),
                                F.expr(f"least({cuts}, ceil(count(1) / {int(rows)})) AS _nb"))
    passed = f"size(filter(coalesce(_cuts, array()), c -> c < {value}))"
    return df.join(stats, on=list(by)).selectExpr(
        *[_q(c) for c in df.columns], f"CASE WHEN _nb = 1 THEN 0L ELSE {passed} * _nb div {cuts} END AS {_q(name)}")


def with_buckets(df: DataFrame, by: Sequence[str], order: str, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                 cuts: int = CUTS) -> DataFrame:
    """Add ``_tb``, a number that grows with ``order`` inside each ``by`` series
    and holds about ``bucket_rows`` rows a value, however the times are spread
    and however long the series is.

    One map-side combined aggregate per series gives its row count and the
    quantiles of its times; a series of n rows is cut at ceil(n / bucket_rows)
    of them, at most ``cuts`` in one pass.  One small job counts the rows of the
    longest series first: above ``cuts * bucket_rows`` the buckets are cut again
    at quantiles of their own times, in as many passes as the count asks.  Rows
    whose times fall in one second share a bucket.
    """
    by, value = list(by), _order_seconds(df, order)
    longest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    out = _cut(df, by, value, bucket_rows, cuts, "_tb")
    while longest > cuts * bucket_rows:
        longest = -(-longest // cuts)
        out = _cut(out, [*by, "_tb"], value, bucket_rows, cuts, "_finer").selectExpr(
            *[_q(c) for c in df.columns], f"_tb * {cuts} + _finer AS _tb")
    return out


def index_series(df: DataFrame, by: Sequence[str], order: str,
                 bucket_rows: int = DEFAULT_BUCKET_ROWS,
                 tie: Sequence[str] = (), idx: str = IDX) -> DataFrame:
    """Add ``idx``: the 0-based position of each row inside its ``by`` series
    (by ``order``, then ``tie``).

    Step 1 counts rows per (by, bucket) — a map-side-combined aggregate
    whose result has one row per bucket (see :func:`with_buckets`).  A window
    over that small table gives every bucket the number of rows before it.
    Step 2 joins the offsets back on (by, bucket) and numbers rows inside each
    bucket; the join's exchange is the one the window needs, so the rows are
    shuffled once.  No task sorts more than one bucket of one series.
    """
    by = list(by)
    keyed = with_buckets(df, by, order, bucket_rows)
    counts = keyed.groupBy(*by, "_tb").agg(F.expr("count(1) AS _n"))
    offsets = counts.selectExpr(
        *[_q(c) for c in by], "_tb",
        f"coalesce(sum(_n) {_over(by, '_tb', 'UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0) AS _off")
    rows = keyed.join(offsets, on=[*by, "_tb"], how="inner")
    order_sql = ", ".join(_q(c) for c in [order, *tie])
    keep = [_q(c) for c in df.columns]
    return rows.selectExpr(*keep, f"_off + row_number() {_over([*by, '_tb'], order_sql)} - 1 AS {_q(idx)}")


def halo_blocks(df: DataFrame, idx: str, block: int, halo: int,
                blk: str = BLK, is_halo: str = HALO) -> DataFrame:
    """Assign each row to block ``idx // block`` and copy it, flagged as halo,
    into every later block whose window frames can reach it (``halo`` rows
    back).  Rows are duplicated ``1 + halo / block`` times on average at most.
    """
    own = f"floor({_q(idx)} / {int(block)})"
    last = f"floor(({_q(idx)} + {int(halo)}) / {int(block)})"
    return (df.selectExpr("*", f"explode(sequence({own}, {last})) AS {_q(blk)}")
              .selectExpr("*", f"{_q(blk)} != {own} AS {_q(is_halo)}"))


def _block_for(span: float, block: int) -> int:
    """Largest block <= ``block`` for which r**-j stays far from overflow."""
    r = 1.0 - 2.0 / (span + 1.0)
    if r <= 0.0:
        return block
    return max(1, min(block, int(600.0 / -math.log(r))))


def ema(df: DataFrame, by: Sequence[str], idx: str, cols: dict[str, tuple[str, float]],
        block: int = DEFAULT_BLOCK_ROWS, carry_chunk: int = 4096,
        blk_col: str | None = None) -> DataFrame:
    """Recursive EMA per series: y0 = x0, yi = (1-a)*y(i-1) + a*xi, a = 2/(span+1).

    ``cols`` maps output name -> (input column, span).  ``df`` must carry the
    0-based series index ``idx`` (see :func:`index_series`); null inputs are
    not allowed (filter them first).

    Plan: rows are hash-partitioned on (by, block).  Inside a block, with
    local position j and r = 1 - a, the partial value is
    l_j = r**j * sum_{k<=j} w_k x_k r**-k (a running window sum), where
    w = 1 for the first row of the series and a otherwise.  Each block's last
    partial L_b feeds a carry c_b = sum_{m>=1} L_(b-m) * R**(m-1), R = r**block,
    computed over the small per-block table with a bounded frame (terms past
    the frame are below the smallest double).  Finally y = l_j + r**(j+1) c_b.

    If ``blk_col`` is given the caller guarantees ``blk_col == idx // block``
    (and that ``block`` is small enough, see :func:`ema_block`); rows already
    partitioned on (by, blk_col) are then not shuffled again.
    """
    by = list(by)
    spans = [s for _, s in cols.values()]
    blk_rows = ema_block(spans, block)
    if blk_col is None:
        out = df.withColumn(BLK, F.floor(F.col(idx) / F.lit(blk_rows)))
    else:
        if blk_rows != block:
            raise ValueError(f"block {block} too large for spans {spans}; use ema_block()")
        out = df.withColumnRenamed(blk_col, BLK) if blk_col != BLK else df
    j = F.col(idx) - F.col(BLK) * F.lit(blk_rows)
    w_in = Window.partitionBy(*by, BLK).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    base = out
    partial_cols, last = [], []
    for name, (src, span) in cols.items():
        a = 2.0 / (span + 1.0)
        r = 1.0 - a
        wt = F.when(F.col(idx) == 0, F.lit(1.0)).otherwise(F.lit(a))
        if r == 0.0:
            out = out.withColumn(f"_l_{name}", F.col(src).cast("double"))
            last.append(F.max_by(F.col(src).cast("double"), F.col(idx)).alias(f"_L_{name}"))
        else:
            scaled = wt * F.col(src) * F.pow(F.lit(r), -j)
            out = out.withColumn(f"_l_{name}", F.pow(F.lit(r), j) * F.sum(scaled).over(w_in))
            # the block's last partial value l_J = r**J * sum(scaled), as a
            # plain aggregate of the input rows: the block table does not
            # depend on the window pass, so that pass runs once
            last.append((F.pow(F.lit(r), F.max(j)) * F.sum(scaled)).alias(f"_L_{name}"))
        partial_cols.append(name)

    # one row per block: last partial value of each column
    blocks = base.groupBy(*by, BLK).agg(*last)

    rates = {name: 1.0 - 2.0 / (span + 1.0) for name, (_, span) in cols.items()}
    carry = _carry(blocks, by, rates, blk_rows, carry_chunk)

    res = out.join(carry, on=[*by, BLK], how="inner")
    for name, (src, span) in cols.items():
        r = 1.0 - 2.0 / (span + 1.0)
        jj = F.col(idx) - F.col(BLK) * F.lit(blk_rows)
        res = res.withColumn(name, F.col(f"_l_{name}") + F.pow(F.lit(r), jj + 1) * F.col(f"_c_{name}"))
    drop = [c for c in res.columns if c.startswith(("_l_", "_c_"))]
    res = res.drop(*drop)
    if blk_col is None:
        return res.drop(BLK)
    return res.withColumnRenamed(BLK, blk_col) if blk_col != BLK else res


def _carry(blocks: DataFrame, by: Sequence[str], rates: dict[str, float], blk_rows: int,
           carry_chunk: int = 4096, keep: Sequence[str] = ()) -> DataFrame:
    """Per block b, ``_c_<name>`` = sum_{m>=1} _L_<name>[b-m] * R**(m-1) with
    R = rate**blk_rows: the recursion's value at the end of block b-1.

    The sum runs over a bounded frame of earlier blocks (older terms are
    below the smallest double), and the block table is itself cut into
    chunks of ``carry_chunk`` blocks with a halo of that frame, so one long
    series is spread over many tasks.  Returns (by, BLK, keep, _c_*).
    """
    frames = {}
    for name, r in rates.items():
        if r == 0.0:
            frames[name] = (0.0, 1)
            continue
        R = r ** blk_rows
        k = 1 if R == 0.0 else int(math.ceil(1500.0 / (blk_rows * -math.log(r)))) + 1
        frames[name] = (R, k)
    kmax = max(k for _, k in frames.values())
    chunked = halo_blocks(blocks, BLK, carry_chunk, kmax, blk="_cb", is_halo="_ch")
    carry_exprs = [
        f"aggregate(collect_list(_L_{name}) {_over([*by, '_cb'], BLK, f'{k} PRECEDING AND 1 PRECEDING')}, "
        f"0.0D, (acc, v) -> acc * {_d(R)} + v) AS _c_{name}"
        for name, (R, k) in frames.items()]
    return (chunked.selectExpr(*[_q(c) for c in by], BLK, *[_q(c) for c in keep], "_ch", *carry_exprs)
                   .where("NOT _ch").drop("_ch"))


def macd_scan(df: DataFrame, by: Sequence[str], idx: str, src: str, fast: float, slow: float,
              signal: float, block: int = DEFAULT_BLOCK_ROWS, carry_chunk: int = 4096,
              blk_col: str | None = None, out: tuple[str, str] = ("macd", "macd_signal"),
              blocks_from: DataFrame | None = None) -> DataFrame:
    """MACD = EMA(fast) - EMA(slow) and its signal EMA(signal) in one pass.

    Same recursions and block scan as :func:`ema`, but the signal line's
    block sums are taken in closed form from sums of the raw input, so the
    block table never depends on a window pass: the rows are sorted and
    windowed once, the small block table gets both carries, and one join
    brings them back.

    With r_s = 1 - 2/(s+1), rho = r_s / r_g (g = the signal span), the
    fast/slow weights w (1 for the first row of the series, a_s after) and
    the signal weights v (likewise with a_g), over block rows k = 0..J:
      sum_k v_k r_g**-k l_k = a_g/(1-rho) * (sum_q w_q x_q r_g**-q
                              - rho**(J+1) * sum_q w_q x_q r_s**-q) [+ (1-a_g) x_0]
      sum_k v_k r_g**-k r_s**(k+1) = r_s * (a_g (1-rho**(J+1))/(1-rho) [+ (1-a_g)])
    where l_k is the in-block EMA partial and the bracketed terms apply to
    the block holding the first row of the series.

    ``blocks_from`` (same rows, same ``blk_col``, before any window the
    caller ran on ``df``) lets the block table skip those windows too.
    """
    by = list(by)
    B = ema_block([fast, slow, signal], block)
    rf, rs, rg = (1.0 - 2.0 / (s + 1.0) for s in (fast, slow, signal))
    if 0.0 in (rf, rs, rg) or rg in (rf, rs):
        raise ValueError("macd_scan needs spans > 1 and a signal span unlike the others")
    af, as_, ag = 1.0 - rf, 1.0 - rs, 1.0 - rg
    if blk_col is None:
        rows = df.selectExpr("*", f"floor({_q(idx)} / {B}) AS {BLK}")
        src_rows = rows if blocks_from is None else blocks_from.selectExpr(
            "*", f"floor({_q(idx)} / {B}) AS {BLK}")
    else:
        if B != block:
            raise ValueError(f"block {block} too large for the spans; use ema_block()")
        rows = df.withColumnRenamed(blk_col, BLK) if blk_col != BLK else df
        src_rows = rows if blocks_from is None else (
            blocks_from.withColumnRenamed(blk_col, BLK) if blk_col != BLK else blocks_from)
    i = _q(idx)
    j = f"({i} - {BLK} * {B})"
    x = f"CAST({_q(src)} AS DOUBLE)"

    def w(a):                      # input weight: 1 for the series' first row
        return f"(CASE WHEN {i} = 0 THEN 1.0D ELSE {_d(a)} END)"

    def pw(r, e):
        return f"pow({_d(r)}, {e})"

    keys = [_q(c) for c in by]
    # block table from the input rows alone
    blocks = src_rows.groupBy(*by, BLK).agg(
        F.expr(f"max({j}) AS _J"),
        F.expr(f"sum({w(af)} * {x} * {pw(rf, '-' + j)}) AS _Af"),
        F.expr(f"sum({w(as_)} * {x} * {pw(rs, '-' + j)}) AS _As"),
        F.expr(f"sum({w(af)} * {x} * {pw(rg, '-' + j)}) AS _Bf"),
        F.expr(f"sum({w(as_)} * {x} * {pw(rg, '-' + j)}) AS _Bs"),
        F.expr(f"max(CASE WHEN {i} = 0 THEN {x} END) AS _x0"))
    blocks = blocks.selectExpr(*keys, BLK, "_J", "_Af", "_As", "_Bf", "_Bs", "_x0",
                               f"{pw(rf, '_J')} * _Af AS _L_f", f"{pw(rs, '_J')} * _As AS _L_s")
    c1 = _carry(blocks, by, {"f": rf, "s": rs}, B, carry_chunk,
                keep=["_J", "_Af", "_As", "_Bf", "_Bs", "_x0"])
    first_blk = f"(CASE WHEN _x0 IS NOT NULL THEN {_d(1.0 - ag)} ELSE 0.0D END)"

    def t_term(r, a_col, b_col):
        rho = r / rg
        return (f"({_d(ag / (1.0 - rho))} * ({b_col} - {pw(rho, '_J + 1')} * {a_col})"
                f" + (CASE WHEN _x0 IS NOT NULL THEN {_d(1.0 - ag)} * _x0 ELSE 0.0D END))")

    def g_term(r):
        rho = r / rg
        return f"({_d(r)} * ({_d(ag / (1.0 - rho))} * (1.0D - {pw(rho, '_J + 1')}) + {first_blk}))"

    lam = (f"{pw(rg, '_J')} * ({t_term(rf, '_Af', '_Bf')} - {t_term(rs, '_As', '_Bs')}"
           f" + _c_f * {g_term(rf)} - _c_s * {g_term(rs)}) AS _L_g")
    c2 = _carry(c1.selectExpr(*keys, BLK, "_c_f", "_c_s", lam), by, {"g": rg}, B,
                carry_chunk, keep=["_c_f", "_c_s"])

    # rows: in-block partials, carries joined once, then the signal's partial
    run = _over([*by, BLK], i, "UNBOUNDED PRECEDING AND CURRENT ROW")
    res = (rows.selectExpr("*", f"{pw(rf, j)} * sum({w(af)} * {x} * {pw(rf, '-' + j)}) {run} AS _lf",
                           f"{pw(rs, j)} * sum({w(as_)} * {x} * {pw(rs, '-' + j)}) {run} AS _ls")
               .join(c2, on=[*by, BLK], how="inner"))
    macd = f"((_lf + {pw(rf, j + ' + 1')} * _c_f) - (_ls + {pw(rs, j + ' + 1')} * _c_s))"
    res = res.selectExpr("*", f"{macd} AS {_q(out[0])}")
    res = res.selectExpr(
        *[_q(c) for c in res.columns if c not in ("_lf", "_ls", "_c_f", "_c_s", "_c_g")],
        f"{pw(rg, j)} * sum({w(ag)} * {_q(out[0])} * {pw(rg, '-' + j)}) {run}"
        f" + {pw(rg, j + ' + 1')} * _c_g AS {_q(out[1])}")
    if blk_col is None:
        return res.drop(BLK)
    return res.withColumnRenamed(BLK, blk_col) if blk_col != BLK else res


def ema_block(spans: Sequence[float], block: int = DEFAULT_BLOCK_ROWS) -> int:
    """Block length usable by :func:`ema` for all ``spans``."""
    return min(_block_for(s, block) for s in spans)


# ------------------------------------------------------------ series with gaps

def gap_rate(span: float) -> float:
    """Least decay of an old value a row, in natural log: after an observation
    ``g`` rows on, the old value keeps A(g) = r**g / (r**g + a) of its weight."""
    r = 1.0 - 2.0 / (span + 1.0)
    if r <= 0.0:
        return 600.0
    g = range(1, 4096)
    return min(-(k * math.log(r) - math.log(r ** k + 1.0 - r)) / k for k in g)


def _last_before(blocks: DataFrame, by: Sequence[str], cols: dict[str, str], chunk: int) -> DataFrame:
    """Add ``cols`` (new name -> column): the last non-null value of the column
    in the earlier blocks of the series.  The block table is searched inside
    chunks of ``chunk`` blocks, and one row a chunk carries over."""
    by = list(by)
    rows = blocks.withColumn("_ck", F.floor(F.col(BLK) / F.lit(chunk)))
    ends = rows.groupBy(*by, "_ck").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(BLK))).alias(f"_e_{n}") for n, c in cols.items()])
    before = Window.partitionBy(*by).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_ck", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in cols])
    inside = Window.partitionBy(*by, "_ck").orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_i_{n}") for n, c in cols.items()])
    out = rows.join(ends, [*by, "_ck"])
    return out.select(*blocks.columns, *[F.coalesce(f"_i_{n}", f"_p_{n}").alias(n) for n in cols])


def ema_gaps(df: DataFrame, by: Sequence[str], idx: str, src: str, spans: dict[str, float],
             block: int = DEFAULT_BLOCK_ROWS, carry_chunk: int = 4096, first: str | None = None) -> DataFrame:
    """EMAs of ``src`` where it may be null: at a null row the last value stands,
    and the weight of the old value keeps decaying by position.

    With g rows since the last observation, y = A y' + (1 - A) x and
    A = r**g / (r**g + a), r = 1 - a, a = 2 / (span + 1); the first observation
    seeds the series, and earlier rows are null.  ``spans`` maps output name to
    span; ``first`` names a column for the index of the first observation.

    Plan: each step is an affine map of the value before it.  Inside a block of
    rows the maps after the block's first observation are composed by running
    sums (of ln A, and of the inputs over the composed weight).  One row a
    block holds the whole block's map; since a block's rows bound the sum of
    its gaps, no weight underflows.  Over the small block table the maps are
    applied in a bounded frame (older values have decayed below the smallest
    double), and blocks without an observation take the last value before.
    """
    by = list(by)
    B = ema_block(list(spans.values()), block)
    x, i = F.col(src).cast("double"), F.col(idx)
    seen = x.isNotNull()
    rates = {n: (1.0 - 2.0 / (s + 1.0), 2.0 / (s + 1.0)) for n, s in spans.items()}

    def old(n: str, g: Column) -> Column:
        r, a = rates[n]
        p = F.pow(F.lit(r), g)
        return p / (p + F.lit(a))

    w = Window.partitionBy(*by, BLK).orderBy(idx)
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(BLK, F.floor(i / F.lit(B)))
    rows = rows.withColumn("_g", F.when(seen, i - F.last(F.when(seen, i), ignorenulls=True).over(past)))
    rows = rows.select("*", F.first(x, ignorenulls=True).over(upto).alias("_x1"),
                       *[F.coalesce(F.sum(F.log(old(n, F.col("_g")))).over(upto), F.lit(0.0)).alias(f"_s_{n}") for n in spans])
    rows = rows.select("*", *[F.when(F.col("_g").isNotNull(), (F.lit(1.0) - old(n, F.col("_g"))) * x * F.exp(-F.col(f"_s_{n}"))).alias(f"_q_{n}")
                              for n in spans])

    blocks = rows.groupBy(*by, BLK).agg(
        F.min(F.when(seen, i)).alias("_f"), F.max(F.when(seen, i)).alias("_l"),
        F.min_by(x, F.when(seen, i)).alias("_bx"),
        *[F.coalesce(F.sum(F.log(old(n, F.col("_g")))), F.lit(0.0)).alias(f"_S_{n}") for n in spans],
        *[F.coalesce(F.sum(f"_q_{n}"), F.lit(0.0)).alias(f"_Q_{n}") for n in spans])
    blocks = _last_before(blocks, by, {"_pl": "_l"}, carry_chunk)
    # the block's first step: 0 where nothing was seen before it
    blocks = blocks.select("*", *[F.when(F.col("_pl").isNull(), F.lit(0.0)).otherwise(old(n, F.col("_f") - F.col("_pl"))).alias(f"_A_{n}") for n in spans])
    some = blocks.where("_f IS NOT NULL").select(
        *by, BLK, *[F.struct((F.exp(f"_S_{n}") * F.col(f"_A_{n}")).alias("m"),
                             (F.exp(f"_S_{n}") * ((F.lit(1.0) - F.col(f"_A_{n}")) * F.col("_bx") + F.col(f"_Q_{n}"))).alias("l")).alias(f"_m_{n}") for n in spans])
    frame = max(int(math.ceil(1500.0 / (B * gap_rate(s)))) + 1 for s in spans.values())
    chunked = halo_blocks(some, BLK, carry_chunk, frame, blk="_cb", is_halo="_ch")
    ends = chunked.selectExpr(*[_q(c) for c in by], BLK, "_ch", *[
        f"aggregate(collect_list(_m_{n}) {_over([*by, '_cb'], BLK, f'{frame} PRECEDING AND CURRENT ROW')}, 0.0D, (acc, v) -> acc * v.m + v.l) AS _y_{n}"
        for n in spans]).where("NOT _ch").drop("_ch")
    table = blocks.select(*by, BLK, "_f", *[f"_A_{n}" for n in spans]).join(ends, [*by, BLK], "left")
    table = _last_before(table, by, {f"_c_{n}": f"_y_{n}" for n in spans}, carry_chunk)
    if first:
        table = table.join(blocks.groupBy(*by).agg(F.min("_f").alias(first)), by)
    table = table.select(*by, BLK, *[f"_A_{n}" for n in spans], *[f"_c_{n}" for n in spans], *([first] if first else []))

    out = rows.join(table, [*by, BLK])
    for n in spans:
        c, a1 = F.col(f"_c_{n}"), F.col(f"_A_{n}")
        inside = F.exp(f"_s_{n}") * (a1 * F.coalesce(c, F.lit(0.0)) + (F.lit(1.0) - a1) * F.col("_x1")
                                     + F.coalesce(F.sum(f"_q_{n}").over(upto), F.lit(0.0)))
        out = out.withColumn(n, F.when(F.col("_x1").isNull(), c).otherwise(inside))
    return out.select(*df.columns, *spans, *([first] if first else []))
