"""Stateful streaming indicators.

Each symbol's state is a typed value of ``operators.indicator_state.STATE``: the
bar count, the last bar time, the three EMA values and the last 20 closes, about
25 numbers whatever the length of the series, in the RocksDB state store.  Each
new bar yields one indicator row.  Bars at or before the symbol's last bar are
dropped (the same late-data rule as the batch high-water mark): a stream cannot
revise values it has already emitted, while the batch path would fold a late bar
into the later values.

On ordered input the output equals the batch indicator table (W12); started from
a stored state it equals the rest of that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketpulse.operators.indicator_state import KEEP, STATE
from marketpulse.operators.indicators import BB_K, BB_N, INDICATOR_COLUMNS, MACD_FAST, MACD_SIGNAL, MACD_SLOW, RSI_N

OUTPUT_SCHEMA = ("symbol string, Date timestamp_ntz, rsi_14 double, macd double, "
                 "macd_signal double, bb_upper double, bb_middle double, bb_lower double")
STATE_SCHEMA = "n long, last_ts timestamp_ntz, e_fast double, e_slow double, e_sig double, closes array<double>"
#: What a session needs for the stream's state.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _advance(rows: pd.DataFrame, st: dict, keep: int) -> list[tuple]:
    """Fold ordered bars into the state, returning one output row per bar."""
    a_f, a_s, a_g = (2.0 / (MACD_FAST + 1), 2.0 / (MACD_SLOW + 1), 2.0 / (MACD_SIGNAL + 1))
    out = []
    closes = list(st["closes"])
    for ts, x in zip(rows["Date"], rows["Close"]):
        if st["n"] == 0:
            ef = es = x
            sig = 0.0
        else:
            ef = st["e_fast"] * (1 - a_f) + x * a_f
            es = st["e_slow"] * (1 - a_s) + x * a_s
            sig = st["e_sig"] * (1 - a_g) + (ef - es) * a_g
        closes = (closes + [x])[-keep:]
        n = st["n"] + 1
        rsi = None
        if n >= RSI_N:
            c = np.asarray(closes[-(RSI_N + 1):], dtype=float)
            d = np.diff(c)
            if len(d) < RSI_N:           # the series' first delta counts as 0
                d = np.concatenate([np.zeros(RSI_N - len(d)), d])
            g, l = np.where(d > 0, d, 0.0).mean(), np.where(d < 0, -d, 0.0).mean()
            rsi = (100.0 if g > 0 else None) if l == 0 else 100.0 - 100.0 / (1.0 + g / l)
        up = mid = low = None
        if n >= BB_N:
            w = np.asarray(closes[-BB_N:], dtype=float)
            mid = float(w.mean())
            sd = float(w.std(ddof=1))
            up, low = mid + BB_K * sd, mid - BB_K * sd
        out.append((ts, rsi, ef - es, sig, up, mid, low))
        st.update(n=n, last_ts=ts, e_fast=ef, e_slow=es, e_sig=sig)
    st["closes"] = closes
    return out


class SeriesProcessor(StatefulProcessor):
    """One symbol's indicator state and the rows that its new bars give."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._put(dict(n=int(r["n"]), last_ts=r["last_ts"], closes=list(r["closes"]),
                       **{c: float(r[c]) for c in ("e_fast", "e_slow", "e_sig")}))

    def _put(self, st: dict) -> None:
        self.state.update((st["n"], pd.Timestamp(st["last_ts"]).to_pydatetime(), st["e_fast"], st["e_slow"], st["e_sig"],
                           [float(x) for x in st["closes"]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            n, last_ts, ef, es, eg, closes = self.state.get()
            st = dict(n=n, last_ts=last_ts, e_fast=ef, e_slow=es, e_sig=eg, closes=list(closes))
        else:
            st = dict(n=0, last_ts=None, e_fast=0.0, e_slow=0.0, e_sig=0.0, closes=[])
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["Close"].notna()].sort_values("Date", kind="stable")
        if st["last_ts"] is not None:
            batch = batch[batch["Date"] > pd.Timestamp(st["last_ts"])]
        made = _advance(batch.drop_duplicates("Date", keep="first"), st, KEEP)
        if made:
            self._put(st)
            out = pd.DataFrame(made, columns=["Date", *INDICATOR_COLUMNS])
            out.insert(0, "symbol", key[0])
            yield out

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, by: str = "symbol", ts: str = "Date", close: str = "Close",
                      state: DataFrame | None = None) -> DataFrame:
    """Streaming indicator rows from a stream of bars (append mode).

    ``state`` (``indicator_state.STATE``, one row a symbol): the stream goes on
    from there, as after a batch load; it is read when the query first starts.
    The session needs ``STATE_STORE`` (``session.get_session`` sets it).
    A task holds one symbol's bars of one micro-batch, to put them in order;
    read the stream with ``ingest.file_stream``, whose ``max_files`` bounds it
    (a backlog then comes in many micro-batches)."""
    sel = bars.select(bars[by].alias("symbol"), bars[ts].cast("timestamp_ntz").alias("Date"),
                      bars[close].cast("double").alias("Close"))
    start = None if state is None else state.select(*[f.name for f in STATE.fields]).groupBy("symbol")
    return sel.groupBy("symbol").transformWithStateInPandas(SeriesProcessor(), OUTPUT_SCHEMA, "Append", "None", start)
