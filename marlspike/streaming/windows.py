"""Sliding windows per wallet as a stream: state that follows the trades, whatever batches and order they come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlspike.functions.benford import leading_digit

#: Trailing windows in minutes.
WINDOWS = {"1h": 60, "4h": 240, "24h": 1440, "7d": 10_080, "30d": 43_200}
_LONGEST = max(WINDOWS.values())
_LAW = np.log10(1 + 1 / np.arange(1, 10))
#: Per minute: trades, volume in units of 1e-7, trades with oneself, then the nine leading digits.
_WIDTH = 12


def wallet_windows(stream: DataFrame) -> DataFrame:
    """(wallet, seen, newest_minute, and per window n, volume, self_share, mad): a row per wallet and batch that has trades of it.

    ``stream``: wallet, ts, amount, same. A window holds the whole minutes after
    newest - width up to the newest, the newest minute of the wallet's trades so
    far. State is a wallet's minutes of the last 30 days with their sums, at most
    43,200 whatever the number of trades; late trades enter their minute, those
    older than 30 days only count as seen. Sums are of integers, so batches in
    any cut and order, and a restart in between, give the same last row.
    """
    rows = stream.select(
        "wallet", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long").alias("minute"), F.round(F.col("amount") * 1e7).cast("long").alias("units"),
        F.col("same").cast("long").alias("same"), F.coalesce(leading_digit(F.col("amount")), F.lit(0)).cast("long").alias("digit"),
    )
    out = "wallet string, seen long, newest_minute long, " + ", ".join(f"n_{w} long, volume_{w} double, self_{w} double, mad_{w} double" for w in WINDOWS)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, minutes, cells = state.get if state.exists else (0, [], [])
        minute, cell = np.array(minutes, np.int64), np.array(cells, np.int64).reshape(-1, _WIDTH)
        for f in frames:
            add = np.zeros((len(f), _WIDTH), np.int64)
            add[:, 0], add[:, 1], add[:, 2] = 1, f["units"], f["same"]
            digit = f["digit"].to_numpy()
            has = digit > 0
            add[np.flatnonzero(has), 2 + digit[has]] = 1
            seen += len(f)
            minute, at = np.unique(np.concatenate([minute, f["minute"].to_numpy()]), return_inverse=True)
            both = np.zeros((len(minute), _WIDTH), np.int64)
            np.add.at(both, at, np.concatenate([cell, add]))
            live = minute > minute[-1] - _LONGEST
            minute, cell = minute[live], both[live]
        state.update((int(seen), minute.tolist(), cell.ravel().tolist()))
        row = [key[0], seen, int(minute[-1])]
        for width in WINDOWS.values():
            s = cell[minute > minute[-1] - width].sum(axis=0)
            digits = s[3:]
            mad = float(np.abs(digits / digits.sum() - _LAW).mean()) if digits.sum() else 0.0
            row += [int(s[0]), s[1] / 1e7, s[2] / s[0], round(mad, 9)]
        yield pd.DataFrame([row], columns=[c.split()[0] for c in out.split(", ")])

    return rows.groupBy("wallet").applyInPandasWithState(step, out, "seen bigint, minutes array<bigint>, cells array<bigint>", "append", GroupStateTimeout.NoTimeout)


def last_per_wallet(rows: DataFrame) -> DataFrame:
    """The newest state of each wallet out of what ``wallet_windows`` emitted."""
    names = [c for c in rows.columns if c != "wallet"]
    return rows.groupBy("wallet").agg(F.max_by(F.struct(*names), "seen").alias("x")).select("wallet", "x.*")
