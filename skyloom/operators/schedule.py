"""Observing queues: greedy choices that depend on the one before, a night to a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "night long, sequence int, source_id string, ra double, dec double, t_slew double, t_exp double, gain double, elapsed double"


def _separation(ra1: float, dec1: float, ra2: np.ndarray, dec2: np.ndarray) -> np.ndarray:
    d1, d2, dr = np.radians(dec1), np.radians(dec2), np.radians(ra2 - ra1)
    h = np.clip(np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin(dr / 2) ** 2, 0, 1)
    return np.degrees(2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)))


def greedy_queue(candidates: DataFrame, budget: float = 60.0, start: tuple[float, float] = (0.0, 0.0), base_minutes: float = 5.0) -> DataFrame:
    """Schedules each night's candidates (night, source_id, ra, dec, phot_g, gain, vacuity) one after another.

    The next target has the largest (gain + vacuity / 2) per minute of slew and
    exposure among those that fit; of equals the first by source_id. A night ends when
    nothing fits or two minutes are left. Nights are independent and run in parallel.
    """

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_id", kind="stable").reset_index(drop=True)
        expose = np.clip(base_minutes * 10 ** (0.4 * (rows["phot_g"].fillna(19.5).to_numpy() - 19.0)), 2.0, 45.0)
        reward = rows["gain"].fillna(0.5).to_numpy() + 0.5 * rows["vacuity"].fillna(0.5).to_numpy()
        ra, dec = rows["ra"].to_numpy(), rows["dec"].to_numpy()
        free = np.isfinite(ra) & np.isfinite(dec)
        at, left, out = start, budget, []
        while left > 2.0 and free.any():
            slew = 0.5 + 0.03 * _separation(at[0], at[1], ra, dec)
            cost = slew + expose
            worth = np.where(free & (cost <= left), reward / cost, -1.0)
            k = int(np.argmax(worth))
            if worth[k] < 0:
                break
            free[k] = False
            left -= cost[k]
            at = (ra[k], dec[k])
            out.append((rows["night"][k], len(out) + 1, rows["source_id"][k], ra[k], dec[k], round(slew[k], 2), round(expose[k], 2), rows["gain"].fillna(0.5)[k], round(budget - left, 2)))
        return pd.DataFrame(out, columns=["night", "sequence", "source_id", "ra", "dec", "t_slew", "t_exp", "gain", "elapsed"])

    return candidates.groupBy("night").applyInPandas(plan, SCHEMA)
