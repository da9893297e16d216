"""Small literal inputs shared by the tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

SENSOR = "id string, ts long, vc int"
ROWS_A = [
    ("sensor_1", 1607527992000, 20),
    ("sensor_1", 1607527994000, 50),
    ("sensor_1", 1607527996000, 30),
    ("sensor_2", 1607527993000, 10),
    ("sensor_2", 1607527995000, 30),
]
ROWS_B = [(i, t, 50 if t == 1607527996000 else v) for i, t, v in ROWS_A]

EVENT = "key string, ts timestamp_ntz, seq long, level int"


def skewed(n: int = 400, keys: int = 6, seed: int = 5) -> list[tuple]:
    """Rows of which half belong to one key and some to the null key, with ties in time."""
    dice = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for seq in range(n):
        key = "hot" if dice.random() < 0.5 else dice.choice([None, *[f"k{i}" for i in range(keys)]])
        rows.append((key, start + timedelta(minutes=seq // 3 * 7), seq, dice.choice([None, *range(0, 60, 3)])))
    dice.shuffle(rows)
    return rows


def collected(df, *order):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
