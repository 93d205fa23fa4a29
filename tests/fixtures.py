"""Hand-made payload documents and rows."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

from isobar.schema import DAILY_VARIABLES, HOURLY, HOURLY_VARIABLES, TEXT_VARIABLES
from isobar.sources import payload
from isobar.sources.cities import cities
from isobar.sources.landing import scan_landing

RUN_TS = datetime(2026, 2, 8, 2, 0, 0)


def document(day: str, days: int = 1, **changes) -> dict:
    """A complete response for ``days`` days from ``day``."""
    first = datetime.fromisoformat(day)
    hours = [first + timedelta(hours=h) for h in range(24 * days)]
    dates = [first + timedelta(days=d) for d in range(days)]
    hourly = {"time": [t.strftime("%Y-%m-%dT%H:%M") for t in hours]}
    hourly |= {v: [float(i % 24) for i in range(len(hours))] for v in HOURLY_VARIABLES}
    hourly["weather_code"] = [3] * len(hours)
    daily = {"time": [d.strftime("%Y-%m-%d") for d in dates]}
    for name in DAILY_VARIABLES:
        value = f"{day}T08:00" if name in TEXT_VARIABLES else 1.5
        daily[name] = [value] * days
    whole = {
        "latitude": 52.37,
        "longitude": 4.9,
        "elevation": 7.0,
        "generationtime_ms": 0.5,
        "utc_offset_seconds": 3600,
        "timezone": "Europe/Amsterdam",
        "timezone_abbreviation": "CET",
        "hourly_units": {"temperature_2m": "C"},
        "hourly": hourly,
        "daily": daily,
    }
    for key, value in changes.items():
        if value is None:
            del whole[key]
        else:
            whole[key] = value
    return whole


def land(root, city: str, day: str, content, name: str = "a", last: str | None = None) -> None:
    """Put one document (or raw text) at its place in the landing folder."""
    folder = f"{root}/city_id={city}/start_date={day}/end_date={last or day}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as file:
        file.write(content if isinstance(content, str) else json.dumps(content))


def judged(spark, root, form: str = "lines"):
    docs = scan_landing(spark, str(root), form)
    return payload.judge(payload.stamped(payload.enrich(docs, cities(spark)), RUN_TS))


def hourly(spark, rows: list[dict]):
    """Hourly rows in the canonical schema; what a row does not name is NULL."""
    defaults = {
        "city_name": "Paris",
        "latitude": 48.9,
        "longitude": 2.4,
        "timezone": "Europe/Paris",
        "ingestion_timestamp": datetime(2026, 2, 8),
        "batch_id": "20260208_000000",
    }
    filled = [{**defaults, **row} for row in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in HOURLY.names) for r in filled], HOURLY)
