"""Inputs that several tests share."""

from __future__ import annotations

from datetime import datetime

from tidelog.plans.engine import open_source
from tidelog.sources.profiles import Registry

ZONE = "Europe/Paris"
IN = " " * 23
NOW = datetime.fromisoformat("2026-08-01T12:00:00+00:00")
QUERY_LOG = """2027-03-05 08:00:00.000 [V] [Home] [Kitchen] -> kettle on
2027-03-05 08:20:00.000 [D] [Mail] [PostSort] -> letter sorted
2027-03-05 08:40:00.000 [I] [Mail] [PostSort] -> letter posted
2027-03-05 09:00:00.000 [W] [Mail] [PostVan] -> parcel late delay=45
2027-03-05 09:20:00.000 [E] [Home] [Kitchen] -> lamp broken
2027-03-05 09:40:00.000 [E] [FAULT] -> note without a place
2027-03-05 10:00:00.000 [I] [Door] [Porch] -> door opened
"""


def opened(spark, folder, files: dict[str, str], **how):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    registry = how.pop("registry", None) or Registry.bundled(ZONE, NOW)
    return open_source(spark, [str(folder / n) for n in files] if how.pop("each", False) else [str(folder)], registry, ZONE, NOW, **how)


def messages(df, order="entry_id"):
    return [r["message"] for r in df.orderBy(order).select("message").collect()]
