"""A small catalog with known answers, plus rows for the edges it lacks."""

from __future__ import annotations

import datetime as dt
import json
from types import SimpleNamespace

from pyspark.sql import SparkSession

from lumencat import schemas

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

# The catalog whose query results are known.
ASSETS = [
    (1, "image", "sunset1.jpg", "/images/sunset1.jpg", 2048000, -122.4194, 37.7749),
    (2, "image", "mountain1.png", "/images/mountain1.png", 3072000, -106.8175, 39.1911),
    (3, "video", "interview1.mp4", "/videos/interview1.mp4", 15360000, -74.0060, 40.7128),
    (4, "image", "beach1.jpg", "/images/beach1.jpg", 1536000, -80.1918, 25.7617),
    (5, "video", "tutorial1.mp4", "/videos/tutorial1.mp4", 20480000, -0.1276, 51.5074),
]
DIMENSIONS = [(1, 1920, 1080), (2, 2560, 1440), (3, 1280, 720), (4, 1600, 900), (5, 1920, 1080)]
TAGS = ["nature", "interview", "tutorial", "landscape", "beach", "mountain", "sunset"]
LINKS = [(1, 1), (1, 4), (1, 7), (2, 1), (2, 4), (2, 6), (3, 2), (4, 1), (4, 4), (4, 5), (5, 3)]

# An asset with nothing attached, wildcards in its name and no place.
BARE = (6, "image", "100%_done.txt", "/x", 1, None, None)


def catalog(spark: SparkSession, *extra: tuple) -> SimpleNamespace:
    rows = [(*a[:5], T0, T0, *a[5:]) for a in (*ASSETS, *extra)]
    metadata = [(i, json.dumps({"iso": i * 100, "lens": {"zoom": i}, "owner": None})) for i in range(1, 6)]
    return SimpleNamespace(
        assets=spark.createDataFrame(rows, schemas.ASSETS),
        dimensions=spark.createDataFrame(DIMENSIONS, schemas.ASSET_DIMENSIONS),
        tags=spark.createDataFrame(list(enumerate(TAGS, 1)), schemas.TAGS),
        links=spark.createDataFrame(LINKS, schemas.ASSET_TAGS),
        metadata=spark.createDataFrame(metadata, schemas.ASSET_METADATA),
    )


def rows(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
