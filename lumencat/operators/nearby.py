"""Radius and nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumencat.functions import geo
from lumencat.operators.ordered import rank_rows
from lumencat.sources.storage import materialize

# Cells of the nearest-neighbour tree: edge of the root cells in degrees, and the finest level. Every
# level quarters the edge; 45 times a power of two keeps cell borders exact in floating point.
ROOT_EDGE, FINEST = 360.0, 20
# Cells with more points than this are split.
CROWD = 512
# Levels counted in one pass over the points.
LEVELS_PER_PASS = 3


def nearby(assets: DataFrame, latitude: float, longitude: float, radius: float = 1000) -> DataFrame:
    """assets within ``radius`` metres (inclusive) of one point with their ``rank`` from 1, nearest first.

    The box conditions reach the scan; the exact distance is computed for what is left. Distances
    that agree to the millimetre tie, by id.
    """
    lon, lat = F.col("lon"), F.col("lat")
    near = (
        assets.where(geo.within_box(lon, lat, longitude, latitude, radius))
        .withColumn("distance", geo.haversine(lon, lat, F.lit(longitude), F.lit(latitude)))
        .where(F.col("distance") <= radius)
    )
    return rank_rows(near, [F.round("distance", 3), "id"], "rank").orderBy("rank")


def _with_vector(places: DataFrame, prefix: str = "") -> DataFrame:
    """``places`` with the cosine of their latitude and their place on a sphere of radius 1."""
    lon, lat = F.col(f"{prefix}lon"), F.col(f"{prefix}lat")
    vector = zip("xyz", geo.unit_vector(lon, lat))
    return places.select("*", F.cos(F.radians(lat)).alias(f"{prefix}flat"), *[v.alias(f"{prefix}u{a}") for a, v in vector])


def _with_touching_cells(rows: DataFrame) -> DataFrame:
    """``rows`` once for their cell (x, y, z) and once for each of its 26 neighbours.

    By unpivots, whose size is planned as that of all copies: of an explode, Spark plans the size of
    one, and broadcasts what is 27 times as large.
    """
    columns = rows.columns
    for axis in "xyz":
        others = [c for c in columns if c != axis]
        steps = [(F.col(axis) + n).alias(f"{axis}{n}") for n in (-1, 0, 1)]
        rows = rows.select(*others, *steps).unpivot(others, [f"`{axis}{n}`" for n in (-1, 0, 1)], "step", axis).select(*columns)
    return rows


def nearby_join(assets: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """F5 for many centres (centre_id, lon, lat): (centre_id, id, distance).

    Equi-join on the cells of a grid on the sphere, then the straight line between the two, and the
    exact distance of what that leaves; a crowded cell is split at run time on whichever side it is
    crowded. Places that are not on earth match nothing.
    """
    located = assets.select("id", "lon", "lat").where(geo.on_earth(F.col("lon"), F.col("lat")))
    centres = centres.where(geo.on_earth(F.col("lon"), F.col("lat")))
    points = _with_vector(located).select("*", geo.sphere_cell(F.col("lon"), F.col("lat"), radius).alias("cell")).select(
        "id", "lon", "lat", "flat", "ux", "uy", "uz", "cell.*"
    )
    asked = _with_vector(centres.select("centre_id", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat")), "c_")
    around = _with_touching_cells(asked.select("*", geo.sphere_cell(F.col("c_lon"), F.col("c_lat"), radius).alias("cell")).select(
        *asked.columns, "cell.*")
    ).where(geo.may_hold_near([F.col(a) for a in "xyz"], [F.col(f"c_u{a}") for a in "xyz"], radius))
    chord = sum(((F.col(f"u{a}") - F.col(f"c_u{a}")) * (F.col(f"u{a}") - F.col(f"c_u{a}")) for a in "xyz"), F.lit(0.0))
    # The slack covers rounding: nearer than that is within the radius, farther is not.
    limit, slack = geo.squared_chord(radius), 1e-12
    distance = geo.haversine(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"), F.col("flat"), F.col("c_flat"))
    return (
        points.join(around, ["x", "y", "z"])
        .where((chord <= limit + slack) & ((chord < limit - slack) | (distance <= radius)))
        .select("centre_id", "id", distance.alias("distance"))
    )


def knn(assets: DataFrame, longitude: float, latitude: float, k: int = 5, metric: str = "planar") -> DataFrame:
    """the ``k`` nearest assets to one point; assets without a location on earth come last."""
    measure = {"planar": geo.planar, "haversine": geo.haversine}[metric]
    lon, lat = F.col("lon"), F.col("lat")
    distance = F.when(geo.on_earth(lon, lat), measure(lon, lat, F.lit(longitude), F.lit(latitude)))
    return (
        assets.select("id", "file_name", distance.alias("distance"))
        .orderBy(F.asc_nulls_last("distance"), "id")
        .limit(k)
    )


def _edge(level: Column) -> Column:
    return F.lit(ROOT_EDGE) / F.pow(F.lit(4.0), level)


def _on_levels(points: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Every point once per level, with its cell there."""
    def cell(axis: str, level: int) -> Column:
        return F.floor(F.col(axis) / F.lit(ROOT_EDGE / 4**level)).cast("long")

    cells = F.array(*[
        F.struct(F.lit(n).alias("level"), cell("lon", n).alias("cx"), cell("lat", n).alias("cy")) for n in levels
    ])
    return points.select("*", F.inline(cells))


def _tree(points: DataFrame, crowd: int) -> tuple[DataFrame, int]:
    """(cells (level, cx, cy, held, split), deepest level): only crowded cells are split further.

    Points outside crowded cells leave after the pass that finds them there, so the depth that a
    crowd needs is paid for by the crowd alone.
    """
    counted: list[DataFrame] = []
    inside = points.select("lon", "lat")
    for first in range(0, FINEST + 1, LEVELS_PER_PASS):
        last = min(first + LEVELS_PER_PASS - 1, FINEST)
        cells = materialize(
            _on_levels(inside, range(first, last + 1)).groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("held")),
            "knn-cells",
        )
        counted.append(cells)
        crowded = cells.where((F.col("level") == last) & (F.col("held") > crowd)).select("cx", "cy")
        if last == FINEST or crowded.isEmpty():
            break
        inside = _on_levels(inside, [last]).join(crowded, ["cx", "cy"], "left_semi").select("lon", "lat")
    split = (F.col("held") > crowd) & (F.col("level") < last)
    return reduce(DataFrame.unionByName, counted).withColumn("split", split), last


def _closing_in(cells: DataFrame, k: int) -> DataFrame:
    """Cells (per place) that may hold one of the place's ``k`` nearest, with the ``bound`` used.

    Sorted by their far corners, the cells that together hold k points bound the k-th distance; a
    cell whose near side lies beyond the bound holds no answer.
    """
    edge = _edge(F.col("level"))

    def sides(centre: str, index: str) -> tuple[Column, Column]:
        low = F.col(index) * edge
        below, above = low - F.col(centre), F.col(centre) - (low + edge)
        return F.greatest(below, above, F.lit(0.0)), F.greatest(-below, -above)

    (near_x, far_x), (near_y, far_y) = sides("c_lon", "cx"), sides("c_lat", "cy")
    place = Window.partitionBy("c_lon", "c_lat")
    reached = F.sum("held").over(place.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The slack covers rounding of coordinates at cell borders.
    bound = F.min(F.when(F.col("reached") >= k, F.col("far"))).over(place) * (1 + 1e-9) + 1e-11
    return (
        cells.withColumn("near", F.sqrt(near_x * near_x + near_y * near_y))
        .withColumn("far", F.sqrt(far_x * far_x + far_y * far_y))
        .withColumn("reached", reached)
        .withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))
        .where(F.col("near") <= F.col("bound"))
        .select("c_lon", "c_lat", "level", "cx", "cy", "held", "split", "bound")
    )


def knn_join(assets: DataFrame, centres: DataFrame, k: int = 5, crowd: int = CROWD) -> DataFrame:
    """F6 for many centres (centre_id, lon, lat): (centre_id, rank, id, distance), planar, exact.

    A tree of cell counts is walked from the root for every distinct place asked about, a level per
    round: cells that cannot hold an answer are dropped, crowded ones give way to their children.
    What remains are a few cells of at most ``crowd`` points each, and only their points are
    compared. Points at one place are cut to their k lowest ids first, which no answer can exceed.
    """
    located = assets.select("id", "lon", "lat").where(geo.on_earth(F.col("lon"), F.col("lat")))
    same_place = Window.partitionBy("lon", "lat").orderBy("id")
    points = materialize(
        located.withColumn("__n", F.row_number().over(same_place)).where(F.col("__n") <= k).drop("__n"), "knn-points"
    )
    tree, deepest = _tree(points, max(crowd, k))

    # Root cells: four for longitudes and latitudes in range.
    roots = [tuple(r) for r in tree.where("level = 0").select("cx", "cy", "held", "split").collect()]
    centres = centres.where(geo.on_earth(F.col("lon"), F.col("lat")))
    places = centres.select(F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat")).distinct()
    root_cells = F.array(*[
        F.struct(
            F.lit(0).alias("level"), F.lit(cx).cast("long").alias("cx"), F.lit(cy).cast("long").alias("cy"),
            F.lit(held).cast("long").alias("held"), F.lit(split).alias("split"),
        )
        for cx, cy, held, split in roots
    ]) if roots else F.lit(None).cast("array<struct<level:int,cx:bigint,cy:bigint,held:bigint,split:boolean>>")
    walked = materialize(_closing_in(places.select("*", F.inline(root_cells)), k), "knn-walk")
    children = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)])
    for _ in range(deepest):
        opened = walked.where("split")
        if opened.isEmpty():
            break
        asked = opened.select("c_lon", "c_lat", "level", "cx", "cy", F.inline(children)).select(
            "c_lon", "c_lat", (F.col("level") + 1).alias("level"),
            (F.col("cx") * 4 + F.col("i")).alias("cx"), (F.col("cy") * 4 + F.col("j")).alias("cy"),
        )
        finer = asked.join(tree, ["level", "cx", "cy"])
        frontier = walked.where("NOT split").drop("bound").unionByName(finer)
        walked = materialize(_closing_in(frontier, k), "knn-walk")

    # At most one value per level of the tree.
    used = sorted(r.level for r in walked.select("level").distinct().collect())
    laid = _on_levels(points, used or [0])
    distance = geo.planar(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"))
    nearest = Window.partitionBy("c_lon", "c_lat").orderBy("distance", "id")
    answers = materialize(
        laid.join(walked.select("c_lon", "c_lat", "level", "cx", "cy", "bound"), ["level", "cx", "cy"])
        .select("c_lon", "c_lat", "id", distance.alias("distance"), "bound")
        .where(F.col("distance") <= F.col("bound"))
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("c_lon", "c_lat", "rank", "id", "distance"),
        "knn-answers",
    )
    asked = centres.select("centre_id", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    return asked.join(answers, ["c_lon", "c_lat"]).select("centre_id", "rank", "id", "distance")
