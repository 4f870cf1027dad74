"""Node labels, lookups and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EARTH_RADIUS, clean_station, haversine, minutes_since, week_of
from .storage import staged


def dense_labels(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """labels(key, node): keys numbered from 0 by first appearance in the given order.

    Keys are sorted by range over partitions; each is numbered inside its partition, from the
    number of keys in the partitions before, so no task sees them all."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    first = staged(first.repartitionByRange("first").withColumn("part", F.spark_partition_id()))
    sizes = first.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    no = F.row_number().over(Window.partitionBy("part").orderBy("first", key)) - 1
    return first.join(F.broadcast(before), "part").select(key, (no + F.col("before")).cast("long").alias("node"))


def known_only(events: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """Events whose both ends are among nodes."""
    for end in ("src", "dst"):
        events = events.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    return events


def merge_places(stations: DataFrame) -> DataFrame:
    """Adds place: the first name (by code point) of the stations with the same coordinates."""
    return stations.withColumn("place", F.min("name").over(Window.partitionBy("latitude", "longitude")))


def distances(stations: DataFrame) -> DataFrame:
    """Distance of each pair of stations, once for a pair. The station list is the one table that is paired whole: it is bounded by the network's hardware."""
    a, b = (stations.select(*(F.col(c).alias(f"{c}_{i}") for c in ("name", "latitude", "longitude"))) for i in (1, 2))
    pairs = a.join(F.broadcast(b), F.col("name_1") < F.col("name_2"))
    return pairs.select("name_1", "name_2", haversine(*(F.col(c) for c in ("latitude_1", "longitude_1", "latitude_2", "longitude_2"))).alias("km"))


#: Cells of the finest level have an edge of 2 ** -FINEST of the earth's radius, less than a metre; those of level 0 one of 2, which covers the sphere.
FINEST = 24

#: Rows of a task of nearest_stations(), asks (27 a station) and stations in cubes: with more rows come more tasks, not larger ones.
TASK_ROWS = 200_000


def _tasks(rows: int) -> int:
    return rows // TASK_ROWS + 1


def nearest_stations(stations: DataFrame, k: int) -> DataFrame:
    """near(name, rank, other, km): the k nearest other stations of each, ties by name; exact, on the whole sphere, without pairing all with all.

    Stations are points on the unit sphere in three dimensions, so that poles and the date line are nothing special, in cubes of edge 2, 1, 1/2 ... A station begins at
    the finest level at which more than k share its cube, and looks into the 27 cubes around: they hold all within an edge's length. If its k-th
    lies within that, it is done; else it goes on at the next coarser level. Cubes are counted at all levels by one aggregate. Of stations at the very same
    place only the k + 1 first names are looked at by others, as these are all that anyone's k nearest can hold. Tasks are cut by the rows counted, before rows are
    multiplied, so that a task's memory doesn't grow with the table, nor with a small file that holds it all. Names are unique."""
    lat, lon = F.radians("latitude"), F.radians("longitude")
    points = stations.select("name", "latitude", "longitude", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    points = staged(points)
    n = points.count()
    points = points.repartition(_tasks(n * (FINEST + 1)), "name")
    same = Window.partitionBy("latitude", "longitude").orderBy("name")
    seen = staged(points.withColumn("no", F.row_number().over(same)).where(F.col("no") <= k + 1).drop("no"))
    cube = ["level", "i", "j", "l"]
    edge = F.pow(F.lit(2.0), 1 - F.col("level"))
    in_cubes = lambda rows: rows.select("*", *(F.floor((F.col(c) + 1) / edge).cast("long").alias(n) for c, n in zip("xyz", cube[1:], strict=True)))
    every = in_cubes(points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(FINEST)))))
    full = staged(every.groupBy(*cube).agg(F.count("*").alias("n")).where(F.col("n") > k).select(cube))
    first = every.join(full, cube).groupBy("name").agg(F.max("level").alias("level"))
    open_ = staged(points.join(first, "name", "left").withColumn("level", F.coalesce("level", F.lit(0))))
    done = None
    while True:
        levels = dict(open_.groupBy("level").count().collect())  # at most FINEST + 1
        if not levels:
            break
        tasks = _tasks(27 * sum(levels.values()) + n * len(levels))
        data = in_cubes(seen.repartition(tasks, "name").withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))))))
        data = data.select(*cube, *(F.col(c).alias(f"other_{c}") for c in ("name", "latitude", "longitude")))
        asks = in_cubes(open_.repartition(tasks, "name"))
        for c in cube[1:]:
            asks = asks.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        near = asks.repartition(tasks, *cube).join(data.repartition(tasks, *cube), cube).where("name <> other_name").repartition(tasks, "name").withColumn("km", haversine(*(F.col(c) for c in ("latitude", "longitude", "other_latitude", "other_longitude"))))
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("km", "other_name"))).where(F.col("rank") <= k).select("name", "level", "rank", "other_name", "km")
        best = staged(best)
        chord = 2 * F.sin(F.max("km") / (2 * EARTH_RADIUS))
        enough = best.groupBy("name").agg(F.max("rank").alias("n"), chord.alias("far"), F.max("level").alias("level"))
        enough = staged(enough.where((F.col("level") == 0) | ((F.col("n") == k) & (F.col("far") <= edge * (1 - 1e-9)))).select("name"))
        found = best.join(enough, "name").select("name", "rank", F.col("other_name").alias("other"), "km")
        done = found if done is None else done.unionByName(found)
        open_ = staged(open_.where("level > 0").join(enough, "name", "left_anti").withColumn("level", F.col("level") - 1))
    return done if done is not None else points.select("name", F.lit(0).alias("rank"), F.col("name").alias("other"), F.lit(0.0).alias("km")).limit(0)


def trip_network(trips: DataFrame, stations: DataFrame, epoch: str, seed: int = 1234567) -> tuple[DataFrame, DataFrame]:
    """(edge_events, node_map) of trips: cleaned names, trips between known stations, dense nodes
    by first start (stations that only end trips follow), time the middle of the week of arrival."""
    named = trips.select(clean_station(F.col("start")).alias("src"), clean_station(F.col("end")).alias("dst"), minutes_since(F.col("started"), epoch, seed).alias("from"), minutes_since(F.col("ended"), epoch, seed + 1).alias("to"))
    places = merge_places(stations)
    for end in ("src", "dst"):
        named = named.join(places.select(F.col("name").alias(end), F.col("place").alias(f"{end}_place")), end)
    named = staged(named.select(F.col("src_place").alias("src"), F.col("dst_place").alias("dst"), "from", "to"))
    both = named.select(F.col("src").alias("place"), F.lit(0).alias("late"), "from").union(named.select("dst", F.lit(1), "from"))
    labels = dense_labels(both, "place", ["late", "from", "place"])
    for end in ("src", "dst"):
        named = named.join(labels.select(F.col("place").alias(end), F.col("node").alias(f"{end}_node")), end)
    events = named.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), week_of(F.col("to")).alias("t"))
    return events, labels.join(places.where("name = place").select("place", "latitude", "longitude"), "place")
