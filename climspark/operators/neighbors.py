"""k nearest stations and the daily correlation with them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climspark.functions.calendar import prepare_dates
from climspark.functions.metrics import is_number
from climspark.operators.stations import station_positions
from climspark.schema import Columns
from climspark.sources.staging import stage

# Distances that agree to this many digits (radians) are ties, broken by the smaller id.
TIE_DIGITS = 12
SLACK = 1e-9
# Places of one part of the plane, which one task searches, and the most parts; sampled places a part.
PLACES_PER_PART = 20_000
MAX_PARTS = 1 << 14
SAMPLED_PER_PART = 64
# Stations of a cell within a part are about so many times k; distances that are held at once.
CELL_OF_K = 4
HELD_DISTANCES = 4_000_000
# Sub-groups in which the smallest ids of one place are found first.
SHARES = 32

NEIGHBOR_SCHEMA = "station long, neighbor long, rank int, distance double"
_FOUND = "x double, y double, reach double, found array<struct<distance: double, neighbor: long>>"


def build_station_kneighbors(
    data: DataFrame,
    *,
    columns: Columns = Columns(),
    k: int = 100,
    targets: DataFrame | Iterable[int] | None = None,
    places_per_part: int = PLACES_PER_PART,
) -> DataFrame:
    """``(station, neighbor, rank, distance)``: the k stations nearest to each one, itself excluded.

    Distance is Euclidean between median (latitude, longitude) in radians. Neighbours are sought for the stations in
    ``targets`` (ids, or a table with a column ``station``; all by default).

    The plane is cut at sampled medians into parts of about ``places_per_part`` places, each searched by one task over
    cells of a few k stations. Only places whose k-th distance reaches into other parts go there, too, and their finds
    are merged. No pairs of all stations are built, whatever the size.
    """
    positions = station_positions(data, columns, with_altitude=False).select(
        F.col(columns.id).cast("long").alias("station"),
        F.radians(columns.lat).alias("x"),
        F.radians(columns.lon).alias("y"),
    )
    positions = stage(positions.filter(is_number(F.col("x")) & is_number(F.col("y"))), "positions")
    asked = None
    if targets is not None:
        if not isinstance(targets, DataFrame):
            targets = data.sparkSession.createDataFrame([(int(t),) for t in targets], "station long")
        asked = positions.join(targets.select(F.col("station").cast("long")).distinct(), "station", "left_semi")
    return _nearest(positions, asked, k, places_per_part)


def _places(positions: DataFrame, asked: DataFrame | None, k: int) -> DataFrame:
    """(x, y, ids, asked): distinct places, each with its k + 1 smallest ids.

    Ties go to the smaller id, so no other id can be anyone's neighbour. The ids of a place that holds very many are
    cut down in sub-groups first.
    """
    share = F.pmod(F.xxhash64("station"), F.lit(SHARES))
    for keys in (["x", "y", share], ["x", "y"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("station"))
        positions = positions.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).drop("_nth")
    places = positions.groupBy("x", "y").agg(F.sort_array(F.collect_list("station")).alias("ids"))
    if asked is None:
        return places.withColumn("asked", F.lit(True))
    wanted = asked.select("x", "y").distinct().withColumn("asked", F.lit(True))
    return places.join(wanted, ["x", "y"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def _nearest(positions: DataFrame, asked: DataFrame | None, k: int, places_per_part: int) -> DataFrame:
    """Neighbours of the stations ``asked`` (all, if None) among ``positions``."""
    places = stage(_places(positions, asked, k), "places")
    n = places.count()
    if not n:
        return positions.sparkSession.createDataFrame([], NEIGHBOR_SCHEMA)
    parts = min(MAX_PARTS, 1 << (max(1, -(-n // places_per_part)) - 1).bit_length())
    cuts = plane_cuts(_sampled(places, n, parts), parts)
    if parts > 1:
        places = stage(_with_part(places, cuts), "parts")
    else:
        places = places.withColumn("part", F.lit(0))
    found = places.groupBy("part").applyInArrow(_search(k), "part int, " + _FOUND)
    if parts > 1:
        found = _across(places, stage(found, "found"), k)
    stations = positions if asked is None else asked
    others = F.slice(F.filter("found", lambda p: p["neighbor"] != F.col("station")), 1, k)
    listed = stations.join(found, ["x", "y"]).select("station", F.posexplode(others).alias("at", "p"))
    return listed.select("station", "p.neighbor", (F.col("at") + 1).alias("rank"), "p.distance")


# --- parts of the plane


def _sampled(places: DataFrame, n: int, parts: int) -> np.ndarray:
    """Some places of every region, drawn by a hash: at most about ``SAMPLED_PER_PART`` for each part."""
    if parts == 1:
        return np.zeros((0, 2))
    wanted = parts * SAMPLED_PER_PART
    drawn = F.pmod(F.xxhash64("x", "y"), F.lit(n)) < wanted
    rows = places.filter(drawn).select("x", "y").limit(2 * wanted).toPandas()
    return rows.to_numpy(float).reshape(-1, 2)


def plane_cuts(sample: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A balanced tree of cuts, level by level: for each node the axis and the place of its cut, at the median of the
    sampled points along the wider axis."""
    cuts, groups = [], [sample]
    while len(groups) < parts:
        axes, at, halves = [], [], []
        for group in groups:
            axis = int(np.argmax(np.ptp(group, axis=0))) if len(group) else 0
            cut = float(np.median(group[:, axis])) if len(group) else 0.0
            low = group[:, axis] <= cut if len(group) else np.zeros(0, bool)
            axes.append(axis)
            at.append(cut)
            halves += [group[low], group[~low]]
        cuts.append((np.array(axes), np.array(at)))
        groups = halves
    return cuts


def part_of(points: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for axes, at in cuts:
        value = points[np.arange(len(points)), axes[node]]
        node = 2 * node + (value > at[node])
    return node


def _points(table) -> np.ndarray:
    return np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()])


def _with_part(places: DataFrame, cuts: list) -> DataFrame:
    schema = T.StructType([*places.schema.fields, T.StructField("part", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(part_of(_points(batch), cuts).astype("i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=schema.names)

    return places.mapInArrow(run, schema)


# --- search within a part


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the points in cells of at most ``size``, cut at medians along the wider axis."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            if len(rows):
                out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        rows = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def _boxes(points: np.ndarray, cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([points[c].min(axis=0) for c in cells]), np.array([points[c].max(axis=0) for c in cells])


def _near_far(low, high, lows, highs) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance between points of a box and of each of other boxes."""
    apart = np.maximum(0, np.maximum(lows - high, low - highs))
    across = np.maximum(np.abs(highs - low), np.abs(high - lows))
    return np.sqrt((apart**2).sum(axis=1)), np.sqrt((across**2).sum(axis=1))


def nearest_ids(
    points: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, k: int, reach: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k + 1 nearest ids, by distance, then id: (distances, ids); fewer if there are no more.

    Queries are taken a cell at a time. Boxes of the points' cells tell how far k + 1 ids lie at most (``reach`` may
    tell better), so only cells within that distance are compared.
    """
    out: list = [None] * len(queries)
    cells = _leaves(points, max(CELL_OF_K * k, 8))
    lows, highs = _boxes(points, cells)
    held = np.array([sum(len(ids[i]) for i in c) for c in cells])
    todo = _leaves(queries, max(CELL_OF_K * k, 8))
    while todo:
        rows = todo.pop()
        low, high = queries[rows].min(axis=0), queries[rows].max(axis=0)
        near, far = _near_far(low, high, lows, highs)
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(held[order]), k + 1)
        limit = far[order[enough]] if enough < len(order) else np.inf
        if reach is not None:
            limit = min(limit, reach[rows].max())
        close = np.flatnonzero(near <= limit + SLACK)
        if len(rows) > 1 and held[close].sum() * len(rows) > HELD_DISTANCES:
            half = _leaves(queries[rows], -(-len(rows) // 2))
            if len(half) > 1:
                todo += [rows[h] for h in half]
                continue
        if not len(close):
            for i in rows:
                out[i] = (np.zeros(0), np.zeros(0, np.int64))
            continue
        at = np.concatenate([cells[c] for c in close])
        flat = np.concatenate([ids[i] for i in at])
        owner = np.repeat(at, [len(ids[i]) for i in at])
        # Columns stand in the order of ids, and the sort is stable: ties keep it.
        by_id = np.argsort(flat, kind="stable")
        flat, owner = flat[by_id], owner[by_id]
        difference = queries[rows][:, None, :] - points[owner][None, :, :]
        distance = np.round(np.sqrt((difference**2).sum(axis=2)), TIE_DIGITS)
        best = np.argsort(distance, axis=1, kind="stable")[:, : k + 1]
        for r, i in enumerate(rows):
            out[i] = (distance[r, best[r]], flat[best[r]])
    return out


def _ids(table: pa.Table) -> list[np.ndarray]:
    column = table.column("ids").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy())
    return np.split(flat, ends[:-1])


def _finds(points: np.ndarray, finds: list, k: int) -> list[pa.Array]:
    sizes = np.array([len(d) for d, _ in finds], np.int64)
    flat = [np.concatenate([f[side] for f in finds] or [np.zeros(0)]) for side in (0, 1)]
    structs = pa.StructArray.from_arrays([pa.array(flat[0], pa.float64()), pa.array(flat[1], pa.int64())], ["distance", "neighbor"])
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), structs)
    reach = [d[k] if len(d) > k else np.inf for d, _ in finds]
    return [pa.array(points[:, 0]), pa.array(points[:, 1]), pa.array(reach, pa.float64()), listed]


_NAMES = ["part", "x", "y", "reach", "found"]


def _search(k: int):
    """For the asked places of a part the k + 1 nearest ids in it; reach is the last one's distance."""

    def run(table: pa.Table) -> pa.Table:
        points, wanted = _points(table), table.column("asked").to_numpy().astype(bool)
        queries = points[wanted]
        finds = nearest_ids(points, _ids(table), queries, k) if len(queries) else []
        part = pa.array(np.full(len(queries), table.column("part")[0].as_py(), "i4"))
        return pa.Table.from_arrays([part, *_finds(queries, finds, k)], names=_NAMES)

    return run


# --- search across parts


def _across(places: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``found`` with what lies in the other parts that a place's reach touches."""
    boxes = places.groupBy("part").agg(
        F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.sum(F.size("ids"))
    ).collect()  # one row a part
    part = np.array([r[0] for r in boxes])
    lows, highs = np.array([r[1:3] for r in boxes], float), np.array([r[3:5] for r in boxes], float)
    held = np.array([r[5] for r in boxes])

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for home, (x, y), reach in zip(batch.column(0).to_pylist(), _points(batch), batch.column(3).to_pylist()):
                point = np.array([x, y])
                near, far = _near_far(point, point, lows, highs)
                if np.isinf(reach):
                    order = np.argsort(far)
                    enough = np.searchsorted(np.cumsum(held[order]), k + 1)
                    reach = far[order[enough]] if enough < len(order) else np.inf
                out += [(int(p), x, y, reach) for p in part[near <= reach + SLACK] if p != home]
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=_NAMES[:4])

    def visit(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        if not guests.num_rows or not hosts.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int32()), *_finds(np.zeros((0, 2)), [], k)], names=_NAMES)
        queries, reach = _points(guests), guests.column("reach").to_numpy()
        finds = nearest_ids(_points(hosts), _ids(hosts), queries, k, reach)
        part_ = pa.array(np.full(len(queries), hosts.column("part")[0].as_py(), "i4"))
        return pa.Table.from_arrays([part_, *_finds(queries, finds, k)], names=_NAMES)

    guests = found.mapInArrow(visits, "part int, x double, y double, reach double")
    more = guests.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(visit, "part int, " + _FOUND)
    merged = found.unionByName(more).groupBy("x", "y").agg(F.flatten(F.collect_list("found")).alias("found"))
    return merged.select("x", "y", F.slice(F.array_sort("found"), 1, k + 1).alias("found"))


def neighbor_frame(data: DataFrame, neighbors: DataFrame | Mapping[int, Iterable[int]]) -> DataFrame:
    """A neighbour map in table form; a Python mapping is accepted as is."""
    if isinstance(neighbors, DataFrame):
        return neighbors
    rows = [(int(s), int(n), i + 1) for s, ns in neighbors.items() for i, n in enumerate(ns)]
    return data.sparkSession.createDataFrame(rows, "station long, neighbor long, rank int")


# --- correlation


def _year_blocks(daily: DataFrame, date: str) -> DataFrame:
    """(station, year, at, v): a year of a station in one row, moments of the year (microseconds) in order and the
    values there. A year bounds each group."""
    seconds = F.dayofyear(date) * 86_400 + F.hour(date) * 3_600 + F.minute(date) * 60
    at = seconds.cast("long") * 1_000_000 + (F.expr(f"extract(SECOND FROM `{date}`)") * 1_000_000).cast("long")
    rows = daily.select("station", F.year(date).alias("year"), F.struct(at.alias("at"), "a").alias("p"))
    blocks = rows.groupBy("station", "year").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return blocks.select("station", "year", F.col("p.at").alias("at"), F.col("p.a").alias("v"))


_MOMENTS = "n long, sa double, sb double, saa double, sbb double, sab double, least_a double, most_a double, least_b double, most_b double"


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of year blocks the sums over their common moments, of values less each station's mean.

    Columns: low, high, then mean, at and v of the one, then of the other.
    """
    for batch in batches:
        sides = []
        for first in (2, 5):
            mean, at, v = (batch.column(first + k) for k in range(3))
            sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            # Keys ascend: rows first, then moments of the year, which need 45 bits.
            key = (row << 45) + at.flatten().to_numpy(zero_copy_only=False)
            sides.append((key, v.flatten().to_numpy(zero_copy_only=False), row, mean.to_numpy(zero_copy_only=False)))
        (key_a, a, row_a, mean_a), (key_b, b, _, mean_b) = sides
        place = np.minimum(np.searchsorted(key_b, key_a), max(0, len(key_b) - 1))
        common = key_b[place] == key_a if len(key_b) else np.zeros(len(key_a), bool)
        row, a, b = row_a[common], a[common], b[place[common]] if len(key_b) else b
        x, y = a - mean_a[row], b - mean_b[row]
        n = np.bincount(row, minlength=batch.num_rows)
        sums = [np.bincount(row, weights=w, minlength=batch.num_rows) for w in (x, y, x * x, y * y, x * y)]
        some = np.flatnonzero(n)
        begins = np.searchsorted(row, some)
        ends = [f.reduceat(w, begins) if len(some) else np.zeros(0) for w in (a, b) for f in (np.minimum, np.maximum)]
        chosen = pa.array(some)
        arrays = [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(n[some].astype("i8"))]
        arrays += [pa.array(s[some]) for s in sums] + [pa.array(e) for e in ends]
        names = ["low", "high", "n", "sa", "sb", "saa", "sbb", "sab", "least_a", "most_a", "least_b", "most_b"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def neighbor_correlations(
    data: DataFrame,
    neighbors: DataFrame | Mapping[int, Iterable[int]],
    *,
    columns: Columns = Columns(),
    start=None,
    end=None,
    min_overlap: int = 60,
) -> DataFrame:
    """``(station, neighbor, corr, n_overlap)`` for every pair of the neighbour map, in one job.

    Duplicate days are averaged first. Days become a row a station and year, so pairs are joined a year at a time, and
    the common days of two years are found in arrays. ``corr`` is NULL below ``min_overlap`` common days or when a side
    is constant; a neighbour without data gets (NULL, 0); a station without data has no rows.
    """
    pairs = neighbor_frame(data, neighbors).select(
        F.col("station").cast("long"), F.col("neighbor").cast("long")
    ).distinct()
    value = F.col(columns.target).cast("double")
    wanted = pairs.select(F.explode(F.array("station", "neighbor")).alias("_wanted")).distinct()
    rows = data.select(columns.id, columns.date, columns.target)
    rows = rows.join(wanted, F.col(columns.id).cast("long") == F.col("_wanted"), "left_semi")
    daily = (
        prepare_dates(rows, columns.date, start, end)
        .filter(is_number(value))
        .groupBy(F.col(columns.id).cast("long").alias("station"), F.col(columns.date))
        .agg(F.avg(value).alias("a"))
    )
    blocks = stage(_year_blocks(daily, columns.date), "years")
    total, held = (F.aggregate(x, F.lit(0.0), lambda s, v: s + v) for x in ("v", F.transform("v", lambda _: F.lit(1.0))))
    means = blocks.groupBy("station").agg((F.sum(total) / F.sum(held)).alias("mean"))
    means = stage(means, "means")
    pairs = pairs.join(means.select("station"), "station", "left_semi")
    # The correlation is symmetric: two stations that are each other's neighbours are joined once.
    low, high = F.least("station", "neighbor").alias("low"), F.greatest("station", "neighbor").alias("high")
    once = pairs.select(low, high).distinct()
    for side in ("low", "high"):
        once = once.join(means.select(F.col("station").alias(side), F.col("mean").alias(f"{side}_mean")), side)
    lows = blocks.select(F.col("station").alias("low"), "year", F.col("at").alias("low_at"), F.col("v").alias("low_v"))
    highs = blocks.select(F.col("station").alias("high"), "year", F.col("at").alias("high_at"), F.col("v").alias("high_v"))
    met = once.join(lows, "low").join(highs, ["high", "year"])
    met = met.select("low", "high", "low_mean", "low_at", "low_v", "high_mean", "high_at", "high_v")
    sums = met.mapInArrow(_moments, f"low long, high long, {_MOMENTS}").groupBy("low", "high").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")],
        ((F.min("least_a") == F.max("most_a")) | (F.min("least_b") == F.max("most_b"))).alias("flat"),
    )
    n = F.col("n")
    cov = F.col("sab") / n - F.col("sa") / n * (F.col("sb") / n)
    spread = F.sqrt(F.col("saa") / n - (F.col("sa") / n) ** 2) * F.sqrt(F.col("sbb") / n - (F.col("sb") / n) ** 2)
    usable = (n >= min_overlap) & ~F.col("flat")
    return pairs.select("station", "neighbor", low, high).join(sums, ["low", "high"], "left").select(
        "station",
        "neighbor",
        F.when(usable, F.try_divide(cov, spread)).alias("corr"),
        F.coalesce("n", F.lit(0)).alias("n_overlap"),
    )


def neighbor_correlation_table(
    data: DataFrame,
    station_id: int,
    *,
    neighbor_ids: Iterable[int],
    columns: Columns = Columns(),
    start=None,
    end=None,
    min_overlap: int = 60,
) -> DataFrame:
    """``(neighbor, corr, n_overlap)`` of one station, best correlation first, undefined last."""
    wanted = [int(n) for n in neighbor_ids]
    local = data.filter(F.col(columns.id).isin([int(station_id), *wanted]))
    table = neighbor_correlations(
        local, {int(station_id): wanted}, columns=columns, start=start, end=end, min_overlap=min_overlap
    )
    return table.drop("station").orderBy(F.col("corr").desc_nulls_last(), "neighbor")
