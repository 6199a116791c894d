"""The same results as the registered queries, in plain SQL for DuckDB.

Written independently of the operators: joins where they use arithmetic, row
numbers where they rank in two levels, exploded edges where they fold arrays.
"""

from __future__ import annotations

import math

from curbflow.functions import projection
from curbflow.functions.projection import LONG_ISLAND_ZONE, NEW_JERSEY_ZONE
from curbflow.functions.raster import Raster
from curbflow.operators.raster import KERNEL_UNIT, FineGrid, kernel_weights
from curbflow.operators.spatial import TOUCH_SLACK
from curbflow.plans import registry, standins
from curbflow.plans.standins import COARSE, GRID

PARTS = {
    "year": "year({})",
    "month": "month({})",
    "day": "day({})",
    "weekday": "dayofweek({}) + 1",
    "hour": "hour({})",
    "min": "minute({})",
    "quarter_hour": "minute({}) // 15",
}
SLOT_KEYS = "year, month, day, weekday, hour, quarter_hour"
MEASURES = ("trips_out", "trips_in", "net_trips_in")
WEATHER = ("temperature", "precipitation", "windspeed")


def d(value: float) -> str:
    """A double literal."""
    return f"{value!r}::DOUBLE"


def part(name: str, ts: str) -> str:
    return f"CAST({PARTS[name].format(ts)} AS INTEGER)"


def mean(x: str) -> str:
    total = f"sum(CAST(floor({x} * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))::DOUBLE"
    return f"{total} / count({x})::DOUBLE / 1000000.0::DOUBLE"


def means(columns) -> str:
    return ", ".join(f"{mean(c)} AS {c}" for c in columns)


def sums(columns) -> str:
    return ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in columns)


def cell(raster: Raster, lon: str, lat: str) -> str:
    gap = f"{lon} - {d(raster.lon_min)}" if raster.left_to_right else f"{d(raster.lon_max)} - {lon}"
    column = f"least(CAST(floor(({gap}) / {d(raster.lon_width)}) AS BIGINT), {raster.n - 1})"
    row = f"least(CAST(floor(({d(raster.lat_max)} - {lat}) / {d(raster.lat_width)}) AS BIGINT), {raster.n - 1})"
    return (
        f"CASE WHEN {lon} BETWEEN {d(raster.lon_min)} AND {d(raster.lon_max)} "
        f"AND {lat} BETWEEN {d(raster.lat_min)} AND {d(raster.lat_max)} "
        f"THEN {row} * {raster.n} + {column} + 1 END"
    )


def center(raster: Raster, cell_id: str) -> tuple[str, str]:
    """Centre of a left-to-right cell."""
    lon = f"({d(raster.lon_min)} + (({cell_id} - 1) % {raster.n} + 0.5::DOUBLE) * {d(raster.lon_width)})"
    lat = f"({d(raster.lat_max)} - (({cell_id} - 1) // {raster.n} + 0.5::DOUBLE) * {d(raster.lat_width)})"
    return lon, lat


def _spread(start: float, width: float, a: int, b: int, prime: int) -> str:
    return (
        f"{d(start)} + ((event_id * {a} + user_id * {b}) % {prime}) * {d(width)} / {d(float(prime))}"
    )


def _crossed(e: str, lon: str, lat: str) -> str:
    return (
        f"{e}.y1 <= {lat} AND {lat} < {e}.y2 AND "
        f"({lon} - {e}.x1) * ({e}.y2 - {e}.y1) < ({e}.x2 - {e}.x1) * ({lat} - {e}.y1)"
    )


HX, HY = GRID.lon_width / 2 + TOUCH_SLACK, GRID.lat_width / 2 + TOUCH_SLACK
SIDE = standins.LATTICE_SIDE
CX, CY = center(GRID, "cell_id")

# Named subqueries; each lists the ones it needs.
PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "base": (
        (),
        f"""SELECT event_id AS trip_id, value, date_trunc('second', ts) AS pickup_datetime,
            (event_id * 131) % 5400 - 60 AS seconds, 1 + event_id % 6 AS passenger_count,
            ((event_id * 17) % 1000) / 100.0::DOUBLE AS trip_distance,
            {_spread(-74.30, 0.70, 7919, 104729, 10007)} AS pickup_longitude,
            {_spread(40.45, 0.50, 6101, 15485863, 10009)} AS pickup_latitude,
            {_spread(-74.30, 0.70, 3571, 7001, 9973)} AS dropoff_longitude,
            {_spread(40.45, 0.50, 4409, 9001, 9967)} AS dropoff_latitude
            FROM events""",
    ),
    "priced": (
        ("base",),
        """SELECT *, pickup_datetime + to_seconds(seconds) AS dropoff_datetime,
            CASE WHEN trip_id % 50 = 0 THEN 0.01::DOUBLE
                 ELSE 2.5::DOUBLE + 2.0::DOUBLE * trip_distance + value / 20.0::DOUBLE END AS fare_amount,
            seconds::DOUBLE / 3600.0::DOUBLE AS trip_time FROM base""",
    ),
    "trips": (
        ("priced",),
        """SELECT *, fare_amount / nullif(trip_time, 0.0::DOUBLE) AS fare_rev_per_hour,
            fare_amount / nullif(trip_distance, 0.0::DOUBLE) AS fare_per_mile FROM priced""",
    ),
    "flagged": (
        ("trips",),
        """SELECT *, coalesce(trip_distance < 100 AND fare_per_mile > 1 AND fare_per_mile < 20
              AND pickup_longitude > -75 AND pickup_longitude < -72
              AND pickup_latitude > 40 AND pickup_latitude < 41.5, false)
            AND coalesce(trip_time > 1.0::DOUBLE / 60.0::DOUBLE AND fare_rev_per_hour < 1000, true) AS clean
            FROM trips""",
    ),
    "clean": (("flagged",), "SELECT * FROM flagged WHERE clean"),
    "usual": (
        ("clean",),
        """SELECT * FROM clean WHERE trip_time > 1.0::DOUBLE / 60.0::DOUBLE
            AND fare_rev_per_hour > 29 AND fare_rev_per_hour < 201""",
    ),
    "fine": (
        ("clean",),
        f"""SELECT *, coalesce({cell(GRID, 'pickup_longitude', 'pickup_latitude')}, 0) AS pickup_region,
            coalesce({cell(GRID, 'dropoff_longitude', 'dropoff_latitude')}, 0) AS dropoff_region FROM clean""",
    ),
    "coarse": (
        ("clean",),
        f"""SELECT *, coalesce({cell(COARSE, 'pickup_longitude', 'pickup_latitude')}, 0) AS pickup_region,
            coalesce({cell(COARSE, 'dropoff_longitude', 'dropoff_latitude')}, 0) AS dropoff_region FROM clean""",
    ),
    "used": (
        ("fine",),
        """SELECT pickup_region AS cell_id, count(*) AS pickups FROM fine
            WHERE pickup_region <> 0 GROUP BY ALL""",
    ),
    # tract outlines
    "corners": (
        (),
        f"""SELECT t AS region_id, k,
            -74.25::DOUBLE + a * 0.0675::DOUBLE + ((a * 7 + b * 3) % 5) * 0.004::DOUBLE AS lon,
            40.50::DOUBLE + b * 0.05::DOUBLE + ((a * 5 + b * 2) % 7) * 0.003::DOUBLE AS lat
            FROM (SELECT t, k, (t - 1) // {SIDE} + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS a,
                         (t - 1) % {SIDE} + CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END AS b
                  FROM (SELECT CAST(unnest(range(1, {standins.N_TRACTS + 1})) AS INTEGER) AS t) q
                  CROSS JOIN (VALUES (0), (1), (2), (3)) AS ks(k)) c""",
    ),
    "sides": (
        ("corners",),
        """SELECT p.region_id, p.lon AS ax, p.lat AS ay, q.lon AS bx, q.lat AS b_y,
            p.lat < q.lat OR (p.lat = q.lat AND p.lon <= q.lon) AS up
            FROM corners p JOIN corners q ON p.region_id = q.region_id AND q.k = (p.k + 1) % 4""",
    ),
    "edges": (
        ("sides",),
        """SELECT region_id, CASE WHEN up THEN ax ELSE bx END AS x1, CASE WHEN up THEN ay ELSE b_y END AS y1,
            CASE WHEN up THEN bx ELSE ax END AS x2, CASE WHEN up THEN b_y ELSE ay END AS y2 FROM sides""",
    ),
    "cells": (
        (),
        f"""SELECT cell_id, {CX} AS cx, {CY} AS cy
            FROM (SELECT unnest(range(1, {GRID.n_cells + 1})) AS cell_id) q""",
    ),
    "centre_in": (
        ("cells", "edges"),
        f"""SELECT c.cell_id, e.region_id FROM cells c JOIN edges e ON {_crossed('e', 'c.cx', 'c.cy')}
            GROUP BY ALL HAVING count(*) % 2 = 1""",
    ),
    "meeting": (
        ("cells", "edges", "centre_in"),
        f"""SELECT c.cell_id, e.region_id FROM cells c JOIN edges e
            ON least(e.x1, e.x2) <= c.cx + {d(HX)} AND greatest(e.x1, e.x2) >= c.cx - {d(HX)}
            AND e.y1 <= c.cy + {d(HY)} AND e.y2 >= c.cy - {d(HY)}
            AND abs((e.x2 - e.x1) * (c.cy - e.y1) - (e.y2 - e.y1) * (c.cx - e.x1))
                <= abs(e.x2 - e.x1) * {d(HY)} + abs(e.y2 - e.y1) * {d(HX)}
            UNION SELECT cell_id, region_id FROM centre_in""",
    ),
    "quick": (
        ("meeting",),
        """SELECT cell_id, CASE WHEN count(*) = 1 THEN min(region_id) ELSE 0 END AS quick_id
            FROM meeting GROUP BY cell_id""",
    ),
    "codes": (
        (),
        f"""SELECT CAST(t AS INTEGER) AS region_id, n_nationkey AS neighborhood_code,
            n_regionkey + 1 AS borough_code
            FROM (SELECT unnest(range(1, {standins.N_TRACTS + 1})) AS t) q
            JOIN nation ON n_nationkey = t % {standins.N_NEIGHBORHOODS}""",
    ),
    # weather
    "hourly": (
        (),
        f"""SELECT year, month, day, hour, {mean('temperature')} AS temperature,
            max(precipitation) AS precipitation, {mean('windspeed')} AS windspeed
            FROM (SELECT {', '.join(f"{part(p, 'ts')} AS {p}" for p in ('year', 'month', 'day', 'hour'))},
                    CASE WHEN event_type <> 'error' THEN value END AS temperature,
                    CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE value / 100.0::DOUBLE END AS precipitation,
                    value / 10.0::DOUBLE AS windspeed FROM events) r
            GROUP BY ALL""",
    ),
}

for _end in ("pickup", "dropoff"):
    _lon, _lat = f"{_end}_longitude", f"{_end}_latitude"
    PIECES[f"hit_{_end}"] = (
        ("trips", "edges"),
        f"""SELECT trip_id, min(region_id) AS region_id FROM (
              SELECT t.trip_id, e.region_id FROM trips t JOIN edges e ON {_crossed('e', f't.{_lon}', f't.{_lat}')}
              GROUP BY ALL HAVING count(*) % 2 = 1) h GROUP BY trip_id""",
    )
    PIECES[f"near_{_end}"] = (
        ("trips", "quick", f"hit_{_end}"),
        f"""SELECT t.trip_id, q.quick_id,
              CASE WHEN q.quick_id <> 0 THEN q.quick_id WHEN q.quick_id = 0 THEN h.region_id END AS region_id
            FROM trips t LEFT JOIN quick q ON q.cell_id = {cell(GRID, f't.{_lon}', f't.{_lat}')}
            LEFT JOIN hit_{_end} h ON h.trip_id = t.trip_id""",
    )
PIECES["tract"] = (
    ("clean", "near_pickup", "near_dropoff"),
    """SELECT c.*, CAST(coalesce(p.region_id, 0) AS INTEGER) AS pickup_region,
        CAST(coalesce(q.region_id, 0) AS INTEGER) AS dropoff_region
        FROM clean c JOIN near_pickup p ON p.trip_id = c.trip_id JOIN near_dropoff q ON q.trip_id = c.trip_id""",
)


PIECES["rerun"] = (
    ("tract",),
    f"""SELECT * FROM tract WHERE date_trunc('month', pickup_datetime) <> (SELECT min(date_trunc('month', pickup_datetime)) FROM tract)
        OR pickup_region BETWEEN 1 AND {registry.RERUN_TRACTS}""",
)


def _leg(source: str, end: str, leaving: int, internal: bool) -> str:
    ts = f"{end}_datetime"
    parts = ", ".join(f"{part(p, ts)} AS {p}" for p in SLOT_KEYS.split(", "))
    rate = "fare_rev_per_hour" if leaving else "NULL::DOUBLE"
    skip = "" if internal else "AND pickup_region <> dropoff_region"
    return (
        f"SELECT {end}_region AS region_id, {parts}, {leaving} AS o, {1 - leaving} AS i, {rate} AS rate "
        f"FROM {source} WHERE {end}_region <> 0 {skip}"
    )


def _net(source: str, internal: bool = True) -> tuple[tuple[str, ...], str]:
    return (
        (source,),
        f"""SELECT region_id, {SLOT_KEYS}, CAST(sum(o) AS BIGINT) AS trips_out,
            CAST(sum(i) AS BIGINT) AS trips_in, CAST(sum(i) - sum(o) AS BIGINT) AS net_trips_in,
            {mean('rate')} AS mean_fare_rev_per_hour
            FROM ({_leg(source, 'pickup', 1, internal)} UNION ALL {_leg(source, 'dropoff', 0, internal)}) l
            GROUP BY ALL""",
    )


PIECES["net_coarse"] = _net("coarse")
PIECES["net_tract"] = _net("tract")
PIECES["boro"] = (
    ("tract", "codes"),
    """SELECT t.* EXCLUDE (pickup_region, dropoff_region), coalesce(a.borough_code, 0) AS pickup_region,
        coalesce(b.borough_code, 0) AS dropoff_region FROM tract t
        LEFT JOIN codes a ON a.region_id = t.pickup_region LEFT JOIN codes b ON b.region_id = t.dropoff_region""",
)
PIECES["net_boro"] = _net("boro", internal=False)
PIECES["areas"] = (
    ("net_tract", "hourly", "codes"),
    f"""SELECT n.* EXCLUDE (mean_fare_rev_per_hour), {', '.join(f'w.{c}' for c in WEATHER)},
        c.neighborhood_code, c.borough_code FROM net_tract n
        LEFT JOIN hourly w USING (year, month, day, hour) LEFT JOIN codes c USING (region_id)""",
)
for _name, _keys in (("by_nbhd", "borough_code, neighborhood_code"), ("by_boro", "borough_code")):
    PIECES[_name] = (
        ("areas",),
        f"SELECT {_keys}, {SLOT_KEYS}, {sums(MEASURES)}, {means(WEATHER)} FROM areas GROUP BY ALL",
    )


def _week(name: str, source: str, keys: str, columns) -> None:
    PIECES[name] = (
        (source,),
        f"SELECT {keys}, weekday, hour, quarter_hour, {means(columns)} FROM {source} GROUP BY ALL",
    )


_week("week_tract", "areas", "borough_code, neighborhood_code, region_id", (*MEASURES, *WEATHER))
_week("week_nbhd", "by_nbhd", "borough_code, neighborhood_code", (*MEASURES, *WEATHER))
_week("week_boro", "by_boro", "borough_code", (*MEASURES, *WEATHER))
_week("week_net", "net_tract", "region_id", MEASURES)
PIECES["boro_net"] = (
    ("net_tract", "codes"),
    f"SELECT borough_code, {SLOT_KEYS}, {sums(MEASURES)} FROM net_tract JOIN codes USING (region_id) GROUP BY ALL",
)
_week("week_boro_net", "boro_net", "borough_code", MEASURES)

# rides per fine cell and hour
_ride_grid: FineGrid = registry.RIDE_GRID
_X0, _Y0 = round(_ride_grid.lon_min * 1000), round(_ride_grid.lat_min * 1000)
_N = _ride_grid.ncol
PIECES["placed"] = (
    ("clean",),
    f"""SELECT *, CAST(floor(pickup_longitude * 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) - ({_X0}) AS dx,
        CAST(floor(pickup_latitude * 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) - ({_Y0}) AS dy FROM clean""",
)
PIECES["rides"] = (
    ("placed",),
    f"""SELECT dx + dy * {_N} AS pickup_cell, {part('year', 'pickup_datetime')} AS year,
        {part('month', 'pickup_datetime')} AS month, {part('weekday', 'pickup_datetime')} AS weekday,
        {part('day', 'pickup_datetime')} AS pickup_day, {part('hour', 'pickup_datetime')} AS pickup_hour,
        count(*) AS rides, CAST(sum(passenger_count) AS BIGINT) AS passenger_count,
        {means(('fare_amount', 'fare_rev_per_hour', 'trip_distance'))}
        FROM placed WHERE dx BETWEEN 1 AND {_N} AND dy BETWEEN 0 AND {_N - 1} GROUP BY ALL""",
)

PIECES["coarse_rides"] = (
    ("coarse", "hourly"),
    f"""SELECT r.*, w.windspeed, w.temperature, coalesce(w.precipitation, 0.0::DOUBLE) AS precipitation
        FROM (SELECT pickup_region AS pickup_cell, {part('year', 'pickup_datetime')} AS year,
        {part('weekday', 'pickup_datetime')} AS weekday,
        {part('month', 'pickup_datetime')} AS month, {part('day', 'pickup_datetime')} AS pickup_day,
        {part('hour', 'pickup_datetime')} AS pickup_hour, count(*) AS rides
        FROM coarse WHERE pickup_region <> 0 GROUP BY ALL) r
        LEFT JOIN hourly w ON w.year = r.year AND w.month = r.month AND w.day = r.pickup_day AND w.hour = r.pickup_hour""",
)

# the full regression: months are columns 1 to 12, weekdays 13 to 19, hours 20 to 43, weather 44
# and 45, the label 46; the cell is taken out by its means, the rest by elimination
LABEL_COLUMN = 46


def _regression(name: str, label: str) -> None:
    PIECES[f"{name}_known"] = (
        ("coarse_rides",),
        f"""SELECT *, row_number() OVER () AS rid, {label} AS y FROM coarse_rides
            WHERE temperature IS NOT NULL AND precipitation IS NOT NULL""",
    )
    PIECES[f"{name}_x"] = (
        (f"{name}_known",),
        " UNION ALL ".join(
            f"SELECT rid, pickup_cell, {column} AS i, {value} AS x FROM {name}_known"
            for column, value in (
                ("CAST(month AS INTEGER)", "1.0::DOUBLE"),
                ("CAST(12 + weekday AS INTEGER)", "1.0::DOUBLE"),
                ("CAST(20 + pickup_hour AS INTEGER)", "1.0::DOUBLE"),
                ("44", "temperature"),
                ("45", "precipitation"),
                (str(LABEL_COLUMN), "y"),
            )
        ),
    )
    PIECES[f"{name}_m"] = (
        (f"{name}_x", f"{name}_known"),
        f"""SELECT pickup_cell, i, sum(x) / max(n) AS m FROM {name}_x
            JOIN (SELECT pickup_cell, count(*) AS n FROM {name}_known GROUP BY ALL) c USING (pickup_cell) GROUP BY ALL""",
    )
    PIECES[f"{name}_n"] = (
        (f"{name}_known",),
        f"SELECT pickup_cell, count(*) AS n FROM {name}_known GROUP BY ALL",
    )
    PIECES[f"{name}_a0"] = (
        (f"{name}_x", f"{name}_m", f"{name}_n"),
        f"""SELECT i, j, sum(v) AS v FROM (
              SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM {name}_x a JOIN {name}_x b USING (rid) GROUP BY ALL
              UNION ALL SELECT a.i, b.i AS j, -sum(a.m * b.m * n) AS v FROM {name}_m a JOIN {name}_m b USING (pickup_cell)
                JOIN {name}_n USING (pickup_cell) GROUP BY ALL) p GROUP BY i, j""",
    )
    for k in range(1, LABEL_COLUMN):
        PIECES[f"{name}_a{k}"] = (
            (f"{name}_a{k - 1}",),
            f"""SELECT a.i, a.j, CASE WHEN p.v IS NULL THEN a.v WHEN a.i = {k} THEN a.v / p.v
                  ELSE a.v - coalesce(r.v, 0) * coalesce(c.v, 0) / p.v END AS v
                FROM {name}_a{k - 1} a LEFT JOIN {name}_a{k - 1} r ON r.i = a.i AND r.j = {k}
                LEFT JOIN {name}_a{k - 1} c ON c.i = {k} AND c.j = a.j
                LEFT JOIN (SELECT v FROM {name}_a{k - 1} WHERE i = {k} AND j = {k} AND v > 1e-7) p ON true""",
        )
    last = f"{name}_a{LABEL_COLUMN - 1}"
    PIECES[f"{name}_fit"] = (
        (last, f"{name}_x", f"{name}_m", f"{name}_known"),
        f"""SELECT k.* EXCLUDE (y), k.y, c.m + f.shift AS y_hat FROM {name}_known k
            JOIN (SELECT pickup_cell, m FROM {name}_m WHERE i = {LABEL_COLUMN}) c USING (pickup_cell)
            JOIN (SELECT x.rid, sum(b.v * x.x) - max(g.s) AS shift FROM {name}_x x
                  JOIN (SELECT i, v FROM {last} WHERE j = {LABEL_COLUMN} AND i < {LABEL_COLUMN}
                        AND i IN (SELECT i FROM {last} WHERE i = j AND abs(v - 1) < 1e-9)) b USING (i)
                  JOIN (SELECT m.pickup_cell, sum(b.v * m.m) AS s FROM {name}_m m
                        JOIN (SELECT i, v FROM {last} WHERE j = {LABEL_COLUMN} AND i < {LABEL_COLUMN}
                              AND i IN (SELECT i FROM {last} WHERE i = j AND abs(v - 1) < 1e-9)) b USING (i)
                        GROUP BY 1) g ON g.pickup_cell = x.pickup_cell
                  GROUP BY x.rid) f USING (rid)""",
    )
    PIECES[f"{name}_all"] = (
        (f"{name}_fit", "coarse_rides"),
        f"""SELECT r.*, f.y_hat FROM coarse_rides r LEFT JOIN {name}_fit f
            USING (pickup_cell, year, month, pickup_day, pickup_hour)""",
    )


_regression("plain", "rides::DOUBLE")
_regression("logged", "ln(rides::DOUBLE)")
RIDE_KEYS = ", ".join(registry.RIDE_KEYS)


def _residual_means(grain: str) -> str:
    keys = ["year", "month", "weekday", "pickup_day", *(["pickup_hour"] if grain == "hour" else [])]
    clock = "pickup_hour, 30" if grain == "hour" else "12, 30"
    fits = {"rides_hat": mean("y_hat"), "rides_resid": mean("(rides - y_hat)"), "residual": f"{mean('rides')} - {mean('y_hat')}"}
    return f"""SELECT {', '.join(keys)}, {means(('rides', 'precipitation', 'temperature'))},
        {', '.join(f'round({x}, 4) AS {name}' for name, x in fits.items())},
        make_timestamp(year, month, pickup_day, {clock}, 0.0) AS datetime
        FROM plain_all GROUP BY {', '.join(keys)}"""


# graph
PIECES["grid_edges"] = (
    ("used",),
    f"""SELECT a.cell_id AS src, b.cell_id AS dst FROM used a JOIN used b
        ON ((a.cell_id - 1) // {GRID.n} = (b.cell_id - 1) // {GRID.n} AND abs(a.cell_id - b.cell_id) = 1)
        OR abs(a.cell_id - b.cell_id) = {GRID.n}""",
)
PIECES["land_edges"] = (
    ("grid_edges", "centre_in"),
    """SELECT * FROM grid_edges WHERE src IN (SELECT cell_id FROM centre_in)
        AND dst IN (SELECT cell_id FROM centre_in)""",
)
_rows = ", ".join(
    f"({d(a)}, {d(b)}, {d(c)}, {d(e)})" for a, b, c, e, _ in standins.CROSSINGS
)
PIECES["links"] = (
    (),
    f"""SELECT {cell(GRID, 'e_lon', 'e_lat')} AS src, {cell(GRID, 'w_lon', 'w_lat')} AS dst
        FROM (VALUES {_rows}) AS v(w_lat, w_lon, e_lat, e_lon)""",
)
PIECES["roads"] = (
    ("land_edges", "links"),
    """SELECT src, dst FROM land_edges UNION SELECT src, dst FROM links WHERE src <> dst
        UNION SELECT dst, src FROM links WHERE src <> dst""",
)
PIECES["s0"] = (("used",), "SELECT cell_id, pickups::DOUBLE AS value FROM used")
for _k in range(1, registry.DIFFUSION_STEPS + 1):
    PIECES[f"s{_k}"] = (
        (f"s{_k - 1}", "roads", "used"),
        f"""SELECT c.cell_id, coalesce(avg(v.value), 0.0::DOUBLE) + 0.25::DOUBLE AS value
            FROM (SELECT cell_id FROM used UNION SELECT dst FROM roads JOIN used ON src = cell_id) c
            LEFT JOIN roads r ON r.dst = c.cell_id
            LEFT JOIN s{_k - 1} v ON v.cell_id = r.src GROUP BY c.cell_id""",
    )


def sql(select: str, *needs: str) -> str:
    """``WITH`` the needed pieces, each after the ones it builds on."""
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name not in ordered:
            depends, body = PIECES[name]
            for other in depends:
                visit(other)
            ordered[name] = body

    for name in needs:
        visit(name)
    if not ordered:
        return select
    # referenced several times and costly, so computed once
    pieces = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in ordered.items())
    return f"WITH {pieces}\n{select}"


def _quantiles(source: str, value: str, probs: dict[str, float], key: str | None) -> str:
    over = f"PARTITION BY {key}" if key else ""
    picks = []
    for name, p in probs.items():
        at = f"((n - 1) * {d(p)})"
        low, high = f"floor({at})", f"ceil({at})"
        a = f"max(CASE WHEN rk = {low} THEN v END)"
        b = f"max(CASE WHEN rk = {high} THEN v END)"
        picks.append(f"{a} + ({b} - {a}) * (max({at}) - max({low})) AS {name}")
    keys = f"{key}, " if key else ""
    return f"""SELECT {keys}{', '.join(picks)}, max(n) AS n FROM (
        SELECT {keys}{value} AS v, row_number() OVER ({over} ORDER BY {value}) - 1 AS rk,
        count(*) OVER ({over}) AS n FROM {source} WHERE {value} IS NOT NULL) q
        {f'GROUP BY {key}' if key else ''}"""


def _transfers(source: str, clock: str, region: str, count: str) -> str:
    keys = ", ".join(f"{part(p, f'{clock}_datetime')} AS {p}" for p in ("weekday", "hour", "quarter_hour"))
    return f"""SELECT pickup_region AS pickup_{region}, dropoff_region AS dropoff_{region}, {keys},
        count(*) AS {count} FROM {source} WHERE {clock}_region <> 0 GROUP BY ALL"""


def _frames(week: str, area: str, limit: float) -> str:
    lim = d(limit)
    regions = "c.region_id, c.borough_code" if area == "borough_code" else "CAST(c.region_id AS BIGINT) AS region_id"
    return f"""SELECT {regions},
        f.hour, f.quarter_hour, printf('%02d:%02d', f.hour, f.quarter_hour * 15) AS label,
        CASE WHEN w.net_trips_in < -{lim} THEN -{lim} WHEN w.net_trips_in > {lim} THEN {lim}
             ELSE w.net_trips_in END AS value
        FROM codes c CROSS JOIN (SELECT CAST(s // 4 AS INTEGER) AS hour, CAST(s % 4 AS INTEGER) AS quarter_hour
                                 FROM (SELECT unnest(range(0, 96)) AS s) q) f
        LEFT JOIN {week} w ON w.{area} = c.{area} AND w.hour = f.hour
          AND w.quarter_hour = f.quarter_hour AND w.weekday = 2"""


def _bin2d(lon: str, lat: str, bins: int) -> tuple[str, str, str]:
    def one(v: str, low: float, high: float) -> str:
        return f"least(CAST(floor(({v} - {d(low)}) / {d((high - low) / bins)}) AS BIGINT), {bins - 1})"

    within = f"{lon} BETWEEN -74.05::DOUBLE AND -73.75::DOUBLE AND {lat} BETWEEN 40.6::DOUBLE AND 40.9::DOUBLE"
    return one(lon, -74.05, -73.75), one(lat, 40.6, 40.9), within


def _density() -> str:
    bw, low, high, points = (registry.DENSITY[k] for k in ("bandwidth", "low", "high", "points"))
    width, step = bw / 8, (high - low) / (points - 1)
    scale = 1.0 / (bw * math.sqrt(2 * math.pi) * KERNEL_UNIT)
    x = f"({d(low)} + point * {d(step)})"
    u = f"(({x} - center) / {d(bw)})"
    weight = f"CAST(floor(exp(-0.5::DOUBLE * {u} * {u}) * {d(float(KERNEL_UNIT))}) AS BIGINT)"
    return f"""SELECT point, {x} AS x,
        CAST(sum({weight} * n) AS BIGINT)::DOUBLE * {d(scale)} / (SELECT count(*) FROM usual)::DOUBLE AS density
        FROM (SELECT (floor(fare_rev_per_hour / {d(width)}) + 0.5::DOUBLE) * {d(width)} AS center, count(*) AS n
              FROM usual GROUP BY ALL) b CROSS JOIN (SELECT unnest(range(0, {points})) AS point) p
        GROUP BY point"""


def _fitted_density(value: str, where: str) -> str:
    """Each value on its two neighbouring points, then the kernel over all pairs of points."""
    values = f"(SELECT {value} AS v FROM clean WHERE {where}) t"
    place = "((v - start) / step)"
    return f"""SELECT * FROM (
        WITH a AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high, 0.9::DOUBLE * pow(count(*), -0.2::DOUBLE)
              * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE) AS bw FROM {values}),
        g AS (SELECT *, low - 3 * bw AS start, (high - low + 6 * bw) / 511 AS step FROM a),
        b AS (SELECT CAST(floor{place} AS BIGINT) + side AS bin,
              sum(CASE WHEN side = 0 THEN 1 - {place} + floor{place} ELSE {place} - floor{place} END) AS mass
              FROM {values}, g, (VALUES (0), (1)) AS s(side) GROUP BY 1)
        SELECT CAST(point AS INTEGER) AS point, round(start + point * step, 8) AS x,
            round(sum(mass * exp(-0.5::DOUBLE * pow((point - bin) * step / bw, 2))) / (max(n) * max(bw) * sqrt(2 * pi())), 8)
              AS density
        FROM b, (SELECT unnest(range(0, 512)) AS point) p, g GROUP BY point, start, step) d"""


def _smooth() -> str:
    bins, reach, sigma = (registry.SMOOTH[k] for k in ("bins", "reach", "sigma"))
    bx, by, within = _bin2d("pickup_longitude", "pickup_latitude", bins)
    weights = ", ".join(
        f"({k - reach}, {w})" for k, w in enumerate(kernel_weights(reach, sigma))
    )
    return f"""SELECT c.bx + i.k AS bx, c.by + j.k AS by, CAST(sum(c.n * i.w * j.w) AS DOUBLE) AS mass
        FROM (SELECT {bx} AS bx, {by} AS by, count(*) AS n FROM clean WHERE {within} GROUP BY ALL) c
        CROSS JOIN (VALUES {weights}) AS i(k, w) CROSS JOIN (VALUES {weights}) AS j(k, w)
        WHERE c.bx + i.k BETWEEN 0 AND {bins - 1} AND c.by + j.k BETWEEN 0 AND {bins - 1} GROUP BY ALL"""


def _fare_map(summary: str) -> str:
    bx, by, within = _bin2d("pickup_longitude", "pickup_latitude", 799)
    return f"""SELECT {part('hour', 'pickup_datetime')} AS pickup_hour, {bx} AS bx, {by} AS by, {summary}
        FROM usual WHERE {within} AND dayofweek(pickup_datetime) = 1 GROUP BY ALL"""


def _raw_output(source: str) -> str:
    return f"""SELECT CAST(trip_id AS VARCHAR) AS vendor_id,
        strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') AS pickup_datetime,
        CAST(passenger_count AS INTEGER) AS passenger_count, trip_distance, dropoff_longitude, fare_amount,
        (trip_id % 7)::DOUBLE AS tip_amount, fare_amount AS total_amount FROM {source}"""


def _pages() -> str:
    rows = []
    for k in range(standins.OBSERVATIONS_PER_PAGE):
        wind = "NULL::DOUBLE" if k == 0 else "value / 10"
        rain = "0.0::DOUBLE" if k == 1 else "value"
        rows.append(
            f"""SELECT {', '.join(f"{part(p, 'ts')} AS {p}" for p in ('year', 'month', 'day'))},
            strftime(ts, '%Y-%m-%d ') || printf('{k + 1}:%02d AM', minute(ts)) AS time,
            value - {50 * k} AS temperature, {rain} AS precipitation, {wind} AS windspeed,
            {k + 1} AS hour FROM events"""
        )
    return " UNION ALL ".join(rows)


def _reprojected() -> str:
    """Conic by fixed-point iteration, transverse Mercator by its series."""
    conic, tm = LONG_ISLAND_ZONE, NEW_JERSEY_ZONE
    cone, scale, rho_0 = conic.constants()
    e = projection.E1
    east = f"((x - {d(conic.false_easting)}) * {d(conic.unit)})"
    south = f"({d(rho_0)} - (y - {d(conic.false_northing)}) * {d(conic.unit)})"
    steps = [
        f"""p0 AS (SELECT *, pi() / 2 - 2 * atan(t) AS phi FROM (SELECT *, {east} AS xe, {south} AS ys,
        pow(sqrt(pow({east}, 2) + pow({south}, 2)) / {d(projection.SEMI_MAJOR * scale)}, {d(1 / cone)}) AS t
        FROM plane) q)"""
    ]
    for k in range(1, 8):
        slip = f"(1 - {d(e)} * sin(phi)) / (1 + {d(e)} * sin(phi))"
        steps.append(
            f"p{k} AS (SELECT * EXCLUDE (phi), pi() / 2 - 2 * atan(t * pow({slip}, {d(e / 2)})) AS phi FROM p{k - 1})"
        )
    e2 = projection.E2
    second = e2 / (1 - e2)
    arc_0 = tm.meridian_arc(math.radians(tm.latitude_of_origin))
    f = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu_scale = projection.SEMI_MAJOR * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    unit = tm.unit / tm.scale_factor
    series = " + ".join(
        f"{d(factor)} * sin({k} * mu)"
        for k, factor in (
            (2, 3 * f / 2 - 27 * f**3 / 32),
            (4, 21 * f**2 / 16 - 55 * f**4 / 32),
            (6, 151 * f**3 / 96),
            (8, 1097 * f**4 / 512),
        )
    )
    return f"""WITH plane AS (SELECT event_id, 913000.0::DOUBLE + (event_id * 7919) % 154321 AS x,
        120000.0::DOUBLE + (event_id * 6101) % 152345 AS y, 400000.0::DOUBLE + (event_id * 3571) % 254321 AS x2,
        500000.0::DOUBLE + (event_id * 4409) % 252345 AS y2 FROM events),
    {', '.join(steps)},
    m0 AS (SELECT *, ({d(arc_0)} + (y2 - {d(tm.false_northing)}) * {d(unit)}) / {d(mu_scale)} AS mu FROM p7),
    m1 AS (SELECT *, mu + {series} AS foot FROM m0),
    m2 AS (SELECT *, {d(second)} * pow(cos(foot), 2) AS c, pow(tan(foot), 2) AS t1,
        {d(projection.SEMI_MAJOR)} / sqrt(1 - {d(e2)} * pow(sin(foot), 2)) AS across,
        {d(projection.SEMI_MAJOR * (1 - e2))} / pow(1 - {d(e2)} * pow(sin(foot), 2), 1.5) AS along FROM m1),
    m3 AS (SELECT *, (x2 - {d(tm.false_easting)}) * {d(unit)} / across AS g FROM m2)
    SELECT event_id, round({d(conic.central_meridian)} + degrees(atan2(xe, ys) / {d(cone)}), 6) AS east_lon,
        round(degrees(phi), 6) AS east_lat,
        round({d(tm.central_meridian)} + degrees((g - (1 + 2 * t1 + c) * pow(g, 3) / 6
            + (5 - 2 * c + 28 * t1 - 3 * c * c + 8 * {d(second)} + 24 * t1 * t1) * pow(g, 5) / 120) / cos(foot)), 6) AS west_lon,
        round(degrees(foot - across * tan(foot) / along * (g * g / 2
            - (5 + 3 * t1 + 10 * c - 4 * c * c - 9 * {d(second)}) * pow(g, 4) / 24
            + (61 + 90 * t1 + 298 * c + 45 * t1 * t1 - 252 * {d(second)} - 3 * c * c) * pow(g, 6) / 720)), 6) AS west_lat
    FROM m3"""


def build() -> dict[str, str]:
    net = f"region_id, {SLOT_KEYS}, trips_out, trips_in, net_trips_in"
    fine_cell = {e: cell(GRID, f"{e}_longitude", f"{e}_latitude") for e in ("pickup", "dropoff")}
    rtl_cell = {e: cell(registry.RTL, f"{e}_longitude", f"{e}_latitude") for e in ("pickup", "dropoff")}
    parts = ", ".join(
        f"{part(p, f'{e}_datetime')} AS {e}_{p}" for p in PARTS for e in ("pickup", "dropoff")
    )
    n = registry.RTL.n
    ring = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    vertices = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(ring))
    west = f"({d(GRID.lon_min)} + ((cell_id - 1) % {GRID.n}) * {d(GRID.lon_width)})"
    north = f"({d(GRID.lat_max)} - ((cell_id - 1) // {GRID.n}) * {d(GRID.lat_width)})"
    p1, p2 = center(GRID, "src"), center(GRID, "dst")
    labels = "printf('%02d:%02d', hour, quarter_hour * 15)"
    patterns = [
        ("daily", ("weekday", "hour", "quarter_hour")),
        ("monthly", ("month", "day")),
        ("yearly", ("year", "month")),
    ]
    pattern_keys = ("weekday", "hour", "quarter_hour", "month", "day", "year")
    copies = "(SELECT * FROM trips UNION ALL SELECT * FROM trips WHERE trip_id % 97 = 0) u"

    out = {
        "trip_time_features": sql(
            f"""SELECT trip_id, trip_time, fare_rev_per_hour, {part('weekday', 'pickup_datetime')} AS weekday,
            {parts}, hour(pickup_datetime) + minute(pickup_datetime) / 60.0::DOUBLE AS pickup_time,
            hour(pickup_datetime) + (minute(pickup_datetime) // 15) / 4.0::DOUBLE AS pickup_slot_hour FROM trips""",
            "trips",
        ),
        "clean_trips": sql(
            "SELECT trip_id, trip_distance, fare_amount, trip_time, fare_rev_per_hour FROM clean", "clean"
        ),
        "clean_flags": sql("SELECT trip_id, clean FROM flagged", "flagged"),
        "clean_reject_counts": sql(
            """SELECT count(*) AS trips, count(*) FILTER (NOT coalesce(trip_distance < 100, false)) AS bad_distance,
            count(*) FILTER (NOT coalesce(fare_per_mile > 1 AND fare_per_mile < 20, false)) AS bad_fare_per_mile,
            count(*) FILTER (NOT coalesce(pickup_longitude > -75 AND pickup_longitude < -72, false)) AS bad_longitude,
            count(*) FILTER (NOT coalesce(pickup_latitude > 40 AND pickup_latitude < 41.5, false)) AS bad_latitude,
            count(*) FILTER (NOT coalesce(trip_time > 1.0::DOUBLE / 60.0::DOUBLE, true)) AS bad_trip_time,
            count(*) FILTER (NOT coalesce(fare_rev_per_hour < 1000, true)) AS bad_fare_rate,
            count(*) FILTER (clean) AS clean FROM flagged""",
            "flagged",
        ),
        "point_to_cell_ltr": sql(
            f"SELECT trip_id, {fine_cell['pickup']} AS pickup_grid, {fine_cell['dropoff']} AS dropoff_grid FROM trips",
            "trips",
        ),
        "point_to_cell_rtl": sql(
            f"SELECT trip_id, {rtl_cell['pickup']} AS pickup_grid, {rtl_cell['dropoff']} AS dropoff_grid FROM trips",
            "trips",
        ),
        "cell_flip": sql(
            f"""SELECT trip_id, cell, (cell - 1) // {n} * {n} + {n} - (cell - 1) % {n} AS flipped
            FROM (SELECT trip_id, {rtl_cell['pickup']} AS cell FROM trips) c""",
            "trips",
        ),
        "cell_reduce": sql(
            f"""SELECT trip_id, cell, ((cell - 1) // 100 // 4) * 25 + ((cell - 1) % 100) // 4 + 1 AS coarse
            FROM (SELECT trip_id, {fine_cell['pickup']} AS cell FROM trips) c""",
            "trips",
        ),
        "cell_centroids": sql(f"SELECT cell_id, pickups, {CX} AS lon, {CY} AS lat FROM used", "used"),
        "cell_polygons": sql(
            f"""SELECT cell_id, CAST(seq AS INTEGER) AS seq,
            CASE WHEN dx = 0 THEN {west} ELSE {west} + {d(GRID.lon_width)} END AS lon,
            CASE WHEN dy = 0 THEN {north} ELSE {north} - {d(GRID.lat_width)} END AS lat
            FROM used CROSS JOIN (VALUES {vertices}) AS v(seq, dx, dy)""",
            "used",
        ),
        "net_flow_by_cell": sql(f"SELECT {net} FROM net_coarse", "net_coarse"),
        "net_flow_by_join": sql(f"SELECT {net}, mean_fare_rev_per_hour FROM net_coarse", "net_coarse"),
        "net_flow_fare_rate": sql(f"SELECT {net}, mean_fare_rev_per_hour FROM net_coarse", "net_coarse"),
        "net_flow_by_tract": sql(f"SELECT {net} FROM net_tract", "net_tract"),
        "transfer_out": sql(_transfers("tract", "pickup", "tract_id", "trips"), "tract"),
        "transfer_into": sql(_transfers("tract", "dropoff", "tract_id", "trips"), "tract"),
        "od_matrix": sql(_transfers("tract", "pickup", "tract_id", "n"), "tract"),
        "od_share": sql(
            f"""SELECT *, n::DOUBLE / CAST(sum(n) OVER (PARTITION BY pickup_grid, weekday, hour, quarter_hour) AS DOUBLE)
            AS share FROM ({_transfers('coarse', 'pickup', 'grid', 'n')}) m""",
            "coarse",
        ),
        "region_parity": sql(
            """SELECT coalesce(p.r, q.r) AS region_id, p.r IS NOT NULL AS has_pickups, q.r IS NOT NULL AS has_dropoffs
            FROM (SELECT DISTINCT pickup_region AS r FROM fine) p
            FULL JOIN (SELECT DISTINCT dropoff_region AS r FROM fine) q ON p.r = q.r
            WHERE p.r IS NULL OR q.r IS NULL""",
            "fine",
        ),
        "cells_in_one_direction": sql(
            """SELECT coalesce(p.r, q.r) AS cell_id, p.r IS NOT NULL AS in_a, q.r IS NOT NULL AS in_b
            FROM (SELECT DISTINCT pickup_region AS r FROM fine) p
            FULL JOIN (SELECT DISTINCT dropoff_region AS r FROM fine) q ON p.r = q.r
            WHERE p.r IS NULL OR q.r IS NULL""",
            "fine",
        ),
        "od_slice_dense": sql(
            f"""SELECT a.t AS pickup_tract_id, b.t AS dropoff_tract_id, coalesce(n, 0) AS n
            FROM (SELECT CAST(unnest(range(1, {standins.N_TRACTS + 1})) AS INTEGER) AS t) a
            CROSS JOIN (SELECT CAST(unnest(range(1, {standins.N_TRACTS + 1})) AS INTEGER) AS t) b
            LEFT JOIN (SELECT pickup_region, dropoff_region, count(*) AS n FROM tract
                WHERE dayofweek(pickup_datetime) = 1 AND hour(pickup_datetime) = 8 AND minute(pickup_datetime) < 15
                GROUP BY ALL) m ON m.pickup_region = a.t AND m.dropoff_region = b.t""",
            "tract",
        ),
        "unused_cells": sql(
            "SELECT cell_id FROM cells EXCEPT SELECT cell_id FROM used", "cells", "used"
        ),
        "tract_quick_assign": sql("SELECT trip_id, quick_id AS quick_tract_id FROM near_pickup", "near_pickup"),
        "tract_assign": sql(
            """SELECT p.trip_id, p.region_id AS pickup_tract_id, q.region_id AS dropoff_tract_id
            FROM near_pickup p JOIN near_dropoff q USING (trip_id)""",
            "near_pickup",
            "near_dropoff",
        ),
        "tract_assign_exact": sql(
            f"""SELECT t.trip_id, CASE WHEN {fine_cell['pickup']} IS NOT NULL THEN p.region_id END AS pickup_tract_id,
            CASE WHEN {fine_cell['dropoff']} IS NOT NULL THEN q.region_id END AS dropoff_tract_id
            FROM trips t LEFT JOIN hit_pickup p USING (trip_id) LEFT JOIN hit_dropoff q USING (trip_id)""",
            "trips",
            "hit_pickup",
            "hit_dropoff",
        ),
        "tagged_trips": sql(
            f"""SELECT pickup_region AS pickup_tract_id, pickup_datetime, pickup_latitude, pickup_longitude,
            dropoff_region AS dropoff_tract_id, dropoff_datetime, dropoff_latitude, dropoff_longitude,
            {part('year', 'pickup_datetime')} AS pickup_year, {part('month', 'pickup_datetime')} AS pickup_month,
            {part('weekday', 'pickup_datetime')} AS weekday, passenger_count, fare_rev_per_hour, fare_amount,
            fare_amount AS total_amount, trip_time, trip_distance FROM tract""",
            "tract",
        ),
        "used_cell_candidates": sql(
            "SELECT cell_id, pickups, region_id FROM used LEFT JOIN meeting USING (cell_id)", "used", "meeting"
        ),
        "tracts_of_used_cells": sql(
            "SELECT DISTINCT region_id FROM used JOIN meeting USING (cell_id)", "used", "meeting"
        ),
        "vertices_with_pickups": sql(
            """SELECT c.region_id, 0 AS ring, CAST(k AS INTEGER) AS seq, lon, lat, pickups FROM corners c
            JOIN (SELECT pickup_region AS region_id, count(*) AS pickups FROM tract GROUP BY ALL) p
            ON p.region_id = c.region_id""",
            "corners",
            "tract",
        ),
        "reprojected_points": _reprojected(),
        "hourly_weather": sql("SELECT * FROM hourly", "hourly"),
        "net_with_weather": sql(
            f"""SELECT {net.replace('region_id', 'n.region_id')}, {', '.join(WEATHER)}
            FROM net_coarse n LEFT JOIN hourly USING (year, month, day, hour)""",
            "net_coarse",
            "hourly",
        ),
        "net_with_codes": sql("SELECT * FROM areas", "areas"),
        "net_with_dated_codes": sql(
            f"""SELECT CASE WHEN make_date(year, month, day) >= DATE '{registry.CODES_CHANGE}'
              THEN (neighborhood_code + 1) % {standins.N_NEIGHBORHOODS} ELSE neighborhood_code END AS neighborhood_code,
            {SLOT_KEYS}, {sums(MEASURES)} FROM areas GROUP BY ALL""",
            "areas",
        ),
        "rollup_neighborhood": sql("SELECT * FROM by_nbhd", "by_nbhd"),
        "rollup_borough": sql("SELECT * FROM by_boro", "by_boro"),
        "rollup_all_levels": sql(
            " UNION ALL ".join(
                f"""SELECT borough_code, {nbhd} AS neighborhood_code, {region} AS region_id, {SLOT_KEYS},
                {level} AS level, {sums(MEASURES)} FROM areas GROUP BY ALL"""
                for level, nbhd, region in (
                    (1, "NULL::INTEGER", "NULL::INTEGER"),
                    (2, "neighborhood_code", "NULL::INTEGER"),
                    (3, "neighborhood_code", "region_id"),
                )
            ),
            "areas",
        ),
        "net_flow_between_boroughs": sql(f"SELECT {net} FROM net_boro", "net_boro"),
        "typical_week_tract": sql("SELECT * FROM week_tract", "week_tract"),
        "typical_week_neighborhood": sql("SELECT * FROM week_nbhd", "week_nbhd"),
        "typical_week_borough": sql("SELECT * FROM week_boro", "week_boro"),
        "flow_patterns": sql(
            " UNION ALL ".join(
                f"""SELECT {', '.join(k if k in keys else f'NULL::INTEGER AS {k}' for k in pattern_keys)},
                '{name}' AS pattern, {means(MEASURES)} FROM net_coarse GROUP BY {', '.join(keys)}"""
                for name, keys in patterns
            ),
            "net_coarse",
        ),
        "map_frames_tract": sql(_frames("week_net", "region_id", 1.0), "codes", "week_net"),
        "map_frames_borough": sql(_frames("week_boro_net", "borough_code", 2.0), "codes", "week_boro_net"),
        "dense_tract_totals": sql(
            f"""SELECT t AS region_id, CAST(coalesce(s, 0) AS BIGINT) AS net_trips_in, printf('%04d', t) AS region_label
            FROM (SELECT unnest(range(1, {standins.N_TRACTS + 7})) AS t) q
            LEFT JOIN (SELECT region_id, sum(net_trips_in) AS s FROM net_tract GROUP BY ALL) n ON n.region_id = t""",
            "net_tract",
        ),
        "net_bounds": sql(
            """SELECT min(net_trips_in) AS low, max(net_trips_in) AS high, max(abs(net_trips_in)) AS max_abs
            FROM week_net WHERE weekday = 2""",
            "week_net",
        ),
        "net_quantiles": sql(
            _quantiles("(SELECT * FROM week_net WHERE weekday = 2) m", "net_trips_in", {"q01": 0.01, "q99": 0.99}, None),
            "week_net",
        ),
        "fare_rate_quantiles": sql(
            _quantiles("clean", "fare_rev_per_hour", {**registry.QUARTILES, "q01": 0.01, "q99": 0.99}, None), "clean"
        ),
        "fare_rate_quantiles_by_weekday": sql(
            _quantiles(
                f"(SELECT {part('weekday', 'pickup_datetime')} AS weekday, fare_rev_per_hour FROM clean) t",
                "fare_rev_per_hour",
                registry.QUARTILES,
                "weekday",
            ),
            "clean",
        ),
        "raster_hour_bins": sql("SELECT * FROM rides", "rides"),
        "fare_rate_grid": sql(_fare_map(f"{mean('fare_rev_per_hour')} AS fare_rev_per_hour"), "usual"),
        "passenger_grid": sql(_fare_map("CAST(sum(passenger_count) AS BIGINT) AS passenger_count"), "usual"),
        "fare_rate_weekly": sql(
            f"""SELECT {part('weekday', 'pickup_datetime')} AS pickup_weekday,
            {part('hour', 'pickup_datetime')} AS pickup_hour, {means(('fare_rev_per_hour',))} FROM usual GROUP BY ALL""",
            "usual",
        ),
        "fare_rate_monthly": sql(
            f"""SELECT {part('month', 'pickup_datetime')} AS pickup_month,
            {part('hour', 'pickup_datetime')} AS pickup_hour, {means(('fare_rev_per_hour',))} FROM usual GROUP BY ALL""",
            "usual",
        ),
        "fare_rate_density": sql(_density(), "usual"),
        "log_fare_rate_density": sql(_fitted_density("ln(fare_rev_per_hour)", "fare_rev_per_hour > 0"), "clean"),
        "passenger_density": sql(_fitted_density("passenger_count::DOUBLE", "true"), "clean"),
        "point_density_2d": sql(_smooth(), "clean"),
        "trip_time_distribution": sql(
            _quantiles(
                "(SELECT pickup_region AS pickup_tract_id, trip_time FROM tract) t",
                "trip_time",
                registry.QUARTILES,
                "pickup_tract_id",
            ),
            "tract",
        ),
        "fare_distribution": sql(
            _quantiles(
                "(SELECT pickup_region AS pickup_tract_id, fare_amount FROM tract) t",
                "fare_amount",
                registry.QUARTILES,
                "pickup_tract_id",
            ),
            "tract",
        ),
        "fare_by_region_and_rain": sql(
            f"""SELECT pickup_region AS pickup_tract_id, precipitation > 1 AS wet, {means(('fare_amount', 'trip_time'))}
            FROM tract t LEFT JOIN hourly w ON w.year = year(t.pickup_datetime) AND w.month = month(t.pickup_datetime)
            AND w.day = day(t.pickup_datetime) AND w.hour = hour(t.pickup_datetime) GROUP BY ALL""",
            "tract",
            "hourly",
        ),
        "duplicate_trips": sql(
            f"""SELECT trip_id, fare_amount, copies FROM (SELECT trip_id, fare_amount,
            count(*) OVER (PARTITION BY trip_id) AS copies FROM {copies}) q WHERE copies > 1""",
            "trips",
        ),
        "unique_key_check": sql(
            f"SELECT trip_id, count(*) AS n FROM {copies} GROUP BY trip_id HAVING count(*) > 1", "trips"
        ),
        "busiest_region": sql(
            """SELECT pickup_grid, n FROM (SELECT pickup_region AS pickup_grid, count(*) AS n,
            rank() OVER (ORDER BY count(*) DESC) AS rk FROM coarse WHERE pickup_region <> 0 GROUP BY ALL) q WHERE rk = 1""",
            "coarse",
        ),
        "sample_trips": sql(
            f"""SELECT trip_id, trip_time, fare_amount FROM trips
            ORDER BY ((trip_id % 2147483648) * 2654435761 + 12345) % 4294967296, trip_id LIMIT {registry.SAMPLE_SIZE}""",
            "trips",
        ),
        "weather_cross_cells": sql(
            f"""SELECT h.*, CAST(c AS INTEGER) AS pickup_cell FROM hourly h
            CROSS JOIN (SELECT unnest(range(1, {registry.CROSS_CELLS + 1})) AS c) q""",
            "hourly",
        ),
        "rides_with_weather": sql(
            """SELECT r.*, temperature, coalesce(precipitation, 0.0::DOUBLE) AS precipitation, windspeed FROM rides r
            LEFT JOIN (SELECT * RENAME (day AS pickup_day, hour AS pickup_hour) FROM hourly) w
            USING (year, month, pickup_day, pickup_hour)""",
            "rides",
            "hourly",
        ),
        "trip_time_network": sql(
            "SELECT count(*) AS trips, count(*) AS estimates, true AS below_variance, true AS falling FROM trips WHERE trip_time < 2",
            "trips",
        ),
        "ride_regression": sql(
            f"SELECT {RIDE_KEYS}, rides, round(y_hat, 5) AS rides_hat, round(rides - y_hat, 5) AS rides_resid FROM plain_all",
            "plain_all",
        ),
        "ride_regression_dependent": sql(
            f"SELECT {RIDE_KEYS}, rides, round(y_hat, 5) AS rides_hat, round(rides - y_hat, 5) AS rides_resid FROM plain_all",
            "plain_all",
        ),
        "log_ride_regression": sql(
            f"""SELECT {RIDE_KEYS}, rides, round(exp(y_hat), 5) AS rides_hat,
            round(exp(ln(rides::DOUBLE) - y_hat), 5) AS rides_resid FROM logged_all""",
            "logged_all",
        ),
        "regression_residuals_daily": sql(_residual_means("day"), "plain_all"),
        "regression_residuals_hourly": sql(_residual_means("hour"), "plain_all"),
        "ride_regression_totals": sql(
            "SELECT input, level, round(sum(rides * x), 2) AS rides_hat, count(*) AS n FROM ("
            + " UNION ALL ".join(
                f"SELECT '{name}' AS input, {level} AS level, {x} AS x, rides FROM coarse_rides "
                "WHERE temperature IS NOT NULL AND precipitation IS NOT NULL"
                for name, level, x in [
                    *((f, f"CAST({f} AS BIGINT)", "1.0::DOUBLE") for f in ("month", "weekday", "pickup_hour", "pickup_cell")),
                    *((c, "NULL::BIGINT", c) for c in ("temperature", "precipitation")),
                ]
            )
            + ") t GROUP BY ALL",
            "coarse_rides",
        ),
        "ride_regression_on_hour": sql(
            """SELECT pickup_cell, pickup_day, pickup_hour, rides,
            round(avg(rides) OVER (PARTITION BY pickup_hour), 6) AS rides_hat FROM coarse_rides""",
            "coarse_rides",
        ),
        "ride_regression_on_wind": sql(
            """SELECT pickup_cell, pickup_day, pickup_hour, rides,
            round(a + b * windspeed, 6) AS rides_hat FROM coarse_rides,
            (SELECT regr_slope(rides, windspeed) AS b, regr_intercept(rides, windspeed) AS a FROM coarse_rides) f""",
            "coarse_rides",
        ),
        "grid_graph": sql("SELECT src, dst FROM grid_edges", "grid_edges"),
        "land_graph": sql("SELECT src, dst FROM land_edges", "land_edges"),
        "dissolved_boroughs": sql(
            """SELECT borough_code AS region_id, round(area, 9) AS area, sides, round(outline, 9) AS outline FROM
            (SELECT borough_code, sum(area) AS area FROM (
               SELECT s.region_id, abs(sum(ax * b_y - bx * ay)) / 2 AS area FROM sides s GROUP BY 1) a
             JOIN codes USING (region_id) GROUP BY 1) x
            JOIN (SELECT borough_code, count(*) AS sides, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS outline
              FROM (SELECT borough_code, x1, y1, x2, y2 FROM edges JOIN codes USING (region_id)
                    GROUP BY ALL HAVING count(*) = 1) e GROUP BY 1) y USING (borough_code)""",
            "sides",
            "edges",
            "codes",
        ),
        "borough_assign": sql(
            f"""SELECT t.trip_id, CASE WHEN {fine_cell['pickup']} IS NOT NULL THEN c.borough_code END AS pickup_borough
            FROM trips t LEFT JOIN hit_pickup p USING (trip_id) LEFT JOIN codes c USING (region_id)""",
            "trips",
            "hit_pickup",
            "codes",
        ),
        "two_layer_land_graph": sql("SELECT src, dst FROM land_edges", "land_edges"),
        "bridged_graph": sql("SELECT src, dst FROM roads", "roads"),
        "graph_degree": sql("SELECT dst AS cell_id, count(*) AS degree FROM roads GROUP BY ALL", "roads"),
        "edge_segments": sql(
            f"""SELECT src, dst, {p1[0]} AS p1_lon, {p1[1]} AS p1_lat, {p2[0]} AS p2_lon, {p2[1]} AS p2_lat
            FROM roads WHERE src < dst""",
            "roads",
        ),
        "split_field": sql(
            f"""SELECT cell_id, CASE WHEN (cell_id - 1) % {GRID.n} < {GRID.n // 2} THEN 10.0::DOUBLE
            ELSE -10.0::DOUBLE END AS value FROM used""",
            "used",
        ),
        "diffusion_steps": sql(
            " UNION ALL ".join(
                f"SELECT {k} AS step, cell_id, round(value, 6) AS value FROM s{k}"
                for k in range(registry.DIFFUSION_STEPS + 1)
            ),
            *[f"s{k}" for k in range(registry.DIFFUSION_STEPS + 1)],
        ),
        "diffusion_convergence": sql(
            " UNION ALL ".join(
                f"""SELECT CAST({k} AS INTEGER) AS step, round(max(abs(b.value - a.value)), 8) AS largest,
                round(avg(abs(b.value - a.value)), 8) AS mean FROM s{k - 1} a JOIN s{k} b USING (cell_id)"""
                for k in range(1, registry.DIFFUSION_STEPS + 1)
            ),
            *[f"s{k}" for k in range(registry.DIFFUSION_STEPS + 1)],
        ),
        "repair_lines": sql(
            _raw_output("trips") + " WHERE trip_id % 53 <> 0 AND trip_id % 59 <> 0 AND trip_id % 61 <> 0 AND trip_id % 67 <> 0",
            "trips",
        ),
        "rejected_line_counts": sql(
            """SELECT CAST(CASE WHEN trip_id % 59 = 0 THEN 17 ELSE 19 END AS INTEGER) AS fields, count(*) AS lines
            FROM trips WHERE trip_id % 53 <> 0 AND (trip_id % 59 = 0 OR trip_id % 61 = 0) GROUP BY ALL""",
            "trips",
        ),
        "canonical_headers": sql(_raw_output("trips"), "trips"),
        "header_survey": sql(
            """SELECT CAST(18 + CASE WHEN g = 1 THEN 0 ELSE 1 END AS INTEGER) AS width,
            CASE g WHEN 1 THEN 'g1_col01 g1_col02' WHEN 2 THEN 'V1 g2_col01' ELSE 'g3_col01 g3_col02' END AS names,
            min(m) AS first_month, max(m) AS last_month, count(DISTINCT m) AS months
            FROM (SELECT trip_id % 3 + 1 AS g, strftime(pickup_datetime, '%Y-%m') AS m FROM trips) t GROUP BY g""",
            "trips",
        ),
        "raw_files_net_flow": sql(f"SELECT {net} FROM net_coarse", "net_coarse"),
        "manifest_parts": """SELECT DISTINCT 'https://example.org/data/' || strftime(o_orderdate, '%Y/tripdata_%Y-%m.csv') AS url,
            strftime(o_orderdate, 'tripdata_%Y-%m.csv') AS file_name, CAST(year(o_orderdate) AS INTEGER) AS year,
            CAST(month(o_orderdate) AS INTEGER) AS month FROM orders""",
        "weather_from_pages": _pages(),
        "partitioned_round_trip": sql(
            " UNION ALL ".join(
                f"""SELECT {e}_region AS region_id, {part('year', 'pickup_datetime')} AS pickup_year,
                {part('month', 'pickup_datetime')} AS pickup_month, count(*) AS trips, '{e}' AS led_by
                FROM tract GROUP BY ALL"""
                for e in ("pickup", "dropoff")
            ),
            "tract",
        ),
        "monthly_tree": sql(
            " UNION ALL ".join(
                f"""SELECT {e}_region AS region_id, {part('year', 'pickup_datetime')} AS pickup_year,
                {part('month', 'pickup_datetime')} AS pickup_month, count(*) AS trips,
                CAST(sum(passenger_count) AS BIGINT) AS passengers, '{e}' AS led_by FROM rerun GROUP BY ALL"""
                for e in ("pickup", "dropoff")
            ),
            "rerun",
        ),
        "trips_of_region": sql(
            f"""SELECT CASE WHEN pickup_region = {registry.ONE_TRACT} THEN 'pickup' ELSE 'dropoff' END AS led_by,
            pickup_region AS pickup_tract_id, dropoff_region AS dropoff_tract_id, pickup_datetime, dropoff_datetime, fare_amount
            FROM rerun WHERE pickup_region = {registry.ONE_TRACT} OR dropoff_region = {registry.ONE_TRACT}""",
            "rerun",
        ),
        "csv_results": sql(f"SELECT {net} FROM net_coarse", "net_coarse"),
        "sql_filter": sql(f"SELECT {net} FROM net_coarse WHERE weekday = 1", "net_coarse"),
        "slot_labels": sql(
            f"""SELECT {labels} AS label, printf('%05d', region_id) AS region_label,
            CAST(sum(trips_out) AS BIGINT) AS trips_out FROM net_coarse GROUP BY ALL""",
            "net_coarse",
        ),
    }
    return out
