"""Itineraries: legs, day schedules, tours, and multi-day trips.

Legs and single schedules are Catalyst expressions. Tours and the balancing of a
trip's days depend on every earlier choice, so a trip is planned in one grouped
call over matrices of its (few) places; trips run in parallel. Within a trip all
moves that a choice has are scored at once, as rows of arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import EARTH_KM, HYBRID_WALK_KM, MODES, haversine_km, leg_minutes, profiles
from .cluster import zone_labels

# Fixed values.
FOOD = "food"
MEAL_TRAVEL, MEAL_WINDOW, MEAL_NEAR, MEAL_TRIES, MEAL_DROPS = 0.25, 2.0, 1.25, 5, 2
VISIT_MINUTES, OPEN_HOUR, CLOSE_HOUR = 60, 0, 24
#: Stops that a row of a point names, on average, and groups that a trip's rows are dealt into.
SPOT, PARTS = 256, 16
#: Places up to which a trip keeps all distances; with more they are worked out as they are asked for.
KEPT_PLACES = 1024


# ---------------------------------------------------------------- expressions


def legs(stops: DataFrame, mode: Column, matrix: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """trip_id, src, dst, km, minutes of every two stops of a trip, both ways.

    matrix: optional trip_id, src, dst, profile (car, foot), km, minutes measured
    on roads. It is used for a trip only if no leg of a needed profile is
    missing; otherwise all its legs are great circles. A leg on roads gets the
    mode's overhead on top; hybrid chooses by the distance on foot. digits: to
    which km and minutes are rounded, if at all. mode may depend on the trip.
    """
    if matrix is None:
        return _line_legs(stops, mode, digits)
    a = stops.select("trip_id", F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = stops.select("trip_id", F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = a.join(b, "trip_id").where("src <> dst")
    line = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    pairs = pairs.select("trip_id", "src", "dst", line.alias("line_km"), mode.alias("mode"))
    for p in ("car", "foot"):
        part = matrix.where(F.col("profile") == p).select("trip_id", "src", "dst", F.col("km").alias(f"{p}_km"), F.col("minutes").alias(f"{p}_min"))
        pairs = pairs.join(part, ["trip_id", "src", "dst"], "left")
    has = lambda p: F.col(f"{p}_km").isNotNull() & F.col(f"{p}_min").isNotNull()
    needed = F.when(F.col("mode") == "driving", has("car")).when(F.col("mode") == "hybrid", has("car") & has("foot")).otherwise(has("foot"))
    whole = pairs.groupBy("trip_id").agg(F.min(needed.cast("int")).alias("whole"))
    drive = (F.col("mode") == "driving") | ((F.col("mode") == "hybrid") & (F.col("foot_km") > HYBRID_WALK_KM))
    road_km = F.when(drive, F.col("car_km")).otherwise(F.col("foot_km"))
    road_min = F.when(drive, F.col("car_min") + F.lit(MODES["driving"][1])).otherwise(F.col("foot_min") + F.lit(MODES["walking"][1]))
    roads = F.col("whole") == 1
    shown = lambda c: c if digits is None else F.round(c, digits)
    return pairs.join(whole, "trip_id").select("trip_id", "src", "dst", shown(F.when(roads, road_km).otherwise(F.col("line_km"))).alias("km"), shown(F.when(roads, road_min).otherwise(leg_minutes(F.col("line_km"), F.col("mode")))).alias("minutes"), roads.alias("on_roads"))


def _line_legs(stops: DataFrame, mode: Column, digits: int | None = None) -> DataFrame:
    """legs on great circles: worked out, and rounded, once for two points, however many stops of a trip lie there."""
    at = ["trip_id", "lat", "lon"]
    sizes = stops.groupBy(*at).agg(F.count("*").alias("n"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"z.{c}")) for c in at]
    # Stops of one point lie in rows of about SPOT, and a trip's rows in PARTS groups, each of which meets all rows of the trip.
    part = F.pmod(F.xxhash64("s.id"), F.ceil(F.col("z.n") / F.lit(SPOT)))
    rows = stops.alias("s").join(sizes.alias("z"), same).groupBy("s.trip_id", "s.lat", "s.lon", part.alias("part")).agg(F.collect_list("s.id").alias("ids"))
    a = rows.select("trip_id", F.col("ids").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.pmod(F.xxhash64("lat", "lon", "part"), F.lit(PARTS)).alias("deal"))
    b = rows.select("trip_id", F.col("ids").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("deal"))
    shown = lambda c: c if digits is None else F.round(c, digits)
    # Few small rows make very many legs, so their groups must not be put together by size.
    tasks = int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (side.repartition(tasks, "trip_id", "deal") for side in (a, b))
    pairs = a.join(b.hint("merge"), ["trip_id", "deal"]).select("trip_id", "src", "dst", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"), mode.alias("mode"))
    pairs = pairs.select("trip_id", "src", "dst", shown(F.col("km")).alias("km"), shown(leg_minutes(F.col("km"), F.col("mode"))).alias("minutes"))
    return pairs.withColumn("src", F.explode("src")).withColumn("dst", F.explode("dst")).where("src <> dst").select("trip_id", "src", "dst", "km", "minutes", F.lit(False).alias("on_roads"))


def within_budget(candidates: DataFrame, most_price: str = "most_price") -> DataFrame:
    """Candidates up to the trip's price level; all of them where none is."""
    ok = F.col("price_level") <= F.col(most_price)
    any_ok = candidates.groupBy("trip_id").agg(F.max(ok.cast("int")).alias("any_ok"))
    return candidates.join(any_ok, "trip_id").where(ok | (F.coalesce("any_ok", F.lit(0)) == 0)).drop("any_ok")


def closes_at(open_hour: Column, close_hour: Column) -> Column:
    """An end before the start lies past midnight, which no day reaches: 24."""
    return F.when(close_hour < open_hour, F.lit(24.0)).otherwise(close_hour.cast("double"))


def open_at(hour: Column, open_hour: Column, close_hour: Column) -> Column:
    a, b = F.coalesce(open_hour, F.lit(OPEN_HOUR)), F.coalesce(close_hour, F.lit(CLOSE_HOUR))
    return (hour >= a) & (hour < closes_at(a, b))


def schedule(stops: Column, start: float, budget: float, mode: str) -> Column:
    """Times ordered stops by a fold over the array.

    stops: array of struct(id, lat, lon, visit, open, close) in visiting order.
    A stop that is closed by arrival, or ends past the budget, is passed over and
    moves neither clock nor place; an early arrival waits. Returns struct(clock,
    km, kept): kept is an array of struct(id, arrival, finish).
    """
    kept_type = "array<struct<id:bigint,arrival:double,finish:double>>"
    zero = F.struct(F.lit(start).alias("clock"), F.lit(0.0).alias("km"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array().cast(kept_type).alias("kept"))

    def step(acc, s):
        km = F.coalesce(haversine_km(acc["lat"], acc["lon"], s["lat"], s["lon"]), F.lit(0.0))
        travel = F.when(acc["lat"].isNull(), F.lit(0.0)).otherwise(leg_minutes(km, F.lit(mode)))
        a, b = F.coalesce(s["open"], F.lit(OPEN_HOUR)), F.coalesce(s["close"], F.lit(CLOSE_HOUR))
        there = acc["clock"] + travel / F.lit(60.0)
        arrival = F.greatest(there, a.cast("double"))
        finish = arrival + F.coalesce(s["visit"], F.lit(VISIT_MINUTES)) / F.lit(60.0)
        fits = (there < closes_at(a, b)) & ((finish - F.lit(start)) * F.lit(60.0) <= budget)
        took = F.struct(s["id"].cast("bigint").alias("id"), arrival.alias("arrival"), finish.alias("finish"))
        return F.when(fits, F.struct(finish.alias("clock"), (acc["km"] + km).alias("km"), s["lat"].alias("lat"), s["lon"].alias("lon"), F.concat(acc["kept"], F.array(took)).alias("kept"))).otherwise(acc)

    return F.aggregate(stops, zero, step, lambda acc: F.struct(acc["clock"].alias("clock"), acc["km"].alias("km"), acc["kept"].alias("kept")))


# -------------------------------------------------------------------- kernels


def line_matrix(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p)[:, None] * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


class Lines:
    """As line_matrix, indexed by rows or by rows and columns, but worked out when asked for. apart: a place at no distance from any."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, apart: int | None = None, of: Callable[[np.ndarray], np.ndarray] = lambda km: km):
        self.p, self.q, self.apart, self.of = np.radians(lat), np.radians(lon), apart, of
        self.c = np.cos(self.p)

    def __getitem__(self, at) -> np.ndarray:
        i, j = at if isinstance(at, tuple) else (np.asarray(at)[..., None], np.arange(len(self.p)))
        h = np.sin((self.p[i] - self.p[j]) / 2) ** 2 + self.c[i] * self.c[j] * np.sin((self.q[i] - self.q[j]) / 2) ** 2
        found = self.of(2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h))))
        return found if self.apart is None else np.where((np.asarray(i) == self.apart) | (np.asarray(j) == self.apart), 0.0, found)


def minutes_matrix(km: np.ndarray, mode: str) -> np.ndarray:
    by = {m: km / v * 60 + extra for m, (v, extra, _) in MODES.items()}
    if mode == "hybrid":
        return np.where(km <= HYBRID_WALK_KM, by["walking"], by["driving"])
    return by.get(mode, by["walking"])


def road_matrices(n: int, legs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], mode: str) -> tuple[np.ndarray, np.ndarray] | None:
    """km and minutes between n places by the mode; None if a leg of a needed profile is missing.

    legs: profile -> (from, to, km, minutes), places by number. Hybrid chooses each leg by its length on foot.
    """
    parts = {}
    for profile in profiles(mode):
        km, minutes = np.full((n, n), np.nan), np.full((n, n), np.nan)
        a, b, x, y = legs.get(profile, (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0)))
        km[a, b], minutes[a, b] = x, y
        for m in (km, minutes):
            np.fill_diagonal(m, 0.0)
        if n < 2 or np.isnan(km).any() or np.isnan(minutes).any():
            return None
        parts[profile] = km, minutes + next(extra for _, extra, p in MODES.values() if p == profile)
    if len(parts) == 1:
        return next(iter(parts.values()))
    drive = parts["foot"][0] > HYBRID_WALK_KM
    return np.where(drive, parts["car"][0], parts["foot"][0]), np.where(drive, parts["car"][1], parts["foot"][1])


def nearest_tours(km: np.ndarray, stops: np.ndarray, origin: int) -> np.ndarray:
    """Each row's stops, always on to the nearest left (the earlier in the row on a tie), from the origin. -1 ends a row."""
    rows = np.arange(len(stops))
    left, here = stops >= 0, np.full(len(stops), origin)
    out = np.full_like(stops, -1)
    for k in range(stops.shape[1]):
        place = np.where(left, km[here[:, None], stops], np.inf).argmin(1)
        some = left[rows, place]
        out[some, k] = stops[rows, place][some]
        left[rows, place] = False
        here = np.where(some, out[:, k], here)
    return out


def reversal_gains(km: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """gains[path, i, j]: what a path gains by running from i to j the other way round, for 0 < i < j.

    The two legs at the ends change, and all legs between change direction: their
    two lengths come from prefix sums, so a matrix needn't be symmetric.
    """
    legs = km[paths[:, :, None], paths[:, None, :]]
    there, back = np.diagonal(legs, 1, 1, 2), np.diagonal(legs, -1, 1, 2)
    turned = np.zeros(paths.shape)
    turned[:, 1:] = np.cumsum(there, axis=1) - np.cumsum(back, axis=1)
    gains = np.zeros(legs.shape)
    gains[:, 1:] = there[:, :, None] - legs[:, :-1]
    # The last node has no leg behind it.
    gains[:, :, 1:-1] += there[:, None, 1:] - legs[:, :, 2:]
    return gains + (turned[:, None, :] - turned[:, :, None])


def shorten_paths(km: np.ndarray, paths: np.ndarray, fixed: int = 1) -> np.ndarray:
    """2-opt on many paths of one length whose first `fixed` nodes stay.

    Each path takes the first gain behind the one that it took last, by i and
    then j, and starts over at the end, until a whole round has found none.
    """
    paths, n = paths.copy(), paths.shape[1]
    i, j = np.triu_indices(n, 1)
    i, j = i[i >= fixed], j[i >= fixed]
    place, active = np.arange(n), np.arange(len(paths))
    last, moved = np.full(len(paths), -1), np.zeros(len(paths), bool)
    while len(active) and len(i):
        gains = reversal_gains(km, paths[active])[:, i, j] > 1e-9
        ahead = gains & (np.arange(len(i)) > last[active, None])
        hit = ahead.any(1)
        move, take = active[hit], ahead.argmax(1)[hit]
        a, b = i[take, None], j[take, None]
        paths[move] = np.take_along_axis(paths[move], np.where((place >= a) & (place <= b), a + b - place, place), 1)
        last[move], moved[move] = take, True
        # Whoever found nothing ahead is done, or goes round once more if this round has moved it.
        ended = active[~hit]
        again = ended[moved[ended]]
        last[again], moved[again] = -1, False
        active = np.concatenate([move, again])
    return paths


def shorten_path(km, path: np.ndarray, fixed: int = 1) -> np.ndarray:
    """As shorten_paths for one path and distances that are the same both ways, row by row, so nothing grows with the square of the path."""
    path, n = np.array(path), len(path)
    last, moved = (fixed, fixed), False
    while n - fixed > 1:
        # The first gain behind the last one, by i and then j.
        i, j = last
        while i < n - 1:
            ends = path[j + 1 :]
            first = n - len(ends)
            gains = (km[path[i - 1], path[i]] - km[path[i - 1], ends]) if len(ends) else np.empty(0)
            if len(gains) > 0:
                after = np.zeros(len(gains))
                after[:-1] = km[ends[:-1], ends[1:]] - km[path[i], ends[1:]]
                hit = np.flatnonzero(gains + after > 1e-9)
                if len(hit):
                    j = first + int(hit[0])
                    break
            i, j = i + 1, i + 1
        if i < n - 1:
            path[i : j + 1] = path[i : j + 1][::-1].copy()
            last, moved = (i, j), True
        elif moved:
            last, moved = (fixed, fixed), False
        else:
            break
    return path


def nearest_tour(km: np.ndarray, stops: list[int], hub: int | None = None) -> list[int]:
    """From the hub, or else the first stop, always on to the nearest left."""
    first = [] if hub is not None or not len(stops) else [stops[0]]
    rest = np.array([list(stops)[len(first) :]], int)
    return [*first, *nearest_tours(km, rest, first[0] if first else hub)[0].tolist()] if rest.size else first


def shorten(km: np.ndarray, tour: list[int], hub: int | None = None) -> list[int]:
    """2-opt on one path whose start, the hub or else the first stop, is fixed."""
    path = np.array([[*([] if hub is None else [hub]), *tour]], int)
    return shorten_paths(km, path)[0, 0 if hub is None else 1 :].tolist()


@dataclass
class Day:
    number: int
    stops: list[int] = field(default_factory=list)
    times: list[tuple[float, float]] = field(default_factory=list)
    km: float = 0.0
    minutes: int = 0


@dataclass
class Walks:
    """Orders, a row each, walked through at once: which stops were kept, and when."""

    orders: np.ndarray
    kept: np.ndarray
    arrival: np.ndarray
    finish: np.ndarray
    km: np.ndarray
    minutes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.kept.sum(1)

    def day(self, row: int, number: int) -> Day:
        on = self.kept[row]
        times = list(zip(self.arrival[row, on].tolist(), self.finish[row, on].tolist(), strict=True))
        return Day(number, self.orders[row, on].tolist(), times, round(float(self.km[row]), 2), int(self.minutes[row]))


class Trip:
    """A trip's places as arrays, and its days.

    places: columns lat, lon, visit, open, close, category; nulls take the
    defaults. km and minutes: matrices over the places (and the hub, which comes
    last); great circles if not given. The day's origin is the hub; without one,
    a place at no distance from any. Sets and orders of stops are rows of
    integers, -1 behind their end, and are judged many at once.
    """

    def __init__(self, places: pd.DataFrame, mode: str = "walking", hub: tuple[float, float] | None = None, start: float = 9.0, heed_hours: bool = True, km: np.ndarray | None = None, minutes: np.ndarray | None = None):
        column = lambda c, default: np.append((places[c] if c in places else pd.Series(np.nan, places.index)).fillna(default).to_numpy(float), default)
        self.n, self.start, self.heed_hours, self.has_hub = len(places), start, heed_hours, hub is not None
        self.on_roads, self.two_opt = km is not None and minutes is not None, True
        if not self.on_roads:
            lat, lon = column("lat", np.nan), column("lon", np.nan)
            if hub is not None:
                lat[-1], lon[-1] = hub
            far = self.n > KEPT_PLACES
            km = None if far else line_matrix(lat, lon)
            minutes = None if far else minutes_matrix(km, mode)
        size = self.n + 1
        if km is None:
            apart = None if self.has_hub else self.n
            self.km, self.minutes = Lines(lat, lon, apart), Lines(lat, lon, apart, lambda x: minutes_matrix(x, mode))
        else:
            self.km, self.minutes = np.zeros((size, size)), np.zeros((size, size))
            known = size if self.has_hub else self.n
            self.km[:known, :known], self.minutes[:known, :known] = km[:known, :known], minutes[:known, :known]
        self.visit, self.opens, closes = column("visit", VISIT_MINUTES), column("open", OPEN_HOUR), column("close", CLOSE_HOUR)
        self.closes = np.where(closes < self.opens, 24.0, closes)
        self.food = np.append((places["category"] == FOOD).to_numpy(bool), False) if "category" in places else np.zeros(size, bool)
        #: Kilometres around each place within which every venue is known, and whether no unknown one could have served better.
        self.reach, self.settled = np.full(size, np.inf), True

    def know_venues(self, searched: np.ndarray, reach: np.ndarray) -> None:
        """All venues within `reach` of the places `searched` are known, and so all within what is left of it around any other place."""
        if not self.on_roads and len(searched):
            self.reach = np.zeros(self.n + 1)
            for at, far in zip(searched, reach, strict=True):
                self.reach = np.maximum(self.reach, far - self.km[at])
            if not self.has_hub:
                self.reach[self.n] = 0.0

    def walk(self, orders: np.ndarray, budget: float) -> Walks:
        """Walks each order, passing over what is closed or doesn't fit."""
        m, width = orders.shape
        here, clock, km = np.full(m, self.n), np.full(m, float(self.start)), np.zeros(m)
        kept, arrivals, finishes = np.zeros((m, width), bool), np.zeros((m, width)), np.zeros((m, width))
        for k in range(width):
            s = orders[:, k]
            arrival = clock + self.minutes[here, s] / 60
            fits = s >= 0
            if self.heed_hours:
                fits &= arrival < self.closes[s]
                arrival = np.maximum(arrival, self.opens[s])
            finish = arrival + self.visit[s] / 60
            fits &= (finish - self.start) * 60 <= budget
            km += np.where(fits, self.km[here, s], 0.0)
            kept[:, k], arrivals[:, k], finishes[:, k] = fits, arrival, finish
            clock, here = np.where(fits, finish, clock), np.where(fits, s, here)
        return Walks(orders, kept, arrivals, finishes, km, ((clock - self.start) * 60).astype(int))

    def solve_all(self, sets: np.ndarray, budget: float) -> Walks:
        """Each set by its nearest-neighbour tour, shortened; sets of one length go together."""
        out = np.full_like(sets, -1)
        lengths = (sets >= 0).sum(1)
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            paths = np.column_stack([np.full(len(at), self.n), nearest_tours(self.km, sets[at, :n], self.n)])
            out[at, :n] = (shorten_paths(self.km, paths, 1 if self.has_hub else 2) if self.two_opt else paths)[:, 1:]
        return self.walk(out, budget)

    def time(self, order: list[int], budget: float, number: int = 0) -> Day:
        return self.walk(np.array([order], int).reshape(1, -1), budget).day(0, number)

    def solve(self, stops: list[int], budget: float, number: int = 0) -> Day:
        return self.solve_all(np.array([stops], int).reshape(1, -1), budget).day(0, number)

    def _grown(self, day: Day, more: np.ndarray, budget: float) -> Walks:
        """The day with each of the stops in turn."""
        return self.solve_all(np.column_stack([np.tile(np.array(day.stops, int), (len(more), 1)), more]), budget)

    def _far(self, day: Day, stops: np.ndarray) -> np.ndarray:
        return self.km[day.stops[-1] if day.stops else self.n, stops]

    def fill(self, days: list[Day], spare: list[int], budget: float) -> list[int]:
        """Spends unused places on days that gain a stop by them: the emptiest day first, its nearest place first. Returns what is left.

        Every move of a day is scored once, and again only when the day has changed.
        """
        left, scored = np.array(spare, int), {}
        while len(left):
            moves = []
            for at, day in enumerate(days):
                if day.minutes >= budget:
                    continue
                if at not in scored:
                    walks = self._grown(day, left, budget)
                    scored[at] = dict(zip(left.tolist(), range(len(left)), strict=True)), walks, walks.counts > len(day.stops)
                row, _, gains = scored[at]
                rows = np.array([row[s] for s in left.tolist()])
                for rank, k in enumerate(np.argsort(self._far(day, left), kind="stable")):
                    if gains[rows[k]]:
                        moves.append((day.minutes, day.number, rank, at, int(k), int(rows[k])))
                        break
            if not moves:
                break
            *_, at, k, row = min(moves)
            days[at] = scored.pop(at)[1].day(row, days[at].number)
            left = np.delete(left, k)
        return left.tolist()

    def even_out(self, days: list[Day], budget: float) -> None:
        """Moves stops to the emptiest day while the squared minutes of the two days together fall: from the fullest day first, the nearest stop first."""
        while len(days) > 1:
            to = min(range(len(days)), key=lambda i: (days[i].minutes, days[i].number))
            poor = days[to]
            table = [(i, k) for i, d in enumerate(days) if i != to and len(d.stops) > 1 for k in range(len(d.stops))]
            if not table:
                return
            giver, seat = np.array(table).T
            stops = np.array([days[i].stops[k] for i, k in table])
            width = max(len(days[i].stops) for i in giver)
            others = np.full((len(table), width), -1)
            for r, (i, k) in enumerate(table):
                others[r, : len(days[i].stops) - 1] = days[i].stops[:k] + days[i].stops[k + 1 :]
            grown, rest = self._grown(poor, stops, budget), self.solve_all(others, budget)
            minutes = np.array([days[i].minutes for i in giver])
            better = (grown.counts > len(poor.stops)) & (rest.minutes.astype(float) ** 2 + grown.minutes.astype(float) ** 2 < minutes.astype(float) ** 2 + float(poor.minutes) ** 2)
            if not better.any():
                return
            order = np.lexsort((seat, self._far(poor, stops), [days[i].number for i in giver], -minutes))
            row = order[better[order]][0]
            days[giver[row]], days[to] = rest.day(row, days[giver[row]].number), grown.day(row, poor.number)

    # Meals

    def meal_reserve(self, meals: list[int], per_day: int, budget: float, typical: float | None = None) -> int:
        """Minutes kept back: the upper median meal (or the typical one given) and a quarter more for the way, at most half the day."""
        if per_day <= 0 or (not len(meals) and typical is None):
            return 0
        typical = np.sort(self.visit[meals])[len(meals) // 2] if typical is None else typical
        return int(min(per_day * typical * (1 + MEAL_TRAVEL), budget / 2))

    def meal_hours(self, budget: float, per_day: int) -> np.ndarray:
        return np.array([self.start + p * budget / 60 for p in meal_parts(per_day)])

    def detours(self, stops: list[int], seams: np.ndarray, venues: np.ndarray) -> np.ndarray:
        """Kilometres more by each venue (column) at each seam (row): seam i lies before stop i, the last one behind all."""
        path = np.array([self.n, *stops], int)
        before, last = path[seams], seams == len(stops)
        after = np.append(path[1:], self.n)[seams]
        way_on = np.where(last[:, None], 0.0, self.km[venues[None, :], after[:, None]] - self.km[before, after][:, None])
        return self.km[before[:, None], venues[None, :]] + way_on

    def _unknown_detour(self, stops: list[int], seams: np.ndarray) -> float:
        """The least kilometres that a venue which isn't known may cost at the seams."""
        path = np.array([self.n, *stops], int)
        before, last = path[seams], seams == len(stops)
        after = np.append(path[1:], self.n)[seams]
        return float(np.where(last, self.reach[before], self.reach[before] + self.reach[after] - self.km[before, after]).min())

    def feed(self, day: Day, hour: float, venues: np.ndarray, budget: float) -> Day | None:
        """The day with one meal more, near the hour if a seam is: the best of the cheapest detours, each tried as it is and without the last sights."""
        clocks = np.array([day.times[0][0] if day.times else hour, *(f for _, f in day.times)])
        seams = np.flatnonzero(np.abs(clocks - hour) <= MEAL_WINDOW)
        seams = seams if len(seams) else np.array([len(day.stops)])
        venues = venues[(self.opens[venues] <= hour) & (hour < self.closes[venues])]
        cost = self.detours(day.stops, seams, venues).ravel()
        orders, tries = [], np.argsort(cost, kind="stable")[:MEAL_TRIES]
        of = []
        for flat in tries:
            seam, venue = seams[flat // len(venues)], int(venues[flat % len(venues)])
            order = np.insert(np.array(day.stops, int), seam, venue)
            sights = np.flatnonzero(~self.food[order] & (order != venue))
            orders += [np.delete(order, sights[len(sights) - d :]) for d in range(min(MEAL_DROPS, len(sights)) + 1)]
            of += [flat] * (len(orders) - len(of))
        if not orders:
            self.settled &= self._unknown_detour(day.stops, seams) == np.inf
            return None
        table = np.full((len(orders), len(day.stops) + 1), -1)
        for r, order in enumerate(orders):
            table[r, : len(order)] = order
        walks = self.walk(table, budget)
        meals = (walks.kept & self.food[table]).sum(1)
        better = np.flatnonzero(meals > self.food[day.stops].sum())
        # What is taken, or the last try if nothing is, must be nearer than any venue that isn't known.
        last = cost[of[better[0]]] if len(better) else cost[tries[-1]] if len(tries) == MEAL_TRIES else np.inf
        self.settled &= bool(last == np.inf and self._unknown_detour(day.stops, seams) == np.inf or last < self._unknown_detour(day.stops, seams) - 1e-9)
        return walks.day(better[0], day.number) if len(better) else None

    def add_meals(self, days: list[Day], meals: list[int], per_day: int, budget: float) -> None:
        """Days get meals up to per_day, as venues and hours allow; a venue that has been placed serves no other day, also if it falls out later."""
        free = np.setdiff1d(np.array(meals, int), [s for d in days for s in d.stops])
        hours = self.meal_hours(budget, per_day)
        for at, day in enumerate(days):
            while True:
                eaten = np.array([t for s, (t, _) in zip(day.stops, day.times, strict=True) if self.food[s]])
                if len(eaten) >= per_day:
                    break
                # The first hour that no meal is near to, or else the one farthest from any.
                gaps = np.abs(hours[:, None] - eaten).min(1, initial=np.inf)
                uncovered = gaps > MEAL_NEAR
                grown = self.feed(day, hours[uncovered.argmax() if uncovered.any() else gaps.argmax()], free, budget)
                if grown is None:
                    break
                free = np.setdiff1d(free, grown.stops)
                days[at] = day = grown


def meal_parts(per_day: int) -> list[float]:
    """Where in a day's hours its meals lie, as parts."""
    return [0.40, 0.85][:per_day] if per_day <= 2 else [(i + 1) / (per_day + 1) for i in range(per_day)]


def plan_days(trip: Trip, zones: dict[int, list[int]], budget: float = 480, fill: bool = True, meals: list[int] = (), meals_per_day: int = 0, typical: float | None = None, keep_order: bool = False) -> list[Day]:
    """A day per zone, filled, evened out and fed; no zones, no days. keep_order: days go by their zone's order, and nothing moves between days."""
    meals = list(meals) if meals_per_day > 0 else []
    sights = budget - (trip.meal_reserve(meals, meals_per_day, budget, typical) if meals else 0)
    days = [(trip.time if keep_order else trip.solve)(zones[z], sights, z + 1) for z in sorted(zones)]
    if fill and days and not keep_order:
        placed = {s for d in days for s in d.stops}
        trip.fill(days, [s for z in sorted(zones) for s in zones[z] if s not in placed], sights)
        trip.even_out(days, sights)
    if meals:
        trip.add_meals(days, meals, meals_per_day, budget)
    return days


# ------------------------------------------------------------ grouped operators

ITINERARY = "trip_id long, day int, seq int, id long, arrival double, finish double, day_km double, day_minutes int, on_roads boolean, settled boolean"
#: Columns that a trip's own rows may set; the rest take the arguments.
OPTIONAL = {"role": "string", "hub_lat": "double", "hub_lon": "double", "days": "int", "budget": "double", "mode": "string", "typical_meal": "double", "reach": "double", "hub_reach": "double"}


def _legs_of(legs: pa.Table | None, ids: np.ndarray) -> dict:
    """profile -> (from, to, km, minutes) of a trip's legs, places by their number; legs of other places don't count."""
    if legs is None or not legs.num_rows:
        return {}
    frame = legs.to_pandas()
    order = np.argsort(ids, kind="stable")

    def number(column: str) -> np.ndarray:
        at = order[np.searchsorted(ids[order], frame[column]).clip(max=len(ids) - 1)]
        return np.where(ids[at] == frame[column], at, -1)

    a, b = number("src"), number("dst")
    known = (a >= 0) & (b >= 0)
    return {p: (a[w], b[w], frame["km"].to_numpy(float)[w], frame["minutes"].to_numpy(float)[w]) for p in ("car", "foot") for w in [np.flatnonzero(known & (frame["profile"] == p).to_numpy())]}


def itineraries(places: DataFrame, *, days: int = 3, budget: float = 480, mode: str = "walking", meals_per_day: int = 0, fill: bool = True, balanced: bool = True, start: float = 9.0, matrix: DataFrame | None = None, keep_order: bool = False, two_opt: bool = True) -> DataFrame:
    """Plans each trip: trip_id, day, seq, id, arrival, finish, day_km, day_minutes, on_roads, settled.

    places: trip_id, id, lat, lon, visit, open, close, category and, optionally,
    role (sight, meal or hub, whose row is where days start), hub_lat and hub_lon
    (the same without a row), days, budget and mode, which count instead of the
    arguments where they aren't null, and typical_meal, the minutes that a meal
    is reserved for (else the upper median of the trip's own venues). A trip has
    as many days as asked for but no more than sights; trips without sights have
    no rows. keep_order: stops are visited in the order of their ids. two_opt:
    whether tours are shortened.

    reach and hub_reach: where a trip's rows hold only some venues, the kilometres
    around a place (or the hub) within which they are all that there are. settled
    then says that no other venue would have come in; null reaches, and trips on
    roads, make no such claim and are settled.

    matrix: trip_id, src, dst, profile (car, foot), km, minutes measured on roads,
    as road_matrix gives them. A trip's legs meet its places in one group. They
    are used if none between its places (and hub) is missing in a profile that
    its mode needs; otherwise all its legs are great circles. Legs needn't be
    the same in both directions.
    """
    for name, kind in OPTIONAL.items():
        if name not in places.columns:
            places = places.withColumn(name, F.lit(None).cast(kind))
    names = [c.split()[0] for c in ITINERARY.split(", ")]

    def plan(table: pa.Table, legs: pa.Table | None = None) -> pa.Table:
        pdf = table.to_pandas().sort_values("id", kind="stable")
        pdf = pd.concat([pdf[pdf["role"] != "hub"], pdf[pdf["role"] == "hub"][:1]], ignore_index=True)
        own = lambda c, default: next(iter(pdf[c].dropna()), default)
        hub_row = bool(len(pdf)) and pdf["role"].iloc[-1] == "hub"
        body = pdf.iloc[:-1] if hub_row else pdf
        meal = (body["role"] == "meal").to_numpy()
        sights = np.flatnonzero(~meal)
        rows = []
        if len(sights):
            how, minutes = own("mode", mode), float(own("budget", budget))
            hub = (pdf["lat"].iloc[-1], pdf["lon"].iloc[-1]) if hub_row else None if pdf["hub_lat"].isna().all() else (float(own("hub_lat", 0)), float(own("hub_lon", 0)))
            # A hub that has no row has no legs either, so a trip that starts there stays on great circles.
            roads = road_matrices(len(pdf), _legs_of(legs, pdf["id"].to_numpy()), how) if hub_row or hub is None else None
            asked = pdf["days"].dropna()
            labels = zone_labels(body.loc[sights, ["lat", "lon"]].to_numpy(float), max(1, min(int(asked.max()) if len(asked) else days, len(sights))), balanced)
            zones = {int(z): sights[labels == z].tolist() for z in np.unique(labels)}
            trip = Trip(body, how, hub, start, True, *(roads or (None, None)))
            trip.two_opt = two_opt
            searched = np.flatnonzero(body["reach"].notna())
            known = body["reach"].to_numpy(float)[searched]
            if trip.has_hub and pdf["hub_reach"].notna().any():
                searched, known = np.append(searched, trip.n), np.append(known, own("hub_reach", 0.0))
            trip.know_venues(searched, known)
            venues = np.flatnonzero(meal | (body["category"] == FOOD).to_numpy()).tolist()
            typical = own("typical_meal", None)
            planned = plan_days(trip, zones, minutes, fill, venues, meals_per_day, None if typical is None else float(typical), keep_order)
            ids, key = body["id"].tolist(), body["trip_id"].iloc[0]
            rows = [(key, d.number, k, ids[s], *d.times[k - 1], d.km, d.minutes, trip.on_roads, trip.settled) for d in planned for k, s in enumerate(d.stops, 1)]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, _ARROW, strict=True))})

    grouped = places.select(F.col("trip_id").cast("long").alias("trip_id"), F.col("id").cast("long").alias("id"), "lat", "lon", "visit", "open", "close", "category", *OPTIONAL).groupBy("trip_id")
    if matrix is None:
        return grouped.applyInArrow(lambda table: plan(table), ITINERARY)
    legs = matrix.select(F.col("trip_id").cast("long").alias("trip_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "profile", "km", "minutes")
    return grouped.cogroup(legs.groupBy("trip_id")).applyInArrow(plan, ITINERARY)


_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]


def tours(places: DataFrame, two_opt: bool = True) -> DataFrame:
    """trip_id, seq, id: the tour of each trip's places from the one of smallest id."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        km = Lines(pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float))
        tour = np.array(nearest_tour(km, list(range(len(pdf)))), int)
        tour = shorten_path(km, tour) if two_opt else tour
        return pd.DataFrame({"trip_id": pdf["trip_id"], "seq": range(1, len(pdf) + 1), "id": pdf["id"].to_numpy()[tour]})

    return places.select(F.col("trip_id").cast("long").alias("trip_id"), F.col("id").cast("long").alias("id"), "lat", "lon").groupBy("trip_id").applyInPandas(work, "trip_id long, seq int, id long")


def route_length(tour: DataFrame) -> DataFrame:
    """trip_id, km: the length along seq; tour has trip_id, seq, lat, lon."""
    from pyspark.sql import Window as W

    w = W.partitionBy("trip_id").orderBy("seq")
    km = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return tour.withColumn("km", km).groupBy("trip_id").agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"))
