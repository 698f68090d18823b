"""Joins, groupings, windows and gates over records and stations: DataFrame operations that Catalyst plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.functions import arrays, physics


def failed(df: DataFrame, module: str, reason: Column | str, when: Column) -> DataFrame:
    """A gate: rows stay; where `when` holds and nothing failed before, failure becomes (module, reason)."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    this = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(module).alias("module"), reason.alias("reason")))
    return df.withColumn("failure", F.coalesce("failure", this) if "failure" in df.columns else this)


def check_instrument(traces: DataFrame, keys: list[str], n_max: int = 3, n_min: int = 2, two_horizontals: bool = True) -> DataFrame:
    """Fails every trace of a record by the first test it misses: too many traces, too few, not two horizontals."""
    w = Window.partitionBy(*keys)
    n, h = F.count(F.lit(1)).over(w), F.count_if(F.col("component") != "Z").over(w)
    reason = F.when(n > n_max, "more traces than allowed").when(n < n_min, "fewer traces than required")
    if two_horizontals:
        reason = reason.when(h < 2, "not two horizontal traces")
    d = traces.withColumn("_r", reason)
    return failed(d, "check_instrument", F.col("_r"), F.col("_r").isNotNull()).drop("_r")


def component_names(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Z for channels that end in Z; the others are H1, H2, ... in channel order."""
    vertical = F.col("channel").endswith("Z")
    k = F.row_number().over(Window.partitionBy(*keys, vertical).orderBy("channel"))
    return channels.withColumn("component", F.when(vertical, "Z").otherwise(F.concat(F.lit("H"), k.cast("string"))))


def record_key(network: Column, station: Column, location: Column, channel: Column, by_location=("RE",)) -> Column:
    """network.station.instrument, with the location too for networks whose locations are separate stations."""
    return F.concat_ws(".", network, station, F.when(network.isin(*by_location), location), F.substring(channel, 1, 2))


def dedup(traces: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The preferred row of each group of duplicates (equal keys), by the order of rank."""
    return traces.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))).where("_k = 1").drop("_k")


def select_colocated(records: DataFrame, station: list[str], preference: list[str], far_preference: list[str] | None = None, far_km: Column | None = None) -> DataFrame:
    """Fails all passed records of a station but the one whose instrument comes first in the preference.

    Where far_km is given, stations beyond it use far_preference. A record alone at its station always stays. Records that
    failed before, which column reason (where there is one) tells, take no part and keep their reason.
    """
    earlier = F.col("reason") if "reason" in records.columns else F.lit(None).cast("string")

    def order(prefs: list[str]) -> Column:
        out = F.lit(None).cast("int")
        for k, p in reversed([*enumerate(prefs)]):
            out = F.when(F.col("instrument") == p[:2], k).otherwise(out)
        return out

    rank = order(preference) if far_preference is None else F.when(F.col("dist_km") > far_km, order(far_preference)).otherwise(order(preference))
    w = Window.partitionBy(*station, "_failed")
    d = records.withColumn("_failed", earlier.isNotNull()).withColumn("_o", rank).withColumn("_n", F.count(F.lit(1)).over(w))
    d = d.withColumn("_best", F.first("instrument").over(w.orderBy(F.col("_o").asc_nulls_last(), "instrument").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = d.withColumn("_any", F.min("_o").over(w))
    reason = F.when((F.col("_n") > 1) & F.col("_any").isNull(), "no preferred instrument").when((F.col("_n") > 1) & (F.col("instrument") != F.col("_best")), F.concat(F.lit("colocated with "), F.col("_best")))
    return d.withColumn("reason", F.when(F.col("_failed"), earlier).otherwise(reason)).drop("_o", "_n", "_best", "_any", "_failed")


def epoch_join(rows: DataFrame, epochs: DataFrame, key: str, at: str) -> DataFrame:
    """rows with the first epoch, by start, of equal key whose [epoch_start, epoch_end) holds at; nulls where there is none.

    A key's few epochs are gathered first, so that an equi-join gives each row once however they overlap.
    """
    rest = [c for c in epochs.columns if c not in ("epoch_key", "epoch_start", "epoch_end")]
    of = epochs.groupBy("epoch_key").agg(F.sort_array(F.collect_list(F.struct("epoch_start", "epoch_end", *rest))).alias("_of"))
    hit = F.get(F.filter("_of", lambda e: (F.col(at) >= e["epoch_start"]) & (F.col(at) < e["epoch_end"])), F.lit(0))
    d = rows.join(of, rows[key] == of["epoch_key"], "left").withColumn("_hit", hit)
    return d.select(*rows.columns, *(F.col(f"_hit.{c}").alias(c) for c in ("epoch_start", "epoch_end", *rest)))


def nearest_event(targets: DataFrame, catalog: DataFrame, key: str, radius_km: float, dt_s: float, depth_km: float, dmag: float, cell_deg: float) -> DataFrame:
    """For each target the catalog event of least normalised distance in space, time, depth and magnitude, within radius_km.

    Candidates meet through cells of latitude and longitude, whose neighbours are searched; no cross join.
    """
    cell = lambda c: F.floor(c / cell_deg)
    reach = math.radians(radius_km / 111.0)  # a little more than the radius as an angle
    rows = math.ceil(math.degrees(reach) / cell_deg)
    near = F.explode(F.sequence(F.lit(-rows), F.lit(rows)))
    wrap = int(360 / cell_deg)
    lon = lambda c: F.pmod(F.floor((c + 180) / cell_deg), F.lit(wrap))
    t = targets.withColumn("_y", cell(F.col("lat"))).withColumn("_x", lon(F.col("lon")))
    # cells narrow towards the poles: the reach in longitude grows, and where the circle holds a pole every cell of a band is searched
    c = catalog.select(*(F.col(x).alias(f"c_{x}") for x in catalog.columns))
    c = c.withColumn("_d", near).withColumn("_y", F.col("_d") + cell(F.col("c_lat"))).drop("_d")
    lat = F.radians(F.col("c_lat"))
    wide = F.when(F.abs(lat) + reach < math.pi / 2, F.ceil(F.degrees(F.asin(F.least(math.sin(reach) / F.cos(lat), F.lit(1.0)))) / cell_deg).cast("int"))
    c = c.withColumn("_w", wide).withColumn("_all", F.col("_w").isNull() | (2 * F.col("_w") + 1 >= wrap))
    some = F.transform(F.sequence(-F.col("_w"), F.col("_w")), lambda k: F.pmod(lon(F.col("c_lon")).cast("int") + k, F.lit(wrap)))
    c = c.withColumn("_x", F.explode(F.when(F.col("_all"), F.sequence(F.lit(0), F.lit(wrap - 1))).otherwise(some))).drop("_all", "_w")
    km = physics.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    j = t.join(c.withColumn("_x", F.col("_x").cast("long")), ["_y", "_x"]).withColumn("km", km).where(F.col("km") <= radius_km)
    sq = lambda v: v * v
    z = F.sqrt(sq(F.col("km") / radius_km) + sq((F.col("time_s") - F.col("c_time_s")) / dt_s) + sq((F.col("depth") - F.col("c_depth")) / depth_km) + sq((F.col("magnitude") - F.col("c_magnitude")) / dmag))
    return j.withColumn("z", z).groupBy(key).agg(F.min(F.struct("z", "c_event", "km")).alias("b")).select(key, F.col("b.c_event").alias("event"), F.col("b.z").alias("z"), F.col("b.km").alias("km"))


def within_bounds(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """rows x the providers whose box holds them; a box whose west exceeds its east crosses the antimeridian. providers is a short list."""
    lon = F.when(F.col("west") <= F.col("east"), F.col("lon").between(F.col("west"), F.col("east"))).otherwise((F.col("lon") >= F.col("west")) | (F.col("lon") <= F.col("east")))
    return rows.join(providers, F.col("lat").between(F.col("south"), F.col("north")) & lon)


def status(records: DataFrame, kind: str) -> DataFrame:
    """Failure tables. short: records by first failure; net: passed and failed by network; long: a row a record."""
    if kind == "short":
        return records.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    if kind == "net":
        return records.groupBy("network").agg(F.count_if(F.col("reason").isNull()).alias("passed"), F.count_if(F.col("reason").isNotNull()).alias("failed"))
    if kind == "long":
        return records.select("network", "station", "instrument", F.coalesce("reason", F.lit("")).alias("reason"))
    raise ValueError(f"kind must be short, net or long, not {kind}")


def resample_even(samples: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Linear interpolation of (t, x) at multiples of step from each series' first t to its last.

    Each interval between neighbouring samples yields the grid points it holds, so nothing but a window by series is needed.
    """
    w = Window.partitionBy(*keys).orderBy("t", "x")
    d = samples.withColumn("_t0", F.min("t").over(Window.partitionBy(*keys))).withColumn("_t1", F.lead("t").over(w)).withColumn("_x1", F.lead("x").over(w)).where("_t1 > t")
    lo, hi = F.ceil((F.col("t") - F.col("_t0")) / step), F.ceil((F.col("_t1") - F.col("_t0")) / step) - 1
    d = d.where(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))
    at = F.col("_t0") + F.col("k") * step
    return d.select(*keys, "k", (F.col("x") + (F.col("_x1") - F.col("x")) * (at - F.col("t")) / (F.col("_t1") - F.col("t"))).alias("y"))


def sta_lta(samples: DataFrame, keys: list[str], order: str, sta: int, lta: int) -> DataFrame:
    """The largest ratio of short to long trailing means of squares; null where a series is shorter than lta."""
    w = Window.partitionBy(*keys).orderBy(order)
    sq = F.col("x") * F.col("x")
    d = samples.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.avg(sq).over(w.rowsBetween(1 - sta, 0))).withColumn("_l", F.avg(sq).over(w.rowsBetween(1 - lta, 0)))
    return d.groupBy(*keys).agg(F.max(F.when((F.col("_n") >= lta) & (F.col("_l") > 0), F.col("_s") / F.col("_l"))).alias("ratio"), F.count(F.lit(1)).alias("n"))


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = rows.withColumn("_new", F.when(top.isNull() | (F.col(start) > top), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def added_in_order(rows: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """keys and each aggregate over their rows, taken in the order given: sums of floats are the same to the last bit however rows are dealt over partitions.

    A key's rows pass through one task, sorted, as in any window.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    running = [v.over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for name, v in values.items()]
    return rows.select(*keys, *running, F.lead(F.lit(True)).over(w).isNull().alias("_last")).where("_last").drop("_last")


def pick_combine(picks: DataFrame, keys: list[str], method: str | tuple[str, ...] = "median") -> DataFrame:
    """One pick a trace from several pickers: median, mean, or the one of max_snr (of equals the earliest); missing picks (null or NaN) don't count.

    Of several methods each gives a column of its name in place of pick. A trace's picks, one a picker, are sorted before
    they are added, as sums of floats hang on the order.
    """
    d = picks.withColumn("pick", F.when(~F.isnan("pick"), F.col("pick")))
    best = F.max_by("pick", F.when(F.col("pick").isNotNull() & F.col("snr").isNotNull(), F.struct("snr", -F.col("pick"))))
    a, n = F.col("_picks"), F.size("_picks")
    low, high = (F.get(a, F.floor(k / 2).cast("int")) for k in (n - 1, n))
    of = {"median": low + (high - low) / 2, "mean": F.when(n > 0, arrays.mean(a)), "max_snr": F.col("_best")}
    out = [of[method].alias("pick")] if isinstance(method, str) else [of[m].alias(m) for m in method]
    return d.groupBy(*keys).agg(F.sort_array(F.collect_list("pick")).alias("_picks"), best.alias("_best")).select(*keys, *out, n.cast("long").alias("n"))


def corners_by_magnitude(mag: Column, least=(-999.0, 3.5, 5.5), highpass=(0.5, 0.3, 0.1), lowpass=(25.0, 35.0, 40.0)) -> Column:
    """Struct highpass, lowpass of the last class whose least magnitude is exceeded."""
    out = F.lit(None).cast("struct<highpass:double,lowpass:double>")
    for m, h, lo in zip(least, highpass, lowpass):
        out = F.when(mag > m, F.struct(F.lit(h).alias("highpass"), F.lit(lo).alias("lowpass"))).otherwise(out)
    return out


def corners_by_snr(snr: DataFrame, keys: list[str], threshold: float, min_freq: float, max_freq: float) -> DataFrame:
    """highpass and lowpass where a record's ratio (freq, snr) stays above threshold over [min_freq, max_freq]; no row where it does not.

    A band begins at the frequency after an upward crossing (or at the first) and ends at the one before a downward
    crossing (or at the last); of the bands that hold the required range the last counts.
    """
    w = Window.partitionBy(*keys).orderBy("freq")
    d = snr.where(F.col("snr").isNotNull() & ~F.isnan("snr")).withColumn("_up", F.col("snr") > threshold)
    d = d.withColumn("_new", F.when(F.col("_up") & ~F.coalesce(F.lag("_up").over(w), F.lit(False)), 1).otherwise(0))
    d = d.withColumn("_band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_up")
    b = d.groupBy(*keys, "_band").agg(F.min("freq").alias("highpass"), F.max("freq").alias("lowpass")).where((F.col("highpass") <= min_freq) & (F.col("lowpass") > max_freq))
    return b.groupBy(*keys).agg(F.max_by(F.struct("highpass", "lowpass"), "_band").alias("c")).select(*keys, "c.*")


def signal_end(d: DataFrame, method: str, vmin: float = 1.0, floor: float = 120.0, dur0: float = 0.0, dur1: float = 0.15, stress_drop: float = 10.0) -> Column:
    """Seconds after the origin (velocity, magnitude) or after the split (source_path) at which the signal ends."""
    if method == "velocity":
        return F.greatest(F.lit(floor), F.col("dist_km") / vmin)
    if method == "magnitude":
        return physics.shaking_seconds(F.col("magnitude"))
    if method == "source_path":
        return F.col("split") + 1 / physics.brune_f0(physics.moment(F.col("magnitude")), stress_drop) + dur0 + dur1 * F.col("dist_km")
    raise ValueError(f"unknown method {method}")


def travel_times(pairs: DataFrame, grid: DataFrame, step_deg: float, step_km: float) -> DataFrame:
    """pairs (degrees, depth_km) with `seconds`, bilinear in a grid (i, j, t) at i * step_deg and j * step_km; null outside it.

    The four corners meet the grid by equi-joins on cell numbers; negative depths count as 0.
    """
    z = F.greatest(F.col("depth_km"), F.lit(0.0))
    d = pairs.withColumn("_i", F.floor(F.col("degrees") / step_deg)).withColumn("_j", F.floor(z / step_km))
    d = d.withColumn("_u", F.col("degrees") / step_deg - F.col("_i")).withColumn("_v", z / step_km - F.col("_j"))
    for a in (0, 1):
        for b in (0, 1):
            g = grid.select((F.col("i") - a).alias("_i"), (F.col("j") - b).alias("_j"), F.col("t").alias(f"_t{a}{b}"))
            d = d.join(g, ["_i", "_j"], "left")
    u, v = F.col("_u"), F.col("_v")
    t = F.col("_t00") * (1 - u) * (1 - v) + F.col("_t10") * u * (1 - v) + F.col("_t01") * (1 - u) * v + F.col("_t11") * u * v
    return d.withColumn("seconds", t).select(*pairs.columns, "seconds")


def align(traces: DataFrame, keys: list[str], dt: float) -> DataFrame:
    """Traces (start seconds, x) of a record cut to what all of them cover: from the latest start to the earliest end."""
    w = Window.partitionBy(*keys)
    end = F.col("start") + (F.size("x") - 1) * dt
    d = traces.withColumn("_a", F.max("start").over(w)).withColumn("_b", F.min(end).over(w))
    first, last = F.round((F.col("_a") - F.col("start")) / dt).cast("int"), F.round((F.col("_b") - F.col("start")) / dt).cast("int")
    return d.withColumn("x", F.when(last >= first, F.slice("x", first + 1, last - first + 1)).otherwise(F.array().cast("array<double>"))).withColumn("start", F.col("_a")).drop("_a", "_b")


def snr_check(snr: DataFrame, keys: list[str], threshold: float, low: Column, high: float) -> DataFrame:
    """keys, least, failed: the least ratio (freq, snr) between low and high; an empty band counts as 0 and NaN never fails."""
    inside = (F.col("freq") >= low) & (F.col("freq") <= high)
    d = snr.groupBy(*keys).agg(F.min(F.when(inside & ~F.isnan("snr"), F.col("snr"))).alias("least"), F.coalesce(F.bool_or(inside & F.isnan("snr")), F.lit(False)).alias("_nan"))
    d = d.withColumn("least", F.when(~F.col("_nan"), F.coalesce("least", F.lit(0.0))))
    return d.select(*keys, "least", F.coalesce(F.col("least") < threshold, F.lit(False)).alias("failed"))


def natural_rank(names: DataFrame, column: str) -> DataFrame:
    """names with `rank`: by the text before the first number, then by that number, then by the whole name."""
    number = F.regexp_extract(column, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    order = Window.orderBy(F.regexp_extract(column, r"^([^\d]*)", 1), number.asc_nulls_first(), column)
    return names.withColumn("rank", F.row_number().over(order))  # column names: a short list


def band_average(spec: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """The mean of value over freq between low and high, by trapezoids between the points inside."""
    w = Window.partitionBy(*keys).orderBy("freq")
    d = spec.where(F.col("freq").between(low, high)).withColumn("_f", F.lead("freq").over(w)).withColumn("_v", F.lead("value").over(w)).where("_f is not null")
    return d.groupBy(*keys).agg((F.sum((F.col("value") + F.col("_v")) / 2 * (F.col("_f") - F.col("freq"))) / F.sum(F.col("_f") - F.col("freq"))).alias("mean"))
