"""Scenarios, hierarchies, reference data, asset-liability cash flows, rate shocks and transfer prices.

Cells: (scenario_id, currency, product, time_bucket, cashflow_type, amount[, discount_factor, repricing_date]).
Curves: (tenor_days, zero_rate); they and all other parameter tables are small and joined as such.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions.scalars import norm_cdf
from veldspar.functions.series import safe
from veldspar.sources.shared import written

from .temporal import active_at

# --- scenarios and hierarchies


def closure(edges: DataFrame, depth: int = 64) -> DataFrame:
    """(node, ancestor, distance) over edges (parent, child): the least distance of each pair. Deeper than depth is an error."""
    step = written(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "parents")
    front = step.select("node", "ancestor", F.lit(1).alias("distance"))
    out = front
    for d in range(2, depth + 2):
        up = front.select("node", F.col("ancestor").alias("__via")).join(step.select(F.col("node").alias("__via"), "ancestor"), "__via").select("node", "ancestor").distinct()
        front = written(up.join(out, ["node", "ancestor"], "left_anti").select("node", "ancestor", F.lit(d).alias("distance")), "closure")
        if front.isEmpty():
            return out
        if d > depth:
            raise ValueError("the hierarchy is too deep, or has a cycle")
        out = out.unionByName(front)
    return out


def ancestors(edges: DataFrame, node, as_of: int) -> DataFrame:
    return closure(active_at(edges, as_of)).where((F.col("node") == node) & (F.col("ancestor") != node)).select("ancestor", "distance")


def descendants(edges: DataFrame, node, as_of: int) -> DataFrame:
    return closure(active_at(edges, as_of)).where((F.col("ancestor") == node) & (F.col("node") != node)).select(F.col("node").alias("descendant"), "distance")


def hierarchy_faults(edges: DataFrame) -> DataFrame:
    """(fault, parent, child): self edges and pairs whose intervals overlap. (Cycles: closure() raises or shows node = ancestor.)"""
    own = edges.where("parent = child").select(F.lit("self").alias("fault"), "parent", "child")
    later = F.max("valid_to").over(Window.partitionBy("parent", "child").orderBy("valid_from", "valid_to").rowsBetween(Window.unboundedPreceding, -1))
    twice = edges.withColumn("__before", later).where(F.col("valid_from") < F.col("__before")).select(F.lit("overlap").alias("fault"), "parent", "child")
    return own.unionByName(twice).distinct()


def rollup(values: DataFrame, edges: DataFrame, as_of: int) -> DataFrame:
    """(node, total): values (node, value) added to the node itself and each of its ancestors."""
    up = closure(active_at(edges, as_of)).select("node", F.col("ancestor").alias("to"))
    fed = values.select(F.col("node").alias("to"), "value").unionByName(values.join(up, "node").select("to", "value"))
    return fed.groupBy(F.col("to").alias("node")).agg(F.sum("value").alias("total"))


def resolve_scenario(scenarios: DataFrame, name: str, depth: int = 32) -> DataFrame:
    """(factor, value, source): shocks (scenario_id, parent_id, factor, value) from the root down to name; the nearest
    scenario that sets a factor counts. A cycle or missing parent raises."""
    parents = scenarios.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("scenario_id").alias("child")).distinct()
    if not parents.select(F.col("parent").alias("scenario_id")).join(scenarios, "scenario_id", "left_anti").isEmpty():
        raise ValueError("a parent is missing")
    if scenarios.where(F.col("scenario_id") == name).isEmpty():
        raise ValueError(f"no such scenario: {name}")
    chain = closure(parents, depth).where(F.col("node") == name)
    if not chain.where(F.col("ancestor") == name).isEmpty():
        raise ValueError("the scenarios have a cycle")
    line = chain.select(F.col("ancestor").alias("scenario_id"), "distance").unionByName(scenarios.sparkSession.createDataFrame([(name, 0)], "scenario_id string, distance int"))
    held = scenarios.join(line, "scenario_id")
    return held.groupBy("factor").agg(F.min_by(F.struct("value", "scenario_id"), "distance").alias("x")).select("factor", "x.value", F.col("x.scenario_id").alias("source"))


def scenario_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(factor, before, after, change) where two sets of shocks (factor, value) differ."""
    both = a.select("factor", F.col("value").alias("before")).join(b.select("factor", F.col("value").alias("after")), "factor", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", change).where("change is not null")


def master_get(master: DataFrame, id_, as_of: int) -> DataFrame:
    """(attribute, value) of the version of id in force at as_of, one row for each attribute."""
    names = [c for c in master.columns if c not in ("id", "valid_from", "valid_to")]
    rows = active_at(master.where(F.col("id") == id_), as_of)
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in names))).alias("x")).select("x.*")


def unresolved(rows: DataFrame, attribute: str, target: DataFrame, as_of: int) -> DataFrame:
    """Rows whose attribute names no record of target(id, ...) in force at as_of."""
    live = active_at(target, as_of).select(F.col("id").cast("string").alias("__id")).distinct()
    return rows.where(F.col(attribute).isNotNull()).join(live, F.col(attribute).cast("string") == F.col("__id"), "left_anti")


# --- curves


def zero_rate(curve: Sequence[tuple[float, float]], days: Column) -> Column:
    """Linear between the tenors of curve (days, rate), flat beyond its ends."""
    points = sorted(curve, key=lambda p: p[0])
    points = [(t, x if isinstance(x, Column) else F.lit(float(x))) for t, x in points]
    out = points[-1][1]
    for (t0, r0), (t1, r1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(days < t1, r0 + (r1 - r0) * (days - t0) / float(t1 - t0)).otherwise(out)
    return F.when(days <= points[0][0], points[0][1]).otherwise(out)


def discount(curve: Sequence[tuple[float, float]], days: Column, basis: int = 365) -> Column:
    return F.exp(-zero_rate(curve, days) * days / float(basis))


# --- cash flows


def cashflow_ladder(cells: DataFrame) -> DataFrame:
    return cells.groupBy("time_bucket").agg(F.sum("amount").alias("amount"))


def nii(cells: DataFrame, horizon: int) -> DataFrame:
    return cells.where((F.col("cashflow_type") == "Interest") & (F.col("time_bucket") <= horizon)).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("nii"))


def eve(cells: DataFrame, curve: Sequence[tuple[float, float]], basis: int = 365) -> DataFrame:
    """Present value; a cell's own discount_factor goes before the curve."""
    df = discount(curve, F.col("time_bucket"), basis)
    own = F.coalesce("discount_factor", df) if "discount_factor" in cells.columns else df
    return cells.agg(F.coalesce(F.sum(F.col("amount") * own), F.lit(0.0)).alias("eve"))


def repricing_gap(cells: DataFrame, edges: Sequence[int]) -> DataFrame:
    """(bucket, gap): principal by the last edge not after its repricing date; earlier ones are left out. Empty buckets show 0."""
    bucket = F.lit(None).cast("long")
    for e in sorted(edges):
        bucket = F.when(F.col("repricing_date") >= e, F.lit(e).cast("long")).otherwise(bucket)
    sums = cells.where("cashflow_type = 'Principal'").groupBy(bucket.alias("bucket")).agg(F.sum("amount").alias("gap"))
    every = cells.sparkSession.createDataFrame([(int(e),) for e in edges], "bucket long")
    return every.join(sums, "bucket", "left").select("bucket", F.coalesce("gap", F.lit(0.0)).alias("gap"))


def liquidity_stress(cells: DataFrame, deposit_runoff: float, outflow: float, inflow_haircut: float) -> DataFrame:
    """(time_bucket, cumulative): deposits run off, other outflows grow, other inflows are cut; running over buckets."""
    a = F.col("amount")
    hit = F.when(F.col("cashflow_type") == "Deposit", a - F.abs(a) * deposit_runoff).when(a < 0, a * (1 + outflow)).otherwise(a * (1 - inflow_haircut))
    steps = cells.groupBy("time_bucket").agg(F.sum(hit).alias("x"))  # one row for each bucket from here
    return steps.select("time_bucket", F.sum("x").over(Window.orderBy("time_bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def deposit_decay(cells: DataFrame, survival: Sequence[float], period_days: int) -> DataFrame:
    """Each deposit as the run-offs between one period's survival and the next's, that many periods out."""
    before = [1.0, *survival[:-1]]
    parts = F.array(*(F.struct(F.lit(max(b - s, 0.0)).alias("share"), F.lit(period_days * (i + 1)).alias("days")) for i, (b, s) in enumerate(zip(before, survival, strict=True)) if b > s))
    gone = cells.where("cashflow_type = 'Deposit'").withColumn("__p", F.explode(parts))
    gone = gone.withColumns({"time_bucket": F.col("time_bucket") + F.col("__p.days"), "amount": F.col("amount") * F.col("__p.share")}).drop("__p")
    return cells.where("cashflow_type <> 'Deposit'").unionByName(gone)


def prepayment(cells: DataFrame, smm: float, shift_days: int) -> DataFrame:
    """A share smm of each principal inflow comes shift_days earlier, as Prepayment."""
    hit = (F.col("cashflow_type") == "Principal") & (F.col("amount") > 0)
    kept = cells.withColumn("amount", F.when(hit, F.col("amount") - F.col("amount") * smm).otherwise(F.col("amount")))
    if smm <= 0:
        return cells
    at = F.greatest(F.col("time_bucket") - shift_days, F.lit(0).cast("long"))
    moved = cells.where(hit).withColumns({"cashflow_type": F.lit("Prepayment"), "amount": F.col("amount") * smm, "time_bucket": at, "repricing_date": at})
    return kept.unionByName(moved)


def currency_breakdown(cells: DataFrame, fx: DataFrame) -> DataFrame:
    """(currency, amount) in the base currency, by fx(currency, rate); a missing rate counts as 1."""
    own = cells.groupBy("currency").agg(F.sum("amount").alias("amount"))
    return own.join(F.broadcast(fx), "currency", "left").select("currency", (F.col("amount") * F.coalesce("rate", F.lit(1.0))).alias("amount"))


def optionality_charge(cells: DataFrame) -> DataFrame:
    return cells.where("cashflow_type = 'Optionality'").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("charge"))


# --- rate shocks

#: Supervisory shocks in basis points (parallel, short, long) by currency, before and from 2026.
SHOCKS_2018 = {"ARS": (400, 500, 300), "AUD": (300, 450, 200), "BRL": (400, 500, 300), "CAD": (200, 300, 150), "CHF": (100, 150, 100), "CNH": (250, 300, 150), "CNY": (250, 300, 150), "EUR": (200, 250, 100), "GBP": (250, 300, 150), "HKD": (200, 250, 100), "IDR": (400, 500, 300), "INR": (400, 500, 300), "JPY": (100, 100, 100), "KRW": (300, 400, 200), "MXN": (400, 500, 300), "RUB": (400, 500, 300), "SAR": (200, 300, 150), "SEK": (200, 300, 150), "SGD": (150, 200, 100), "TRY": (400, 500, 300), "USD": (200, 300, 150), "ZAR": (400, 500, 300)}
SHOCKS_2026 = {"ARS": (400, 500, 300), "AUD": (350, 425, 300), "BRL": (400, 500, 300), "CAD": (200, 275, 175), "CHF": (175, 250, 200), "CNH": (225, 300, 150), "CNY": (225, 300, 150), "EUR": (225, 350, 200), "GBP": (275, 425, 250), "HKD": (225, 375, 200), "IDR": (400, 500, 300), "INR": (325, 475, 225), "JPY": (100, 100, 100), "KRW": (225, 350, 225), "MXN": (400, 500, 200), "RUB": (400, 500, 300), "SAR": (275, 375, 250), "SEK": (275, 425, 200), "SGD": (175, 250, 225), "TRY": (400, 500, 300), "USD": (200, 300, 225), "ZAR": (325, 500, 300)}
#: Ends of the 19 standard time bands in years, and their midpoints.
BAND_ENDS = (1 / 365, 1 / 12, 0.25, 0.5, 0.75, 1, 1.5, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, math.inf)
BAND_MIDPOINTS = (0.0028, 0.0417, 0.1667, 0.375, 0.625, 0.875, 1.25, 1.75, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 12.5, 17.5, 25)
SCENARIOS = ("parallel_up", "parallel_down", "steepener", "flattener", "short_up", "short_down")
RATE_FLOOR = -0.02


def time_bands(spark: SparkSession) -> DataFrame:
    starts = (0.0, *BAND_ENDS[:-1])
    return spark.createDataFrame([(i, float(a), float(b), float(m)) for i, (a, b, m) in enumerate(zip(starts, BAND_ENDS, BAND_MIDPOINTS, strict=True))], "band int, start_years double, end_years double, midpoint double")


def shock(scenario: str, currency: str, years: Column, year: int = 2026) -> Column:
    """The scenario's change of the zero rate at a maturity."""
    parallel, short, long_ = (x / 10_000 for x in (SHOCKS_2026 if year >= 2026 else SHOCKS_2018)[currency])
    decay = F.exp(-years / 4.0)
    return {
        "parallel_up": F.lit(parallel), "parallel_down": F.lit(-parallel), "short_up": short * decay, "short_down": -short * decay,
        "steepener": -0.65 * short * decay + 0.9 * long_ * (1 - decay), "flattener": 0.8 * short * decay - 0.6 * long_ * (1 - decay),
    }[scenario]


def shocked_rate(rate: Column, scenario: str, currency: str, years: Column, year: int = 2026) -> Column:
    return F.greatest(rate + shock(scenario, currency, years, year), F.lit(RATE_FLOOR))


def nearest_midpoint(years: Column) -> Column:
    """The midpoint nearest to a maturity, the shorter one of two as near."""
    out = F.lit(float(BAND_MIDPOINTS[-1]))
    for a, b in reversed(list(zip(BAND_MIDPOINTS, BAND_MIDPOINTS[1:], strict=False))):
        out = F.when(years - a <= b - years, F.lit(float(a))).otherwise(out)
    return out


def irrbb_eve(cells: DataFrame, currency: str, curve: Sequence[tuple[float, float]], year: int = 2026, filter_currency: bool = False) -> DataFrame:
    """(scenario, delta_eve): max(0, loss of present value) under each of the six shocks, over cash flows by band midpoint.

    currency picks the shocks; the cells are all used unless filter_currency. One pass sums cells into bands."""
    rows = cells.where(F.col("currency") == currency) if filter_currency else cells
    bands = rows.groupBy(nearest_midpoint(F.col("time_bucket") / 365.0).alias("years")).agg(F.sum("amount").alias("cf"))
    base = zero_rate(curve, F.col("years") * 365)
    each = F.array(*(F.struct(F.lit(s).alias("scenario"), (F.col("cf") * F.exp(-base * F.col("years")) - F.col("cf") * F.exp(-shocked_rate(base, s, currency, F.col("years"), year) * F.col("years"))).alias("loss")) for s in SCENARIOS))
    return bands.select(F.explode(each).alias("x")).groupBy("x.scenario").agg(F.greatest(F.sum("x.loss"), F.lit(0.0)).alias("delta_eve"))


def nmd_split(df: DataFrame, balance: str, core_share: float, core_cap: float) -> DataFrame:
    """Adds core and non_core of a non-maturity deposit: the core share held under its cap."""
    core = F.col(balance) * min(core_share, core_cap)
    return df.withColumns({"core": core, "non_core": F.col(balance) - core})


def prepayment_bands(schedule: Column, rate: float) -> Column:
    """Cash flows of an array schedule when a share `rate` of what is outstanding prepays in each band: an ordered fold."""
    total = F.aggregate(schedule, F.lit(0.0), lambda s, x: s + x)
    start = F.struct(total.alias("left"), F.lit(1.0).alias("scale"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        due = x * s["scale"]
        early = (s["left"] - due) * rate
        left = s["left"] - due - early
        scale = F.when(s["left"] - due > 0, s["scale"] * safe(left, s["left"] - due)).otherwise(s["scale"])
        return F.struct(left.alias("left"), scale.alias("scale"), F.array_append(s["out"], due + early).alias("out"))

    return F.aggregate(schedule, start, step, lambda s: s["out"])


def _let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """fn of a struct of values, each evaluated once however often fn names it."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), fn), 1)


def black76(forward: Column, strike: Column, vol: Column, years: Column, df: Column, call: bool = True) -> Column:
    """Discounted Black price of a call or put on a forward; intrinsic without volatility, time or a positive strike."""
    sign = 1.0 if call else -1.0

    def price(x: Column) -> Column:
        live = (x["vol"] > 0) & (x["years"] > 0) & (x["k"] > 0) & (x["f"] > 0)
        root = F.when(live, x["vol"] * F.sqrt(x["years"]))
        d1 = (F.ln(F.when(live, x["f"] / F.when(x["k"] > 0, x["k"]))) + 0.5 * root * root) / root
        inner = F.greatest(sign * (x["f"] - x["k"]), F.lit(0.0))
        value = _let(lambda d: sign * (x["f"] * norm_cdf(d["one"]) - x["k"] * norm_cdf(d["two"])), one=sign * d1, two=sign * (d1 - root))
        return x["df"] * F.when(live, value).otherwise(inner)

    return _let(price, f=forward, k=strike, vol=vol, years=years, df=df)


def caplet(curve: Sequence[tuple[float, float | Column]], start: Column, end: Column, strike: Column, vol: Column, call: bool = True) -> Column:
    """On the simple forward rate between two days, discounted with the start day's factor, for the period's length."""
    tau = (end - start) / 365.0
    return _let(lambda x: tau * black76((x["a"] / x["b"] - 1) / tau, strike, vol, start / 365.0, x["a"], call), a=discount(curve, start), b=discount(curve, end))


def swaption(curve: Sequence[tuple[float, float | Column]], expiry: Column, payments: Sequence[int], strike: Column, vol: Column, payer: bool = True) -> Column:
    """On the swap rate over the payment days (from expiry on), paid by the annuity."""
    days = [expiry, *(F.lit(float(p)) for p in payments)]
    factors = {f"d{i}": discount(curve, t) for i, t in enumerate(days)}

    def price(x: Column) -> Column:
        annuity = sum(((b - a) / 365.0 * x[f"d{i}"] for i, (a, b) in enumerate(zip(days, days[1:], strict=False), 1)), F.lit(0.0))
        return _let(lambda y: black76((x["d0"] - x[f"d{len(days) - 1}"]) / y["annuity"], strike, vol, expiry / 365.0, y["annuity"], payer), annuity=annuity)

    return _let(price, **factors)


#: Fixed value: what implied volatilities are multiplied by when options are valued under a shock.
VOL_BUMP = 1.25


def shifted_curve(curve: Sequence[tuple[float, float]], scenario: str, currency: str, year: int = 2026, basis: int = 365) -> list[tuple[float, Column]]:
    """The curve's points after the scenario's shock at their maturities, floored; rates are constant expressions."""
    return [(t, shocked_rate(F.lit(float(x)), scenario, currency, F.lit(t / basis), year)) for t, x in sorted(curve)]


def option_risk(options: DataFrame, value: Callable[[Sequence[tuple[float, float | Column]], Column], Column], curve: Sequence[tuple[float, float]], currency: str, vol: str = "vol", year: int = 2026, bump: float = VOL_BUMP) -> DataFrame:
    """(scenario, base, shocked, risk) of a portfolio under the six shocks: its value on the curve less that on the shifted
    curve with all volatilities times bump; a loss is positive. value(curve, vol) prices a row. One pass over the options."""
    base = value(curve, F.col(vol))
    each = [F.struct(F.lit(s).alias("scenario"), base.alias("base"), value(shifted_curve(curve, s, currency, year), F.col(vol) * bump).alias("shocked")) for s in SCENARIOS]
    rows = options.select(F.explode(F.array(*each)).alias("x")).groupBy("x.scenario").agg(F.sum("x.base").alias("base"), F.sum("x.shocked").alias("shocked"))
    return rows.withColumn("risk", F.col("base") - F.col("shocked"))


# --- transfer prices


def ftp_price(trades: DataFrame, curve: Sequence[tuple[float, float]], policy: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds base, liquidity, basis, optionality, behavioural and rate to trades (trade_id, product, days).

    policy: (product, component, spread). A component comes from the nearest product up the hierarchy parents(parent,
    child) that has one, else from '*', else it is 0."""
    parts = ("liquidity", "basis", "optionality", "behavioural")
    up = closure(parents).select(F.col("node").alias("product"), F.col("ancestor").alias("source"), "distance")
    own = trades.select("product").distinct()
    chain = own.select("product", F.col("product").alias("source"), F.lit(0).alias("distance")).unionByName(own.join(up, "product")).unionByName(own.select("product", F.lit("*").alias("source"), F.lit(1 << 20).alias("distance")))
    found = chain.join(policy.select(F.col("product").alias("source"), "component", "spread"), "source").groupBy("product").pivot("component", parts).agg(F.min_by("spread", "distance"))
    priced = trades.join(found, "product", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in parts}).withColumn("base", zero_rate(curve, F.col("days")))
    return priced.withColumn("rate", F.col("base") + sum((F.col(c) for c in parts[1:]), F.col(parts[0])))


def ftp_reconcile(priced: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """(trade_id, rate, actual, difference, ok)."""
    return priced.join(actual, "trade_id").select("trade_id", "rate", "actual", (F.col("actual") - F.col("rate")).alias("difference"), (F.abs(F.col("actual") - F.col("rate")) <= tolerance).alias("ok"))
