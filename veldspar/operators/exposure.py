"""Large exposures, counterparty risk and ownership: DataFrame functions.

Events: (event_id, entity_id, amount, crm_reduction, exempt, sector, country, rating, connected, affiliate,
valid_from, valid_to[, corrects]). Relationships: (parent, child, kind, pct, valid_from, valid_to).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.series import safe
from veldspar.sources.shared import written

from .temporal import active_at

CONTROL, DEPENDENCE, PERSON, CONTROL_SHARE = "Control", "EconomicDependence", "ConnectedPerson", 0.5
#: Limits as shares of tier 1, by dimension: (metric, limit, warning, report).
LIMITS = (("lc_group", 0.25, 0.20, 0.10), ("entity", 0.25, 0.20, 0.10), ("connected_party", 0.15, 0.12, 0.10), ("sector", 1.0, 0.8, 0.5), ("country", 1.0, 0.8, 0.5))


def components(pairs: DataFrame) -> DataFrame:
    """(id, rep): the smallest id reachable over pairs (a, b), for each end.

    Large-star and small-star steps, each a written table; the driver sees a count and a checksum."""
    edges, last = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("rep")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("rep")).distinct())


def lc_groups(relations: DataFrame, t: int, share: float = CONTROL_SHARE) -> DataFrame:
    """(id, rep) of groups linked at t by control of at least `share` or by economic dependence."""
    live = active_at(relations, t).where(((F.col("kind") == CONTROL) & (F.col("pct") >= share)) | (F.col("kind") == DEPENDENCE))
    return components(live.select(F.col("parent").alias("a"), F.col("child").alias("b")))


def connected_parties(entities: DataFrame, relations: DataFrame, t: int) -> DataFrame:
    """Ids that are connected by themselves or as children of a connected person."""
    own = entities.where("is_connected").select(F.col("entity_id").alias("id"))
    return own.unionByName(active_at(relations, t).where(F.col("kind") == PERSON).select(F.col("child").alias("id"))).distinct()


def before_crm(long_: Column, short: Column) -> Column:
    return F.greatest(long_ - short, F.lit(0.0))


def after_crm(amount: Column, reduction: Column) -> Column:
    return F.greatest(amount - reduction, F.lit(0.0))


def current_events(events: DataFrame) -> DataFrame:
    """Without events that a later one corrects."""
    return events.join(events.where("corrects is not null").select(F.col("corrects").alias("event_id")), "event_id", "left_anti")


def ledger(events: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each key that an event feeds, and measure: (event_id, dim, key, measure, amount, valid_from, valid_to)."""
    rows = events.join(groups.select(F.col("id").alias("entity_id"), "rep"), "entity_id", "left")
    text = lambda c: F.col(c).cast("string")
    pair = lambda dim, key, when=None: F.struct(F.lit(dim).alias("dim"), (key if when is None else F.when(when, key)).alias("key"))
    keys = F.array(pair("entity", text("entity_id")), pair("lc_group", F.coalesce(text("rep"), text("entity_id"))), pair("sector", text("sector")), pair("connected_party", text("entity_id"), F.col("connected")), pair("group_affiliate", text("entity_id"), F.col("affiliate")), pair("country", text("country")), pair("rating", text("rating")))
    amounts = F.array(F.struct(F.lit("before").alias("measure"), F.col("amount").alias("value")), F.struct(F.lit("after").alias("measure"), after_crm(F.col("amount"), F.col("crm_reduction")).alias("value")), F.struct(F.lit("exempted").alias("measure"), F.when(F.col("exempt"), F.col("amount")).alias("value")))
    fed = rows.select("event_id", "valid_from", "valid_to", F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("k"), amounts.alias("m"))
    return fed.select("event_id", "k.dim", "k.key", "valid_from", "valid_to", F.explode(F.filter("m", lambda m: m["value"].isNotNull())).alias("m")).select("event_id", "dim", "key", "m.measure", F.col("m.value").alias("amount"), "valid_from", "valid_to")


def point_exposure(rows: DataFrame, t: int) -> DataFrame:
    return active_at(rows, t).groupBy("dim", "key", "measure").agg(F.sum("amount").alias("exposure"))


def period_max(rows: DataFrame, start: int, end: int) -> DataFrame:
    """(dim, key, measure, peak, peak_at): the largest running total in [start, end] and when it was first reached.

    Each event is a rise and a fall; changes at one time are summed before the running total."""
    held = rows.where((F.col("valid_from") <= end) & (F.col("valid_to") > start))
    moves = held.select("dim", "key", "measure", F.explode(F.array(F.struct(F.greatest("valid_from", F.lit(start).cast("long")).alias("t"), F.col("amount").alias("d")), F.struct(F.col("valid_to").alias("t"), (-F.col("amount")).alias("d")))).alias("x"))
    steps = moves.select("dim", "key", "measure", "x.*").where(F.col("t") <= end).groupBy("dim", "key", "measure", "t").agg(F.sum("d").alias("d"))
    total = F.sum("d").over(Window.partitionBy("dim", "key", "measure").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    best = steps.withColumn("total", F.floor(total * 1e4 + 0.5) / 1e4).groupBy("dim", "key", "measure").agg(F.max(F.struct("total", (-F.col("t")).alias("n"))).alias("m"))
    return best.select("dim", "key", "measure", F.col("m.total").alias("peak"), (-F.col("m.n")).alias("peak_at"))



def ratios(point: DataFrame, tier1: float, measure: str = "after") -> DataFrame:
    """(dim, key, exposure, ratio, headroom, status) under LIMITS."""
    limits = point.sparkSession.createDataFrame([x for x in LIMITS], "dim string, lim double, warn double, report double")
    rows = point.where(F.col("measure") == measure).join(F.broadcast(limits), "dim")
    ratio = F.col("exposure") / tier1
    state = F.when(ratio >= F.col("lim"), "breach").when(ratio >= F.col("warn"), "warn").when(ratio >= F.col("report"), "reportable").otherwise("ok")
    return rows.select("dim", "key", "exposure", ratio.alias("ratio"), (F.col("lim") * tier1 - F.col("exposure")).alias("headroom"), state.alias("status"))


def breach_scan(rows: DataFrame, start: int, end: int, tier1: float, report: float = 0.10, top_n: int = 20, measure: str = "after") -> DataFrame:
    """Groups whose period maximum reaches the reporting share or is among the top_n: (rank, key, peak, ratio, peak_at)."""
    peaks = period_max(rows.where((F.col("dim") == "lc_group") & (F.col("measure") == measure)), start, end)
    over, first = peaks.where(F.col("peak") / tier1 >= report), peaks.orderBy(F.desc("peak"), "key").limit(top_n)
    chosen = over.unionByName(first).distinct()
    place = F.row_number().over(Window.orderBy(F.desc("peak"), "key"))  # the rows of a report
    return chosen.select(place.alias("rank"), "key", "peak", (F.col("peak") / tier1).alias("ratio"), "peak_at")


def report_parts(rows: DataFrame, start: int, end: int, tier1: float, threshold: float = 0.10, top_n: int = 10) -> DataFrame:
    """The five-part report: (part, key, measure, peak, peak_at): groups after and before mitigation over the threshold,
    exempted, connected parties, and the top_n entities."""
    parts = (("I", "lc_group", "after", threshold, None), ("II", "lc_group", "before", threshold, None), ("III", "lc_group", "exempted", threshold, None), ("IV", "connected_party", "after", 0.0, None), ("V", "entity", "after", None, top_n))
    out = None
    for part, dim, measure, share, n in parts:
        peaks = period_max(rows.where((F.col("dim") == dim) & (F.col("measure") == measure)), start, end)
        own = peaks.where(F.col("peak") >= share * tier1) if n is None else peaks.orderBy(F.desc("peak"), "key").limit(n)
        own = own.select(F.lit(part).alias("part"), "key", "measure", "peak", "peak_at")
        out = own if out is None else out.unionByName(own)
    return out


def contributors(rows: DataFrame, report: DataFrame, dims: dict[str, str]) -> DataFrame:
    """Events in force when a reported key was at its peak: (part, key, event_id, amount)."""
    names = F.create_map(*(F.lit(x) for kv in dims.items() for x in kv))
    keyed = report.withColumn("dim", names[F.col("part")])
    events = rows.select("dim", "key", "measure", "event_id", "amount", "valid_from", "valid_to")
    return keyed.join(events, ["dim", "key", "measure"]).where((F.col("valid_from") <= F.col("peak_at")) & (F.col("peak_at") < F.col("valid_to"))).select("part", "key", "event_id", "amount")


def concentration(rows: DataFrame, dim: str, t: int, tier1: float, measure: str = "after") -> DataFrame:
    """(key, exposure, ratio, share) of one dimension."""
    point = point_exposure(rows.where((F.col("dim") == dim) & (F.col("measure") == measure)), t)
    total = point.agg(F.sum("exposure").alias("total"))
    return point.crossJoin(F.broadcast(total)).select("key", "exposure", (F.col("exposure") / tier1).alias("ratio"), safe(F.col("exposure"), F.col("total")).alias("share"))


def pre_trade_check(rows: DataFrame, groups: DataFrame, entity: int, amount: float, t: int, tier1: float, limit: float = 0.25) -> DataFrame:
    """(dim, key, current, projected, ratio, breach) of the entity and its group with the new amount."""
    spark = rows.sparkSession
    one = spark.createDataFrame([(entity,)], "id long").join(groups, "id", "left").select(F.explode(F.array(F.struct(F.lit("entity").alias("dim"), F.col("id").cast("string").alias("key")), F.struct(F.lit("lc_group").alias("dim"), F.coalesce("rep", "id").cast("string").alias("key")))).alias("x")).select("x.*")
    now = point_exposure(rows.where("measure = 'after'"), t)
    return one.join(now, ["dim", "key"], "left").select("dim", "key", F.coalesce("exposure", F.lit(0.0)).alias("current"), (F.coalesce("exposure", F.lit(0.0)) + amount).alias("projected")).select("*", (F.col("projected") / tier1).alias("ratio"), (F.col("projected") / tier1 > limit).alias("breach"))


def sa_ccr(trades: DataFrame, alpha: float = 1.4, floor: float = 0.05) -> DataFrame:
    """(netting_set, rc, addon, multiplier, ead) from (netting_set, hedging_set, value, collateral, notional, factor, delta).

    Add-ons are |sum of notional * factor * delta| by hedging set, added up; the multiplier falls with over-collateral."""
    sets = trades.groupBy("netting_set", "hedging_set").agg(F.sum("value").alias("value"), F.sum("collateral").alias("collateral"), F.abs(F.sum(F.col("notional") * F.col("factor") * F.col("delta"))).alias("addon"))
    net = sets.groupBy("netting_set").agg((F.sum("value") - F.sum("collateral")).alias("net"), F.sum("addon").alias("addon"))
    power = safe(F.col("net"), 2 * (1 - floor) * F.col("addon"), F.lit(0.0))
    multiplier = F.least(F.lit(1.0), floor + (1 - floor) * F.exp(F.least(power, F.lit(0.0))))
    rc = F.greatest(F.col("net"), F.lit(0.0))
    return net.select("netting_set", rc.alias("rc"), "addon", multiplier.alias("multiplier"), (alpha * (rc + multiplier * F.col("addon"))).alias("ead"))


def stressed(events: DataFrame, positions: DataFrame, shift: float) -> DataFrame:
    """Events with amount * (1 - duration * shift) where the entity has a rate position (entity_id, duration) with a duration."""
    own = positions.where("duration <> 0").groupBy("entity_id").agg(F.max("duration").alias("__d"))
    return events.join(own, "entity_id", "left").withColumn("amount", F.col("amount") * F.coalesce(1 - F.col("__d") * shift, F.lit(1.0))).drop("__d")


# --- transactions and ownership


def transaction_totals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(dim, key, total, n) over each of the columns in one pass."""
    sets = F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("key")) for c in by))).alias("x")
    return df.select(sets, "amount").groupBy("x.dim", "x.key").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def explanation_subgraph(transactions: DataFrame, seeds: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """Transactions (tx_id, src, dst, ...) within `hops` of seeds(id), each once, with the hop that reached it."""
    steps = transactions.select("tx_id", "src", "dst")
    if not directed:
        steps = steps.unionByName(transactions.select("tx_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    steps = written(steps, "tx")
    frontier = written(seeds.select("id").distinct(), "front")
    nodes, out = frontier, None
    for hop in range(1, hops + 1):
        taken = written(steps.join(frontier.withColumnRenamed("id", "src"), "src"), "taken")
        got = taken.select("tx_id", F.lit(hop).alias("hop"))
        out = got if out is None else out.unionByName(got)
        frontier = written(taken.select(F.col("dst").alias("id")).distinct().join(nodes, "id", "left_anti"), "front")
        nodes = nodes.unionByName(frontier)
        if frontier.isEmpty():
            break
    return out.groupBy("tx_id").agg(F.min("hop").alias("hop"))


def beneficial_owners(stakes: DataFrame, threshold: float = 0.25, depth: int | None = None) -> DataFrame:
    """(company, owner, share): ultimate owners (owned by nobody) whose shares multiplied along simple paths sum to the
    threshold at least. stakes: (owner, owned, pct). A path that returns to itself ends; with depth, paths that go on
    after so many further steps are an error."""
    direct = written(stakes.select("owner", "owned", "pct"), "stakes")
    front = direct.select(F.col("owned").alias("company"), "owner", F.col("pct").alias("share"), F.array("owned", "owner").alias("path")).where("owner <> owned")
    out = front.select("company", "owner", "share")
    steps = 0
    while True:
        up = front.join(direct.select(F.col("owned").alias("owner"), F.col("owner").alias("__up"), "pct"), "owner")
        front = written(up.where(~F.array_contains("path", F.col("__up"))).select("company", F.col("__up").alias("owner"), (F.col("share") * F.col("pct")).alias("share"), F.array_append("path", F.col("__up")).alias("path")), "paths")
        if front.isEmpty():
            break
        if steps == depth:
            raise ValueError(f"ownership paths go on after {depth} further steps")
        steps += 1
        out = out.unionByName(front.select("company", "owner", "share"))
    top = out.join(direct.select(F.col("owned").alias("owner")).distinct(), "owner", "left_anti")
    return top.groupBy("company", "owner").agg(F.sum("share").alias("share")).where(F.col("share") >= threshold)


def hybrid_score(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean, held in [0, 1]."""
    total = sum((w * s for w, s in zip(weights, scores, strict=True)), F.lit(0.0))
    return F.least(F.greatest(total / sum(weights), F.lit(0.0)), F.lit(1.0))


def false_positive_rate(df: DataFrame, score: str, outcome: str, threshold: float) -> DataFrame:
    """(alerts, false_positives, rate) over the rows with a conclusive outcome (true or false); without any, no rate."""
    held = df.where(F.col(outcome).isNotNull() & (F.col(score) >= threshold))
    wrong = F.count(F.when(~F.col(outcome), 1))
    return held.agg(F.count("*").alias("alerts"), wrong.alias("false_positives"), safe(wrong.cast("double"), F.count("*")).alias("rate"))


def suggest_threshold(df: DataFrame, score: str, outcome: str, target: float, steps: int = 20) -> DataFrame:
    """(threshold): the lowest k / steps at which the false positive rate is at most target; all steps in one pass."""
    held = df.where(F.col(outcome).isNotNull())
    grid = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col(score) * steps + 1e-9).cast("int"))))
    rates = grid.groupBy("k").agg(F.avg((~F.col(outcome)).cast("double")).alias("rate"))
    every = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k")).join(rates, "k", "left")
    return every.where(F.coalesce("rate", F.lit(0.0)) <= target).agg((F.min("k") / steps).alias("threshold"))


def case_snapshot(df: DataFrame, case: str, order: str) -> DataFrame:
    """(case, body, digest): the rows of each case as JSON in order, and its SHA-256: equal input, equal artifact."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*(c for c in sorted(df.columns) if c != case)).alias("r")))), lambda x: x["r"]))
    return df.groupBy(case).agg(body.alias("body")).withColumn("digest", F.sha2("body", 256))
