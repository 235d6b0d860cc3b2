"""Tracing items: timelines, matching of anonymous returns, alerts and loss hotspots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from looptrace.functions.numfn import ratio
from looptrace.functions.timefn import AsOf, hours_between
from looptrace.operators.slices import previous, scanned, sliced
from looptrace.plans.cycles import linked
from looptrace.plans.packaging import open_overdue, pkg_last_location
from looptrace.plans.sensors import hot_readings
from looptrace.plans.washing import latest_inspections
from looptrace.session import stored


def _event(df: DataFrame, step: int, event: str, ref: str, at: str, place=None) -> DataFrame:
    return df.select(
        "instance_id",
        F.col(at).cast("timestamp").alias("ts"),
        F.lit(step).alias("step"),
        F.lit(event).alias("event"),
        F.col(ref).cast("bigint").alias("ref_id"),
        (F.lit(None) if place is None else F.col(place)).cast("bigint").alias("location_id"),
    )


def _washes(inspections: DataFrame, wash_cycles: DataFrame, hubs: DataFrame) -> DataFrame:
    """Washes of items with their places."""
    places = hubs.select("hub_id", "location_id")
    return _washed_items(inspections, wash_cycles).join(places, "hub_id", "left")


def _washed_items(inspections: DataFrame, wash_cycles: DataFrame) -> DataFrame:
    """A wash is known to an item through its inspections."""
    return (
        inspections.filter("wash_id IS NOT NULL")
        .select("instance_id", "wash_id")
        .distinct()
        .join(wash_cycles.select("wash_id", "hub_id", "start_time"), "wash_id")
    )


def instance_timeline(
    packaging_instances: DataFrame,
    checkouts: DataFrame,
    retailers: DataFrame,
    returns: DataFrame,
    inspections: DataFrame,
    wash_cycles: DataFrame,
    hubs: DataFrame,
    contamination_incidents: DataFrame,
    movements: DataFrame,
    slices: int | None = None,
) -> DataFrame:
    """All that happened to each item in one shape, with the hours since its event before."""
    loans = checkouts.join(retailers.select("retailer_id", "location_id"), "retailer_id", "left")
    washes = _washes(inspections, wash_cycles, hubs)
    logged = [
        _event(packaging_instances, 0, "birth", "instance_id", "birthed_at"),
        _event(loans, 1, "checkout", "checkout_id", "checkout_time", "location_id"),
        _event(returns, 2, "return", "return_id", "return_time", "location_id"),
        _event(inspections, 4, "inspection", "inspection_id", "inspected_at"),
        _event(contamination_incidents, 5, "incident", "incident_id", "detected_at"),
        _event(movements, 6, "movement", "mv_id", "moved_at", "to_loc_id"),
    ]
    washed = _event(washes, 3, "wash", "wash_id", "start_time", "location_id")
    logs = reduce(DataFrame.unionByName, [*logged, washed])
    events = previous(logs, "instance_id", ["ts", "step", "ref_id"], ["ts"], slices)
    return events.select(
        "instance_id", "ts", "event", "ref_id", "location_id",
        hours_between(F.col("prev.ts"), F.col("ts")).alias("hours_since_prev"),
    )


def match_returns(
    checkouts: DataFrame, returns: DataFrame, slices: int | None = None
) -> DataFrame:
    """Every return with its checkout: the stored link, else the one found here.

    An unlinked return closes a checkout of its item when that checkout is the event right
    before it and no other return links to it.  Looking one event back uses each checkout
    once at most and never pairs the events of an item with each other.
    """
    taken = linked(returns).select("checkout_id").distinct().withColumn("taken", F.lit(True))
    loans = checkouts.join(taken, "checkout_id", "left").select(
        "instance_id",
        F.col("checkout_time").cast("timestamp").alias("ts"),
        F.lit(0).alias("step"),
        F.col("checkout_id").alias("id"),
        F.when(F.col("taken").isNull(), F.col("checkout_id")).alias("free"),
        F.lit(None).cast("bigint").alias("link"),
    )
    backs = returns.select(
        "instance_id",
        F.col("return_time").cast("timestamp").alias("ts"),
        F.lit(1).alias("step"),
        F.col("return_id").alias("id"),
        F.lit(None).cast("bigint").alias("free"),
        F.col("checkout_id").alias("link"),
    )
    events = previous(
        loans.unionByName(backs), "instance_id", ["ts", "step", "id"], ["free"], slices
    )
    return events.filter("step = 1").select(
        F.col("id").alias("return_id"),
        "instance_id",
        F.coalesce("link", "prev.free").alias("matched_checkout_id"),
    )


def match_returns_nested(
    checkouts: DataFrame, returns: DataFrame, slices: int | None = None
) -> DataFrame:
    """Every return with its checkout: the stored link, else the newest checkout of its item before
    it that no return links to and no later return between them takes.

    Checkouts that no link takes open a loan, returns without a link close one, as brackets do.
    Running sums give the depth; where it would fall below nothing, a return has no checkout, and
    the running minimum tells how often that was.  Brackets of one item and level alternate, so a
    return's checkout is the event before it there: no pairs of events, no stack, and an item
    with any number of events may be cut into slices.
    """
    stored_links = linked(returns).select("return_id", "instance_id", "checkout_id")
    loans = checkouts.join(stored_links.select("checkout_id").distinct(), "checkout_id", "left_anti")
    opened = loans.select(
        "instance_id",
        F.col("checkout_time").cast("timestamp").alias("ts"),
        F.lit(0).alias("step"),
        F.col("checkout_id").alias("id"),
    )
    closed = returns.filter("checkout_id IS NULL").select(
        "instance_id",
        F.col("return_time").cast("timestamp").alias("ts"),
        F.lit(1).alias("step"),
        F.col("return_id").alias("id"),
    )
    order = ["ts", "step", "id"]
    cut = sliced(opened.unionByName(closed), "instance_id", order, slices)
    change = 1 - 2 * F.col("step")
    deep = scanned(cut, "instance_id", order, depth=("sum", change))
    deep = scanned(deep, "instance_id", order, low=("min", F.col("depth") + change))
    above = F.col("depth") - F.least(F.lit(0), "low")  # loans open before the event
    levels = deep.select(
        F.struct("instance_id", (above + 1 - F.col("step")).alias("level")).alias("bracket"), *order
    )
    paired = previous(levels, "bracket", order, ["step", "id"], slices).filter("step = 1")
    found = paired.select(
        F.col("id").alias("return_id"),
        "bracket.instance_id",
        F.when(F.col("prev.step") == 0, F.col("prev.id")).alias("matched_checkout_id"),
    )
    return stored_links.withColumnRenamed("checkout_id", "matched_checkout_id").unionByName(found)


# The steps of a loop, as (state before, event).  Everything else breaks it.
LOOP_STEPS = (
    ("unborn", "birth"),
    ("ready", "checkout"),
    ("out", "return"),
    ("back", "wash"),
    ("washed", "inspection"),
)


def loop_conformance(
    packaging_instances: DataFrame,
    checkouts: DataFrame,
    returns: DataFrame,
    inspections: DataFrame,
    wash_cycles: DataFrame,
    slices: int | None = None,
) -> DataFrame:
    """The loops of each item, checkout, return, wash, passed inspection, and what breaks each.

    Loop 0 is the item's birth and lasts until its first checkout; every checkout starts another.
    An event out of turn is a break of the loop it meets, named by the event and the state it meets:
    a checkout of an item that is not ready breaks the loop before its own.  A loop is complete when
    it came to its passed inspection (loop 0: to the birth) without any break.

    The states follow from two scans.  Checkouts and returns set whether an item is out.  While it is
    out, other events change nothing; else the newest event tells the state.  A failed inspection sends
    the item back to the wash.
    """
    logged = [
        _event(packaging_instances, 0, "birth", "instance_id", "birthed_at"),
        _event(checkouts, 1, "checkout", "checkout_id", "checkout_time"),
        _event(returns, 2, "return", "return_id", "return_time"),
        _event(_washed_items(inspections, wash_cycles), 3, "wash", "wash_id", "start_time"),
    ]
    judged = _event(inspections.filter("result = 'pass'"), 4, "inspection", "inspection_id", "inspected_at")
    failed = inspections.filter("result <> 'pass' OR result IS NULL")
    failed = _event(failed, 4, "inspection", "inspection_id", "inspected_at")
    logs = reduce(DataFrame.unionByName, logged).withColumn("passed", F.lit(None).cast("boolean"))
    logs = logs.unionByName(judged.withColumn("passed", F.lit(True)))
    logs = logs.unionByName(failed.withColumn("passed", F.lit(False))).drop("location_id")

    order, event = ["ts", "step", "ref_id"], F.col("event")
    cut = sliced(logs, "instance_id", order, slices)
    lent = scanned(
        cut,
        "instance_id",
        order,
        out=("last", F.when(event == "checkout", True).when(event == "return", False)),
        loans=("sum", (event == "checkout").cast("bigint")),
        earlier=("sum", F.lit(1)),
    )
    sets = (
        F.when(event == "checkout", "out")
        .when(event == "return", "back")
        .when(F.col("out"), None)
        .when(event == "wash", "washed")
        .when(event == "inspection", F.when(F.col("passed"), "ready").otherwise("back"))
        .when(F.col("earlier") == 0, "ready")
    )
    known = scanned(lent, "instance_id", order, state=("last", sets))
    state = F.coalesce("state", F.lit("unborn"))
    in_turn = reduce(
        lambda a, b: a | b, ((state == before) & (event == then) for before, then in LOOP_STEPS)
    )
    reached = in_turn & ((event == "birth") | F.coalesce("passed", F.lit(False)))
    when = F.struct(*order)
    rule = F.when(~in_turn, F.concat(event, F.lit(" while "), state))

    def of_loop(number, met, reached, rule):
        return F.struct(
            number.cast("bigint").alias("loop_no"), met.alias("met"), reached.alias("reached"),
            rule.alias("rule"),
        )

    starts = event == "checkout"
    own = of_loop(F.col("loans") + starts.cast("bigint"), F.lit(True), reached, F.when(~starts, rule))
    cut_short = of_loop(F.col("loans"), F.lit(False), F.lit(False), rule)
    both = F.when(starts & rule.isNotNull(), F.array(own, cut_short)).otherwise(F.array(own))
    rows = known.select("instance_id", "ts", when.alias("at"), F.explode(both).alias("in"))
    rows = rows.select("instance_id", "ts", "at", "in.*")
    found = rows.groupBy("instance_id", "loop_no").agg(
        F.min(F.when(F.col("met"), F.col("ts"))).alias("started_at"),
        F.count_if("met").alias("events"),
        (F.max("reached") & (F.count("rule") == 0)).alias("complete"),
        F.count("rule").alias("breaks"),
        F.min_by(F.struct("ts", "rule"), F.when(F.col("rule").isNotNull(), F.col("at"))).alias("first"),
    )
    return found.select(
        "instance_id", "loop_no", "started_at", "events", "complete", "breaks",
        F.col("first.ts").alias("break_at"), F.col("first.rule").alias("rule"),
    )


def loop_breaks(loops: DataFrame) -> DataFrame:
    """How often loops of ``loop_conformance`` first break by each rule; NULL: not broken."""
    return loops.groupBy("rule").agg(
        F.count("*").alias("loops"),
        F.count_if("complete").alias("complete"),
        F.min("break_at").alias("first_at"),
        F.max("break_at").alias("last_at"),
    )


def with_matches(returns: DataFrame, matched: DataFrame) -> DataFrame:
    """Returns whose links include those that ``match_returns`` found, for any loan report."""
    links = matched.select("return_id", "matched_checkout_id")
    return (
        returns.join(links, "return_id", "left")
        .withColumn("checkout_id", F.coalesce("checkout_id", "matched_checkout_id"))
        .select(returns.columns)
    )


def _rewash(
    inspections: DataFrame, contamination_incidents: DataFrame, min_severity: int
) -> DataFrame:
    """Items to wash again: newest inspection failed, or a grave incident after the last pass."""
    passes = inspections.filter("result = 'pass'").groupBy("instance_id")
    passes = passes.agg(F.max("inspected_at").cast("timestamp").alias("passed_at"))
    failed = latest_inspections(inspections).filter("result = 'fail'")
    failed = failed.select("instance_id", F.col("inspected_at").cast("timestamp").alias("failed_at"))
    grave = contamination_incidents.filter(F.col("severity") >= min_severity)
    grave = grave.groupBy("instance_id").agg(
        F.max("detected_at").cast("timestamp").alias("detected_at")
    )
    grave = grave.join(passes, "instance_id", "left").filter(
        F.col("passed_at").isNull() | (F.col("detected_at") > F.col("passed_at"))
    )
    found = failed.join(grave.drop("passed_at"), "instance_id", "full")
    return found.select(
        "instance_id",
        F.greatest("failed_at", "detected_at").alias("at"),
        F.when(F.col("detected_at").isNull(), "failed inspection")
        .when(F.col("failed_at").isNull(), "incident")
        .otherwise("failed inspection and incident")
        .alias("detail"),
    )


# How grave each kind of alert is, 1 to 5.
OVERDUE_SEVERITY, BREACH_SEVERITY, REWASH_SEVERITY = 2, 4, 3


def alerts(
    checkouts: DataFrame,
    returns: DataFrame,
    sensor_readings: DataFrame,
    inspections: DataFrame,
    contamination_incidents: DataFrame,
    as_of: AsOf,
    hours: int = 24,
    limit_c: float = 35,
    min_severity: int = 4,
) -> DataFrame:
    """(alert, instance_id, severity, at, detail): overdue loans, hot items, items to rewash."""
    overdue = open_overdue(checkouts, returns, as_of).select(
        F.lit("overdue").alias("alert"),
        "instance_id",
        F.lit(OVERDUE_SEVERITY).alias("severity"),
        F.col("due_date").cast("timestamp").alias("at"),
        F.concat(F.lit("checkout "), F.col("checkout_id").cast("string")).alias("detail"),
    )
    breach = (
        hot_readings(sensor_readings, as_of, hours, limit_c)
        .groupBy("instance_id")
        .agg(F.max("value").alias("peak"), F.max("measured_at").alias("at"))
        .select(
            F.lit("breach").alias("alert"),
            "instance_id",
            F.lit(BREACH_SEVERITY).alias("severity"),
            F.col("at").cast("timestamp").alias("at"),
            F.concat(F.lit("peak "), F.col("peak").cast("string")).alias("detail"),
        )
    )
    rewash = _rewash(inspections, contamination_incidents, min_severity).select(
        F.lit("rewash").alias("alert"),
        "instance_id",
        F.lit(REWASH_SEVERITY).alias("severity"),
        "at",
        "detail",
    )
    return overdue.unionByName(breach).unionByName(rewash)


def loss_hotspots(
    packaging_instances: DataFrame,
    movements: DataFrame,
    checkouts: DataFrame,
    returns: DataFrame,
    contamination_incidents: DataFrame,
    locations: DataFrame,
    as_of: AsOf,
) -> DataFrame:
    """Last known places of items lost, damaged or overdue, ranked by their share of them."""
    overdue = open_overdue(checkouts, returns, as_of).select("instance_id").distinct()
    overdue = overdue.withColumn("overdue", F.lit(1))
    reported = contamination_incidents.groupBy("instance_id").agg(F.count("*").alias("incidents"))
    gone = F.when(F.col("state").isin("lost", "damaged"), 1).otherwise(0)
    items = (
        packaging_instances.select("instance_id", gone.alias("lost"))
        .join(overdue, "instance_id", "left")
        .join(reported, "instance_id", "left")
        .filter("lost = 1 OR overdue = 1 OR incidents > 0")
        .join(pkg_last_location(movements).drop("moved_at"), "instance_id", "left")
    )
    counts = ["lost", "overdue", "incidents"]
    names = locations.select(F.col("location_id").alias("to_loc_id"), F.col("name").alias("location"))
    places = (
        items.groupBy("to_loc_id")
        .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
        .join(names, "to_loc_id", "left")
        .groupBy("location")
        .agg(*(F.sum(c).alias(c) for c in counts))
        .withColumn("missing", F.col("lost") + F.col("overdue"))
    )
    places = stored(places, "places")  # used twice: for the ranks and for the rows
    return places.join(_ranks(places), "missing").select("location", *counts, "share", "rank")


SIZES = 64  # binary lengths a count may have


def _ranks(places: DataFrame) -> DataFrame:
    """(missing, rank, share) per distinct count, so that no window sees the places themselves.

    Counts are ranked among those of their binary length; each length hands its number of
    places to all shorter ones, and its sum to all.
    """
    per_count = (
        places.groupBy("missing")
        .agg(F.count("*").alias("n"))
        .withColumn("size", F.length(F.bin("missing")))
    )
    per_size = per_count.groupBy("size").agg(
        F.sum("n").alias("places"), F.sum(F.col("missing") * F.col("n")).alias("items")
    )
    longer = F.when(F.col("size") > F.col("to"), F.col("places")).otherwise(0)
    handed = (
        per_size.withColumn("to", F.explode(F.sequence(F.lit(1), F.lit(SIZES))))
        .groupBy("to")
        .agg(F.sum(longer).alias("above"), F.sum("items").alias("total"))
    )
    greater = Window.partitionBy("size").orderBy(F.desc("missing"))
    greater = greater.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_count.withColumn("among", F.coalesce(F.sum("n").over(greater), F.lit(0)))
        .join(handed, F.col("size") == F.col("to"))
        .select(
            "missing",
            (F.col("above") + F.col("among") + 1).alias("rank"),
            ratio(F.col("missing"), F.nullif(F.col("total"), F.lit(0))).alias("share"),
        )
    )
