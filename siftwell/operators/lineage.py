"""Lineage: what is stale, and what depends on what.

Relations, cut times and edges are DataFrames, however many there are. Each
round of a walk is written to the shared folder, so a long chain neither grows
the plan nor is lost with an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

FRESH, STALE, UNKNOWN = "fresh", "stale", "unknown"


# Rounds after which the pieces found so far are written as one.
MERGE_ROUNDS = 16


def _reach(links: DataFrame, start: DataFrame) -> DataFrame:
    """Every child that leads to a name in ``start`` over (child, parent)
    links, the start included; each once. Other columns of ``start`` travel
    along, and a name is found once with each of their values."""
    columns = start.columns
    frontier = found = written(start.distinct())
    rounds = 0
    while not frontier.isEmpty():
        nxt = (links.join(frontier.withColumnRenamed("name", "parent"), "parent").drop("parent")
               .withColumnRenamed("child", "name").select(columns).distinct())
        frontier = written(nxt.join(found, columns, "left_anti"))
        found = found.unionByName(frontier)
        rounds += 1
        if rounds % MERGE_ROUNDS == 0:
            found = written(found)
    return found


def dependents(edges: DataFrame, name: str) -> DataFrame:
    """Every slice that reads ``name``, directly or through other slices.

    ``edges`` has (child, parent). One column, ``name``; each slice once.
    """
    links = written(edges.select("child", "parent"))
    direct = links.filter(F.col("parent") == name).select(F.col("child").alias("name"))
    return _reach(links, direct).filter(F.col("name") != name)


def edge_facts(slices: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with what it says by itself.

    ``slices`` (name, cut_at) and ``sources`` (name, loaded_at) may hold null
    times. ``direct`` is stale when the parent changed after the cut, unknown
    when the parent is gone or its time was never recorded, else fresh; it is
    what the edge says before the parent's own state is known.
    """
    known = (sources.select(F.col("name").alias("parent"), F.col("loaded_at").alias("changed_at"),
                            F.lit(False).alias("is_slice"))
             .unionByName(slices.select(F.col("name").alias("parent"), F.col("cut_at").alias("changed_at"),
                                        F.lit(True).alias("is_slice"))))
    # A source wins over a slice of the same name.
    known = known.groupBy("parent").agg(F.min_by("changed_at", "is_slice").alias("changed_at"),
                                        F.min("is_slice").alias("is_slice"))
    cuts = slices.select(F.col("name").alias("child"), "cut_at").filter(F.col("cut_at").isNotNull())
    return (edges.select("child", "parent").distinct().join(cuts, "child").join(known, "parent", "left")
            .select("child", "parent", F.coalesce("is_slice", F.lit(False)).alias("is_slice"),
                    F.when(F.col("is_slice").isNull(), UNKNOWN).when(F.col("changed_at") > F.col("cut_at"), STALE)
                    .when(F.col("changed_at").isNull(), UNKNOWN).otherwise(FRESH).alias("direct")))


def staleness(slices: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, state) of every slice: stale, unknown or fresh, in that order of
    precedence.

    Stale: an input changed after the cut, or is itself stale. Fresh: every
    input is known not to have changed and is itself fresh. Anything else is
    unknown: no cut time, no recorded input, an input gone, or a cycle. A slice
    without a cut time is never stale, and passes nothing on.
    """
    facts = written(edge_facts(slices, sources, edges))
    between = facts.filter("is_slice").select("child", "parent")

    stale = _reach(between, facts.filter(F.col("direct") == STALE).select(F.col("child").alias("name")))

    # Fresh from the sources upwards: a slice is fresh once nothing it reads is
    # left in doubt. What is stale, waits for something that is not fresh, or
    # goes round in a circle never gets there.
    ruled_out = stale.unionByName(facts.filter(F.col("direct") == UNKNOWN).select(F.col("child").alias("name")))
    waiting = written(
        facts.groupBy(F.col("child").alias("name")).agg(F.count_if("is_slice").alias("open"))
        .join(ruled_out, "name", "left_anti")
        .withColumn("round", F.when(F.col("open") == 0, 0)))
    rounds = 0
    while not (frontier := waiting.filter(F.col("round") == rounds)).isEmpty():
        rounds += 1
        settled = (between.join(frontier.select(F.col("name").alias("parent")), "parent")
                   .groupBy(F.col("child").alias("name")).agg(F.count("parent").alias("settled")))
        left = F.col("open") - F.coalesce("settled", F.lit(0))
        waiting = written(waiting.join(settled, "name", "left").select(
            "name", left.alias("open"), F.coalesce("round", F.when(left == 0, rounds)).alias("round")))
    fresh = waiting.filter(F.col("round").isNotNull()).select("name")

    states = (stale.withColumn("state", F.lit(STALE)).unionByName(fresh.withColumn("state", F.lit(FRESH))))
    return (slices.select("name").distinct().join(states, "name", "left")
            .select("name", F.coalesce("state", F.lit(UNKNOWN)).alias("state")))


def roots(slices: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, root): for every stale slice the inputs, its own or further up,
    that changed after something was cut from them; each once."""
    return _roots(edge_facts(slices, sources, edges))


def _roots(facts: DataFrame) -> DataFrame:
    facts = written(facts)
    changed = facts.filter(F.col("direct") == STALE).select(F.col("child").alias("name"), F.col("parent").alias("root"))
    return _reach(facts.filter("is_slice").select("child", "parent"), changed)


def reasons(slices: DataFrame, sources: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """(name, input, reason): why a slice is not fresh, one row per cause.

    An input that is stale itself has a row for each of its ``roots``; one that
    also changed after the cut has a row for that.
    """
    facts = written(edge_facts(slices, sources, edges))
    upstream = states.select(F.col("name").alias("parent"), F.col("state").alias("parent_state"))
    inherited = facts.filter("is_slice").join(_roots(facts).withColumnRenamed("name", "parent"), "parent").select(
        F.col("child").alias("name"), F.col("parent").alias("input"),
        F.concat("parent", F.lit(" is stale itself, as "), "root", F.lit(" changed")).alias("reason"))
    per_edge = (facts.join(upstream, "parent", "left").select(
        F.col("child").alias("name"), F.col("parent").alias("input"),
        F.when(F.col("direct") == STALE, F.concat("parent", F.lit(" changed after this was cut")))
        .when(F.col("is_slice") & (F.col("parent_state") == UNKNOWN),
              F.concat(F.lit("the state of "), "parent", F.lit(" is unknown")))
        .when(~(F.col("is_slice") & F.col("parent_state").eqNullSafe(STALE)) & (F.col("direct") == UNKNOWN),
              F.concat("parent", F.lit(" is gone, or its time was not recorded")))
        .alias("reason")).filter(F.col("reason").isNotNull()).unionByName(inherited))
    has_input = edges.select(F.col("child").alias("name")).distinct()
    none = F.lit(None).cast("string").alias("input")
    no_time = slices.filter(F.col("cut_at").isNull()).select(
        "name", none, F.lit("no cut time was recorded").alias("reason"))
    no_input = (slices.filter(F.col("cut_at").isNotNull()).join(has_input, "name", "left_anti")
                .select("name", none, F.lit("what it reads was not recorded").alias("reason")))
    return per_edge.unionByName(no_time).unionByName(no_input)
