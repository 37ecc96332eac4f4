"""Query-log analysis: cluster access, batch loads, measured cost, stragglers, deadlines.

A log is ``trace(qid, ranked ARRAY<INT>)``: one row per query, clusters best first. Measured cost is
``profile(cluster_id, size, latency_s)``, power is ``power(frequency_mhz, busy_watts, idle_watts)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.positions import with_positions
from vectorloom.operators.sizing import checkpointed

_FANOUT_COLUMNS = 64  # fan-outs summed as columns of one aggregation
_TASK_QUERIES = 50_000  # queries whose loads one task of the sweep holds

def top_clusters_explode(trace: DataFrame, c: int) -> DataFrame:
    """``(qid, rk, cluster_id)``: the first ``c`` entries of every ranked list."""
    chosen = trace.select("qid", F.posexplode(F.slice("ranked", 1, c)).alias("pos", "cluster_id"))
    return chosen.select("qid", (F.col("pos") + 1).alias("rk"), "cluster_id")


def cluster_access_freq(trace: DataFrame, sizes: DataFrame, c: int) -> DataFrame:
    """``(cluster_id, document_count, access_count)``; clusters nobody asked for count 0."""
    accesses = top_clusters_explode(trace, c).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("access_count"))
    return sizes.join(accesses, "cluster_id", "left").select(
        "cluster_id", "document_count", F.coalesce("access_count", F.lit(0)).alias("access_count")
    )


def log_batches(trace: DataFrame, batch_size: int, mode: str = "aligned") -> DataFrame:
    """Add ``batch``: runs of ``batch_size`` queries in log order.

    ``aligned``: batch i holds positions i*B .. i*B+B-1, an incomplete last batch is kept.
    ``compat``: a batch closes at every position divisible by B, so the first query is a batch of its
    own and an incomplete tail is dropped.
    """
    placed = with_positions(trace, "qid")
    if mode == "aligned":
        return placed.withColumn("batch", F.floor(F.col("pos") / batch_size).cast("bigint")).drop("pos")
    if mode != "compat":
        raise ValueError("mode must be 'aligned' or 'compat'")
    batch = F.ceil(F.col("pos") / batch_size).cast("bigint")
    last = placed.agg(F.max("pos").alias("hi")).head().hi
    closed = -1 if last is None else last // batch_size
    return placed.withColumn("batch", batch).where(F.col("batch") <= closed).drop("pos")


def batch_cluster_load(batched: DataFrame, c: int) -> DataFrame:
    """``(batch, cluster_id, load)``: how many queries of a batch ask each of their top ``c`` clusters."""
    asked = batched.select("batch", F.explode(F.slice("ranked", 1, c)).alias("cluster_id"))
    return asked.groupBy("batch", "cluster_id").agg(F.count(F.lit(1)).alias("load"))


#: Loads in a range of the forward look-up.
_CUT = 65_536


def ceiling_table(profile: DataFrame, loads: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """The profile with one row for every integer load that occurs, up to its largest size.

    A load takes the cost of the smallest profiled size that is not below it. Spelling that out per
    load turns the forward as-of look-up into a plain equi-join. Loads end at the largest one in ``loads``, so the
    table has at most that many rows per key, however large the profiled sizes are.
    """
    most = loads.agg(F.coalesce(F.max("load"), F.lit(0)).cast("bigint")).scalar()
    w = Window.partitionBy(*keys).orderBy("size")
    previous = F.coalesce(F.lag("size").over(w), F.lit(0))
    stepped = profile.withColumn("_from", (previous + 1).cast("bigint"))
    stepped = stepped.withColumn("_to", F.least(F.col("size").cast("bigint"), most)).where(F.col("_from") <= F.col("_to"))
    steps = F.explode(F.sequence("_from", "_to"))
    return stepped.withColumn("load", steps).drop("_from", "_to")


def ceiling_steps(loads: DataFrame, profile: DataFrame, keys: Sequence[str] = ("cluster_id",), cut: int = _CUT) -> DataFrame:
    """``(*keys, load, step)``: every load that occurs, with the profile's row of the smallest size that is not below it, if there is one.

    A forward as-of merge: loads and profiled sizes of a key are read once, largest first, and each load takes the size read last. The work
    depends on how many different loads occur, not on how large they are. A key's axis is cut every ``cut`` loads, so that
    no key is sorted by one task; what a range finds beyond its end comes from a table with a row per range. Of several rows with the same
    size the one with the least other values counts; sizes and loads that are NULL match nothing.
    """
    keys = list(keys)
    others = [c for c in profile.columns if c not in keys]
    row = F.struct("size", *[c for c in others if c != "size"])
    known = profile.where(F.col("size").isNotNull()).groupBy(*keys, F.col("size").cast("double").alias("_at")).agg(F.min(row).alias("step"))
    asked = loads.where(F.col("load").isNotNull()).select(*keys, "load").distinct()
    both = known.withColumns({"load": F.lit(None).cast(loads.schema["load"].dataType), "_kind": F.lit(1)}).unionByName(
        asked.withColumns({"_at": F.col("load").cast("double"), "_kind": F.lit(0), "step": F.lit(None).cast(known.schema["step"].dataType)})
    )
    both = both.withColumn("_range", F.floor(F.col("_at") / cut))
    ends = both.groupBy(*keys, "_range").agg(F.min("step").alias("step"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.withColumn("step", F.last("step", ignorenulls=True).over(before)).where(F.col("step").isNotNull())
    beyond = beyond.withColumns({"_at": F.lit(float("inf")), "load": F.lit(None).cast(loads.schema["load"].dataType), "_kind": F.lit(2)})
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(beyond).withColumn("step", F.last("step", ignorenulls=True).over(down))
    return found.where("_kind = 0").select(*keys, "load", "step")


def ceiling_lookup(loads: DataFrame, profile: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Add ``size`` and ``latency_s`` of the smallest profiled size >= load; NULL if there is none."""
    steps = ceiling_steps(loads, profile.select(*keys, "size", "latency_s"), keys)
    return loads.join(steps, [*keys, "load"], "left").select(*loads.columns, "step.size", "step.latency_s")


def sampling_cost(profile: DataFrame, batch_size: int) -> DataFrame:
    """One row ``(sampling_s)``: the largest profiled cost of a whole batch over all clusters; NULL if that size wasn't profiled."""
    return profile.where(F.col("size") == batch_size).agg(F.max("latency_s").alias("sampling_s"))


def with_sampling(rows: DataFrame, sampling: DataFrame | None) -> DataFrame:
    """Add ``sampling_s`` from the one row of :func:`sampling_cost`; 0 without a sampling step."""
    cost = F.lit(0.0) if sampling is None else sampling.select(F.col("sampling_s").cast("double")).scalar()
    return rows.withColumn("sampling_s", cost)


def straggler_cost(costed: DataFrame, sampling: DataFrame | None = None) -> DataFrame:
    """``(batch, deep_s, batch_s)``: a batch waits for its slowest cluster, after the sampling step.

    A batch with a load outside the profile, or with a sampling step of unknown cost, has no known cost (NULL); it is not dropped.
    """
    known = F.count("latency_s") == F.count(F.lit(1))
    worst = costed.groupBy("batch").agg(F.when(known, F.max("latency_s")).alias("deep_s"))
    return with_sampling(worst, sampling).select("batch", "deep_s", (F.col("deep_s") + F.col("sampling_s")).alias("batch_s"))


def fanout_loads(batched: DataFrame, max_fanout: int, by: Sequence[str] = ("batch",)) -> DataFrame:
    """``(c, *by, cluster_id, load)`` for every fan-out c = 1..max from one aggregation.

    An access at list position p counts for every fan-out above p. The loads of all fan-outs are sums
    over the same (batch, cluster) group, so the log is shuffled once and not repeated per fan-out.
    """
    by = list(by)
    asked = batched.select(*by, F.posexplode(F.slice("ranked", 1, max_fanout)).alias("pos", "cluster_id"))
    if max_fanout > _FANOUT_COLUMNS:
        # too many sums for one aggregation: repeat the counts per list position instead
        counts = asked.groupBy(*by, "cluster_id", "pos").agg(F.count(F.lit(1)).alias("n"))
        spread = counts.withColumn("c", F.explode(F.sequence(F.col("pos") + 1, F.lit(max_fanout))))
        return spread.groupBy("c", *by, "cluster_id").agg(F.sum("n").alias("load"))
    sums = [F.count(F.when(F.col("pos") < c, 1)).alias(f"load_{c}") for c in range(1, max_fanout + 1)]
    wide = asked.groupBy(*by, "cluster_id").agg(*sums)
    per_fanout = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"load_{c}").alias("load")) for c in range(1, max_fanout + 1)])
    long = wide.select(*by, "cluster_id", F.explode(per_fanout).alias("f"))
    return long.select("f.c", *by, "cluster_id", "f.load").where(F.col("load") > 0)


def _load_runs(batched: DataFrame, max_fanout: int, by: Sequence[str], n_tasks: int) -> DataFrame:
    """``(*by, cluster_id, load, first, last)``: the loads of :func:`fanout_loads` with a row for all fan-outs ``first`` .. ``last`` that have the same one.

    The log is shuffled once, a row per query; a load only grows with the fan-out, so most accesses are one row for all fan-outs.
    """
    by = list(by)
    whole = batched.select(*by, F.slice("ranked", 1, max_fanout).alias("ranked")).repartition(n_tasks, *by)
    asked = whole.select(*by, F.posexplode("ranked").alias("pos", "cluster_id"))
    counts = asked.groupBy(*by, "cluster_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "cluster_id").orderBy("pos")
    return counts.select(
        *by,
        "cluster_id",
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("load"),
        (F.col("pos") + 1).alias("first"),
        F.coalesce(F.lead("pos").over(w), F.lit(max_fanout)).alias("last"),
    )


def cost_by_fanout(
    batched: DataFrame, profile: DataFrame, max_fanout: int, batch_size: int, sampling: DataFrame | None = None
) -> DataFrame:
    """``(c, n_batches, mean_s, throughput_qps)``: mean batch cost and throughput per fan-out; NULL if the sampling step's cost is unknown."""
    costed = ceiling_lookup(fanout_loads(batched, max_fanout), profile)
    known = F.count("latency_s") == F.count(F.lit(1))
    worst = costed.groupBy("c", "batch").agg(F.when(known, F.max("latency_s")).alias("deep_s"))
    means = with_sampling(worst, sampling).groupBy("c").agg(
        F.count("deep_s").alias("n_batches"), F.avg(F.col("deep_s") + F.col("sampling_s")).alias("mean_s")
    )
    return means.withColumn("throughput_qps", F.try_divide(F.lit(float(batch_size)), F.col("mean_s")))


def cost_sweep(
    trace: DataFrame,
    profile: DataFrame,
    sample_nprobe: Sequence[int],
    deep_nprobe: Sequence[int],
    batch_sizes: Sequence[int],
    max_fanout: int,
    mode: str = "aligned",
) -> DataFrame:
    """Mean batch cost and throughput for every combination of settings, in one job.

    ``profile(cluster_id, size, nprobe, k, threads, latency_s)``. Returns ``(sample_nprobe, deep_nprobe, k,
    threads, batch_size, c, n_batches, mean_s, throughput_qps)``. The log is batched once per batch size, and
    one join looks up all settings: neither settings nor fan-outs multiply the rows that are shuffled. A batch counts for a setting only if the setting has a cost for all
    its loads (``mean_s`` is NULL if no batch does). Settings whose sampling step was not profiled at the batch
    size are left out.
    """
    setting, batch = ["nprobe", "k", "threads"], ["batch_size", "batch"]
    sizes = [log_batches(trace, size, mode).withColumn("batch_size", F.lit(size)) for size in batch_sizes]
    # a fixed share of the log per task, however well its rows are compressed
    n_tasks = max(1, -(-trace.count() * len(sizes) // _TASK_QUERIES))
    loads = _load_runs(reduce(DataFrame.unionByName, sizes), max_fanout, batch, n_tasks)
    deep = profile.where(F.col("nprobe").isin(list(deep_nprobe)))
    table = ceiling_table(deep.select("cluster_id", *setting, "size", "latency_s"), loads, ("cluster_id", *setting))
    # settings are few: a load meets the costs of all of them in one row, under their numbers
    settings = deep.select(*setting).distinct().coalesce(1).withColumn("setting", F.monotonically_increasing_id().cast("int"))
    settings = checkpointed(settings)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in setting])
    numbered = table.join(F.broadcast(settings.withColumnsRenamed({c: f"_{c}" for c in setting})), same)
    entry = F.struct("setting", "n", "latency_s")
    costs = (
        numbered.groupBy("cluster_id", "load", "setting")
        .agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("latency_s").alias("latency_s"))
        .groupBy("cluster_id", "load")
        .agg(F.sort_array(F.collect_list(entry)).alias("costs"))
        .select("cluster_id", "load", *[F.col(f"costs.{c}").alias(f"_{c}") for c in ("setting", "n", "latency_s")])
    )
    costed = loads.join(costs, ["cluster_id", "load"], "left").drop("cluster_id", "load").repartition(n_tasks, *batch)
    # setting -1 counts the clusters a batch waits for; all of a batch is in one task from here on
    waits = F.array(F.struct(F.lit(-1).alias("_setting"), F.lit(1).alias("_n"), F.lit(None).cast(profile.schema["latency_s"].dataType).alias("_latency_s")))
    known = F.when(F.col("_setting").isNotNull(), F.arrays_zip("_setting", "_n", "_latency_s"))
    spread = costed.select(*batch, F.explode(F.sequence("first", "last")).alias("c"), F.concat(waits, F.coalesce(known, F.slice(waits, 1, 0))).alias("e"))
    spread = spread.select(*batch, "c", F.explode("e").alias("e"))
    worst = spread.groupBy(*batch, "c", F.col("e._setting").alias("setting")).agg(
        F.sum("e._n").alias("n"), F.max("e._latency_s").alias("latency_s")
    )
    n_loads = F.max(F.when(F.col("setting") == -1, F.col("n"))).over(Window.partitionBy(*batch, "c"))
    worst = worst.withColumn("deep_s", F.when(F.col("n") == n_loads, F.col("latency_s"))).where("setting >= 0").join(F.broadcast(settings), "setting")
    means = worst.groupBy(*setting, "batch_size", "c").agg(
        F.count("deep_s").alias("n_batches"), F.avg("deep_s").alias("deep_s")
    )
    sampling = (
        profile.where(F.col("nprobe").isin(list(sample_nprobe)) & F.col("size").isin(list(batch_sizes)))
        .groupBy(F.col("nprobe").alias("sample_nprobe"), "k", "threads", F.col("size").alias("batch_size"))
        .agg(F.max("latency_s").alias("sampling_s"))
    )
    grid = sampling.join(deep.select(*setting).distinct(), ["k", "threads"])
    grid = grid.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(max_fanout))))
    total = grid.join(means, [*setting, "batch_size", "c"], "left")
    total = total.withColumn("mean_s", F.col("sampling_s") + F.col("deep_s"))
    return total.select(
        "sample_nprobe",
        F.col("nprobe").alias("deep_nprobe"),
        "k",
        "threads",
        "batch_size",
        "c",
        F.coalesce("n_batches", F.lit(0)).alias("n_batches"),
        "mean_s",
        F.try_divide(F.col("batch_size").cast("double"), F.col("mean_s")).alias("throughput_qps"),
    )


def frontier(priced: DataFrame, loads: DataFrame, top: int | None = None) -> DataFrame:
    """``(cluster_id, load, frequency_mhz, size, latency_s, busy_watts, idle_watts)``: for every load that occurs, the settings worth a look.

    Each frequency takes its smallest profiled size that is not below the load (:func:`ceiling_steps`). A setting is left out if another one
    with the same idle power is no slower and needs no more energy beyond its idle power: it is no worse under any deadline. What is
    left is a skyline, found by a running minimum over ascending times. The setting of the frequency ``top`` always stays.
    """
    asked = loads.select("cluster_id", "load").distinct().join(priced.select("cluster_id", "frequency_mhz").distinct(), "cluster_id")
    steps = ceiling_steps(asked, priced, ("cluster_id", "frequency_mhz")).where(F.col("step").isNotNull())
    rows = steps.select("cluster_id", "load", "frequency_mhz", "step.*")
    beyond_idle = F.col("latency_s") * (F.col("busy_watts") - F.col("idle_watts"))
    faster = Window.partitionBy("cluster_id", "load", "idle_watts").orderBy("latency_s", "_beyond", "frequency_mhz").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_beyond", beyond_idle).withColumn("_least", F.min("_beyond").over(faster))
    worth = F.col("_least").isNull() | (F.col("_beyond") < F.col("_least"))
    return ranked.where(worth if top is None else worth | (F.col("frequency_mhz") == top)).drop("_beyond", "_least")


def cheapest_under_deadline(
    loads: DataFrame, profile: DataFrame, power: DataFrame, slack_s: float = 0.0, by: Sequence[str] = ("batch",)
) -> DataFrame:
    """``(*by, cluster_id, load, base_j, scaled_j, enhanced_j)``: cheapest setting that keeps the deadline.

    ``profile(cluster_id, frequency_mhz, size, latency_s)``. At the top frequency a cluster takes its
    base latency, and the batch as long as its slowest cluster. A lower frequency is an option if its
    latency is strictly below that straggler time (``scaled``) or below the larger of straggler time
    and ``slack_s`` (``enhanced``); energy is busy power while searching plus idle power for the rest
    of the straggler time. Without a better option the base energy stands. A batch with a load outside
    the profile at the top frequency has no known straggler time: its energies are NULL. Only the settings on the :func:`frontier` are compared.
    """
    priced = profile.join(power, "frequency_mhz")
    # the top clock is the largest that was measured and has a power
    top = priced.agg(F.max("frequency_mhz").alias("top")).head().top
    options = (
        frontier(priced, loads, top)
        .groupBy("cluster_id", "load")
        .agg(F.sort_array(F.collect_list(F.struct("frequency_mhz", "latency_s", "busy_watts", "idle_watts"))).alias("options"))
    )
    matched = loads.join(options, ["cluster_id", "load"], "left")
    matched = matched.withColumn("base", F.get(F.filter("options", lambda o: o["frequency_mhz"] == F.lit(top)), 0))
    # a batch is a small group (at most its queries times the fan-out), so its maximum is a window
    batch = Window.partitionBy(*by)
    known = F.count("base.latency_s").over(batch) == F.count(F.lit(1)).over(batch)
    timed = matched.withColumn("straggler_s", F.when(known, F.max("base.latency_s").over(batch)))
    bound = F.col("straggler_s")

    def energy(o):
        return o["latency_s"] * o["busy_watts"] + F.greatest(bound - o["latency_s"], F.lit(0.0)) * o["idle_watts"]

    def cheapest(limit):
        feasible = F.filter("options", lambda o: o["latency_s"] < limit)
        return F.least(F.col("base_j"), F.array_min(F.transform(feasible, energy)))

    timed = timed.withColumn("base_j", F.when(bound.isNotNull(), energy(F.col("base"))))
    return timed.select(
        *by,
        "cluster_id",
        "load",
        "base_j",
        F.when(bound.isNotNull(), cheapest(bound)).alias("scaled_j"),  # greatest/least skip NULLs
        F.when(bound.isNotNull(), cheapest(F.greatest(bound, F.lit(float(slack_s))))).alias("enhanced_j"),
    )


def batch_energy(per_cluster: DataFrame, by: Sequence[str] = ("batch",)) -> DataFrame:
    """Energy sums per batch; unknown if one of its clusters is."""
    names = ["base_j", "scaled_j", "enhanced_j"]
    known = {n: F.count(n) == F.count(F.lit(1)) for n in names}
    return per_cluster.groupBy(*by).agg(*[F.when(known[n], F.sum(n)).alias(n) for n in names])


def energy_by_fanout(
    batched: DataFrame,
    profile: DataFrame,
    sample_profile: DataFrame,
    power: DataFrame,
    max_fanout: int,
    batch_size: int,
    slack_s: float = 0.0,
) -> DataFrame:
    """``(c, n_batches, base_j, scaled_j, enhanced_j)``: mean energy of a batch per fan-out.

    A batch pays for the sampling step, where each cluster serves the whole batch, and for its deep
    searches (:func:`cheapest_under_deadline`). Slack helps the deep searches only.
    """
    whole = sample_profile.select("cluster_id").distinct().select(
        F.lit(0).alias("batch"), "cluster_id", F.lit(batch_size).cast("bigint").alias("load")
    )
    sampling = batch_energy(cheapest_under_deadline(whole, sample_profile, power)).head()
    base, scaled = (None, None) if sampling is None else (sampling.base_j, sampling.scaled_j)
    loads = fanout_loads(batched, max_fanout)
    deep = batch_energy(cheapest_under_deadline(loads, profile, power, slack_s, ("c", "batch")), ("c", "batch"))

    def mean(name, step):
        return F.avg(F.col(name) + F.lit(step).cast("double")).alias(name)

    return deep.groupBy("c").agg(
        F.count("base_j").alias("n_batches"), mean("base_j", base), mean("scaled_j", scaled), mean("enhanced_j", scaled)
    )
