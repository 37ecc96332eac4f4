"""Quality of three search strategies over a grid of settings, each table scored once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.ivf import IvfIndex, probe_lists, search_probed, stack_indexes
from vectorloom.operators.match import best_per, merge_tasks
from vectorloom.operators.quality import quality_by_config
from vectorloom.operators.search import exact_topk, rank_parts
from vectorloom.operators.sizing import checkpointed, let_go, table_shape

CONFIG = ["sample_nprobe", "deep_nprobe", "k", "c"]
STRATEGIES = ["monolithic", "split", "routed"]
_HELD = StorageLevel.MEMORY_AND_DISK
_ROUND_PROBES = 1_600_000  # probed lists of the queries of one round
_LEAST_TASKS = 8  # over which the hits of a round are dealt


def _pair(a: Column, b: Column) -> Column:
    """Two integers as one, the key of a map."""
    return F.shiftleft(a.cast("bigint"), 32) + b.cast("bigint")


def asked_lists(queries: DataFrame, index: IvfIndex, nprobe: int, keep: Column, **match) -> DataFrame:
    """``(qid, asked)``: the probes of a query that ``keep`` selects as one map, from part and list to ``probe_rk``."""
    probes = probe_lists(queries, index.coarse, nprobe, **match).where(keep)
    entry = F.struct(_pair(F.col("part_id"), F.col("list_id")), "probe_rk")
    return probes.groupBy("qid").agg(F.map_from_entries(F.collect_list(entry)).alias("asked"))


def list_hits(queries: DataFrame, index: IvfIndex, k: int, asked: DataFrame, n_tasks: int, **match) -> DataFrame:
    """``(qid, part_id, probe_rk, vec_id, score)``: top ``k`` per list of ``asked``.

    The top-k of a union is the top-k of the top-k lists, so every smaller setting is a filter on
    ``probe_rk`` before the lists are merged. Hits are dealt by query over ``n_tasks``, as a search of several shares leaves them (it isn't
    repeated then), and get their ``probe_rk`` by a join on the query alone.
    """
    probes = asked.select("qid", F.explode("asked").alias("pair", "probe_rk"))
    probes = probes.select("qid", F.shiftright("pair", 32).cast("int").alias("part_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("list_id"))
    hits = search_probed(queries, index, probes, k, per=("part_id", "list_id"), **match).repartition(n_tasks, "qid")
    rank = F.try_element_at("asked", _pair(F.col("part_id"), F.col("list_id")))
    return hits.join(asked.repartition(n_tasks, "qid"), "qid").select("qid", "part_id", rank.alias("probe_rk"), "vec_id", "score")


def _repeat_for(hits: DataFrame, column: str, values: Sequence[int], name: str) -> DataFrame:
    """Each row once for every setting ``name`` that is at least the row's ``column``."""
    settings = F.array(*[F.lit(v) for v in sorted(set(values))])
    return hits.withColumn(name, F.explode(F.filter(settings, lambda v: v >= F.col(column))))


def fan_out_quality(hits: DataFrame, by: Sequence[str], entry: Column, fans: Column, ks: Column) -> DataFrame:
    """``(*by, c, k, recall, ndcg)`` for every fan-out c of ``fans`` and every k of ``ks``; a hit takes part from c = ``entry`` on.

    ``hits`` carry ``true_rk``, their rank in the query's true list (NULL if they aren't in it), and ``n_true``, the length of that list. A group
    holds the hits of one query and setting, at most k per part. It is sorted once, each fan-out takes its
    prefix of that order, and only one row per query and setting leaves the group.
    """
    order = F.struct((-F.col("score")).alias("neg"), "vec_id", entry.alias("entry"), "true_rk")
    packed = hits.groupBy(*by).agg(F.sort_array(F.collect_list(order)).alias("found"), F.first("n_true").alias("n_true"))

    def gain(rank: Column) -> Column:
        return F.lit(1.0) / F.log2(rank + F.lit(1))

    def scores(c: Column, k: Column) -> Column:
        best = F.slice(F.filter("found", lambda h: h["entry"] <= c), F.lit(1), k)
        gains = F.transform(best, lambda h, i: F.when(h["true_rk"] <= k, gain(i + F.lit(1))).otherwise(F.lit(0.0)))
        dcg = F.aggregate(gains, F.lit(0.0), lambda total, g: total + g)
        length = F.least(F.col("n_true"), k)
        ideal = F.aggregate(F.sequence(F.lit(1), length), F.lit(0.0), lambda total, r: total + gain(r))
        n_hits = F.size(F.filter(best, lambda h: h["true_rk"] <= k))
        return F.struct(c.alias("c"), k.alias("k"), (n_hits / length).alias("recall"), (dcg / ideal).alias("ndcg"))

    settings = F.flatten(F.transform(fans, lambda c: F.transform(ks, lambda k: scores(c, k))))
    rows = packed.select(*[c for c in by if c != "k"], F.explode(settings).alias("s"))
    return rows.select(*[c for c in by if c != "k"], "s.*")


def quality_sweep(
    queries: DataFrame,
    corpus: DataFrame,
    monolithic: IvfIndex,
    splits: IvfIndex,
    clusters: IvfIndex,
    n_parts: int,
    sample_nprobe: Sequence[int],
    deep_nprobe: Sequence[int],
    k: Sequence[int],
    monolithic_nprobe: int,
    **match,
) -> DataFrame:
    """Mean recall and NDCG per (sample_nprobe, deep_nprobe, k, c), c = 1..n_parts.

    ``monolithic`` has the single part 0, the others the parts 0..n_parts-1.
    Scores are computed once, at the largest setting; the grid is filters, small
    per-list merges and aggregations. Fan-outs are spelled out only after each part has been cut to
    k hits, inside the group of one query. Queries go in rounds of bounded size, and only a round's sums are kept, so the
    disk that is held doesn't grow with the hits of all queries. Within a round hits are shuffled by query, and stay so.
    """
    spark, k_max = queries.sparkSession, max(k)

    def at_k(hits: DataFrame, by: Sequence[str]) -> DataFrame:
        """Rank once, then repeat a row for every k it belongs to."""
        return _repeat_for(best_per(hits, k_max, by, id_col="vec_id"), "rk", k, "k")

    # the true list of a query as one map, so that every hit is marked by a single join
    truth = checkpointed(
        exact_topk(queries, corpus, k_max, **match).groupBy("qid").agg(
            F.map_from_entries(F.collect_list(F.struct("vec_id", "rk"))).alias("true_list")
        )
    )
    n_queries = truth.count()
    let_go(spark)

    # all three indexes are probed and searched in one pass: parts 0, 1..n and n+1..2n
    stacked = stack_indexes([(monolithic, 0), (splits, 1), (clusters, 1 + n_parts)])
    part, largest = F.col("part_id"), max([*deep_nprobe, *sample_nprobe])
    allowed = F.when(part == 0, monolithic_nprobe).when(part <= n_parts, max(deep_nprobe)).otherwise(largest)
    every_k, one, fans = F.array(*[F.lit(v) for v in sorted(set(k))]), F.lit(1), F.sequence(F.lit(1), F.lit(n_parts))

    def scored_hits(searched: DataFrame) -> dict[str, DataFrame]:
        """Quality per query and setting of each strategy."""
        # one index over everything: no fan-out, no routing
        mono = best_per(searched.where(part == 0), k_max, ["qid"], id_col="vec_id").drop("rk")
        mono = fan_out_quality(mono, ["qid"], one, F.array(one), every_k).drop("c")

        # splits: the first c of them, unrouted
        split = searched.where((part > 0) & (part <= n_parts)).withColumn("part_id", part - 1)
        split = _repeat_for(split, "probe_rk", deep_nprobe, "deep_nprobe")
        split = best_per(split, k_max, ["qid", "part_id", "deep_nprobe"], id_col="vec_id").drop("rk")
        split = fan_out_quality(split, ["qid", "deep_nprobe"], F.col("part_id") + 1, fans, every_k)

        # clusters: routes per (sample setting, k), since k hits make the sample score
        base = searched.where(part > n_parts).withColumn("part_id", part - 1 - n_parts)
        sample = at_k(_repeat_for(base, "probe_rk", sample_nprobe, "sample_nprobe"), ["qid", "part_id", "sample_nprobe"])
        means = sample.groupBy("qid", "part_id", "sample_nprobe", "k").agg(F.avg("score").alias("sample_score"))
        routes = rank_parts(means, ("qid", "sample_nprobe", "k"))
        deep = at_k(_repeat_for(base, "probe_rk", deep_nprobe, "deep_nprobe"), ["qid", "part_id", "deep_nprobe"]).drop("rk")
        # a query's routes as one map from part and k, joined on the query alone like the probes
        routes = routes.groupBy("qid", "part_id", "k").agg(F.collect_list(F.struct("sample_nprobe", "route_rk")).alias("routes"))
        routes = routes.groupBy("qid").agg(
            F.map_from_entries(F.collect_list(F.struct(_pair(F.col("part_id"), F.col("k")), "routes"))).alias("routes")
        )
        routed = deep.join(routes, "qid").withColumn("routes", F.try_element_at("routes", _pair(F.col("part_id"), F.col("k"))))
        routed = routed.select("*", F.inline("routes")).drop("routes")
        routed = fan_out_quality(routed, ["qid", "sample_nprobe", "deep_nprobe", "k"], F.col("route_rk"), fans, F.array("k"))
        return {"monolithic": mono, "split": split, "routed": routed}

    # a strategy that ignores a setting has the same value all along it: average first, repeat the mean
    own = {"monolithic": [], "split": ["deep_nprobe", "c"], "routed": ["sample_nprobe", "deep_nprobe", "c"]}
    axes = {
        "sample_nprobe": F.array(*[F.lit(v) for v in sorted(set(sample_nprobe))]),
        "deep_nprobe": F.array(*[F.lit(v) for v in sorted(set(deep_nprobe))]),
        "c": F.sequence(F.lit(1), F.lit(n_parts)),
    }

    def sums_of(strategy: str, scored: DataFrame) -> DataFrame:
        sums = scored.groupBy("k", *own[strategy]).agg(F.sum("recall").alias("recall"), F.sum("ndcg").alias("ndcg"))
        for name in axes:
            if name not in own[strategy]:
                sums = sums.withColumn(name, F.lit(None).cast("int"))
        return sums.select(F.lit(strategy).alias("strategy"), *CONFIG, "recall", "ndcg")

    n_rounds = max(1, -(-n_queries * (monolithic_nprobe + n_parts * (max(deep_nprobe) + largest)) // _ROUND_PROBES))

    def round_sums(n: int) -> list:
        """A row per setting and strategy with the sums over the queries of a round."""

        def of_round(table: DataFrame) -> DataFrame:  # not the hash that deals rows to tasks, or queries to the shares of a search
            return table if n_rounds == 1 else table.where(F.pmod(F.xxhash64("qid", F.lit("round")), F.lit(n_rounds)) == n)

        asking = of_round(queries)
        asked = asked_lists(asking, stacked, max(monolithic_nprobe, largest), F.col("probe_rk") <= allowed).persist(_HELD)
        n_tasks = max(_LEAST_TASKS, merge_tasks(table_shape(asking, "qv")[0], k_max))
        hits = list_hits(asking, stacked, k_max, asked, n_tasks, **match)
        marked = hits.join(of_round(truth).repartition(n_tasks, "qid"), "qid").withColumns(
            {"true_rk": F.try_element_at("true_list", F.col("vec_id")), "n_true": F.size("true_list")}
        )
        searched = marked.drop("true_list").persist(_HELD)
        try:
            sums = [sums_of(strategy, scored) for strategy, scored in scored_hits(searched).items()]
            return reduce(DataFrame.unionByName, sums).collect()
        finally:
            searched.unpersist()
            asked.unpersist()

    rows = []
    for n in range(n_rounds):
        rows += round_sums(n)
        let_go(spark)
    schema = "strategy string, sample_nprobe int, deep_nprobe int, k int, c int, recall double, ndcg double"
    total = spark.createDataFrame(rows, schema).groupBy("strategy", *CONFIG).agg(F.sum("recall").alias("recall"), F.sum("ndcg").alias("ndcg"))

    def means_of(strategy: str) -> DataFrame:
        mean = total.where(F.col("strategy") == strategy)
        mean = mean.withColumns({"recall": F.col("recall") / n_queries, "ndcg": F.col("ndcg") / n_queries})
        for name, values in axes.items():
            if name not in own[strategy]:
                mean = mean.withColumn(name, F.explode(values))
        return mean.select(*CONFIG, "strategy", "recall", "ndcg")

    rows = reduce(DataFrame.unionByName, [means_of(strategy) for strategy in STRATEGIES])
    return quality_by_config(rows, CONFIG, STRATEGIES).fillna(0.0)


def accuracy_run(sweep: DataFrame) -> DataFrame:
    """A sweep under the headers of the accuracy run table, ready for ``result_sink``."""
    columns = {
        "Number of Clusters Searched": "c",
        "Sample nProbe": "sample_nprobe",
        "nProbe": "deep_nprobe",
        "Monolithic NDCG": "monolithic_ndcg",
        "Split NDCG": "split_ndcg",
        "Cluster NDCG": "routed_ndcg",
        "Monolithic Recall": "monolithic_recall",
        "Split Recall": "split_recall",
        "Cluster Recall": "routed_recall",
    }
    return sweep.select(*[F.col(c).alias(header) for header, c in columns.items()])
