"""DuckDB SQL that says, independently, what the registered queries must return."""

from __future__ import annotations

K, N_SPLITS, SAMPLE, DEEP, FAN = 5, 10, 2, 4, 3
BATCH = 50
SLACK_S = 16.0


def _r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)::DOUBLE"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# --- vectors ----------------------------------------------------------------------------------

EMB = "emb AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
# contiguous splits; the last one keeps the remainder
PLACED = f"""
placed AS MATERIALIZED (
  SELECT vec_id, label, e, pos, least(pos // size, {N_SPLITS - 1})::INTEGER AS split_id, size
  FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos,
               greatest(1, count(*) OVER () // {N_SPLITS}) AS size FROM emb))"""
PART_OF = {"monolithic": "0", "split": "split_id", "label": "label", "kmeans": "(SELECT a.part_id FROM km_assigned a WHERE a.vec_id = placed.vec_id)"}


def _scored_pairs(corpus: str = "emb", extra: str = "") -> str:
    return f"""
pairs AS MATERIALIZED (
  SELECT q.vec_id AS qid, c.vec_id{extra}, list_inner_product(q.e, c.e) AS score FROM emb q, {corpus} c)"""


def _topk(source: str, k: int, by: str = "qid", extra: str = "") -> str:
    return f"""(SELECT {by}{extra}, vec_id, score, rk FROM (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, vec_id)::INTEGER AS rk FROM {source})
    WHERE rk <= {k})"""


def _hits(source: str, extra: str = "") -> str:
    return f"SELECT {extra}qid, rk, vec_id, {_r('score')} AS score FROM {source}"


def _lloyd_step(p: str, i: int) -> str:
    """One Lloyd step within every part; a centroid without rows stays."""
    return f"""
{p}_a{i} AS MATERIALIZED (
  SELECT part_id, list_id, e FROM (
    SELECT t.part_id, c.list_id, t.e,
           row_number() OVER (PARTITION BY t.part_id, t.vec_id ORDER BY list_distance(t.e, c.c), c.list_id) AS rn
    FROM {p}_train t JOIN {p}_c{i} c USING (part_id)) WHERE rn = 1),
{p}_m{i} AS MATERIALIZED (
  SELECT part_id, list_id, list(m ORDER BY d) AS c FROM (
    SELECT part_id, list_id, d, avg(x) AS m FROM (
      SELECT part_id, list_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM {p}_a{i})
    GROUP BY ALL) GROUP BY ALL),
{p}_c{i + 1} AS MATERIALIZED (
  SELECT o.part_id, o.list_id, coalesce(n.c, o.c) AS c FROM {p}_c{i} o LEFT JOIN {p}_m{i} n USING (part_id, list_id))"""


def _index(kind: str) -> str:
    """Trained and filled index of one kind of partition: <kind>_coarse, <kind>_sq, <kind>_post."""
    p = kind
    return f"""
{p}_part AS MATERIALIZED (SELECT vec_id, e, {PART_OF[kind]} AS part_id FROM placed),
{p}_size AS MATERIALIZED (
  SELECT part_id, n, nlist, least(n, greatest(nlist, n // 10)) AS n_train FROM (
    SELECT part_id, count(*) AS n, floor(sqrt(count(*)))::BIGINT AS nlist FROM {p}_part GROUP BY part_id)),
{p}_train AS MATERIALIZED (
  SELECT part_id, vec_id, e, pos, nlist, n_train FROM (
    SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY vec_id) - 1 AS pos FROM {p}_part)
  JOIN {p}_size USING (part_id) WHERE pos < n_train),
{p}_c0 AS MATERIALIZED (
  SELECT t.part_id, s.list_id::INTEGER AS list_id, t.e AS c
  FROM (SELECT part_id, nlist, n_train, unnest(range(nlist)) AS list_id FROM {p}_size) s
  JOIN {p}_train t ON t.part_id = s.part_id AND t.pos = (s.list_id * s.n_train) // s.nlist),
{_lloyd_step(p, 0)},
{_lloyd_step(p, 1)},
{p}_coarse AS MATERIALIZED (SELECT part_id, list_id, c FROM {p}_c2),
{p}_sq AS MATERIALIZED (
  SELECT part_id, list(lo ORDER BY d) AS vmin, list(hi - lo ORDER BY d) AS vdiff FROM (
    SELECT part_id, d, min(x) AS lo, max(x) AS hi FROM (
      SELECT part_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM {p}_train) GROUP BY ALL)
  GROUP BY part_id),
{p}_assigned AS MATERIALIZED (
  SELECT part_id, vec_id, e, list_id FROM (
    SELECT r.part_id, r.vec_id, r.e, c.list_id, row_number() OVER (
      PARTITION BY r.vec_id ORDER BY list_inner_product(r.e, c.c) DESC, c.list_id) AS rn
    FROM {p}_part r JOIN {p}_coarse c USING (part_id)) WHERE rn = 1),
{p}_coded AS MATERIALIZED (
  SELECT part_id, vec_id, list_id, e, vmin, vdiff, list_transform(e, lambda x, i:
    CASE WHEN vdiff[i] > 0 THEN greatest(0, least(255, floor(255.0 * (x - vmin[i]) / vdiff[i])))::INTEGER
         ELSE 0 END) AS code
  FROM {p}_assigned JOIN {p}_sq USING (part_id)),
{p}_post AS MATERIALIZED (
  SELECT part_id, vec_id, list_id, e, code, list_transform(code, lambda x, i:
    vmin[i] + (x::DOUBLE + 0.5) / 255.0 * vdiff[i]) AS decoded
  FROM {p}_coded)"""


def _probes(kind: str, nprobe: int) -> str:
    return f"""
{kind}_probes AS MATERIALIZED (
  SELECT qid, part_id, list_id, probe_rk, score FROM (
    SELECT q.vec_id AS qid, c.part_id, c.list_id, list_inner_product(q.e, c.c) AS score,
           row_number() OVER (PARTITION BY q.vec_id, c.part_id
             ORDER BY list_inner_product(q.e, c.c) DESC, c.list_id)::INTEGER AS probe_rk
    FROM emb q, {kind}_coarse c) WHERE probe_rk <= {nprobe})"""


def _probed(kind: str, name: str, where: str = "true") -> str:
    """Every decoded vector of the probed lists with its score."""
    return f"""
{name} AS MATERIALIZED (
  SELECT b.qid, b.part_id, b.list_id, b.probe_rk, t.vec_id, list_inner_product(q.e, t.decoded) AS score
  FROM {kind}_probes b JOIN {kind}_post t USING (part_id, list_id) JOIN emb q ON q.vec_id = b.qid
  WHERE {where})"""


SAMPLE_ROUTES = f"""
sample_hits AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, part_id ORDER BY score DESC, vec_id) AS rk
                 FROM probed WHERE probe_rk <= {SAMPLE}) WHERE rk <= {K}),
sample AS MATERIALIZED (SELECT qid, part_id, avg(score) AS sample_score FROM sample_hits GROUP BY ALL),
routes AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sample_score DESC, part_id) AS route_rk FROM sample)"""


def _truth(k: int = K) -> str:
    return f"truth AS MATERIALIZED {_topk('pairs', k)}"


def _hex(column: str) -> str:
    return f"array_to_string(list_transform({column}, lambda x: printf('%02X', x)), '')"


def _kmeans(k: int, steps: int) -> str:
    """Plain k-means over everything: part 0 with k evenly spaced start vectors."""
    head = f"""
km_train AS MATERIALIZED (
  SELECT 0 AS part_id, vec_id, e, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM emb),
km_c0 AS MATERIALIZED (
  SELECT 0 AS part_id, j.list_id::INTEGER AS list_id, t.e AS c
  FROM (SELECT unnest(range({k})) AS list_id) j JOIN km_train t ON t.pos = (j.list_id * t.n) // {k})"""
    return ",\n".join([head, *[_lloyd_step("km", i) for i in range(steps)]])


KMEANS = _kmeans(10, 3)
KMEANS_ASSIGNED = """
km_assigned AS MATERIALIZED (
  SELECT vec_id, list_id AS part_id FROM (
    SELECT t.vec_id, c.list_id, row_number() OVER (
      PARTITION BY t.vec_id ORDER BY list_distance(t.e, c.c), c.list_id) AS rn
    FROM km_train t, km_c3 c) WHERE rn = 1)"""

APPROX = [EMB, PLACED, _index("monolithic"), _probes("monolithic", 8), _probed("monolithic", "probed"),
          f"approx AS MATERIALIZED {_topk('probed', K)}", _scored_pairs(), _truth()]
MARKED = """
marked AS MATERIALIZED (
  SELECT a.qid, a.rk, a.vec_id, (t.vec_id IS NOT NULL)::INTEGER AS hit
  FROM approx a LEFT JOIN truth t ON t.qid = a.qid AND t.vec_id = a.vec_id),
ideal AS MATERIALIZED (
  SELECT qid, count(*) AS n_true, sum(1.0::DOUBLE / log2(rk + 1)) AS idcg FROM truth GROUP BY qid),
gained AS MATERIALIZED (
  SELECT qid, sum(hit)::BIGINT AS n_hits, sum(CASE WHEN hit = 1 THEN 1.0::DOUBLE / log2(rk + 1) ELSE 0 END) AS dcg
  FROM marked GROUP BY qid),
per_query AS MATERIALIZED (
  SELECT i.qid, coalesce(n_hits, 0)::BIGINT AS n_hits, n_true, coalesce(n_hits, 0) / n_true::DOUBLE AS recall,
         coalesce(dcg, 0)::DOUBLE AS dcg, idcg, CASE WHEN idcg = 0 THEN 0 ELSE coalesce(dcg, 0) / idcg END AS ndcg
  FROM ideal i LEFT JOIN gained g USING (qid))"""

LABEL_INDEX = [EMB, PLACED, _index("label")]
LABEL_PROBED = [*LABEL_INDEX, _probes("label", DEEP), _probed("label", "probed")]
LABEL_PARTS = "labelled AS MATERIALIZED (SELECT vec_id, e, label AS part_id FROM emb)"
PART_PAIRS = _scored_pairs("labelled", ", c.part_id")
SPLIT_PAIRS = _scored_pairs("placed", ", c.split_id AS part_id, c.pos - c.split_id * c.size AS local_pos")

KMEANS_PROBED = [
    EMB, PLACED, KMEANS, KMEANS_ASSIGNED, _index("kmeans"), _probes("kmeans", DEEP), _probed("kmeans", "probed")
]
# one best hit per part makes the sample score of a query log
TRACE_ROUTES = f"""
routes AS MATERIALIZED (
  SELECT qid, part_id, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, part_id) AS route_rk
  FROM probed WHERE probe_rk <= {SAMPLE} GROUP BY qid, part_id)"""

_quality_by_config = _with(
    EMB, PLACED, _scored_pairs("placed", ", c.split_id, c.label"), _truth(),
    _index("monolithic"), _probes("monolithic", 8), _probed("monolithic", "mono_probed"),
    f"""split_lists AS MATERIALIZED (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, split_id ORDER BY score DESC, vec_id) AS prk FROM pairs) WHERE prk <= {K})""",
    f"""label_lists AS MATERIALIZED (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, vec_id) AS prk FROM pairs) WHERE prk <= {K})""",
    """label_routes AS MATERIALIZED (
      SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY avg(score) DESC, label) AS route_rk
      FROM label_lists GROUP BY qid, label)""",
    """fans AS (SELECT unnest(range(1, 11))::INTEGER AS c)""",
    f"""found AS MATERIALIZED (
      SELECT 'split' AS strategy, c, qid, vec_id, row_number() OVER (
        PARTITION BY c, qid ORDER BY score DESC, vec_id) AS rk
      FROM split_lists JOIN fans ON c >= split_id + 1
      QUALIFY rk <= {K}
      UNION ALL
      SELECT 'routed' AS strategy, c, qid, vec_id, row_number() OVER (
        PARTITION BY c, qid ORDER BY score DESC, vec_id) AS rk
      FROM label_lists JOIN label_routes USING (qid, label) JOIN fans ON c >= route_rk
      QUALIFY rk <= {K}
      UNION ALL
      SELECT 'monolithic' AS strategy, c, qid, vec_id, rk FROM {_topk("mono_probed", K)}, fans)""",
    f"""scored AS MATERIALIZED (
      SELECT f.strategy, f.c, f.qid, count(t.vec_id) / {K}::DOUBLE AS recall,
             coalesce(sum(CASE WHEN t.vec_id IS NOT NULL THEN 1.0::DOUBLE / log2(f.rk + 1) END), 0)
               / (SELECT sum(1.0::DOUBLE / log2(r + 1)) FROM unnest(range(1, {K + 1})) u(r)) AS ndcg
      FROM found f LEFT JOIN truth t ON t.qid = f.qid AND t.vec_id = f.vec_id GROUP BY ALL)""",
) + f"""
SELECT c, {_r("avg(recall) FILTER (strategy = 'monolithic')")} AS monolithic_recall,
       {_r("avg(ndcg) FILTER (strategy = 'monolithic')")} AS monolithic_ndcg,
       {_r("avg(recall) FILTER (strategy = 'split')")} AS split_recall,
       {_r("avg(ndcg) FILTER (strategy = 'split')")} AS split_ndcg,
       {_r("avg(recall) FILTER (strategy = 'routed')")} AS routed_recall,
       {_r("avg(ndcg) FILTER (strategy = 'routed')")} AS routed_ndcg
FROM scored GROUP BY c"""

_quality_sweep = _with(
    EMB, PLACED, _index("monolithic"), _index("split"), _index("label"),
    _probes("monolithic", 8), _probes("split", 4), _probes("label", 4),
    _probed("monolithic", "mono_probed"), _probed("split", "split_probed"), _probed("label", "probed"),
    _scored_pairs(), f"truth AS MATERIALIZED {_topk('pairs', 5)}",
    """grid AS MATERIALIZED (
      SELECT s::INTEGER AS sample_nprobe, d::INTEGER AS deep_nprobe, k::INTEGER AS k, c::INTEGER AS c
      FROM unnest([1, 2]) a(s), unnest([2, 4]) b(d), unnest([3, 5]) x(k), unnest(range(1, 11)) y(c))""",
    """sample_means AS MATERIALIZED (
      SELECT sample_nprobe, k, qid, part_id, avg(score) AS sample_score FROM (
        SELECT g.sample_nprobe, g.k, p.qid, p.part_id, p.score, row_number() OVER (
          PARTITION BY g.sample_nprobe, g.k, p.qid, p.part_id ORDER BY p.score DESC, p.vec_id) AS rk
        FROM (SELECT DISTINCT sample_nprobe, k FROM grid) g JOIN probed p ON p.probe_rk <= g.sample_nprobe)
      WHERE rk <= k GROUP BY ALL)""",
    """sweep_routes AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY sample_nprobe, k, qid ORDER BY sample_score DESC, part_id) AS route_rk
      FROM sample_means)""",
    """routed AS MATERIALIZED (
      SELECT * FROM (
        SELECT g.sample_nprobe, g.deep_nprobe, g.k, g.c, p.qid, p.vec_id, row_number() OVER (
          PARTITION BY g.sample_nprobe, g.deep_nprobe, g.k, g.c, p.qid ORDER BY p.score DESC, p.vec_id) AS rk
        FROM grid g JOIN sweep_routes r ON r.sample_nprobe = g.sample_nprobe AND r.k = g.k AND r.route_rk <= g.c
        JOIN probed p ON p.qid = r.qid AND p.part_id = r.part_id AND p.probe_rk <= g.deep_nprobe)
      WHERE rk <= k)""",
    """split_found AS MATERIALIZED (
      SELECT g.sample_nprobe, f.* FROM (
        SELECT * FROM (
          SELECT g.deep_nprobe, g.k, g.c, p.qid, p.vec_id, row_number() OVER (
            PARTITION BY g.deep_nprobe, g.k, g.c, p.qid ORDER BY p.score DESC, p.vec_id) AS rk
          FROM (SELECT DISTINCT deep_nprobe, k, c FROM grid) g
          JOIN split_probed p ON p.part_id < g.c AND p.probe_rk <= g.deep_nprobe)
        WHERE rk <= k) f, (SELECT DISTINCT sample_nprobe FROM grid) g)""",
    """mono_found AS MATERIALIZED (
      SELECT g.sample_nprobe, g.deep_nprobe, g.k, g.c, f.qid, f.vec_id, f.rk FROM (
        SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk
        FROM mono_probed) f JOIN grid g ON f.rk <= g.k)""",
    """found AS MATERIALIZED (
      SELECT 'routed' AS strategy, sample_nprobe, deep_nprobe, k, c, qid, vec_id, rk FROM routed
      UNION ALL SELECT 'split', sample_nprobe, deep_nprobe, k, c, qid, vec_id, rk FROM split_found
      UNION ALL SELECT 'monolithic', sample_nprobe, deep_nprobe, k, c, qid, vec_id, rk FROM mono_found)""",
    """ideal AS MATERIALIZED (
      SELECT k, sum(1.0::DOUBLE / log2(r + 1)) AS idcg
      FROM (SELECT DISTINCT k FROM grid), unnest(range(1, 6)) u(r) WHERE r <= k GROUP BY k)""",
    """scored AS MATERIALIZED (
      SELECT f.strategy, f.sample_nprobe, f.deep_nprobe, f.k, f.c,
             count(t.vec_id) / f.k::DOUBLE / (SELECT count(*) FROM emb) AS recall,
             coalesce(sum(CASE WHEN t.vec_id IS NOT NULL THEN 1.0::DOUBLE / log2(f.rk + 1) END), 0)
               / any_value(i.idcg) / (SELECT count(*) FROM emb) AS ndcg
      FROM found f JOIN ideal i ON i.k = f.k
      LEFT JOIN truth t ON t.qid = f.qid AND t.vec_id = f.vec_id AND t.rk <= f.k
      GROUP BY f.strategy, f.sample_nprobe, f.deep_nprobe, f.k, f.c)""",
) + "\nSELECT sample_nprobe, deep_nprobe, k, c, " + ", ".join(
    f"""{_r(f"coalesce(max({m}) FILTER (strategy = '{s}'), 0)")} AS {s}_{m}"""
    for s in ("monolithic", "split", "routed") for m in ("recall", "ndcg")
) + " FROM scored GROUP BY ALL"


# --- query log --------------------------------------------------------------------------------

CENTS = "round(l_extendedprice * 100)::BIGINT"
LOG = f"""
spent AS MATERIALIZED (
  SELECT l_orderkey AS qid, l_suppkey::INTEGER AS cluster_id, sum({CENTS}) AS spent FROM lineitem GROUP BY ALL),
asked AS MATERIALIZED (
  SELECT qid, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY spent DESC, cluster_id)::INTEGER AS rk FROM spent),
numbered AS MATERIALIZED (SELECT o_orderkey AS qid, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)"""
LOADS = f"""
loads AS MATERIALIZED (
  SELECT pos // {BATCH} AS batch, cluster_id, count(*) AS load
  FROM asked JOIN numbered USING (qid) WHERE rk <= {FAN} GROUP BY ALL)"""
PROFILE = f"""
profile AS MATERIALIZED (
  SELECT l_suppkey::INTEGER AS cluster_id, l_quantity::INTEGER AS size,
         (sum({CENTS})::BIGINT // count(*)) / 1e6::DOUBLE AS latency_s FROM lineitem GROUP BY ALL)"""
LOOKED_UP = """
looked_up AS MATERIALIZED (
  SELECT l.*, (SELECT min(size) FROM profile p WHERE p.cluster_id = l.cluster_id AND p.size >= l.load) AS size FROM loads l),
costed AS MATERIALIZED (
  SELECT l.*, p.latency_s FROM looked_up l LEFT JOIN profile p ON p.cluster_id = l.cluster_id AND p.size = l.size)"""
FREQUENCY = "(substr(o_orderpriority, 1, 1)::INTEGER * 400 + 800)"
PRICED = f"""
fprofile AS MATERIALIZED (
  SELECT cluster_id, frequency_mhz, size, ((c * 2800) // frequency_mhz) / 1e6::DOUBLE AS latency_s FROM (
    SELECT l_suppkey::INTEGER AS cluster_id, {FREQUENCY} AS frequency_mhz, l_quantity::INTEGER AS size,
           sum({CENTS})::BIGINT // count(*) AS c
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)),
power AS MATERIALIZED (
  SELECT frequency_mhz, w + frequency_mhz / 20.0::DOUBLE AS busy, w / 2.0::DOUBLE AS idle FROM (
    SELECT {FREQUENCY} AS frequency_mhz, (sum(round(o_totalprice * 100)::BIGINT)::BIGINT // count(*)) / 1e5::DOUBLE AS w
    FROM orders GROUP BY ALL)),
fsize AS MATERIALIZED (
  SELECT l.batch, l.cluster_id, l.load, p.frequency_mhz, min(p.size) AS size
  FROM loads l JOIN fprofile p ON p.cluster_id = l.cluster_id AND p.size >= l.load GROUP BY ALL),
fcost AS MATERIALIZED (
  SELECT s.batch, s.cluster_id, s.load, s.frequency_mhz, p.latency_s, w.busy, w.idle
  FROM fsize s JOIN fprofile p USING (cluster_id, frequency_mhz, size) JOIN power w USING (frequency_mhz)),
base AS MATERIALIZED (
  SELECT l.batch, l.cluster_id, l.load, f.latency_s, f.busy, f.idle
  FROM loads l LEFT JOIN fcost f ON f.batch = l.batch AND f.cluster_id = l.cluster_id
    AND f.frequency_mhz = (SELECT max(frequency_mhz) FROM power)),
straggler AS MATERIALIZED (
  SELECT batch, CASE WHEN count(latency_s) = count(*) THEN max(latency_s) END AS straggler_s FROM base GROUP BY batch),
energy AS MATERIALIZED (
  SELECT f.batch, f.cluster_id, f.latency_s, s.straggler_s,
         f.latency_s * f.busy + greatest(s.straggler_s - f.latency_s, 0) * f.idle AS joule
  FROM fcost f JOIN straggler s USING (batch) WHERE s.straggler_s IS NOT NULL),
priced AS MATERIALIZED (
  SELECT b.batch, b.cluster_id, b.load,
         CASE WHEN s.straggler_s IS NOT NULL THEN
           b.latency_s * b.busy + greatest(s.straggler_s - b.latency_s, 0) * b.idle END AS base_j,
         CASE WHEN s.straggler_s IS NOT NULL THEN least(
           b.latency_s * b.busy + greatest(s.straggler_s - b.latency_s, 0) * b.idle,
           (SELECT min(joule) FROM energy e WHERE e.batch = b.batch AND e.cluster_id = b.cluster_id
              AND e.latency_s < s.straggler_s)) END AS scaled_j,
         CASE WHEN s.straggler_s IS NOT NULL THEN least(
           b.latency_s * b.busy + greatest(s.straggler_s - b.latency_s, 0) * b.idle,
           (SELECT min(joule) FROM energy e WHERE e.batch = b.batch AND e.cluster_id = b.cluster_id
              AND e.latency_s < greatest(s.straggler_s, {SLACK_S}))) END AS enhanced_j
  FROM base b JOIN straggler s USING (batch))"""

_cost_by_fanout = _with(
    LOG, PROFILE,
    "fans AS (SELECT unnest(range(1, 7))::INTEGER AS c)",
    f"""closed AS MATERIALIZED (
      SELECT qid, ceil(pos / {BATCH}::DOUBLE)::BIGINT AS batch FROM numbered
      WHERE ceil(pos / {BATCH}::DOUBLE) <= (SELECT max(pos) FROM numbered) // {BATCH})""",
    """loads AS MATERIALIZED (
      SELECT c, batch, cluster_id, count(*) AS load
      FROM asked JOIN closed USING (qid) JOIN fans ON rk <= c GROUP BY ALL)""",
    LOOKED_UP,
    """worst AS MATERIALIZED (
      SELECT c, batch, CASE WHEN count(latency_s) = count(*) THEN max(latency_s) END AS deep_s FROM costed GROUP BY ALL)""",
    f"""means AS MATERIALIZED (
      SELECT c, count(deep_s) AS n_batches,
             avg(deep_s + (SELECT max(latency_s) FROM profile WHERE size = {BATCH})) AS mean_s FROM worst GROUP BY c)""",
) + f"\nSELECT c, n_batches, {_r('mean_s')} AS mean_s, {_r(f'{BATCH}.0::DOUBLE / mean_s', 4)} AS throughput_qps FROM means"

_cost_sweep = _with(
    LOG,
    f"""sprofile AS MATERIALIZED (
      SELECT l_suppkey::INTEGER AS cluster_id, l_quantity::INTEGER AS size,
             CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 64 ELSE 128 END AS nprobe,
             CASE l_linestatus WHEN 'F' THEN 16 ELSE 32 END AS threads,
             (sum({CENTS})::BIGINT // count(*)) / 1e6::DOUBLE AS latency_s
      FROM lineitem GROUP BY ALL)""",
    "grid AS (SELECT b::INTEGER AS batch_size, c::INTEGER AS c FROM unnest([16, 48]) x(b), unnest(range(1, 5)) y(c))",
    """closed AS MATERIALIZED (
      SELECT qid, batch_size, ceil(pos / batch_size::DOUBLE)::BIGINT AS batch
      FROM numbered, (SELECT DISTINCT batch_size FROM grid)
      WHERE ceil(pos / batch_size::DOUBLE) <= (SELECT max(pos) FROM numbered) // batch_size)""",
    """loads AS MATERIALIZED (
      SELECT c, batch_size, batch, cluster_id, count(*) AS load
      FROM asked JOIN closed USING (qid) JOIN grid USING (batch_size) WHERE rk <= c GROUP BY ALL)""",
    "settings AS (SELECT d::INTEGER AS nprobe, t::INTEGER AS threads FROM unnest([64, 128]) x(d), unnest([16, 32]) y(t))",
    """sized AS MATERIALIZED (
      SELECT l.cluster_id, l.load, s.nprobe, s.threads, min(p.size) AS size
      FROM (SELECT DISTINCT cluster_id, load FROM loads) l, settings s
      LEFT JOIN sprofile p ON p.cluster_id = l.cluster_id AND p.nprobe = s.nprobe AND p.threads = s.threads AND p.size >= l.load
      GROUP BY ALL)""",
    """costed AS MATERIALIZED (
      SELECT l.c, l.batch_size, l.batch, z.nprobe, z.threads, p.latency_s
      FROM loads l JOIN sized z USING (cluster_id, load)
      LEFT JOIN sprofile p ON p.cluster_id = z.cluster_id AND p.nprobe = z.nprobe AND p.threads = z.threads AND p.size = z.size)""",
    """worst AS MATERIALIZED (
      SELECT c, batch_size, batch, nprobe, threads, CASE WHEN count(latency_s) = count(*) THEN max(latency_s) END AS deep_s
      FROM costed GROUP BY ALL)""",
    """sampling AS MATERIALIZED (
      SELECT nprobe AS sample_nprobe, threads, size AS batch_size, max(latency_s) AS sampling_s
      FROM sprofile WHERE nprobe IN (8, 64) GROUP BY ALL)""",
    """means AS MATERIALIZED (
      SELECT sample_nprobe, nprobe AS deep_nprobe, threads, batch_size, c, count(deep_s) AS n_batches,
             avg(deep_s) + any_value(sampling_s) AS mean_s,
             (sum(round(deep_s * 1e6)::BIGINT) + count(deep_s) * round(any_value(sampling_s) * 1e6)::BIGINT)::BIGINT AS total_us
      FROM worst JOIN sampling USING (threads, batch_size) GROUP BY ALL)""",
) + f"""
SELECT sample_nprobe::INTEGER AS sample_nprobe, deep_nprobe::INTEGER AS deep_nprobe, {K}::INTEGER AS k, threads::INTEGER AS threads,
       batch_size, c, n_batches, total_us, {_r('batch_size / mean_s', 3)} AS throughput_qps FROM means"""

# every fan-out as batches of its own; batch -1 is the sampling step, where each cluster serves 32 queries
_energy_by_fanout = _with(
    LOG,
    """loads AS MATERIALIZED (
      SELECT c * 10000000 + pos // 32 AS batch, cluster_id, count(*) AS load
      FROM asked JOIN numbered USING (qid), unnest(range(1, 4)) f(c) WHERE rk <= c GROUP BY ALL
      UNION ALL SELECT DISTINCT -1, l_suppkey::INTEGER, 32 FROM lineitem)""",
    PRICED,
    """totals AS MATERIALIZED (
      SELECT batch, CASE WHEN count(base_j) = count(*) THEN sum(base_j) END AS base_j,
             CASE WHEN count(scaled_j) = count(*) THEN sum(scaled_j) END AS scaled_j,
             CASE WHEN count(enhanced_j) = count(*) THEN sum(enhanced_j) END AS enhanced_j
      FROM priced GROUP BY batch)""",
    "step AS (SELECT base_j AS b, scaled_j AS s FROM totals WHERE batch = -1)",
) + f"""
SELECT (batch // 10000000)::INTEGER AS c, count(base_j) AS n_batches, {_r('avg(base_j + b)', 4)} AS base_j,
       {_r('avg(scaled_j + s)', 4)} AS scaled_j, {_r('avg(enhanced_j + s)', 4)} AS enhanced_j
FROM totals, step WHERE batch >= 0 GROUP BY ALL"""

RUN_MEANS = f"""
SELECT l_returnflag, l_linestatus, l_linenumber AS c, count(*) AS n, (sum({CENTS})::BIGINT // count(*)) / 100.0::DOUBLE AS mean_price
FROM lineitem GROUP BY ALL"""


ORACLES: dict[str, str] = {
    "corpus_scan": _with(EMB) + f" SELECT vec_id, len(e)::INTEGER AS dim, {_r('list_sum(e)')} AS total FROM emb",
    "vector_validate": """
SELECT count(*) AS n_rows, count(*) FILTER (len(embedding) = 64) AS n_valid,
       count(*) FILTER (embedding IS NULL) AS n_null, count(*) FILTER (len(embedding) <> 64) AS n_wrong_dim,
       count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS n_bad_component
FROM embeddings""",
    "vector_validate_dirty": """
SELECT count(*) AS n_rows, count(*) FILTER (k NOT IN (3, 13, 23, 33, 43)) AS n_valid, count(*) FILTER (k = 3) AS n_null,
       count(*) FILTER (k = 43) AS n_wrong_dim, count(*) FILTER (k IN (13, 23, 33)) AS n_bad_component
FROM (SELECT vec_id % 50 AS k FROM embeddings)""",
    "corpus_prefix": _with(EMB) + f"""
SELECT vec_id, label, {_r('list_sum(e)')} AS total FROM emb ORDER BY vec_id LIMIT 250""",
    "query_set": _with(EMB) + f"""
SELECT vec_id AS qid, len(e)::INTEGER AS dim, {_r('list_inner_product(e, e)')} AS norm2 FROM emb""",
    "metrics_csv": RUN_MEANS,
    "multi_csv_labelled": f"SELECT l_linestatus, c, n, mean_price, 'run_' || l_returnflag || '.csv' AS run FROM ({RUN_MEANS})",
    "result_sink": RUN_MEANS,
    "trace_parse": _with(LOG) + """
SELECT n.qid, count(a.cluster_id)::INTEGER AS n_ranked, coalesce(string_agg(a.cluster_id::VARCHAR, ',' ORDER BY a.rk), '') AS ranked
FROM numbered n LEFT JOIN asked a USING (qid) GROUP BY n.qid""",
    "index_write": _with(*LABEL_INDEX) + " SELECT part_id, list_id, count(*) AS n_rows FROM label_post GROUP BY ALL",
    "index_read": _with(*LABEL_INDEX) + f"""
SELECT part_id, n_lists, n_rows, {_r('list_sum(vdiff)', 4)} AS total_range
FROM (SELECT part_id, count(*) AS n_lists FROM label_coarse GROUP BY part_id)
JOIN (SELECT part_id, count(*) AS n_rows FROM label_post GROUP BY part_id) USING (part_id)
JOIN label_sq USING (part_id)""",
    "synthetic_vectors": f"""
SELECT vec_id, 64::INTEGER AS dim, {_r('list_sum(v::DOUBLE[])')} AS total, {_r('v[1]::DOUBLE')} AS first, {_r('v[64]::DOUBLE')} AS last
FROM (SELECT vec_id, list_transform(range(64), lambda j:
        (('0x' || substr(md5('7:' || vec_id || ':' || j), 1, 13))::BIGINT / 2251799813685248.0::DOUBLE - 1)::FLOAT) AS v FROM embeddings)""",
    "split_partition": _with(EMB, PLACED) + """
SELECT vec_id, split_id AS part_id, pos - split_id * size AS local_pos FROM placed""",
    "kmeans_fit": _with(EMB, KMEANS) + f"""
SELECT list_id AS cluster_id, (dim - 1)::INTEGER AS dim, {_r('x')} AS x FROM (
  SELECT list_id, unnest(c) AS x, generate_subscripts(c, 1) AS dim FROM km_c3)""",
    "kmeans_converged": _with(EMB, _kmeans(10, 20)) + f"""
SELECT list_id AS cluster_id, (dim - 1)::INTEGER AS dim, {_r('x')} AS x FROM (
  SELECT list_id, unnest(c) AS x, generate_subscripts(c, 1) AS dim FROM km_c20)""",
    "kmeans_seeded": "SELECT 20::BIGINT AS n_clusters, 0::BIGINT AS n_empty, count(*) AS n_rows FROM embeddings",
    "cluster_assign": _with(EMB, KMEANS, KMEANS_ASSIGNED) + " SELECT vec_id, part_id FROM km_assigned",
    "cluster_membership": """
SELECT label AS part_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS local_pos, vec_id FROM embeddings""",
    "cluster_sizes": _with(EMB, KMEANS, KMEANS_ASSIGNED) + """
SELECT c.list_id AS part_id, count(a.vec_id) AS n_rows FROM km_c3 c LEFT JOIN km_assigned a ON a.part_id = c.list_id GROUP BY ALL""",
    "train_sample": _with(*LABEL_INDEX) + " SELECT part_id, vec_id, pos FROM label_train",
    "train_sample_hashed": """
WITH ranked AS (
  SELECT label AS part_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) - 1 AS pos,
         count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT part_id, vec_id, pos FROM ranked WHERE pos < least(n, greatest(floor(sqrt(n))::BIGINT, n // 10))""",
    "ivf_train": _with(EMB, PLACED, _index("monolithic")) + f"""
SELECT part_id, list_id, (dim - 1)::INTEGER AS dim, {_r('x')} AS x FROM (
  SELECT part_id, list_id, unnest(c) AS x, generate_subscripts(c, 1) AS dim FROM monolithic_coarse)""",
    "ivf_assign": _with(*LABEL_INDEX) + " SELECT vec_id, part_id, list_id FROM label_assigned",
    "sq8_train": _with(*LABEL_INDEX) + f"""
SELECT part_id, (dim - 1)::INTEGER AS dim, {_r('lo')} AS vmin, {_r('width')} AS vdiff FROM (
  SELECT part_id, unnest(vmin) AS lo, unnest(vdiff) AS width, generate_subscripts(vmin, 1) AS dim FROM label_sq)""",
    "sq8_encode": _with(*LABEL_INDEX) + f" SELECT part_id, vec_id, {_hex('code')} AS code FROM label_coded",
    "sq8_decode": _with(*LABEL_INDEX) + f"""
SELECT vec_id, {_r('list_sum(list_transform(e, lambda x, i: (x - decoded[i]) * (x - decoded[i])))')} AS squared_error FROM label_post""",
    "index_append": _with(*LABEL_INDEX) + f" SELECT part_id, list_id, vec_id, {_hex('code')} AS code FROM label_coded",
    "index_extend": _with(*LABEL_INDEX) + f" SELECT part_id, list_id, vec_id, {_hex('code')} AS code FROM label_coded",
    "index_compact": _with(*LABEL_INDEX) + f" SELECT part_id, list_id, vec_id, {_hex('code')} AS code FROM label_coded",
    "stream_index_append": _with(*LABEL_INDEX) + f" SELECT part_id, list_id, vec_id, {_hex('code')} AS code FROM label_coded",
    "exact_topk": _with(EMB, _scored_pairs()) + " " + _hits(_topk("pairs", K)),
    "exact_topk_dirty": _with(EMB, "usable AS (SELECT * FROM emb WHERE vec_id % 10 <> 3)", _scored_pairs("usable")) + " " + _hits(_topk("pairs", K)),
    "probe_lists": _with(*LABEL_INDEX, _probes("label", DEEP)) + f"""
SELECT qid, part_id, list_id, probe_rk, {_r('score')} AS score FROM label_probes""",
    "ivf_topk": _with(*APPROX) + " " + _hits("approx"),
    "per_partition_topk": _with(EMB, LABEL_PARTS, PART_PAIRS) + " " + _hits(_topk("pairs", K, "qid, part_id"), "part_id, "),
    "split_search": _with(EMB, PLACED, SPLIT_PAIRS) + " " + _hits(_topk("(SELECT * FROM pairs WHERE part_id < 4)", K)),
    "ivf_split_search": _with(EMB, PLACED, _index("split"), _probes("split", DEEP), _probed("split", "probed", "b.part_id < 4"))
    + " " + _hits(_topk("probed", K)),
    "local_to_global_id": _with(EMB, PLACED, SPLIT_PAIRS) + f"""
SELECT qid, part_id, rk, local_pos, vec_id AS global_id FROM {_topk('pairs', K, 'qid, part_id', ', local_pos')}""",
    "merge_topk": _with(EMB, LABEL_PARTS, PART_PAIRS, f"lists AS MATERIALIZED {_topk('pairs', K, 'qid, part_id')}")
    + " " + _hits(_topk("(SELECT * EXCLUDE (rk) FROM lists)", 2 * K)),
    "sample_scores": _with(*LABEL_PROBED, SAMPLE_ROUTES) + f"""
SELECT qid, part_id, {_r('sample_score')} AS sample_score FROM sample""",
    "rank_clusters": _with(*LABEL_PROBED, SAMPLE_ROUTES) + """
SELECT qid, string_agg(part_id::VARCHAR, ',' ORDER BY route_rk) AS ranked FROM routes GROUP BY qid""",
    "routed_search": _with(*LABEL_PROBED, SAMPLE_ROUTES, f"""
deep AS MATERIALIZED (SELECT p.* FROM probed p JOIN routes r ON r.qid = p.qid AND r.part_id = p.part_id WHERE route_rk <= {FAN})""")
    + " " + _hits(_topk("deep", K)),
    "clustered_search": _with(*KMEANS_PROBED, SAMPLE_ROUTES, f"""
deep AS MATERIALIZED (SELECT p.* FROM probed p JOIN routes r ON r.qid = p.qid AND r.part_id = p.part_id WHERE route_rk <= {FAN})""")
    + " " + _hits(_topk("deep", K)),
    "query_trace": _with(*KMEANS_PROBED, TRACE_ROUTES) + """
SELECT qid, '[' || string_agg(part_id::VARCHAR, ', ' ORDER BY route_rk) || ']' AS ranked_text FROM routes GROUP BY qid""",
    "trace_access_freq": _with(*KMEANS_PROBED, TRACE_ROUTES) + f"""
SELECT d.part_id AS cluster_id, d.n AS document_count, coalesce(a.n, 0) AS access_count
FROM (SELECT part_id, count(*) AS n FROM km_assigned GROUP BY part_id) d
LEFT JOIN (SELECT part_id, count(*) AS n FROM routes WHERE route_rk <= {FAN} GROUP BY part_id) a USING (part_id)""",
    "exact_routed_search": _with(EMB, LABEL_PARTS, PART_PAIRS, f"lists AS MATERIALIZED {_topk('pairs', K, 'qid, part_id')}", f"""
routes AS MATERIALIZED (
  SELECT qid, part_id, row_number() OVER (PARTITION BY qid ORDER BY avg(score) DESC, part_id) AS route_rk
  FROM lists GROUP BY qid, part_id),
deep AS MATERIALIZED (
  SELECT l.* EXCLUDE (rk) FROM lists l JOIN routes r ON r.qid = l.qid AND r.part_id = l.part_id WHERE route_rk <= {FAN})""")
    + " " + _hits(_topk("deep", K)),
    "batched_search": _with(EMB, _scored_pairs()) + " " + _hits(_topk("pairs", K), "(SELECT count(*) FROM emb e WHERE e.vec_id < qid) // 32 AS qblock, "),
    "ground_truth_overlap": _with(*APPROX, MARKED) + " SELECT qid, rk, vec_id, hit FROM marked",
    "recall_at_k": _with(*APPROX, MARKED) + f" SELECT qid, n_hits, n_true, {_r('recall')} AS recall FROM per_query",
    "dcg_at_k": _with(*APPROX, MARKED) + f" SELECT qid, {_r('dcg')} AS dcg FROM per_query",
    "ndcg_at_k": _with(*APPROX, MARKED) + f"""
SELECT qid, {_r('dcg')} AS dcg, {_r('idcg')} AS idcg, {_r('ndcg')} AS ndcg FROM per_query""",
    "quality_by_config": _quality_by_config,
    "quality_sweep": _quality_sweep,
    "top_clusters_explode": _with(LOG) + f" SELECT qid, rk, cluster_id FROM asked JOIN numbered USING (qid) WHERE rk <= {FAN}",
    "cluster_access_freq": _with(LOG) + f"""
SELECT s_suppkey::INTEGER AS cluster_id, coalesce(d.n, 0) AS document_count, coalesce(a.n, 0) AS access_count
FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) d ON d.l_suppkey = s_suppkey
LEFT JOIN (SELECT cluster_id, count(*) AS n FROM asked JOIN numbered USING (qid) WHERE rk <= {FAN} GROUP BY ALL) a ON a.cluster_id = s_suppkey""",
    "log_batches": _with(LOG) + f"""
SELECT 'aligned' AS mode, qid, pos // {BATCH} AS batch FROM numbered
UNION ALL
SELECT 'compat' AS mode, qid, ceil(pos / {BATCH}::DOUBLE)::BIGINT AS batch FROM numbered
WHERE ceil(pos / {BATCH}::DOUBLE) <= (SELECT max(pos) FROM numbered) // {BATCH}""",
    "batch_cluster_load": _with(LOG, LOADS) + " SELECT batch, cluster_id, load FROM loads",
    "ceiling_lookup": _with(LOG, LOADS, PROFILE, LOOKED_UP) + " SELECT batch, cluster_id, load, size, latency_s FROM costed",
    "straggler_cost": _with(LOG, LOADS, PROFILE, LOOKED_UP) + f"""
SELECT batch, {_r('deep_s')} AS deep_s,
       {_r(f'deep_s + (SELECT max(latency_s) FROM profile WHERE size = {BATCH})')} AS batch_s
FROM (SELECT batch, CASE WHEN count(latency_s) = count(*) THEN max(latency_s) END AS deep_s FROM costed GROUP BY batch)""",
    "cost_by_fanout": _cost_by_fanout,
    "cheapest_under_deadline": _with(LOG, LOADS, PRICED) + f"""
SELECT batch, cluster_id, load, {_r('base_j')} AS base_j, {_r('scaled_j')} AS scaled_j, {_r('enhanced_j')} AS enhanced_j FROM priced""",
    "batch_energy": _with(LOG, LOADS, PRICED) + f"""
SELECT batch, {_r('CASE WHEN count(base_j) = count(*) THEN sum(base_j) END', 4)} AS base_j,
       {_r('CASE WHEN count(scaled_j) = count(*) THEN sum(scaled_j) END', 4)} AS scaled_j,
       {_r('CASE WHEN count(enhanced_j) = count(*) THEN sum(enhanced_j) END', 4)} AS enhanced_j
FROM priced GROUP BY batch""",
    "cost_sweep": _cost_sweep,
    "energy_by_fanout": _energy_by_fanout,
    "config_select": """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 3""",
    "group_means": f"""
SELECT l_returnflag, l_linenumber, {_r('avg(l_extendedprice)', 4)} AS l_extendedprice,
       {_r('avg(l_quantity)', 4)} AS l_quantity, {_r('avg(l_discount)', 4)} AS l_discount
FROM lineitem GROUP BY ALL""",
    "align_series": f"""
SELECT l_shipdate::DATE::VARCHAR AS day, """ + ", ".join(
        f"(sum({CENTS}) FILTER (l_returnflag = '{f}')::BIGINT // nullif(count(*) FILTER (l_returnflag = '{f}'), 0))::DOUBLE AS flag_{f.lower()}"
        for f in ("A", "N", "R")) + " FROM lineitem GROUP BY ALL",
    "zip_series": f"""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_lines, sum({CENTS})::BIGINT // count(*) AS mean_cents
FROM lineitem GROUP BY ALL""",
    "normalise_to_baseline": f"""
WITH series AS MATERIALIZED (
  SELECT l_returnflag, l_suppkey, sum({CENTS})::BIGINT // count(*) AS mean_cents FROM lineitem GROUP BY ALL)
SELECT s.l_returnflag, s.l_suppkey, s.mean_cents, {_r('s.mean_cents / b.mean_cents::DOUBLE')} AS relative
FROM series s LEFT JOIN series b ON b.l_suppkey = s.l_suppkey AND b.l_returnflag = 'A'""",
    "trimmed_mean": f"""
WITH ranked AS MATERIALIZED (
  SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n,
         row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS up,
         row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id DESC) AS down
  FROM events WHERE value IS NOT NULL)
SELECT event_type, n AS n_rows, count(*) AS n_used, {_r('avg(value)')} AS trimmed_mean
FROM ranked WHERE n <= 4 OR (up > 2 AND down > 2) GROUP BY ALL""",
    "trimmed_mean_unnamed": f"""
WITH lines AS MATERIALIZED (
  SELECT CASE WHEN l_returnflag NOT LIKE 'R%' THEN l_returnflag END AS flag, l_suppkey, nullif(l_quantity, 7) AS v FROM lineitem),
ranked AS MATERIALIZED (
  SELECT flag, l_suppkey, v, count(*) OVER (PARTITION BY flag, l_suppkey) AS n,
         row_number() OVER (PARTITION BY flag, l_suppkey ORDER BY v) AS i FROM lines WHERE v IS NOT NULL)
SELECT flag, l_suppkey, n AS n_rows, count(*) AS n_used, {_r('avg(v)')} AS trimmed_mean
FROM ranked WHERE n <= 6 OR (i > 3 AND i <= n - 3) GROUP BY ALL""",
    "positions_with_gaps": """
WITH placed AS (
  SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, nullif(o_custkey % 50, 7) AS cust FROM orders),
numbered AS (
  SELECT status, cust, row_number() OVER (PARTITION BY status ORDER BY cust NULLS FIRST) - 1 AS pos FROM placed)
SELECT bucket_rows, status, coalesce(cust, -1) AS cust, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos
FROM numbered, (VALUES (4096), (1000000)) t(bucket_rows) GROUP BY ALL""",
    "distinct_levels": """
WITH levels AS (
  SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS level FROM orders
  UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders)
SELECT "column", level, count(*) OVER (PARTITION BY "column") AS n_levels FROM levels WHERE level IS NOT NULL""",
}
