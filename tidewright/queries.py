"""Registered queries over the driver's tables, and the SQL that checks them.

E1 is events by user, E2 line items by supplier, E3 embeddings, E4 documents with labels, E5
conversations. Doubles are rounded to six places in the outermost projection of both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import kernels as K
from tidewright.operators import corruptions, curation, reports, stats
from tidewright.operators import signals as S
from tidewright.plans import curator, plots
from tidewright.sources import datasets, views
from tidewright.sources.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The common parts of the checking SQL.
_E1 = """
e1 AS (SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
              (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t, value AS x FROM events),
e1n AS (SELECT ep, step, t, CASE WHEN stddev_pop(x) OVER (PARTITION BY ep) > 0 THEN (x - avg(x) OVER (PARTITION BY ep)) / stddev_pop(x) OVER (PARTITION BY ep) ELSE 0 END AS x FROM e1)
"""
_E2 = """
items AS (SELECT l_suppkey AS ep, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS step,
                 l_quantity, l_discount, l_tax, l_extendedprice / 1000 AS state FROM lineitem),
e2 AS (SELECT ep, step, step / 20 AS t, 0 AS dof, l_quantity AS x FROM items UNION ALL SELECT ep, step, step / 20, 1, l_discount FROM items UNION ALL SELECT ep, step, step / 20, 2, l_tax FROM items),
e2n AS (SELECT ep, step, t, dof, CASE WHEN stddev_pop(x) OVER (PARTITION BY ep, dof) > 0 THEN (x - avg(x) OVER (PARTITION BY ep, dof)) / stddev_pop(x) OVER (PARTITION BY ep, dof) ELSE 0 END AS x FROM e2)
"""


def _gradient_sql(source: str, out: str, dof: str = "") -> str:
    keys, part = f"ep, step, t{dof}", f"PARTITION BY ep{dof} ORDER BY step"
    return f"""
{out}_ AS (SELECT {keys}, x, lag(x) OVER w AS x0, lead(x) OVER w AS x2, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM {source} WINDOW w AS ({part})),
{out} AS (SELECT {keys}, CASE WHEN x0 IS NULL THEN (x2 - x) / nullif(b, 0) WHEN x2 IS NULL THEN (x - x0) / nullif(a, 0)
          ELSE (a * a * x2 + (b * b - a * a) * x - b * b * x0) / nullif(a * b * (a + b), 0) END AS x FROM {out}_)"""


def query(sql: str | None = None):
    def note(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return note


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


_JERK1 = f"WITH {_E1}, {_gradient_sql('e1n', 'g1')}, {_gradient_sql('g1', 'g2')}, jerk AS (SELECT ep, avg(abs(x)) AS v, max(abs(x)) AS m, count(*) AS n FROM g2 GROUP BY ep)"


@query(f"{_JERK1} SELECT ep AS episode_index, round(CASE WHEN n >= 3 THEN v END, 6) AS value, round(CASE WHEN n >= 3 THEN m END, 6) AS max_jerk FROM jerk")
def q_jerk(spark, sf_dir):
    return S.jerk(views.event_frames(spark, sf_dir)).select("episode_index", *r6("value", "max_jerk"))


@query(f"WITH {_E1}, {_gradient_sql('e1n', 'g1')}, {_gradient_sql('g1', 'g2')}, {_gradient_sql('g2', 'g3')} SELECT ep AS episode_index, round(CASE WHEN count(*) >= 4 THEN avg(abs(x)) END, 6) AS value FROM g3 GROUP BY ep")
def q_jerk_order3(spark, sf_dir):
    return S.jerk(views.event_frames(spark, sf_dir), order=3).select("episode_index", *r6("value"))


@query(f"WITH {_E2}, {_gradient_sql('e2n', 'g1', ', dof')}, {_gradient_sql('g1', 'g2', ', dof')}, s AS (SELECT ep, step, sqrt(sum(x * x)) AS n FROM g2 GROUP BY ep, step) SELECT ep AS episode_index, round(avg(n), 6) AS value, round(max(n), 6) AS max_jerk FROM s GROUP BY ep")
def q_jerk_three_dimensions(spark, sf_dir):
    return S.jerk(views.line_frames(spark, sf_dir)).select("episode_index", *r6("value", "max_jerk"))


_JITTER1 = """
j0 AS (SELECT ep, step, x, list_sort([coalesce(lag(x) OVER w, x), x, coalesce(lead(x) OVER w, x)])[2] AS m FROM e1n WINDOW w AS (PARTITION BY ep ORDER BY step)),
jit AS (SELECT ep, avg(abs(x - m)) AS jitter FROM j0 GROUP BY ep)"""


@query(f"WITH {_E1}, {_JITTER1} SELECT ep AS episode_index, round(jitter, 6) AS jitter FROM jit")
def q_action_jitter(spark, sf_dir):
    return S.jitter(views.event_frames(spark, sf_dir)).select("episode_index", *r6("jitter"))


def _z(c: str) -> str:
    return f"CASE WHEN {c}_mad > 0 THEN 0.6745 * ({c} - {c}_med) / {c}_mad WHEN {c}_std > 0 THEN ({c} - {c}_avg) / {c}_std ELSE 0 END"


_SUMMARY = f"""{_E1}, {_JITTER1},
sm AS (SELECT e1.ep, avg(abs(x)) AS mean_abs, stddev_pop(x) AS mean_std, any_value(jitter) AS jitter, count(*)::DOUBLE AS n_steps FROM e1 JOIN jit USING (ep) GROUP BY e1.ep),
st AS (SELECT {', '.join(f'median({c}) AS {c}_med, avg({c}) AS {c}_avg, stddev_pop({c}) AS {c}_std' for c in S.SUMMARY)} FROM sm WHERE n_steps >= 3),
md AS (SELECT {', '.join(f'median(abs({c} - {c}_med)) AS {c}_mad' for c in S.SUMMARY)} FROM sm, st WHERE n_steps >= 3),
zs AS (SELECT ep, n_steps, {', '.join(f'{_z(c)} AS z_{c}' for c in S.SUMMARY)} FROM sm, st, md)"""


@query(f"WITH {_SUMMARY}, o AS (SELECT *, greatest({', '.join(f'abs(z_{c})' for c in S.SUMMARY)}) AS outlier FROM zs) SELECT ep AS episode_index, round(CASE WHEN n_steps >= 3 THEN greatest(z_jitter, outlier) END, 6) AS value, round(outlier, 6) AS outlier_z, outlier > 3.5 AS is_outlier FROM o")
def q_action_noise(spark, sf_dir):
    return S.action_noise(views.event_frames(spark, sf_dir)).select("episode_index", *r6("value", "outlier_z"), "is_outlier")


_PATH = "SELECT ep AS episode_index, round(CASE WHEN p >= 1e-9 THEN n / p END, 6) AS value FROM (SELECT ep, sqrt(sum(s * s)) AS n FROM (SELECT ep, dof, sum(x) AS s FROM mv GROUP BY ep, dof) GROUP BY ep) JOIN (SELECT ep, sum(d) AS p FROM (SELECT ep, step, sqrt(sum(x * x)) AS d FROM mv GROUP BY ep, step) GROUP BY ep) USING (ep)"


@query(f"WITH {_E2}, mv AS (SELECT * FROM e2) {_PATH}")
def q_path_efficiency_increments(spark, sf_dir):
    return S.path_efficiency(views.line_frames(spark, sf_dir)).select("episode_index", *r6("value"))


@query(f"WITH {_E2}, mv AS (SELECT ep, step, dof, x FROM (SELECT ep, step, dof, x - lag(x) OVER (PARTITION BY ep, dof ORDER BY step) AS x FROM e2) WHERE x IS NOT NULL) {_PATH}")
def q_path_efficiency_positions(spark, sf_dir):
    return S.path_efficiency(views.line_frames(spark, sf_dir), motion="positions").select("episode_index", *r6("value"))


_EMBED = f"""{_E2},
an AS (SELECT ep, step, sqrt(sum(x * x)) AS n, sqrt(sum(d * d)) AS c FROM (SELECT ep, step, dof, x, x - lag(x) OVER (PARTITION BY ep, dof ORDER BY step) AS d FROM e2) GROUP BY ep, step),
sn AS (SELECT ep, step, abs(state) AS n, abs(state - lag(state) OVER (PARTITION BY ep ORDER BY step)) AS c FROM items),
em AS (SELECT * FROM (SELECT ep, count(*)::DOUBLE AS n_steps, avg(n) AS action_mean, stddev_pop(n) AS action_std, coalesce(avg(c), 0) AS action_change FROM an GROUP BY ep)
       JOIN (SELECT ep, avg(n) AS state_mean, stddev_pop(n) AS state_std, coalesce(avg(c), 0) AS state_change FROM sn GROUP BY ep) USING (ep))"""


@query(f"WITH {_EMBED} SELECT ep AS episode_index, {', '.join(f'round({c}, 6) AS {c}' for c in S.EMBEDDING)} FROM em")
def q_stat_embedding(spark, sf_dir):
    return S.statistical_embedding(views.line_frames(spark, sf_dir), state="state").select("episode_index", *r6(*S.EMBEDDING))


_Z = ", ".join(f"(({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END))" for c in S.EMBEDDING)


@query(f"WITH {_EMBED}, z AS (SELECT ep, [{_Z}] AS v FROM em) SELECT a.ep AS episode_index, round(min(list_distance(a.v, b.v)), 6) AS value FROM z a JOIN z b ON a.ep <> b.ep GROUP BY a.ep")
def q_embedded_redundancy(spark, sf_dir):
    v = S.standardised(S.statistical_embedding(views.line_frames(spark, sf_dir), state="state"), S.EMBEDDING)
    return S.redundancy(v).select("episode_index", *r6("value"))


_VALIDITY = f"""WITH {_E1}, d AS (SELECT ep, abs(x - lag(x) OVER (PARTITION BY ep ORDER BY step)) AS d FROM e1),
s AS (SELECT ep, count(*) AS n, coalesce(avg(CASE WHEN d < 1e-8 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 0) AS still FROM d GROUP BY ep), m AS (SELECT median(n) AS med FROM s),
v AS (SELECT ep, CASE WHEN n < .5 * med THEN (.5 * med - n) / med ELSE 0 END AS tr, greatest(0, still - .1) AS st FROM s, m)"""


@query(f"""{_VALIDITY}
SELECT ep AS episode_index, round(tr + st, 6) AS value, round(tr, 6) AS truncated, round(st, 6) AS stalled, tr + st = 0 AS is_valid FROM v""")
def q_structural_validity(spark, sf_dir):
    return S.structural_validity(views.event_frames(spark, sf_dir)).select("episode_index", *r6("value", "truncated", "stalled"), "is_valid")


@query(f"{_VALIDITY} SELECT count(*) FILTER (tr + st = 0) AS n_valid, count(*) FILTER (tr > 0) AS n_truncated, count(*) FILTER (st > 0) AS n_stalled, count(*) FILTER (tr IS NULL) AS n_nonfinite FROM v")
def q_structural_tally(spark, sf_dir):
    return reports.structural_tally(S.structural_validity(views.event_frames(spark, sf_dir)))


@query(f"WITH {_E1}, d AS (SELECT ep, abs(x - 2 * lag(x) OVER w + lag(x, 2) OVER w) AS d FROM e1 WINDOW w AS (PARTITION BY ep ORDER BY step)) SELECT round(-avg(m), 6) AS quality FROM (SELECT ep, avg(d) AS m FROM d WHERE d IS NOT NULL GROUP BY ep)")
def q_action_roughness(spark, sf_dir):
    return reports.action_roughness(views.event_frames(spark, sf_dir)).select(*r6("quality"))


@query("SELECT user_id AS episode_index, (row_number() OVER w - 1)::INT AS step, (row_number() OVER w - 1) / 20 AS t, value AS level, -value AS action FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_nested_steps(spark, sf_dir):
    """Events as nested episodes, read back as frames."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_index"), F.struct("ts", "event_id", F.struct(F.col("value").alias("level")).alias("observation"), (-F.col("value")).alias("action")).alias("s"))
    steps = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["observation"].alias("observation"), s["action"].alias("action")))
    frames = datasets.read_nested(e.groupBy("episode_index").agg(steps.alias("steps")), fps=20.0)
    return frames.select("episode_index", "step", "t", F.col("`observation.level`").alias("level"), "action")


@query(f"""WITH {_E2}, j AS (SELECT ep, l_tax, greatest(abs(l_quantity - lag(l_quantity) OVER w), abs(state - lag(state) OVER w)) AS jump FROM items WINDOW w AS (PARTITION BY ep ORDER BY step))
SELECT ep AS episode_index, round(greatest(0, max(l_tax) - .005) + greatest(0, coalesce(max(jump), 0) - 1), 6) AS value, round(max(l_tax), 6) AS max_penetration, round(coalesce(max(jump), 0), 6) AS max_jump FROM j GROUP BY ep""")
def q_sim_validity(spark, sf_dir):
    frames = views.line_frames(spark, sf_dir).withColumns({"height": F.get("state", 0), "place": F.get("action", 0)})
    return S.sim_validity(frames, "penetration", ["height", "place"]).select("episode_index", *r6("value", "max_penetration", "max_jump"))


@query(f"""WITH {_E1}, n AS (SELECT ep, count(*) AS n, median(dt) AS dt FROM (SELECT ep, t - lag(t) OVER (PARTITION BY ep ORDER BY step) AS dt FROM e1) GROUP BY ep),
p AS (SELECT ep, n, 1 / dt AS fs, (2 ** (ceil(log2(n)) + 4))::BIGINT AS nfft FROM n WHERE n >= 4),
k AS (SELECT ep, fs, nfft, unnest(range(0, nfft // 2 + 1)) AS k FROM p),
f AS (SELECT k.ep, k.k, any_value(k.k * (fs / nfft)) AS f, sqrt(sum(abs(x) * cos(2 * pi() * k.k * step / nfft)) ** 2 + sum(abs(x) * sin(2 * pi() * k.k * step / nfft)) ** 2) AS m FROM k JOIN e1 USING (ep) GROUP BY k.ep, k.k),
g AS (SELECT ep, k, f, m / max(m) OVER (PARTITION BY ep) AS m FROM f), h AS (SELECT * FROM g WHERE f <= 10),
s AS (SELECT ep, min(k) AS a, max(k) AS b FROM h WHERE m >= .05 GROUP BY ep), c AS (SELECT h.* FROM h JOIN s ON h.ep = s.ep AND h.k BETWEEN s.a AND s.b),
d AS (SELECT ep, (f - lag(f) OVER w) / (max(f) OVER (PARTITION BY ep) - min(f) OVER (PARTITION BY ep)) AS df, m - lag(m) OVER w AS dm FROM c WINDOW w AS (PARTITION BY ep ORDER BY k)),
v AS (SELECT ep, -sum(sqrt(df * df + dm * dm)) AS v, count(*) AS n FROM d GROUP BY ep)
SELECT n.ep AS episode_index, round(CASE WHEN v.n >= 2 THEN v.v END, 5) AS value FROM n LEFT JOIN v ON v.ep = n.ep""")
def q_sparc(spark, sf_dir):
    return S.spectral_smoothness(views.event_frames(spark, sf_dir)).select("episode_index", F.round("value", 5).alias("value"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id AS episode_index, round(min(list_distance(a.v, b.v)), 6) AS value FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id")
def q_knn_redundancy(spark, sf_dir):
    return S.redundancy(views.vectors(spark, sf_dir).select("episode_index", "v")).select("episode_index", *r6("value"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id), k AS (SELECT vec_id, d FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) <= 3) SELECT vec_id AS episode_index, round(avg(d), 6) AS value FROM k GROUP BY vec_id")
def q_knn_redundancy_k3(spark, sf_dir):
    return S.redundancy(views.vectors(spark, sf_dir).select("episode_index", "v"), k=3).select("episode_index", *r6("value"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT min(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT count(*) AS n, round(avg(d), 6) AS diversity FROM n")
def q_diversity(spark, sf_dir):
    return S.nearest(views.vectors(spark, sf_dir).select("episode_index", "v")).agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("diversity"))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.event_frames(spark, sf_dir)
    columns = ["episode_index", "signal", "value", "higher_is_better", "skip_reason"]
    return S.jerk(frames).select(*columns).union(S.action_noise(frames).select(*columns)).union(S.path_efficiency(frames, dims=(0, 1), motion="positions").select(*columns))


def computed(scores):
    """Scores computed once, as they are read twice."""
    return K.cut(scores)


def event_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.weighted_sum(computed(event_scores(spark, sf_dir)), {"jerk": 2.0}).withColumn("fingerprint", F.lpad(F.col("episode_index").cast("string"), 20, "0"))


_SCORES = f"""WITH {_SUMMARY}, {_gradient_sql('e1n', 'g1')}, {_gradient_sql('g1', 'g2')},
sc AS (SELECT ep, 'jerk' AS signal, CASE WHEN count(*) >= 3 THEN avg(abs(x)) END AS value, false AS high FROM g2 GROUP BY ep
 UNION ALL SELECT ep, 'action_noise', CASE WHEN n_steps >= 3 THEN greatest(z_jitter, {', '.join(f'abs(z_{c})' for c in S.SUMMARY)}) END, false FROM zs
 UNION ALL SELECT ep, 'path_efficiency', CASE WHEN count(*) >= 2 AND sum(abs(d)) >= 1e-9 THEN abs(sum(d)) / sum(abs(d)) END, true FROM (SELECT ep, x - lag(x) OVER (PARTITION BY ep ORDER BY step) AS d FROM e1) GROUP BY ep),
bo AS (SELECT signal, min(value) AS a, max(value) AS b FROM sc GROUP BY signal),
nm AS (SELECT ep, signal, value, high, CASE WHEN value IS NULL OR b <= a THEN .5 WHEN high THEN (value - a) / (b - a) ELSE 1 - (value - a) / (b - a) END AS norm FROM sc JOIN bo USING (signal)),
ks AS (SELECT ep, sum(norm * CASE signal WHEN 'jerk' THEN 2 ELSE 1 END) / 4 AS keep, lpad(ep::VARCHAR, 20, '0') AS fp FROM nm GROUP BY ep)"""


@query(f"{_SCORES} SELECT ep AS episode_index, signal, round(norm, 6) AS norm FROM nm")
def q_minmax_keep(spark, sf_dir):
    return curation.normalised(computed(event_scores(spark, sf_dir))).select("episode_index", "signal", *r6("norm"))


@query(f"{_SCORES} SELECT ep AS episode_index, round(keep, 6) AS keep_score FROM ks")
def q_weighted_sum(spark, sf_dir):
    return event_keep(spark, sf_dir).select("episode_index", *r6("keep_score"))


@query(f"{_SCORES} SELECT ep AS episode_index, round(keep, 6) AS keep_score FROM ks QUALIFY row_number() OVER (ORDER BY keep DESC, fp) <= (SELECT round_even(.8 * count(*), 0) FROM ks)")
def q_topk_budget(spark, sf_dir):
    keep = K.cut(event_keep(spark, sf_dir))
    return curation.top_k(keep, curation.Budget("fraction", 0.8).resolve(keep.count())).select("episode_index", *r6("keep_score"))


@query(f"{_SCORES}, g AS (SELECT ks.* FROM ks JOIN (SELECT ep FROM sc WHERE signal = 'action_noise' AND NOT coalesce(value > 2, false)) USING (ep)) SELECT ep AS episode_index, round(keep, 6) AS keep_score FROM g QUALIFY row_number() OVER (ORDER BY keep DESC, fp) <= (SELECT round_even(.5 * count(*), 0) FROM g)")
def q_gate_topk(spark, sf_dir):
    scores = K.cut(event_scores(spark, sf_dir))
    gated = scores.where((F.col("signal") == "action_noise") & curation.Gate("action_noise", reject_above=2.0).rejects(F.col("value")))
    keep = curation.weighted_sum(scores, {"jerk": 2.0}).withColumn("fingerprint", F.lpad(F.col("episode_index").cast("string"), 20, "0"))
    valid = K.cut(keep.join(gated.select("episode_index"), "episode_index", "left_anti"))
    return curation.top_k(valid, curation.Budget("fraction", 0.5).resolve(valid.count())).select("episode_index", *r6("keep_score"))


@query(f"{_SCORES}, g AS (SELECT * FROM ks WHERE ep % 7 <> 0) SELECT ep AS episode_index, round(keep, 6) AS keep_score FROM g QUALIFY row_number() OVER (ORDER BY keep DESC, fp) <= 20")
def q_drop_list(spark, sf_dir):
    keep = event_keep(spark, sf_dir)
    listed = keep.where("episode_index % 7 = 0").select("episode_index")
    return curation.top_k(keep.join(listed, "episode_index", "left_anti"), 20).select("episode_index", *r6("keep_score"))


@query(f"{_SCORES}, g AS (SELECT * FROM ks WHERE ep % 3 = 0) SELECT ep AS episode_index, round(keep, 6) AS keep_score FROM g QUALIFY row_number() OVER (ORDER BY keep DESC, fp) <= 20")
def q_keep_list(spark, sf_dir):
    keep = event_keep(spark, sf_dir)
    listed = keep.where("episode_index % 3 = 0").select("episode_index")
    return curation.top_k(keep.join(listed, "episode_index", "left_semi"), 20).select("episode_index", *r6("keep_score"))


@query(f"{_SCORES} SELECT ep AS episode_index, round(keep, 6) AS keep_score FROM ks QUALIFY row_number() OVER (ORDER BY keep, fp) <= 10")
def q_rank_worst(spark, sf_dir):
    return curation.worst(event_keep(spark, sf_dir), 10).select("episode_index", *r6("keep_score"))


@query(f"{_SCORES}, p AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY norm, signal) AS place FROM nm) SELECT ep AS episode_index, place::INT AS place, signal, round(norm, 6) AS norm FROM p WHERE place = 1 OR (place = 2 AND norm < .5)")
def q_responsible_signals(spark, sf_dir):
    return curation.responsible(computed(event_scores(spark, sf_dir))).select("episode_index", "place", "signal", *r6("norm"))


@query(f"{_SCORES} SELECT signal, high AS higher_is_better, count(value) AS scored, count(*) - count(value) AS skipped, round(min(value), 6) AS low, round(median(value), 6) AS median, round(max(value), 6) AS high FROM sc GROUP BY signal, high")
def q_signal_report(spark, sf_dir):
    return reports.signal_report(event_scores(spark, sf_dir)).select("signal", "higher_is_better", "scored", "skipped", *r6("low", "median", "high"))


@query(f"{_JERK1}, k AS (SELECT ep, 1 - (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS keep FROM jerk WHERE n >= 3), d AS (SELECT ep, keep, row_number() OVER (ORDER BY keep DESC, lpad(ep::VARCHAR, 20, '0')) <= (SELECT round_even(.8 * count(*), 0) FROM k) AS kept FROM k) SELECT ep AS episode_index, round(keep, 6) AS keep_score, kept, (CASE WHEN kept THEN 'kept' ELSE 'below budget' END) AS reason FROM d")
def q_curate(spark, sf_dir):
    result = curator.run(views.event_frames(spark, sf_dir), curator.CurationSpec(budget=curation.Budget("fraction", 0.8), baseline=False))
    return result.decisions.select("episode_index", *r6("keep_score"), "kept", F.split("reason", ":")[0].alias("reason"))


def decided(spark: SparkSession, sf_dir: str, name: str, parameters: dict) -> DataFrame:
    return curator.run(views.event_frames(spark, sf_dir), curator.CurationSpec({name: parameters}, budget=curation.Budget("fraction", 0.5), baseline=False)).decisions


@query(f"""{_SCORES}, a AS (SELECT ep FROM nm WHERE signal = 'jerk' QUALIFY row_number() OVER (ORDER BY norm DESC, lpad(ep::VARCHAR, 20, '0')) <= (SELECT round_even(.5 * count(*), 0) FROM ks)),
b AS (SELECT ep FROM nm WHERE signal = 'action_noise' QUALIFY row_number() OVER (ORDER BY norm DESC, lpad(ep::VARCHAR, 20, '0')) <= (SELECT round_even(.5 * count(*), 0) FROM ks)),
f AS (SELECT a.ep AS a, b.ep AS b FROM a FULL JOIN b ON a.ep = b.ep)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) AS n_either, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 6) AS jaccard FROM f""")
def q_compare_runs(spark, sf_dir):
    return reports.compare(decided(spark, sf_dir, "jerk", {}), decided(spark, sf_dir, "action_noise", {})).select("n_both", "n_either", "only_a", "only_b", *r6("jaccard"))


@query("""WITH e AS (SELECT DISTINCT user_id AS ep FROM events), p AS (SELECT ep, CASE WHEN ep % 5 = 0 THEN 'missing' WHEN ep % 5 = 1 THEN 'kept differs' WHEN ep % 5 = 2 THEN 'reason differs' END AS problem FROM e)
SELECT ep AS episode_index, problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT -1 - ep, 'not expected' FROM e WHERE ep % 5 = 3""")
def q_verify(spark, sf_dir):
    """Differences are planted: missing episodes, other verdicts, other reasons, episodes that were not expected."""
    once = decided(spark, sf_dir, "jerk", {}).select("episode_index", "kept", "reason")
    kind = F.col("episode_index") % 5
    changed = once.where(kind != 0).withColumns({"kept": F.when(kind == 1, ~F.col("kept")).otherwise(F.col("kept")), "reason": F.when(kind == 2, F.concat("reason", F.lit("!"))).otherwise(F.col("reason"))})
    more = once.where(kind == 3).withColumn("episode_index", -1 - F.col("episode_index"))
    return reports.verify(once, changed.union(more))


@query("SELECT d.doc_id AS episode_index FROM documents d WHERE md5(d.text) NOT IN (SELECT md5(c.text) FROM documents c JOIN labels l USING (doc_id) WHERE l.quality = 1)")
def q_diff_anti(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    source = docs.select(F.col("doc_id").alias("episode_index"), F.md5("text").alias("fingerprint"))
    curated = docs.join(labels.where("quality = 1"), "doc_id").select(F.md5("text").alias("fingerprint"))
    return reports.diff(source, curated).select("episode_index")


@query("SELECT doc_id AS episode_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q_diff_by_index(spark, sf_dir):
    """The curated side has no fingerprints, so numbers are compared."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_index"), F.md5("text").alias("fingerprint"))
    curated = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("episode_index"), F.lit(None).cast("string").alias("fingerprint"))
    return reports.diff_or_index(source, curated).select("episode_index")


_ORDERS = f"WITH {_E1}, {_gradient_sql('e1n', 'g1')}, {_gradient_sql('g1', 'g2')}, {_gradient_sql('g2', 'g3')}"


@query(f"""{_ORDERS}, a AS (SELECT CASE WHEN count(*) >= 3 THEN avg(abs(x)) END AS v FROM g2 GROUP BY ep), b AS (SELECT CASE WHEN count(*) >= 4 THEN avg(abs(x)) END AS v FROM g3 GROUP BY ep)
SELECT 'jerk' AS signal, (SELECT count(v) FROM a) AS scored_a, (SELECT count(v) FROM b) AS scored_b, round((SELECT median(v) FROM a), 6) AS median_a, round((SELECT median(v) FROM b), 6) AS median_b, round((SELECT median(v) FROM b) - (SELECT median(v) FROM a), 6) AS delta""")
def q_compare_signals(spark, sf_dir):
    frames = views.event_frames(spark, sf_dir)
    return reports.compare_signals(S.jerk(frames), S.jerk(frames, order=3)).select("signal", "scored_a", "scored_b", *r6("median_a", "median_b", "delta"))


@query(f"{_ORDERS} SELECT ep AS episode_index, round(min(abs(x)), 6) AS low, round(median(abs(x)), 6) AS median, round(max(abs(x)), 6) AS high FROM g2 WHERE x IS NOT NULL GROUP BY ep")
def q_step_summary(spark, sf_dir):
    return reports.step_summary(S.jerk_steps(views.event_frames(spark, sf_dir))).select("episode_index", *r6("low", "median", "high"))


@query("SELECT source, count(*) AS n, min(n_chars) AS low, median(n_chars) AS median, max(n_chars) AS high FROM documents GROUP BY source")
def q_profile_lengths(spark, sf_dir):
    return reports.distribution(views.document_episodes(spark, sf_dir), "n_steps", ["source"])


@query("WITH s AS (SELECT count(*) AS n FROM events GROUP BY user_id), r AS (SELECT min(n) AS a, max(n) AS b, least(5, max(n) - min(n) + 1) AS k FROM s), t AS (SELECT ((n - a) * k // (b - a + 1))::INT AS bucket, a, b, k FROM s, r) SELECT bucket, (a + ceil(bucket * (b - a + 1) / k))::BIGINT AS low, (a + ceil((bucket + 1) * (b - a + 1) / k) - 1)::BIGINT AS high, count(*) AS n FROM t GROUP BY bucket, a, b, k")
def q_length_histogram(spark, sf_dir):
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_steps"))
    return reports.length_histogram(lengths, "n_steps")


@query("WITH r AS (SELECT min(n_chars)::DOUBLE AS a, max(n_chars)::DOUBLE AS b FROM documents), p AS (SELECT least(19, floor((n_chars - a) / (b - a) * 20))::INT AS bin, a, (b - a) / 20 AS w FROM documents, r) SELECT bin, round(a + bin * w, 6) AS low, round(a + (bin + 1) * w, 6) AS high, count(*) AS n FROM p GROUP BY bin, a, w")
def q_signal_histogram(spark, sf_dir):
    return plots.histogram(lengths_as_scores(spark, sf_dir)).select("bin", *r6("low", "high"), "n")


@query("SELECT source, count(*) AS n, min(n_chars)::DOUBLE AS low, round(quantile_cont(n_chars, .25), 6) AS q1, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, .75), 6) AS q3, max(n_chars)::DOUBLE AS high FROM documents GROUP BY source")
def q_box_by_source(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_index"), "source")
    return reports.box(lengths_as_scores(spark, sf_dir), sources, "source").select("source", "n", "low", *r6("q1", "median", "q3"), "high")


def lengths_as_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_index"), F.lit("n_chars").alias("signal"), F.col("n_chars").cast("double").alias("value"))


@query("SELECT quality = 1 AS kept, count(*) AS n, round(avg(n_chars), 6) AS mean_steps FROM documents JOIN labels USING (doc_id) GROUP BY kept")
def q_length_confound(spark, sf_dir):
    e = views.document_episodes(spark, sf_dir).where("success is not null")
    return reports.length_confound(e.select("episode_index", F.col("success").alias("kept")), e).select("kept", "n", *r6("mean_steps"))


_COVER = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN l_suppkey END) AS present, round(count(DISTINCT CASE WHEN {c} IS NOT NULL THEN l_suppkey END) / count(DISTINCT l_suppkey), 6) AS coverage, round(count({c}) / count({c}), 6) AS finite_fraction, round(min({c}), 6) AS low, round(max({c}), 6) AS high, round(avg({c}), 6) AS mean FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))


@query(_COVER)
def q_feature_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "episode_index")
    n = items.select("episode_index").distinct().count()
    return reports.feature_coverage(items, ["l_quantity", "l_discount", "l_tax"], n).select("feature", "present", *r6("coverage", "finite_fraction", "low", "high", "mean"))


@query(f"WITH {_E2} SELECT dof::INT AS dof, count(x) AS n, round(min(x), 6) AS low, round(median(x), 6) AS median, round(max(x), 6) AS high FROM e2 GROUP BY dof")
def q_feature_profile(spark, sf_dir):
    return reports.feature_profile(K.to_long(views.line_frames(spark, sf_dir), "action")).select("dof", "n", *r6("low", "median", "high"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS n_success, count(*) FILTER (quality = 0) AS n_failure, count(*) FILTER (quality IS NULL) AS n_unknown, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def q_success_rate(spark, sf_dir):
    return reports.success_rate(views.document_episodes(spark, sf_dir), "success", ["lang"]).select("lang", "n_success", "n_failure", "n_unknown", *r6("rate"))


@query("SELECT task, count(*) AS n FROM (SELECT lang AS task FROM documents UNION ALL SELECT source FROM documents) GROUP BY task")
def q_task_counts(spark, sf_dir):
    return reports.task_counts(views.document_episodes(spark, sf_dir), "tasks")


@query("SELECT lang, sum(quality)::BIGINT AS n_pos, (count(*) - sum(quality))::BIGINT AS n_neg, round((SELECT sum(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN .5 ELSE 0 END) FROM documents p JOIN labels lp ON lp.doc_id = p.doc_id AND lp.quality = 1, documents q JOIN labels lq ON lq.doc_id = q.doc_id AND lq.quality = 0 WHERE p.lang = d.lang AND q.lang = d.lang) / nullif(sum(quality) * (count(*) - sum(quality)), 0), 6) AS auc FROM documents d JOIN labels USING (doc_id) GROUP BY lang")
def q_auc_quality(spark, sf_dir):
    e = views.document_episodes(spark, sf_dir).where("success is not null").withColumn("length", F.col("n_steps").cast("double"))
    return stats.rank_auc(e, ["lang"], "success", "length").select("lang", "n_pos", "n_neg", *r6("auc"))


@query("WITH d AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY quality, doc_id) AS b FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS rho FROM d GROUP BY lang")
def q_spearman(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "doc_id", F.col("n_chars").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))
    return stats.spearman(docs, ["lang"], "a", "b", "doc_id").select("lang", "n", *r6("rho"))


@query("WITH n AS (SELECT user_id AS ep, count(*) AS n FROM events GROUP BY user_id) SELECT ep AS episode_index, greatest(2, round_even(n * .5, 0))::BIGINT AS n_steps FROM n")
def q_corrupt_truncate(spark, sf_dir):
    return corruptions.truncate(views.event_frames(spark, sf_dir), 0.5).groupBy("episode_index").agg(F.count("*").alias("n_steps"))


@query(f"WITH {_E1}, k AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n FROM e1) SELECT ep AS episode_index, count(*) AS n_steps, round(sum(x), 6) AS total FROM k WHERE n <= 2 OR step % 4 = 0 OR (n <= 4 AND step = n - 1) GROUP BY ep")
def q_corrupt_frame_skip(spark, sf_dir):
    return corruptions.frame_skip(views.event_frames(spark, sf_dir)).groupBy("episode_index").agg(F.count("*").alias("n_steps"), F.round(F.sum(F.get("action", 0)), 6).alias("total"))


@query(f"WITH {_E1}, g AS (SELECT ep, x, .5 * stddev_pop(x) OVER (PARTITION BY ep) AS g FROM e1) SELECT ep AS episode_index, round(sum(CASE WHEN g > 0 THEN round_even(x / g, 0) * g ELSE x END), 6) AS total FROM g GROUP BY ep")
def q_corrupt_quantize(spark, sf_dir):
    return corruptions.action_quantize(views.event_frames(spark, sf_dir)).groupBy("episode_index").agg(F.round(F.sum(F.get("action", 0)), 6).alias("total"))


@query("WITH n AS (SELECT user_id AS ep, count(*) AS n FROM events GROUP BY user_id) SELECT ep AS episode_index, n + greatest(1, round_even(n / 3, 0))::BIGINT AS n_steps FROM n")
def q_corrupt_stall(spark, sf_dir):
    return corruptions.stall(views.event_frames(spark, sf_dir)).groupBy("episode_index").agg(F.count("*").alias("n_steps"))


@query("SELECT user_id AS episode_index, count(*) AS n_steps, kind FROM events, (SELECT unnest(['jitter', 'detour', 'wrong_target_offset', 'dropped_dof']) AS kind) GROUP BY user_id, kind")
def q_corrupt_seeded(spark, sf_dir):
    out = None
    for kind in corruptions.SEEDED:
        rows = corruptions.seeded(views.event_frames(spark, sf_dir), kind, seed=3).groupBy("episode_index").agg(F.count("*").alias("n_steps")).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.union(rows)
    return out


@query("""WITH n AS (SELECT user_id AS ep, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT ep, n, false AS bad FROM n UNION ALL SELECT ep, greatest(2, round_even(n * (1 - .9), 0)), true FROM n),
m AS (SELECT median(n) AS med FROM b), v AS (SELECT bad, CASE WHEN n < .5 * med THEN (.5 * med - n) / med ELSE 0 END AS v FROM b, m)
SELECT 'truncate' AS kind, 'structural_validity' AS signal, (SELECT count(*) FROM n) AS n_pos, (SELECT count(*) FROM n) AS n_neg, round(avg(CASE WHEN p.v > q.v THEN 1.0 WHEN p.v = q.v THEN .5 ELSE 0 END), 4) AS auc FROM v p, v q WHERE p.bad AND NOT q.bad""")
def q_detection_truncate(spark, sf_dir):
    found = corruptions.detection_matrix(views.event_frames(spark, sf_dir), ["truncate"], {"s": S.structural_validity})
    return found.select("kind", "signal", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query(f"""WITH {_E1}, d AS (SELECT ep, abs(x - lag(x) OVER (PARTITION BY ep ORDER BY step)) < 1e-8 AS still FROM e1),
o AS (SELECT ep, count(*) AS n, count(*) FILTER (still) AS k, greatest(1, round_even(count(*) / 3, 0)) AS c FROM d GROUP BY ep),
b AS (SELECT n, k, false AS bad FROM o UNION ALL SELECT n + c, k + c, true FROM o), m AS (SELECT median(n) AS med FROM b),
v AS (SELECT bad, CASE WHEN n < .5 * med THEN (.5 * med - n) / med ELSE 0 END + greatest(0, CASE WHEN n > 1 THEN k / (n - 1) ELSE 0 END - .1) AS v FROM b, m)
SELECT 'stall' AS kind, 'structural_validity' AS signal, (SELECT count(*) FROM o) AS n_pos, (SELECT count(*) FROM o) AS n_neg, round(avg(CASE WHEN p.v > q.v THEN 1.0 WHEN p.v = q.v THEN .5 ELSE 0 END), 4) AS auc FROM v p, v q WHERE p.bad AND NOT q.bad""")
def q_detection_stall(spark, sf_dir):
    found = corruptions.detection_matrix(views.event_frames(spark, sf_dir), ["stall"], {"s": S.structural_validity})
    return found.select("kind", "signal", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query(None)
def q_detection_matrix(spark, sf_dir):
    chosen = {"jerk": S.jerk, "action_noise": S.action_noise, "structural_validity": S.structural_validity}
    return corruptions.detection_matrix(views.event_frames(spark, sf_dir), ["jitter", "stall", "frame_skip", "action_quantize"], chosen).select("kind", "signal", "n_pos", "n_neg", *r6("auc"))


@query(f"WITH {_E1}, {_gradient_sql('e1n', 'g1')}, {_gradient_sql('g1', 'g2')}, p AS (SELECT ep, step, abs(x) AS norm, row_number() OVER (PARTITION BY ep ORDER BY abs(x) DESC, step) AS place FROM g2 WHERE x IS NOT NULL) SELECT ep AS episode_index, place::INT AS place, step::INT AS step, round(norm, 6) AS norm FROM p WHERE place <= 3")
def q_per_transition_worst(spark, sf_dir):
    return reports.worst_steps(S.jerk_steps(views.event_frames(spark, sf_dir))).select("episode_index", "place", "step", *r6("norm"))


@query("WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id AS episode_index, row_number() OVER (ORDER BY conv_id) - 1 AS out_index, (coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS from_index FROM n")
def q_running_index(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    placed = K.in_order(n, F.col("conv_id").asc(), total="n")
    return placed.select(F.col("conv_id").alias("episode_index"), (F.col("rank") - 1).alias("out_index"), F.col("before").alias("from_index"))


@query("WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), c AS (SELECT conv_id, n, coalesce(sum(n) OVER (ORDER BY md5(conv_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT conv_id AS episode_index, n AS n_steps FROM c WHERE b < 100")
def q_length_matched(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(F.count("*").alias("n_steps")).withColumn("o", F.md5(F.col("episode_index").cast("string")))
    return stats.length_matched(n, "o", 100).select("episode_index", "n_steps")


@query("SELECT source AS name, round(avg(n_chars), 6) AS submitted_mean, row_number() OVER (ORDER BY avg(n_chars), source) AS place FROM documents GROUP BY source")
def q_leaderboard(spark, sf_dir):
    means = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.avg("n_chars").alias("submitted_mean"))
    return stats.leaderboard(means).select("name", *r6("submitted_mean"), "place")


@query("WITH r AS (SELECT l_suppkey AS seed, avg(l_quantity) FILTER (l_returnflag = 'R') AS a, avg(l_quantity) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY l_suppkey), d AS (SELECT a - b AS d FROM r WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS n, round(avg(d), 6) AS delta, round(2 * sqrt(var_samp(d) / count(*)), 6) AS half_width, coalesce(avg(d) - 2 * sqrt(var_samp(d) / count(*)) > 0, false) AS separated FROM d")
def q_paired_delta(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("seed")).agg(F.avg("l_quantity").alias("value"))
    return stats.paired_delta(runs, "R", "N").select("n", *r6("delta", "half_width"), "separated")


@query("SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS removed, round(count(*) FILTER (quality = 0) / (SELECT count(*) FROM labels WHERE quality = 0), 6) AS share, round((count(*) FILTER (quality = 0) / (SELECT count(*) FROM labels WHERE quality = 0)) / (count(*) / (SELECT count(*) FROM labels)), 6) AS enrichment FROM documents JOIN labels USING (doc_id) GROUP BY source")
def q_removed_by_group(spark, sf_dir):
    e = views.document_episodes(spark, sf_dir).where("success is not null")
    return reports.removed_by_group(e.select("episode_index", F.col("success").alias("kept")), e.select("episode_index", "source"), "source").select("source", "n", "removed", *r6("share", "enrichment"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_kept, count(*) FILTER (quality = 0) AS n_removed, round(100.0 * count(*) FILTER (quality = 0) / count(*), 6) AS pct_removed FROM labels")
def q_quality_summary(spark, sf_dir):
    return reports.quality_summary(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("kept"))).select("n", "n_kept", "n_removed", *r6("pct_removed"))


_GREEDY = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
r AS (SELECT vec_id, v, row_number() OVER (ORDER BY v[1] DESC, lpad(vec_id::VARCHAR, 20, '0')) AS rank FROM v),
e AS (SELECT b.rank, list(a.rank) AS near FROM r a JOIN r b ON a.rank < b.rank AND list_distance(a.v, b.v) <= 1.1 GROUP BY b.rank),
w AS (SELECT r.vec_id, r.rank, coalesce(e.near, []) AS near FROM r LEFT JOIN e USING (rank)),
g AS (SELECT 1::BIGINT AS rank, [1::BIGINT] AS kept UNION ALL SELECT g.rank + 1, CASE WHEN list_has_any(g.kept, w.near) THEN g.kept ELSE list_append(g.kept, w.rank) END FROM g JOIN w ON w.rank = g.rank + 1)
"""


@query(_GREEDY + """SELECT w.vec_id AS episode_index, list_contains(f.kept, w.rank) AS kept FROM w, (SELECT kept FROM g ORDER BY rank DESC LIMIT 1) f""")
def q_greedy_dedup(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    keep = v.select("episode_index", F.lpad(F.col("episode_index").cast("string"), 20, "0").alias("fingerprint"), F.get("v", 0).alias("keep_score"))
    return curation.greedy_dedup(keep, v.select("episode_index", "v"), 1.1).select("episode_index", "kept")


@query(_GREEDY + """, f AS (SELECT kept FROM g ORDER BY rank DESC LIMIT 1), k AS (SELECT r.* FROM r, f WHERE list_contains(f.kept, r.rank)), x AS (SELECT r.* FROM r ANTI JOIN k USING (rank))
SELECT x.vec_id AS episode_index, k.vec_id AS representative, round(list_distance(x.v, k.v), 6) AS distance FROM x JOIN k ON true QUALIFY row_number() OVER (PARTITION BY x.rank ORDER BY list_distance(x.v, k.v), k.rank) = 1""")
def q_removed_representative(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    keep = v.select("episode_index", F.lpad(F.col("episode_index").cast("string"), 20, "0").alias("fingerprint"), F.get("v", 0).alias("keep_score"))
    walk = K.cut(curation.greedy_dedup(keep, v.select("episode_index", "v"), 1.1))
    found = curation.representatives(walk.where("not kept"), walk.where("kept"), v.select("episode_index", "v"))
    return found.select("episode_index", "representative", *r6("distance"))


@query("""WITH e AS (SELECT user_id AS ep, count(*) AS n FROM events GROUP BY user_id)
SELECT ep AS episode_index, CASE WHEN ep % 4 = 0 THEN 'quarantined: unreadable episode (EOFError: cut)' WHEN ep % 4 = 1 THEN 'on the drop list' ELSE 'kept' END AS reason, ep % 4 > 1 AS kept FROM e""")
def q_quarantine(spark, sf_dir):
    """A fourth of the episodes does not read, a fourth is on the drop list; the rest is kept."""
    frames = views.event_frames(spark, sf_dir)
    lost = frames.select("episode_index").distinct().where("episode_index % 4 = 0").withColumn("problem", F.lit("EOFError: cut"))
    listed = [r.episode_index for r in frames.select("episode_index").distinct().where("episode_index % 4 = 1").collect()]
    result = curator.run(frames.where("episode_index % 4 <> 0"), curator.CurationSpec(baseline=False, drop=listed), quarantined=lost)
    return result.decisions.select("episode_index", F.regexp_replace("reason", "^kept:.*", "kept").alias("reason"), "kept")


@query(None)
def q_coverage(spark, sf_dir):
    frames = views.line_frames(spark, sf_dir)
    result = curator.run(frames, curator.CurationSpec(budget=curation.Budget("fraction", 0.3), selection="coverage", baseline=False, state="state"))
    return result.decisions.select("episode_index", *r6("keep_score"), "kept")


@query(None)
def q_equal_n_baseline(spark, sf_dir):
    ids = [r.user_id for r in table(spark, sf_dir, "events").select("user_id").distinct().orderBy("user_id").collect()]
    return spark.createDataFrame([(i,) for i in curation.equal_n_baseline(ids, len(ids) // 2, 0)], "episode_index long")


@query(None)
def q_content_hash(spark, sf_dir):
    frames = views.event_frames(spark, sf_dir)
    return datasets.fingerprints(frames, ["action"])
