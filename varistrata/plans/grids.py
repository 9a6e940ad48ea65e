"""Queries of keyed samples and of the experiment grid on fold moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from varistrata.functions import permutation
from varistrata.operators import experiment, folds, results, sampling
from varistrata.plans import adapters as A
from varistrata.plans.registry import query

SEED = sampling.SEED


def _at(place: str, n: str, *key: str) -> str:
    return permutation.sql(place, n, str(SEED), *key)


def design_sql(people: str, reps: int) -> str:
    """CTEs `numbered` (eid, i from 0, n) of the subjects of a query, and `design` (rep, s, set_name, draw, eid) of samples without replacement; needs `sizes` (s)."""
    return f"""numbered AS (SELECT eid, row_number() OVER (ORDER BY md5(concat_ws('-', CAST(eid AS VARCHAR), 'keyed{SEED}')), eid) - 1 AS i, count(*) OVER () AS n FROM ({people})),
total AS (SELECT DISTINCT n, n // 2 AS h FROM numbered), turns AS (SELECT unnest(range({reps})) AS rep),
spots AS (SELECT rep, s, 'learn' AS set_name, d, {_at('d', 'h', str(sampling._LEARN), 'rep', 's')} AS p, n FROM (SELECT rep, s, h, n, unnest(range(s)) AS d FROM sizes, turns, total)
 UNION ALL SELECT rep, NULL, 'val', d, h + d, n FROM (SELECT rep, h, n, unnest(range(n - h)) AS d FROM turns, total)),
design AS (SELECT rep, s, set_name, CAST(d + 1 AS BIGINT) AS draw, eid FROM (SELECT rep, s, set_name, d, {_at('p', 'n', str(sampling._PLACES), 'rep')} AS i FROM spots) JOIN numbered USING (i))"""


@query(f"""WITH {A.SIZES}, {design_sql('SELECT c_custkey AS eid FROM customer', 3)},
pools AS (SELECT 'learn' AS set_name, 0 AS start, h AS pool, {sampling._LEARN} AS turn, n FROM total UNION ALL SELECT 'val', h, n - h, {sampling._VAL}, n FROM total),
again AS (SELECT *, start + {permutation.sql_keyed(str(SEED), 'turn', 'rep', 's', 'd')} % pool AS p FROM (SELECT rep, s, set_name, start, pool, turn, n, unnest(range(s)) AS d FROM sizes, turns, pools))
SELECT 'once' AS subset, CAST(rep AS BIGINT) AS rep, CAST(s AS BIGINT) AS sample_size, set_name, draw, eid FROM design
UNION ALL SELECT 'again', CAST(rep AS BIGINT), CAST(s AS BIGINT), set_name, CAST(d + 1 AS BIGINT), eid FROM (SELECT rep, s, set_name, d, {_at('p', 'n', str(sampling._PLACES), 'rep')} AS i FROM again) JOIN numbered USING (i)""")
def keyed_design(spark, sf_dir):
    """Nested samples by keyed permutations: without replacement and with all others validating, and with replacement and as many validating."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"))
    sizes = sampling.planned_sizes(c.count(), 6, 4)
    out = sampling.keyed_design(c, sizes, 3, subset="once").unionByName(sampling.keyed_design(c, sizes, 3, subset="again", replace=True, match_validation=True))
    return out.select("subset", "set_name", "eid", *[F.col(c).cast("long").alias(c) for c in ("rep", "sample_size", "draw")])


REPS, CV_REPS, N_FOLDS = 2, 2, 5
_KEY = [str(k) for k in folds.unit_key(experiment.Settings(), "all", 0, 0)[:2]]


@query(f"""WITH {A.VIEWS}, m AS (SELECT eid, a2 AS a, b2 AS b, c0 AS c FROM views), k AS (SELECT count(*) AS n FROM m), sizes AS (SELECT n // 6 AS s FROM k UNION ALL SELECT n // 3 FROM k),
{design_sql('SELECT eid FROM m', REPS)},
learn AS (SELECT rep, s, draw, a, b, c FROM design JOIN m USING (eid) WHERE set_name = 'learn'),
val AS (SELECT rep, a, b, c FROM design JOIN m USING (eid) WHERE set_name = 'val'),
cut AS (SELECT *, {permutation.sql('draw - 1', 's', *_KEY, 'rep', 's', 't + 1')} * {N_FOLDS} // s AS fold FROM learn, (SELECT unnest(range({CV_REPS})) AS t)),
fit AS (SELECT rep, s, -1 AS t, -1 AS f, a, b, c FROM learn UNION ALL SELECT rep, s, t, f, a, b, c FROM cut, (SELECT unnest(range({N_FOLDS})) AS f) WHERE fold <> f),
st AS (SELECT rep, s, t, f, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM fit GROUP BY ALL),
w AS (SELECT rep, s, t, f, sum(coalesce((a - ma) / sa, 0) * (c - mc) / sc) / sum(power((c - mc) / sc, 2)) AS wa, sum((b - mb) / sb * (c - mc) / sc) / sum(power((c - mc) / sc, 2)) AS wb FROM fit JOIN st USING (rep, s, t, f) GROUP BY ALL),
model AS (SELECT * FROM st JOIN w USING (rep, s, t, f)),
d AS (SELECT rep, s, t, f, coalesce((a - ma) / sa, 0) - wa * (c - mc) / sc AS x, (b - mb) / sb - wb * (c - mc) / sc AS y FROM fit JOIN model USING (rep, s, t, f)),
r AS (SELECT rep, s, t, f, corr(x, y) AS r, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM d GROUP BY ALL),
own AS (SELECT rep, s, 'learn' AS set_name, 0 AS t0, draw AS id, NULL AS fold, a, b, c FROM learn UNION ALL SELECT v.rep, sizes.s, 'val', 0, row_number() OVER (), NULL, a, b, c FROM val v, sizes),
seen AS (SELECT o.rep, o.s, o.set_name, o.id, m.t, m.f, coalesce((a - ma) / sa, 0) - wa * (c - mc) / sc AS x, (b - mb) / sb - wb * (c - mc) / sc AS y FROM own o JOIN model m ON o.rep = m.rep AND o.s = m.s),
tested AS (SELECT u.rep, u.s, u.fold AS f, coalesce((a - ma) / sa, 0) - wa * (c - mc) / sc AS x, (b - mb) / sb - wb * (c - mc) / sc AS y FROM cut u JOIN model m ON u.rep = m.rep AND u.s = m.s AND u.fold = m.f AND u.t = 0 AND m.t = 0),
ens AS (SELECT rep, s, set_name, id, avg(x / sx) AS x, avg(y / sy) AS y FROM seen JOIN r USING (rep, s, t, f) WHERE t >= 0 GROUP BY ALL),
told AS (SELECT rep, s, 'without_cv' AS cca_type, set_name, NULL AS fold, sign(any_value(r.r)) * corr(x, y) AS corr FROM seen JOIN r USING (rep, s, t, f) WHERE t = -1 GROUP BY rep, s, set_name
 UNION ALL SELECT rep, s, 'repeated_cv', set_name, NULL, sign(any_value(r.r)) * corr(x, y) FROM ens JOIN r USING (rep, s) WHERE r.t = -1 GROUP BY rep, s, set_name
 UNION ALL SELECT rep, s, 'cv', 'learn', f, abs(r) FROM r WHERE t = 0
 UNION ALL SELECT rep, s, 'cv', 'val', f, sign(any_value(r.r)) * corr(x, y) FROM tested JOIN r USING (rep, s, f) WHERE r.t = 0 GROUP BY rep, s, f)
SELECT CAST(rep AS BIGINT) AS rep, CAST(s AS BIGINT) AS sample_size, cca_type, set_name, CAST(fold AS BIGINT) AS fold, round(corr, 6) AS corr FROM told""")
def grid_one_column_views(spark, sf_dir):
    """The whole grid with one column a view (one has missing values) and a confound, where canonical correlation has a closed form: on all learning rows, on each fold, and as an ensemble of models."""
    v = A.customer_views(spark, sf_dir, "a2", "b2", "c0")
    n = v.count()
    design = sampling.keyed_design(v.select("eid"), [n // 6, n // 3], REPS)
    settings = experiment.Settings(n_pcs=(1, 1), n_folds=N_FOLDS, cv_reps=CV_REPS, cca_types=("without_cv", "repeated_cv", "cv"), missing=1.0, frequency=1.0)
    out = folds.run_linear_grid(v, {"a": ["a2"], "b": ["b2"]}, design, settings, ["c0"], numeric=[]).where("metric = 'corr'")
    return out.select("cca_type", "set_name", F.col("rep").cast("long").alias("rep"), F.col("sample_size").cast("long").alias("sample_size"), F.col("pos").cast("long").alias("fold"), A.r6(F.col("value")).alias("corr"))


def _embedded(spark, sf_dir, null_model: bool, reps: int, **settings):
    """Embeddings as two views of 32 columns with labels as confounds: 20 components and 20 repetitions of cross-validation."""
    v = A.halves(spark, sf_dir).select("*", *[F.when(F.col("label") == k, 1.0).otherwise(0.0).alias(f"c{k}") for k in range(3)])
    n = v.count()
    design = sampling.keyed_design(v.select("eid"), sampling.planned_sizes(n, 3, 20), reps)
    names = {"behavioural": A.EMBEDDED[:32], "brain": A.EMBEDDED[32:]}
    return folds.run_linear_grid(v, names, design, experiment.Settings(**settings), ["c0", "c1", "c2"], numeric=[], null_model=null_model)


@query()
def moments_cross_validation(spark, sf_dir):
    """Ensembles of 100 models and the models of one split into folds, at 20 components."""
    return _embedded(spark, sf_dir, False, 3, cca_types=("without_cv", "repeated_cv", "cv"))


@query()
def moments_null_band(spark, sf_dir):
    """The 2.5 % and 97.5 % of the validation correlations of 100 repetitions on dealt rows, at 20 components."""
    out = _embedded(spark, sf_dir, True, 100, cca_types=("without_cv",), cv_reps=0)
    return results.null_quantiles(out.where("metric = 'corr' and set_name = 'val'"), ["subset", "sample_size", "cca_type", "component"], "value", skip_missing=False)


#: Columns of the wide table, some with their values cut down to few kinds so that one of them dominates.
CUT = {c: (f"floor(\"{c}\" / 40)" if i % 3 == 0 else f'"{c}"') for i, c in enumerate(A.COLUMNS[:12])}


@query(f"""WITH {A.WIDE}, m AS (SELECT eid, {', '.join(f'{x} AS "{c}"' for c, x in CUT.items())} FROM wide), k AS (SELECT count(*) AS n FROM m), sizes AS (SELECT n // 8 AS s FROM k UNION ALL SELECT n // 3 FROM k),
{design_sql('SELECT eid FROM m', 3)},
l AS (SELECT rep, s, col, x FROM design JOIN m USING (eid), LATERAL (SELECT unnest([{', '.join(f"'{c}'" for c in CUT)}]) AS col, unnest([{', '.join(f'"{c}"' for c in CUT)}]) AS x) WHERE set_name = 'learn'),
v AS (SELECT rep, s, col, x, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT rep, s, col, sum(n) AS total, coalesce(sum(CASE WHEN x IS NOT NULL THEN n END), 0) AS present, max(CASE WHEN x IS NOT NULL THEN n END) AS most FROM v GROUP BY ALL)
SELECT CAST(rep AS BIGINT) AS rep, CAST(s AS BIGINT) AS sample_size, col, CAST(total AS BIGINT) AS n, CAST(present AS BIGINT) AS present, CAST(CASE WHEN 2 * most > present THEN most ELSE 0 END AS BIGINT) AS most,
 coalesce(present > 0 AND 1 - present / total < 0.95 AND most / present < 0.8, false) AS kept FROM t""")
def sample_features(spark, sf_dir):
    """Which columns each of several learning samples keeps: those with few missing values and no dominant one in the sample's own rows."""
    w = A.wide(spark, sf_dir).select("eid", *[(F.floor(F.col(f"`{c}`") / 40) if "floor" in x else F.col(f"`{c}`")).alias(c) for c, x in CUT.items()])
    n = w.count()
    design = sampling.keyed_design(w.select("eid"), [n // 8, n // 3], 3)
    out = folds.selected_columns(w, {"all": list(CUT)}, design, experiment.Settings(missing=0.95))
    return out.select(F.col("rep").cast("long").alias("rep"), F.col("sample_size").cast("long").alias("sample_size"), F.col("feature").alias("col"), F.col("rows").alias("n"), "present", F.col("most").cast("long").alias("most"), "kept")
