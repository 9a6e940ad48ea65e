"""Nested resampling: which subjects learn and validate in each repetition and sample size.

Draws are orders by a hash of subject, repetition, size and seed: the same rows give the same samples on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varistrata.functions.kernels import sample_sizes

SEED = 3791


def size_bounds(n_subjects: int, most_components: int, n_folds: int = 5, least: int | None = None, most: int | None = None, validation: float = 0.5) -> tuple[int, int]:
    """Least and most sample sizes: each training fold has as many subjects as components; half of all validate."""
    low = math.ceil(most_components / (1 - 1 / n_folds)) if least is None else least
    high = int((1 - validation) * n_subjects) if most is None else most
    if high > n_subjects:
        raise ValueError("the most subjects of a sample are more than there are")
    if low > high:
        raise ValueError("the least sample size is over the most")
    return low, high


def subset_sizes(sizes: Sequence[int], n_subset: int, validation: float = 0.5) -> list[int]:
    """Sizes of the whole cohort that a subset can have, so they are comparable between subsets."""
    return [s for s in sizes if s <= int((1 - validation) * n_subset)]


def sizes_of_subsets(subsets: DataFrame, sizes: Sequence[int], n: str = "n", validation: float = 0.5) -> DataFrame:
    """subsets (with the number of their subjects) and `sample_size`: a row for each of the sizes that subset_sizes gives."""
    cells = F.array(*[F.lit(int(s)) for s in sizes])
    return subsets.withColumn("sample_size", F.explode(F.filter(cells, lambda s: s <= ((1 - validation) * F.col(n)).cast("long"))))


def planned_sizes(n_subjects: int, n_sizes: int, most_components: int, **bounds) -> list[int]:
    return sample_sizes(*size_bounds(n_subjects, most_components, **bounds), n_sizes)


def _order(key: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), *[p.cast("string") for p in parts]))


def _hash_number(*parts: Column) -> Column:
    """A whole number from 0 to 2**48 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def _positions(df: DataFrame, keys: list[str], key: str) -> DataFrame:
    """df with `pos` from 1 in the order of `_o` (then key) within keys, and `_held`, how many rows those keys have.

    The first three digits of the hash part the rows into 4096 ranges; a range's rows are numbered by themselves
    and start where the ranges before end, so no repetition is sorted in one task.
    """
    ranged = df.withColumn("_range", F.substring("_o", 1, 3))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    starts = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_held": F.sum("_n").over(Window.partitionBy(*keys))}).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_o", key))
    numbered = ranged.withColumn("_row", within).alias("n")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_range")]  # a NULL stratum is one
    joined = numbered.join(starts.alias("s"), same).withColumn("pos", (F.col("_start") + F.col("_row")).cast("int"))
    return joined.select(*[F.col(f"n.{c}") for c in df.columns], "pos", "_held")


def ordered_places(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df with `pos` from 1 in the order of a hash of the key."""
    return _positions(df.withColumns({"_o": _order(key, F.lit(seed)), "_all": F.lit(0)}), ["_all"], key).drop("_o", "_all", "_held")


def split_in_out(subjects: DataFrame, n_reps: int, n_in: int, key: str = "eid", strata: str | None = None, seed: int | None = None) -> DataFrame:
    """rep, key, pos (from 1 in the order of the draw), is_in for every repetition and subject; the first n_in are in.

    strata: each group gives its share, by whole numbers and then the largest remainders.
    """
    reps = F.broadcast(subjects.sparkSession.range(n_reps).select(F.col("id").cast("int").alias("rep")))
    keep = [key] if strata is None else [key, strata]
    order = _order(key, F.col("rep")) if seed is None else _order(key, F.col("rep"), F.lit(seed))
    crossed = subjects.select(*keep).crossJoin(reps).withColumn("_o", order)
    if strata is None:
        return _positions(crossed, ["rep"], key).select("rep", key, "pos", (F.col("pos") <= n_in).alias("is_in"))
    quotas = _quotas(subjects.groupBy(F.col(strata).alias("_g")).agg(F.count("*").alias("_c")), F.lit(n_in), [])
    ranked = _positions(crossed, ["rep", strata], key).join(quotas, F.col(strata).eqNullSafe(F.col("_g")))
    return ranked.select("rep", key, "pos", (F.col("pos") <= F.col("_q")).alias("is_in"))


def _quotas(groups: DataFrame, n: Column, by: list[str]) -> DataFrame:
    """groups (by, _g, members _c) with `_q`: whole parts of n in proportion to the members; the largest remainders get one more. A row for each group goes through one window task of its `by`."""
    whole = Window.partitionBy(*by)
    exact = n * F.col("_c") / F.sum("_c").over(whole)
    based = groups.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    turn = F.row_number().over(whole.orderBy(F.desc(F.col("_exact") - F.col("_base")), F.col("_g").cast("string")))
    return based.withColumns({"_rest": n - F.sum("_base").over(whole), "_turn": turn}).withColumn("_q", (F.col("_base") + (F.col("_turn") <= F.col("_rest")).cast("int")).cast("int")).drop("_exact", "_base", "_rest", "_turn")


def stratified_quota(counts: dict, n: int) -> dict:
    """Whole parts of n in proportion to the counts; the largest remainders get one more."""
    total = sum(counts.values())
    exact = {g: n * c / total for g, c in counts.items()}
    out = {g: int(x) for g, x in exact.items()}
    for g in sorted(counts, key=lambda g: (out[g] - exact[g], str(g)))[: n - sum(out.values())]:
        out[g] += 1
    return out


def design(subjects: DataFrame, sizes: Sequence[int], n_reps: int, key: str = "eid", subset: str = "all", replace: bool = False, match_validation: bool = False, strata: str | None = None, seed: int = SEED, n_in: int | None = None, cut: bool = True) -> DataFrame:
    """subset, rep, sample_size, set_name, draw, key: the learning sample of each size within the largest, and the validation sample.

    Learning subjects come from the first n_in (half of all, or the largest size if that is more) of a repetition's
    order, validation subjects from the rest: all of them (sample_size null), or as many as the size. With replacement, a draw takes the subject at a hashed place, and
    `draw` tells repeated ones apart. strata: each group gives its share of the first n_in and of every draw.

    A draw without replacement or strata looks only at subjects whose hash is so low that the sample lies among them but
    for a chance of one in 10**20; it stops if that is ever not so (cut=False looks at all).
    """
    n = subjects.count()
    inside = max(n // 2, *sizes) if n_in is None else n_in
    places = split_in_out(subjects, n_reps, inside, key, strata, seed)
    spark = subjects.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(s),) for s in sizes], "sample_size int"))
    if strata is not None:
        places = places.join(subjects.select(key, F.col(strata).alias("_g")), key)

    def hashed(pool: DataFrame, name: str) -> DataFrame:
        return pool.drop("pos").crossJoin(wanted).withColumn("_o", _order(key, F.col("rep"), F.col("sample_size"), F.lit(f"{name}{seed}")))

    def draw(pool: DataFrame, name: str, held: int) -> DataFrame:
        if strata is not None:
            return stratified(pool, name)
        if not replace:
            crossed = hashed(pool, name)
            if cut:
                share = (F.col("sample_size") + 10 * F.sqrt("sample_size") + 50) / held
                crossed = crossed.where(F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") < share * float(1 << 32))
            ranked = _positions(crossed, ["rep", "sample_size"], key).withColumnRenamed("pos", "draw")
            if cut:
                short = (F.col("_held") < F.least(F.col("sample_size"), F.lit(held)))
                ranked = ranked.where(F.when(short, F.raise_error(F.lit("a sample lies beyond the cut: use cut=False"))).otherwise(F.lit(True)).cast("boolean"))
            return ranked.where("draw <= sample_size").select("rep", "sample_size", "draw", key)
        numbered = _positions(pool.drop("pos").withColumn("_o", _order(key, F.col("rep"), F.lit(f"{name}{seed}"))), ["rep"], key).withColumnRenamed("pos", "_at").drop("_o", "_held")
        most = numbered.groupBy("rep").agg(F.max("_at").alias("_held"))
        draws = most.crossJoin(wanted).select("rep", "sample_size", "_held", F.explode(F.sequence(F.lit(1), "sample_size")).alias("draw"))
        at = draws.withColumn("_at", (F.pmod(_hash_number(F.col("rep"), F.col("sample_size"), F.col("draw"), F.lit(seed), F.lit(name)), F.col("_held")) + 1).cast("int"))
        return at.join(numbered, ["rep", "_at"]).select("rep", "sample_size", "draw", key)

    def stratified(pool: DataFrame, name: str) -> DataFrame:
        """Each group's share of every size: whole numbers, then the largest remainders, as the pool of a repetition has the groups."""
        groups = pool.groupBy("rep", "_g").agg(F.count("*").alias("_c")).crossJoin(wanted)
        quotas = _quotas(groups, F.col("sample_size"), ["rep", "sample_size"]).select("rep", "sample_size", F.col("_g").alias("_group"), "_q", F.col("_c").alias("_members"))
        if replace:
            numbered = _positions(pool.drop("pos").withColumn("_o", _order(key, F.col("rep"), F.lit(f"{name}{seed}"))), ["rep", "_g"], key).select("rep", F.col("_g").alias("_group"), F.col("pos").alias("_at"), key)
            draws = quotas.where("_q > 0").select("*", F.explode(F.sequence(F.lit(1), "_q")).alias("_k"))
            at = draws.withColumn("_at", (F.pmod(_hash_number(F.col("rep"), F.col("sample_size"), F.coalesce(F.col("_group").cast("string"), F.lit("")), F.col("_k"), F.lit(seed), F.lit(name)), F.col("_members")) + 1).cast("int"))
            chosen = at.alias("a").join(numbered.alias("n"), (F.col("a.rep") == F.col("n.rep")) & F.col("a._group").eqNullSafe(F.col("n._group")) & (F.col("a._at") == F.col("n._at"))).select("a.rep", "sample_size", "_k", "a._group", key)
            by = Window.partitionBy("rep", "sample_size").orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("_k").cast("string"))), "_k", key)
            return chosen.withColumn("draw", F.row_number().over(by)).select("rep", "sample_size", "draw", key)
        ranked = _positions(hashed(pool, name), ["rep", "sample_size", "_g"], key).withColumnRenamed("pos", "_at").alias("r")
        chosen = ranked.join(quotas.alias("q"), (F.col("r.rep") == F.col("q.rep")) & (F.col("r.sample_size") == F.col("q.sample_size")) & F.col("r._g").eqNullSafe(F.col("q._group"))).where("_at <= _q")
        own = _positions(chosen.select("r.rep", "r.sample_size", "r._o", f"r.{key}"), ["rep", "sample_size"], key)
        return own.select("rep", "sample_size", F.col("pos").alias("draw"), key)

    kept, outside = places.where("is_in"), places.where("not is_in")
    learn = draw(kept, "learn", inside).withColumn("set_name", F.lit("learn"))
    if match_validation:
        held_out = draw(outside, "val", n - inside).withColumn("set_name", F.lit("val"))
    else:
        held_out = outside.select("rep", F.lit(None).cast("int").alias("sample_size"), F.col("pos").alias("draw"), key).withColumn("set_name", F.lit("val"))
    return learn.unionByName(held_out).select(F.lit(subset).alias("subset"), "rep", "sample_size", "set_name", "draw", key)


#: Draws that one row of the plan stands for before they are made one by one.
CHUNK = 1 << 16


def _permuted(place: Column, n: Column, *key: Column) -> Column:
    """Places under keyed permutations, by arithmetic on batches."""
    from varistrata.functions import permutation

    @F.pandas_udf("long")
    def turn(place, n, *key):
        import pandas as pd

        return pd.Series(permutation.permuted(place.to_numpy(), n.to_numpy(), *[k.to_numpy() for k in key]))

    return turn(place, n, *key)


#: Told apart in the keys of permutations: the places of a repetition, and the draws of learning and validation samples.
_PLACES, _LEARN, _VAL = 0, 1, 2


def keyed_design(subjects: DataFrame, sizes: Sequence[int], n_reps: int, key: str = "eid", subset: str = "all", replace: bool = False, match_validation: bool = False, seed: int = SEED, n_in: int | None = None) -> DataFrame:
    """The rows of `design`, made draw by draw: a sample of s subjects is s rows, whatever the cohort's size, and no subject is hashed for a draw it is not in.

    Subjects are numbered once, in the order of a hash. A keyed permutation for each repetition puts them into places, of
    which the first n_in are the learning pool; another one for each repetition and size orders a pool, so
    draw d is the subject at a place that is worked out from d alone. With replacement the place is a hash of d.
    Keys must be distinct; a null key is a subject like any other.
    """
    n = subjects.count()
    inside = max(n // 2, *sizes) if n_in is None else n_in
    if inside > n or (match_validation and not replace and max(sizes) > n - inside):
        raise ValueError("a sample has more subjects than there are to draw from")
    spark = subjects.sparkSession
    pools = [("learn", 0, inside, _LEARN), *([("val", inside, n - inside, _VAL)] if match_validation else [])]
    rows = [(r, s, name, start, s, pool, turn) for r in range(n_reps) for s in sizes for name, start, pool, turn in pools]
    rows += [] if match_validation else [(r, None, "val", inside, n - inside, n - inside, _VAL) for r in range(n_reps)]
    plan = spark.createDataFrame(rows, "rep int, sample_size int, set_name string, _start long, _take long, _pool long, _turn long").where("_take > 0")
    chunks = plan.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_take - 1) div {CHUNK})"))).repartition("rep", "sample_size", "set_name", "_chunk")
    draws = chunks.withColumn("_d", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least((_chunk + 1) * {CHUNK}, _take) - 1)")))
    s, rep, size = F.lit(seed).cast("long"), F.col("rep").cast("long"), F.coalesce(F.col("sample_size"), F.lit(0)).cast("long")
    if replace:
        from varistrata.functions import permutation

        @F.pandas_udf("long")
        def hashed(pool, *key):
            import pandas as pd

            return pd.Series(permutation.keyed(*[k.to_numpy() for k in key]) % pool.to_numpy())

        spot = F.when(F.col("sample_size").isNull(), F.col("_d")).otherwise(hashed(F.col("_pool"), s, F.col("_turn"), rep, size, F.col("_d")))
    else:
        spot = F.when(F.col("sample_size").isNull(), F.col("_d")).otherwise(_permuted(F.col("_d"), F.col("_pool"), s, F.col("_turn"), rep, size))
    at = draws.withColumn("_index", _permuted(F.col("_start") + spot, F.lit(n).cast("long"), s, F.lit(_PLACES).cast("long"), rep))
    numbered = ordered_places(subjects.select(key), key, f"keyed{seed}").select(key, (F.col("pos") - 1).cast("long").alias("_index"))
    # As many draws as all samples have rows: no side is broadcast, whatever its compressed size.
    return at.join(numbered.hint("merge"), "_index").select(F.lit(subset).alias("subset"), "rep", "sample_size", "set_name", (F.col("_d") + 1).cast("int").alias("draw"), key)


def age_group(column: str, width: int = 5) -> Column:
    return F.floor(F.col(column) / width).cast("int")
