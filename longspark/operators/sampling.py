"""Entity splits and sampled budgets from hash draws.

Exact sizes need exact ranks. A rank is counted inside equal slices of the draw and the slices
are added up, so no task ever orders the whole pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.functions.draws import draw, draw_slice
from longspark.operators.scan import MAX_ROWS, Run, add_chunks, running

SLICES = 256
# Largest sample taken by a top-n sort; larger ones are cut by rank.
TOP_N_LIMIT = 10_000


def ranked(
    df: DataFrame, by: list[str], entity: str, seed: Column | int, stream: str, *, slices: int = SLICES
) -> DataFrame:
    """Add ``rank`` (1-based, random order of the seed) and ``pool_size`` inside ``by``."""
    keyed = df.withColumn("_draw", draw(seed, stream, F.col(entity))).withColumn(
        "_slice", draw_slice(F.col("_draw"), slices)
    )
    runs = {"rank": Run("count"), "_after": Run("count", inclusive=False, reverse=True)}
    out = running(keyed, by, ["_draw", entity], runs, chunk="_slice")
    return out.withColumn("pool_size", F.col("rank") + F.col("_after")).drop(
        "_draw", "_slice", "_after"
    )


def _refused(rows: DataFrame, problem: DataFrame) -> DataFrame:
    """``rows``, or an error when it runs: ``problem`` is one row with ``problem``, null if all is well."""
    fails = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True))
    return rows.join(F.broadcast(problem)).where(fails).drop("problem")


def _repeats(entities: DataFrame, key: list[str]) -> DataFrame:
    """One row whose ``problem`` says how many keys are given more than once, null for none."""
    twice = entities.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(F.col("n").cast("string"), F.lit(" entities are repeated"))
    return twice.select(F.when(F.col("n") > 0, message).alias("problem"))


def cut_size(n: Column, fraction: float) -> Column:
    return F.floor(n.cast("double") * F.lit(fraction)).cast("bigint")


def split_entities(
    entities: DataFrame,
    *,
    entity: str = "patient_id",
    by: tuple[str, ...] = (),
    seed: int = 0,
    train_fraction: float = 0.7,
    val_fraction: float = 0.1,
) -> DataFrame:
    """Disjoint ``train``, ``val`` and ``test`` entities with exact sizes ``int(n * f)``.

    A repeated entity could fall into two parts: it is an error.
    """
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must be between 0 and 1")
    if not 0 <= val_fraction < 1 or train_fraction + val_fraction >= 1:
        raise ValueError("val_fraction must leave a non-empty test part")
    out = ranked(entities, list(by), entity, seed, "split")
    train = cut_size(F.col("pool_size"), train_fraction)
    val = train + cut_size(F.col("pool_size"), val_fraction)
    part = (
        F.when(F.col("rank") <= train, "train").when(F.col("rank") <= val, "val").otherwise("test")
    )
    out = out.withColumn("split", part).drop("rank", "pool_size")
    return _refused(out, _repeats(entities, [*by, entity]))


def sample_entities(
    pool: DataFrame, n: int, seed: int, *, entity: str = "patient_id", stream: str = "sample"
) -> DataFrame:
    """``n`` entities without replacement; a pool that has fewer is an error."""
    if n <= 0:
        raise ValueError("n must be positive")
    size = pool.agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(F.lit(f"{n} wanted from a pool of "), F.col("n").cast("string"))
    short = size.select(F.when(F.col("n") < n, message).alias("problem"))
    if n <= TOP_N_LIMIT:
        keyed = pool.withColumn("_draw", draw(seed, stream, F.col(entity)))
        return _refused(keyed.orderBy("_draw", entity).limit(n).drop("_draw"), short)
    out = ranked(pool, [], entity, seed, stream)
    return _refused(out.where(F.col("rank") <= n).drop("rank", "pool_size"), short)


def validation_count(n: Column, fraction: float) -> Column:
    """Half-even rounding of ``n * fraction``, at least 1 and at most ``n - 1``."""
    rounded = F.bround(n.cast("double") * F.lit(fraction)).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.least(n.cast("bigint") - 1, rounded))


def budgets(
    pool: DataFrame,
    sizes: list[int],
    seeds: list[int],
    *,
    entity: str = "patient_id",
    by: tuple[str, ...] = (),
    validation_fraction: float = 0.2,
) -> DataFrame:
    """For every seed and size: that many entities, split into ``fit`` and ``validation``.

    Where a pool is smaller than a size, one row per seed and size says so: no entity, role ``shortfall``.
    """
    if min(sizes) < 2:
        raise ValueError("a budget holds at least two entities")
    if not 0 < validation_fraction < 1:
        raise ValueError("validation_fraction must be between 0 and 1")
    seeded = pool.withColumn("subset_seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
    chosen = ranked(seeded, [*by, "subset_seed"], entity, F.col("subset_seed"), "sample").where(
        F.col("rank") <= max(sizes)
    )
    fitting = F.filter(
        F.array(*[F.lit(s).cast("bigint") for s in sorted(sizes)]), lambda n: F.col("rank") <= n
    )
    members = chosen.withColumn("n_train", F.explode(fitting)).where(
        F.col("pool_size") >= F.col("n_train")
    )
    members = members.drop("rank", "pool_size")
    again = ranked(
        members, [*by, "subset_seed", "n_train"], entity, F.col("subset_seed") + 1, "validation"
    )
    role = F.when(
        F.col("rank") <= validation_count(F.col("n_train"), validation_fraction), "validation"
    ).otherwise("fit")
    out = again.withColumn("role", role).drop("rank", "pool_size")
    return out.unionByName(_shortfalls(pool, sizes, seeds, by), allowMissingColumns=True)


def _shortfalls(pool: DataFrame, sizes: list[int], seeds: list[int], by: tuple[str, ...]) -> DataFrame:
    counts = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    numbers = lambda values: F.explode(F.array(*[F.lit(v).cast("bigint") for v in sorted(values)]))
    rows = counts.withColumn("n_train", numbers(sizes)).where("_n < n_train")
    return rows.withColumn("subset_seed", numbers(seeds)).withColumn("role", F.lit("shortfall")).drop("_n")


def fit_val_budget(
    pool: DataFrame,
    n: int,
    seed: int,
    *,
    entity: str = "patient_id",
    validation_fraction: float = 0.2,
) -> DataFrame:
    out = budgets(pool, [n], [seed], entity=entity, validation_fraction=validation_fraction)
    return out.drop("subset_seed", "n_train")


def site_split(
    entities: DataFrame,
    *,
    train_site: object = 0,
    site: str = "site",
    entity: str = "patient_id",
    seed: int = 0,
    train_fraction: float = 0.8,
    sites: list | None = None,
) -> DataFrame:
    """Development and test part of the training site; every other site is all test.

    An entity may stand once, at one site: a repeated one could be on both sides and is an error. So is a training site
    that has no development or no test entity, and a site of ``sites`` without any entity.
    """
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must be between 0 and 1")
    out = ranked(entities, [site], entity, seed, "split")
    here = F.col(site) == F.lit(train_site)
    develop = F.coalesce(here & (F.col("rank") <= cut_size(F.col("pool_size"), train_fraction)), F.lit(False))
    out = out.withColumn("role", F.when(develop, "development").otherwise("test")).drop("rank", "pool_size")
    sizes = entities.agg(F.count_if(here).alias("n"))
    short = (cut_size(F.col("n"), train_fraction) < 1) | (cut_size(F.col("n"), train_fraction) >= F.col("n"))
    message = F.concat(F.lit(f"site {train_site} cannot be split: it has "), F.col("n").cast("string"), F.lit(" entities"))
    problems = [_repeats(entities, [entity]), sizes.select(F.when(short, message).alias("problem"))]
    if sites:
        empty = missing_sites(entities, sites, site=site).agg(F.array_sort(F.collect_list(F.col(site).cast("string"))).alias("_s"))
        said = F.concat(F.lit("no entity at site "), F.array_join("_s", ", "))
        problems.append(empty.select(F.when(F.size("_s") > 0, said).alias("problem")))
    every = problems[0]
    for p in problems[1:]:
        every = every.unionByName(p)
    return _refused(out, every.agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problem")).select(
        F.when(F.col("problem") != "", F.col("problem")).alias("problem")
    ))


def missing_sites(entities: DataFrame, sites: list, *, site: str = "site") -> DataFrame:
    """Sites of the plan without a single entity."""
    wanted = entities.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sites))).alias(site))
    return wanted.join(entities.select(site), site, "left_anti")


def nearest_match(
    targets: DataFrame,
    candidates: DataFrame,
    value: str,
    *,
    by: list[str],
    target_id: str,
    candidate_id: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Per target the candidate of least absolute mismatch; the smaller one on a tie.

    Both sides walk one ordered stream per group, so no target meets every candidate.
    """
    offers = candidates.groupBy(*by, F.col(value).alias("_v")).agg(F.min(candidate_id).alias("_cid"))
    stream = targets.select(
        *by, F.col(value).alias("_v"), F.col(target_id).alias("_tid"), F.lit(1).alias("_kind")
    ).unionByName(
        offers.select(*by, "_v", "_cid", F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    cut, chunk = add_chunks(stream, by, "_v", ties=("_kind", "_tid"), max_rows=max_rows)
    offer = F.when(F.col("_kind") == 0, F.struct(F.col("_v").alias("v"), F.col("_cid").alias("id")))
    runs = {"_low": Run("last", offer, False, False), "_high": Run("last", offer, False, True)}
    out = running(cut, by, ["_v", "_kind", "_tid"], runs, chunk=chunk).where(F.col("_kind") == 1)
    low, high = F.col("_low"), F.col("_high")
    take_low = low.isNotNull() & (
        high.isNull() | (F.col("_v") - low["v"] <= high["v"] - F.col("_v"))
    )
    best = F.when(take_low, low).otherwise(high)
    return out.select(
        *by,
        F.col("_tid").alias(target_id),
        F.col("_v").alias("target_value"),
        best["id"].alias(candidate_id),
        best["v"].alias("candidate_value"),
        F.abs(best["v"] - F.col("_v")).alias("mismatch"),
        F.try_divide(F.abs(best["v"] - F.col("_v")), F.abs(F.col("_v"))).alias("relative_mismatch"),
    )
