"""Deterministic splits, quotas, mixes and top-k, all ordered by stable hashes and a stated sequence column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.columns import sha1_bucket
from evidentia.operators.ordered import join_same, row_numbers


def _rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def hash_split(df: DataFrame, key: Column, percent: int, *, digits: int = 8, names=("val", "train"), override: Column | None = None, name: str = "split") -> DataFrame:
    """Rows whose key's bucket is below `percent` get the first name; where `override` is not NULL it counts instead."""
    drawn = F.when(sha1_bucket(key, digits) < percent, names[0]).otherwise(names[1])
    return df.withColumn(name, drawn if override is None else F.coalesce(override, drawn))


def propagate_split(df: DataFrame, entity: str, is_eval: Column, name: str = "split", names=("val", "train")) -> DataFrame:
    """All rows of an entity go to evaluation if any of them does."""
    held = df.groupBy(entity).agg(F.max(is_eval.cast("int")).alias("__any"))
    return join_same(df, held, [entity]).withColumn(name, F.when(F.col("__any") == 1, names[0]).otherwise(names[1])).drop("__any")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; a group is reduced in parts before its rows meet."""
    return _rank(df, keys, order, "__top").where(F.col("__top") <= n).drop("__top")


def cyclic_take(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, most: int | None = None) -> DataFrame:
    """n rows of each group in order, going round again where the group has fewer; adds `cycle`.

    A group is first cut to its n rows (`most`, where n is a column), in parts before its rows meet, and counted then."""
    first = top_n(df, keys, order, most if most is not None else n) if most is not None or isinstance(n, int) else df
    n = F.lit(n) if isinstance(n, int) else n
    w = Window.partitionBy(*keys)
    ranked = _rank(first, keys, order, "__rn").where(F.col("__rn") <= n).withColumn("__m", F.count("*").over(w))
    last = F.floor((n - F.col("__rn")) / F.col("__m")).cast("int")
    return ranked.withColumn("cycle", F.explode(F.sequence(F.lit(0), last))).drop("__rn", "__m")


def capped(df: DataFrame, budgets: DataFrame, key: str, order: Sequence[Column], budget: str = "budget") -> DataFrame:
    """Keeps a class whole where it has no budget (NULL or not listed) and else its first `budget` rows.

    `budgets` is a small table of the caller with one row per class.
    """
    listed = df.join(budgets, key, "left")
    free = listed.where(F.col(budget).isNull())
    bound = row_numbers(listed.where(F.col(budget) > 0), [key], order, "__rn").where(F.col("__rn") <= F.col(budget)).drop("__rn")
    return free.unionByName(bound).drop(budget)


def balanced(df: DataFrame, keys: Sequence[str], positive: Column, order: Sequence[Column], ratio: float = 1.0) -> DataFrame:
    """Positives and negatives of each group at most 1 to `ratio`; with ratio 1 as many of either as the scarcer has.

    A row whose condition is NULL is neither and is left out."""
    marked = df.withColumn("__pos", positive.cast("int")).where("__pos IS NOT NULL")
    counts = marked.groupBy(*keys).agg(F.sum("__pos").alias("__p"), F.sum(1 - F.col("__pos")).alias("__n"))
    ranked = join_same(row_numbers(marked, [*keys, "__pos"], order, "__rn"), counts, keys)
    take_pos = F.least("__p", F.floor(F.col("__n") / ratio)) if ratio == 1 else F.col("__p")
    take_neg = F.least(F.col("__n"), F.floor(take_pos * ratio))
    return ranked.where(F.col("__rn") <= F.when(F.col("__pos") == 1, take_pos).otherwise(take_neg)).drop("__pos", "__p", "__n", "__rn")


def tier_mix(df: DataFrame, keys: Sequence[str], tier: str, shares: Sequence[tuple[str, float]], order: Sequence[Column], target: int) -> DataFrame:
    """`target` rows of each group: each tier's share first (rounded half to even), then what is left by tier order.

    Adds `phase`, 0 inside a tier's quota and 1 for rows that fill up; goes round again only where a group is exhausted.
    """
    quota, place = F.lit(0), F.lit(len(shares))
    for i, (name, share) in enumerate(shares):
        quota = F.when(F.col(tier) == name, int(round(target * share))).otherwise(quota)
        place = F.when(F.col(tier) == name, i).otherwise(place)
    ranked = _rank(df, [*keys, tier], order, "__rn").where(F.col("__rn") <= target).withColumn("__place", place)
    ranked = ranked.withColumn("phase", F.when(F.col("__rn") <= quota, 0).otherwise(1))
    return cyclic_take(ranked, keys, [F.col("phase"), F.col("__place"), F.col("__rn"), *order], target).drop("__rn", "__place")


def even_budgets(classes: Sequence[str], n: int) -> list[tuple[str, int]]:
    """n split evenly; the first classes get one more where it does not divide."""
    base, more = divmod(n, len(classes))
    return [(c, base + (i < more)) for i, c in enumerate(classes)]


def share_budgets(shares: Sequence[tuple[str, float]], n: int) -> list[tuple[str, int]]:
    """Budgets by share, rounded half to even; the last class gets the rest."""
    parts = [(c, int(round(n * s))) for c, s in shares[:-1]]
    return [*parts, (shares[-1][0], n - sum(p for _, p in parts))]


def take_budgets(df: DataFrame, key: str, budgets: Sequence[tuple[str, int]], order: Sequence[Column], cyclic: bool = True) -> DataFrame:
    """Each class's budget of rows; listed classes only."""
    n = F.lit(0)
    for name, size in budgets:
        n = F.when(F.col(key) == name, size).otherwise(n)
    chosen = df.where(F.col(key).isin(*[b[0] for b in budgets]))
    most = max((b[1] for b in budgets), default=0)
    if cyclic:
        return cyclic_take(chosen, [key], order, n, most)
    return _rank(chosen, [key], order, "__rn").where(F.col("__rn") <= most).where(F.col("__rn") <= n).drop("__rn")


def require_quota(df: DataFrame, key: str, quotas: Sequence[tuple[str, int]]) -> DataFrame:
    """The rows, or an error that names a class with fewer rows than its quota."""
    have = {r[0]: r[1] for r in df.where(F.col(key).isin(*[q[0] for q in quotas])).groupBy(key).count().collect()}
    short = [(c, n, have.get(c, 0)) for c, n in quotas if have.get(c, 0) < n]
    if short:
        raise ValueError("too few rows: " + ", ".join(f"{c} has {h} of {n}" for c, n, h in short))
    return df


def shortage_report(df: DataFrame, key: str, per_class: int) -> DataFrame:
    counted = df.groupBy(key).agg(F.count("*").alias("available"))
    return counted.withColumn("taken", F.least("available", F.lit(per_class))).withColumn("short", F.greatest(F.lit(0), per_class - F.col("available")))


def round_robin_views(df: DataFrame, entity: str, order: Sequence[Column], max_views: int, quota: int) -> DataFrame:
    """Passes over a priority list, each entity at most `max_views` times, until the quota is met; adds pass, view_index
    (the view's place for its entity) and entity_views (how often the entity was used)."""
    w = Window.partitionBy(entity)
    rows = _rank(df, [entity], order, "__j").where(F.col("__j") <= max_views).withColumn("__k", F.count("*").over(w))
    last = F.floor((max_views - F.col("__j")) / F.col("__k")).cast("int")
    views = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    views = views.withColumn("view_index", (F.col("pass") * F.col("__k") + F.col("__j")).cast("bigint"))
    taken = views.orderBy("pass", *order).limit(quota)
    return taken.withColumn("entity_views", F.max("view_index").over(w)).drop("__j", "__k")


def locked_sets(df: DataFrame, positive: Column, order: Sequence[Column], n_pos: int, n_neg: int, entity: str) -> DataFrame:
    """A locked hold-out of so many positives and negatives from different entities; positives choose first."""
    w = Window.partitionBy(entity).orderBy(F.col("__pos").desc(), *order)
    one = df.withColumn("__pos", positive.cast("int")).withColumn("__e", F.row_number().over(w)).where("__e = 1")
    pos = one.where("__pos = 1").orderBy(*order).limit(n_pos)
    neg = one.where("__pos = 0").orderBy(*order).limit(n_neg)
    return pos.unionByName(neg).drop("__pos", "__e")


def select_candidate(candidates: DataFrame, guards: Column, by: Sequence[str], name: str = "name") -> DataFrame:
    """The candidate that passes all guards and is greatest by a tuple of columns; no row if none passes."""
    best = candidates.where(guards).agg(F.max_by(F.struct(*candidates.columns), F.struct(*by, name)).alias("best"))
    return best.where("best is not null").select("best.*")


def hard_negative_mix(df: DataFrame, positive: Column, hard: Column, order: Sequence[Column], n_pos: int, n_neg: int) -> DataFrame:
    """Positives, one third hard negatives and the rest easy ones, each cyclic in order; adds `role`."""
    role = F.when(positive, "positive").when(hard, "hard_negative").otherwise("easy_negative")
    n_hard = n_neg // 3
    return take_budgets(df.withColumn("role", role), "role", [("positive", n_pos), ("hard_negative", n_hard), ("easy_negative", n_neg - n_hard)], order)


def reshuffled_cycles(df: DataFrame, keys: Sequence[str], identity: Column, order: Sequence[Column], n: int, salt: str) -> DataFrame:
    """n rows of each group where every round over the group has a hash order of its own; adds `cycle`."""
    counted = join_same(df, df.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
    rounds = F.ceil(F.lit(n) / F.col("__m")).cast("int")
    views = counted.withColumn("cycle", F.explode(F.sequence(F.lit(0), rounds - 1)))
    draw = F.sha1(F.concat_ws("::", F.lit(salt), F.col("cycle"), identity.cast("string")).cast("binary"))
    return _rank(views, [*keys, "cycle"], [draw, *order], "__rn").where(F.col("__rn") <= n).where(F.col("cycle") * F.col("__m") + F.col("__rn") <= n).drop("__rn", "__m")


def priority_sample(df: DataFrame, keys: Sequence[str], ranks: Sequence[tuple[str, Column]], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, better ranks first; adds `rank`, the first name whose condition holds, or other."""
    name, place = F.lit("other"), F.lit(len(ranks))
    for i, (r, condition) in reversed(list(enumerate(ranks))):
        name, place = F.when(condition, r).otherwise(name), F.when(condition, i).otherwise(place)
    ranked = df.withColumn("rank", name).withColumn("__place", place)
    return top_n(ranked, keys, [F.col("__place"), *order], n).drop("__place")


def ratio_capped(df: DataFrame, key: str, base: str, ratios: Sequence[tuple[str, float]], order: Sequence[Column]) -> DataFrame:
    """The base class whole, and of each listed class at most `ratio` times as many rows as the base has."""
    n = df.where(F.col(key) == base).agg(F.count("*").alias("__base"))
    cap = F.when(F.col(key) == base, F.col("__base"))
    for name, ratio in ratios:
        cap = cap.when(F.col(key) == name, F.floor(F.col("__base") * ratio))
    listed = df.where(F.col(key).isin(base, *[r[0] for r in ratios]))
    ranked = row_numbers(listed, [key], order, "__rn").join(F.broadcast(n), how="inner", on=F.lit(True))
    return ranked.where(F.col("__rn") <= cap).drop("__rn", "__base")


def replay_mix(base: DataFrame, additions: DataFrame, keys: Sequence[str], positive: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """The base rows and, for each group, as many new positives as negatives: the least of both and of a cap."""
    even = balanced(additions, keys, positive, order)
    side = even.withColumn("__pos", positive.cast("int"))
    return base.withColumn("role", F.lit("replay")).unionByName(top_n(side, [*keys, "__pos"], order, cap).drop("__pos").withColumn("role", F.lit("added")), allowMissingColumns=True)


def odd_aware_halves(df: DataFrame, positive: Column, order: Sequence[Column], n: int) -> DataFrame:
    """n rows, half of them positive and the odd one positive too, each half cyclic."""
    side = df.withColumn("__side", F.when(positive, "pos").otherwise("neg"))
    return take_budgets(side, "__side", [("pos", n // 2 + n % 2), ("neg", n // 2)], order).drop("__side")


def quotas_with_roles(df: DataFrame, key: str, identity: Sequence[str], quotas: Sequence[tuple[str, str, int]], order: Sequence[Column]) -> DataFrame:
    """For each (class, role, n) in turn the next n rows of the class that no earlier quota has used; repeated
    identities count once. Adds `role`."""
    once = _rank(df, [key, *identity], order, "__dup").where("__dup = 1").drop("__dup")
    ranked = _rank(once, [key], order, "__rn")
    role, done = F.lit(None).cast("string"), {}
    for name, label, n in quotas:
        start = done.get(name, 0)
        role = F.when((F.col(key) == name) & (F.col("__rn") > start) & (F.col("__rn") <= start + n), label).otherwise(role)
        done[name] = start + n
    return ranked.where(F.col("__rn") <= max(done.values(), default=0)).withColumn("role", role).where("role is not null").drop("__rn")


def extremes(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k greatest and k least rows as a report, marked in `end`."""
    top = df.orderBy(F.desc(value), tie).limit(k).withColumn("end", F.lit("top"))
    return top.unionByName(df.orderBy(F.asc(value), tie).limit(k).withColumn("end", F.lit("bottom")))
