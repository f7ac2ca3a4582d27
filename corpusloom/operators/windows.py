"""Order-dependent operators, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_order(lines: DataFrame, page: list[str], index: str, draw: str) -> DataFrame:
    """`pos` from 0: by index, null last, then by drawing number."""
    w = Window.partitionBy(*page).orderBy(F.col(index).isNull(), index, draw)
    return lines.withColumn("pos", F.row_number().over(w) - 1)


def region_index(lines: DataFrame, page: list[str], region: str, pos: str = "pos", scored: str | None = None) -> DataFrame:
    """`region_index` by a region's first line; `reading_order_index` counts scored regions only."""
    first = lines.groupBy(*page, region).agg(F.min(pos).alias("first"), *([F.max(scored).alias("scored")] if scored else [F.lit(True).alias("scored")]))
    w = Window.partitionBy(*page).orderBy("first", region)
    run = F.sum(F.col("scored").cast("int")).over(w)
    return first.withColumn("region_index", F.row_number().over(w) - 1).withColumn("reading_order_index", F.when(F.col("scored"), run - 1))


def order_violations(lines: DataFrame, page: list[str], index: str, logical: str, ties: list[str] | None = None) -> DataFrame:
    """Lines whose index is not their place, or whose logical index falls: (page, index, rule).  `ties` order lines of one index."""
    w = Window.partitionBy(*page).orderBy(index, *(ties or []))
    seen = F.max(logical).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumn("place", F.row_number().over(w) - 1).withColumn("seen", seen)
    rule = F.when(F.col(index) != F.col("place"), "position").when(F.col(logical) < F.col("seen"), "monotone")
    return marked.withColumn("rule", rule).where("rule IS NOT NULL").select(*page, index, "rule")


def reconstruct(segments: DataFrame, page: list[str], index: str, logical: str, join: str, text: str) -> DataFrame:
    """(page, logical, line, ok): segments of a logical line in order, joined by a space or a cell bar; the first has no join."""
    own = segments.where(F.col(logical).isNotNull()).groupBy(*page, logical).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(join).alias("j"), F.col(text).alias("t")))).alias("s"))
    part = F.transform("s", lambda x, i: F.concat(F.when(i == 0, "").when(x["j"] == "cell", " | ").otherwise(" "), x["t"]))
    ok = F.get("s", F.lit(0))["j"].isNull() & F.forall(F.slice("s", 2, F.size("s")), lambda x: F.coalesce(x["j"].isin("space", "cell"), F.lit(False)))
    return own.select(*page, logical, F.array_join(part, "").alias("line"), ok.alias("ok"))


def first_appearance(rows: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """`rank` from 0 of each value by its first place."""
    first = rows.groupBy(*by, value).agg(F.min(pos).alias("first"))
    return first.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy("first")) - 1)


def round_robin(i: Column, ids: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, ids)), F.pmod(i, F.lit(len(ids))).cast("int") + 1)


def balanced_assignment(rows: DataFrame, key: str, ids: list[str], seed: int) -> DataFrame:
    """`assigned`: keys in hash order, dealt in turn, so counts differ by one at most.

    Ranks come from 4,096 ranges of the hash: counts of ranges first, then places inside each."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    marked = rows.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = marked.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    ranked = marked.withColumn("__r", rank).join(F.broadcast(counts), "__b")
    return ranked.withColumn("assigned", round_robin(F.col("__r") + F.col("__before"), ids)).drop("__h", "__b", "__r", "__before")


def truncate(items: Column, k: int) -> tuple[Column, Column]:
    """The first k items and how many were cut."""
    return F.slice(items, 1, k), F.greatest(F.size(items) - k, F.lit(0))


def interleave(main: DataFrame, extra: DataFrame, order: str, key: str, seed: int) -> DataFrame:
    """Rows of both with `slot`: extra rows at seeded places, main rows in their order.

    Every row gets its rank in its own table from `ranked`; the slots of extra rows are the least hashes of all
    slots, and the i-th main row goes to the i-th slot that is left."""
    h = F.sha2(F.concat(F.lit(f"{seed}:x:"), F.col(key).cast("string")), 256)
    a, b = ranked(main, F.col(order)), ranked(extra, h)
    total = main.count() + extra.count()
    n_extra = extra.count()
    places = main.sparkSession.range(total).select(F.col("id").alias("slot"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))
    taken = ranked(ranked(places, F.col("h"), "__by_hash").where(F.col("__by_hash") < n_extra), F.col("h")).select("slot", "__rank")
    left = ranked(places.join(taken, "slot", "left_anti"), F.col("slot")).select("slot", "__rank")
    return a.join(left, "__rank").drop("__rank").unionByName(b.join(taken, "__rank").drop("__rank"))


def ranked(rows: DataFrame, by: Column, name: str = "__rank") -> DataFrame:
    """Rows with their rank from 0 in the order of a column, without a window over all rows.

    Spark's range partitioning sorts the rows; only the number of rows of each partition reaches the driver's plan."""
    spread = rows.withColumn("__by", by).repartitionByRange(F.col("__by")).sortWithinPartitions("__by").withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    spread = spread.withColumn("__in", F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33))
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return spread.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__in")).drop("__by", "__part", "__id", "__in", "__p", "__before")


def keep_first(rows: DataFrame, value: str, key: str, seed: int, n: int | None = None) -> DataFrame:
    """Rows without repeats of `value`, each value's least hash kept, in hash order, at most n.

    The least is an aggregate, so a value with many rows is no hot task."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    best = rows.withColumn("__h", h).groupBy(value).agg(F.min_by(F.struct(*rows.columns), F.struct("__h", key)).alias("r"), F.min("__h").alias("__h"))
    best = best.orderBy("__h", "r")
    return (best.limit(n) if n is not None else best).select("r.*")


def capped_sample(rows: DataFrame, by: list[str], key: str, cap: int, seed: int) -> DataFrame:
    """At most `cap` rows of each group, those with the least hashes; a sampling operator.

    The cut-off hash comes from ranks inside (group, leading hash digit) first, so no task ranks a whole group."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    marked = rows.withColumn("__h", h)
    small = marked.withColumn("__s", F.substring("__h", 3, 1)).withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__h", key))).where(F.col("__r") <= cap)
    return small.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h", key))).where(F.col("__r") <= cap).drop("__h", "__s", "__r")


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*[F.coalesce(F.col(c), F.lit("")) for c in ("severity", "code", "source_path")])


def sort_errors(errors: DataFrame) -> DataFrame:
    return errors.orderBy("code", F.coalesce("row", F.lit(0)), "seq")


def first_error(errors: DataFrame, by: list[str], path: str, message: str) -> DataFrame:
    """The error with the least path of each key."""
    return errors.groupBy(*by).agg(F.min_by(F.struct(path, message), path).alias("e")).select(*by, "e.*")


def best_choice(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The value with the least compound order in each group."""
    return rows.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def page_pack(lines: DataFrame, by: list[str], order: str, sizes: Column) -> DataFrame:
    """`paragraph`: consecutive lines in paragraphs, each as long as its own first line's size says (2 to 6).

    A page's sizes are folded in order: where a line is the next to start a paragraph, its size says where the one after starts."""
    w = Window.partitionBy(*by).orderBy(order)
    placed = lines.withColumn("__n", F.row_number().over(w)).withColumn("__size", F.least(F.greatest(sizes, F.lit(2)), F.lit(6)).cast("int"))
    page = placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__n", "__size"))).alias("s"))
    zero = F.struct(F.lit(1).alias("next"), F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        new = x["__n"] == a["next"]
        at = F.when(new, a["at"] + 1).otherwise(a["at"])
        return F.struct(F.when(new, a["next"] + x["__size"]).otherwise(a["next"]).alias("next"), at.alias("at"), F.concat(a["out"], F.array(at)).alias("out"))

    packed = page.select(*[F.col(c).alias(f"__{c}") for c in by], F.posexplode(F.aggregate("s", zero, step)["out"]).alias("__i", "paragraph"))
    same = F.col("__n") == F.col("__i") + 1
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.join(packed, same).drop("__n", "__size", "__i", *[f"__{c}" for c in by])
