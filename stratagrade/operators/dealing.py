"""Splits of any number of rows: quotas by stratum, order by a hash.

No order of rows matters here, and no line for a row, a stratum or a group goes to the
driver.  split.py has the forms that repeat a seeded sequential stream instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import messages as say
from ..schemas import SPLITS
from .joins import join_same
from .split import DEFAULT_RATIOS, check_ratios, quotas


def stratum_digest(keys: list[str]) -> Column:
    """A stratum's place in the fixed order of strata; nulls are a value."""
    return F.md5(F.concat_ws("\x1f", *[F.when(F.col(k).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(k).cast("string"))) for k in keys]).cast("binary"))


def _share(upto: str, part: str, whole: str) -> str:
    """upto * part / whole, rounded half up, in decimals."""
    return f"CASE WHEN {whole} = 0 THEN 0L ELSE (2 * CAST({upto} AS DECIMAL(18)) * CAST({part} AS DECIMAL(18)) + {whole}) div (2 * {whole}) END"


def stratum_quotas(sizes: DataFrame, keys: list[str], ratios=DEFAULT_RATIOS) -> DataFrame:
    """sizes(*keys, total) -> *keys, n_train, n_val, n_test: quotas that add up to those
    of all rows, however small the strata.

    Strata stand in a fixed order (of a digest), and targets are rounded cumulatively:
    train takes the rounded share of all rows up to a stratum's end, less that up to its
    start; val takes likewise of what train leaves, and test the rest.  A stratum is
    within one row of its share of train, and within two of the others'.  Sums up to a stratum
    are taken by cells of the digest, so that no task sees all strata.
    """
    named = sizes.select(*keys, "total", stratum_digest(keys).alias("__m")).withColumn("__c", F.substring("__m", 1, 4))
    everything = Window.partitionBy(F.lit(0))  # 65536 cells at most
    cells = named.groupBy("__c").agg(F.sum("total").alias("__n"))
    cells = cells.select("__c", (F.sum("__n").over(everything.orderBy("__c")) - F.col("__n")).alias("__base"), F.sum("__n").over(everything).alias("total"))
    cells = quotas(cells, ratios).withColumnsRenamed({"total": "__all", "n_train": "__t", "n_val": "__v"}).drop("n_test")
    inside = F.sum("total").over(Window.partitionBy("__c").orderBy("__m", *keys).rowsBetween(Window.unboundedPreceding, 0))
    upto = named.join(cells, "__c").withColumn("__end", F.col("__base") + inside).withColumn("__start", F.col("__end") - F.col("total"))
    for at in ("start", "end"):
        upto = upto.withColumn(f"__t_{at}", F.expr(_share(f"__{at}", "__t", "__all")))
        upto = upto.withColumn(f"__v_{at}", F.expr(_share(f"(__{at} - __t_{at})", "__v", "(__all - __t)")))
    train, val = (F.col(f"__{x}_end") - F.col(f"__{x}_start") for x in "tv")
    return upto.select(*keys, train.alias("n_train"), val.alias("n_val"), (F.col("total") - train - val).alias("n_test"))


def deal(rows: DataFrame, stratum: list[str], key: str, seed: int, limits) -> DataFrame:
    """Adds split: within each stratum, rows in the order of md5(seed, key) fill the
    quotas that limits(sizes) gives for the strata's sizes(*stratum, total).

    A hot stratum isn't ordered in one task: its rows are counted by the first bits of
    the hash, and only the buckets in which a quota ends are ordered row by row.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    hashed = rows.withColumn("__h", digest).withColumn("__b", F.substring("__h", 1, 3))
    cells = hashed.groupBy(*stratum, "__b").agg(F.count("*").alias("__n"))
    sizes = limits(cells.groupBy(*stratum).agg(F.sum("__n").alias("total"))).withColumnsRenamed({"n_train": "__t", "n_val": "__v"}).select(*stratum, "__t", "__v")
    before = F.sum("__n").over(Window.partitionBy(*stratum).orderBy("__b")) - F.col("__n")
    cells = cells.withColumn("__before", before)
    cells = join_same(cells, sizes, stratum)
    ends = lambda x: (F.col("__before") < x) & (x < F.col("__before") + F.col("__n"))
    cells = cells.withColumn("__cut", ends(F.col("__t")) | ends(F.col("__t") + F.col("__v")))
    placed = join_same(hashed, cells, [*stratum, "__b"])
    side = lambda at: F.when(at < F.col("__t"), SPLITS[0]).when(at < F.col("__t") + F.col("__v"), SPLITS[1]).otherwise(SPLITS[2])
    rank = F.row_number().over(Window.partitionBy(*stratum, "__b").orderBy("__h", key)) - 1
    whole = placed.where(~F.col("__cut")).withColumn("split", side(F.col("__before")))
    edge = placed.where("__cut").withColumn("__rank", rank).withColumn("split", side(F.col("__before") + F.col("__rank"))).drop("__rank")
    return whole.unionByName(edge).drop("__h", "__b", "__n", "__before", "__t", "__v", "__cut")


def split_by_hash(rows: DataFrame, stratum: list[str], key: str, ratios=DEFAULT_RATIOS, seed: int = 42) -> DataFrame:
    """Adds split: rows of each stratum in the order of md5(seed, key) fill its quotas.

    The splits' sizes are allocate_counts() of all rows whatever the strata, and each
    stratum is within two rows of its share (see stratum_quotas()).  Rows with null
    strata make strata of their own, and rows with a null key count as having an empty
    one; every row gets a split.
    """
    check_ratios(ratios)
    return deal(rows, stratum, key, seed, lambda sizes: stratum_quotas(sizes, stratum, ratios))


# Groups ---------------------------------------------------------------------------


def plan_classes(classes: list[tuple[int, int, dict]], ratios) -> list[list[int]]:
    """For each class (groups, rows, {label: rows}): how many of its groups each split gets.

    A class is like groups of its mean size and labels.  Every split first gets the
    whole part of its share of groups; those left over, at most two a class, go one by
    one, the largest first, to where the errors of sizes and of the class's labels
    come out least.
    """
    active = [i for i in range(3) if ratios[i] > 0]
    n_groups = sum(m for m, _, _ in classes)
    if n_groups < len(active):
        raise ValueError(say.FEW_GROUPS.format(groups=n_groups, splits=len(active)))
    totals: dict = {}
    for _, _, labels in classes:
        for label, n in labels.items():
            totals[label] = totals.get(label, 0) + n
    total = sum(rows for _, rows, _ in classes)
    size_error = [-total * r for r in ratios]  # rows beyond the target
    error = [{label: -n * r for label, n in totals.items()} for r in ratios]
    dealt = []

    def give(to: int, groups: float, c: tuple[int, int, dict]) -> None:
        m, rows, labels = c
        size_error[to] += groups * rows / m
        for label, n in labels.items():
            error[to][label] += groups * n / m

    for c in classes:
        dealt.append([int(c[0] * r + 1e-9) for r in ratios])
        for i in active:
            give(i, dealt[-1][i], c)

    def gain(to: int, c: tuple[int, int, dict]) -> float:
        """By how much one more group changes the squared errors."""
        m, rows, labels = c
        change = lambda e, x: (e + x) ** 2 - e**2
        size = change(size_error[to], rows / m) / max(total * ratios[to], 1)
        return size + sum(change(error[to][x], n / m) / max(totals[x] * ratios[to], 1) for x, n in labels.items()) / max(len(labels), 1)

    for k in sorted(range(len(classes)), key=lambda k: -classes[k][1] / classes[k][0]):
        for _ in range(classes[k][0] - sum(dealt[k])):
            to = min(active, key=lambda i: (gain(i, classes[k]), i))  # noqa: B023
            dealt[k][to] += 1
            give(to, 1, classes[k])
    for i in active:  # no split stays empty
        if not any(d[i] for d in dealt):
            donor = max(active, key=lambda j: sum(d[j] for d in dealt))
            k = min((k for k in range(len(classes)) if dealt[k][donor]), key=lambda k: classes[k][1] / classes[k][0])
            dealt[k][donor] -= 1
            dealt[k][i] += 1
    return dealt


def group_classes(entries: DataFrame, most: int = 128) -> DataFrame:
    """entries(group, field, value, n) -> group, size, class: groups of about one size
    (within a factor of 1.42) whose labels lean alike.

    A group's signature is the most frequent value of each field; the `most` signatures with
    the most rows have classes of their own, all others share 32 by hash.  So there are a
    few thousand classes, whatever the number of groups.
    """
    by_field = entries.groupBy("group", "field").agg(F.sum("n").alias("size"), F.max(F.struct("n", "value")).alias("top"))
    leaning = F.transform(F.array_sort(F.collect_list(F.struct("field", F.col("top.value").alias("value")))), lambda x: F.concat(x["field"], F.lit("="), x["value"]))
    groups = by_field.groupBy("group").agg(F.max("size").alias("size"), F.array_join(leaning, "\x1f").alias("signature"))
    named = groups.groupBy("signature").agg(F.sum("size").alias("rows")).orderBy(F.desc("rows"), "signature").limit(most).select("signature", F.lit(True).alias("known"))
    groups = groups.join(F.broadcast(named), "signature", "left")  # `most` rows
    family = F.when(F.col("known"), F.col("signature")).otherwise(F.concat(F.lit("~"), F.pmod(F.xxhash64("signature"), F.lit(32)).cast("string")))
    step = F.floor(F.log2(F.col("size").cast("double")) * 2).cast("string")
    return groups.select("group", "size", F.concat_ws("|", step, family).alias("class"))


def _fold(entries: DataFrame, most: int) -> DataFrame:
    """entries(class, field, value, n) with all but the `most` frequent values of a field
    put into 32 by hash."""
    sums = entries.groupBy("field", "value").agg(F.sum("n").alias("all"))
    kept = sums.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("all"), "value"))).where(F.col("place") <= most)
    kept = kept.select("field", "value", F.lit(True).alias("known"))
    value = F.when(F.col("known"), F.col("value")).otherwise(F.concat(F.lit("~"), F.pmod(F.xxhash64("value"), F.lit(32)).cast("string")))
    return entries.join(F.broadcast(kept), ["field", "value"], "left").groupBy("class", "field", value.alias("value")).agg(F.sum("n").alias("n"))


def split_groups_by_class(rows: DataFrame, group: Column, labels: dict[str, Column], ratios=DEFAULT_RATIOS, seed: int = 42, most: int = 128) -> DataFrame:
    """Adds split; groups stay whole, and rows without a group are one.

    Groups are gathered into a bounded number of classes (see group_classes()); the driver
    plans how many groups of each class go to each split (see plan_classes()), from a
    line for each class and one for each of its labels, of which it tells `most` + 32 a
    field apart; a class's groups are then dealt in the order of md5(seed, group).

    Sizes and labels come out about as near to the ratios as groups of such sizes allow:
    the rows of a split, and those of any label in it, miss their share by less than
    4 sqrt(r (1 - r) s) + 2 m, where r is the split's ratio, s the sum of squares of what
    each group has of it and m the most that one has (a deal without classes would miss
    by more than that about once in 16,000).
    """
    check_ratios(ratios)
    if rows.isEmpty():
        return rows.withColumn("split", F.lit(None).cast("string"))
    fields = labels or {"": F.lit("")}
    keyed = rows.withColumn("__g", group)
    one = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c.cast("string"), F.lit("")).alias("value")) for n, c in fields.items()])
    entries = keyed.select(F.col("__g").alias("group"), F.explode(one).alias("e")).groupBy("group", "e.field", "e.value").agg(F.count("*").alias("n"))
    classes = group_classes(entries, most)
    sizes = {r["class"]: (r["m"], r["rows"], {}) for r in classes.groupBy("class").agg(F.count("*").alias("m"), F.sum("size").alias("rows")).orderBy("class").collect()}
    held = join_same(entries, classes.select("group", "class"), ["group"])
    for r in _fold(held, most).collect():
        sizes[r["class"]][2][r["field"], r["value"]] = r["n"]
    plan = plan_classes(list(sizes.values()), ratios)
    lines = [(name, train, val) for name, (train, val, _) in zip(sizes, plan, strict=True)]
    chosen = rows.sparkSession.createDataFrame(lines, "class string, n_train long, n_val long")
    dealt = deal(classes.select(F.col("group").alias("__g"), "class"), ["class"], "__g", seed, lambda found: found.join(chosen, "class"))
    return join_same(keyed, dealt.select("__g", "split"), ["__g"]).drop("__g")
