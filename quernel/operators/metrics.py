"""Ranking and decision metrics as grouped DataFrame operators.

Running sums over scores are taken in two levels: ties are summed first, each group's score range is cut at its
approximate percentiles, whole parts are summed, and a window runs within one part only. A group, however large, is
so spread over `parts` tasks, and results don't depend on where the cuts lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import written

PARTS = 32


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def ties(df: DataFrame, keys: list[str], score: str, label: str | tuple[str, str]) -> DataFrame:
    """One row per group and score: p positives and n negatives. label: 1 or 0, or the two columns that count a row's."""
    if not isinstance(label, str):
        p, n = label
        return df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(p).alias("p"), F.sum(n).alias("n"))
    y = F.col(label) == 1
    return df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))


def with_above(tied: DataFrame, keys: list[str], score: str, parts: int = PARTS) -> DataFrame:
    """Add p_above and n_above, the positives and negatives with a higher score, and the totals p_all and n_all."""
    parts = max(2, parts)
    tied = written(tied, "ties")  # read three times: a row a group and score
    shares = [i / parts for i in range(1, parts)]
    cuts = tied.groupBy(*keys).agg(F.percentile_approx(score, shares, 1000).alias("_cuts"), F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    part = tied.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_cuts")
    higher = Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*keys, "_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    sums = sums.select(*keys, "_part", *(F.coalesce(F.sum(f"_{c}").over(higher), F.lit(0)).alias(f"_{c}") for c in "pn"))
    within = Window.partitionBy(*keys, "_part").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = part.join(sums, [*keys, "_part"])
    return out.select(*keys, score, "p", "n", "p_all", "n_all", *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_above") for c in "pn"))


def auroc(df: DataFrame, keys: list[str], score: str = "score", label: str | tuple[str, str] = "label", name: str = "auroc", parts: int = PARTS) -> DataFrame:
    """Area under the ROC curve of each group, ties half; 0.5 where only one class is."""
    df, keys = _keyed(df, keys)
    above = with_above(ties(df, keys, score, label), keys, score, parts)
    # a negative is beaten by the positives above it and half beaten by those tied with it
    won = F.sum(F.col("n") * (F.col("p_above") + F.col("p") / 2))
    out = above.groupBy(*keys).agg(won.alias("_won"), F.max(F.col("p_all").cast("double") * F.col("n_all")).alias("_pairs"))
    value = F.when(F.col("_pairs") > 0, F.col("_won") / F.greatest(F.col("_pairs"), F.lit(1.0))).otherwise(F.lit(0.5))
    return out.select(*(k for k in keys if k != "_all"), value.alias(name))


def rates(df: DataFrame, keys: list[str], score: Column, theta: Column, label: str = "label") -> DataFrame:
    """Counts and rates of the rule score > theta in each group."""
    hit, y = score > theta, F.col(label) == 1
    counts = df.groupBy(*keys).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """Add tpr, fpr, asr, prec and f1 to tp, fp, fn, tn; empty denominators count as 1."""
    one = lambda c: F.greatest(c, F.lit(1))
    out = counts.withColumns({"tpr": F.col("tp") / one(F.col("tp") + F.col("fn")), "fpr": F.col("fp") / one(F.col("fp") + F.col("tn")), "prec": F.col("tp") / one(F.col("tp") + F.col("fp"))})
    return out.withColumns({"asr": 1.0 - F.col("tpr"), "f1": 2 * F.col("prec") * F.col("tpr") / F.greatest(F.col("prec") + F.col("tpr"), F.lit(1e-12))})


def roc_points(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", parts: int = PARTS) -> DataFrame:
    """One point per distinct score taken as the threshold (positive from it on): threshold, fpr, tpr."""
    df, keys = _keyed(df, keys)
    above = with_above(ties(df, keys, score, label), keys, score, parts)
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return above.select(*(k for k in keys if k != "_all"), F.col(score).alias("threshold"), ((F.col("n_above") + F.col("n")) / one("n_all")).alias("fpr"), ((F.col("p_above") + F.col("p")) / one("p_all")).alias("tpr"))


def choose_theta(df: DataFrame, keys: list[str], budget: Column, score: str = "score", label: str | tuple[str, str] = "label", parts: int = PARTS) -> DataFrame:
    """The threshold of best F1 among those whose false-positive rate is within budget; the higher one on ties.

    Candidates are all scores; a row is positive if its score is higher, so the highest one is always within budget."""
    df, keys = _keyed(df, keys)
    above = with_above(ties(df, keys, score, label), keys, score, parts)
    counts = above.select(*keys, F.col(score).alias("theta"), F.col("p_above").alias("tp"), F.col("n_above").alias("fp"), (F.col("p_all") - F.col("p_above")).alias("fn"), (F.col("n_all") - F.col("n_above")).alias("tn"))
    ok = with_rates(counts).where(F.col("fpr") <= budget + F.lit(1e-12))
    best = ok.groupBy(*keys).agg(F.max(F.struct(F.round("f1", 12).alias("f1"), "theta", "tpr", "fpr")).alias("b"))
    return best.select(*(k for k in keys if k != "_all"), "b.theta", "b.f1", "b.tpr", "b.fpr")


def pearson(a: Column, b: Column) -> Column:
    """Correlation as an aggregate; 0 where either column doesn't vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    flat = F.least(F.stddev_pop(a), F.stddev_pop(b)) < 1e-12
    return F.when(flat, F.lit(0.0)).otherwise(F.covar_pop(a, b) / F.when(flat, F.lit(1.0)).otherwise(spread))


def counted_moments(df: DataFrame, keys: list[str], times: str, a: str, b: str) -> DataFrame:
    """Means, population deviations and correlation (rho, 0 where either doesn't vary) of a and b, whose rows count `times`: mean_a, mean_b, sd_a, sd_b, rho."""
    n = F.col(times).cast("double")
    mean = lambda c: F.sum(n * c) / F.sum(n)
    m = df.groupBy(*keys).agg(mean(F.col(a)).alias("mean_a"), mean(F.col(b)).alias("mean_b"))  # a row a group
    around = df.join(F.broadcast(m), keys)
    x, y = F.col(a) - F.col("mean_a"), F.col(b) - F.col("mean_b")
    s = around.groupBy(*keys).agg(F.first("mean_a").alias("mean_a"), F.first("mean_b").alias("mean_b"), F.sqrt(mean(x * x)).alias("sd_a"), F.sqrt(mean(y * y)).alias("sd_b"), mean(x * y).alias("_c"))
    flat = F.least("sd_a", "sd_b") < 1e-12
    return s.withColumn("rho", F.when(flat, F.lit(0.0)).otherwise(F.col("_c") / F.when(flat, F.lit(1.0)).otherwise(F.col("sd_a") * F.col("sd_b")))).drop("_c")


def pearson_of_blocks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Correlation of each group from blocks: a row stands for n pairs, all those of one list of numbers with another, whose
    means are x and y, variances xx and yy. Within a block nothing is correlated. 0 where either number doesn't vary."""
    df = written(df.select(*keys, "n", "x", "xx", "y", "yy"), "blocks")  # read twice: means, then what lies around them
    n = F.col("n").cast("double")
    mean = lambda c: F.sum(n * F.col(c)) / F.sum(n)
    # a row a group
    out = df.join(F.broadcast(df.groupBy(*keys).agg(mean("x").alias("_x"), mean("y").alias("_y"))), keys)
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    out = out.groupBy(*keys).agg(*((F.sum(n * c) / F.sum(n)).alias(a) for a, c in (("_a", F.col("xx") + dx * dx), ("_b", F.col("yy") + dy * dy), ("_c", dx * dy))))
    a, b = F.sqrt("_a"), F.sqrt("_b")
    flat = F.least(a, b) < 1e-12
    return out.select(*keys, F.when(flat, F.lit(0.0)).otherwise(F.col("_c") / F.when(flat, F.lit(1.0)).otherwise(a * b)).alias(name))


def _share(x: Column, lo: Column, hi: Column) -> Column:
    """Where x lies between lo and hi, 0 to 1: by logarithm if both have one sign and magnitudes far apart, else evenly."""
    even = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)  # halved, so that no difference is infinite
    log = lambda c: F.ln(F.greatest(c, F.lit(5e-324)))
    up = (log(x) - log(lo)) / F.greatest(log(hi) - log(lo), F.lit(1e-9))
    down = 1 - (log(-x) - log(-hi)) / F.greatest(log(-lo) - log(-hi), F.lit(1e-9))
    far = F.lit(1e6)
    return F.coalesce(F.when((lo > 0) & (hi / far > lo), up).when((hi < 0) & (lo / far < hi), down).otherwise(even), (x > lo).cast("double"))


def median(df: DataFrame, keys: list[str], value: str, name: str = "median", bins: int = 1024, few: int = 4096) -> DataFrame:
    """The exact median of each group (the mean of the middle two), whatever its size; nulls and NaN don't count.

    Selection by rank: a pass counts bins between a group's least and greatest value, the middle ranks' bins become the
    new bounds, and when at most `few` values lie between a group's, these are sorted. No task holds a group or its
    distinct values; bounds lie in a table, a row a group and rank, that is joined like any other."""
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    rows, keys_ = _keyed(rows, keys)
    sizes = rows.groupBy(*keys_).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    half = F.floor((F.col("_n") - 1) / 2).cast("long")
    ranks = F.array(F.struct(F.lit(0).alias("i"), half.alias("r")), F.struct(F.lit(1).alias("i"), (F.col("_n") - 1 - half).alias("r")))
    # i: which of the middle two; _r: its rank from 0 among the _n values from _lo to _hi
    open_ = written(sizes.withColumn("_i", F.explode(ranks)).select(*keys_, F.col("_i.i").alias("_i"), F.col("_i.r").alias("_r"), "_n", "_lo", "_hi"), "median-bounds")
    while open_.where((F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        wide = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
        inside = rows.join(open_.where(wide), keys_).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        at = F.least(F.floor(_share(F.col("_x"), F.col("_lo"), F.col("_hi")) * bins), F.lit(bins - 1)).cast("int")
        counted = inside.groupBy(*keys_, "_i", "_r", at.alias("_b")).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        before = Window.partitionBy(*keys_, "_i").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # `bins` rows
        counted = counted.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = counted.where((F.col("_r") >= F.col("_s")) & (F.col("_r") < F.col("_s") + F.col("_c")))
        hit = hit.select(*keys_, "_i", (F.col("_r") - F.col("_s")).alias("_r"), F.col("_c").alias("_n"), "_lo", "_hi")
        open_ = written(open_.where(~wide).unionByName(hit), "median-bounds")
    done = open_.where(F.col("_lo") == F.col("_hi")).select(*keys_, "_i", F.col("_lo").alias("_v"))
    last = rows.join(open_.where(F.col("_lo") < F.col("_hi")), keys_).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    last = last.groupBy(*keys_, "_i", "_r").agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    last = last.select(*keys_, "_i", F.get("_l", F.col("_r").cast("int")).alias("_v"))
    both = done.unionByName(last).groupBy(*keys_).agg((F.sum(F.col("_v") / 2)).alias(name))
    return both.select(*(k for k in keys_ if k != "_all"), name)


def crosstab(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts by rows and the named values of a column, 0 where there are none."""
    return df.groupBy(*rows).pivot(column, values).count().na.fill(0, values)


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts for every pair of labels that occur on either side, 0 included."""
    labels = df.select(F.col(truth).alias("l")).union(df.select(F.col(pred).alias("l"))).where("l is not null").distinct()
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    # labels are the few classes of a task
    grid = labels.select(F.col("l").alias("truth")).join(labels.select(F.col("l").alias("pred")))
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 39, margin: float = 0.1) -> DataFrame:
    """Counts in equal bins from the least value less margin to the greatest plus margin, the last bin closed."""
    span = df.agg((F.min(value) - margin).alias("lo"), (F.max(value) + margin).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return df.join(F.broadcast(span)).withColumn("bin", b).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"))
