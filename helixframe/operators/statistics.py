"""Tests, effect sizes, corrections for many tests, correlation, diversity and enrichment as aggregates and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.numeric import chi2_p_value, f_p_value, hypergeom_p_value, log2_fold_change, normal_p_value, t_p_value
from helixframe.operators.matrix import median

# --- two groups -----------------------------------------------------------------------------------------------------


def two_group_moments(long: DataFrame, group: str, reference, test, key: str = "feature") -> DataFrame:
    """Per key: n1, n2, mean1, mean2, var1, var2 (ddof 1), sd1, sd2 (ddof 0), variance over both; 1 is the reference. One shuffle."""
    rows = long.where(F.col(group).isin(reference, test) & F.col("value").isNotNull())

    def of(which, f) -> Column:
        return f(F.when(F.col(group) == which, F.col("value")))

    return rows.groupBy(key).agg(
        *(of(w, f).alias(f"{n}{k}") for k, w in ((1, reference), (2, test)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp), ("sd", F.stddev_pop))),
        F.var_pop("value").alias("var_all"),
    )


def t_test(moments: DataFrame, welch: bool = True) -> DataFrame:
    """Adds statistic (test minus reference) and df; null where a group has fewer than two values or nothing varies."""
    v1, v2, n1, n2 = F.col("var1"), F.col("var2"), F.col("n1"), F.col("n2")
    if welch:
        a, b = v1 / n1, v2 / n2
        error, df = F.sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    else:
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        error, df = F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2)), (n1 + n2 - 2).cast("double")
    fine = (n1 >= 2) & (n2 >= 2) & (error > 0)
    return moments.withColumn("statistic", F.when(fine, (F.col("mean2") - F.col("mean1")) / error)).withColumn("df", F.when(fine, df))


def pooled_sd() -> Column:
    n1, n2 = F.col("n1"), F.col("n2")
    return F.sqrt(((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n1 + n2 - 2))


def effect_sizes(moments: DataFrame) -> DataFrame:
    """Adds Cohen's d (0 if nothing varies) with its 95 % interval and label, and Hedges' g."""
    n1, n2 = F.col("n1"), F.col("n2")
    d = F.when(pooled_sd() > 0, (F.col("mean2") - F.col("mean1")) / pooled_sd()).otherwise(F.lit(0.0))
    error = F.sqrt((n1 + n2) / (n1 * n2) + F.col("cohens_d") * F.col("cohens_d") / (2 * (n1 + n2)))
    size = F.abs("cohens_d")
    return moments.withColumn("cohens_d", d).withColumns({"ci_low": F.col("cohens_d") - 1.96 * error, "ci_high": F.col("cohens_d") + 1.96 * error, "hedges_g": F.col("cohens_d") * (1 - 3.0 / (4 * (n1 + n2) - 9)), "effect": F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")})


def rank_sums(long: DataFrame, group: str, reference, test, key: str = "feature") -> DataFrame:
    """Mann-Whitney by average ranks: u of the test group, Cliff's delta (u to -1..1) with label, z with tie correction and p."""
    rows = long.where(F.col(group).isin(reference, test) & F.col("value").isNotNull())
    # equal values are counted first, so ranks need only different values
    values = rows.groupBy(key, "value").agg(F.count("*").alias("t"), F.count_if(F.col(group) == test).alias("t2"))
    below = F.sum("t").over(Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    sums = values.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("t") + 1) / 2).groupBy(key).agg(F.sum("t").alias("n"), F.sum("t2").alias("n2"), F.sum(F.col("rank") * F.col("t2")).alias("r2"), F.sum(F.col("t") * F.col("t") * F.col("t").cast("double") - F.col("t")).alias("ties"))
    n, n2 = F.col("n").cast("double"), F.col("n2").cast("double")
    n1 = n - n2
    u = F.col("r2") - n2 * (n2 + 1) / 2
    found = sums.withColumn("u", u).withColumn("cliffs_delta", F.when((n1 > 0) & (n2 > 0), 2 * F.col("u") / (n1 * n2) - 1))
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    size = F.abs("cliffs_delta")
    found = found.withColumn("z", F.when(sd > 0, (F.col("u") - n1 * n2 / 2 - F.signum(F.col("u") - n1 * n2 / 2) * 0.5) / sd))
    return found.withColumn("effect", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")).withColumn("p_value", normal_p_value("z"))


# --- several groups -------------------------------------------------------------------------------------------------


def anova(long: DataFrame, group: str, key: str = "feature") -> DataFrame:
    """One-way: F, degrees of freedom, eta and omega squared, p."""
    cells = long.where("value IS NOT NULL").groupBy(key, group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    total = cells.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ss_within"))
    ss = F.col("q") - F.col("n") * F.col("grand") * F.col("grand")
    rows = total.withColumn("ss_between", ss).withColumn("df_between", (F.col("k") - 1).cast("double")).withColumn("df_within", (F.col("n") - F.col("k")).cast("double"))
    within = F.col("ss_within") / F.col("df_within")
    fine = (F.col("df_between") > 0) & (F.col("df_within") > 0) & (F.col("ss_within") > 0)
    whole = F.col("ss_between") + F.col("ss_within")
    rows = rows.withColumn("f", F.when(fine, F.col("ss_between") / F.col("df_between") / within)).withColumn("eta_squared", F.when(whole > 0, F.col("ss_between") / whole)).withColumn("omega_squared", F.when(fine, (F.col("ss_between") - F.col("df_between") * within) / (whole + within)))
    return rows.withColumn("p_value", f_p_value("f", "df_between", "df_within")).drop("q", "grand")


def kruskal(long: DataFrame, group: str, key: str = "feature") -> DataFrame:
    """Kruskal-Wallis H with tie correction, df, p."""
    rows = long.where("value IS NOT NULL").groupBy(key, group, "value").agg(F.count("*").alias("t"))
    ties = rows.groupBy(key, "value").agg(F.sum("t").alias("all"))
    below = F.sum("all").over(Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ties.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("all") + 1) / 2)
    correction = ties.groupBy(key).agg(F.sum("all").alias("n"), F.sum(F.col("all").cast("double") * F.col("all") * F.col("all") - F.col("all")).alias("ties"))
    sums = rows.join(ranks, [key, "value"]).groupBy(key, group).agg(F.sum("t").alias("ni"), F.sum(F.col("rank") * F.col("t")).alias("r"))
    h = sums.groupBy(key).agg(F.sum(F.col("r") * F.col("r") / F.col("ni")).alias("q"), F.count("*").alias("k")).join(correction, key)
    n = F.col("n").cast("double")
    rows = h.withColumn("h", (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).withColumn("df", (F.col("k") - 1).cast("double"))
    return rows.select(key, "n", "h", "df").withColumn("p_value", chi2_p_value("h", "df"))


def levene(long: DataFrame, group: str, key: str = "feature") -> DataFrame:
    """Equality of variances: the analysis of variance of distances from the groups' means."""
    means = long.groupBy(key, group).agg(F.avg("value").alias("m"))
    return anova(long.join(means, [key, group]).withColumn("value", F.abs(F.col("value") - F.col("m"))), group, key)


# --- corrections ----------------------------------------------------------------------------------------------------


def adjust(tests: DataFrame, method: str = "fdr_bh", p: str = "p_value", family: list[str] | None = None, tie: str = "feature", out: str = "adjusted") -> DataFrame:
    """Corrects the p-values of each family (default: all rows) of tests, one row a test; null p-values stay null.

    Tests are results, not measurements; a family is ordered in one task, as every step-up or step-down rule asks for.
    """
    family = family or []
    order = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), tie)
    every = Window.partitionBy(*family)
    # from the last rank backwards: a frame that ends at the last row would be gone through anew for each row
    up = Window.partitionBy(*family).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*family).orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    # null p-values rank last and are not counted; what is taken over a frame leaves them out
    rows = tests.withColumn("__rank", F.row_number().over(order)).withColumn("__n", F.count(p).over(every))
    x, n, rank = F.col(p), F.col("__n"), F.col("__rank")
    one = lambda c: F.least(c, F.lit(1.0))
    if method == "bonferroni":
        done = rows.withColumn(out, one(x * n))
    elif method == "sidak":
        done = rows.withColumn(out, 1 - F.pow(1 - x, n))
    elif method == "holm":
        done = rows.withColumn(out, one(F.max(x * (n - rank + 1)).over(down)))
    elif method == "holm_sidak":
        done = rows.withColumn(out, one(F.max(1 - F.pow(1 - x, n - rank + 1)).over(down)))
    elif method == "fdr_bh":
        done = rows.withColumn(out, one(F.min(x * n / rank).over(up)))
    elif method == "fdr_by":
        done = rows.withColumn("__c", F.sum(F.when(x.isNotNull(), 1 / rank)).over(every)).withColumn(out, one(F.min(x * n * F.col("__c") / rank).over(up))).drop("__c")
    elif method in ("fdr_tsbh", "fdr_tsbky"):
        # two stages: the rejections of the first estimate how many hypotheses hold
        alpha = 0.05 / 1.05 if method == "fdr_tsbky" else 0.05
        first = rows.withColumn("__a", one(F.min(x * n / rank).over(up)))
        m0 = n - F.count_if(F.col("__a") <= alpha).over(every)
        scaled = first.withColumn("__m", F.when(m0 > 0, m0 / n).otherwise(1.0 / n))
        done = scaled.withColumn(out, one(F.col("__a") * F.col("__m") * (1.05 if method == "fdr_tsbky" else 1.0))).drop("__a", "__m")
    elif method == "qvalue":
        steps = [round(0.05 * k, 2) for k in range(1, 19)]
        shares = [F.count_if(x > s).over(every) / (n * (1 - s)) for s in steps]
        middle = F.array_sort(F.array(*shares))
        pi0 = one((F.element_at(middle, 9) + F.element_at(middle, 10)) / 2)
        done = rows.withColumn("__pi", pi0).withColumn(out, one(F.min(x * n / rank).over(up) * F.col("__pi"))).drop("__pi")
    else:
        raise ValueError(f"unknown correction {method!r}")
    return done.withColumn(out, F.when(x.isNotNull(), F.col(out))).drop("__rank", "__n")


# --- differential analysis ------------------------------------------------------------------------------------------


def differential(long: DataFrame, group: str, reference, test, method: str = "welch", pseudocount: float = 0.0, correction: str = "fdr_bh", fdr: float = 0.05, min_lfc: float = 1.0, key: str = "feature") -> DataFrame:
    """Per feature: moments, statistic, df, p, adjusted p, log2 fold change, class (up, down, ns). `method`: welch, student, mann_whitney.

    Features whose values do not vary (population variance below 1e-10) or with fewer than three values are left out.
    """
    moments = two_group_moments(long, group, reference, test, key).where((F.col("var_all") >= 1e-10) & (F.col("n1") + F.col("n2") >= 3))
    if method == "mann_whitney":
        ranks = rank_sums(long, group, reference, test, key).select(key, F.col("u").alias("statistic"), "p_value", "cliffs_delta")
        tested = moments.join(ranks, key)
    else:
        tested = t_test(moments, method == "welch")
        tested = tested.withColumn("p_value", F.coalesce(t_p_value("statistic", "df"), F.lit(1.0)))
    tested = tested.withColumn("log2fc", log2_fold_change(F.col("mean1"), F.col("mean2"), pseudocount))
    tested = adjust(tested, correction, tie=key)
    deg = (F.col("adjusted") < fdr) & (F.abs("log2fc") > min_lfc)
    return tested.withColumn("class", F.when(F.coalesce(deg, F.lit(False)), F.when(F.col("log2fc") > 0, "up").otherwise("down")).otherwise("ns"))


def volcano(results: DataFrame) -> DataFrame:
    return results.withColumn("neg_log10_p", -F.log10(F.greatest("p_value", F.lit(1e-300))))


def ma(results: DataFrame, mean: str = "mean1") -> DataFrame:
    return results.withColumn("log_mean", F.log10(F.col(mean) + 1)).withColumn("significant", F.col("p_value") < 0.05)


def gene_ranking(results: DataFrame, by: str = "signed_p") -> DataFrame:
    """Score for pre-ranked enrichment: sign of the fold change times -log10 p, or the statistic, or the fold change; nulls dropped, best first."""
    score = {"signed_p": F.signum("log2fc") * -F.log10(F.greatest("p_value", F.lit(1e-300))), "statistic": F.col("statistic"), "logfc": F.col("log2fc")}[by]
    return results.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "feature")


def compare_methods(results: dict[str, DataFrame], key: str = "feature", fdr: float = 0.05) -> DataFrame:
    """Features significant by any method: a boolean column each and their number."""
    tagged = reduce(DataFrame.unionAll, [r.where(F.col("adjusted") < fdr).select(key, F.lit(n).alias("method")) for n, r in results.items()])
    return tagged.groupBy(key).agg(*(F.max(F.col("method") == n).alias(n) for n in results), F.countDistinct("method").alias("n_methods")).orderBy(F.desc("n_methods"), key)


# --- correlation, distances, diversity ------------------------------------------------------------------------------


def pair_correlations(long: DataFrame, method: str = "pearson", threshold: float | None = None) -> DataFrame:
    """(a, b, r, n) of feature pairs a < b over their common samples.

    Sums of products by pair: every sample is expanded to its own feature pairs and these are added up before the shuffle.
    """
    from helixframe.operators.matrix import ranked

    rows = long.where("value IS NOT NULL")
    if method == "spearman":
        rows = ranked(rows).select("sample", "feature", F.col("rank_avg").alias("value"))
    a, b = rows.select("sample", F.col("feature").alias("a"), F.col("value").alias("x")), rows.select("sample", F.col("feature").alias("b"), F.col("value").alias("y"))
    found = a.join(b, "sample").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    return found.where(F.abs("r") >= threshold) if threshold is not None else found


def alpha_diversity(long: DataFrame) -> DataFrame:
    """Shannon (natural logarithm), Simpson and the number of observed features of every sample."""
    some = long.where("value > 0")
    shares = some.join(some.groupBy("sample").agg(F.sum("value").alias("s")), "sample").withColumn("p", F.col("value") / F.col("s"))
    return shares.groupBy("sample").agg((-F.sum(F.col("p") * F.log("p"))).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"), F.count("*").alias("observed"))


#: Rows of the samples, neighbours by name, whose pairs one task adds up, and pairs of rows that it holds at a time.
BUNDLE, MET = 500_000, 250_000


class _Bundle:
    """The rows of a bundle's samples by feature, met by rows of its own and of later samples."""

    def __init__(self, rows: pd.DataFrame, joint: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, least: float | None = None) -> None:
        self.joint, self.least, codes, self.features = joint, least, *pd.factorize(rows["feature"])
        order = np.argsort(codes, kind="stable")
        self.first = np.searchsorted(codes[order], np.arange(len(self.features) + 1))
        self.place, self.value = rows["place"].to_numpy()[order], rows["value"].to_numpy()[order]
        self.width, self.index = int(self.place.max()) + 1, pd.Index(self.features)
        places, firsts = np.unique(rows["place"].to_numpy(), return_index=True)
        self.names, self.sizes = (np.empty(self.width, dtype=rows[c].to_numpy().dtype) for c in ("sample", "n"))
        self.names[places], self.sizes[places] = rows["sample"].to_numpy()[firsts], rows["n"].to_numpy()[firsts]

    def pairs(self, rows: pd.DataFrame, own: bool) -> pd.DataFrame:
        """(a, b, na, nb, total) of all samples of `rows`, which are whole and stand together."""
        at, place, value = self.index.get_indexer(rows["feature"]), rows["place"].to_numpy() if own else None, rows["value"].to_numpy()
        new = (rows["sample"] != rows["sample"].shift()).to_numpy()
        b, firsts, few = np.cumsum(new) - 1, np.flatnonzero(new), np.where(at >= 0, self.first[at + 1] - self.first[at], 0)
        ends, keys, totals, i = np.cumsum(few), [], [], 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MET, "right")))
            if j < len(rows) and (start := firsts[b[j]]) > i:  # samples are whole where they fit
                j = int(start)
            row = np.repeat(np.arange(i, j), few[i:j])
            mine = np.arange(len(row)) - np.repeat(ends[i:j] - few[i:j] - (ends[i - 1] if i else 0), few[i:j]) + self.first[at[row]]
            if own:
                before = self.place[mine] < place[row]
                row, mine = row[before], mine[before]
            key = b[row] * self.width + self.place[mine]
            x = None if self.joint is None else self.joint(self.value[mine], value[row])
            low, span = (b[i] * self.width, (b[j - 1] - b[i] + 1) * self.width)
            if span <= 2 * MET:
                many = np.bincount(key - low, minlength=span)
                n = np.flatnonzero(many)
                keys.append(n + low)
                totals.append((many if x is None else np.bincount(key - low, x, span))[n].astype(np.float64))
            else:
                n, where, many = np.unique(key, return_inverse=True, return_counts=True)
                keys.append(n)
                totals.append((many if x is None else np.bincount(where, x, len(n))).astype(np.float64))
            i = j
        key, total = np.concatenate(keys), np.concatenate(totals)
        if not (key[1:] > key[:-1]).all():  # a sample in several slices
            key, where = np.unique(key, return_inverse=True)
            total = np.bincount(where, total, len(key))
        if self.least is not None:
            key, total = key[total >= self.least], total[total >= self.least]
        a, later = key % self.width, firsts[key // self.width]
        return pd.DataFrame({"a": self.names[a], "b": rows["sample"].to_numpy()[later], "na": self.sizes[a], "nb": rows["n"].to_numpy()[later], "total": total})


def _sharing(rows: DataFrame, own: Column, joint: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, least: float | None = None, bundle: int = BUNDLE) -> DataFrame:
    """(a, b, na, nb, total) of samples a < b that share a feature: the sum of `joint` values over their common features (their number, without), and of each sample its aggregate `own`.

    Samples are dealt by name into bundles. A row (sample, feature, value) goes to the bundles of the samples up to its own that have its feature, and
    a bundle's task adds up all pairs of its samples with these and later ones, in order of the later: rows are shuffled, never pairs, and few more
    rows than given where samples near by name share features. Samples whose own aggregate is below `least` are left out.
    """
    from helixframe.operators.graph import dropped, settled

    rows = settled(rows.where("sample IS NOT NULL AND feature IS NOT NULL").withColumn("value", F.col("value").cast("double")))  # tables free the shuffle files before them
    sizes = settled(rows.groupBy("sample").agg(own.cast("double").alias("n"), F.count("*").alias("rows")).where(F.col("n") >= least if least is not None else F.lit(True)))
    n = max(1, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // bundle))
    placed = settled(sizes.drop("rows").repartitionByRange(n, "sample").withColumn("bundle", F.spark_partition_id()))
    upto = Window.partitionBy("feature").orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = settled(rows.join(placed, "sample").withColumn("tasks", F.collect_set("bundle").over(upto)))
    dropped(rows)
    sent = dealt.withColumn("task", F.explode("tasks")).select((F.col("task") * 2 + (F.col("task") != F.col("bundle")).cast("int")).alias("turn"), "sample", "feature", "value", "n")
    sent = sent.repartition(n, F.floor(F.col("turn") / 2)).sortWithinPartitions("turn", "sample")
    kind = rows.schema["sample"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = ((turn, part) for batch in batches for turn, part in batch.groupby("turn"))
        for turn, same in groupby(parts, key=itemgetter(0)):
            if turn % 2 == 0:
                mine = pd.concat([part for *_, part in same], ignore_index=True)
                mine["place"] = (mine["sample"] != mine["sample"].shift()).cumsum() - 1
                held = _Bundle(mine, joint, least)
                yield held.pairs(mine, True)
                continue
            open_: list[pd.DataFrame] = []  # rows of the last sample, which may go on
            for *_, part in same:
                last = (part["sample"] == part["sample"].iat[-1]).to_numpy()
                if not last.all() or (open_ and open_[-1]["sample"].iat[-1] != part["sample"].iat[-1]):
                    yield held.pairs(pd.concat([*open_, part[~last]], ignore_index=True), False)
                    open_ = []
                open_.append(part[last])
            yield held.pairs(pd.concat(open_, ignore_index=True), False)

    return sent.mapInPandas(run, f"a {kind}, b {kind}, na double, nb double, total double")


def beta_diversity(long: DataFrame, metric: str = "braycurtis", bundle: int = BUNDLE) -> DataFrame:
    """(a, b, distance) of sample pairs a < b that share a feature: braycurtis, euclidean, manhattan or jaccard.

    Sums over shared features are completed from the samples' own sums, so absent features need no rows. Pairs without a
    shared feature, whose distance is 1 (or follows from the samples' sums), are not listed.
    """
    rows, value = long.where("value <> 0"), F.col("value")
    na, nb, total = F.col("na"), F.col("nb"), F.col("total")
    own, joint, distance = {
        "braycurtis": (F.sum(value), np.fmin, 1 - 2 * total / (na + nb)), "manhattan": (F.sum(value), np.fmin, na + nb - 2 * total),
        "euclidean": (F.sum(value * value), np.multiply, F.sqrt(F.greatest(na + nb - 2 * total, F.lit(0.0)))), "jaccard": (F.count("*"), None, 1 - total / (na + nb - total)),
    }[metric]
    rows = rows.select("sample", "feature", F.lit(1).alias("value") if metric == "jaccard" else value)
    return _sharing(rows, own, joint, bundle=bundle).select("a", "b", distance.alias("distance"))


# --- enrichment -----------------------------------------------------------------------------------------------------


def over_representation(query: DataFrame, universe: DataFrame, sets: DataFrame, min_size: int = 2) -> DataFrame:
    """Per set of (pathway, gene): overlap, sizes, odds ratio, one-sided Fisher p (hypergeometric) and its BH correction.

    `query` and `universe` have a column gene; genes outside the universe do not count.
    """
    inside = universe.select("gene").distinct()
    asked = query.select("gene").distinct().join(inside, "gene", "left_semi")
    members = sets.select("pathway", "gene").distinct().join(inside, "gene", "left_semi")
    sizes = members.join(asked.withColumn("hit", F.lit(1)), "gene", "left").groupBy("pathway").agg(F.count("*").alias("set_size"), F.count("hit").alias("overlap")).where(F.col("set_size") >= min_size)
    totals = F.broadcast(inside.agg(F.count("*").alias("universe_size")).crossJoin(asked.agg(F.count("*").alias("query_size"))))
    rows = sizes.crossJoin(totals)
    b, c = F.col("query_size") - F.col("overlap"), F.col("set_size") - F.col("overlap")
    d = F.col("universe_size") - F.col("query_size") - c
    rows = rows.withColumn("odds_ratio", F.when(b * c > 0, F.col("overlap") * d / (b * c))).withColumn("p_value", hypergeom_p_value("overlap", "universe_size", "set_size", "query_size"))
    return adjust(rows, "fdr_bh", tie="pathway")


def prerank(ranking: DataFrame, sets: DataFrame, weight: float = 1.0, min_size: int = 2) -> DataFrame:
    """Enrichment score of (gene, score) rankings: the largest deviation of the weighted running sum, and the leading edge's size.

    The running sum changes at hits only, so it is taken over the hits of each set with their ranks; the whole ranking is never
    repeated for each set.
    """
    order = Window.orderBy(F.desc("score"), "gene")
    ranked = ranking.withColumn("rank", F.row_number().over(order))
    total = F.broadcast(ranking.agg(F.count("*").alias("n")))
    hits = sets.select("pathway", "gene").distinct().join(ranked, "gene").withColumn("w", F.pow(F.abs("score"), F.lit(weight))).crossJoin(total)
    by = Window.partitionBy("pathway")
    run = by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = hits.withColumns({"k": F.row_number().over(by.orderBy("rank")), "size": F.count("*").over(by), "cum": F.sum("w").over(run), "all": F.sum("w").over(by)}).where((F.col("size") >= min_size) & (F.col("all") > 0))
    misses = F.col("n") - F.col("size")
    after = F.col("cum") / F.col("all") - (F.col("rank") - F.col("k")) / misses
    before = (F.col("cum") - F.col("w")) / F.col("all") - (F.col("rank") - F.col("k")) / misses
    both = steps.withColumn("after", after).withColumn("before", before).groupBy("pathway").agg(F.max("after").alias("high"), F.min("before").alias("low"), F.max("size").alias("size"), F.max_by("k", "after").alias("edge"))
    return both.select("pathway", "size", F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")).alias("es"), F.when(F.col("high") >= -F.col("low"), F.col("edge")).alias("leading_edge"))


def prerank_significance(ranking: DataFrame, sets: DataFrame, weight: float = 1.0, min_size: int = 15, max_size: int = 500, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """`prerank` with p, normalised score and FDR (Benjamini-Hochberg) of each set, from `permutations` seeded sets of as many genes drawn at random.

    p is the share of null scores of the observed sign that are as large ((c + 1) / (m + 1)), nes the score over their mean size. The
    ranking holds a number a gene; every set is judged in its own task.
    """
    scores = np.array([r[0] for r in ranking.orderBy(F.desc("score"), "gene").select(F.col("score").cast("double")).collect()])  # one number a gene
    weights, n = np.abs(scores) ** weight, len(scores)

    def judge(batches):
        for batch in batches:
            out = []
            for name, size, es in zip(batch["pathway"], batch["size"], batch["es"]):
                rng = np.random.default_rng([seed, *str(name).encode()])
                null = np.empty(permutations)
                for i in range(permutations):
                    at = np.sort(rng.choice(n, int(size), replace=False))
                    w = weights[at]
                    run, miss = np.cumsum(w) / max(w.sum(), 1e-300), (at - np.arange(len(at))) / max(n - len(at), 1)
                    high, low = (run - miss).max(), (np.r_[0.0, run[:-1]] - miss).min()
                    null[i] = high if high >= -low else low
                same = null[null >= 0] if es >= 0 else -null[null < 0]
                out.append(((int((same >= abs(es)).sum()) + 1) / (len(same) + 1), abs(es) / same.mean() * (1 if es >= 0 else -1) if len(same) and same.mean() > 0 else None))
            yield batch.assign(p_value=[o[0] for o in out], nes=pd.Series([o[1] for o in out], dtype="float64", index=batch.index))

    found = prerank(ranking, sets, weight, min_size).where(F.col("size") <= max_size)
    kind = found.schema["pathway"].dataType.simpleString()
    tested = found.select("pathway", "size", "es", "leading_edge").repartition("pathway").mapInPandas(judge, f"pathway {kind}, size long, es double, leading_edge long, p_value double, nes double")
    return adjust(tested, "fdr_bh", tie="pathway", out="fdr")


def select_test(long: DataFrame, group: str, alpha: float = 0.05) -> DataFrame:
    """One row (n_groups, normality_p, variance_p, test): the test that suits the values.

    Normality by the moments of all values (Jarque-Bera; no sample is drawn), equal variances by Levene's test over all values: student or
    welch for two groups, anova for more; mann_whitney or kruskal where the values are not normal.
    """
    v = F.col("value")
    rows = long.where(v.isNotNull())
    moments = rows.agg(F.count_distinct(group).alias("n_groups"), F.count("*").alias("n"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k"))
    moments = moments.withColumn("jb", F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)).withColumn("normality_p", F.coalesce(chi2_p_value("jb", F.lit(2.0)), F.lit(0.0)))
    spread = levene(rows.select(F.col(group), F.lit(0).alias("feature"), "value"), group).select(F.col("p_value").alias("variance_p"))
    both = moments.crossJoin(F.broadcast(spread))  # one row each
    normal, two = F.col("normality_p") > alpha, F.col("n_groups") == 2
    test = F.when(normal & two, F.when(F.coalesce("variance_p", F.lit(1.0)) > 0.05, "student").otherwise("welch")).when(two, "mann_whitney").when(normal, "anova").otherwise("kruskal")
    return both.select("n_groups", "normality_p", "variance_p", test.alias("test"))


def rank_set_test(ranking: DataFrame, sets: DataFrame, permutations: int = 200, seed: int = 42) -> DataFrame:
    """Mean rank of each set against that of all genes, with a seeded permutation p of (c + 1) / (n + 1)."""
    ranked = ranking.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "gene")))
    totals = ranked.agg(F.count("*").alias("n")).first()["n"]
    rows = sets.select("pathway", "gene").distinct().join(ranked, "gene").groupBy("pathway").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("size"))
    spread = (totals + 1) / 2

    @F.pandas_udf("double")
    def p_value(mean: pd.Series, size: pd.Series, name: pd.Series) -> pd.Series:
        out = []
        for m, k, s in zip(mean, size, name):
            rng = np.random.default_rng([seed, *str(s).encode()])
            draws = np.array([rng.choice(totals, int(k), replace=False).mean() + 1 for _ in range(permutations)])
            out.append((int((np.abs(draws - spread) >= abs(m - spread)).sum()) + 1) / (permutations + 1))
        return pd.Series(out, dtype="float64")

    return rows.withColumn("shift", F.col("mean_rank") - spread).withColumn("p_value", p_value("mean_rank", "size", "pathway"))


def pathway_scores(long: DataFrame, sets: DataFrame, method: str = "mean", min_size: int = 2) -> DataFrame:
    """(sample, pathway, score, n): mean or median of a pathway's features in every sample, of pathways with enough features present."""
    joined = long.where("value IS NOT NULL").join(sets.select("pathway", F.col("gene").alias("feature")).distinct(), "feature")
    score = F.avg("value") if method == "mean" else median("value")
    return joined.groupBy("sample", "pathway").agg(score.alias("score"), F.count("*").alias("n")).where(F.col("n") >= min_size)


def crosstalk(sets: DataFrame, min_overlap: int = 3, bundle: int = BUNDLE) -> DataFrame:
    """(a, b, overlap, jaccard) of pathway pairs a < b; genes are joined, not all pairs of pathways, and pathways below `min_overlap` genes overlap with none enough."""
    rows = sets.select(F.col("pathway").alias("sample"), F.col("gene").alias("feature"), F.lit(1).alias("value")).distinct()
    pairs = _sharing(rows, F.count("*"), None, min_overlap, bundle).where(F.col("total") >= min_overlap)
    return pairs.select("a", "b", F.col("total").cast("long").alias("overlap"), (F.col("total") / (F.col("na") + F.col("nb") - F.col("total"))).alias("jaccard"))


# --- consensus of rankings ------------------------------------------------------------------------------------------


def consensus(scores: DataFrame, how: str = "weighted") -> DataFrame:
    """(feature, consensus, rank) from (method, feature, score): weighted mean of scores over the method's largest, rank product or Borda count."""
    best = scores.groupBy("method").agg(F.max("score").alias("top"), F.count("*").alias("m"))
    ties = F.count("*").over(Window.partitionBy("method", "score"))
    rank = F.rank().over(Window.partitionBy("method").orderBy(F.desc("score"))) + (ties - 1) / 2
    rows = scores.withColumn("r", rank).join(best, "method")
    value = {"weighted": F.avg(F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.lit(0.0))), "rank_product": 1 / F.exp(F.avg(F.log(F.col("r") + 1))), "borda": F.sum(F.col("m") - F.col("r") + 1)}[how]
    found = rows.groupBy("feature").agg(value.alias("consensus"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("consensus"), "feature")))


def selection_frequency(scores: DataFrame, quantile: float = 0.75) -> DataFrame:
    """Share of methods in which a feature's score exceeds the method's quantile."""
    cuts = scores.groupBy("method").agg(F.percentile("score", F.lit(quantile)).alias("cut"))
    return scores.join(cuts, "method").groupBy("feature").agg(F.avg((F.col("score") > F.col("cut")).cast("double")).alias("frequency"))
