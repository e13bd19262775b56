"""Quality rules by robust multivariate outliers (DataFrame functions only).

Every text gives a vector of transformed, smoothed statistics.  For each (lang, source) group
the minimum covariance determinant estimate of centre and scatter is sought from several starts
(coordinate medians and quartile spreads of the group and of all rows, and classical moments):
a concentration step keeps the share H of rows of least Mahalanobis distance and estimates anew;
steps go on until no determinant falls any more, and the start that ends with the least one wins.
A row is rejected when its squared distance exceeds the CONFIDENCE quantile of the chi-square law
of its dimension, or when it fails the base rule.

Every group, whatever its size, is estimated in the same way: its kept rows are joined by PRIOR
pseudo-rows with the moments of all groups' kept rows, so a small group leans on the whole and a
large one hardly does.  Scatter is regularised by a diagonal FLOOR, because most statistics of
clean text are zero; that of repeated words is a quarter of what the base rule lets pass.

Each step is one aggregation to (group, start, distance bin), which is pre-aggregated before its
shuffle, so a group that holds most rows costs no more than others.

Edge cases: a null text has no words and fails the base rule; null lang or source is a group
of its own; an empty table gives an empty result; repeated rows get the same verdict; other
columns are not looked at, whatever their names, and `keep_good` returns them as they are.
"""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import let, owned, words_of, written

SHINGLE = 5
#: Share of rows that a concentration step keeps, bins a unit of log distance, pseudo-rows of the whole.
H, BINS, PRIOR = 0.75, 16, 60
#: Steps at most, and the fall of a log determinant that is worth another.
STEPS, STILL = 12, 1e-3
#: Share of ordinary rows that the cutoff keeps.
CONFIDENCE = 0.999
#: Spread that each statistic is granted at least (see `vector`).
FLOOR = (0.08, 0.35, 0.11, 0.11, 0.30, 0.30)
P = len(FLOOR)
LOW = [(i, j) for i in range(P) for j in range(i + 1)]


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more (windows compared by 64-bit hash)."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        zero = F.struct(F.lit(-SHINGLE).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(SHINGLE), i - acc["at"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(pairs, covered))

    return F.when(n <= SHINGLE, 0).otherwise(let(windows, count))


def statistics(text: Column) -> Column:
    """Struct of the base statistics and of those that only the vector uses."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        joined = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(joined).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(joined, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.char_length(F.regexp_replace(joined, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.char_length(F.regexp_replace(joined, r"[^!?]+", "")).cast("long").alias("n_marks"),
        )

    return let(words_of(text), counts)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """Transformed statistics; each rate is smoothed by some dozens of words of ordinary text."""
    n = s["n_words"]
    return [
        F.log((s["word_chars"] + 250) / (n + 50)),
        F.log((s["n_symbols"] + 1.0) / (n + 50)),
        F.sqrt(s["n_dup_lines"] / (s["n_lines"] + 10)),
        F.sqrt(s["n_repeat_words"] / (n + 50)),
        F.log((s["n_upper"] + 10.0) / (n + 50)),
        F.log((s["n_marks"] + 1.0) / (n + 50)),
    ]


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1.0 / a
    k = a
    while term > total * 1e-12:
        k += 1
        term *= x / k
        total += term
    return total * exp(-x + a * log(x) - lgamma(a))


def chi_square_quantile(p: int, share: float) -> float:
    """Value below which a chi-square variable of p degrees of freedom lies with this probability."""
    lo, hi = 0.0, 10.0 * p + 100
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(p / 2, mid / 2) < share else (lo, mid)
    return lo


#: Squared distance beyond which a document is rejected.
CUTOFF = chi_square_quantile(P, CONFIDENCE)


def _consistency(p: int, share: float) -> float:
    """Factor that makes the scatter of the nearest `share` of normal rows that of all."""
    return share / _gamma_p(p / 2 + 1, chi_square_quantile(p, share) / 2)


def _squared(df: DataFrame, at: str) -> DataFrame:
    """Adds `distance`: squared Mahalanobis distance of the array x by the struct `at`, by forward substitution.

    Each step is a column of its own, so that it is computed once and in generated code.
    """
    for k in range(P):
        rest = F.col("x")[k] - F.col(f"{at}.mu")[k]
        for j in range(k):
            rest = rest - F.col(f"{at}.chol")[k * (k + 1) // 2 + j] * F.col(f"z{j}")
        df = df.withColumn(f"z{k}", rest / F.col(f"{at}.chol")[k * (k + 1) // 2 + k])
    names = [f"z{k}" for k in range(P)]
    return df.withColumn("distance", reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in names])).drop(*names)


def _distance(x: Column, mu: Column, chol: Column) -> Column:
    """`distance` of `_squared` as one expression, each step bound once: for filters, which are pushed below
    columns and would take a copy of every earlier step into each later one."""

    def solved(z: list[Column]) -> Column:
        k = len(z)
        if k == P:
            return reduce(lambda a, b: a + b, [v * v for v in z])
        rest = x[k] - mu[k]
        for j in range(k):
            rest = rest - chol[k * (k + 1) // 2 + j] * z[j]
        return let(rest / chol[k * (k + 1) // 2 + k], lambda v: solved([*z, v]))

    return solved([])


def _factored(df: DataFrame, keep: list[str], mu: Column, cov) -> DataFrame:
    """`keep`, mu and chol: the Cholesky factor, row by row, of the regularised scatter cov(i, j), j <= i.

    It is made column by column, each in two steps (its diagonal, all below it), so that plans stay short.
    """
    df = df.withColumn("mu", mu)

    def rest(i: int, j: int) -> Column:
        value = cov(i, j) + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            value = value - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        return value

    for j in range(P):
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest(j, j), F.lit(FLOOR[j] ** 2 / 4))))
        df = df.withColumns({f"l{i}_{j}": rest(i, j) / F.col(f"l{j}_{j}") for i in range(j + 1, P)}) if j + 1 < P else df
    return df.select(*keep, "mu", F.array(*[F.col(f"l{i}_{j}") for i, j in LOW]).alias("chol"))


def _both(rows: DataFrame) -> DataFrame:
    """Every row under its own group and under the one over all (g null)."""
    return rows.withColumn("k", F.explode(F.array(F.col("g"), F.lit(None).cast("struct<lang:string,source:string>"))))


def _sums(x: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in LOW]]


def _moments(df: DataFrame, factor: float, keep: list[str] = ["k", "start"]) -> DataFrame:
    """`keep`, mu and chol from the columns of `_sums`; the scatter is taken times `factor`."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    return _factored(df, keep, F.array(*mean), lambda i, j: (F.col(f"s{i}_{j}") / F.col("n") - F.col("mu")[i] * F.col("mu")[j]) * factor)


def _start(rows: DataFrame) -> DataFrame:
    """(k, start, mu, chol) of the starts: 0 coordinate medians and quartile spreads, from histograms
    with bins of 1/256; 1 those of all rows; 2 classical moments."""
    cells = (
        rows.select("k", F.posexplode("x").alias("d", "v"))
        .groupBy("k", "d", F.floor(F.col("v") * 256).alias("b"))
        .agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("k", "d")
    seen = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(seen) / F.sum("n").over(w)
    at = lambda q: F.min(F.when(F.col("s") >= q, F.col("b"))) / 256.0
    dims = cells.withColumn("s", share).groupBy("k", "d").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    spread = dims.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("d", "m", "sd"))).alias("q"))  # P entries
    spread = spread.withColumn("start", F.lit(0))
    medians = _factored(spread, ["k", "start"], F.transform("q", lambda q: q["m"]), lambda i, j: F.col("q")[i]["sd"] ** 2 if i == j else F.lit(0.0))
    medians = written(medians, "mcd-medians")
    whole = F.broadcast(medians.where("k is null").select("mu", "chol"))  # one row
    classical = _moments(rows.groupBy("k").agg(*_sums([F.col("x")[i] for i in range(P)])).withColumn("start", F.lit(2)), 1.0)
    return medians.unionByName(medians.select("k", F.lit(1).alias("start")).join(whole)).unionByName(classical)


def _with(rows: DataFrame, params: DataFrame, key: str) -> DataFrame:
    """Rows with `at`, the parameters of their group; rows of hot groups are not gathered."""
    params = params.select(F.col("k").alias("pk"), F.struct("start", "mu", "chol", "det").alias("at"))
    return rows.join(params, rows[key].eqNullSafe(params["pk"])).drop("pk")


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: new centre and factor of every group and start, and `old`, the log determinant before."""
    x = [F.col("x")[i] for i in range(P)]
    binned = (
        _squared(_with(rows, params, "k"), "at")
        .withColumn("b", F.floor(F.log(F.col("distance") + 1e-9) * BINS))
        .groupBy("k", F.col("at.start").alias("start"), F.col("at.det").alias("old"), "b")  # one old a start
        .agg(*_sums(x))
    )
    w = Window.partitionBy("k", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = binned.withColumn("before", before).withColumn("all", F.sum("n").over(w)).where(F.col("before") < H * F.col("all"))
    names = ["n", *[c for c in binned.columns if c.startswith("s") and c != "start"]]
    sums = written(near.groupBy("k", "start").agg(F.first("old").alias("old"), *[F.sum(c).alias(c) for c in names]), "mcd-sums")
    whole = F.broadcast(sums.where("k is null").select("start", F.struct(*names).alias("whole")))  # a row a start
    share = F.when(F.col("k").isNull(), 0.0).otherwise(PRIOR / F.col("whole.n"))
    leaned = sums.join(whole, "start").select("k", "start", "old", *[(F.col(c) + share * F.col(f"whole.{c}")).alias(c) for c in names])
    return _moments(leaned, _consistency(P, H), ["k", "start", "old"])


def _log_determinant(chol: Column) -> Column:
    return 2 * reduce(lambda a, b: a + b, [F.log(chol[i * (i + 3) // 2]) for i in range(P)])


def _group(lang: Column, source: Column) -> Column:
    return F.struct(lang.alias("lang"), source.alias("source"))


def estimates(rows: DataFrame) -> DataFrame:
    """(k, mu, chol): centre and factor of every group, from rows (g, x) that pass the base rule."""
    both = _both(rows)
    with owned() as work:
        det = _log_determinant(F.col("chol"))
        params = written(_start(both).withColumn("det", det), "mcd-start")
        for step in range(STEPS):
            seen = Observation()  # the fall is seen as the step is written, without another job
            new = _concentrate(both, params).withColumn("det", det)
            params = written(new.observe(seen, F.max(F.col("old") - F.col("det")).alias("fall")), "mcd-step")
            fall = seen.get["fall"]
            if step and (fall is None or fall < STILL):
                break
        least = F.min_by(F.struct("mu", "chol"), "det")
        best = params.where("k is not null").groupBy("k").agg(least.alias("at")).select("k", "at.mu", "at.chol")
    best = written(best, "mcd")
    work.drop(rows.sparkSession)
    return best


def _verdict(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds `distance` (squared) by the estimate of the group; null where no row of the group passed the base rule."""
    return _squared(_owned(rows, params), "own").drop("pk", "own")


def _owned(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with `own`, the estimate of their group."""
    own = params.select(F.col("k").alias("pk"), F.struct("mu", "chol").alias("own"))
    return rows.join(own, rows["g"].eqNullSafe(own["pk"]), "left")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF
) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and distance (null if the base rule failed)."""
    s = F.col("s")
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), _group(F.col(lang_col), F.col(source_col)).alias("g"), statistics(F.col(text_col)).alias("s"))
        .withColumn("failed", base_failed(s))
        .withColumn("x", F.array(*vector(s))),
        "quality-statistics",
    )
    params = estimates(rows.where(~F.col("failed")).select("g", "x"))
    judged = _verdict(rows, params)
    return judged.select(
        "doc_id",
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("failed").alias("base_failed"),
        (~F.col("failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
        F.when(~F.col("failed"), F.col("distance")).alias("distance"),
    )


def keep_good(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF
) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep.

    All rows are written with their vectors (null if the base rule failed), so that texts are looked at
    once and never shuffled.  A filter before the write would be pushed below the statistics, with copies
    of them that are computed again.
    """
    x = let(statistics(F.col(text_col)), lambda s: F.when(~base_failed(s), F.array(*vector(s))))
    rows = docs.select(F.struct("*").alias("row"), _group(F.col(lang_col), F.col(source_col)).alias("g"), x.alias("x"))
    rows = written(rows, "quality-rows").where("x is not null")
    params = estimates(rows.select("g", "x"))
    distance = _distance(F.col("x"), F.col("own.mu"), F.col("own.chol"))
    return _owned(rows, params).where(F.coalesce(distance, F.lit(0.0)) <= cutoff).select("row.*")
