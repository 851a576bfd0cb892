"""Quality rules: plain limits, then robust multivariate outliers per language and source.

The statistics of a text form a vector. For every (language, source) the minimum
covariance determinant estimate gives a centre and a scatter that junk cannot pull
away: concentration steps repeatedly fit them to the ``CORE`` share of rows closest to
the present fit. The same estimate is made per language and over all rows, and each fit leans on
the one above it with the weight of ``PRIOR`` rows, so a group of any size has a verdict.
Rows far from the centre in Mahalanobis distance are rejected.
Everything is built-in DataFrame functions; only one row per group is ever joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions.bind import bind
from visloom.llm.common import Scratch, words_of

SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
DIMS = 5
STEPS_PER_UNIT = 256  # statistics are whole multiples of 1/256: exact medians and sums
CORE = 0.75  # share of a group's rows a concentration step keeps
PRIOR = 50  # rows' worth of weight the fit above (language, then all rows) has in a group's fit
SHORT = 50  # words added to a text when its repeated words are weighed: one line said twice is little in a short text
MAX_STEPS = 12
SETTLED = 1e-3  # steps end when no log determinant moves by this much
# Least standard deviation of each statistic given those before it: one that hardly varies in a group
# (no symbols, no repeats) must not reject a text for a single symbol or one repeated line. It holds where
# the estimate is below it, and each statistic's range is above its floor times the root of CUTOFF.
FLOORS = (0.5, 0.25, 0.5, 0.63, 0.54)
CHI2_MEDIAN = 4.3515  # median of chi-square with DIMS degrees of freedom
# Rejection limit on the squared distance: the chi-square quantile of 1 - 1e-9.
CUTOFF = 52.0


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that the same text has twice or more.

    The window hashes are sorted with their places; equal neighbours are repeats. The
    work is n log n in the number of words, with a short way out when all windows differ.
    """

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        return F.when(
            F.size(w) >= width,
            F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            inside = F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(width)]))
            return F.size(F.array_distinct(F.flatten(inside)))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(placed, repeats))

    return bind(words, lambda w: bind(windows(w), covered))


def text_statistics(text: Column) -> list[Column]:
    """Counts of a whole text: words, their code points, symbols, repeated lines and words."""
    value = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda line: F.ltrim(line, F.lit(BLANKS)) != "")
    return [
        F.regexp_count(value, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
        .alias("lines"),
        bind(
            words_of(text),
            lambda w: F.struct(
                F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("again")
            ),
        ).alias("words"),
    ]


def statistics(documents: DataFrame) -> DataFrame:
    """One row per document: its key columns, the counts and the transformed vector x0..x4.

    The vector: log words, log mean word length, log symbols per 100 words, log repeated
    lines per 100 lines, log words in repeated windows per 100 words (of a text SHORT words longer); in
    steps of 1/256.
    A null text has no words. Null language and source form groups of their own.
    """
    counted = documents.select("doc_id", "lang", "source", *text_statistics(F.col("text")))
    n_words = F.col("words.n").cast("bigint")
    flat = counted.select(
        "doc_id",
        "lang",
        "source",
        n_words.alias("n_words"),
        F.col("words.chars").cast("bigint").alias("word_chars"),
        "n_symbols",
        F.col("lines.again").cast("bigint").alias("n_dup_lines"),
        F.col("words.again").cast("bigint").alias("n_repeat_words"),
        F.col("lines.n").alias("n_lines"),
    )
    least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    vector = [
        F.log1p(F.col("n_words")),
        F.log1p(F.col("word_chars") / least_one("n_words")),
        F.log1p(100 * F.col("n_symbols") / least_one("n_words")),
        F.log1p(100 * F.col("n_dup_lines") / least_one("n_lines")),
        F.log1p(100 * F.col("n_repeat_words") / (F.col("n_words") + SHORT)),
    ]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.select(
        *[c for c in flat.columns if c != "n_lines"],
        failed.alias("base_failed"),
        *[(F.round(v * STEPS_PER_UNIT) / STEPS_PER_UNIT).alias(f"x{k}") for k, v in enumerate(vector)],
    )


GROUP = ["level", "lang", "source"]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _leveled(rows: DataFrame) -> DataFrame:
    """Each row as a member of its (language, source), its language and the whole: levels 0, 1 and 2."""
    levels = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return levels.withColumns(
        {"lang": F.when(F.col("level") < 2, F.col("lang")), "source": F.when(F.col("level") < 1, F.col("source"))}
    )


def _same(one: DataFrame, other: DataFrame, names: list[str] = GROUP) -> Column:
    """Equal keys; null keys meet null keys."""
    equal = F.lit(True)
    for k in names:
        equal = equal & one[k].eqNullSafe(other[k])
    return equal


def _with_fit(rows: DataFrame, fit: DataFrame, names: list[str] = GROUP) -> DataFrame:
    """Rows beside their group's fit."""
    return rows.join(fit, _same(rows, fit, names)).drop(*[fit[k] for k in names])


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns of a fit: |W (x - m)|² with W the inverse Cholesky factor."""
    centred = [F.col(f"x{j}") - F.col(f"m{j}") for j in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col(f"w{i}{j}") * centred[j]
        total = total + row * row
    return total


def _factored(moments: DataFrame) -> DataFrame:
    """Beside m_i and s_ij: w_ij, the inverse Cholesky factor with FLOORS as least pivots, and log det."""
    out = moments
    for j in range(DIMS):  # column by column: the pivot, then what stands below it
        less = lambda i: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: B023, E731
        pivot = F.greatest(F.col(f"s{j}{j}") - less(j), F.lit(FLOORS[j] ** 2))
        out = out.withColumn(f"l{j}{j}", F.sqrt(pivot))
        below = {f"l{i}{j}": (F.col(f"s{i}{j}") - less(i)) / F.col(f"l{j}{j}") for i in range(j + 1, DIMS)}
        out = out.withColumns(below) if below else out
    out = out.withColumns({f"w{i}{i}": 1 / F.col(f"l{i}{i}") for i in range(DIMS)})
    for off in range(1, DIMS):  # diagonal by diagonal
        out = out.withColumns(
            {
                f"w{i}{i - off}": -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{i - off}") for k in range(i - off, i)), F.lit(0.0))
                / F.col(f"l{i}{i}")
                for i in range(off, DIMS)
            }
        )
    log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(DIMS)), F.lit(0.0))
    return out.withColumn("log_det", log_det).drop(*[f"l{i}{j}" for i, j in PAIRS])


def _first_fits(rows: DataFrame) -> DataFrame:
    """Two starts per group: medians scaled by the median absolute deviation, and unscaled medians."""
    half = lambda c: F.percentile(c, 0.5)
    centre = rows.groupBy(*GROUP).agg(*[half(F.col(f"x{i}")).alias(f"m{i}") for i in range(DIMS)])
    apart = _with_fit(rows, centre)
    spread = apart.groupBy(*GROUP, *[f"m{i}" for i in range(DIMS)]).agg(
        *[half(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"d{i}") for i in range(DIMS)]
    )
    starts = spread.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    scatter = {f"s{i}{j}": F.lit(0.0) for i in range(DIMS) for j in range(i)}
    for i in range(DIMS):
        scaled = F.pow(1.4826 * F.col(f"d{i}"), 2)
        scatter[f"s{i}{i}"] = F.when(F.col("start") == 0, scaled).otherwise(1.0)
    starts = starts.withColumns(scatter)
    return _factored(starts.drop(*[f"d{i}" for i in range(DIMS)]))


def _concentrate(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One concentration step: refit on the CORE share of each group's closest rows.

    The share's limit is exact on a logarithmic scale of distances with 1/256 steps; rows
    on the limit's step all belong.
    """
    placed = _with_fit(rows, fit).select(
        *GROUP,
        "start",
        *[f"x{i}" for i in range(DIMS)],
        F.round(F.log1p(_distance()) * STEPS_PER_UNIT).cast("int").alias("far"),
    )
    limits = placed.groupBy(*GROUP, "start").agg(F.percentile("far", CORE).alias("limit"))
    same = _same(placed, limits, [*GROUP, "start"])
    core = placed.join(limits, same).where(F.col("far") <= F.col("limit")).select(placed["*"])
    mean = [F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS)]
    cross = [F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    moments = core.groupBy(*GROUP, "start").agg(*mean, *cross)
    scatter = {f"s{i}{j}": F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS}
    return _factored(moments.withColumns(scatter).drop(*[f"p{i}{j}" for i, j in PAIRS]))


def _leaning(fit: DataFrame, above: DataFrame, names: list[str]) -> DataFrame:
    """Centre and scatter of each fit averaged with those above it: rows_here against PRIOR rows."""
    values = [*[f"m{i}" for i in range(DIMS)], *[f"s{i}{j}" for i, j in PAIRS]]
    top = above.select(*[F.col(k).alias(f"above_{k}") for k in [*names, *values]])
    equal = F.lit(True)
    for k in names:
        equal = equal & F.col(k).eqNullSafe(F.col(f"above_{k}"))
    own = F.col("rows_here") / (F.col("rows_here") + PRIOR)
    mean = [(own * F.col(v) + (1 - own) * F.col(f"above_{v}")).alias(v) for v in values]
    return fit.join(top, equal).select(*GROUP, *mean)


def covariance_fits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Per (lang, source): the centre m_i and inverse Cholesky factor w_ij of its fit.

    Concentration steps run until no determinant shrinks any more (MAX_STEPS at most); of
    the two starts the one with the smaller determinant stays, its scatter scaled up so that the median
    squared distance is that of a chi-square law. Fits of languages lean on that of all rows,
    fits of groups on that of their language: the fewer rows, the more.
    """
    rows = scratch.put(_leveled(rows), "leveled")
    fit = scratch.put(_first_fits(rows), "fit0")
    for step in range(1, MAX_STEPS + 1):
        better = scratch.put(_concentrate(rows, fit), f"fit{step}")
        old = fit.select(*GROUP, "start", F.col("log_det").alias("was"))
        moved = better.join(old, _same(better, old, [*GROUP, "start"])).agg(
            F.max(F.abs(F.col("log_det") - F.col("was"))).alias("moved")
        )
        change = moved.first()["moved"]
        scratch.drop(f"fit{step - 1}")
        fit = better
        if step > 1 and (change is None or change < SETTLED):
            break
    columns = [c for c in fit.columns if c not in GROUP]
    best = fit.groupBy(*GROUP).agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("best"))
    best = best.select(*GROUP, "best.*").drop("start", "log_det")
    sizes = (
        _with_fit(rows, best)
        .select(*GROUP, (F.round(F.log1p(_distance()) * STEPS_PER_UNIT) / STEPS_PER_UNIT).alias("far"))
        .groupBy(*GROUP)
        .agg(F.expm1(F.percentile("far", 0.5)).alias("middle"), F.count(F.lit(1)).alias("rows_here"))
    )
    sizes = sizes.withColumn("scale", F.greatest(F.col("middle") / CHI2_MEDIAN, F.lit(1.0))).drop("middle")
    scaled = _with_fit(best.drop(*[f"w{i}{j}" for i, j in PAIRS]), sizes)
    scaled = scratch.put(scaled.withColumns({f"s{i}{j}": F.col("scale") * F.col(f"s{i}{j}") for i, j in PAIRS}), "scaled")
    level = lambda k: scaled.where(F.col("level") == k)
    languages = _leaning(level(1), level(2), [])
    return _factored(_leaning(level(0), languages, ["lang"])).drop("level", "log_det")


def quality_verdicts(documents: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, squared ``distance`` and ``kept`` for every row of ``documents``.

    Needs doc_id, text, lang, source; other columns are not read. Fits come from rows that
    pass the plain limits; ``distance`` is null for rows that fail them. Repeated rows count as often as they occur. An empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    rows = scratch.put(statistics(documents), "statistics")
    passed = rows.where(~F.col("base_failed")).select("lang", "source", *[f"x{i}" for i in range(DIMS)])
    fits = scratch.put(covariance_fits(passed, scratch), "fits")
    judged = rows.join(fits, _same(rows, fits, ["lang", "source"]) & ~F.col("base_failed"), "left")
    distance = _distance()
    return judged.select(
        rows["doc_id"],
        rows["lang"],
        rows["source"],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"),
    )


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose verdict is to keep, with all their columns.

    Rows sharing a doc_id go together as soon as one of them is rejected.
    """
    verdicts = quality_verdicts(documents)
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return documents.join(gone, documents["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
