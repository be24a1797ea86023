"""Quality rules: word statistics, and robust multivariate outliers among them, by DataFrame functions only.

For each language and source, a minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps from two fixed starts (medians with absolute deviations; all rows): distances to the
estimate, the closest three quarters of the rows, their mean and covariance, and again. The estimate of
smaller determinant judges all rows by Mahalanobis distance.

Vectors are kept in units of 1/1024, so sums are exact and do not depend on how rows are dealt out. The
distance that holds three quarters of a group is read from a histogram of a fixed number of bins, whose
counts add up like other sums. No group is gathered in one place: a row per group and start is sent to all
rows, as long as there are no more than FEW groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.llm._common import release, store

UNIT = 1024
#: Smallest standard deviation, in the statistics' own units, that counts for each entry of the vector.
FLOORS = {"word_length": 0.35, "symbols": 0.045, "dup_lines": 0.15, "repeats": 0.09, "upper": 0.06}
KEYS = list(FLOORS)
#: Distance beyond which a row is an outlier (chi-square with 5 degrees of freedom: 1 - 1e-9), its median,
#: the share of rows that an estimate rests on, the most steps, the change of the log determinant below which they
#: end, the rows that a group needs for its own estimate, and the groups up to which estimates are broadcast.
CUTOFF, MEDIAN, SHARE, STEPS, SETTLED, LEAST, FEW = 50.7, 4.351, 0.75, 10, 0.01, 30, 20_000
#: Bins of the distance's histogram: equal steps of its logarithm.
PER_OCTAVE, BINS = 64, 4096
PAIRS = [(i, j) for i in range(len(KEYS)) for j in range(i + 1)]


def word_statistics(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper beside docs (text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("_words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint"),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_grams": F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(1), F.size("_words") - 2), lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)))),
    })
    docs = docs.withColumns({"n_lines": F.size("_lines").cast("bigint"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), "_sorted": F.sort_array(F.coalesce("_grams", F.array().cast("array<bigint>")))}).drop("_lines", "_words")
    docs = docs.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (F.get("_sorted", i - 1) == x)))).drop("_sorted")
    # a few repeated hashes are looked up one by one; many are found by sorting hashes with their places
    placed = F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_placed", F.when(F.size("_twice") > 64, placed))
    few = F.filter(F.transform("_grams", lambda x, i: F.when(F.array_contains("_twice", x), i)), lambda i: i.isNotNull())
    many = F.filter("_placed", lambda e, i: (F.get("_placed", i + 1)["h"] == e["h"]) | ((i > 0) & (F.get("_placed", i - 1)["h"] == e["h"])))
    many = F.sort_array(F.transform(many, lambda e: e["i"]))
    docs = docs.withColumn("_places", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= 64, few).otherwise(many))
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_places", state, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return docs.withColumn("n_repeat_words", covered).drop("_grams", "_twice", "_placed", "_places")


def _vector() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    parts = {
        "word_length": F.col("word_chars") / words,
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "upper": F.sqrt(F.col("n_upper") / chars),
    }
    return {k: F.round(F.least(v, F.lit(1e4)) * UNIT).cast("bigint") for k, v in parts.items()}


def _factor(est: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor l_i_j of the covariance c_i_j, and the logarithm of its determinant."""
    for j in range(len(KEYS)):
        square = F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        # the floor was added to the diagonal, so no pivot is smaller
        est = est.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(square, F.lit((FLOORS[KEYS[j]] * UNIT) ** 2 / 2))))
        rest = {f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, len(KEYS))}
        est = est.withColumns(rest) if rest else est
    log_det = sum((F.log(F.col(f"l_{j}_{j}")) for j in range(len(KEYS))), F.lit(0.0))
    return est.withColumn("log_det", log_det).select("grp", "start", "log_det", *(f"m_{i}" for i in range(len(KEYS))), *(f"l_{i}_{j}" for i, j in PAIRS))


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean, covariance (with the floors) and factor of the rows by grp and start."""
    sums = {f"s_{i}": F.sum(KEYS[i]) for i in range(len(KEYS))} | {f"p_{i}_{j}": F.sum(F.col(KEYS[i]) * F.col(KEYS[j])) for i, j in PAIRS}
    est = rows.groupBy("grp", "start").agg(F.count("*").alias("n"), *(v.alias(k) for k, v in sums.items()))
    n = F.col("n").cast("double")
    est = est.withColumns({f"m_{i}": F.col(f"s_{i}") / n for i in range(len(KEYS))})
    floor = lambda i, j: F.lit((FLOORS[KEYS[i]] * UNIT) ** 2 if i == j else 0.0)
    return _factor(est.withColumns({f"c_{i}_{j}": F.col(f"p_{i}_{j}") / n - F.col(f"m_{i}") * F.col(f"m_{j}") + floor(i, j) for i, j in PAIRS}))


def _few(small: DataFrame, groups: int) -> DataFrame:
    """A table with a row per group (and start), to be joined to rows: by broadcast where the groups are few."""
    return F.broadcast(small) if groups <= FEW else small


def _first(rows: DataFrame, groups: int) -> DataFrame:
    """The two starts of each group: medians (from the statistics' own histograms), and all rows."""
    medians = rows.groupBy("grp").agg(*(F.percentile_approx(k, 0.5, 1000).alias(f"m_{i}") for i, k in enumerate(KEYS)))
    away = rows.join(_few(medians, groups), "grp").groupBy("grp").agg(*(F.percentile_approx(F.abs(F.col(k) - F.col(f"m_{i}")), 0.5, 1000).alias(f"d_{i}") for i, k in enumerate(KEYS)))
    spread = {f"c_{i}_{j}": F.pow(F.col(f"d_{i}") * 1.4826, F.lit(2.0)) + (FLOORS[KEYS[i]] * UNIT) ** 2 if i == j else F.lit(0.0) for i, j in PAIRS}
    robust = medians.join(away, "grp").withColumns({f"m_{i}": F.col(f"m_{i}").cast("double") for i in range(len(KEYS))} | spread).withColumn("start", F.lit(0))
    return _factor(robust).unionByName(_estimate(rows.withColumn("start", F.lit(1))))


def _distance(rows: DataFrame, est: DataFrame, on: list[str], groups: int) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the row's estimate, and its bin."""
    rows = rows.join(_few(est, groups), on)
    for i in range(len(KEYS)):
        z = (F.col(KEYS[i]) - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}")
        rows = rows.withColumn(f"z_{i}", z)
    rows = rows.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(KEYS))), F.lit(0.0)))
    return rows.withColumn("bin", F.least(F.floor(F.log2(1 + F.col("d2") * 1024) * PER_OCTAVE), F.lit(BINS - 1)).cast("int"))


def _quantile(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """The first bin, for each group, up to which at least that share of its rows lies."""
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumns({"c": so_far, "t": total}).where(F.col("c") >= F.col("t") * share).groupBy(*by).agg(F.min("bin").alias("limit"))


def outliers(samples: DataFrame, rows: DataFrame, groups: int, steps: int = STEPS) -> DataFrame:
    """rows with d2, the squared robust distance to what samples of the same grp give.

    Both have grp and the vector's columns; groups: how many there are. Steps end when no group's log
    determinant changes by SETTLED. d2 is scaled so that a group's median is not above that of chi-square.
    """
    est = store(_first(samples, groups), "mcd")
    both = samples.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        near = _distance(both, est, ["grp", "start"], groups)
        close = near.join(_few(_quantile(near, ["grp", "start"], SHARE), groups), ["grp", "start"]).where("bin <= limit")
        last, est = est, store(_estimate(close.select("grp", "start", *KEYS)), "mcd")
        moved = est.join(last.select("grp", "start", F.col("log_det").alias("_was")), ["grp", "start"]).agg(F.max(F.abs(F.col("log_det") - F.col("_was")))).first()[0]
        release(last)
        if moved is None or moved < SETTLED:
            break
    best = est.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    chosen = est.join(best, ["grp", "start"]).drop("start")
    middle = _quantile(_distance(samples, chosen, ["grp"], groups), ["grp"], 0.5)
    at_limit = (F.pow(F.lit(2.0), (F.col("limit") + 1) / PER_OCTAVE) - 1) / 1024
    middle = middle.withColumn("scale", F.greatest(at_limit / MEDIAN, F.lit(1.0)))
    judged = _distance(rows, chosen, ["grp"], groups).join(_few(middle, groups), "grp")
    return judged.withColumn("d2", F.col("d2") / F.col("scale")).select(*rows.columns, "d2")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Word statistics of docs (doc_id, text, lang, source), base_failed, distance and kept; one row per row.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed and within the cutoff of the estimate of its language and source (of its language, then of
    all rows, where fewer than LEAST rows passed the base rules). Null texts count as empty and fail;
    a null lang or source is a value like others; repeated rows count each; other columns are ignored; an
    empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    stats = word_statistics(docs).drop("text").withColumns(_vector())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = store(stats.withColumn("base_failed", failed), "word_stats")
    passed = stats.where("not base_failed")
    sizes = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("of_lang"))
    grp = F.when(F.col("n") >= LEAST, F.concat_ws("\x1f", F.lit("s"), "lang", "source")).when(F.col("of_lang") >= LEAST, F.concat_ws("\x1f", F.lit("l"), "lang")).otherwise(F.lit("all"))
    names = sizes.join(by_lang, "lang").select("lang", "source", grp.alias("grp"))
    names = store(names, "groups")
    groups = names.count()
    # groups that use a wider estimate: its rows are all those of that width
    rows = passed.join(_few(names, groups), ["lang", "source"])
    wide = _few(names.select("grp").distinct(), groups)
    samples = rows.select("lang", "source", *KEYS).withColumn("grp", F.explode(F.array(F.concat_ws("\x1f", F.lit("s"), "lang", "source"), F.concat_ws("\x1f", F.lit("l"), "lang"), F.lit("all")))).join(wide, "grp", "left_semi")
    judged = outliers(samples.select("grp", *KEYS), rows, groups).drop("grp", "n", "of_lang")
    bad = stats.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    out = bad.unionByName(judged, allowMissingColumns=True)
    kept = ~F.col("base_failed") & (F.col("d2") <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.sqrt("d2").alias("distance"))

