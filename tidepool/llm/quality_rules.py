"""Quality rules: multivariate outliers by minimum covariance determinant.

Statistics of each document are computed by SQL expressions over its own text,
transformed to comparable scales and held against robust estimates of its
language and source: location and scatter of the subset, a fixed share of the
group, whose covariance has the smallest determinant.  It is sought from
several starts (central by all statistics together, central in each, and any
half); concentration steps lower each start's determinant, and the start with
the smallest one wins.  A step is two groupings of the statistics with few rows
per task (sums of products; exact percentiles of rounded distances), so a group
of any size combines on the map side; estimates return to their documents by a
join whose group key is salted.

Estimates are made for each source of a language, for each language and for all
documents, and each is drawn towards the next wider one by a fixed number of
documents' worth: a small group leans on its language, a large one stands for
itself, and no size switches from one to the other.

Statistics are rounded to 1/256 and summed as integers, so a repeated task or
another partitioning gives the same estimates to the last bit.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut

SYMBOLS = "#*$%&|<>"
_SPACES = "\t\n\x0b\x0c\r"
SCALE = 256
#: Transformed statistics; for each the least standard deviation an estimate may have, so that
#: a statistic which hardly varies within a group does not reject on its own for a trifle.
#: That of repeats leaves them to the base rule where a group has none: 0.64 * sqrt(22.5) is log1p(20).
FEATURES = {"f_length": 0.5, "f_word_length": 0.08, "f_symbols": 0.25, "f_dup_lines": 0.35, "f_repeats": 0.64, "f_capitals": 0.25}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Fixed rules and the strength of the robust test.

    ``share`` of a group forms its subset, found in ``steps`` concentration steps
    from each start; ``tail`` is the chance that a normal vector would be
    rejected; ``prior_rows`` documents' worth of the wider group's estimates are
    mixed into a group's own.
    """

    least_words: int = 10
    most_repeats_percent: int = 20
    window: int = 5
    share: float = 0.75
    steps: int = 3
    tail: float = 1e-3
    prior_rows: int = 60
    salts: int = 32


def text_statistics(df: DataFrame, text: str, window: int = 5) -> DataFrame:
    """Add the counts of :data:`COUNTS` and ``n_capitals`` (long); a null text has none of anything."""
    t, w = "__text", "__words"
    staged = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    staged = staged.withColumn(w, F.array_remove(F.split(F.translate(t, _SPACES, " " * len(_SPACES)), " "), ""))
    staged = staged.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" " + _SPACES)) != ""))
    # Each word is hashed once, and a window from its words' hashes.
    staged = staged.withColumn("__hashes", F.transform(w, lambda x: F.xxhash64(x)))
    every = F.transform("__hashes", lambda h, i: F.xxhash64(h, *(F.get("__hashes", i + k) for k in range(1, window))))
    staged = staged.withColumn("__windows", F.when(F.size(w) >= window, F.slice(every, 1, F.size(w) - (window - 1))).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    # Equal windows are neighbours once sorted; their starts, in order again, tell the words covered.
    ordered = "array_sort(transform(__windows, (h, i) -> struct(h as h, i as i)))"
    starts = F.expr(
        f"array_sort(array_distinct(aggregate(array({ordered}), cast(array() as array<int>), (_, s) -> flatten(zip_with("
        "slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))))))"
    )
    staged = staged.withColumn("__starts", F.when(repeated, starts))
    covered = F.expr(f"{window} + aggregate(zip_with(slice(__starts, 1, size(__starts) - 1), slice(__starts, 2, size(__starts) - 1), (a, b) -> least({window}, b - a)), 0, (s, x) -> s + x)")
    out = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.translate(t, " " + _SPACES, "")),
        "n_symbols": F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(F.col("__starts").isNull(), F.lit(0)).otherwise(covered),
        "n_capitals": F.char_length(t) - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    }
    return staged.withColumns({k: v.cast("long") for k, v in out.items()}).drop(t, w, "__lines", "__hashes", "__windows", "__starts")


def _features() -> list[Column]:
    def share(part: str, whole: str) -> Column:
        return F.log1p(F.lit(100.0) * F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    values = [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))),
        share("n_symbols", "word_chars"),
        F.log1p(F.col("n_dup_lines").cast("double")),
        share("n_repeat_words", "n_words"),
        share("n_capitals", "word_chars"),
    ]
    return [F.round(v * SCALE).cast("long").alias(name) for name, v in zip(FEATURES, values, strict=True)]


def _solve(groups: DataFrame, size: int) -> DataFrame:
    """From mean m_i and covariance c_i_j: the inverse v_i_j of the lower Cholesky factor, and the logarithm of the determinant."""
    out, kept = groups, groups.columns
    for i in range(size):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for i in range(size):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}")
                value = value / F.col(f"l_{i}_{i}")
            out = out.withColumn(f"v_{i}_{j}", value)
    determinant = sum((2 * F.log(f"l_{i}_{i}") for i in range(size)), F.lit(0.0))
    return out.select(*kept, *(f"v_{i}_{j}" for i in range(size) for j in range(i + 1)), F.round(determinant, 9).alias("determinant"))


def _distance(size: int) -> Column:
    """Squared Mahalanobis distance of the feature columns from a group's estimates."""
    total = F.lit(0.0)
    for i in range(size):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col(f"v_{i}_{j}") * (F.col(list(FEATURES)[j]) / SCALE - F.col(f"m_{j}"))
        total = total + row * row
    return total


def _chi2(size: int, p: float) -> float:
    """Quantile of the chi-squared distribution (Wilson-Hilferty)."""
    a = 2 / (9 * size)
    return size * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


#: A group: how narrow it is (0: all, 1: a language, 2: a source of it), and which.
_GROUP = ["width", "lang_key", "source_key"]


def _key(column: Column) -> Column:
    """A text for any value, null too, that no other value has."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def _estimates(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Location and regularised scatter of each group's chosen rows."""
    names = list(FEATURES)
    size = len(names)
    sums = [F.sum(n).alias(f"s_{i}") for i, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in range(size) for j in range(i + 1)]
    agg = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    means = {f"m_{i}": F.col(f"s_{i}") / F.col("n") / SCALE for i in range(size)}
    agg = agg.withColumns(means)
    cov = []
    for i, n in enumerate(names):
        for j in range(i + 1):
            value = F.col(f"p_{i}_{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"m_{i}") * F.col(f"m_{j}")
            cov.append((value + F.lit(FEATURES[n] ** 2) if i == j else value).alias(f"c_{i}_{j}"))
    return agg.select(*keys, "n", *means, *cov)


def _drawn(estimates: DataFrame, size: int, prior: int) -> DataFrame:
    """Each group's location and scatter with the wider group's mixed in for ``prior`` documents."""
    values = [f"m_{i}" for i in range(size)] + [f"c_{i}_{j}" for i in range(size) for j in range(i + 1)]
    own = F.col("n") / (F.col("n") + prior)
    out = [estimates.filter("width = 0").select(*_GROUP, *values)]
    for width in (1, 2):
        keys = ["lang_key"] if width == 2 else []
        wider = out[-1].select(*keys, *(F.col(v).alias(f"w_{v}") for v in values))
        level = estimates.filter(F.col("width") == width)
        joined = level.join(wider, keys) if keys else level.crossJoin(F.broadcast(wider))
        out.append(joined.select(*_GROUP, *((own * F.col(v) + (1 - own) * F.col(f"w_{v}")).alias(v) for v in values)))
    # Only sources judge; the estimates of wider groups have gone into theirs.
    return _solve(out[2], size)


def minimum_determinant(pool: DataFrame, rules: Rules) -> DataFrame:
    """Of each group of rows (``_GROUP``, ``salt`` and the features): n, m_i and c_i_j of the subset of smallest determinant."""
    size, names, keys = len(FEATURES), list(FEATURES), [*_GROUP, "start"]

    def salted(small: DataFrame) -> DataFrame:
        return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))

    def chosen(away: DataFrame, share: Column) -> DataFrame:
        """The rows that are nearest within their group and start, ties included."""
        rounded = away.withColumn("bucket", F.round(F.log1p("distance") * 64).cast("int"))
        most = rounded.groupBy(*keys).agg(F.percentile("bucket", F.lit(0.5)).alias("half"), F.percentile("bucket", F.lit(rules.share)).alias("most")).select(*keys, share.alias("most"))
        return rounded.join(salted(most), [*keys, "salt"]).filter("bucket <= most")

    middle = pool.groupBy(*_GROUP).agg(*(F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i, n in enumerate(names)))
    spread = [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FEATURES[n] * SCALE)) for i, n in enumerate(names)]
    off = [F.abs(F.col(n) - F.col(f"q_{i}")[1]) / spread[i] for i, n in enumerate(names)]
    # Three starts: central by all statistics together, central in each, and a half dealt by hash.
    starts = [sum((o * o for o in off), F.lit(0.0)), F.greatest(*off) ** 2, F.pmod(F.xxhash64(*names, F.lit("start")), F.lit(1 << 20)).cast("double")]
    begun = pool.join(salted(middle), [*_GROUP, "salt"]).select(*_GROUP, "salt", *names, F.posexplode(F.array(*starts)).alias("start", "distance"))
    estimates = cut(_solve(_estimates(chosen(begun, F.when(F.col("start") == 0, F.col("most")).otherwise(F.col("half"))), keys), size))
    for _ in range(rules.steps):
        away = pool.join(salted(estimates), [*_GROUP, "salt"]).select(*keys, "salt", *names, _distance(size).alias("distance"))
        estimates = cut(_solve(_estimates(chosen(away, F.col("most")), keys), size))
    best = estimates.groupBy(*_GROUP).agg(F.min_by("start", F.struct("determinant", "start")).alias("start"))
    return estimates.join(best, keys).drop("start", "determinant", *(f"v_{i}_{j}" for i in range(size) for j in range(i + 1)))


def reject_outliers(df: DataFrame, text: str = "text", *, lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Add the statistics, ``base_failed``, ``distance`` and ``kept`` to every row; the text is left out.

    ``base_failed``: fewer than ``least_words`` words, or more than
    ``most_repeats_percent`` of them in windows that occur twice.  ``distance``
    is the squared robust Mahalanobis distance, scaled so that the group's
    median is that of a normal sample; ``kept`` is false if base_failed or if
    the distance is beyond the quantile of ``tail``.

    A null language or source is a group of its own; null and empty texts fail
    the base rules; repeated rows count each; columns named like an added one
    are replaced, all others stay whatever their names; an empty table gives an
    empty result.  Estimates are made from rows that pass the base rules.
    """
    size, names = len(FEATURES), list(FEATURES)
    made = {*COUNTS, "base_failed", "distance", "kept"}
    # The table's own columns travel in one struct, so that no name of theirs meets one of ours.
    own = [c for c in df.columns if c not in made and c != text]
    given = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own") if own else F.lit(None).alias("own"), F.col(f"`{text}`").alias("text"), _key(F.col(f"`{lang}`")).alias("lang_key"), _key(F.col(f"`{source}`")).alias("source_key"))
    stats = text_statistics(given, "text", rules.window).drop("text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeats_percent * F.col("n_words")))
    rows = cut(stats.select("*", F.lit(2).alias("width"), *_features(), F.pmod(F.xxhash64(*names, "word_chars", "n_capitals"), F.lit(rules.salts)).cast("int").alias("salt")))

    def salted(small: DataFrame) -> DataFrame:
        return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))

    judged = rows.filter(~F.col("base_failed"))
    groups = F.array(F.struct(F.lit(2).alias("width"), "lang_key", "source_key"), F.struct(F.lit(1).alias("width"), "lang_key", F.lit("*").alias("source_key")), F.struct(F.lit(0).alias("width"), F.lit("*").alias("lang_key"), F.lit("*").alias("source_key")))
    pool = judged.select(F.explode(groups).alias("g"), "salt", *names).select("g.*", "salt", *names)
    estimates = cut(_drawn(minimum_determinant(pool, rules), size, rules.prior_rows))
    bucket = F.round(F.log1p("distance") * 64).cast("int")
    away = rows.join(salted(estimates), [*_GROUP, "salt"], "left").withColumn("distance", _distance(size))
    # The median distance of each group, drawn towards that of the wider one as the estimates are.
    seen = cut(judged.join(salted(estimates), [*_GROUP, "salt"]).withColumn("distance", _distance(size)).select("lang_key", "source_key", bucket.alias("bucket")))
    own_n = F.col("n") / (F.col("n") + rules.prior_rows)
    median = [F.count(F.lit(1)).alias("n"), F.expm1(F.percentile("bucket", F.lit(0.5)) / 64).alias("own_half")]
    of_all = seen.agg(F.expm1(F.percentile("bucket", F.lit(0.5)) / 64).alias("wider"))
    of_lang = seen.groupBy("lang_key").agg(*median).crossJoin(F.broadcast(of_all)).select("lang_key", (own_n * F.col("own_half") + (1 - own_n) * F.col("wider")).alias("wider"))
    centre = seen.groupBy("lang_key", "source_key").agg(*median).join(of_lang, "lang_key").select(F.lit(2).alias("width"), "lang_key", "source_key", (own_n * F.col("own_half") + (1 - own_n) * F.col("wider")).alias("half"))
    final = away.join(salted(centre), [*_GROUP, "salt"], "left")
    # The scale only ever widens: a group with hardly any variation is not judged more sharply for it.
    scale = F.greatest(F.col("half") / _chi2(size, 0.5), F.lit(1.0))
    scaled = final.withColumn("distance", F.col("distance") / scale)
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= _chi2(size, 1 - rules.tail))
    return scaled.select(*(F.col(f"own.`{c}`").alias(c) for c in own), *COUNTS, "base_failed", "distance", verdict.alias("kept"))
