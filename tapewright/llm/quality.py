"""Quality rules: counts over whole texts, then robust multivariate outliers.

Every document gets counts from built-in functions. Documents that pass the
base rules become vectors of four transformed statistics, stored as integers
(1/1024 of a binary logarithm), so that all sums are exact and the result does
not depend on how rows are dealt out.

A minimum covariance determinant estimate is made for all rows, for each
language, and for each language and source, at once. Three deterministic starts
(median and quartiles alone, or with the correlations of the rows' spatial signs
or of their hyperbolic tangents) are each concentrated: fit mean and covariance on
the closest ``H`` of the rows, measure every row's Mahalanobis distance, keep the
closest ``H`` again, until the determinant stops falling. The start that ends
with the least determinant wins and is reweighted. Last, a language's fit is drawn
to that of all rows, and a source's to its language's, as if ``PRIOR_ROWS`` rows
stood behind the wider fit: a small group leans on it, a large one does not.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: Share of a group's rows that the concentration steps keep.
H = 0.75
#: Deterministic starts of the concentration.
STARTS = ("median", "sign", "tanh")
#: A start's steps end once the logarithm of the determinant falls by no more than this, or after so many.
TOLERANCE, MOST_STEPS = 1e-3, 30
#: What is added to the diagonal of a start's correlations, so that they can be inverted.
RIDGE = 1e-3
#: Share of normal rows that the reweighted fit takes in.
NEAR = 0.975
#: Rows that a wider group's fit counts for in a narrower one's.
PRIOR_ROWS = 100
#: Squared distance beyond which a document is an outlier: 1 - 1e-9 of chi-squared with 4 degrees of freedom.
CUTOFF = 48.0
#: Smallest standard deviation of each statistic, in binary logarithms: word length, symbols, repeated lines, repeated words.
#: Most rows of clean groups have none of the last three, so their spread is 0, and this stands in: one symbol or one
#: repeated line in 100 words is 2.4 floors from none, a phrase of eight words said twice in 200 words 4.5. An outlier
#: is 6.9 floors away, which is in the range of each statistic, so that each can reject by itself.
FLOORS = (0.08, 0.42, 0.42, 0.7)

UNIT = 1024
DIMS = (1, 2, 3, 4)
PAIRS = tuple(combinations_with_replacement(DIMS, 2))
#: A group is all rows (level 0), a language (1) or a language and source (2).
KEYS = ["g_level", "g_lang", "g_source"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-squared for an even ``k``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def consistency(share: float, k: int = len(DIMS)) -> float:
    """Factor that makes the covariance of the closest ``share`` of normal rows unbiased."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def _length(c: Column) -> Column:
    return F.length(c).cast("long")


def _repeated(items: Column, key: str) -> Column:
    """Of a sorted array of structs, those whose ``key`` equals a neighbour's."""
    same = lambda x, j: x[key] == F.get(items, j)[key]
    return F.filter(items, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))


def base_counts(df: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the five counts and ``base_failed``; other columns stay, the text too.

    Words are runs outside ASCII white space. ``n_repeat_words`` counts the words
    that lie in a window of eight words found twice or more in the text. Windows
    are compared by hash first; those with equal hashes are compared as words.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_words": F.filter(F.split(body, SPACE, -1), lambda w: w != ""), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": _length(F.translate(body, " \t\n\x0b\f\r", "")),
            "n_symbols": _length(body) - _length(F.translate(body, SYMBOLS, "")),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.when(
                F.size("_words") >= window,
                F.transform(F.sequence(F.lit(1), F.size("_words") - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window))),
            ),
        }
    ).drop("_lines")
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_order", F.when(twice, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    words = lambda x: F.array_join(F.slice(F.col("_words"), x["i"] + 1, window), " ")
    df = df.withColumn("_alike", F.sort_array(F.transform(_repeated(F.col("_order"), "h"), lambda x: F.struct(words(x).alias("w"), x["i"].alias("i")))))
    df = df.withColumn("_at", F.sort_array(F.transform(_repeated(F.col("_alike"), "w"), lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + window).alias("end"), (a["n"] + F.least(F.lit(window), i + window - a["end"])).alias("n")),
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_words", "_hashes", "_order", "_alike", "_at")


def _vector() -> dict[str, Column]:
    fixed = lambda c: F.round(F.log2(c) * UNIT).cast("long")
    per_100 = lambda c: fixed(1 + 100 * F.col(c) / F.col("n_words"))
    return {"x1": fixed(F.col("word_chars") / F.col("n_words")), "x2": per_100("n_symbols"), "x3": per_100("n_dup_lines"), "x4": per_100("n_repeat_words")}


def _grouped(vectors: DataFrame) -> DataFrame:
    """Every vector once for each of its three groups."""
    group = lambda level, lang, source: F.struct(F.lit(level).alias("g_level"), lang.alias("g_lang"), source.alias("g_source"))
    none, lang = F.lit(""), F.col("lang")
    groups = F.explode(F.array(group(0, none, none), group(1, lang, none), group(2, lang, F.col("source"))))
    return vectors.select(*_X, groups.alias("g")).select(*_X, "g.*")


def _at_share(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the smallest value at or below which each share of the rows lies.

    ``counts`` has a row ``keys, value, n`` for each distinct value; values are
    small integers, so a key's window is short however many rows it stands for.
    """
    w = Window.partitionBy(*keys)
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "total": F.sum("n").over(w)})
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * share), F.col(value))).alias(name) for name, share in shares.items()])


def _rounded(c: Column) -> Column:
    return F.floor(c * UNIT + 0.5)


def _factored(fits: DataFrame) -> DataFrame:
    """Add the Cholesky factor ``l11 .. l44`` and ``logdet`` to fits with means ``m`` and covariances ``c``."""
    for j in DIMS:
        inner = lambda i: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(1, j)), F.lit(0.0))  # noqa: E731, B023
        fits = fits.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner(j), F.lit(1e-6))))
        if j < len(DIMS):
            fits = fits.withColumns({f"l{i}{j}": (F.col(f"c{j}{i}") - inner(i)) / F.col(f"l{j}{j}") for i in DIMS if i > j})
    return fits.withColumn("logdet", 2 * sum((F.log(F.col(f"l{j}{j}")) for j in DIMS), F.lit(0.0)))


_M = [f"m{i}" for i in DIMS]
_C = [f"c{i}{j}" for i, j in PAIRS]
_L = [f"l{j}{i}" for i, j in PAIRS]
_X = [f"x{i}" for i in DIMS]


def _starts(groups: DataFrame) -> DataFrame:
    """For each group and start: the medians, and a covariance of quartile ranges and the start's correlations."""
    long = groups.select(*KEYS, F.posexplode(F.array(*_X)).alias("dim", "v"))
    counts = long.groupBy(*KEYS, "dim", "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = _at_share(counts, [*KEYS, "dim"], "v", {"low": 0.25, "mid": 0.5, "high": 0.75})
    pick = lambda i, c: F.max(F.when(F.col("dim") == i - 1, c))
    spread = lambda i: F.greatest((F.col("high") - F.col("low")) / 1.349, F.lit(FLOORS[i - 1] * UNIT))
    centers = cuts.groupBy(*KEYS).agg(*[pick(i, F.col("mid").cast("double")).alias(f"m{i}") for i in DIMS], *[pick(i, spread(i)).alias(f"d{i}") for i in DIMS])
    centers = materialize(centers, "quality-centers")

    rows = groups.join(centers, KEYS).withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in DIMS})
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in DIMS), F.lit(0.0)))
    rows = rows.withColumn("norm", F.when(norm > 0, norm).otherwise(1.0))
    seen = {"sign": lambda i: F.col(f"z{i}") / F.col("norm"), "tanh": lambda i: F.tanh(f"z{i}")}
    rows = rows.select(*KEYS, *[_rounded(view(i)).alias(f"{name}{i}") for name, view in seen.items() for i in DIMS])
    sums = rows.groupBy(*KEYS).agg(*[F.sum(F.col(f"{name}{i}") * F.col(f"{name}{j}")).alias(f"{name}{i}{j}") for name in seen for i, j in PAIRS])
    found = sums.join(centers, KEYS)

    def covariance(name: str, i: int, j: int) -> Column:
        both = F.col(f"d{i}") * F.col(f"d{j}")
        if name == "median":
            return both if i == j else F.lit(0.0)
        deviation = lambda i: F.sqrt(F.greatest(F.col(f"{name}{i}{i}"), F.lit(1.0)))
        return both * (1.0 + RIDGE) if i == j else F.col(f"{name}{i}{j}") / (deviation(i) * deviation(j)) * both

    one = lambda name: F.struct(F.lit(name).alias("start"), *[covariance(name, i, j).alias(f"c{i}{j}") for i, j in PAIRS])
    found = found.select(*KEYS, *_M, F.explode(F.array(*[one(name) for name in STARTS])).alias("s")).select(*KEYS, *_M, "s.*")
    return _factored(found).withColumn("logdet", F.lit(float("inf")))


def _sums() -> list[Column]:
    """Exact sums in 64 bits: products stay under 2**27, so that 2**36 rows fit."""
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in DIMS], *products]


def _fit(sums: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Means and floored covariances from summed rows."""
    fit = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in DIMS})
    cov = lambda i, j: (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency(share)
    floored = lambda i, j: F.greatest(cov(i, j), F.lit((FLOORS[i - 1] * UNIT) ** 2)) if i == j else cov(i, j)
    return fit.select(*keys, "n", *_M, *[floored(i, j).alias(f"c{i}{j}") for i, j in PAIRS])


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, to vectors that stand beside their fit."""
    for i in DIMS:
        rest = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(1, i)), F.lit(0.0))
        rows = rows.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in DIMS), F.lit(0.0)))


def _step(groups: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step for every fit, in one pass: sums by whole bins of distance, then the closest bins' fit.

    A fit whose determinant does not fall stays; ``fell`` says whether it did.
    """
    keys = [*KEYS, "start"]
    binned = _distance(groups.join(fits.select(*keys, *_M, *_L), KEYS)).withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * 64))
    counts = binned.groupBy(*keys, "bin").agg(*_sums())
    over = Window.partitionBy(*keys)
    counts = counts.withColumns({"before": F.sum("n").over(over.orderBy("bin")) - F.col("n"), "total": F.sum("n").over(over)})
    closest = counts.where(F.col("before") < F.ceil(F.col("total") * H))
    whole = [F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in DIMS], *[f"s{i}{j}" for i, j in PAIRS])]
    new = _factored(_fit(closest.groupBy(*keys).agg(*whole), keys, H))
    values = [*_M, *_C, *_L, "logdet"]
    both = new.select(*keys, F.struct(*values).alias("new")).join(fits.select(*keys, F.struct(*values).alias("old")), keys)
    both = both.withColumn("fell", F.col("new.logdet") < F.col("old.logdet") - TOLERANCE)
    return both.select(*keys, "fell", F.when(F.col("fell"), F.col("new")).otherwise(F.col("old")).alias("fit")).select(*keys, "fell", "fit.*")


def _concentrated(groups: DataFrame) -> DataFrame:
    """Each group's fit of the least determinant."""
    moving = materialize(_starts(groups), "quality-fits")
    settled = None
    for _ in range(MOST_STEPS):
        after = materialize(_step(groups, moving), "quality-fits")
        still = after.where(~F.col("fell"))
        settled = still if settled is None else settled.unionByName(still)
        moving = after.where("fell")
        if moving.isEmpty():
            break
    ended = settled.unionByName(moving)
    best = ended.groupBy(*KEYS).agg(F.min(F.struct("logdet", "start", *_M, *_L)).alias("b"))
    return best.select(*KEYS, *[f"b.{c}" for c in (*_M, *_L)])


def _shrunk(fits: DataFrame) -> DataFrame:
    """Each language's fit drawn to that of all rows, then each source's to its language's."""

    def drawn(level: int, own: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
        parents = parents.select(*on, *[F.col(c).alias(f"p_{c}") for c in (*_M, *_C)])
        both = own.where(F.col("g_level") == level)
        both = both.join(parents, on) if on else both.join(parents.withColumn("g_level", F.lit(level)), "g_level")
        weight = F.col("n") / (F.col("n") + PRIOR_ROWS)
        mixed = lambda c: F.coalesce(F.col(c), F.col(f"p_{c}")) * weight + F.col(f"p_{c}") * (1 - weight)
        return materialize(both.select(*KEYS, *[mixed(c).alias(c) for c in (*_M, *_C)]), "quality-shrunk")

    languages = drawn(1, fits, fits.where("g_level = 0"), [])
    return _factored(drawn(2, fits, languages, ["g_lang"]))


def outlier_distances(stats: DataFrame) -> DataFrame:
    """``row, d2`` for every row of ``stats`` that passed the base rules."""
    rows = stats.where(~F.col("base_failed")).withColumns(_vector())
    rows = rows.select("row", *_X, F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    rows = materialize(rows, "quality-vectors")
    groups = _grouped(rows)
    best = materialize(_concentrated(groups), "quality-best")
    near = _distance(groups.join(best, KEYS)).where(F.col("d2") <= chi2_quantile(NEAR, len(DIMS)))
    own = best.select(*KEYS).join(_fit(near.groupBy(*KEYS).agg(*_sums()), KEYS, NEAR), KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fits = _shrunk(materialize(own, "quality-own")).select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), *_M, *_L)
    return _distance(rows.join(fits, ["lang", "source"])).select("row", "d2")


def _stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    kept = ["id", "lang", "source", "mark", *BASE, "base_failed"]
    rows = base_counts(rows.withColumn("mark", F.xxhash64("text", "lang", "source"))).select(*kept, F.monotonically_increasing_id().alias("row"))
    return materialize(rows, "quality-stats")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """For every row: id, the five counts, ``base_failed``, ``kept`` and the distance ``d2``.

    ``docs`` needs the columns ``lang`` and ``source``; others are not looked at.
    Null text has no words and fails the base rules. Null language or source
    counts as the empty one. Rows that repeat an id are judged one by one, equal
    rows alike. Texts are counted whole, however long. ``d2`` is null where the base
    rules failed. An empty table gives an empty result.
    """
    return _verdicts(docs, id_col, text_col, cutoff).drop("mark")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, cutoff: float) -> DataFrame:
    stats = _stats(docs, id_col, text_col)
    judged = stats.join(outlier_distances(stats), "row", "left")
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)
    return judged.select(F.col("id").alias(id_col), *BASE, "base_failed", kept.alias("kept"), "d2", "mark")


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_verdicts` keeps, with all their columns.

    A row's verdict follows from its text, language and source, so the rejected
    (id, digest of the three) pairs are anti-joined; ids may repeat or be null.
    """
    gone = _verdicts(docs, id_col, text_col, cutoff).where(~F.col("kept")).select(F.col(id_col).alias("_gone_id"), F.col("mark").alias("_gone_mark"))
    gone = materialize(gone, "quality-gone")
    mark = F.xxhash64(text_col, "lang", "source")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (mark == gone["_gone_mark"]), "left_anti")
