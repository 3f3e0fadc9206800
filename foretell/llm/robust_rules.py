"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Each text gets a vector of transformed statistics. For every language and
source, minimum-covariance-determinant estimates give a centre and a scatter
that junk can't pull towards itself: from three fixed starts, concentration
steps on the three quarters of texts that lie closest; the start of the least
determinant goes on until it settles. Small cells lean on their language. Texts
at a large Mahalanobis distance from their cell are rejected. All of it is
DataFrame and SQL expressions: steps are grouped sums, and quantiles are read
from histograms of bounded size, so a cell that holds a third of all rows is
pre-aggregated like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretell.llm.common import SPACE, WORD, checkpointed, join_unique, word_array

#: Fixed limits: too few words, or too large a share (%) of words in repeated triples.
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
#: The coordinates of a text's vector; the floors are added in square to the scatter's diagonal (a regularised
#: determinant), so that a statistic that is constant in a cell, such as no symbols at all, still has a scale.
COORDINATES = {"size": 0.5, "word_length": 0.4, "symbols": 0.3, "repeats": 0.1, "dup_lines": 0.1}
#: Share of a cell's texts that the estimates rest on, and what makes them consistent for normal vectors:
#: share / P(chi2(7) <= the share's quantile of chi2(5)).
SHARE, CONSISTENCY = 0.75, 1.41
#: chi2(5) is beyond this once in a million.
CUTOFF = 35.9
#: Concentration steps before the start of the least determinant is chosen, and after that at most; steps end when no
#: log determinant moves by more than the tolerance.
FIRST_STEPS, STEPS, TOLERANCE = 2, 12, 1e-3
#: A cell's estimates are averaged with its language's, and a language's with all texts', which count like so many texts.
PRIOR = 20
_BINS_PER_UNIT = 32
#: Up to so many rows of estimates (200 bytes each) are sent to every task; more are joined by shuffle but for the heaviest cells.
BROADCAST_CELLS = 20_000
_D = list(COORDINATES)


def statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``n_lines``; null texts count as empty.

    n_repeat_words: words in windows of three that are found twice or more in
    the text, first included. Windows are compared by XXH64: within one text of
    a million words two different ones collide with probability below 1e-7.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    own = [c for c in docs.columns if c not in names]
    # One projection for each array that lambdas look into: as a column it is made once a row, not once an element.
    # Working names begin with a mark that no column of the caller has.
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    w, lines, h, places_of, t = (mark + x for x in "wlhpt")
    own = [F.col(f"`{c.replace('`', '``')}`") for c in own]
    words = docs.select(*own, word_array(F.col("text")).alias(w), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias(lines))
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    counted = words.select(
        *own,
        F.size(w).cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)).alias(h),
    )
    # Most texts repeat no window; only those that do are sorted, to find equal windows side by side.
    places = F.sort_array(F.transform(h, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rest = [F.col(f"`{c.replace('`', '``')}`") for c in counted.columns if c != h]
    placed = counted.select(*rest, F.when(F.size(F.array_distinct(h)) < F.size(h), places).alias(places_of))
    twice = F.filter(places_of, lambda p, k: (p["h"] == F.get(places_of, k - 1)["h"]) | (p["h"] == F.get(places_of, k + 1)["h"]))
    found = placed.select(*rest, F.sort_array(F.transform(twice, lambda p: p["i"])).alias(t))
    covers = F.aggregate(F.transform(t, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(t, k - 1), F.lit(-3)))), F.lit(0), lambda n, c: n + c)
    # Always true, but never the same expression twice: a filter on these columns is then not pushed below the
    # projections above, where each array would be made anew for every element that a lambda looks at.
    here = F.monotonically_increasing_id() >= 0
    return found.select(*own, *names[:4], F.when(here, F.coalesce(covers, F.lit(0)).cast("long")).alias("n_repeat_words"), "n_lines")


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    values = {
        "size": F.log1p("n_words"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "repeats": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    return [values[c].alias(c) for c in _D]


def _quantile_bins(histogram: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For each of ``shares`` the first bin up to which a key's histogram ``(keys, bin, n)`` holds that share of its rows, all in one pass."""
    order = Window.partitionBy(*keys).orderBy("bin")
    total = F.sum("n").over(Window.partitionBy(*keys))
    upto = histogram.select(*keys, "bin", F.sum("n").over(order).alias("upto"), total.alias("total"))
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("bin"))).alias(name) for name, share in shares.items()])


_PAIRS = [(i, j) for i in range(len(_D)) for j in range(i + 1)]
_MOMENTS = [f"m{i}" for i in range(len(_D))] + [f"v{i}{j}" for i, j in _PAIRS]
_STARTS = 3


def _moments(factor: float) -> list[Column]:
    """Centre and scatter from ``n``, sums ``s{i}`` and sums of products ``s{i}{j}``, with the squared floors on the diagonal."""
    mean = [f"s{i} / n AS m{i}" for i in range(len(_D))]
    floor = lambda i, j: f" + {COORDINATES[_D[i]] ** 2}D" if i == j else ""
    return [F.expr(x) for x in mean + [f"{factor}D * (s{i}{j} / n - (s{i} / n) * (s{j} / n)){floor(i, j)} AS v{i}{j}" for i, j in _PAIRS]]


def _sums() -> list[Column]:
    return [F.expr(x) for x in ["count(*) AS n", *[f"sum({c}) AS s{i}" for i, c in enumerate(_D)], *[f"sum({_D[i]} * {_D[j]}) AS s{i}{j}" for i, j in _PAIRS]]]


def _starts(vectors: DataFrame) -> DataFrame:
    """``(cell, start, n, centre, scatter)``: quartiles by coordinate, medians with the floors alone, and all vectors' moments."""
    bins = F.array(*[F.floor(F.least(F.col(c), F.lit(64.0)) * _BINS_PER_UNIT) for c in _D])
    # Written before the windows, so that rows are summed by cell and bin before those of one cell meet.
    histogram = checkpointed(vectors.select("cell", F.posexplode(bins).alias("j", "bin")).groupBy("cell", "j", "bin").agg(F.count("*").alias("n")))
    spread = _quantile_bins(histogram, ["cell", "j"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    pick = lambda j, x: F.max(F.when(F.col("j") == j, x))
    centre = [pick(j, (F.col("mid") + 0.5) / _BINS_PER_UNIT).alias(f"c{j}") for j in range(len(_D))]
    scale = [pick(j, F.pow((F.col("high") - F.col("low")) / _BINS_PER_UNIT / 1.349, 2) + COORDINATES[c] ** 2).alias(f"q{j}") for j, c in enumerate(_D)]
    sums = vectors.groupBy("cell").agg(*_sums())
    known = spread.groupBy("cell").agg(*centre, *scale).join(sums.select("cell", "n", *_moments(1.0)), "cell")

    def start(number: int, scatter: Callable[[int], Column]) -> Column:
        flat = [(scatter(i) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _PAIRS]
        return F.struct(F.lit(number).alias("start"), *[F.col(f"c{j}").alias(f"m{j}") for j in range(len(_D))], *flat)

    quartiles = start(0, lambda j: F.col(f"q{j}"))
    floors = start(1, lambda j: F.lit(COORDINATES[_D[j]] ** 2))
    whole = F.struct(F.lit(2).alias("start"), *_MOMENTS)
    return known.select("cell", "n", F.explode(F.array(quartiles, floors, whole)).alias("s")).select("cell", "s.start", "n", *[f"s.{c}" for c in _MOMENTS])


def _factored(cells: DataFrame) -> DataFrame:
    """``cells`` with the scatter's Cholesky factor ``l{i}{j}`` (with the squared floors on its diagonal it is never singular) and ``logdet``."""
    made = []
    for i, j in _PAIRS:
        rest = f"v{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        made.append(f"sqrt({rest}) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return cells.selectExpr("*", *made, " + ".join(f"2 * ln(l{i}{i})" for i in range(len(_D))) + " AS logdet")


def _with_distance(rows: DataFrame, vector: list[str]) -> DataFrame:
    """``rows``, which have a cell's ``m{i}`` and ``l{i}{j}``, with ``d2``: the squared Mahalanobis distance of ``vector``, by forward substitution."""
    made = [f"({c} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}" for i, c in enumerate(vector)]
    return rows.selectExpr("*", *made, " + ".join(f"y{i} * y{i}" for i in range(len(_D))) + " AS d2").drop(*[f"y{i}" for i in range(len(_D))])


def _joined(rows: DataFrame, cells: DataFrame, keys: list[str], total: int, few: bool) -> DataFrame:
    """``rows`` with their cell's estimates: ``few`` cells are broadcast, else only the heaviest of them."""
    return rows.join(F.broadcast(cells.drop("n")), keys) if few else join_unique(rows, cells, keys, total)


def _concentrate(vectors: DataFrame, cells: DataFrame, total: int, few: bool) -> DataFrame:
    """One concentration step for ``cells (cell, start, n, ...)``: mean and scatter of the SHARE of each cell's vectors that lie closest, factored, and the log determinant that ``was`` before.

    Sums by cell and bin of distance are written out first, so that only bins
    meet in a cell's task, never its rows, however many tasks there are.
    """
    own = [c for c in cells.columns if c[0] in "ml" and c[1:].isdigit()]
    estimates = cells.select("cell", "start", "n", F.col("logdet").alias("was"), *own)
    joined = _joined(vectors, estimates, ["cell", "start"], total, few)
    near = F.floor(F.log2(F.col("d2") + 1e-9) * _BINS_PER_UNIT).alias("bin")
    placed = _with_distance(joined, _D).select("cell", "start", "was", *_D, near)
    binned = checkpointed(placed.groupBy("cell", "start", "bin").agg(F.max("was").alias("was"), *_sums()))
    key = ["cell", "start"]
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("bin")) - F.col("n")
    whole = F.sum("n").over(Window.partitionBy(*key))
    closest = binned.select("*", before.alias("before"), whole.alias("whole")).where(F.col("before") < SHARE * F.col("whole"))
    names = ["n", *[f"s{i}" for i in range(len(_D))], *[f"s{i}{j}" for i, j in _PAIRS]]
    sums = closest.groupBy(*key).agg(F.max("whole").alias("all"), F.max("was").alias("was"), *[F.sum(c).alias(c) for c in names])
    return checkpointed(_factored(sums.select(*key, "was", F.col("all").alias("n"), *_moments(CONSISTENCY))))


def judge(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without ``with_text``, all but text) and the statistics, ``base_failed``, ``kept`` and ``distance``.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_SHARE % of them in
    repeated triples. kept is false where base_failed, else true where the
    vector's Mahalanobis distance from its cell is within the square root of
    CUTOFF. Cells are language and source (nulls are values of their own), and
    every one has estimates: with n texts they are averaged, n to PRIOR, with
    its language's, which are averaged in the same way with those of all texts.
    Estimates rest on the texts that pass the fixed limits; distance is null
    for the rest. Null, empty and wordless texts fail the fixed limits. Repeated
    rows are rows like any other. A column of ``docs`` that has the name of a
    new one gives way to it. The statistics are taken once and written out.
    """
    docs = docs.drop("base_failed", "kept", "distance")
    measured = statistics(docs)
    measured = checkpointed(measured if with_text else measured.drop("text"))
    named = measured.select(F.struct(*[F.col(f"`{c}`") for c in measured.columns]).alias("own"), _failed().alias("base_failed"), *_cell_key(), *_vector())
    passing, failed = named.where("NOT base_failed"), named.where("base_failed")
    factors = _estimates(passing.select("lang", "source", *_D))
    count, total = factors.agg(F.count("*"), F.sum("n")).first()
    placed = _with_distance(_joined(passing, factors, ["lang", "source"], total or 0, count <= BROADCAST_CELLS), _D)
    verdict = placed.select("own.*", "base_failed", (F.col("d2") <= CUTOFF).alias("kept"), F.sqrt("d2").alias("distance"))
    return verdict.unionByName(failed.select("own.*", "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))


def _cell_key() -> list[Column]:
    """lang and source, as values of their own where null; none is "*"."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in ("lang", "source")]


def _estimates(passing: DataFrame) -> DataFrame:
    """``(lang, source, n, m{i}, l{i}{j})``: centre and factored scatter for every cell of ``passing (lang, source, coordinates)``."""
    star = F.lit("*")
    levels = F.array(*[F.struct(a.alias("lang"), b.alias("source")) for a, b in ((star, star), (F.col("lang"), star), (F.col("lang"), F.col("source")))])
    named = passing.select(F.explode(levels).alias("name"), *_D)
    # Cells go by a hash of their name from here on; vectors are numbers, written out once for all steps.
    number = F.xxhash64("name").alias("cell")
    names = named.select(number, "name.lang", "name.source").distinct()
    vectors = checkpointed(named.select(number, *_D))
    cells = checkpointed(_factored(_starts(vectors)))
    count, total = cells.agg(F.count("*"), F.sum("n")).first()
    few = count <= BROADCAST_CELLS
    begun = vectors.select("*", F.explode(F.array(*[F.lit(k) for k in range(_STARTS)])).alias("start"))
    for _ in range(FIRST_STEPS):
        cells = _concentrate(begun, cells, total or 0, few)
    kept = ["n", *_MOMENTS, *[f"l{i}{j}" for i, j in _PAIRS]]
    best = cells.groupBy("cell").agg(F.min(F.struct("logdet", "start", *kept)).alias("b"))
    cells = checkpointed(best.select("cell", F.lit(0).alias("start"), "b.logdet", *[F.col(f"b.{c}").alias(c) for c in kept]))
    one = vectors.withColumn("start", F.lit(0))
    for _ in range(STEPS):
        cells = _concentrate(one, cells, total or 0, few)
        if not (cells.agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0] or 0) > TOLERANCE:
            break

    def leaning(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
        weight = F.col("n") / (F.col("n") + PRIOR)
        wide = above.select(*keys, *[F.col(c).alias(f"above_{c}") for c in _MOMENTS])
        both = own.join(wide, keys) if keys else own.crossJoin(F.broadcast(wide))  # without keys: one row
        return both.select("lang", "source", "n", *[(weight * F.col(c) + (1 - weight) * F.col(f"above_{c}")).alias(c) for c in _MOMENTS])

    flat = checkpointed(cells.join(names, "cell").select("lang", "source", "n", *_MOMENTS))  # read three times
    by_lang = leaning(flat.where("lang != '*' AND source = '*'"), flat.where("lang = '*'"), [])
    by_cell = leaning(flat.where("source != '*'"), by_lang, ["lang"])
    return checkpointed(_factored(by_cell).drop("logdet", *_MOMENTS[len(_D) :]))
