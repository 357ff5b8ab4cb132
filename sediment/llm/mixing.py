"""Mixing to target weights with soft membership, from DataFrame operations alone.

A naive Bayes classifier over binned text statistics, counted from a labelled table, gives each document posteriors
over the domains. Projected gradient steps then fit a rate of at least 0 to every document so that the expected tokens
of the domains, each document's tokens times its rate times its posterior, match the targets in the least squares.
A step needs one sum a domain, and a document's rate follows from the steps so far, so nothing else is moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import BROADCAST_IDS, cut, kept_rows

#: Bins of each statistic; smoothing of the counts; share of the strongest domain's evidence that the others keep.
BINS, SMOOTH, FLOOR = 32, 1.0, 1e-6
#: Steps at most, relative error of a domain's tokens at which they end, steps after which rates are written down.
STEPS, CLOSE, KEEP = 200, 1e-4, 8


def statistics(text: Column) -> dict[str, Column]:
    """Bin numbers (0 to BINS - 1) of a text's statistics: shares of symbols, capitals and digits among its
    characters, of distinct words among its words, and the mean length of a word."""
    size = F.greatest(F.length(text), F.lit(1))
    # to count a pattern's matches, Spark lists them all
    left_without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    words = F.split(text, " ")
    values = {
        "symbols": left_without(r"[\p{L}\p{N}\s.,]+") / size * 40,
        "capitals": left_without(r"\P{Lu}+") / size * 40,
        "digits": left_without(r"[^0-9]+") / size * 40,
        "distinct": F.size(F.array_distinct(words)) / F.size(words) * 24,
        "length": size / F.size(words) * 2,
    }
    return {k: F.least(F.floor(v), F.lit(BINS - 1)).cast("int") for k, v in values.items()}


def tokens(text: Column) -> Column:
    """White-space separated words."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def classifier(rows: DataFrame, labels: DataFrame, domains: list[str], names: list[str], label_col: str) -> dict[str, list[list[float]]]:
    """For each statistic and bin, the log-likelihood of every domain, and under ``""`` the log-priors: as many numbers
    as statistics x bins x domains. Rows whose label is no domain don't count; without any all domains are alike."""
    from math import log

    known = labels.select("doc_id", F.col(label_col).cast("string").alias("domain")).filter(F.col("domain").isin(domains))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    pairs = rows.join(known, "doc_id").select("domain", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names])))
    counts = {(r["domain"], r["name"], r["bin"]): r["count"] for r in pairs.groupBy("domain", "name", "bin").count().collect()}
    size = {d: sum(n for (x, name, _), n in counts.items() if x == d and name == names[0]) for d in domains}
    table = {n: [[log((counts.get((d, n, b), 0) + SMOOTH) / (size[d] + SMOOTH * BINS)) for d in domains] for b in range(BINS)] for n in names}
    return table | {"": [[log((size[d] + SMOOTH) / (sum(size.values()) + SMOOTH * len(domains))) for d in domains]]}


def _numbers(table: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])


def _posteriors(table: dict[str, list[list[float]]], names: list[str], n: int) -> Column:
    total = _numbers(table[""])[0]
    for name in names:
        total = F.zip_with(total, F.element_at(_numbers(table[name]), F.col(name) + 1), lambda a, b: a + b)
    scaled = F.transform(total, lambda v: v - F.array_max(total))
    odds = F.transform(scaled, lambda v: F.greatest(F.exp(v), F.lit(FLOOR)))
    whole = F.aggregate(odds, F.lit(0.0), lambda a, v: a + v)
    return F.transform(odds, lambda v: v / whole)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


@dataclass
class Mixture:
    """``rows``: doc_id, n_tokens, posteriors, rate, copies and the kept columns; ``targets`` and ``expected`` tokens by
    domain."""

    rows: DataFrame
    targets: dict[str, float]
    expected: dict[str, float]
    steps: int
    converged: bool


def fit_rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    label_col: str = "quality",
    budget: float | None = None,
    whole: str | None = None,
    repeat: bool = True,
    seed: int = 0,
    keep: tuple[str, ...] = (),
    steps: int = STEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Mixture:
    """Fit rates for ``docs`` so that expected domain tokens are ``weights`` (made to add up to 1) times ``budget``.

    Domains are the keys of ``weights``, values of ``label_col`` in ``labels`` (doc_id and that column). Without a
    ``budget`` it is the one that asks domain ``whole`` for all its tokens or, without that, the largest
    that asks no domain for more tokens than it has. ``copies`` draws each document's
    number of copies from its rate by a hash of its id and ``seed`` (``repeat`` False: 1 at most), so that the expected
    number is the rate. A null text has no tokens; a null id is drawn like any other; rows that repeat an id are
    weighed each for itself; an empty table gives an empty result; other columns are ignored except ``keep``, which must
    not be named like a column of the result. The fit ends when each domain has its target within CLOSE, or after
    ``steps`` steps; ``Mixture.converged`` says which.
    """
    if clash := {"doc_id", "n_tokens", "posteriors", "rate", "copies"} & set(keep):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    domains = sorted(weights)
    share = {d: weights[d] / sum(weights.values()) for d in domains}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stats = statistics(text)
    names = list(stats)
    kept = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), kept.alias("_keep"), tokens(text).alias("n_tokens"), *[v.alias(k) for k, v in stats.items()])
    rows = cut(chosen, "statistics")
    table = classifier(rows, labels.select(F.col(id_col).cast("long").alias("doc_id"), label_col), domains, names, label_col)
    rows = rows.select("doc_id", "_keep", "n_tokens", _posteriors(table, names, len(domains)).alias("posteriors"), F.lit(1.0).alias("rate"))
    rows = cut(rows, "posteriors")

    def sums(frame: DataFrame) -> list[float]:
        each = [F.sum(F.col("n_tokens") * F.col("rate") * F.col("posteriors")[k]) for k in range(len(domains))]
        return [float(v or 0.0) for v in frame.agg(*each).first()]

    mass = sums(rows)
    if budget is None and whole is not None:
        budget = mass[domains.index(whole)] / share[whole]
    if budget is None:
        budget = min((m / share[d] for m, d in zip(mass, domains, strict=True) if share[d] > 0), default=0.0)
    targets = [budget * share[d] for d in domains]
    scale = [max(m, 1e-9) for m in mass]
    now, taken, gradients = rows, 0, []

    def stepped() -> DataFrame:
        if not gradients:
            return now
        rate = F.aggregate(_numbers(gradients), F.col("rate"), lambda x, g: F.greatest(F.lit(0.0), x - _dot(F.col("posteriors"), g)))
        return now.withColumn("rate", rate)

    expected = mass


    def close() -> bool:
        return all(abs(e - t) <= CLOSE * max(t, 1.0) for e, t in zip(expected, targets, strict=True))

    while taken < steps and not close():
        # in units of each domain's own tokens the least squares have steps of length 1
        gradients.append([(e - t) / s for e, t, s in zip(expected, targets, scale, strict=True)])
        taken += 1
        if len(gradients) == KEEP:
            now, gradients = cut(stepped(), f"rates{taken}"), []
        expected = sums(stepped())
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    final = stepped().withColumn("copies", copies if repeat else F.least(copies, F.lit(1)))
    final = final.select("doc_id", *[F.col(f"_keep.{c}") for c in keep], "n_tokens", "posteriors", "rate", "copies")
    return Mixture(final, dict(zip(domains, targets, strict=True)), dict(zip(domains, expected, strict=True)), taken, close())


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``fit_rates`` draws them (of rows that share an id all as
    often as the one drawn most; a null id is an id of its own). Null texts have no tokens, so their rates stay at 1 and
    their rows stay; an empty table gives an empty result.

    Ids to drop, or numbers of copies, are broadcast where their number allows it; more are joined by a shuffle."""
    drawn = fit_rates(docs, labels, weights, id_col=id_col, **options).rows
    if not options.get("repeat", True):
        return kept_rows(docs, drawn.select("doc_id", (F.col("copies") > 0).alias("kept")), id_col)
    drawn = cut(drawn.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")).filter("_copies != 1"), "drawn")
    few = drawn.count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(drawn) if few else drawn, docs[id_col].cast("long").eqNullSafe(drawn["_id"]), "left")
    copies = F.coalesce(drawn["_copies"], F.lit(1))
    again = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(again).alias("_sediment_copy")).drop("_sediment_copy")
