"""Mixing of sources to target weights by iterative proportional fitting.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

TOLERANCE = 1e-5  # largest relative change of a marginal in the last round
FEW_CELLS = 100_000
SEED = 20240
#: Exponents that flatten each marginal's shares towards equal ones.
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.8}
BUDGET = 0.6


def topic_of(text: Column) -> Column:
    """A topic by the form of the text: tables, links, figures or prose."""
    return F.when(text.contains(" | "), "table").when(text.contains("http"), "links").when(text.rlike("[0-9]{3}"), "figures").otherwise("prose")


def n_tokens(text: Column) -> Column:
    """Words of the text; at least 1, so that an empty text can still be drawn."""
    return F.greatest(F.size(F.split(F.btrim(text), "[ \\x09-\\x0D]+")), F.lit(1)).cast("long")


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    other = {"c_source": F.coalesce("source", F.lit("")), "c_lang": F.coalesce("lang", F.lit("")), "c_topic": topic_of(text), "tokens": n_tokens(text)}
    return docs.drop(*other, "probability", "selected", "u").withColumns(other)


def _change(fitted: DataFrame, names) -> float:
    """The largest relative change of a marginal of w against before."""
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"c_{n}").alias("value")) for n in names)))
    sums = fitted.select(values.alias("x"), "w", "before").groupBy("x").agg(F.sum("w").alias("w"), F.sum("before").alias("before"))
    return sums.agg(F.max(F.abs(F.col("w") - F.col("before")) / F.greatest("before", F.lit(1e-12)))).first()[0] or 0.0


def raked(cells: DataFrame, flatten: dict[str, float] = FLATTEN, budget: float = BUDGET, rounds: int | None = None) -> DataFrame:
    """Cell weights whose marginals meet the targets, none above the cell's own mass.

    cells: c_source, c_lang, c_topic, mass.  The target of a value is its share of mass
    to the power flatten, times budget of all tokens.  Each step scales one marginal to
    its targets and caps at the mass; each round is written, so the plan stays short.  Rounds of
    all three go on until none changes a marginal by more than TOLERANCE of it; with
    rounds, no further than that many.  Values that can't reach their target within the
    cap stay below.
    """
    total, n = cells.agg(F.sum("mass"), F.count(F.lit(1))).first()
    fitted = cells.withColumn("w", F.col("mass") * F.lit(float(budget)))
    for name, power in flatten.items():
        t = cells.groupBy(f"c_{name}").agg(F.pow(F.sum("mass").cast("double"), F.lit(power)).alias("p"))
        scale = t.agg(F.sum("p")).first()[0] or 1.0
        t = t.select(F.col(f"c_{name}").alias("t_key"), (F.col("p") * F.lit(budget * float(total or 0) / scale)).alias(f"t_{name}"))
        fitted = fitted.join(t, F.col(f"c_{name}") == F.col("t_key")).drop("t_key")
    # Few cells are one partition, in which sums need no exchange; more are dealt by the summed value.
    together = (lambda df: df.coalesce(1)) if n <= FEW_CELLS else (lambda df: df)
    fitted = together(saved(together(fitted), "mix-cells"))
    done = 0
    while rounds is None or done < rounds:
        fitted = fitted.withColumn("before", F.col("w"))
        for name in flatten:
            reached = F.sum("w").over(Window.partitionBy(f"c_{name}"))
            fitted = fitted.withColumn("w", F.least(F.col("w") * F.col(f"t_{name}") / F.greatest(reached, F.lit(1e-12)), F.col("mass").cast("double")))
        fitted = together(saved(fitted, "mix-cells"))
        done += 1
        if _change(fitted, flatten) <= TOLERANCE:
            break
    return fitted.drop("before", *(f"t_{name}" for name in flatten))


def residuals(cells: DataFrame, fitted: DataFrame, flatten: dict[str, float] = FLATTEN, budget: float = BUDGET) -> DataFrame:
    """name, value, target, reached and share_off (1 - reached / target) of every marginal after raking."""
    total = cells.agg(F.sum("mass")).first()[0] or 0
    out = None
    for name, power in flatten.items():
        t = cells.groupBy(F.col(f"c_{name}").alias("value")).agg(F.pow(F.sum("mass").cast("double"), F.lit(power)).alias("p"))
        scale = t.agg(F.sum("p")).first()[0] or 1.0
        w = fitted.groupBy(F.col(f"c_{name}").alias("r_value")).agg(F.sum("w").alias("reached"))
        part = t.join(w, F.col("value") == F.col("r_value")).select(F.lit(name).alias("name"), "value", (F.col("p") * F.lit(budget * float(total) / scale)).alias("target"), "reached")
        out = part if out is None else out.union(part)
    return out.withColumn("share_off", 1 - F.col("reached") / F.col("target"))


def mixed(docs: DataFrame, flatten: dict[str, float] = FLATTEN, budget: float = BUDGET, rounds: int | None = None, seed: int = SEED) -> DataFrame:
    """docs with c_source, c_lang, c_topic, tokens, probability and selected.

    Token mass is added up for each (source, lang, topic); the cells are raked to the
    target marginals; a document's probability is its cell's weight over its mass, and
    it is selected if a hash of seed, doc_id and text, as a number in [0, 1), is below
    it.  So a re-run selects the same rows, and equal rows go together.  A null source
    or language is a value of its own, the empty string; a null text is empty.  Tokens are
    counted as words, a measure that SQL has.  Texts are read whole; a draw that equals the
    probability isn't selected.  An empty
    table gives no rows.  Columns named like the new ones are replaced.
    """
    named = _named(docs)
    cells = saved(named.groupBy("c_source", "c_lang", "c_topic").agg(F.sum("tokens").alias("mass")), "mix-cells")
    fitted = raked(cells, flatten, budget, rounds)
    rates = fitted.select(F.col("c_source").alias("r_source"), F.col("c_lang").alias("r_lang"), F.col("c_topic").alias("r_topic"), (F.col("w") / F.col("mass")).alias("probability"))
    out = named.join(rates, (F.col("c_source") == F.col("r_source")) & (F.col("c_lang") == F.col("r_lang")) & (F.col("c_topic") == F.col("r_topic"))).drop("r_source", "r_lang", "r_topic")
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return out.withColumn("selected", u < F.col("probability"))
