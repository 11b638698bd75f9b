"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The cells' token counts are raked: in turn for every dimension, each cell
is scaled by its value's target share over its present share, ``ROUNDS`` times.  A document of a cell is then kept with
probability ``c * raked / counted`` tokens, ``c`` being the largest factor that leaves no probability above one; so the kept
tokens have, in expectation, exactly the raked mix.  One rare cell of a large factor makes that ``c`` small for all others.  Where it
would keep less than the share ``least_kept`` of all tokens, the cells are raked again to that share with no cell above its own
tokens, and ``c`` is solved for exactly that share with probabilities held at one; the mix is then as near to the targets as
the rare cells' own tokens allow.  A document is kept if a number drawn from its id's MD5 is below its
probability, so a run that is repeated keeps the same documents.

Texts are read once, in place; what is shuffled are the cells' sums, and each round is written to the shared folder.

Defined results: a null or missing value of a dimension is a value of its own; null and empty texts have no tokens and the
probability of their cell (1 where a whole cell has none); rows that repeat an id are kept or dropped together if they
are in one cell; without rows the result has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import SPACES, materialize, md5_unit
from turnwise.operators.ordering import Ordering, running_sum, scan, total, value_segments

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
TEMPER = 0.9  # default targets: every value's counted share to this power, which lifts rare values
LEAST_KEPT = 0.5  # share of all tokens that the pipeline keeps at least
SEED = "mix"


def n_tokens(text: Column) -> Column:
    """Tokens for the weights: runs of anything but white space."""
    gap = f"[{SPACES}]+"
    return F.coalesce(F.size(F.filter(F.split(text, gap), lambda w: w != "")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """The form of a text, which stands in for a topic where a table has none: table, symbols, note or prose."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    held = lambda chars: size - F.length(F.translate(text, chars, ""))
    return (
        F.when(held("|") * 50 > size, "table").when(held("#*$%&<>") * 20 > size, "symbols").when(size < 500, "note").otherwise("prose")
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): counted shares to a power, as targets."""
    totals = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raised = F.pow(F.col("tokens").cast("double"), F.lit(power))
    whole = totals.agg(F.sum(raised)).first()[0] or 1.0
    return totals.select("value", (raised / F.lit(float(whole))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], name: str, rounds: int = ROUNDS, kept: float | None = None) -> DataFrame:
    """cells(*dimensions, tokens) with ``raked``, the tokens scaled to the target shares (value, share) of every dimension.

    A value without a target keeps nothing.  With ``kept``, the targets are shares of that part of the tokens, and no cell is raked
    above its own tokens.
    """
    whole = (cells.agg(F.sum("tokens")).first()[0] or 0) * (1.0 if kept is None else kept)
    # The shares go to the cells once; a step is then one aggregate by value and one look-up of it.
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        goal = target.select(F.col("value").alias(dimension), (F.col("share") * float(whole)).alias(f"__{dimension}"))
        now = now.join(goal, dimension, "left")
    now = materialize(now, f"{name}_goals")
    for step in range(rounds):
        for dimension in targets:
            held = now.groupBy(dimension).agg(F.sum("raked").alias("__held"))
            scale = F.when(F.col("__held") > 0, F.col(f"__{dimension}") / F.col("__held"))
            raked = F.col("raked") * F.coalesce(scale, F.lit(0.0))
            now = now.join(held, dimension, "left").withColumn("raked", raked if kept is None else F.least(raked, F.col("tokens").cast("double"))).drop("__held")
        now = materialize(now, f"{name}_round{step}")
    return now.select(*cells.columns, "raked")


def solved(raked: DataFrame, kept: float) -> float:
    """The ``c`` for which min(tokens, c * raked) sums to the share ``kept`` of all tokens, or holds every cell it can at one.

    A cell is held at one from ``c = tokens / raked`` on.  Running sums in the order of that number say what each such ``c`` keeps; between
    two of them what is kept grows in proportion.  Cells are cut at quantiles of the number, so no task holds all of them.
    """
    able = raked.where("tokens > 0 and raked > 0").select((F.col("tokens") / F.col("raked")).alias("at"), F.col("tokens").cast("double").alias("tokens"), "raked")
    steps = able.groupBy("at").agg(F.sum("tokens").alias("tokens"), F.sum("raked").alias("raked")).withColumn("all", F.lit(1))
    order = Ordering(("all",), ("at",), "__cut")
    placed = scan(value_segments(steps, "at", 64), order, full=running_sum(F.col("tokens")), part=running_sum(F.col("raked")), free=total(F.sum, F.col("raked")))
    goal = kept * float(raked.agg(F.sum("tokens")).first()[0] or 0)
    reached = F.col("full") + F.col("at") * (F.col("free") - F.col("part")) >= goal
    before = F.struct((F.col("full") - F.col("tokens")).alias("full"), (F.col("free") - F.col("part") + F.col("raked")).alias("free"))
    found = placed.agg(F.min_by(F.when(reached, before), F.when(reached, F.col("at"))).alias("first"), F.max("at").alias("last")).first()
    if found.first is None:
        return found.last or 0.0
    return (goal - found.first.full) / found.first.free


def probabilities(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None, topic_col: str | None = None, power: float = TEMPER, least_kept: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` as (id, *dimensions, n_tokens), and the probability of every cell.

    With ``least_kept``, that share of all tokens is kept at least, in expectation.
    """
    text = F.col(f"`{text_col}`")
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), value("source").alias("source"), value("lang").alias("lang"), (value(topic_col) if topic_col else topic(text)).alias("topic"), n_tokens(text).alias("n_tokens"))
    rows = materialize(rows, f"{name}_rows")
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), f"{name}_cells")
    targets = targets or {d: tempered(cells, d, power) for d in DIMENSIONS}
    raked = rake(cells, targets, name)
    factor = F.col("raked") / F.col("tokens")
    found = raked.where("tokens > 0").agg(F.max(factor).alias("most"), (F.sum("raked") / F.sum("tokens")).alias("raked")).first()
    most = found.most or 1.0
    chance = F.when(F.col("tokens") > 0, factor / F.lit(float(most))).otherwise(1.0)
    if least_kept and found.most and found.raked / most < least_kept:
        raked = rake(cells, targets, f"{name}_least", kept=least_kept)
        chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), factor * F.lit(float(solved(raked, least_kept))))).otherwise(1.0)
    return rows, materialize(raked.select(*DIMENSIONS, chance.alias("probability")), f"{name}_chances")


def drawn(doc_id: Column) -> Column:
    return md5_unit(doc_id, F.lit(SEED))


def mixed(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the draw keeps."""
    _, chances = probabilities(docs, name, id_col, text_col, **how)
    chances = chances.select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.col("probability").alias("__probability"))
    topic_col = how.get("topic_col")
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    marked = docs.withColumn("__s", value("source")).withColumn("__l", value("lang")).withColumn("__t", value(topic_col) if topic_col else topic(F.col(f"`{text_col}`")))
    match = (F.col("__s") == F.col("__source")) & (F.col("__l") == F.col("__lang")) & (F.col("__t") == F.col("__topic")) & (drawn(F.col(f"`{id_col}`")) < F.col("__probability"))
    return marked.join(chances, match, "left_semi").drop("__s", "__l", "__t")
