"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Document rates as near as possible to 1 (in relative
entropy), none above MOST, whose words add up to the targets, are exponentially tilted:

    rate = min(MOST, exp(lambda_source * size / mean size of the source)).

The multipliers solve the convex dual; its gradient for a source is the words its rates take less its
target, its second derivative the tilted sum of squares. Each Newton iteration is one Spark aggregation over
(source, size) cells, since rates depend on nothing else; steps are taken on the logarithm and kept
in the bracket that earlier iterations have found. The state of an iteration is a written table.

Rates become copies without losing the balance: in each source the fractional parts are summed up in order of
size, and a cell gets as many extra copies as whole numbers are passed, so the words taken stay within about
one document of what the rates ask. Inside a cell the documents with the lowest hash get them. Cells are parted
by hash for that, so a cell may hold any share of the rows.

Targets: weights repeat over the sources in order of code points (null last) and share all words; a source gets
MOST times its own words at most, and what is above goes to the others by weight until none is above.

A null text has size 0, and so has one without words; such documents are taken once. Null is a source of its own.
Repeated rows count each; they are interchangeable. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymap.llm.tables import WORD, whole_text
from tallymap.session import write_stage

WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken this many times at most, and a target is as many times its source.
MOST = 3.0
#: Relative difference from every target at which the iteration ends.
CLOSE = 1e-9
TURNS = 100
#: Times that what rounding leaves over is made up for.
SETTLED = 3
#: Documents of a cell that are ranked together.
RANKED = 500


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def target_words(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds sid (rank of the source) and target to one row per source with source_size.

    Sources at their limit are those with the least limit per weight. Going through them in that order, the share
    per weight of what is left over is final as soon as the next source can take its own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    limit = most * F.col("source_size")
    ranked = ranked.withColumns({"weight": weight, "limit": limit, "per": limit / weight})
    up = Window.orderBy("per", "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumns({
        "all": F.sum("source_size").over(everything),
        "before": F.coalesce(F.sum("limit").over(up), F.lit(0.0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)),
    })
    # what each unit of weight gets if this source and those behind it are the ones below their limits
    level = (F.col("all") - F.col("before")) / F.col("rest")
    level = F.max(F.when(level <= F.col("per"), level)).over(everything)
    target = F.least("limit", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "sid", "source_size", target.alias("target"))


def _rate(multiplier, scale, most: float):
    return F.least(F.lit(most), F.exp(F.least(F.col("size") / scale * multiplier, F.lit(50.0))))


def multipliers(cells: DataFrame, state: DataFrame, most: float = MOST) -> DataFrame:
    """sid, multiplier and scale of each source, by Newton's iteration.

    ``cells``: sid, size, n. ``state``: sid, target, source_size, n_docs.
    """
    scale = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    none = F.lit(None).cast("double")
    share = F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-300)))
    state = state.where((F.col("target") > 0) & (F.col("source_size") > 0)).select(
        "sid", "target", scale.alias("scale"), share.alias("m"), none.alias("low"), none.alias("high"), F.lit(1.0).alias("off")
    )
    for turn in range(TURNS):
        rate = _rate(F.col("m"), F.col("scale"), most)
        words = F.col("n") * F.col("size") * rate
        steep = F.when(rate < most, words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = cells.join(state, "sid").groupBy("sid").agg(
            F.sum(words).alias("g"), F.sum(steep).alias("h"),
            *(F.first(c).alias(c) for c in ("target", "scale", "m", "low", "high")),
        )
        over = F.col("g") >= F.col("target")
        sums = sums.withColumns({
            "high": F.when(over, F.col("m")).otherwise(F.col("high")),
            "low": F.when(over, F.col("low")).otherwise(F.col("m")),
            "off": F.abs(F.col("g") / F.col("target") - 1),
        })
        newton = F.col("m") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.col("h")
        far = F.greatest(2 * F.abs("m"), F.lit(1.0))  # while one side isn't known
        inside = (newton > F.coalesce("low", F.col("m") - far)) & (newton < F.coalesce("high", F.col("m") + far))
        halfway = (F.coalesce("low", F.col("high") - far) + F.coalesce("high", F.col("low") + far)) / 2
        outer = F.when(F.col("low").isNull(), F.col("m") - far).when(F.col("high").isNull(), F.col("m") + far).otherwise(halfway)
        step = F.when((F.col("h") > 0) & (F.col("g") > 0) & inside, newton).otherwise(outer)
        stay = F.col("off") <= CLOSE
        state = write_stage(
            sums.select("sid", "target", "scale", F.when(stay, F.col("m")).otherwise(step).alias("m"), "low", "high", "off"),
            f"multipliers-{turn}",
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    return state.select("sid", F.col("m").alias("multiplier"), "scale")


def _settled(cells: DataFrame, most: float) -> DataFrame:
    """What rounding leaves a source short of or above its target is made up for by one copy more or less of a document of
    about that size, if that comes nearer. Where ``extra`` is negative, so many documents get one copy less."""
    all_of = Window.partitionBy("sid")
    off = F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).over(all_of)
    cells = cells.withColumn("off", off).withColumn("gap", F.abs(F.abs("off") - F.col("size")))
    more = (F.col("off") > 0) & (F.col("extra") < F.col("n")) & ((F.col("base") < F.floor(F.lit(most))) | (F.col("extra") < 0))
    less = (F.col("off") < 0) & ((F.col("extra") > 0) | ((F.col("base") > 0) & (F.col("extra") > -F.col("n"))))
    fits = (more | less) & (F.col("gap") < F.abs("off"))
    best = F.min(F.when(fits, F.struct("gap", "size"))).over(all_of)
    chosen = fits & (F.col("size") == best["size"])
    extra = F.col("extra") + F.when(chosen, F.signum("off")).otherwise(0).cast("long")
    return cells.withColumn("extra", F.coalesce(extra, F.col("extra"))).drop("off", "gap")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate and copies."""
    sized = write_stage(sizes(docs), "sizes")
    counted = write_stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = target_words(totals.select("source", "source_size"), weights, most)
    targets = write_stage(
        targets.alias("t").join(totals.select("source", "n_docs").alias("n"), F.expr("t.source <=> n.source")).select("t.*", "n_docs"), "targets"
    )
    cells = counted.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("c.*", "sid", "target", "source_size")
    cells = write_stage(cells, "cells")
    solved = multipliers(cells.select("sid", "size", "n"), targets, most)

    rate = F.when(F.col("multiplier").isNull(), F.when(F.col("size") == 0, 1.0).otherwise(0.0)).otherwise(
        _rate(F.col("multiplier"), F.col("scale"), most)
    )
    rated = cells.join(solved, "sid", "left").withColumn("rate", rate).drop("multiplier", "scale")
    # a rate that stands for a whole number is one, or noise would part equal runs differently
    rated = rated.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-7, F.round("rate")).otherwise(F.col("rate")))
    upto = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("n") * (F.col("rate") - F.floor("rate"))
    after = F.floor(F.sum(part).over(upto) + 0.5)
    rated = rated.withColumn("after", after)
    extra = F.col("after") - F.coalesce(F.lag("after").over(Window.partitionBy("sid").orderBy("size")), F.lit(0))
    rated = rated.select(
        "source", "sid", "size", "n", "source_size", "target", "rate", F.floor("rate").alias("base"), extra.alias("extra")
    )
    for turn in range(SETTLED):
        rated = write_stage(_settled(rated, most), f"rates-{turn}")
    rated = rated.withColumn("parts", F.ceil(F.col("n") / RANKED))

    spread = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1))
    placed = (
        sized.alias("d").join(rated.alias("r"), F.expr("d.source <=> r.source AND d.size = r.size"))
        .select("doc_id", "d.source", "d.size", "sid", "source_size", "target", "rate", "base", "extra", "parts")
        .withColumn("h", spread)
        .withColumn("part", F.floor(F.col("h") / float(1 << 52) * F.col("parts")))
    )
    held = placed.groupBy("sid", "size", "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("earlier", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    rank = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("h", "doc_id"))
    ranked = placed.join(held, ["sid", "size", "part"]).withColumn("place", F.col("earlier") + rank)
    one = F.when(F.col("place") <= F.abs("extra"), F.signum("extra")).otherwise(0)
    copies = F.col("base") + one
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """One row per document with the words that the mix takes from it."""
    taken = F.col("copies") * F.col("size")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "rate", "copies")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it."""
    names = docs.columns
    copies = write_stage(mix_sources(docs, weights, most).select("doc_id", "source", "size", "copies"), "copies")
    key = ["doc_id", "source", "size"]
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    key_of = [F.col("doc_id").cast("long"), F.col("source").cast("string"), size]
    # rows that are alike in all three are told apart by their rank
    given = docs.select(F.struct("*").alias("doc"), *(c.alias(f"_{n}") for c, n in zip(key_of, key, strict=True)))
    given = given.withColumn("_rank", F.row_number().over(Window.partitionBy(*(f"_{n}" for n in key)).orderBy(F.lit(0))))
    copies = copies.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("copies")))
    match = F.expr(" AND ".join(f"_{n} <=> {n}" for n in [*key, "rank"]))
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    joined = given.join(copies, match).where("copies > 0").select("doc", F.explode(times).alias("_turn"))
    return joined.select(*(F.col("doc")[n].alias(n) for n in names))
