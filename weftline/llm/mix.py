"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZER, size_rows
from weftline.session import materialize, spread

#: Slices of each source's keys, at their quantiles: COARSE groups of as many slices. Token sums are formed by slice before any row is sorted.
COARSE = 48
#: Slices of a source that a round of the draw reads.
AHEAD = 8


def source_name(col: Column) -> Column:
    """A source in its usual spelling: lower case, no white space around it."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in (0, 1), fixed by the id and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """(documents with the times each is used, report of shares).

    ``docs`` needs doc_id, text and source, ``targets`` source, target_share and max_repeats. Every source gets
    ``target_share * total_tokens``; without ``total_tokens`` the largest total is taken that all sources can fill. A source
    that cannot fill its part gives all it may, and the report shows the share really reached. Whole epochs over a source come
    that cannot fill its part gives all it may, and the report shows the share really reached. Whole epochs over a source come
    first; what is left of its budget is drawn without replacement by Efraimidis-Spirakis keys, weighted by quality, in order of the
    key; a document that no longer fits is passed over, until no document of the source fits. Documents without an id, with a null or unlisted source, and those of no tokens, are not used.
    Repeated rows of one id are drawn together and counted once each. A source without documents is reported with share 0 and limits nothing.

    Plan: one pass over the text writes id, source, size and weight; budgets come from one sum a source. Keys are cut at their own quantiles,
    so slices are even whatever the weights are; their sums are one small table. The draw reads the one slice of each source in which its budget ends, and then
    only slices that hold a document that still fits, so no task sorts a source and no round reads one.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    rows = spread(docs.where("doc_id is not null").select("doc_id", "text", source_name(F.col("source")).alias("source")))
    rows = rows.mapInPandas(size_rows(tokenizer, ["doc_id", "source"], False, True), "doc_id long, source string, n_tokens long, weight double")
    sized = materialize(rows.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()), "mix-sizes")
    size = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("documents"))
    have = t.join(size, "source", "left").na.fill(0, ["source_tokens", "documents"])
    if total_tokens is None:
        whole = have.where((F.col("source_tokens") > 0) & (F.col("target_share") > 0))
        total = whole.agg(F.coalesce(F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("target_share")), F.lit(0.0)).alias("total"))
    else:
        total = sized.sparkSession.range(1).select(F.lit(float(total_tokens)).alias("total"))
    part = F.least(F.col("target_share") * F.col("total"), (F.col("source_tokens") * F.col("max_repeats")).cast("double"))
    plan = (
        have.join(F.broadcast(total))
        .withColumn("budget", F.floor(part + 1e-6).cast("long"))
        .withColumn("epochs", F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens"))
    )
    plan = materialize(plan, "mix-plan")  # a row a source
    keyed = sized.withColumn("key", -F.log(draw(F.col("doc_id"), seed)) / F.col("weight"))
    edges = keyed.groupBy("source").agg(F.percentile_approx("key", [k / COARSE**2 for k in range(1, COARSE**2)], 20 * COARSE**2).alias("edges"))
    keyed = keyed.join(F.broadcast(edges), "source")  # a row a source, of fixed width
    tops = F.transform(F.sequence(F.lit(COARSE), F.lit(COARSE * (COARSE - 1)), F.lit(COARSE)), lambda k: F.get("edges", k - 1))
    coarse = keyed.withColumn("c", F.size(F.filter(tops, lambda e: e < F.col("key"))))
    fine = F.size(F.filter(F.slice("edges", F.col("c") * COARSE + 1, F.lit(COARSE - 1)), lambda e: e < F.col("key")))
    keyed = coarse.withColumn("slice", F.col("c") * COARSE + fine).select("doc_id", "source", "n_tokens", "key", "slice")
    keyed = materialize(keyed.repartitionByRange("slice"), "mix-keys")  # by slice, so that a round reads the files of its slices
    sums = materialize(keyed.groupBy("source", "slice").agg(F.sum("n_tokens").alias("tokens"), F.min("n_tokens").alias("least")), "mix-slices")
    first, picked = draw_rounds(keyed, sums, plan)
    before = keyed.join(F.broadcast(first), "source").where(F.col("slice") < F.col("first")).select("doc_id", "source", "n_tokens")
    drawn = before.withColumn("n", F.lit(1).cast("long"))
    drawn = drawn.unionByName(picked) if picked is not None else drawn
    whole = sized.join(F.broadcast(plan.where("epochs > 0").select("source", "epochs")), "source").select("doc_id", "source", "n_tokens", F.col("epochs").alias("n"))
    used = whole.unionByName(drawn).groupBy("doc_id", "source", "n_tokens").agg(F.sum("n").alias("times_used"))
    used = used.select("doc_id", "source", "n_tokens", "times_used")
    return used, share_report(used, plan)


def take_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """An applyInPandas function over some slices of a source: the documents that fit one after another, in order of their keys, with their number of rows."""
    pdf = pdf.sort_values(["key", "doc_id", "n_tokens"], kind="stable")
    room, took = int(pdf["room"].iloc[0]), []
    for tokens in (pdf["n_tokens"] * pdf["n"]).tolist():
        took.append(tokens <= room)
        room -= tokens if took[-1] else 0
    return pdf.loc[took, ["source", "doc_id", "n_tokens", "n"]]


def draw_rounds(keyed: DataFrame, sums: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(first, picked): for each source the slice in which its budget ends, of which all earlier ones are drawn whole, and the documents
    drawn from that slice on.

    Each round takes, for all sources at once, the next AHEAD slices that hold a document that still fits, and fills what is left from them in order;
    the room shrinks in every round. What reaches the driver is a row a source; the sums are COARSE squared rows a source, in order on one task each."""
    spark = keyed.sparkSession
    by = Window.partitionBy("source").orderBy("slice")
    run = sums.withColumn("before", F.coalesce(F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.join(F.broadcast(plan.select("source", F.col("rest").alias("room"))), "source")
    ends = run.where(F.col("before") + F.col("tokens") > F.col("room")).groupBy("source").agg(F.min_by(F.struct("slice", "before", "room"), "slice").alias("x")).select("source", "x.*")
    whole = sums.groupBy("source").agg((F.max("slice") + 1).alias("past"))
    first = materialize(whole.join(ends, "source", "left").select("source", F.coalesce("slice", "past").alias("first"), (F.col("room") - F.col("before")).alias("room")), "mix-first")
    state = {r["source"]: (r["first"], r["room"]) for r in first.where("room is not null").collect()}
    picked = None
    while state:
        now = spark.createDataFrame([(s, at, room) for s, (at, room) in state.items()], "source string, at int, room long")
        fitting = sums.join(F.broadcast(now), "source").where((F.col("slice") >= F.col("at")) & (F.col("least") <= F.col("room")))
        after = fitting.groupBy("source", "room").agg(F.slice(F.sort_array(F.collect_list("slice")), 1, AHEAD).alias("slices")).collect()
        if not after:
            break
        now = spark.createDataFrame([(r["source"], at, r["room"]) for r in after for at in r["slices"]], "source string, slice int, room long")
        inside = keyed.where(F.col("slice").isin(sorted({at for r in after for at in r["slices"]}))).join(F.broadcast(now), ["source", "slice"])
        inside = inside.groupBy("source", "room", "doc_id", "key", "n_tokens").agg(F.count("*").alias("n"))
        took = materialize(inside.groupBy("source").applyInPandas(take_in_order, "source string, doc_id long, n_tokens long, n long"), "mix-picked")
        used = {r["source"]: r["t"] for r in took.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t")).collect()}
        state = {r["source"]: (r["slices"][-1] + 1, r["room"] - used.get(r["source"], 0)) for r in after if r["room"] > used.get(r["source"], 0)}
        picked = took if picked is None else picked.unionByName(took)
    return first.select("source", "first"), picked


def share_report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """Tokens and share each source really has in the mixture beside its target."""
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("mixed_tokens"), F.count("*").alias("documents_used"), F.max("times_used").alias("most_repeats"))
    out = plan.select("source", "target_share", "max_repeats", "source_tokens", "documents", "budget").join(got, "source", "left").na.fill(0, ["mixed_tokens", "documents_used", "most_repeats"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # a row a source: bounded
    return out.withColumn("actual_share", F.round(F.coalesce(F.try_divide(F.col("mixed_tokens"), whole), F.lit(0.0)), 6))
