"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down the tree of domains, languages and sources by weight. A leaf can take its tokens times the
allowed epochs; what it cannot take goes to its siblings by their weights, and only what a whole family cannot take goes to the
family's siblings. Each leaf then takes whole epochs of all its documents, and of the next epoch, in an order seeded by the
epoch, the documents that start before its budget ends.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, free_name

LEVELS = ("domain", "lang", "source")
#: Rows of a range of a leaf's order, about.
RANGE_ROWS = 4096


@dataclass(frozen=True)
class Mix:
    """Target weights by level and name; names that are not given have the default weight of their level."""

    budget_share: float = 0.6
    max_epochs: int = 2
    seed: int = 17
    weights: Mapping[str, Mapping[str | None, float]] = field(default_factory=dict)
    default: Mapping[str, float] = field(default_factory=dict)


def share_out(nodes: DataFrame, family: list[str], weight: str, capacity: str, amount: str, got: str) -> DataFrame:
    """Adds `got`: each family's amount by weight, where what a node cannot take goes to the others by weight.

    The nodes of a family fill up in the order of capacity by weight; one is full if at its turn its part of what is left, among those
    not yet full, is no less than its capacity. Nodes without weight or capacity get nothing.
    """
    usable = (F.col(weight) > 0) & (F.col(capacity) > 0)
    c, w = F.when(usable, F.col(capacity)).otherwise(0.0), F.when(usable, F.col(weight)).otherwise(0.0)
    all_ = Window.partitionBy(*family)
    order = all_.orderBy(usable.desc(), (c / F.when(usable, w)).asc()).rowsBetween(Window.unboundedPreceding, -1)
    before_c, before_w = (F.coalesce(F.sum(x).over(order), F.lit(0.0)) for x in (c, w))
    full = usable & (c * (F.sum(w).over(all_) - before_w) <= (F.col(amount) - before_c) * w)
    named = nodes.withColumn("is_full", full)
    full = F.col("is_full")
    held = F.sum(F.when(full, c).otherwise(0.0)).over(all_)
    open_ = F.sum(F.when(full, 0.0).otherwise(w)).over(all_)
    part = F.when(full, c).when(usable, F.greatest(F.lit(0.0), w * (F.col(amount) - held) / open_)).otherwise(0.0)
    return named.withColumn(got, part).drop("is_full")


def leaf_budgets(ws: Workspace, totals: DataFrame, mix: Mix) -> DataFrame:
    """totals (domain, lang, source, tokens, m) with `got`: the budget of each leaf.

    The budget is shared out level by level, each family by itself, in tables of one row for a node; only the sum of all tokens comes
    to the driver. A branch's capacity is that of its leaves with a positive weight all the way down.
    """
    spark = ws.spark
    leaves = totals
    for level in LEVELS:
        kind = dict(totals.dtypes)[level]
        given = spark.createDataFrame([(None if k is None else k, float(w)) for k, w in mix.weights.get(level, {}).items()], f"given {kind}, w double")
        # A row for each weight that the caller gave.
        leaves = leaves.join(F.broadcast(given), F.col(level).eqNullSafe(F.col("given")), "left").withColumn(f"w_{level}", F.coalesce("w", F.lit(float(mix.default.get(level, 1.0))))).drop("given", "w")
    leaves = ws.stash(leaves.withColumn("cap", F.col("tokens").cast("double") * mix.max_epochs), "leaves")
    budget = mix.budget_share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    reach = lambda level: F.sum(F.when(F.col(f"w_{level}") > 0, F.col("cap")).otherwise(0.0)).alias("cap")
    langs = leaves.groupBy("domain", "lang", "w_domain", "w_lang").agg(reach("source"))
    domains = langs.groupBy("domain", "w_domain").agg(reach("lang")).withColumn("amount", F.lit(budget))
    domains = share_out(domains.withColumn("root", F.lit(0)), ["root"], "w_domain", "cap", "amount", "got")
    for level, nodes, above in (("lang", langs, ("domain",)), ("source", leaves, ("domain", "lang"))):
        parents = domains if level == "lang" else shared
        parents = parents.select(*(F.col(k).alias(f"up_{k}") for k in above), F.col("got").alias("amount"))
        on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"up_{k}")) for k in above))
        shared = share_out(nodes.join(parents, on).drop(*(f"up_{k}" for k in above)), list(above), f"w_{level}", "cap", "amount", "got")
    return shared.select(*LEVELS, "tokens", "m", "got")


def word_count(text: Column) -> Column:
    """Words, runs without ASCII white space: the tokens that budgets count."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _turn(mix: Mix, epoch: Column, id_: Column) -> Column:
    """Place of a row in the order of an epoch, 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), epoch.cast("long"), id_.cast("long")), 1)


def _range(turn: Column, ranges: Column) -> Column:
    return F.floor(turn / F.lit(2.0**63) * ranges).cast("long")


def _same(left: str, right: str) -> Column:
    a, b, c = (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in LEVELS)
    return a & b & c


def mixture_plan(ws: Workspace, rows: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, whole, cut, cut_tokens) of each leaf of rows (id, domain, lang, source, n_tokens).

    A leaf takes `whole` epochs, and of the next one the rows whose turn is at most cut (null: none); that at the cut
    gives cut_tokens only. Nothing of a leaf is brought to one task: tokens are summed by ranges of the turn, each of about
    4096 rows, and only the range in which a budget ends is ordered row by row. Tables of a row for each leaf are joined as their
    size allows.
    """
    totals = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("m"))
    got = leaf_budgets(ws, totals, mix).withColumn("take", F.floor(F.col("got") + 0.5).cast("long"))
    whole = F.when(F.col("tokens") > 0, F.expr("take div tokens")).otherwise(0).cast("long")
    plan = got.withColumn("whole", whole).withColumn("rest", F.col("take") - F.col("whole") * F.col("tokens")).withColumn("ranges", F.greatest(F.lit(1), F.expr(f"m div {RANGE_ROWS}")).cast("long"))
    plan = ws.stash(plan.select(*LEVELS, "whole", "rest", "ranges"), "budgets")
    turned = rows.alias("r").join(plan.where("rest > 0").alias("p"), _same("r", "p")).select("r.*", "rest", _turn(mix, F.col("whole"), F.col("id")).alias("turn"), "ranges")
    turned = turned.withColumn("range", _range(F.col("turn"), F.col("ranges")))
    sums = turned.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ws.stash(sums.withColumn("before", before).where("before < rest AND before + t >= rest").select(*LEVELS, F.col("range").alias("last"), "before"), "ends")
    edge = turned.alias("r").join(ends.alias("e"), _same("r", "e")).where("range = last").select("r.*", "before")
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("turn")) - F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "turn"))
    edge = edge.withColumn("upto", upto).where("upto < rest")
    cuts = edge.groupBy(*LEVELS).agg(F.max("turn").alias("cut"), F.max_by(F.least("n_tokens", F.col("rest") - F.col("upto")), F.struct("turn", "n_tokens")).alias("cut_tokens"))
    out = plan.alias("r").join(cuts.alias("e"), _same("r", "e"), "left").select("r.*", "cut", "cut_tokens")
    return ws.stash(out.drop("rest", "ranges"), "plan")


def _rows(docs: DataFrame, domain: Column, lang: str, source: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), domain.alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"), word_count(F.col(text_col)).alias("n_tokens"))


def select_mixture(docs: DataFrame, mix: Mix, domain: Column, lang: str = "lang", source: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, domain, lang, source, n_tokens, copies, tokens_taken), one row for each row of docs that the mixture takes.

    copies: in how many epochs the document is; tokens_taken: those copies' tokens, where the last document of a leaf's
    prefix is cut at the leaf's budget. A document is in an epoch if it starts before the budget ends, so one without words
    may be, with no tokens. A null domain, language or source is a name of its own. An epoch's order is by hash of
    seed, epoch and id; rows of one id are taken together, as are rows with a null id. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.stash(_rows(docs, domain, lang, source, id_col, text_col), "rows")
    taken = rows.alias("r").join(mixture_plan(ws, rows, mix).alias("p"), _same("r", "p")).select("r.*", "whole", "cut", "cut_tokens", _turn(mix, F.col("whole"), F.col("id")).alias("turn"))
    more = F.coalesce(F.col("turn") <= F.col("cut"), F.lit(False))
    last = F.when(F.col("turn") == F.col("cut"), F.least("cut_tokens", "n_tokens")).otherwise(F.col("n_tokens"))
    taken = taken.withColumn("copies", F.col("whole") + more.cast("long")).withColumn("tokens_taken", F.col("whole") * F.col("n_tokens") + F.when(more, last).otherwise(0))
    return taken.where("copies > 0").select("id", *LEVELS, "n_tokens", "copies", "tokens_taken")


def keep_mixture(docs: DataFrame, mix: Mix, domain: Column, lang: str = "lang", source: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, once each and with all columns, that select_mixture() takes. Texts are shuffled only if the plan, a row for
    each leaf, is beyond what Spark broadcasts."""
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.stash(_rows(docs, domain, lang, source, id_col, text_col), "rows")
    names = {k: free_name(docs, f"mix_{k}") for k in (*LEVELS, "whole", "cut")}
    plan = mixture_plan(ws, rows, mix).select(*(F.col(k).alias(x) for k, x in names.items()))
    on = domain.eqNullSafe(F.col(names["domain"])) & F.col(lang).eqNullSafe(F.col(names["lang"])) & F.col(source).eqNullSafe(F.col(names["source"]))
    taken = (F.col(names["whole"]) > 0) | (_turn(mix, F.col(names["whole"]), F.col(id_col)) <= F.col(names["cut"]))
    return docs.join(plan, on).where(taken).drop(*names.values())


def source_domain(source: str = "source") -> Column:
    """Domain of a source: one of four groups, by the crc32 of its name."""
    return F.concat(F.lit("domain"), F.crc32(F.col(source).cast("binary")) % 4)


#: Weights of the registered queries: domains alike, other languages than English raised, sources alike.
PRODUCTION = Mix(budget_share=0.6, max_epochs=2, weights={"lang": {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}}, default={"lang": 0.05})


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the production mixture takes, and how often."""
    out = select_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), PRODUCTION, source_domain())
    return out.withColumnRenamed("id", "doc_id")
