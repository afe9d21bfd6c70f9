"""Merchant cleaning and automatic categorisation.

Categories are learned within a *scope*: the whole data set (``scope=()``) or
each value of some columns, e.g. ``scope=["account_number"]`` learns every
account's categories from that account's rows only, all accounts in parallel.

1. ``description_table`` / ``merchant_table``: distinct descriptions with
   counts (partial aggregation), cleaned once each; merchants per scope.
2. ``learn_categories``: greedy leader grouping in frequency order. A leader
   absorbs every not-yet-grouped frequent merchant of its scope whose
   similarity to it is above the threshold; the first ``max_categories``
   distinct names per scope are kept and a later leader producing an existing
   name replaces the earlier one. A merchant is decided once all earlier ones
   that resemble it are (``functions.independent``), so a round decides many at
   once, all scopes together. The first ``block`` merchants of a scope are
   decided among each other, their leaders absorb the rest through the exact
   similarity join, then the next ``GROWTH`` times as many of what is left: a
   family of any size is absorbed by its leader before its pairs are listed. Per-scope
   name caps are applied with windows over the (small) leader table, and the
   remaining table is checkpointed whenever another round follows.
3. ``assign``: exact (scope, name) -> category equi-join, then a fuzzy pass for
   the remaining frequent merchants (best score, first category on ties),
   again through the similarity join, on distinct names only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import UNCATEGORIZED, UNKNOWN_MERCHANT
from ..functions.independent import first_independent_set
from ..functions.money import pct
from ..functions.ranges import shuffled, staged
from ..functions.similarity import similar_pairs
from ..functions.text import clean_merchant, keywords
from ..session import ensure_checkpoint_dir, python_workers_ready

CM = "clean_merchant"
RANK_TYPE = "struct<neg_count:bigint,name:string>"


def with_clean_merchant(df: DataFrame) -> DataFrame:
    return df.withColumn(CM, clean_merchant(F.col("main_description")))


def description_table(df: DataFrame, *, scope: Sequence[str] = (), amounts: bool = False) -> DataFrame:
    """Distinct (scope, raw description) with row counts and the cleaned name;
    with ``amounts`` also the sum, number and signs of its amounts, from which a
    category's statistics follow without another pass over the rows.

    Cleaning (a chain of regexes) runs once per distinct description instead
    of once per row; everything downstream works on this dictionary."""
    more = []
    if amounts:
        a = F.col("amount")
        more = [F.sum(a).alias("_sum"), F.count(a).alias("_n"), F.count_if(a > 0).alias("_pos"), F.count_if(a < 0).alias("_neg")]
    counts = df.groupBy(*scope, "main_description").agg(F.count(F.lit(1)).alias("description_count"), *more)
    return counts.withColumn(CM, clean_merchant(F.col("main_description")))


def merchant_table(df: DataFrame, *, descriptions: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct cleaned merchants per scope with row counts."""
    d = descriptions if descriptions is not None else description_table(df, scope=scope)
    return d.groupBy(*scope, CM).agg(F.sum("description_count").cast("bigint").alias("merchant_count"))


def rank_key(count, name):
    return F.struct((-count).cast("bigint").alias("neg_count"), name.alias("name"))


def frequent_merchants(
    df: DataFrame, *, min_frequency: int = 5, descriptions: DataFrame | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Frequent merchants with their frequency order key.

    ``merchant_rank`` is the struct (-count, name): ascending order = count
    desc, name asc, and names are unique, so it is a total order that needs no
    global (single-partition) ranking window."""
    counts = merchant_table(df, descriptions=descriptions, scope=scope).where(F.col("merchant_count") >= min_frequency)
    return counts.withColumn("merchant_rank", rank_key(F.col("merchant_count"), F.col(CM)))


def category_names(members: DataFrame, *, scope: Sequence[str] = ()) -> DataFrame:
    """Name of each group from the words of its members.

    ``members``: (scope, leader_rank, leader, clean_merchant, merchant_rank).
    Words are counted over all members; the three most common words of length
    >= 3 that are not all digits (ties: first seen, leader first then frequency
    order) are joined by ``_``; without such words the leader's name with ``_``
    for spaces. Cut to 30 characters, upper case."""
    g = [*scope, "leader_rank"]
    words = members.select(*g, "merchant_rank", F.posexplode(F.split(F.col(CM), " ")).alias("pos", "word"))
    counted = (
        words.where((F.length("word") >= 3) & ~F.col("word").rlike(r"(?U)^\d+$"))
        .groupBy(*g, "word")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("merchant_rank", "pos")).alias("first"))
    )
    w = Window.partitionBy(*g).orderBy(F.col("n").desc(), F.col("first").asc())
    top = counted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 3)
    joined = top.groupBy(*g).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda s: s["word"]), "_").alias("_words")
    )
    leaders = members.where(F.col("merchant_rank") == F.col("leader_rank")).select(*g, "leader")
    return leaders.join(joined, on=g, how="left").select(
        *g,
        "leader",
        F.upper(
            F.substring(F.coalesce(F.col("_words"), F.regexp_replace(F.col("leader"), " ", "_")), 1, 30)
        ).alias("category_name"),
    )


@dataclass
class Categories:
    """Result of ``learn_categories``.

    members: scope, clean_merchant, merchant_rank, leader_rank, category_name,
             category_order, category_id (winning leaders only)
    leaders: scope, leader_rank, leader, category_name, category_id,
             category_order, is_winner (every accepted leader, in order)
    descriptions: the ``description_table`` of ``categorize``, with amounts
    """

    members: DataFrame
    leaders: DataFrame
    scope: list[str] = field(default_factory=list)
    descriptions: DataFrame | None = None  # of the rows learned from, written


#: each batch of merchants is this many times as large as the one before, up to ``MOST``
GROWTH, MOST = 4, 1 << 16


def _grouped(batch: DataFrame, *, similarity: float, smart_grouping: bool, scope: list[str]) -> DataFrame:
    """``batch`` (scope, clean_merchant, merchant_rank) with ``leader_rank``: the
    earliest leader of the batch that each merchant resembles, or itself."""
    if not smart_grouping:
        return batch.withColumn("leader_rank", F.col("merchant_rank"))
    batch = shuffled(batch)
    leads = batch.select(*scope, F.col("merchant_rank").alias("before"), F.col(CM).alias("_leader"))
    pairs = similar_pairs(leads, batch, threshold=similarity, keys=scope, left_id="before", left_text="_leader", right_id="merchant_rank", right_text=CM)
    edges = shuffled(staged(pairs.where(F.col("before") < F.col("merchant_rank")).select(*scope, "before", F.col("merchant_rank").alias("after")), "resembling"))
    leaders, _rounds = first_independent_set(batch.select(*scope, F.col("merchant_rank").alias("node")), edges, scope)
    owner = edges.join(leaders.withColumnRenamed("node", "before"), [*scope, "before"]).groupBy(*scope, F.col("after").alias("merchant_rank")).agg(
        F.min("before").alias("_owner"))
    return batch.join(owner, [*scope, "merchant_rank"], "left").withColumn("leader_rank", F.coalesce("_owner", "merchant_rank")).drop("_owner")


def _scoped_join(a: DataFrame, b: DataFrame, scope: list[str], how: str = "inner") -> DataFrame:
    """Join on the scope columns; with no scope ``b`` is a one-row table."""
    if scope:
        return a.join(b, on=scope, how=how)
    return a.crossJoin(F.broadcast(b))


def learn_categories(
    df: DataFrame,
    *,
    min_frequency: int = 5,
    similarity: float = 0.85,
    smart_grouping: bool = True,
    max_categories: int = 100,
    block: int = 256,
    descriptions: DataFrame | None = None,
    scope: Sequence[str] = (),
) -> Categories:
    """Greedy leader grouping over the frequent merchants of every scope (exact)."""
    spark: SparkSession = df.sparkSession
    ensure_checkpoint_dir(spark)
    python_workers_ready(spark)
    scope = list(scope)
    freq = frequent_merchants(df, min_frequency=min_frequency, descriptions=descriptions, scope=scope)
    # reused inside a round (block pick, absorption, anti-join): persisted;
    # the lineage is cut by a checkpoint only when another round follows
    remaining = freq.select(*scope, CM, "merchant_rank").persist(StorageLevel.MEMORY_AND_DISK)
    held: list[DataFrame] = [remaining]
    scope_fields = [f for f in remaining.schema.fields if f.name in scope]
    member_cols = [*scope, "leader_rank", "leader", CM, "merchant_rank"]
    leaders_acc: DataFrame | None = None
    members_acc: DataFrame | None = None
    while True:
        # next block per scope: at most block + 1 rows per scope
        if scope:
            w = Window.partitionBy(*scope).orderBy("merchant_rank")
            cand = remaining.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= block + 1)
        else:
            cand = remaining.orderBy("merchant_rank").limit(block + 1)
        # the merchant after the batch only tells that the batch is not all
        sizes = cand.groupBy(*scope).agg(F.count(F.lit(1)).alias("_size"), F.max("merchant_rank").alias("_end"))
        cand = shuffled(staged(_scoped_join(cand.select(*scope, CM, "merchant_rank"), sizes, scope), "batch"))
        whole = F.col("_size") <= block
        cand = cand.where(whole | (F.col("merchant_rank") < F.col("_end"))).withColumn("_whole", whole).drop("_size", "_end")
        local = _grouped(cand, similarity=similarity, smart_grouping=smart_grouping, scope=scope).withColumn("leader", F.col("leader_rank.name"))
        local = local.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(local)
        if local.isEmpty():
            break
        # every scope's block held all of its remaining merchants: last round
        last_round = local.where(~F.col("_whole")).isEmpty()
        partial_leaders = local.where(~F.col("_whole") & (F.col("merchant_rank") == F.col("leader_rank")))
        if smart_grouping and not last_round:
            # scopes with more merchants than the block: the block's leaders
            # absorb the rest of their scope through the similarity join
            lead = partial_leaders.select(*scope, "leader_rank", "leader")
            rem = remaining if not scope else remaining.join(lead.select(*scope).distinct(), on=scope, how="left_semi")
            pairs = similar_pairs(
                lead, rem, threshold=similarity, keys=scope,
                left_id="leader_rank", left_text="leader", right_id="merchant_rank", right_text=CM,
            ).where(F.col("merchant_rank") > F.col("leader_rank"))
            first = pairs.groupBy(*scope, "merchant_rank", CM).agg(F.min("leader_rank").alias("leader_rank"))
            absorbed = first.join(lead, on=[*scope, "leader_rank"]).select(*member_cols)
            own = lead.select(*scope, "leader_rank", "leader", F.col("leader").alias(CM), F.col("leader_rank").alias("merchant_rank"))
            members = local.where(F.col("_whole")).select(*member_cols).unionByName(own).unionByName(absorbed)
        else:
            members = local.select(*member_cols)
        members = members.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(members)
        names = category_names(members, scope=scope)
        # per-scope cap on distinct names, counted in leader order
        if leaders_acc is not None:
            prior = leaders_acc.select(*scope, "category_name").distinct().withColumn("_seen", F.lit(True))
            prior_n = leaders_acc.groupBy(*scope).agg(F.countDistinct("category_name").alias("_prior"))
            names = names.join(prior, on=[*scope, "category_name"], how="left")
            names = _scoped_join(names, prior_n, scope, "left")
        else:
            names = names.withColumn("_seen", F.lit(False)).withColumn("_prior", F.lit(0).cast("bigint"))
        first_use = Window.partitionBy(*scope, "category_name").orderBy("leader_rank")
        in_order = Window.partitionBy(*scope).orderBy("leader_rank").rowsBetween(Window.unboundedPreceding, 0)
        names = names.withColumn(
            "_new", ((F.row_number().over(first_use) == 1) & ~F.coalesce(F.col("_seen"), F.lit(False))).cast("int")
        ).withColumn("_cum", F.coalesce(F.col("_prior"), F.lit(0)) + F.sum("_new").over(in_order))
        cutoff = names.where(F.col("_cum") >= max_categories).groupBy(*scope).agg(F.min("leader_rank").alias("_cut"))
        if scope:
            names = names.join(cutoff, on=scope, how="left")
        else:
            # a global aggregate: exactly one row, ``_cut`` null when no cap hit
            names = names.crossJoin(F.broadcast(cutoff))
        accepted = (
            names.where(F.col("_cut").isNull() | (F.col("leader_rank") <= F.col("_cut")))
            .select(*scope, "leader_rank", "leader", "category_name")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        held.append(accepted)
        kept = members.join(accepted.select(*scope, "leader_rank"), on=[*scope, "leader_rank"], how="left_semi")
        leaders_acc = accepted if leaders_acc is None else leaders_acc.unionByName(accepted)
        members_acc = kept if members_acc is None else members_acc.unionByName(kept)
        if last_round:
            break
        leaders_acc = leaders_acc.checkpoint(eager=True)
        members_acc = members_acc.checkpoint(eager=True)
        # drop grouped merchants and scopes that reached the cap
        remaining = remaining.join(members.select(*scope, "merchant_rank"), on=[*scope, "merchant_rank"], how="left_anti")
        if scope:
            remaining = remaining.join(cutoff.select(*scope), on=scope, how="left_anti")
        elif not cutoff.where(F.col("_cut").isNotNull()).isEmpty():
            break
        remaining = remaining.checkpoint(eager=True)
        for frame in held:
            frame.unpersist()
        held = []
        block = max(block, min(block * GROWTH, MOST))
        if remaining.isEmpty():
            break
    if leaders_acc is None:
        rank_t = remaining.schema["merchant_rank"].dataType
        leaders_acc = spark.createDataFrame(
            [],
            StructType(scope_fields + [StructField("leader_rank", rank_t), StructField("leader", StringType()), StructField("category_name", StringType())]),
        )
        members_acc = spark.createDataFrame(
            [],
            StructType(
                scope_fields
                + [
                    StructField("leader_rank", rank_t),
                    StructField("leader", StringType()),
                    StructField(CM, StringType()),
                    StructField("merchant_rank", rank_t),
                ]
            ),
        )
    # the results are small (one row per frequent merchant / leader) but their
    # lineage spans every round; checkpoint them so the plans that use them
    # stay small, then release the round's cached tables
    leaders = _leader_table(leaders_acc, scope).checkpoint(eager=True)
    winners = leaders.where(F.col("is_winner")).select(*scope, "leader_rank", "category_name", "category_order", "category_id")
    members_out = members_acc.join(winners, on=[*scope, "leader_rank"], how="inner").checkpoint(eager=True)
    for frame in held:
        frame.unpersist()
    return Categories(members=members_out, leaders=leaders, scope=scope)


def _leader_table(leaders: DataFrame, scope: list[str]) -> DataFrame:
    """Leaders in order with collision resolution: a name keeps the position
    of its first leader and the contents of its last one. Windows run per
    scope over the leader table (one row per leader)."""
    by_scope = Window.partitionBy(*scope).orderBy("leader_rank")
    by_name = Window.partitionBy(*scope, "category_name")
    t = (
        leaders.withColumn("category_id", F.row_number().over(by_scope).cast("bigint"))
        .withColumn("_first", F.min("leader_rank").over(by_name))
        .withColumn("_last", F.max("leader_rank").over(by_name))
    )
    return t.select(
        *scope,
        "leader_rank",
        "leader",
        "category_name",
        "category_id",
        F.dense_rank().over(Window.partitionBy(*scope).orderBy("_first")).cast("bigint").alias("category_order"),
        (F.col("leader_rank") == F.col("_last")).alias("is_winner"),
    )


def _desc_join(df: DataFrame, mapping: DataFrame, scope: list[str]):
    """Row -> (scope, description) mapping join condition (null-safe on the
    description; mapping scope columns are prefixed ``_s_``)."""
    cond = df["main_description"].eqNullSafe(mapping["_desc"])
    for c in scope:
        cond = cond & (df[c] == mapping[f"_s_{c}"])
    return cond


def category_table(df: DataFrame, cats: Categories, *, descriptions: DataFrame | None = None) -> DataFrame:
    """Per category: merchants, transactions, mean amount, amount pattern,
    keywords (<= 10, sorted), frequency score, confidence, first 3 merchants."""
    scope = cats.scope
    d = descriptions
    if d is None or "_sum" not in d.columns:
        # written once: read by three steps below, whose conditions on the cleaned
        # name would else be pushed below the counting and clean every row's name
        d = staged(description_table(df, scope=scope, amounts=True), "descriptions")
    n_total = d.groupBy(*scope).agg(F.sum("description_count").alias("_n_total"))
    mem = cats.members
    g = [*scope, "category_name"]
    tx_stats = (
        d.join(mem.select(*scope, CM, "category_name"), on=[*scope, CM], how="inner")
        .groupBy(*g)
        .agg(
            F.sum("description_count").alias("transaction_count"),
            (F.sum("_sum").cast("double") / F.when(F.sum("_n") > 0, F.sum("_n"))).alias("avg_amount"),
            F.sum("_pos").alias("_pos"),
            F.sum("_neg").alias("_neg"),
        )
    )
    counts = merchant_table(df, descriptions=d, scope=scope).select(*scope, CM, "merchant_count")
    mem_stats = (
        mem.join(counts, on=[*scope, CM], how="left")
        .groupBy(*g, "category_order", "category_id", "leader_rank")
        .agg(
            F.count(F.lit(1)).alias("merchant_count"),
            F.count_if((F.col(CM) != UNKNOWN_MERCHANT) & (F.length(CM) > 2)).alias("_meaningful"),
            F.max(F.when(F.col("merchant_rank") == F.col("leader_rank"), F.col("merchant_count"))).alias("_leader_count"),
        )
    )
    w_first = Window.partitionBy(*g).orderBy("merchant_rank")
    first3 = (
        mem.withColumn("_k", F.row_number().over(w_first))
        .where(F.col("_k") <= 3)
        .groupBy(*g)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", CM))), lambda s: s[CM]), ", ").alias("sample_merchants"))
    )
    kw = mem.select(*g, F.explode(keywords(F.col(CM))).alias("kw")).distinct()
    w_kw = Window.partitionBy(*g).orderBy("kw")
    kw10 = (
        kw.withColumn("_k", F.row_number().over(w_kw))
        .where(F.col("_k") <= 10)
        .groupBy(*g)
        .agg(F.array_join(F.array_sort(F.collect_list("kw")), ",").alias("keywords"))
    )
    total = F.col("transaction_count")
    pattern = (
        F.when(total.isNull() | (total == 0), F.lit("unknown"))
        .when(F.col("_pos") / total > 0.8, F.lit("mostly_positive"))
        .when(F.col("_neg") / total > 0.8, F.lit("mostly_negative"))
        .otherwise(F.lit("mixed"))
    )
    conf = (
        F.least(F.lit(1.0), F.col("_leader_count") / 50) * 0.4
        + (F.lit(1.0) / F.col("merchant_count")) * 0.3
        + (F.col("_meaningful") / F.col("merchant_count")) * 0.3
    )
    joined = mem_stats.join(tx_stats, on=g, how="left").join(first3, on=g, how="left").join(kw10, on=g, how="left")
    return _scoped_join(joined, n_total, scope).select(
        *scope,
        "category_name",
        "category_id",
        "category_order",
        "merchant_count",
        F.coalesce(total, F.lit(0)).alias("transaction_count"),
        "avg_amount",
        pattern.alias("amount_pattern"),
        F.coalesce(F.col("keywords"), F.lit("")).alias("keywords"),
        (F.col("_leader_count") / F.col("_n_total")).alias("frequency_score"),
        F.round(F.least(F.lit(1.0), conf), 3).alias("confidence_score"),
        "sample_merchants",
    )


def assign(
    df: DataFrame,
    cats: Categories,
    *,
    min_frequency: int = 5,
    similarity: float = 0.85,
    exclude_one_off: bool = True,
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """Add ``auto_category`` and ``category_confidence`` to every row.

    Exact match on the cleaned name (within the scope) -> 1.0; otherwise the
    best fuzzy match of the cleaned name against all categorised merchants of
    the scope (> threshold, first in category order on ties) -> 0.7; otherwise
    UNCATEGORIZED / 0.0. Both steps work on distinct names and join back by
    (scope, description)."""
    scope = cats.scope
    d = descriptions if descriptions is not None else staged(description_table(df, scope=scope), "descriptions")
    exact = cats.members.select(*scope, CM, F.col("category_name").alias("_exact"))
    counts = merchant_table(df, descriptions=d, scope=scope)
    uncat = counts.join(exact, on=[*scope, CM], how="left_anti")
    if exclude_one_off:
        uncat = uncat.where(F.col("merchant_count") >= min_frequency)
    known = cats.members.select(
        *scope,
        F.col(CM).alias("kid"),
        F.col("category_name").alias("_cat"),
        "category_order",
        "merchant_rank",
    )
    uncat_ids = uncat.select(*scope, F.col(CM).alias("uid"), F.col(CM).alias("utext"))
    if uncat_ids.isEmpty():
        # nothing left for the fuzzy stage: skip the similarity join
        best = exact.select(*scope, CM).limit(0).withColumn("_fuzzy", F.lit(None).cast("string"))
    else:
        known_ids = known.select(*scope, "kid", F.col("kid").alias("ktext"))
        pairs = similar_pairs(
            uncat_ids, known_ids, threshold=similarity, keys=scope,
            left_id="uid", left_text="utext", right_id="kid", right_text="ktext",
        )
        ranked = pairs.join(known, on=[*scope, "kid"], how="inner")
        best = ranked.groupBy(*scope, F.col("uid").alias(CM)).agg(
            F.min_by(F.col("_cat"), F.struct(-F.col("score"), F.col("category_order"), F.col("merchant_rank"))).alias("_fuzzy")
        )
    # (scope, description) -> category for categorised descriptions only; every
    # other row is UNCATEGORIZED. The mapping holds descriptions of frequent,
    # categorised merchants, so it is usually small enough for AQE to broadcast
    # it after measuring it, and the rows are then never shuffled.
    mapping = (
        d.select(*scope, "main_description", CM)
        .join(exact, on=[*scope, CM], how="left")
        .join(best, on=[*scope, CM], how="left")
        .where(F.col("_exact").isNotNull() | F.col("_fuzzy").isNotNull())
        .select(
            *[F.col(c).alias(f"_s_{c}") for c in scope],
            F.col("main_description").alias("_desc"),
            F.coalesce(F.col("_exact"), F.col("_fuzzy")).alias("_cat"),
            F.when(F.col("_exact").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.7)).alias("_conf"),
        )
    )
    return (
        df.join(mapping, _desc_join(df, mapping, scope), "left")
        .withColumn("auto_category", F.coalesce(F.col("_cat"), F.lit(UNCATEGORIZED)))
        .withColumn("category_confidence", F.coalesce(F.col("_conf"), F.lit(0.0)))
        .drop("_desc", "_cat", "_conf", *[f"_s_{c}" for c in scope])
    )


def categorize(df: DataFrame, *, scope: Sequence[str] = (), **settings) -> tuple[DataFrame, Categories]:
    """Learn categories from ``df`` (per ``scope``) and label every row."""
    ensure_checkpoint_dir(df.sparkSession)
    scope = list(scope)
    # short lineage (scan + one aggregate), reused by every stage below
    descriptions = description_table(df, scope=scope, amounts=True).checkpoint(eager=True)
    learn_keys = {"min_frequency", "similarity", "smart_grouping", "max_categories", "block"}
    cats = learn_categories(
        df, descriptions=descriptions, scope=scope, **{k: v for k, v in settings.items() if k in learn_keys}
    )
    cats.descriptions = descriptions
    assign_keys = {"min_frequency", "similarity", "exclude_one_off"}
    out = assign(df, cats, descriptions=descriptions, **{k: v for k, v in settings.items() if k in assign_keys})
    return out, cats


def categorisation_stats(categorised: DataFrame, *, by: Sequence[str] = (), cats: Categories | None = None) -> DataFrame:
    """Total / categorised / uncategorised rows and the categorised share; with
    ``cats`` (learned per ``by``) also the number of categories created."""
    out = categorised.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("auto_category") != UNCATEGORIZED).alias("categorized_transactions"),
        F.countDistinct(F.when(F.col("auto_category") != UNCATEGORIZED, F.col("auto_category"))).alias("categories_used"),
    )
    out = out.withColumn("uncategorized_transactions", F.col("total_transactions") - F.col("categorized_transactions")).withColumn(
        "categorized_percentage", pct(F.col("categorized_transactions"), F.col("total_transactions"))
    )
    if cats is not None:
        created = cats.leaders.where("is_winner").groupBy(*by).agg(F.countDistinct("category_name").alias("categories_created"))
        # without keys this is one row
        out = out.join(created, on=list(by), how="left") if by else out.crossJoin(F.broadcast(created))
        out = out.withColumn("categories_created", F.coalesce("categories_created", F.lit(0)))
    return out


def category_distribution(categorised: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return categorised.groupBy(*by, "auto_category").agg(F.count(F.lit(1)).alias("transaction_count"))


def category_summary(df: DataFrame, cats: Categories, *, descriptions: DataFrame | None = None) -> DataFrame:
    """One row per category for review: name, merchants, transactions, mean
    amount, pattern, frequency score and the first three merchants; the
    categories with most transactions first (per scope)."""
    table = category_table(df, cats, descriptions=descriptions).select(
        *cats.scope,
        "category_name",
        "merchant_count",
        "transaction_count",
        "avg_amount",
        "amount_pattern",
        "frequency_score",
        "sample_merchants",
    )
    return table.orderBy(*cats.scope, F.desc("transaction_count"), "category_name")


def export_categories(df: DataFrame, cats: Categories, path: str, *, fmt: str = "parquet") -> str:
    """Write the category summary and the merchant -> category mapping for review."""
    from ..plans.report import write_bundle

    write_bundle(
        {
            "category_summary": category_summary(df, cats),
            "merchant_category": cats.members.select(*cats.scope, CM, "category_name", "category_id", "category_order"),
        },
        path,
        fmt=fmt,
        cluster_by=cats.scope,
    )
    return path
