"""Mixing sources to target weights along a time-varying curriculum.

A source's weight over training time ``t`` in [0, 1] is a schedule of straight
pieces.  Its integral is the source's demand: the mix takes as many words of
the source as its target says, at a rate that follows the schedule.  A source's
documents are laid end to end in the order of a hash, as often as the target
needs (``max_passes`` times at most); the word at which a copy starts, looked up
in the inverse of the cumulative demand, is the copy's training position, and
the mix is range-sorted by position.

Targets share ``budget`` times all words by weight; a source stops at
``max_passes`` times its size and what it can't take is shared anew by the
others until none is above.

A source may hold a third of all rows: its documents are dealt to buckets by
their hash, buckets are totalled (one row each), and words are counted within a
bucket, starting from the total of those before it.

Defined results: null texts have size 0 and take 0; null sources are one source,
the last; repeated rows are documents of their own; an empty table gives no
rows; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import column, stage

#: Weights of the sources by name, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_PASSES = 2
#: Rows that a bucket of a source holds on average, at most.
BUCKET_ROWS = 4_000

#: (time, relative weight) points of the schedules, by the source's place in
#: name order, repeating: level, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def words(text: Column) -> Column:
    """Number of words (runs without space or control white space); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(doc_id: Column) -> Column:
    """60 bits of a digest of the id (null: 0): the order of a source's documents."""
    digest = F.substring(F.md5(doc_id.cast("long").cast("string").cast("binary")), 1, 15)
    return F.coalesce(F.conv(digest, 16, 10).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_passes: int = MAX_PASSES) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``place``, ``weight`` and
    ``target``.  One row a source, so a task can order them."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    table = table.withColumn("ceiling", (F.col("source_size") * max_passes).cast("double"))
    # sources fill up in the order of ceiling / weight; level is what a unit of
    # weight gets once those before a source are full
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    full = F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    rest = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (budget * F.sum("source_size").over(all_rows) - full) / rest
    table = table.withColumn("level", level)
    # in that order, the first source that stays below its ceiling sets the level of all
    nth = F.row_number().over(by_ratio)
    table = table.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct(nth.alias("nth"), "level")))
    open_level = F.min("open").over(all_rows)["level"]
    target = F.least(F.col("ceiling"), F.coalesce(open_level * F.col("weight"), F.col("ceiling")))
    return table.select("source", "source_size", "place", "weight", target.alias("target"))


def _position(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source has met ``share`` (0 to 1) of its demand."""
    result = F.lit(None).cast("double")
    for i, points in enumerate(schedules):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])]
        total, done = sum(areas), 0.0
        time = F.lit(points[-1][0])
        pieces = []
        for (t0, w0), (t1, w1), area in zip(points, points[1:], areas):
            pieces.append((t0, w0, (w1 - w0) / (t1 - t0), done, done + area))
            done += area
        for t0, w0, slope, start, end in reversed(pieces):
            need = share * total - start
            # w0 * x + slope * x^2 / 2 = need, in the form that is stable for any slope
            x = 2 * need / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)))
            time = F.when(share * total < end, t0 + x).otherwise(time)
        result = F.when(place % len(schedules) == i, time).otherwise(result)
    return result


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False,
        carried: list[str] | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``,
    ``target``, ``taken`` (words, repeats counted) and ``positions`` (training
    position of each copy); ``carried`` columns come along as ``in_<name>``.

    The last copy that a source's target reaches is cut there (its words up to
    the target are taken); with ``whole``, it is taken entirely if the target
    reaches its middle and left out if not."""
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), column(source_col).cast("string").alias("source"),
        words(column(text_col).cast("string")).alias("size"), _order(column(id_col)).alias("h"),
        F.xxhash64(column(text_col).cast("string")).alias("text_key"), *[column(c).alias(f"in_{c}") for c in carried or []],
    )
    narrow = stage(rows.select("doc_id", "source", "size", "h"), "mix-sizes")
    sources = stage(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "mix-targets")
    buckets = max(1, -(-narrow.count() // BUCKET_ROWS))
    if not carried:
        rows = narrow.withColumn("text_key", F.lit(0))

    # by the hash's size, so buckets follow its order
    of_bucket = F.floor(F.col("h").cast("double") / 2.0**60 * buckets).cast("int")
    totals = narrow.withColumn("bucket", of_bucket).groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).select("source", "bucket", "before")
    totals = totals.join(sources, totals["source"].eqNullSafe(sources["source"])).select(
        totals["source"].alias("of_source"), F.col("bucket").alias("of_bucket"), "before", "source_size", "place", "target")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", of_bucket).withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(totals, rows["source"].eqNullSafe(F.col("of_source")) & (rows["bucket"] == F.col("of_bucket")))

    start = F.col("before") + F.col("offset")
    goal = F.round("target").cast("long")
    passes = range(options.get("max_passes", MAX_PASSES))
    taken, positions = F.lit(0).cast("long"), []
    for n in passes:
        begin = start + n * F.col("source_size")
        if whole:
            part = F.when((goal - begin) * 2 >= F.col("size"), F.col("size")).otherwise(0)
        else:
            part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begin))
        taken = taken + part
        place = _position(F.least(F.lit(1.0), begin / F.greatest(goal, F.lit(1))), F.col("place"))
        positions.append(F.when((part > 0) & (F.col("size") > 0), place))
    rows = rows.withColumn("taken", taken.cast("long")).withColumn("positions", F.array_compact(F.array(*positions)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", *[column(f"in_{c}") for c in carried or []])


def range_sorted(mixed: DataFrame) -> DataFrame:
    """``mixed`` by the position of the first copy; documents that are not
    taken come last."""
    keyed = mixed.withColumn("position", F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))) if "position" not in mixed.columns else mixed
    return keyed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as its
    copies are taken (whole copies only), range-sorted by training position."""
    mixed = mix(docs, id_col, text_col, source_col, whole=True, carried=docs.columns, **options)
    copies = mixed.withColumn("position", F.explode("positions"))
    return range_sorted(copies).select(*[column(f"in_{c}").alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """Query ``op2_mixing`` over table ``documents`` as DuckDB SQL."""
    time = "NULL"
    for i, points in enumerate(SCHEDULES):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])]
        total, done, cases = sum(areas), 0.0, []
        for (t0, w0), (t1, w1), area in zip(points, points[1:], areas):
            slope = (w1 - w0) / (t1 - t0)
            need = f"(share * {total}::DOUBLE - {done}::DOUBLE)"
            at = f"{t0}::DOUBLE + 2 * {need} / ({w0}::DOUBLE + sqrt(greatest(0::DOUBLE, {w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {need})))"
            done += area
            cases.append(f"WHEN share * {total}::DOUBLE < {done}::DOUBLE THEN {at}")
        time = f"CASE WHEN place % {len(SCHEDULES)} = {i} THEN CASE {' '.join(cases)} ELSE {points[-1][0]}::DOUBLE END ELSE {time} END"
    part = lambda n: f"greatest(0, least(size, goal - (start + {n} * source_size)))"
    weights = ", ".join(f"{w}.0" for w in WEIGHTS)
    return rf"""
        WITH docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 0) AS h FROM documents),
        sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
        places AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place, {MAX_PASSES} * source_size::DOUBLE AS ceiling FROM sizes),
        weighed AS (SELECT *, ([{weights}])[place % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM places),
        levels AS (
            SELECT *, row_number() OVER r AS nth,
                   ({BUDGET}::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
            FROM weighed WINDOW r AS (ORDER BY ceiling / weight, place),
                                b AS (ORDER BY ceiling / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        opened AS (SELECT min_by(level, nth) AS level FROM levels WHERE level * weight <= ceiling),
        targets AS (SELECT source, source_size, place, least(ceiling, coalesce((SELECT level FROM opened) * weight, ceiling)) AS target FROM weighed),
        laid AS (
            SELECT d.doc_id, d.size, t.source_size, t.place, t.target, round(t.target)::BIGINT AS goal,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        taken AS (SELECT *, {part(0)} AS first_part, {part(1)} AS second_part, least(1::DOUBLE, start::DOUBLE / greatest(goal, 1)) AS share FROM laid)
        SELECT doc_id, size, source_size, target, (first_part + second_part)::BIGINT AS taken,
               CASE WHEN first_part > 0 AND size > 0 THEN {time} ELSE 2.0::DOUBLE END AS position FROM taken"""
