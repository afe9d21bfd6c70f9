"""License scan: canonical digests of entire texts, joined to known ones.

A text's canonical form has lower-case words with single spaces, no copyright
lines and one spelling of words that have several; its SHA-256 is equality
joined to the digests of known licence texts.  The same is done with each line
as an entire text, so a licence statement on a line of its own is found.

Long licences are known by their digest alone.  Column functions and joins only.
The known digests are a fixed list of a few dozen rows, so their side of the join is broadcast.

Defined results: null and empty texts have the digest of the empty text and no
licence; every input row gives one output row; null ids are kept; a digest that
several licences share names them all, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import texts
from ledgerlake.llm.license_texts import DIGESTS, KNOWN, SPELLINGS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"\n[^a-z0-9\n]*(copyright[ \t:]*(\(c\)|©|[0-9]{4})|copyright[ \t]+(the|by)[ \t]|(\(c\)|©)[ \t]*(copyright|[0-9]{4})|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    lower = F.translate(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), UPPER, LOWER)
    words = F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, ""), NOT_WORD, " ")
    words = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for spelling, chosen in SPELLINGS:
        words = F.replace(words, F.lit(spelling), F.lit(chosen))
    return F.trim(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """``digest`` and ``license``: one row a digest, of ``known`` (name and text)
    and ``digests`` (name and digest of the canonical text)."""
    pairs = lambda second, rows: F.array(*[F.struct(F.lit(name).alias("license"), F.lit(x).alias(second)) for name, x in rows])
    listed = spark.range(1).select(F.inline(pairs("text", known))).select("license", digest(F.col("text")).alias("digest"))
    if digests:
        listed = listed.unionByName(spark.range(1).select(F.inline(pairs("digest", digests))))
    return listed.groupBy("digest").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``text_digest``, ``license`` (of the whole text, or null) and
    ``line_licenses`` (of its lines: distinct names joined by commas, or null)."""
    known = F.broadcast(known if known is not None else known_digests(docs.sparkSession))
    rows = texts(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    whole = rows.select("doc_id", "row_key", digest(F.col("text")).alias("text_digest"))
    whole = whole.join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    lines = rows.select("row_key", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    found = lines.select("row_key", digest(F.col("line")).alias("digest")).join(known, "digest")
    found = found.groupBy("row_key").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"))
    return whole.join(found, "row_key", "left").select("doc_id", "text_digest", "license", "line_licenses")


def oracle_sql(known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> str:
    """The same scan of table ``documents`` as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        lower = f"translate(chr(10) || coalesce({text}, ''), '{UPPER}', '{LOWER}')"
        words = f"regexp_replace(regexp_replace({lower}, {quote(COPYRIGHT_LINE)}, '', 'g'), {quote(NOT_WORD)}, ' ', 'g')"
        words = f"' ' || trim({words}, ' ') || ' '"
        for spelling, chosen in SPELLINGS:
            words = f"replace({words}, {quote(spelling)}, {quote(chosen)})"
        return f"sha256(trim({words}, ' '))"

    pairs = lambda rows: ", ".join(f"({quote(name)}, {quote(x)})" for name, x in rows)
    listed = f"SELECT license, {form('text')} AS digest FROM (VALUES {pairs(known)}) AS t(license, text)"
    if digests:
        listed += f" UNION ALL FROM (VALUES {pairs(digests)}) AS t(license, digest)"
    return f"""
        WITH known AS (
            SELECT digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license
            FROM ({listed}) GROUP BY digest),
        rows AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
        lines AS (SELECT n, {form('line')} AS digest FROM (SELECT n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM rows)),
        found AS (SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM lines JOIN known USING (digest) GROUP BY n),
        whole AS (SELECT n, doc_id, {form('text')} AS text_digest FROM rows)
        SELECT doc_id, text_digest, license, line_licenses
        FROM whole LEFT JOIN known ON text_digest = digest LEFT JOIN found USING (n)"""
