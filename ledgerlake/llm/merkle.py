"""Merkle manifest of a table, kept as a postorder append log.

Each value of ``tree_col`` has a tree over its rows in ascending order of id.
Every two consecutive nodes of a level become one of the next; a last one alone
becomes the digest of itself alone; a single row is its own root.  The trees'
roots, ordered by the tree's value, are the leaves of one more tree.

A node is written when its last leaf is: in postorder.  With ``s`` the first
leaf below node ``i`` of level ``l`` (s = i 2^l), all nodes that end before ``s``
are complete and precede it, ``2 s - popcount(s)`` of them, so its position is

    2 s - popcount(s) + size(l, leaves below it) - 1

and siblings are addressed without a search.  Nodes that are full never move
when rows with larger ids are appended.

Work is dealt out in aligned blocks of 2^``height`` leaves: a block is a whole
subtree, so one builder writes its nodes one after the other as one segment of
the log (32 bytes a node; its root stands last).  The roots of the segments are
the leaves of the next round.  Proofs come from the segments: a block's rows
look up their siblings by position, and share the path above the block's root.
Rows are numbered by ranges of (tree, id, digest) and counts of each range, so
neither a tree nor a hot value passes through one task.

Defined results: null values are written as ``-``, texts whole, empty ones as
``0:``; rows that repeat an id are ordered by digest (entirely equal ones are
interchangeable), null ids come first, a null tree value is a tree of its own;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import column, stage

#: Leaves of a segment: 2 to this power.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = "top"  # no tree has this key: others are written as fields
_ITEM = "tree string, idx long, n long, digest string"
_SEGMENT = "tree string, block long, n long, nodes binary"


# --- digests as columns ------------------------------------------------------

def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def proof_digest(steps: Column) -> Column:
    """Digest of the siblings of a proof, lowest level first."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.substr(s, F.lit(2))), "").cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and a proof's siblings lead to."""
    def up(node: Column, step: Column) -> Column:
        other = F.substr(step, F.lit(2))
        return F.sha2(F.when(step.startswith("<"), F.concat(other, node)).otherwise(F.concat(node, other)).cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


# --- one segment -------------------------------------------------------------

def _digest(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def subtree_size(level: int, leaves: int) -> int:
    """Nodes of a subtree of ``level`` levels above ``leaves`` leaves."""
    if leaves == 1 << level:
        return 2 * leaves - 1
    return sum(-(-leaves >> k) for k in range(level + 1))


def position(level: int, index: int, n: int) -> int:
    """Place in the postorder log, from 0, of a node of a tree over ``n`` leaves."""
    start = index << level
    return 2 * start - start.bit_count() + subtree_size(level, min(1 << level, n - start)) - 1


def postorder(leaves: Sequence[bytes], top: int) -> list[bytes]:
    """Nodes of the tree of ``top`` levels over ``leaves``, as they complete."""
    log: list[bytes] = []
    open_nodes: list[bytes] = []  # complete ones without a complete parent
    for i, node in enumerate(leaves):
        log.append(node)
        while i & 1:  # the right child of a pair
            node = _digest(open_nodes.pop(), node)
            log.append(node)
            i >>= 1
        open_nodes.append(node)
    edge = None  # the last node of a level, if it is not full
    for level in range(top):
        if len(leaves) >> level & 1:
            edge = _digest(open_nodes.pop(), *([edge] if edge else []))
        elif edge:
            edge = _digest(edge)
        if edge:
            log.append(edge)
    return log


def steps_of(index: int, n: int, top: int, nodes: bytes) -> list[str]:
    """Siblings of leaf ``index`` from a segment over ``n`` leaves: ``<`` before a
    left one, ``>`` before a right one, ``=`` where the node has none."""
    out = []
    for level in range(top):
        other = (index >> level) ^ 1
        if other << level >= n:
            out.append("=")
            continue
        at = 32 * position(level, other, n)
        out.append(("<" if other & 1 == 0 else ">") + nodes[at : at + 32].hex())
    return out


def _shape(block: int, n: int, height: int) -> tuple[int, int]:
    """(leaves, levels) of a block of a round over ``n`` items."""
    if n <= 1 << height:
        return n, levels(n)
    return min(1 << height, n - (block << height)), height


# --- the log -----------------------------------------------------------------

@dataclass(frozen=True)
class Log:
    """``items``: (tree, idx, n, digest) and what came with them; ``rounds``: the
    segments (tree, block, n, nodes) of each round; ``roots``: (tree, root)."""

    items: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    height: int


@dataclass(frozen=True)
class Manifest:
    trees: Log
    top: Log
    root: str | None


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in their ``tree``, and ``n``,
    the tree's rows.  ``order`` begins with what orders the trees."""
    # a column of its own separates rows that are equal, so a range can end among them
    rows = stage(rows.withColumn("nth", F.monotonically_increasing_id()), "merkle-rows")
    ranged = rows.repartitionByRange(*order, "nth").sortWithinPartitions(*order, "nth")
    ranged = stage(ranged.drop("nth").withColumn("place", F.monotonically_increasing_id()), "merkle-ranges")
    part = F.shiftright("place", 33).alias("part")
    counts = ranged.groupBy("tree", part).agg(F.count("*").alias("here"), F.min("place").alias("first"))
    before = Window.partitionBy("tree").orderBy("part")
    counts = counts.select("tree", "part", (F.sum("here").over(before) - F.col("here") - F.col("first")).alias("shift"),
                           F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    return ranged.withColumn("part", part).join(counts, ["tree", "part"]).withColumn("idx", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _log(items: DataFrame, height: int) -> Log:
    """Builds the log over numbered ``items`` (tree, idx, n, digest)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree, n, block = rows["tree"].iloc[0], int(rows["n"].iloc[0]), int(rows["idx"].iloc[0]) >> height
        nodes = postorder([d.encode() for d in rows["digest"]], _shape(block, n, height)[1])
        return pd.DataFrame({"tree": [tree], "block": [block], "n": [n], "nodes": [bytes.fromhex(b"".join(nodes).decode())]})

    rounds, roots, todo = [], None, items.select("tree", "idx", "n", "digest")
    while True:
        block = F.shiftright("idx", height).alias("block")
        segments = stage(todo.groupBy("tree", block).applyInPandas(build, _SEGMENT), "merkle-log")
        rounds.append(segments)
        made = segments.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / (1 << height)).alias("n"),
                               F.lower(F.hex(F.substring("nodes", -32, 32))).alias("digest"))
        done = made.where("n = 1").select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        todo = made.where("n > 1")
        if todo.isEmpty():
            return Log(items, rounds, roots, height)


def build(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: Sequence[str] = FIELDS,
          height: int = HEIGHT, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``.  ``carry``: further columns, of the rows of
    ``docs``, that go with the leaves to the proofs."""
    own = [c.alias(f"carried_{name}") for name, c in (carry or {}).items()]
    rows = docs.select(column(tree_col).cast("string").alias("value"), column(id_col).cast("long").alias("id"),
                       field(column(tree_col)).alias("tree"), leaf_digest([column(c) for c in fields]).alias("digest"), *own)
    trees = _log(stage(_numbered(rows, ["value", "id", "digest"]), "merkle-items"), height)
    values = trees.items.where("idx = 0").select("tree", "value")
    subroots = trees.roots.join(values, "tree").select(F.lit(_TOP).alias("tree"), "value", F.col("tree").alias("of"), F.col("root").alias("digest"))
    top = _log(stage(_numbered(subroots, ["value"]), "merkle-subroots"), height)
    root = top.roots.first()
    return Manifest(trees, top, root["root"] if root else None)


def log_nodes(log: Log) -> DataFrame:
    """The log as a table: tree, pos (from 0 in each tree), level, idx, digest."""
    height = log.height

    def rows(first_level: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for tree, block, n, nodes, leaves in frame.itertuples(index=False):
                    m, top = _shape(block, n, height)
                    # a round's leaves are the roots of the round before
                    at = [(level, i, 32 * position(level, i, m)) for level in range(first_level > 0, top + 1) for i in range(-(-m >> level))]
                    found = [(tree, position(first_level + level, (block << height >> level) + i, leaves), first_level + level,
                              (block << height >> level) + i, nodes[p : p + 32].hex()) for level, i, p in at]
                    yield pd.DataFrame(found, columns=["tree", "pos", "level", "idx", "digest"])

        return run

    sizes, out = log.items.select("tree", F.col("n").alias("leaves")).distinct(), None
    for nth, segments in enumerate(log.rounds):
        part = segments.join(sizes, "tree").mapInPandas(rows(nth * height), "tree string, pos long, level int, idx long, digest string")
        out = part if out is None else out.unionByName(part)
    return out


def _paths(log: Log, above: DataFrame) -> DataFrame:
    """(tree, block, steps, subroot) of the first round's segments: the steps
    above each segment's root.  ``above``: those above each tree's root."""
    height = log.height

    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, block, n, nodes, steps, subroot in frame.itertuples(index=False):
                m, top = _shape(block, n, height)
                yield pd.DataFrame({"tree": tree, "block": [(block << height) + i for i in range(m)],
                                    "steps": [steps_of(i, m, top, nodes) + list(steps) for i in range(m)], "subroot": subroot})

    schema = "tree string, block long, steps array<string>, subroot string"
    ends = above.select("tree", F.lit(0).cast("long").alias("block"), "steps", "subroot")
    found = None
    for nth in range(len(log.rounds) - 1, -1, -1):
        segments = log.rounds[nth]
        here = segments.where(F.col("n") <= 1 << height).select("tree").join(ends, "tree")  # trees that end in this round
        here = here.select("tree", "block", "steps", "subroot")
        found = here if found is None else here.unionByName(found)
        if nth:
            found = segments.select("tree", "block", "n", "nodes").join(found, ["tree", "block"]).mapInPandas(down, schema)
            found = stage(found, "merkle-paths")
    return found


def _proofs(log: Log, above: DataFrame) -> DataFrame:
    """The items with ``steps`` and ``subroot``."""
    height, names = log.height, log.items.columns
    segments = log.rounds[0].select("tree", "block", "n", "nodes").join(_paths(log, above), ["tree", "block"])

    def look_up(items: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        block, n, nodes = int(own["block"].iloc[0]), int(own["n"].iloc[0]), own["nodes"].iloc[0]
        m, top = _shape(block, n, height)
        path = list(own["steps"].iloc[0])
        items = items[names]
        return items.assign(steps=[steps_of(int(i) - (block << height), m, top, nodes) + path for i in items["idx"]], subroot=own["subroot"].iloc[0])

    items = log.items.withColumn("block", F.shiftright("idx", height))
    more = [T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("subroot", T.StringType())]
    schema = T.StructType([*log.items.schema.fields, *more])
    return items.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInPandas(look_up, schema)


def proofs(manifest: Manifest) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``steps`` (siblings from the leaf
    to the root) and the carried columns of every row."""
    top, trees = manifest.top, manifest.trees
    steps = top.roots.select("tree", F.array().cast("array<string>").alias("steps"), F.col("root").alias("subroot"))
    above = stage(_proofs(top, steps).select(F.col("of").alias("tree"), "steps", F.col("digest").alias("subroot")), "merkle-above")
    carried = [c for c in trees.items.columns if c.startswith("carried_")]
    return _proofs(trees, above).select("id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), "steps",
                                        *[F.col(c).alias(c.removeprefix("carried_")) for c in carried])


def tampered_fields(id_col: str = "doc_id", size_col: str = "n_chars", fields: Sequence[str] = FIELDS) -> Column:
    """The leaf digest of a row whose ``size_col`` is one larger where 7 divides
    the crc32 of the decimal id, else of the row as it is."""
    plain = [column(c) for c in fields]
    changed = [F.try_add(column(c), F.lit(1)) if c == size_col else column(c) for c in fields]
    hit = F.crc32(column(id_col).cast("string").cast("binary")) % 7 == 0
    return F.when(F.coalesce(hit, F.lit(False)), leaf_digest(changed)).otherwise(leaf_digest(plain))


def oracle_sql() -> str:
    def leaf(n_chars: str) -> str:
        values = ["doc_id", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({v})::varchar))::varchar || ':' || ({v})::varchar, '-')" for v in values) + ")"

    # crc32: reflected, polynomial EDB88320
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: {step}))"
    up = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS changed, {crc} % 7 = 0 AS hit FROM documents),
own AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM own GROUP BY lang
  UNION ALL SELECT lang, level + 1, {up} FROM trees WHERE len(nodes) > 1),
subroots AS MATERIALIZED (
  SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM trees WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots HAVING count(*) > 0
  UNION ALL SELECT level + 1, {up} FROM tops WHERE len(nodes) > 1),
steps AS MATERIALIZED (
  SELECT o.doc_id, o.lang, o.idx, t.level AS rung, t.nodes[xor(o.idx >> t.level, 1) + 1] AS other, (o.idx >> t.level) & 1 AS right_one
  FROM own o JOIN trees t ON o.lang IS NOT DISTINCT FROM t.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT o.doc_id, o.lang, o.idx, s.height + t.level, t.nodes[xor(s.place >> t.level, 1) + 1], (s.place >> t.level) & 1
  FROM own o JOIN subroots s ON o.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON len(t.nodes) > 1),
paths AS (
  SELECT lang, idx, list(coalesce(other, '') ORDER BY rung) AS others, list(right_one ORDER BY rung) AS sides FROM steps GROUP BY lang, idx),
folded AS (
  SELECT o.*, p.others, p.sides, list_reduce(
    list_prepend(CASE WHEN hit THEN changed ELSE leaf END, coalesce(list_transform(range(0, len(others)), lambda i: sides[i + 1]::varchar || others[i + 1]), [])),
    lambda a, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM own o LEFT JOIN paths p ON o.lang IS NOT DISTINCT FROM p.lang AND o.idx = p.idx)
SELECT f.doc_id, f.leaf, s.subroot, r.nodes[1] AS root, sha256(coalesce(list_aggregate(others, 'string_agg', ''), '')) AS proof_sha256,
  f.folded_root, f.folded_root = r.nodes[1] AS verified
FROM folded f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang JOIN tops r ON len(r.nodes) = 1"""
