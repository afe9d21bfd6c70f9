"""DuckDB SQL for learned categories: similarity, grouping, names, labels.

The similarity score is stated by its definition: the longest common block of
two strings (the earliest in the first string, then in the second), then the
same for what stands left and right of it.  A recursive table holds the pieces
of every pair, one round of blocks a step; a pair's matched characters are the
sum of its blocks.  Strings are shorter than 200 characters (longer ones would
ignore very frequent characters).

The grouping is stated as a walk over the names in frequency order that carries
the list of leaders so far: a name joins the first of them that it resembles,
else it becomes one.
"""

from __future__ import annotations

from . import oracle as O

#: value of a block: its length first, then the earliest start in the first string
_BLOCK = """coalesce(list_max(list_transform(range(0, length(sa) * length(sa)),
      lambda z: CASE WHEN z // length(sa) + z % length(sa) < length(sa)
                      AND contains(sb, substr(sa, (z // length(sa) + 1)::bigint, (z % length(sa) + 1)::bigint))
                     THEN (z % length(sa) + 1) * 1000 + 999 - z // length(sa) ELSE 0 END)), 0)"""


def similarity_ctes(pairs: str, *, name: str = "sim") -> str:
    """``name`` (a, b, score) for the distinct pairs of the table ``pairs`` (a, b)."""
    return f"""
    {name}_parts AS (
      SELECT a, b, sa, sb, {_BLOCK} AS v FROM (SELECT a, b, a AS sa, b AS sb FROM {pairs})
      UNION ALL
      SELECT a, b, sa, sb, {_BLOCK} AS v FROM (
        SELECT a, b, piece.x AS sa, piece.y AS sb FROM (
          SELECT a, b, unnest([
            struct_pack(x := substr(sa, 1, i), y := substr(sb, 1, strpos(sb, substr(sa, i + 1, k)) - 1)),
            struct_pack(x := substr(sa, i + k + 1), y := substr(sb, strpos(sb, substr(sa, i + 1, k)) + k))]) AS piece
          FROM (SELECT *, (v // 1000)::bigint AS k, (999 - v % 1000)::bigint AS i FROM {name}_parts WHERE v > 0))
        WHERE length(piece.x) > 0 AND length(piece.y) > 0)),
    {name} AS MATERIALIZED (
      SELECT a, b, CAST(2 * sum(v // 1000) AS DOUBLE) / (length(a) + length(b)) AS score FROM {name}_parts GROUP BY a, b)"""


def category_ctes(source: str, descriptions: str, keywords, *, cap: int = 100, group: bool = True, scoped: bool = False,
                  threshold: float = 0.85, frequency: int = 5) -> str:
    """All tables up to ``cats`` (a row for each category), ``members`` and
    ``lab`` (labelled rows).  ``descriptions``: SQL of the cleaned name;
    ``keywords``: function from a name to SQL of its keyword list."""
    s = "account_number" if scoped else "''"
    near = f"""
    pairs AS (SELECT DISTINCT x.clean_merchant AS a, y.clean_merchant AS b FROM r x JOIN r y ON x.s = y.s AND x.clean_merchant <> y.clean_merchant
              WHERE 2.0 * least(length(x.clean_merchant), length(y.clean_merchant)) / (length(x.clean_merchant) + length(y.clean_merchant)) > {threshold}),
    {similarity_ctes("pairs")},
    near AS (SELECT y.s, y.rk, list(x.rk ORDER BY x.rk) AS earlier FROM r x JOIN r y ON x.s = y.s AND x.rk < y.rk
             JOIN sim ON sim.a = x.clean_merchant AND sim.b = y.clean_merchant WHERE sim.score > {threshold} {"" if group else "AND false"} GROUP BY 1, 2),
    walk AS (
      SELECT s, 1::bigint AS rk, 1::bigint AS leader, [1::bigint] AS leaders FROM (SELECT DISTINCT s FROM r)
      UNION ALL
      SELECT s, rk, owner, CASE WHEN owner = rk THEN list_append(leaders, rk) ELSE leaders END FROM (
        SELECT w.s, r.rk, w.leaders, coalesce(list_filter(n.earlier, lambda x: list_contains(w.leaders, x))[1], r.rk) AS owner
        FROM walk w JOIN r ON r.s = w.s AND r.rk = w.rk + 1 LEFT JOIN near n ON n.s = r.s AND n.rk = r.rk))"""
    return f"""txn AS ({O.TXN[source]()}),
    d AS MATERIALIZED (SELECT {s} AS s, main_description, count(*) AS description_count, {descriptions} AS clean_merchant FROM txn GROUP BY 1, 2),
    mc AS (SELECT s, clean_merchant, CAST(sum(description_count) AS BIGINT) AS merchant_count FROM d GROUP BY 1, 2),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY merchant_count DESC, clean_merchant)::bigint AS rk
                       FROM mc WHERE merchant_count >= {frequency}),{near},
    grouped AS MATERIALIZED (SELECT r.*, walk.leader FROM r JOIN walk ON r.s = walk.s AND r.rk = walk.rk),
    w AS (SELECT s, leader, rk, unnest(string_split(clean_merchant, ' ')) AS word,
                 unnest(range(1, len(string_split(clean_merchant, ' ')) + 1)) AS pos FROM grouped),
    wc AS (SELECT s, leader, word, count(*) AS n, min(rk * 1000 + pos) AS fpos FROM w
           WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+') GROUP BY 1, 2, 3),
    wt AS (SELECT *, row_number() OVER (PARTITION BY s, leader ORDER BY n DESC, fpos) AS k FROM wc),
    wj AS (SELECT s, leader, string_agg(word, '_' ORDER BY k) AS words FROM wt WHERE k <= 3 GROUP BY 1, 2),
    nm AS (SELECT g.s, g.rk, g.merchant_count, upper(substr(coalesce(wj.words, replace(g.clean_merchant, ' ', '_')), 1, 30)) AS category_name
           FROM grouped g LEFT JOIN wj ON g.s = wj.s AND g.rk = wj.leader WHERE g.rk = g.leader),
    fl AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY s, category_name ORDER BY rk) = 1 THEN 1 ELSE 0 END AS is_new FROM nm),
    cu AS (SELECT *, sum(is_new) OVER (PARTITION BY s ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM fl),
    cut AS (SELECT s, min(rk) AS c FROM cu WHERE cum >= {cap} GROUP BY 1),
    acc AS (SELECT cu.*, row_number() OVER (PARTITION BY cu.s ORDER BY cu.rk) AS category_id
            FROM cu LEFT JOIN cut ON cu.s = cut.s WHERE cut.c IS NULL OR cu.rk <= cut.c),
    win AS (SELECT *, max(rk) OVER (PARTITION BY s, category_name) AS last_rk, min(rk) OVER (PARTITION BY s, category_name) AS first_rk FROM acc),
    cats AS MATERIALIZED (SELECT s, rk, category_name, category_id, merchant_count AS leader_count, category_order FROM (
               SELECT *, dense_rank() OVER (PARTITION BY s ORDER BY first_rk) AS category_order FROM win) WHERE rk = last_rk),
    members AS MATERIALIZED (SELECT g.*, c.category_name, c.category_id, c.category_order
               FROM grouped g JOIN cats c ON g.s = c.s AND g.leader = c.rk),
    rest AS (SELECT r.s, r.clean_merchant FROM r WHERE NOT EXISTS (
               SELECT 1 FROM members m WHERE m.s = r.s AND m.clean_merchant = r.clean_merchant)),
    fuzzy AS (SELECT rest.s, rest.clean_merchant,
                     arg_min(m.category_name, struct_pack(x := -sim.score, y := m.category_order, z := m.rk)) AS category_name
              FROM rest JOIN members m ON m.s = rest.s JOIN sim ON sim.a = rest.clean_merchant AND sim.b = m.clean_merchant
              WHERE sim.score > {threshold} GROUP BY 1, 2),
    lab AS (SELECT t.*, coalesce(m.category_name, f.category_name, 'UNCATEGORIZED') AS auto_category,
                   CASE WHEN m.category_name IS NOT NULL THEN CAST(1.0 AS DOUBLE) WHEN f.category_name IS NOT NULL THEN CAST(0.7 AS DOUBLE)
                        ELSE CAST(0.0 AS DOUBLE) END AS category_confidence
            FROM txn t LEFT JOIN d ON t.main_description IS NOT DISTINCT FROM d.main_description AND {"t." + s if scoped else s} = d.s
            LEFT JOIN members m ON m.s = d.s AND m.clean_merchant = d.clean_merchant
            LEFT JOIN fuzzy f ON f.s = d.s AND f.clean_merchant = d.clean_merchant),
    tx AS (SELECT d.s, m.category_name, count(*) AS transaction_count, CAST(sum(t.amount) AS DOUBLE) / count(t.amount) AS avg_amount,
                  count(*) FILTER (WHERE t.amount > 0) AS pos, count(*) FILTER (WHERE t.amount < 0) AS neg
           FROM txn t JOIN d ON t.main_description IS NOT DISTINCT FROM d.main_description AND {"t." + s if scoped else s} = d.s
           JOIN members m ON m.s = d.s AND m.clean_merchant = d.clean_merchant GROUP BY 1, 2),
    kw AS (SELECT s, category_name, array_to_string(list_slice(list_sort(list_distinct(flatten(list({keywords("clean_merchant")})))), 1, 10), ',') AS keywords
           FROM members GROUP BY 1, 2),
    ms AS (SELECT s, category_name, count(*) AS merchant_count,
                  count(*) FILTER (WHERE clean_merchant <> 'UNKNOWN' AND length(clean_merchant) > 2) AS meaningful,
                  array_to_string(list_slice(list(clean_merchant ORDER BY rk), 1, 3), ', ') AS sample_merchants FROM members GROUP BY 1, 2),
    nt AS (SELECT s, sum(description_count) AS total FROM d GROUP BY 1),
    category_rows AS (
      SELECT c.s, c.category_name, CAST(c.category_id AS BIGINT) AS category_id, CAST(c.category_order AS BIGINT) AS category_order,
             CAST(ms.merchant_count AS BIGINT) AS merchant_count, CAST(coalesce(tx.transaction_count, 0) AS BIGINT) AS transaction_count, tx.avg_amount,
             CASE WHEN tx.transaction_count IS NULL OR tx.transaction_count = 0 THEN 'unknown'
                  WHEN tx.pos / tx.transaction_count > 0.8 THEN 'mostly_positive'
                  WHEN tx.neg / tx.transaction_count > 0.8 THEN 'mostly_negative' ELSE 'mixed' END AS amount_pattern,
             coalesce(kw.keywords, '') AS keywords, c.leader_count / nt.total AS frequency_score,
             round(least(CAST(1.0 AS DOUBLE),
                         least(CAST(1.0 AS DOUBLE), c.leader_count / 50) * CAST(0.4 AS DOUBLE)
                         + (CAST(1.0 AS DOUBLE) / ms.merchant_count) * CAST(0.3 AS DOUBLE)
                         + (ms.meaningful / ms.merchant_count) * CAST(0.3 AS DOUBLE)), 3) AS confidence_score,
             ms.sample_merchants
      FROM cats c JOIN ms ON ms.s = c.s AND ms.category_name = c.category_name JOIN nt ON nt.s = c.s
      LEFT JOIN tx ON tx.s = c.s AND tx.category_name = c.category_name LEFT JOIN kw ON kw.s = c.s AND kw.category_name = c.category_name)"""


CATEGORY_COLUMNS = ("category_name, category_id, category_order, merchant_count, transaction_count, avg_amount, amount_pattern, "
                    "keywords, frequency_score, confidence_score, sample_merchants")
