"""Mixing of sources to target weights, by hierarchical budgets. DataFrame functions only.

Leaves are (domain, lang, source). A token budget goes down the tree: each node deals its budget to its
children by weight, but no child gets more than its subtree can supply; what a child cannot take goes to
its siblings, by weight again, until all is placed (weighted water-filling). As a node's supply is the sum
below it, siblings take up a shortage first, and only what a whole subtree lacks reaches its ancestors'
siblings. All of it is integer arithmetic; tokens left over by rounding down go one each to the children with the
largest remainders (ties: smaller name), so that budgets add up exactly.

A leaf that gets `full` times its tokens and a rest gives all its documents `full` times and, from the
next epoch, the shortest prefix of that epoch's seeded order that holds the rest; the last document of the
prefix is cut. The order is by MD5 of seed, epoch, doc_id and the text's MD5, so that null or repeated ids are spread too. The prefix is found in two steps, so that no
leaf is ever sorted as a whole: sums over hash ranges of about `range_rows` documents give the range in
which the prefix ends, and only that range is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

LEVELS = ("domain", "lang", "source")


def words(text: str = "text") -> Column:
    """Whitespace-separated tokens; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def domain_of(source: str = "source", groups: int = 4) -> Column:
    """A domain from a source's number; sources without a number are 'unknown'."""
    number = F.regexp_extract(F.col(source), r"(\d{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "unknown").otherwise(F.concat(F.lit("d"), (number.cast("long") % groups).cast("string")))


def _weight(level: str, weights: dict[str, int]) -> Column:
    """1 where nothing is given."""
    if any(w < 1 or int(w) != w for w in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(38,0)")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children: parent's columns, name, cap, weight, budget (the parent's). Gives each its `given`."""
    key = [F.col(c) for c in parent] or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), name)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    zero = F.lit(0).cast("decimal(38,0)")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    out = children.withColumns({"_c": F.coalesce(F.sum(big("cap")).over(before), zero), "_w": F.coalesce(F.sum("weight").over(before), zero), "_all": F.sum("weight").over(whole)})
    out = out.withColumn("_full", big("cap") * (F.col("_all") - F.col("_w")) <= F.col("weight") * (big("budget") - F.col("_c")))
    out = out.withColumn("_full", F.min("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumns({
        "_rest": big("budget") - F.coalesce(F.sum(F.when(F.col("_full"), big("cap"))).over(whole), zero),
        "_open": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole), zero),
    })
    parts = "CASE WHEN _open = 0 THEN 1 ELSE _open END"
    out = out.withColumns({"_share": F.expr(f"CAST((weight * _rest) div {parts} AS BIGINT)"), "_left": F.expr(f"(weight * _rest) % {parts}")})
    dealt = F.sum(F.when(~F.col("_full"), F.col("_share"))).over(whole)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("_full", F.desc("_left"), name))
    more = F.when(~F.col("_full") & (nth <= F.col("_rest") - F.coalesce(dealt, F.lit(0))), 1).otherwise(0)
    given = F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_share") + more).cast("long")
    return out.withColumn("given", given).drop("_c", "_w", "_all", "_full", "_rest", "_open", "_share", "_left")


def budgets(leaves: DataFrame, total: Column | int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """leaves: the levels' columns, tokens, docs. Adds `budget`, at most max_epochs times the tokens."""
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    up = {n: leaf.groupBy(*LEVELS[:n]).agg(F.sum("cap").alias("cap")) for n in (1, 2)} | {3: leaf.select(*LEVELS, "cap")}
    amount = F.lit(total).cast("long") if isinstance(total, int) else total
    given = None
    for n in (1, 2, 3):
        level = up[n].withColumn("weight", _weight(LEVELS[n - 1], weights.get(LEVELS[n - 1], {})))
        if given is None:
            level = level.withColumn("budget", F.least(amount, F.sum("cap").over(Window.partitionBy(F.lit(0)))))
        else:
            level = level.join(given.select(*LEVELS[: n - 1], F.col("given").alias("budget")), list(LEVELS[: n - 1]))
        given = _fill(level, list(LEVELS[: n - 1]), LEVELS[n - 1])
    return leaves.join(given.select(*LEVELS, F.col("given").alias("budget")), list(LEVELS))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget_tenths: int = 6, budget: int | None = None, max_epochs: int = 2, seed: str = "mix-1", range_rows: int = 2_000, domain: Column | None = None, tokens: Column | None = None, carry: bool = False) -> DataFrame:
    """One row for each document of which anything is selected: doc_id, the leaf, tokens, `epochs` (times
    it is taken whole), `prefix_tokens` (taken in the epoch after those) and `selected_tokens`.

    The budget is `budget` tokens, or that many tenths of all tokens; it is cut to what max_epochs can
    supply. Null lang or source: 'unknown'. A null or empty text has no tokens, and a document without tokens is never
    selected. Rows that repeat are documents each. A null doc_id is ordered as an empty one; of equal ids and texts any may be cut. Very long
    texts are counted whole. Columns besides doc_id, text, lang and source are not looked at, whatever their names.
    An empty table gives no row. With `carry` each row also holds the document it stands for, all columns of `docs` in
    a struct `row`.
    """
    spark = docs.sparkSession
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    leaf = {"domain": domain_of() if domain is None else domain, "lang": F.coalesce("lang", F.lit("unknown")), "source": F.coalesce("source", F.lit("unknown"))}
    sized = save(docs.select("doc_id", leaf["domain"].alias("domain"), leaf["lang"].alias("lang"), leaf["source"].alias("source"), (words() if tokens is None else tokens).alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), *row)).where("tokens > 0")
    few = max(8, spark.sparkContext.defaultParallelism)  # tasks that write a row a leaf
    leaves = save(sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).coalesce(few))
    total = budget
    if total is None:
        total = int(leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_tenths // 10
    plan = budgets(leaves, int(total), weights, max_epochs).select(
        *LEVELS, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"), F.ceil(F.col("docs") / F.lit(range_rows)).cast("long").alias("ranges")
    )
    plan = save(plan.coalesce(few))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))
    at = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32)
    keyed = sized.join(plan, list(LEVELS)).withColumn("_key", key).withColumn("_at", at)
    sums = keyed.groupBy(*LEVELS, "_at").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("_at"))
    # The prefix ends in the range where the running sum first reaches the rest.
    ends = save(sums.withColumn("_to", running).where("_to - n < rest AND rest <= _to").select(*LEVELS, F.col("_at").alias("_end"), (F.col("_to") - F.col("n")).alias("_start")).coalesce(few))
    placed = keyed.join(ends, list(LEVELS), "left")
    inside = placed.where("_at = _end")
    so_far = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("_key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    cut = inside.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least("tokens", F.col("rest") - F.col("_start") - F.coalesce(so_far, F.lit(0)))))
    other = placed.where("_end IS NULL OR _at <> _end").withColumn("prefix_tokens", F.when(F.col("_at") < F.col("_end"), F.col("tokens")).otherwise(F.lit(0)))
    columns = ["doc_id", *LEVELS, "tokens", "epochs", F.col("prefix_tokens").cast("long").alias("prefix_tokens"), *(["row"] if carry else [])]
    out = cut.select(*columns).unionByName(other.select(*columns))
    return out.withColumn("selected_tokens", F.col("epochs") * F.col("tokens") + F.col("prefix_tokens")).where("selected_tokens > 0")


#: Production parameters of the registered query.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SEED = "mix-1"


def _sql_fill(n: int, source: str) -> str:
    """SQL of one level's water-filling over `source` (levels, cap, weight, budget)."""
    parent, name = ", ".join(LEVELS[: n - 1]) or "1", LEVELS[n - 1]
    order = f"PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {name}"
    return f"""
  a{n} AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
    coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0,
    sum(weight) OVER (PARTITION BY {parent}) AS wall FROM {source}),
  b{n} AS (SELECT *, min(CASE WHEN cap * (wall - w0) <= weight * (budget - c0) THEN 1 ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isfull FROM a{n}),
  c{n} AS (SELECT *, budget - coalesce(sum(CASE WHEN isfull = 1 THEN cap END) OVER (PARTITION BY {parent}), 0) AS rest0,
    coalesce(sum(CASE WHEN isfull = 0 THEN weight END) OVER (PARTITION BY {parent}), 0) AS open0 FROM b{n}),
  d{n} AS (SELECT *, (weight * rest0) // greatest(open0, 1) AS share0, (weight * rest0) % greatest(open0, 1) AS left0 FROM c{n}),
  e{n} AS (SELECT *, coalesce(sum(CASE WHEN isfull = 0 THEN share0 END) OVER (PARTITION BY {parent}), 0) AS dealt0,
    row_number() OVER (PARTITION BY {parent} ORDER BY isfull, left0 DESC, {name}) AS nth0 FROM d{n}),
  g{n} AS (SELECT {", ".join(LEVELS[:n])}, CAST(CASE WHEN isfull = 1 THEN cap ELSE share0 + CASE WHEN nth0 <= rest0 - dealt0 THEN 1 ELSE 0 END END AS HUGEINT) AS given FROM e{n})"""


def oracle(weights: dict[str, dict[str, int]] = WEIGHTS, tenths: int = 6, max_epochs: int = 2, seed: str = SEED) -> str:
    """The registered query as one DuckDB statement, with plain running sums over whole leaves."""
    def case(level: str) -> str:
        return "CASE " + level + "".join(f" WHEN '{k}' THEN {w}" for k, w in sorted(weights.get(level, {}).items())) + " ELSE 1 END" if weights.get(level) else "1"

    return f"""
WITH sized AS (
  SELECT doc_id, CASE WHEN coalesce(regexp_extract(source, '(\\d{{1,9}})$', 1), '') = '' THEN 'unknown'
      ELSE 'd' || CAST(CAST(regexp_extract(source, '(\\d{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(text, '\\S+')) AS HUGEINT) AS tokens, md5(text) AS digest
  FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '\\S+')) > 0),
  leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, {max_epochs} * sum(tokens) AS cap FROM sized GROUP BY ALL),
  s1 AS (SELECT domain, sum(cap) AS cap, CAST({case("domain")} AS HUGEINT) AS weight,
    (SELECT least(sum(tokens) * {tenths} // 10, sum(cap)) FROM leaves) AS budget FROM leaves GROUP BY domain),
{_sql_fill(1, "s1")},
  s2 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, CAST({case("lang").replace("CASE lang", "CASE l.lang")} AS HUGEINT) AS weight, any_value(g.given) AS budget
    FROM leaves l JOIN g1 g ON l.domain = g.domain GROUP BY l.domain, l.lang),
{_sql_fill(2, "s2")},
  s3 AS (SELECT l.domain, l.lang, l.source, l.cap, CAST(1 AS HUGEINT) AS weight, g.given AS budget
    FROM leaves l JOIN g2 g ON l.domain = g.domain AND l.lang = g.lang),
{_sql_fill(3, "s3")},
  plan AS (SELECT l.domain, l.lang, l.source, g.given // l.tokens AS epochs, g.given % l.tokens AS rest
    FROM leaves l JOIN g3 g ON l.domain = g.domain AND l.lang = g.lang AND l.source = g.source),
  ordered AS (SELECT s.doc_id, s.domain, s.lang, s.source, s.tokens, p.epochs, p.rest,
    coalesce(sum(s.tokens) OVER (PARTITION BY s.domain, s.lang, s.source
      ORDER BY md5('{seed}:' || CAST(p.epochs AS VARCHAR) || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.digest), s.doc_id, s.tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN plan p ON s.domain = p.domain AND s.lang = p.lang AND s.source = p.source)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(epochs AS BIGINT) AS epochs,
  CAST(greatest(0, least(tokens, rest - before)) AS BIGINT) AS prefix_tokens,
  CAST(epochs * tokens + greatest(0, least(tokens, rest - before)) AS BIGINT) AS selected_tokens
FROM ordered WHERE epochs * tokens + greatest(0, least(tokens, rest - before)) > 0
"""
