"""Mixing sources to target weights: hierarchical budgets and token prefixes of seeded epochs.

Sources form a tree of domain, language and source. A node's budget is shared
among its children by their weights, but no child gets more than its subtree
can give (its tokens times ``max_epochs``). What a child cannot take goes to
its siblings by their weights; only what a whole subtree cannot take reaches
the siblings of its ancestors. With capacities summed upwards this is one
water-filling for each parent, solved in closed form: children in the order of
capacity over weight, and the water level at the first child that does not
fill up.

A leaf with a budget of b tokens over a size of s gives b // s whole epochs,
and from the next epoch the longest prefix, in an order seeded by the epoch,
whose tokens fit the rest. Rows with the same id stand at one place of that
order and go together.

A null domain, language or source counts as ``(none)``; a null text has no
tokens and goes with whole epochs only; an empty table gives an empty result.
Result columns replace columns of the same name.

A hot source is cut into buckets of its order: counts of buckets find the one
with the border, and only that bucket is looked at row by row. The decision
comes back to the texts as one threshold for each leaf, so texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import WORD_CLASS, documents, stage, text_of

LEAF = ["domain", "lang", "source"]
#: Production parameters: target shares at each level; nodes that are not listed have weight 1.
DOMAINS = ("web", "books", "news", "forum")
DOMAIN_WEIGHTS = {"web": 4.0, "books": 3.0, "news": 2.0, "forum": 1.0}
LANG_WEIGHTS = {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}
MAX_EPOCHS = 4
SHARE = 0.8
BUCKET_BITS = 12
EDGE = 1e-6


def domain_of(source: str = "source") -> Column:
    """A stand-in for a domain column, which the tables lack: sources are dealt to the domains by checksum."""
    c = F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")) % len(DOMAINS)
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (c + 1).cast("int"))


def weight(level: str, weights: dict[str, float]) -> Column:
    c = F.lit(1.0)
    for name, w in weights.items():
        c = F.when(F.col(level) == name, F.lit(float(w))).otherwise(c)
    return c


def order_key(seed: int, epoch: Column) -> Column:
    """60 bits that place an id in an epoch's order."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def share_out(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Water-filling: adds ``share``, for nodes with ``weight`` and ``capacity``, below the parent's budget.

    A node of weight 0 gets nothing and its siblings share the budget; where all siblings
    have weight 0 the budget is not used.
    """
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
    order = F.coalesce(F.try_divide(F.col("capacity"), F.col("weight")), F.lit(0.0))  # the excluded come first and take nothing
    before = Window.partitionBy(*parent).orderBy(order, "name").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    out = nodes.withColumns({
        "__llm_below": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "__llm_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "__llm_budget": budget,
    }).withColumn("__llm_level", F.try_divide(F.col("__llm_budget") - F.col("__llm_below"), F.col("__llm_left")))
    fits = F.when(F.col("__llm_level") <= order, F.col("__llm_level"))
    level = F.max(fits).over(whole)  # the first child that does not fill up has the highest level of those
    return out.withColumn("__llm_water", level).withColumn(
        "share", F.when(F.col("__llm_water").isNull(), F.col("capacity").cast("double")).otherwise(
            F.least(F.col("capacity").cast("double"), F.col("weight") * F.col("__llm_water")))
    ).drop("__llm_below", "__llm_left", "__llm_budget", "__llm_level", "__llm_water")


def plan(sizes: DataFrame, total: Column, domain_weights=None, lang_weights=None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each leaf (with ``size``): ``budget``, whole ``epochs`` and the tokens ``rest`` of the next one."""
    leaves = sizes.withColumn("capacity", F.col("size") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    langs = langs.withColumns({"weight": weight("lang", lang_weights or LANG_WEIGHTS), "name": F.col("lang")})
    langs = langs.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))  # an excluded one holds nothing
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))

    domains = domains.withColumns({"weight": weight("domain", domain_weights or DOMAIN_WEIGHTS), "name": F.col("domain"), "all": F.lit(1)})
    domains = share_out(domains, ["all"], total).select("domain", F.col("share").alias("above"))
    langs = share_out(langs.join(domains, "domain"), ["domain"], F.col("above")).select("domain", "lang", F.col("share").alias("above"))
    leaves = leaves.join(langs, ["domain", "lang"]).withColumns({"weight": F.lit(1.0), "name": F.col("source")})
    leaves = share_out(leaves, ["domain", "lang"], F.col("above"))
    budget = F.floor(F.col("share") + EDGE).cast("long")
    return leaves.select(*LEAF, "size", "n_rows", budget.alias("budget")).withColumn(
        "epochs", F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(1).cast("long")
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))


def borders(tokens: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """The last place of each leaf's prefix: ``(border_key, border_id)``; no row where nothing fits."""
    key = F.col("key")
    rows = tokens.join(leaves.filter("rest > 0").select(*LEAF, "epochs", "rest"), LEAF)
    rows = rows.withColumn("key", order_key(seed, F.col("epochs"))).groupBy(*LEAF, "rest", "key", "doc_id").agg(F.sum("tokens").alias("tokens"))
    rows = stage(rows.withColumn("bucket", F.shiftright(key, 60 - BUCKET_BITS)), "order")
    up_to = Window.partitionBy(*LEAF).orderBy("bucket")
    buckets = rows.groupBy(*LEAF, "rest", "bucket").agg(F.sum("tokens").alias("n")).withColumn("end", F.sum("n").over(up_to))
    # The first bucket that does not fit as a whole holds the border, the ones before it belong to the prefix.
    first = buckets.filter("end > rest").groupBy(*LEAF).agg(F.min("bucket").alias("bucket"))
    first = stage(buckets.join(first, [*LEAF, "bucket"], "left_semi").select(*LEAF, "bucket", (F.col("end") - F.col("n")).alias("start")), "border_buckets")
    inside = Window.partitionBy(*LEAF, "bucket").orderBy("key", F.col("doc_id").asc_nulls_first())
    near = rows.join(first, [*LEAF, "bucket"]).withColumn("end", F.col("start") + F.sum("tokens").over(inside)).filter("end <= rest")
    last = near.groupBy(*LEAF).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    # Where not even the bucket's first row fits, the prefix ends with the bucket before.
    return first.join(last, LEAF, "left").select(
        *LEAF, F.coalesce("last.key", F.shiftleft("bucket", 60 - BUCKET_BITS) - 1).alias("border_key"),
        F.col("last.doc_id").alias("border_id"), F.col("last").isNull().alias("border_whole"),
    )


def mix(
    df: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 42,
    domain: Column | None = None, domain_weights: dict | None = None, lang_weights: dict | None = None,
) -> DataFrame:
    """The rows chosen, once for each epoch, with ``domain``, ``tokens`` and ``epoch``; the budget is a share of all tokens."""
    own = {"domain": domain if domain is not None else domain_of()}
    named = df.withColumns({f"__llm_{c}": F.coalesce(own.get(c, F.col(c)), F.lit("(none)")) for c in LEAF})
    names = [F.col(f"__llm_{c}").alias(c) for c in LEAF]
    tokens = stage(named.select(*names, "doc_id", F.regexp_count(text_of(), F.lit(WORD_CLASS)).cast("long").alias("tokens")), "tokens")
    sizes = stage(tokens.groupBy(*LEAF).agg(F.sum("tokens").alias("size"), F.count("*").alias("n_rows")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    leaves = stage(plan(sizes, F.lit(float(int(total * share))), domain_weights, lang_weights, max_epochs), "plan")
    marks = stage(leaves.join(borders(tokens, leaves, seed), LEAF, "left").select(
        *[F.col(c).alias(f"__llm_{c}") for c in LEAF], "epochs", "rest", "border_key", "border_id", "border_whole"), "marks")
    marks = marks.select(*[f"__llm_{c}" for c in LEAF], *[F.col(c).alias(f"__llm_{c}") for c in ("epochs", "rest", "border_key", "border_id", "border_whole")])

    key, at = order_key(seed, F.col("__llm_epochs")), F.col("__llm_border_key")
    not_after = F.coalesce(F.col("doc_id") <= F.col("__llm_border_id"), F.col("doc_id").isNull())
    more = (F.col("__llm_rest") > 0) & at.isNotNull() & ((key < at) | ((key == at) & (F.col("__llm_border_whole") | not_after)))
    copies = F.col("__llm_epochs") + more.cast("long")
    out = named.join(marks, [f"__llm_{c}" for c in LEAF]).withColumn("__llm_copies", copies).filter("__llm_copies > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__llm_copies") - 1)))
    out = out.withColumns({"domain": F.col("__llm_domain"), "tokens": F.regexp_count(text_of(), F.lit(WORD_CLASS)).cast("long")})
    return out.drop(*[c for c in out.columns if c.startswith("__llm_")])


def query(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def _case(level: str, weights: dict[str, float]) -> str:
    return "CASE " + level + "".join(f" WHEN '{n}' THEN {w}::DOUBLE" for n, w in weights.items()) + " ELSE 1.0::DOUBLE END"


def _filled(name: str, nodes: str, parent: str, budget: str) -> str:
    return f"""{name}_l AS (
  SELECT *, ({budget} - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM ({nodes})),
{name} AS (
  SELECT *, coalesce(least(capacity::DOUBLE, weight * max(lvl) FILTER (WHERE lvl <= capacity / weight) OVER (PARTITION BY {parent})), capacity::DOUBLE) AS share FROM {name}_l)"""


#: crc32 is no DuckDB function, so the stand-in domains of the test tables' sources are written out.
def sql() -> str:
    import zlib

    domains = "CASE source" + "".join(
        f" WHEN 'src{i}' THEN '{DOMAINS[zlib.crc32(f'src{i}'.encode()) % len(DOMAINS)]}'" for i in range(20)) + " END"
    return f"""
WITH t AS (
  SELECT doc_id, {domains} AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
s AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS size FROM t GROUP BY ALL),
lc AS (SELECT domain, lang, sum(size * {MAX_EPOCHS})::BIGINT AS capacity FROM s GROUP BY ALL),
dc AS (SELECT domain, sum(capacity)::BIGINT AS capacity FROM lc GROUP BY ALL),
{_filled('d', f"SELECT *, {_case('domain', DOMAIN_WEIGHTS)} AS weight, domain AS name, 1 AS root FROM dc", 'root', f"(SELECT floor(sum(size) * {SHARE}::DOUBLE) FROM s)")},
{_filled('l', f"SELECT lc.*, d.share AS above, {_case('lang', LANG_WEIGHTS)} AS weight, lang AS name FROM lc JOIN d USING (domain)", 'domain', 'above')},
{_filled('v', f"SELECT s.*, s.size * {MAX_EPOCHS} AS capacity, l.share AS above, 1.0::DOUBLE AS weight, source AS name FROM s JOIN l USING (domain, lang)", 'domain, lang', 'above')},
p AS (SELECT domain, lang, source, size, floor(share + 1e-6)::BIGINT AS budget FROM v),
q AS (SELECT *, CASE WHEN size > 0 THEN budget // size ELSE 1 END AS epochs FROM p),
o AS (
  SELECT t.*, epochs, budget - epochs * size AS rest,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || epochs || ':' || doc_id)[1:15], doc_id RANGE UNBOUNDED PRECEDING) AS upto
  FROM t JOIN q USING (domain, lang, source)),
c AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, unnest(range(copies))::BIGINT AS epoch FROM c WHERE copies > 0"""


SQL = sql()
