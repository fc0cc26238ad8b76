"""Token usage and what it costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import model_key, price

#: First cell of the row with the model names, texts that mark the rows of prices, and what inputs have in common.
MODEL_ROW, INPUT_MARK = "模型版本", "输入"
PRICE_ROWS = {"cache_hit": "输入（缓存命中）", "cache_miss": "输入（缓存未命中）", "output": "百万tokens输出"}


def usage_totals(usage: DataFrame, *keys: str) -> DataFrame:
    out = usage.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("prompt", "completion", "cache_hit", "requests")))
    return out.withColumn("cache_miss", F.greatest(F.lit(0), F.col("prompt") - F.col("cache_hit"))).withColumn("total", F.col("prompt") + F.col("completion"))


def usage_report(totals: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 2)).otherwise(0.0)
    return totals.withColumns({"hit_pct": share("cache_hit", "prompt"), "miss_pct": share("cache_miss", "prompt"), "output_pct": share("completion", "total")})


def price_lookup(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Each model's price: by equal name, else by equal key, else by the first of which one key begins the other.

    All three are equi-joins: keys that begin one another meet at the shorter, for which every beginning of the longer is
    made. What a model finds is ranked by kind and order.
    """
    beginnings = lambda key: F.explode(F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.substring(key, F.lit(1), n)))
    p = prices.select("ord", F.col("model").alias("priced"), model_key(F.col("model")).alias("pkey"), "cache_hit_price", "cache_miss_price", "output_price")
    m = models.select("model").distinct().withColumn("mkey", model_key(F.col("model")))
    kinds = (
        m.withColumn("met", F.col("model")).join(p.withColumn("met", F.col("priced")), "met").withColumn("kind", F.lit(0)),
        m.withColumn("met", F.col("mkey")).join(p.withColumn("met", F.col("pkey")), "met").withColumn("kind", F.lit(1)),
        m.where("mkey <> ''").withColumn("met", beginnings(F.col("mkey"))).join(p.withColumn("met", F.col("pkey")), "met").withColumn("kind", F.lit(2)),
        m.withColumn("met", F.col("mkey")).join(p.where("pkey <> ''").withColumn("met", beginnings(F.col("pkey"))), "met").withColumn("kind", F.lit(2)),
    )
    both = reduce(DataFrame.unionByName, kinds)
    first = F.min_by(F.struct("priced", "cache_hit_price", "cache_miss_price", "output_price"), F.struct("kind", "ord"))
    return both.groupBy("model").agg(first.alias("x")).select("model", "x.*")


def estimate_cost(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """totals with cost; null for a model without a price."""
    cost = F.expr("cache_hit / 1e6D * cache_hit_price + cache_miss / 1e6D * cache_miss_price + completion / 1e6D * output_price")
    return totals.join(price_lookup(totals, prices), "model", "left").withColumn("cost", cost)


def fresh_prices(cache: DataFrame, now: int, ttl: int = 24 * 3600) -> DataFrame:
    """Cached prices that are not older than ttl; if none is, whatever there is. One aggregate says which."""
    fresh = F.lit(now) - F.col("fetched_at") <= ttl
    any_fresh = cache.agg(F.coalesce(F.bool_or(fresh), F.lit(False)).alias("_any"))
    return cache.join(F.broadcast(any_fresh), fresh | ~F.col("_any")).drop("_any")


def price_table(rows: DataFrame, versions: bool = False) -> DataFrame:
    """Prices on a price page: doc_id, ord, model, cache_hit_price, cache_miss_price, output_price.

    rows: doc_id, r, cells (texts of one table row; see ``sources.html.table_rows``). Prices are matched with models by their
    order in the row, as merged cells shift columns; of several rows of a kind the last counts. A row whose number of prices
    differs from that of models is an error; a model that lacks a price is left out. versions: see model_key.
    """
    shown = F.array_join("cells", " ")
    output = shown.contains(PRICE_ROWS["output"]) & ~shown.contains(INPUT_MARK)
    kind = F.when(F.get("cells", F.lit(0)) == MODEL_ROW, "model")
    for name in ("cache_hit", "cache_miss"):
        kind = kind.when(shown.contains(PRICE_ROWS[name]), name)
    told = rows.withColumn("kind", kind.when(output, "output")).where("kind is not null")
    named = F.transform(F.filter(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: c != ""), lambda c: model_key(c, versions))
    found = F.filter(F.transform("cells", price), lambda x: x.isNotNull())
    told = told.withColumn("named", F.when(F.col("kind") == "model", named)).withColumn("found", F.when((F.col("kind") != "model") & (F.size(found) > 0), found))
    last = lambda value, name: F.max_by(value, F.when((F.col("kind") == name) & F.col(value).isNotNull(), F.col("r"))).alias(name)
    page = told.groupBy("doc_id").agg(last("named", "model"), *(last("found", name) for name in PRICE_ROWS))
    for name in PRICE_ROWS:
        wrong = F.raise_error(F.concat(F.lit(f"{name}: "), F.size(name), F.lit(" prices for "), F.size("model"), F.lit(" models")))
        page = page.withColumn(name, F.when(F.size(name) != F.size("model"), wrong.cast("array<double>")).otherwise(F.col(name)))
    each = page.select("doc_id", F.posexplode("model").alias("ord", "name"), *PRICE_ROWS)
    each = each.select("doc_id", "ord", F.col("name").alias("model"), *(F.get(name, F.col("ord")).alias(f"{name}_price") for name in PRICE_ROWS)).dropna()
    latest = (F.max_by(f"{name}_price", "ord").alias(f"{name}_price") for name in PRICE_ROWS)
    return each.groupBy("doc_id", "model").agg(F.min("ord").alias("ord"), *latest).select("doc_id", "ord", "model", *(f"{name}_price" for name in PRICE_ROWS))
