"""Latest rows, price histories and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.functions.dates import SHOP_ZONE, local_day


def first_by(df: DataFrame, keys: list, order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key. Spark cuts down groups before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def daily_history(observed: DataFrame, keys: list[str], ts: str, price: str, shop: str, in_stock: Column, zone: str = SHOP_ZONE) -> DataFrame:
    """Per key and local day: the lowest price and the shops in stock, and the last time; a
    day without stock has a null price and no shops."""
    return observed.groupBy(*keys, local_day(F.col(ts), zone).alias("day")).agg(
        F.min(F.when(in_stock, F.col(price))).alias("lowest_price"), F.count_distinct(F.when(in_stock, F.col(shop))).alias("shops_in_stock"), F.max(ts).alias("last_seen")
    )


def daily_shop_bitmaps(observed: DataFrame, keys: list[str], ts: str, price: str, number: str, in_stock: Column, zone: str = SHOP_ZONE) -> DataFrame:
    """The daily history in a form that adds up: per key, local day, ``bucket`` (of 32,768 shop numbers) and ``word`` (of 64 numbers in it, those that have a shop) the shops
    in stock and all shops as bits of a long, the lowest price in stock, and the last time: never more rows than observations, each of a few bytes, however few
    shops a day has. ``number`` is a shop's whole number, 0 or more. Rows without a number count for prices and times only. Rows are dealt out before they are
    aggregated: a product's day has few of them, so that a scan's task would fill and spill a table of nearly all its rows, to send as many."""
    place = F.bitmap_bit_position(number)
    bit = F.expr("shiftleft(1L, CAST(_place % 64 AS INT))")
    cells = [*keys, "day", "bucket", "word"]
    placed = observed.withColumn("_place", place).select(
        *keys, local_day(F.col(ts), zone).alias("day"), F.coalesce(F.bitmap_bucket_number(number), F.lit(1)).alias("bucket"), F.coalesce(F.floor(F.col("_place") / 64), F.lit(0)).cast("int").alias("word"), "_place", in_stock.alias("_in_stock"), F.col(price).alias("_price"), F.col(ts).alias("_ts")
    )
    return placed.repartition(*cells).groupBy(*cells).agg(
        F.coalesce(F.bit_or(F.when(F.col("_in_stock"), bit)), F.lit(0)).cast("long").alias("in_stock"), F.coalesce(F.bit_or(bit), F.lit(0)).cast("long").alias("shops"),
        F.min(F.when(F.col("_in_stock"), F.col("_price"))).alias("lowest_price"), F.max("_ts").alias("last_seen"),
    )


def rolled_up(daily: DataFrame, keys: list[Column]) -> DataFrame:
    """Daily bitmaps brought together to ``keys`` (of its columns, such as the key alone or its month): lowest price, shops in stock, all shops, last time; exact,
    without the observations. Shops are counted word by word, so no row is expanded for distinct counts. One exchange by ``keys`` serves both steps; a task keeps a key's words
    (a 64th of its shops), not its days."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    parts = daily.select(*named, "bucket", "word", "in_stock", "shops", "lowest_price", "last_seen").repartition(*names).groupBy(*names, "bucket", "word").agg(
        F.bit_count(F.bit_or("in_stock")).alias("n_in_stock"), F.bit_count(F.bit_or("shops")).alias("n_shops"), F.min("lowest_price").alias("lowest_price"), F.max("last_seen").alias("last_seen")
    )
    whole = parts.groupBy(*names).agg(
        F.min("lowest_price").alias("lowest_price"), F.sum("n_in_stock").alias("shops_in_stock"), F.sum("n_shops").alias("all_shops"), F.max("last_seen").alias("last_seen")
    )
    columns = daily.select(*keys).columns
    return whole.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), "lowest_price", "shops_in_stock", "all_shops", "last_seen")


def best_prices(offers: DataFrame, product: str, shop: str, price: str, last_seen: str, in_stock: Column, as_of: Column, hours: int = 48) -> DataFrame:
    """Per product: the lowest price that is fresh and in stock, the shops that have such an
    offer, all shops, and when the cheapest such offer was last seen."""
    fresh = in_stock & (F.col(last_seen) >= as_of - F.make_interval(hours=F.lit(hours)))
    best = F.min(F.when(fresh, F.struct(F.col(price).alias("price"), (-F.unix_micros(F.col(last_seen).cast("timestamp"))).alias("late"), F.col(last_seen).alias("seen"))))
    # A row for each shop first, so that shops are counted without a copy of the rows for each count.
    shops = offers.groupBy(product, F.col(shop).alias("_shop")).agg(F.min(F.when(fresh, F.col(price))).alias("_price"), F.max(fresh).alias("_fresh"), best.alias("_best"))
    found = shops.groupBy(product).agg(
        F.min("_price").alias("lowest_fresh_price"), F.count(F.when(F.col("_fresh"), F.col("_shop"))).alias("fresh_instock_shop_count"), F.count("_shop").alias("total_active_shop_count"), F.min("_best").alias("_best")
    )
    return found.withColumn("best_price_last_seen_at", F.col("_best.seen")).drop("_best")


def changes(observed: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it of the same key, with that."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, place = F.lag(value).over(w), F.row_number().over(w)
    return observed.withColumn(f"old_{value}", before).withColumn("_place", place).where((F.col("_place") > 1) & ~F.col(value).eqNullSafe(F.col(f"old_{value}"))).drop("_place")


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change_type (new, gone, changed), old and new value, of two snapshots."""
    o, n = (d.select(key, F.col(value).alias(name), F.lit(True).alias(f"_{name}")) for d, name in ((old, "old"), (new, "new")))
    joined = o.join(n, key, "full")
    kind = F.when(F.col("_old").isNull(), F.lit("new")).when(F.col("_new").isNull(), F.lit("gone")).when(~F.col("old").eqNullSafe(F.col("new")), F.lit("changed"))
    return joined.withColumn("change_type", kind).where(F.col("change_type").isNotNull()).select(key, "change_type", "old", "new")


def history_to_append(history: DataFrame, incoming: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """The incoming observations (one per key) that say something new: there is no earlier one,
    or the latest one is of another day or differs in one of ``values`` (nulls compare as values)."""
    latest = first_by(history, keys, [F.desc(ts), *(F.asc(v) for v in values)]).select(*keys, F.col(ts).alias("_ts"), *(F.col(v).alias(f"_{v}") for v in values))
    joined = incoming.join(latest, keys, "left")
    new = F.col("_ts").isNull() | (F.to_date("_ts") != F.to_date(ts))
    for v in values:
        new = new | ~F.col(v).eqNullSafe(F.col(f"_{v}"))
    return joined.where(new).select(*incoming.columns)


def trailing(points: DataFrame, keys: list[str], day: str, days: int) -> DataFrame:
    """The points of the last ``days`` days of each key, counted from its last point."""
    last = F.max(day).over(Window.partitionBy(*keys))
    return points.withColumn("_last", last).where(F.col(day) >= F.date_sub("_last", days - 1)).drop("_last")


def period_lows(points: DataFrame, keys: list[str], day: str, price: str, days: int) -> DataFrame:
    """Per key over the trailing days: low, high, the current price, and whether it is the low."""
    return trailing(points, keys, day, days).groupBy(*keys).agg(
        F.min(price).alias("low"), F.max(price).alias("high"), F.max_by(price, day).alias("current")
    ).withColumn("is_low", F.coalesce(F.col("current") == F.col("low"), F.lit(False)))
