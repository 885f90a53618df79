"""Health checks of markets, the aggregator, nodes and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import at, minutes_before
from .requests import health_minutes

#: Errors that are joined to one text at most; what reports more lists them as rows.
MAX_ERRORS = 1_000_000
#: Heights by which a node may be behind another.
ALLOWED_LAG = 2


def market_health(markets: DataFrame, trades: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """A market is healthy if its last trade is younger than ``minutes``; without trades it isn't."""
    last = trades.groupBy("market_id").agg(F.max("executed_at").alias("last_trade"))
    healthy = F.col("last_trade") > minutes_before(as_of, health_minutes(minutes))
    return markets.select("market_id").join(last, "market_id", "left").select("market_id", F.coalesce(healthy, F.lit(False)).alias("is_healthy"), "last_trade")


def aggregator_health(trades: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """One row: healthy if any trade falls in the last ``minutes`` (720 at most), with the insert time of the newest.

    The window includes both ends, but a trade at its very beginning is found without being healthy.
    """
    begin = minutes_before(as_of, health_minutes(minutes, bounded=True))
    found = trades.where(F.col("executed_at").between(begin, at(as_of))).agg(F.max("executed_at").alias("newest"), F.max_by("i_created_at", F.struct("executed_at", "id")).alias("last_sync"))
    return found.select(F.coalesce(F.col("newest") > begin, F.lit(False)).alias("is_healthy"), "last_sync")


def joined_errors(errors: DataFrame, order: list[str], separator: str, most: int = MAX_ERRORS) -> DataFrame:
    """One row (n_errors, errors): how many there are, and the texts (column ``error``) of the first ``most`` in order, joined.

    Tasks keep their first ``most`` only, so what meets in one doesn't grow with the errors.
    """
    first = errors.orderBy(*order).limit(most).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "error"))), lambda e: e["error"]), separator).alias("errors"))
    return errors.agg(F.count("*").alias("n_errors")).crossJoin(first)


def whole(errors: DataFrame, most: int) -> DataFrame:
    """A joined text, or an error if it isn't whole."""
    many = F.raise_error(F.concat(F.col("n_errors").cast("string"), F.lit(f" errors are too many for one text, which takes {most}; list them as rows"))).cast("boolean")
    return errors.where(F.when(F.col("n_errors") > most, many).otherwise(True))


def node_lags(nodes: DataFrame) -> DataFrame:
    """Nodes more than two blocks behind another: (behind, ahead, height_behind, height_ahead).

    Nodes (name, height; null where the query failed) are a configured list; the pairs are the result.
    """
    known = nodes.where("height is not null")
    a, b = known.select(F.col("name").alias("ahead"), F.col("height").alias("height_ahead")), known.select(F.col("name").alias("behind"), F.col("height").alias("height_behind"))
    return a.join(b, (F.col("height_ahead") - F.col("height_behind") > ALLOWED_LAG) & (F.col("ahead") != F.col("behind")))


def node_errors(nodes: DataFrame) -> DataFrame:
    """(kind, name, other, error): nodes that could not be queried (kind 0), and those that are behind others (kind 1)."""
    failed = nodes.where("height is null").select(F.lit(0).alias("kind"), "name", F.lit("").alias("other"), F.concat(F.lit("failed to query: "), "name", F.lit(";")).alias("error"))
    late = node_lags(nodes).select(
        F.lit(1).alias("kind"), F.col("ahead").alias("name"), F.col("behind").alias("other"),
        F.concat("behind", F.lit(" is behind "), "ahead", F.lit(". Expected height "), F.col("height_ahead").cast("string"), F.lit(", found "), F.col("height_behind").cast("string")).alias("error"),
    )
    return failed.unionByName(late)


def node_health(nodes: DataFrame, most: int = MAX_ERRORS) -> DataFrame:
    """One row: healthy if nodes are configured and there is no error; errors in the order of the names.

    More than ``most`` errors are an error; :func:`node_errors` lists any number.
    """
    errors = whole(joined_errors(node_errors(nodes), ["kind", "name", "other"], "", most), most)
    return nodes.agg(F.count("*").alias("n")).crossJoin(errors).select(((F.col("n") > 0) & (F.col("n_errors") == 0)).alias("is_healthy"), "errors")


def endpoints(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The endpoint of the longest prefix (prefix, endpoint) of each address, or null.

    Addresses meet prefixes by equality, once for each length that prefixes have, instead of testing all pairs.
    """
    lengths = prefixes.select(F.char_length("prefix").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))
    tried = addresses.select("address").distinct().crossJoin(F.broadcast(lengths)).select("address", F.explode("lengths").alias("n"))
    heads = tried.where(F.char_length("address") >= F.col("n")).withColumn("prefix", F.substring(F.col("address"), F.lit(1), F.col("n")))
    best = heads.join(prefixes, "prefix").groupBy("address").agg(F.max_by("endpoint", "n").alias("endpoint"))
    return addresses.join(best, "address", "left")


def check_balances(checks: DataFrame, balances: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(address, denom, is_healthy, error) for each check (address, min_amount, denom); a balance not held is 0."""
    held = balances.select("address", F.explode("balances").alias("b")).groupBy("address", F.col("b.denom").alias("denom")).agg(F.first(F.col("b.amount").cast("decimal(38,0)")).alias("amount"))
    rows = endpoints(checks, prefixes).join(held, ["address", "denom"], "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(38,0)")))
    few = F.concat(F.lit("balance ["), F.col("amount").cast("string"), F.lit("] is less than min amount ["), F.col("min_amount").cast("string"), F.lit("]"))
    error = F.when(F.col("endpoint").isNull(), "no endpoint found for provided address").when(F.col("amount") < F.col("min_amount"), few).otherwise("")
    return rows.select("address", "denom", (error == "").alias("is_healthy"), error.alias("error"))


def balance_health(checked: DataFrame, most: int = MAX_ERRORS) -> DataFrame:
    """One row: all healthy, and the errors joined in the order of the addresses.

    More than ``most`` errors are an error; :func:`check_balances` lists any number, :func:`joined_errors` the first ones
    and their number.
    """
    text = F.concat(F.lit("["), "address", F.lit("]: ["), "error", F.lit("]"))
    errors = checked.where(~F.col("is_healthy")).select("address", "denom", text.alias("error"))
    return whole(joined_errors(errors, ["address", "denom"], "; ", most), most).select((F.col("n_errors") == 0).alias("is_healthy"), "errors")
