"""Explicit schemas of the external files."""

from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

# ---- fixed values: column order of the tick and bar archives ------------------------------------------------
TRADES = StructType([
    StructField("agg_trade_id", LongType()), StructField("price", DoubleType()), StructField("quantity", DoubleType()),
    StructField("first_trade_id", LongType()), StructField("last_trade_id", LongType()),
    StructField("transact_time", LongType()), StructField("is_buyer_maker", BooleanType()),
])
KLINES = StructType([
    StructField("open_time", LongType()), StructField("open", DoubleType()), StructField("high", DoubleType()),
    StructField("low", DoubleType()), StructField("close", DoubleType()), StructField("volume", DoubleType()),
    StructField("close_time", LongType()), StructField("quote_volume", DoubleType()), StructField("count", LongType()),
    StructField("taker_buy_volume", DoubleType()), StructField("taker_buy_quote_volume", DoubleType()),
    StructField("ignore", DoubleType()),
])

# ---- fixed values: header names accepted in user files, the first one preferred ------------------------------
HEADER_ALIASES = {
    "timestamp": ("timestamp", "bar_open_ms", "date", "datetime", "open_time", "time", "ts"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "price"),
    "volume": ("volume", "base_volume", "basevolume", "v", "vol"),
    "amount": ("amount", "quote_asset_volume", "quote_volume", "quotevolume", "turnover"),
}
REQUIRED = ("timestamp", "open", "high", "low", "close")
