"""Declared schemas of the tables and files (no inference anywhere)."""

from pyspark.sql import types as T

NEWS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("body", T.StringType(), False),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("url", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

CRYPTO_PRICES = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("price", T.DecimalType(20, 8), False),
    T.StructField("volume", T.DecimalType(20, 8)),
    T.StructField("recorded_at", T.TimestampNTZType()),
])

CRYPTO_INDICATORS = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("recorded_at", T.TimestampNTZType(), False),
    T.StructField("rsi_14", T.DecimalType(10, 4)),
    T.StructField("macd", T.DecimalType(20, 8)),
    T.StructField("macd_signal", T.DecimalType(20, 8)),
    T.StructField("bb_upper", T.DecimalType(20, 8)),
    T.StructField("bb_middle", T.DecimalType(20, 8)),
    T.StructField("bb_lower", T.DecimalType(20, 8)),
])

CHAT_SESSIONS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("title", T.StringType()),
])

CHAT_MESSAGES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("session_id", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("message", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
])

VECTORS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("title", T.StringType()),
    T.StructField("published_time", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
])

# CSV files: read as text, typed explicitly afterwards.
NEWS_CSV = T.StructType([T.StructField(c, T.StringType()) for c in
                         ["Timestamp", "Published Time", "Title", "Body", "URL", "Keywords"]])
PRICE_CSV = T.StructType([T.StructField(c, T.StringType()) for c in
                          ["Date", "Open", "High", "Low", "Close", "Volume"]])

ARTICLE = T.StructType([
    T.StructField("PUBLISHED_ON", T.LongType()),
    T.StructField("TITLE", T.StringType()),
    T.StructField("BODY", T.StringType()),
    T.StructField("URL", T.StringType()),
    T.StructField("KEYWORDS", T.VariantType()),
])

TABLES = {
    "news": NEWS,
    "crypto_prices": CRYPTO_PRICES,
    "crypto_indicators": CRYPTO_INDICATORS,
    "chat_sessions": CHAT_SESSIONS,
    "chat_messages": CHAT_MESSAGES,
}
PARTITIONED = {"crypto_prices": "symbol", "crypto_indicators": "symbol"}
