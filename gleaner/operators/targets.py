"""Validation of scan targets."""

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: networks larger than this get a warning.
LARGE_NETWORK = 256
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
CIDR = rf"^({_OCTET}(?:\.{_OCTET}){{3}})/(\d|[12]\d|3[0-2])$"


def _number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    return sum((F.element_at(parts, k + 1).try_cast("long") * F.lit(256 ** (3 - k)) for k in range(4)), F.lit(0).cast("long"))


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(F.floor(number / F.lit(256**k)), F.lit(256))).cast("string") for k in (3, 2, 1, 0)])


@F.pandas_udf(T.StructType().add("normalised", T.StringType()).add("is_range", T.BooleanType()).add("log_size", T.IntegerType()))
def _version_6(items: pd.Series) -> pd.DataFrame:
    """IPv6 addresses and networks; null for anything else."""

    def parse(item: str | None) -> tuple:
        try:
            network = ipaddress.IPv6Network(item, strict=False)
        except ValueError:
            return None, None, None
        return (str(network), True, 128 - network.prefixlen) if "/" in item else (str(network.network_address), False, 0)

    return pd.DataFrame([parse(x) if x is not None else (None, None, None) for x in items], columns=["normalised", "is_range", "log_size"])


def explode_targets(rows: DataFrame, targets: str) -> DataFrame:
    """One row for each non-blank item of a comma-separated list of IP addresses and networks.

    Adds item, valid, is_range, normalised (host bits cleared), size (2^62 at most) and large. Only
    items with a colon, which IPv4 has not, leave the JVM.
    """
    each = rows.select("*", F.posexplode(F.split(targets, ",")).alias("item_no", "item")).withColumn("item", F.trim("item")).filter("item <> ''")
    address, bits = F.regexp_extract("item", CIDR, 1), F.regexp_extract("item", CIDR, 2).try_cast("int")
    single, network = F.col("item").rlike(IPV4), F.col("item").rlike(CIDR)
    size = F.when(network, F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")).when(single, F.lit(1).cast("long"))
    six = F.when(F.col("item").contains(":"), _version_6(F.when(F.col("item").contains(":"), F.col("item"))))
    each = each.withColumn("six", six)
    size6 = F.when(F.col("six.log_size").isNotNull(), F.pow(F.lit(2.0), F.least(F.col("six.log_size"), F.lit(62))).cast("long"))
    base = _dotted(_number(address) - F.pmod(_number(address), size))
    return each.withColumns(
        {
            "valid": single | network | F.col("six.normalised").isNotNull(),
            "is_range": network | F.coalesce("six.is_range", F.lit(False)),
            "normalised": F.when(network, F.concat(base, F.lit("/"), bits.cast("string"))).when(single, F.col("item")).otherwise(F.col("six.normalised")),
            "size": F.coalesce(size, size6),
            "large": F.coalesce(F.coalesce(size, size6) > LARGE_NETWORK, F.lit(False)),
        }
    ).drop("six")


def valid_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def single_target(target: Column) -> Column:
    """The trimmed target if it is one host or one web address, else null: no lists, networks or paths."""
    own = F.trim(F.coalesce(target, F.lit("")))
    address = own.rlike(r"^(?i:https?):")
    one = F.when(own.contains(",") | (own == ""), F.lit(False)).when(address, valid_url(own)).otherwise(~own.rlike("[/ ]"))
    return F.when(one, own)
