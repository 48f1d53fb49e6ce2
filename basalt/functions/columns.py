"""Column expressions that several operators share. All stay in generated code; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name space of deterministic ids; ids made under another one differ.
ID_NAMESPACE = "basalt"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deterministic_uuid(kind: str, key, namespace: str = ID_NAMESPACE) -> Column:
    """A name-based id: MD5 of ``namespace:kind:key`` with version 3 and the RFC variant."""
    m = F.md5(F.concat(F.lit(f"{namespace}:{kind}:"), _c(key)).cast("binary"))
    return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.lit("3"), F.substring(m, 14, 3)), F.concat(F.translate(F.substring(m, 17, 1), "0123456789abcdef", "89ab" * 4), F.substring(m, 18, 3)), F.substring(m, 21, 12))


def valid_at(day, start, end) -> Column:
    """``day`` lies in [start, end); a null bound is open."""
    d, a, b = _c(day), _c(start), _c(end)
    return (a.isNull() | (d >= a)) & (b.isNull() | (d < b))


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe_ln(x) -> Column:
    """Natural logarithm, null unless positive."""
    x = _c(x)
    return F.when(x > 0, F.ln(x))


def sample_kurtosis(x, where: Column | None = None) -> Column:
    """Excess kurtosis of a sample (G2), from Spark's population figure; null under four values."""
    x = _c(x) if where is None else F.when(where, _c(x))
    n, g = F.count(x).cast("double"), F.kurtosis(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def when_idx(x, low: int, high: int | None = None) -> Column:
    """``x`` where the backward index is in [low, high]."""
    i = F.col("idx")
    return F.when(i == low if high is None else i.between(low, high), _c(x))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Spark puts a group limit before the shuffle, so this is cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def rounded(x, digits: int = 6) -> Column:
    """Rounded by plain arithmetic, which gives the same in any engine."""
    k = float(10**digits)
    return F.floor(_c(x) * k + 0.5).cast("double") / k


#: Vendor security type code, instrument type, security form.
INSTRUMENT_TYPES = (
    ("CS", "common_stock", "common_stock"),
    ("OS", "ordinary_shares", "common_stock_like"),
    ("PFD", "preferred_stock", "preferred"),
    ("ETF", "etf", "fund"),
    ("ETN", "etn", "note"),
    ("ETV", "etv", "fund"),
    ("ETS", "ets", "fund"),
    ("FUND", "closed_end_fund", "fund"),
    ("BASKET", "basket", "fund"),
    ("UNIT", "unit", "unit"),
    ("RIGHT", "right", "right"),
    ("WARRANT", "warrant", "warrant"),
    ("ADRC", "adr_common", "adr"),
    ("ADRP", "adr_preferred", "adr"),
    ("ADRR", "adr_right", "adr"),
    ("ADRW", "adr_warrant", "adr"),
    ("GDR", "gdr", "adr"),
    ("NYRS", "ny_registry_shares", "adr"),
    ("SP", "structured_product", "structured_product"),
    ("BOND", "bond", "bond"),
    ("AGEN", "agency_bond", "bond"),
    ("EQLK", "equity_linked_bond", "bond"),
    ("LT", "liquidating_trust", "trust"),
)
UNKNOWN_TYPE = "unknown_stock_like"
CLEAN_COMMON_STOCK = ("CS",)


def classify(code) -> Column:
    """Struct (instrument_type, security_form, is_clean_common_stock) of a vendor type code in any case."""
    code = F.upper(F.coalesce(_c(code), F.lit("")))
    kind, form = (F.create_map(*[F.lit(x) for r in INSTRUMENT_TYPES for x in (r[0], r[i])]) for i in (1, 2))
    return F.struct(
        F.coalesce(F.element_at(kind, code), F.lit(UNKNOWN_TYPE)).alias("instrument_type"),
        F.coalesce(F.element_at(form, code), F.lit(UNKNOWN_TYPE)).alias("security_form"),
        code.isin(*CLEAN_COMMON_STOCK).alias("is_clean_common_stock"),
    )
