"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}
HASH_PATTERN = "^0x[a-fA-F0-9]{64}$"
ADDRESS_PATTERN = "^(0[xX])?[0-9a-fA-F]{40}$"
INTEGER_PATTERN = "^-?[0-9]+$"
WHITESPACE = " \t\n\r\f\v\u0085\u00a0"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    return F.coalesce(trimmed(value), F.lit("")) == ""


def normalize_address(value: Column) -> Column:
    """The join key of an address: lower case with prefix; other text is only trimmed."""
    text = trimmed(value)
    return F.when(
        text.rlike(ADDRESS_PATTERN), F.concat(F.lit("0x"), F.lower(F.right(text, F.lit(40))))
    ).otherwise(text)


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, number in SEVERITY_RANK.items():
        rank = F.when(severity == name, number).otherwise(rank)
    return rank


def rank_label(rank: Column) -> Column:
    label = F.lit("none")
    for name, number in SEVERITY_RANK.items():
        label = F.when(rank == number, name).otherwise(label)
    return label


def entity_type_or_default(entity_type: Column, is_contract: Column) -> Column:
    default = F.when(F.coalesce(is_contract, F.lit(False)), "contract").otherwise("wallet")
    return F.coalesce(empty_to_null(entity_type), default)


def risk_label_first(label: Column, flag_risk: Column) -> Column:
    """A label decides whenever there is one; a label of 'none' hides flag risk."""
    return F.coalesce(empty_to_null(label), flag_risk, F.lit("none"))


def risk_flags_first(label: Column, flag_risk: Column) -> Column:
    """Flag risk decides whenever there is any, even if the label is graver."""
    return F.coalesce(F.nullif(empty_to_null(flag_risk), F.lit("none")), empty_to_null(label), F.lit("none"))


def octets(data: Column) -> Column:
    return F.coalesce(F.octet_length(data), F.lit(0))


def bytes_to_hex(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.coalesce(data, F.lit(b"")))))


def payload_text_to_hex(text: Column) -> Column:
    """Text payloads: hex passes through, base64 is decoded, anything else stays as it is."""
    decoded = F.try_to_binary(text, F.lit("base64"))
    return (
        F.when(text.isNull() | (text == ""), "0x")
        .when(text.startswith("0x"), text)
        .otherwise(F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(decoded))), text))
    )


def search_target(term: Column) -> Column:
    return F.when(trimmed(term).rlike(HASH_PATTERN), "transaction").otherwise("account")


def _format_unit(amount: Column, power: int, precision: int, suffix: str) -> Column:
    # Text arithmetic: amounts may have up to 78 digits, more than any decimal holds.
    negative = amount.startswith("-")
    digits = F.regexp_replace(amount, "^-", "")
    width = F.greatest(F.length(digits), F.lit(power + 1))
    padded = F.lpad(digits, width, F.lit("0"))
    whole = F.regexp_replace(F.left(padded, F.length(padded) - power), "^0+(?=[0-9])", "")
    fraction = F.rtrim(F.left(F.right(padded, F.lit(power)), F.lit(precision)), F.lit("0"))
    shown = F.concat(
        F.when(negative, "-").otherwise(""),
        whole,
        F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""),
        F.lit(f" {suffix}"),
    )
    return (
        F.when(amount.isNull() | (amount == ""), f"0 {suffix}")
        .when(amount.rlike(INTEGER_PATTERN), shown)
        .otherwise(amount)
    )


def format_eth(amount: Column, precision: int = 4) -> Column:
    """Wei text as ether; digits beyond the precision are cut off, not rounded."""
    return _format_unit(amount, 18, precision, "ETH")


def format_gwei(amount: Column, precision: int = 2) -> Column:
    return _format_unit(amount, 9, precision, "Gwei")


def short_address(address: Column, width: int = 6) -> Column:
    return (
        F.when(address.isNull() | (address == ""), "Unknown")
        .when(F.length(address) <= width * 2 + 2, address)
        .otherwise(F.concat(F.left(address, F.lit(width + 2)), F.lit("…"), F.right(address, F.lit(width))))
    )


def compact_count(value: Column) -> Column:
    """Counts with one decimal and K/M/B/T; a value that rounds up to 1000 moves to the next unit."""
    number = value.cast("double")
    size = F.abs(number)

    def scaled(divisor: float, suffix: str) -> Column:
        text = F.format_string("%.1f", F.round(number / divisor, 1))
        return F.concat(F.regexp_replace(text, r"\.0$", ""), F.lit(suffix))

    return (
        F.when(value.isNull(), "0")
        .when(size < 999.95, scaled(1.0, ""))
        .when(size < 999.95e3, scaled(1e3, "K"))
        .when(size < 999.95e6, scaled(1e6, "M"))
        .when(size < 999.95e9, scaled(1e9, "B"))
        .otherwise(scaled(1e12, "T"))
    )


def format_percent(value: Column, digits: int = 1) -> Column:
    usable = value.isNotNull() & ~F.isnan(value)
    return F.when(usable, F.format_string(f"%.{digits}f%%", F.round(value, digits))).otherwise("0%")


def format_similarity(value: Column) -> Column:
    return format_percent(value * 100, 1)


def datetime_label(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "MMM d, yyyy, HH:mm 'UTC'"), F.lit("Unavailable"))


def delta_percent(current: Column, previous: Column) -> Column:
    now = F.coalesce(current, F.lit(0)).cast("double")
    before = F.coalesce(previous, F.lit(0)).cast("double")
    from_zero = F.when(now != 0, 100.0).otherwise(0.0)
    return F.when(before == 0, from_zero).otherwise((now - before) / F.greatest(before, F.lit(1.0)) * 100)


def risk_text(level: Column) -> Column:
    return F.lower(F.coalesce(empty_to_null(level), F.lit("unknown")))


def feature_title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def signed_value(value: Column) -> Column:
    return F.format_string("%+.2f", value)


def circular_severity(hops: Column) -> Column:
    return F.when(hops <= 2, "high").when(hops == 3, "medium").otherwise("low")


def bytecode_severity(similarity: Column) -> Column:
    return F.when(similarity >= 0.995, "high").when(similarity >= 0.985, "medium").otherwise("low")


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null when either has no direction."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def features_to_json(features: Column) -> Column:
    return F.to_json(features)


def features_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,double>")


def clamp_limit(limit: int | None, default: int, maximum: int | None = None) -> int:
    """Limits that are missing or not positive become the default; larger ones the maximum, if there is one."""
    if limit is None or limit <= 0:
        return default
    return limit if maximum is None else min(limit, maximum)


def clamp_hours(hours: int | None) -> int:
    return clamp_limit(hours, 24, 720)


def clamp_depth(depth: int | None) -> int:
    return clamp_limit(depth, 2, 3)


def clamp_hops(hops: int | None) -> int:
    return clamp_limit(hops, 3, 4)


def bucket_unit(unit: str | None) -> str:
    return unit if unit in ("minute", "hour", "day") else "hour"
