"""Aggregates, all with map-side partials. Results over integers are exact and rounded once; those out of range are errors."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..errors import InvalidQuery
from .scalar import E, finite, spark_type, type_name


def aggregate(name: str, distinct: bool, arg: E | None) -> E:
    """The aggregate column of one call; ``arg`` None means COUNT(*)."""
    if arg is None:
        return E(F.count(F.lit(1)), "int")
    if name == "COUNT":
        return E(F.countDistinct(arg.col) if distinct else F.count(arg.col), "int")
    if arg.variants:
        raise InvalidQuery(f"{name} cannot combine {' and '.join(type_name(v.type) for v in arg.variants)}")
    if name == "COLLECT_LIST":
        inner = arg.type
        return E(F.collect_set(arg.col) if distinct else F.collect_list(arg.col), ("list", inner), binding=arg.binding)
    if name in ("MIN", "MAX"):
        if isinstance(arg.type, tuple) or arg.type == "path":
            raise InvalidQuery(f"{name} does not take {type_name(arg.type)}")
        return E(F.min(arg.col) if name == "MIN" else F.max(arg.col), arg.type)
    if arg.type not in ("int", "float", "null"):
        raise InvalidQuery(f"{name} does not take {type_name(arg.type)}")
    c = arg.col if arg.type != "null" else F.lit(None).cast("bigint")
    if name == "SUM":
        if arg.type == "float":
            return E(finite(F.sum_distinct(c) if distinct else F.sum(c)), "float")
        exact = c.cast("decimal(38,0)")
        return E((F.sum_distinct(exact) if distinct else F.sum(exact)).cast("bigint"), "int")
    if name == "AVG":
        if arg.type == "float":
            return E(finite(F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)), "float")
        exact = c.cast("decimal(38,0)")
        total, n = (F.sum_distinct(exact), F.count_distinct(c)) if distinct else (F.sum(exact), F.count(c))
        return E(F.when(n > 0, _ratio(total, n)), "float")
    if name in ("STDDEV_POP", "STDDEV_SAMP"):
        if arg.type == "float":
            return E(F.stddev_pop(c) if name == "STDDEV_POP" else F.stddev_samp(c), "float")
        # Sums over halves of the integers stay within 38 digits; the last step is exact as well.
        high, low = F.shiftright(c, 32).cast("decimal(19,0)"), c.bitwiseAND(0xFFFFFFFF).cast("decimal(19,0)")
        sums = [F.sum(x.cast("decimal(38,0)")).cast("string") for x in (high, low, high * high, high * low, low * low)]
        return E(_deviation(F.lit(name == "STDDEV_SAMP"), F.count(c), *sums), "float")
    raise InvalidQuery(f"{name} is no aggregate")


def counted_rows(arg: E | None, weight: str) -> E:
    """COUNT over rows that each stand for as many as their weight; ``arg`` None means COUNT(*)."""
    value = F.col(weight) if arg is None else F.when(arg.col.isNotNull(), F.col(weight))
    return E(F.coalesce(F.sum(value), F.lit(0).cast("bigint")), "int")


_EXACT = 1 << 53


def _ratio(total: Column, n: Column) -> Column:
    """An exact sum by a count, rounded once: whole part and rest apart where the sum is no exact double."""
    rest = total % n
    whole = ((total - rest) / n).cast("decimal(38,0)")
    apart = F.when(F.abs(whole) < _EXACT, whole.cast("double") + rest.cast("double") / n).otherwise((total / n).cast("double"))
    return F.when(F.abs(total) <= _EXACT, total.cast("double") / n).otherwise(apart)


@F.udf(DoubleType(), useArrow=True)
def _deviation(sample: bool, n: int, high: str, low: str, high_high: str, high_low: str, low_low: str):
    """Once for each group: root of an exact ratio."""
    if not n or sample and n < 2:
        return None
    from decimal import Decimal, localcontext

    total = (int(high) << 32) + int(low)
    squares = (int(high_high) << 64) + (int(high_low) << 33) + int(low_low)
    with localcontext(prec=120):
        return float((Decimal(n * squares - total * total) / Decimal(n * (n - 1 if sample else n))).sqrt())


def apart(name: str, distinct: bool, arg: E | None) -> bool:
    """Whether a call is computed over a table of its own and joined by the grouping keys: no built-in gives it exactly."""
    return name.startswith("PERCENTILE") or distinct and name.startswith("STDDEV")


def beside(name: str, distinct: bool, arg: E, fraction: E | None, rows: DataFrame, by: list[str], argument: str, column: str, freeze) -> tuple[DataFrame, E]:
    """(the grouping keys and ``column``, the typed result) of one such call over rows with the keys and the argument.

    Values are counted first. Percentiles sort the distinct values into ranges over all keys, so that one key's values lie in many
    tasks, count what each range holds, and look the wanted ranks up; no task holds all values of a key.
    """
    if arg.type not in ("int", "float", "null"):
        raise InvalidQuery(f"{name} does not take {type_name(arg.type)}")
    values = rows.select(*by, argument).where(F.col(argument).isNotNull())
    if name.startswith("STDDEV"):
        made = aggregate(name, False, arg)
        return values.distinct().groupBy(*by).agg(made.col.alias(column)), made
    if not (fraction and fraction.literal):
        raise InvalidQuery("the fraction of a percentile must not depend on rows")
    kind = "float" if name == "PERCENTILE_CONT" or arg.type == "null" else arg.type
    if fraction.value is None:
        return rows.select(*by).distinct().withColumn(column, F.lit(None).cast(spark_type(kind))) if by else rows.sparkSession.range(1).select(F.lit(None).cast(spark_type(kind)).alias(column)), E(F.col(column), kind)
    if fraction.type not in ("int", "float") or not 0 <= fraction.value <= 1:
        raise InvalidQuery("the fraction of a percentile must be between 0 and 1")
    f = Decimal(repr(fraction.value)) if fraction.type == "float" else Decimal(fraction.value)
    f = f.quantize(Decimal(1).scaleb(-17)) if -f.as_tuple().exponent > 17 else f
    counts = values.groupBy(*by, argument).agg(F.lit(1).cast("long").alias("__n") if distinct else F.count(F.lit(1)).alias("__n"))
    dealt = freeze(counts.repartitionByRange(*by, argument).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"))
    before, whole = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    parts = parts.select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col("__part").alias("__place"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"), F.sum("__m").over(whole).alias("__total"))
    on = F.col("__part") == F.col("__place")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    within = Window.partitionBy(*by, "__part").orderBy(argument).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.join(parts, on).withColumn("__upto", F.col("__start") + F.sum("__n").over(within))
    size = F.col("__total").cast("decimal(20,0)")
    if name == "PERCENTILE_DISC":
        rank = F.greatest(F.ceil(size * F.lit(f)).cast("long") - 1, F.lit(0))  # from 0
        ranks = {"__low": rank, "__high": rank}
        part = F.lit(Decimal(0))
    else:
        exact = (size - 1) * F.lit(f)
        ranks = {"__low": F.floor(exact).cast("long"), "__high": F.ceil(exact).cast("long")}
        part = exact - F.floor(exact)
    found = [F.max(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__n") <= r), F.col(argument))).alias(k) for k, r in ranks.items()]
    ends = ranked.groupBy(*by).agg(*found, F.max(part).alias("__share"))
    low, high, share = F.col("__low"), F.col("__high"), F.col("__share")
    if name == "PERCENTILE_DISC":
        value = low
    elif arg.type == "int":
        value = (low.cast("decimal(20,0)") + (high.cast("decimal(20,0)") - low.cast("decimal(20,0)")) * share.cast("decimal(17,16)")).cast("double")
    else:
        value = low + (high - low) * share.cast("double")
    return ends.select(*by, value.cast(spark_type(kind)).alias(column)), E(F.col(column), kind)
