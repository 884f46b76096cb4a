"""Column expressions; everything here stays inside whole-stage codegen."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the portable integer mixer: the Mersenne prime 2**31 - 1 and
# two multipliers below it, so every product stays under 2**62.
MIX_PRIME = 2147483647
MIX_FIRST = 48271
MIX_SECOND = 69621

NUMBER_PATTERN = r"(\d+\.?\d*|\.\d*)([eE][+-]?\d+)?"


def _long(x) -> Column:
    if isinstance(x, str):
        x = F.col(x)
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def int_div(a, b) -> Column:
    return F.call_function("div", _long(a), _long(b))


def block_size(rank, n, parts) -> Column:
    """Rows owned by a rank when n rows are dealt in contiguous blocks and the
    remainder goes to the first ranks."""
    return int_div(n, parts) + F.when(_long(rank) < _long(n) % _long(parts), 1).otherwise(0)


def block_start(rank, n, parts) -> Column:
    return _long(rank) * int_div(n, parts) + F.least(_long(rank), _long(n) % _long(parts))


def block_rank(pos, n, parts) -> Column:
    """Owner of a position, in closed form: no range join against the block bounds."""
    base, extra = int_div(n, parts), _long(n) % _long(parts)
    wide = extra * (base + 1)
    narrow_width = F.greatest(base, F.lit(1).cast("bigint"))
    return (F.when(_long(pos) < wide, int_div(pos, base + 1))
            .otherwise(extra + int_div(_long(pos) - wide, narrow_width)))


def mix(x, seed=0) -> Column:
    """Pseudo-random integer in [0, 2**31 - 1) from an integer column, using only
    integer arithmetic so that any SQL engine reproduces it."""
    a = F.pmod(_long(x), F.lit(MIX_PRIME).cast("bigint")) * MIX_FIRST
    a = (a + _long(seed) * MIX_SECOND + 1) % MIX_PRIME
    a = (a * a + MIX_SECOND) % MIX_PRIME
    return (a * a + MIX_FIRST) % MIX_PRIME


def uniform_int(x, max_value, seed=0) -> Column:
    """Uniform integer in [0, max_value]."""
    return mix(x, seed) % (_long(max_value) + 1)


def parse_run_name(name, style="slash") -> Column:
    """Split a benchmark name into a struct; NULL when it does not fit.

    ``slash``: ``impl/distribution/size/max_value[/...]``.
    ``underscore``: ``impl_size_max_distribution`` before the first slash.
    """
    name = F.col(name) if isinstance(name, str) else name
    if style == "slash":
        pieces = F.split(name, "/", -1)
        places = {"impl": 0, "dist": 1, "size": 2, "max_value": 3}
    elif style == "underscore":
        pieces = F.split(F.get(F.split(name, "/", -1), F.lit(0)), "_", -1)
        places = {"impl": 0, "dist": None, "size": 1, "max_value": 2}
    else:
        raise ValueError(f"unknown name style {style!r}")

    def parsed(p):
        def field(name):
            if places[name] is None:
                rest = F.greatest(F.size(p) - 3, F.lit(0))
                return F.array_join(F.slice(p, F.lit(4), rest), "_").alias(name)
            text = F.get(p, F.lit(places[name]))
            return (text.try_cast("bigint") if name in ("size", "max_value") else text).alias(name)

        fits = (F.size(p) >= 4) & field("size").isNotNull() & field("max_value").isNotNull()
        return F.when(fits, F.struct(*[field(f) for f in ("impl", "dist", "size", "max_value")]))

    # the lambda variable keeps the split from being evaluated once per field
    return F.element_at(F.transform(F.array(pieces), parsed), 1)


def extract_metric(report, key) -> Column:
    """First number at or after ``key`` in a text report, else 0."""
    report = F.col(report) if isinstance(report, str) else report
    start = F.instr(report, key)
    tail = F.when(start > 0, F.substr(report, start))
    return F.coalesce(F.regexp_extract(tail, NUMBER_PATTERN, 0).try_cast("double"), F.lit(0.0))


@F.pandas_udf(T.StringType())
def two_decimals(values: pd.Series) -> pd.Series:
    """Display text with two decimals, rounded from the exact binary value. Built-in
    formatting rounds the shortest decimal text instead and differs on ties."""
    return pd.Series([None if pd.isna(v) else f"{v:.2f}" for v in values], dtype=object)
