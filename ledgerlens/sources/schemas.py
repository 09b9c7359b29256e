"""Declared schemas of the logical tables.

The source tables are external and fixed; each logical table is declared here and checked when it is registered.
Wei amounts are decimals so that ``gas_price * gas_used`` never overflows 64 bits and sums stay exact. ETH and USD amounts
have 18 places, token prices nine; a source with more places is refused, as a cast would round it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NTZ = T.TimestampNTZType()
S = T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


MONEY = T.DecimalType(38, 18)
FEE_COST = _schema(("block_timestamp", NTZ), ("gas_spend", MONEY), ("gas_spend_usd", MONEY))
FEE_ONLY = _schema(("block_timestamp", NTZ), ("gas_spend", MONEY))

SCHEMAS: dict[str, T.StructType] = {
    "transactions": _schema(
        ("hash", S),
        ("block_timestamp", NTZ),
        ("from_address", S),
        ("to_address", S),
        ("value", T.DecimalType(38, 0)),
        ("receipt_l1_fee", T.DecimalType(26, 0)),
        ("receipt_effective_gas_price", T.DecimalType(20, 0)),
        ("receipt_gas_used", T.DecimalType(8, 0)),
    ),
    "contracts": _schema(("address", S), ("deployer", S), ("block_timestamp", NTZ)),
    "labels_apps": _schema(("address", S), ("name", S), ("slug", S), ("category", S)),
    "token_prices_hourly": _schema(("hour", NTZ), ("symbol", S), ("usd_price", T.DecimalType(20, 9))),
    "l1_batch_fees": FEE_COST,
    "l1_verification_fees": FEE_COST,
    "l1_bridge_revenue": _schema(("block_timestamp", NTZ), ("bridge_fee", MONEY)),
    "l1_gas_oracle_fees": FEE_ONLY,
    "l2_gas_oracle_fees": FEE_ONLY,
    "deployments": _schema(
        ("chain", S),
        ("deployer", S),
        ("created_at", NTZ),
        ("token_type", S),
        ("is_min_length", T.IntegerType()),
        ("is_used", T.IntegerType()),
    ),
    "git_commits": _schema(("date", NTZ), ("username", S)),
    "protocol_tvl": _schema(("slug", S), ("payload", S)),
}

# Event-time column of each fact table; these tables are cut at ``ts <= as_of``. Dimensions (labels, prices,
# protocol payloads) are not cut.
EVENT_TIME = {
    "transactions": "block_timestamp",
    "contracts": "block_timestamp",
    "l1_batch_fees": "block_timestamp",
    "l1_verification_fees": "block_timestamp",
    "l1_bridge_revenue": "block_timestamp",
    "l1_gas_oracle_fees": "block_timestamp",
    "l2_gas_oracle_fees": "block_timestamp",
    "deployments": "created_at",
    "git_commits": "date",
}

# Optional date partition column of each fact table (``to_date`` of its event time). Tables stored with it get
# partition pruning from the ``as_of`` cut and from every metric's time window (see ``Tables.window``).
PARTITION_COLUMNS = {name: ("created_date" if ts == "created_at" else "commit_date" if ts == "date" else "block_date") for name, ts in EVENT_TIME.items()}

# Keys the metrics assume unique: a duplicate would multiply sums in the joins that use them.
UNIQUE_KEYS = {"contracts": ["address"], "labels_apps": ["address"], "token_prices_hourly": ["hour", "symbol"], "protocol_tvl": ["slug"]}


class SchemaError(ValueError):
    pass


def conform(name: str, df: DataFrame, strict_types: bool = False) -> DataFrame:
    """Select the declared columns of ``name`` in declared order, casting other types to the declared ones.

    Missing columns raise :class:`SchemaError`, and so do decimals with more places than declared (the cast would round
    them); digits before the point that do not fit raise when the row is read. Extra columns are dropped (column
    pruning then reaches the scan).
    """
    schema = SCHEMAS[name]
    if [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]:
        return df  # already the declared shape
    present = {f.name.lower(): f for f in df.schema.fields}
    cols = []
    for field in schema.fields:
        src = present.get(field.name.lower())
        if src is None:
            raise SchemaError(f"{name}: missing column {field.name!r}; has {sorted(present)}")
        same_scale_decimal = (
            isinstance(src.dataType, T.DecimalType)
            and isinstance(field.dataType, T.DecimalType)
            and src.dataType.scale == field.dataType.scale
        )
        if isinstance(src.dataType, T.DecimalType) and isinstance(field.dataType, T.DecimalType) and src.dataType.scale > field.dataType.scale:
            raise SchemaError(f"{name}.{field.name}: {src.dataType.simpleString()} has more places than {field.dataType.simpleString()}")
        if src.dataType == field.dataType or same_scale_decimal:
            # A wider decimal of the same scale (e.g. production wei columns as DECIMAL(38,0)) is kept as is:
            # narrowing it could overflow.
            cols.append(df[src.name].alias(field.name))
        elif strict_types:
            raise SchemaError(f"{name}.{field.name}: expected {field.dataType.simpleString()}, got {src.dataType.simpleString()}")
        else:
            cols.append(df[src.name].cast(field.dataType).alias(field.name))
    return df.select(*cols)
