"""The ten tables: columns, types, defaults, and reading them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The relational schema, one "column type" pair per column. Ids are strings here
# (UUIDs in production); the operators accept any id type.
SCHEMAS: dict[str, str] = {
    "users": """id string, username string, email string, full_name string, role string,
        is_active boolean, permissions string, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "clients": """id string, name string, legal_name string, mb string, pib string, address string,
        city string, municipality string, street string, house_number string,
        google_maps_link string, contact_person string, contact string, bank_info string,
        is_manual_address boolean, telegram string, instagram string, phone string, email string,
        installment_payment boolean, installment_term int, showcase boolean, bar boolean,
        notes string, created_at timestamp_ntz, updated_at timestamp_ntz, created_by string""",
    "products": """id string, code string, name string, price decimal(10,2), weight decimal(8,2),
        category string, description string, is_active boolean, created_at timestamp_ntz,
        updated_at timestamp_ntz, created_by string""",
    "invoices": """id string, number string, date date, due_date date, client_id string,
        delivery_address string, vat_rate decimal(5,2), reference string, subtotal decimal(12,2),
        vat_amount decimal(12,2), total decimal(12,2), status string, is_delivered boolean,
        is_paid boolean, notes string, created_at timestamp_ntz, updated_at timestamp_ntz,
        created_by string""",
    "invoice_items": """id string, invoice_id string, product_id string, quantity int,
        unit_price decimal(10,2), total_price decimal(12,2), created_at timestamp_ntz""",
    "deliveries": """id string, number string, date date, due_date date, client_id string,
        delivery_method string, status string, is_signed boolean, notes string,
        created_at timestamp_ntz, updated_at timestamp_ntz, created_by string""",
    "delivery_items": """id string, delivery_id string, product_id string, quantity int,
        unit string, created_at timestamp_ntz""",
    "product_groups": """id string, name string, quantity_type string,
        original_quantity decimal(12,2), current_quantity decimal(12,2), shipment_date date,
        reservation_type string, reservation_amount decimal(12,2), created_at timestamp_ntz,
        updated_at timestamp_ntz, created_by string""",
    "product_group_items": """id string, group_id string, product_id string,
        created_at timestamp_ntz""",
    "activity_logs": """id string, user_id string, action string, entity_type string,
        entity_id string, details string, ip_address string, user_agent string,
        created_at timestamp_ntz""",
}

# Column defaults on insert. Ids and times are arguments of apply_defaults.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "user", "is_active": True, "permissions": "{}"},
    "clients": {
        "is_manual_address": False, "installment_payment": False, "showcase": False, "bar": False,
    },
    "products": {"weight": 0, "is_active": True},
    "invoices": {"vat_rate": 20, "status": "draft", "is_delivered": False, "is_paid": False},
    "invoice_items": {},
    "deliveries": {"status": "draft", "is_signed": False},
    "delivery_items": {"unit": "ком"},
    "product_groups": {"reservation_amount": 0},
    "product_group_items": {},
    "activity_logs": {},
}

# The six tables whose updated_at is maintained on every change.
TOUCHED = ("users", "clients", "products", "invoices", "deliveries", "product_groups")

ID_COLUMNS = (
    "id", "client_id", "product_id", "invoice_id", "delivery_id", "group_id",
    "user_id", "entity_id", "created_by",
)


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def load_tables(
    spark: SparkSession, path: str, tables: Iterable[str] = tuple(SCHEMAS)
) -> dict[str, DataFrame]:
    """Scan tables stored as ``path/<table>`` Parquet directories with the declared schema."""
    return {t: spark.read.schema(schema(t)).parquet(f"{path}/{t}") for t in tables}


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
) -> DataFrame:
    """Scan a table of a relational database, split into ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.options(**properties)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=str(partitions),
        )
    return ensure_columns(reader.load(), table)


def ensure_columns(df: DataFrame, table: str) -> DataFrame:
    """Add the declared columns ``df`` lacks as typed NULLs; keep what is there.

    Missing id-valued columns take the type of the table's own ids.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    id_type = present.get("id")
    added = []
    for field in schema(table).fields:
        if field.name not in present:
            wanted = id_type if id_type is not None and field.name in ID_COLUMNS else field.dataType
            added.append(F.lit(None).cast(wanted).alias(field.name))
    return df.select("*", *added)


def apply_defaults(
    df: DataFrame,
    table: str,
    new_id: Column | None = None,
    now: dt.datetime | Column | None = None,
) -> DataFrame:
    """Fill absent and NULL columns of rows about to be inserted.

    ``new_id`` must be a deterministic expression (see ``derived_id``): a lost task is run again
    and has to produce the same ids.
    """
    full = ensure_columns(df, table)
    types = {f.name: f.dataType for f in full.schema.fields}
    fill: dict[str, Column] = {c: F.lit(v) for c, v in DEFAULTS[table].items()}
    if new_id is not None:
        fill["id"] = new_id
    if now is not None:
        moment = now if isinstance(now, Column) else F.lit(now)
        fill.update({c: moment for c in ("created_at", "updated_at") if c in types})
    return full.withColumns(
        {c: F.coalesce(F.col(c), v.cast(types[c])) for c, v in fill.items()}
    )


def derived_id(*parts: Column | str) -> Column:
    """A UUID-shaped id computed from the row, hence the same on every run of a task."""
    digest = F.md5(F.concat_ws("\u0001", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
