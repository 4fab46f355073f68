"""Fixed schemas of files read and written."""

from __future__ import annotations

from pyspark.sql import types as T

# Column types of the raw transaction files, by header name. Identifiers are read as text and
# normalised later; timestamps and dates are parsed there too.
RAW_TXN = {
    "trans_date_trans_time": T.StringType(),
    "cc_num": T.StringType(),
    "merchant": T.StringType(),
    "category": T.StringType(),
    "amt": T.DoubleType(),
    "first": T.StringType(),
    "last": T.StringType(),
    "gender": T.StringType(),
    "street": T.StringType(),
    "city": T.StringType(),
    "state": T.StringType(),
    "zip": T.StringType(),
    "lat": T.DoubleType(),
    "long": T.DoubleType(),
    "city_pop": T.LongType(),
    "job": T.StringType(),
    "dob": T.StringType(),
    "trans_num": T.StringType(),
    "unix_time": T.LongType(),
    "merch_lat": T.DoubleType(),
    "merch_long": T.DoubleType(),
    "is_fraud": T.ShortType(),
}

# Columns of the relations, in the order in which they are stored.
DIM_CUSTOMER = (
    "customer_id bigint, cc_num string, first string, last string, gender string, street string, city string, "
    "state string, zip string, lat double, long double, city_pop bigint, job string, dob date"
)
DIM_MERCHANT = "merchant_id bigint, merchant_name string, merch_lat double, merch_long double"
DIM_CATEGORY = "category_id bigint, category_name string"
DIM_DATE = (
    "date_id bigint, trans_date date, year int, month int, day int, day_of_week string, is_weekend boolean, "
    "year_month string"
)
FACT_TRANSACTIONS = (
    "transaction_id bigint, trans_num string, customer_id bigint, merchant_id bigint, category_id bigint, "
    "date_id bigint, trans_ts timestamp_ntz, unix_time bigint, amt double, is_fraud smallint, year int, month int, "
    "hour int, is_weekend boolean, cust_merch_distance_km double, split string"
)
_METRICS = (
    "total_tx bigint, fraud_tx bigint, fraud_rate double, total_amount double, fraud_amount double, "
    "fraud_share_by_value double"
)
RELATIONS = {
    "dim_customer": DIM_CUSTOMER,
    "dim_merchant": DIM_MERCHANT,
    "dim_category": DIM_CATEGORY,
    "dim_date": DIM_DATE,
    "fact_transactions": FACT_TRANSACTIONS,
    "agg_daily_fraud": (
        "trans_date date, year int, month int, day int, day_of_week string, is_weekend boolean, year_month string, "
        + _METRICS
    ),
    "agg_monthly_fraud": "year int, month int, year_month string, " + _METRICS,
    "agg_merchant_fraud": "merchant_id bigint, merchant_name string, " + _METRICS,
    "agg_category_fraud": "category_id bigint, category_name string, " + _METRICS,
}

CHUNK = (
    "chunk_id string, doc_id bigint, section string, subsection string, block_index int, chunk_index int, text string"
)
PAYLOAD = (
    "struct<chunk_id: string, section: string, subsection: string, block_index: int, chunk_index: int, text: string>"
)
COLLECTION = f"id string, vector array<float>, payload {PAYLOAD}"


def columns(relation: str) -> tuple[str, ...]:
    """Names of the columns of a relation, in order."""
    return tuple(field.split()[0] for field in RELATIONS[relation].split(", "))
