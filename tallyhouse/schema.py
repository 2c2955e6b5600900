"""Declared tables: columns, keys, minimum sizes, and other fixed domain values."""

from __future__ import annotations

# The commerce tables and their columns, types in Spark DDL.
TABLE_COLUMNS = {
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_zip_code_prefix": "string",
        "customer_city": "string",
        "customer_state": "string",
    },
    "sellers": {
        "seller_id": "string",
        "seller_zip_code_prefix": "string",
        "seller_city": "string",
        "seller_state": "string",
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        "product_name_lenght": "int",
        "product_description_lenght": "int",
        "product_photos_qty": "int",
        "product_weight_g": "int",
        "product_length_cm": "int",
        "product_height_cm": "int",
        "product_width_cm": "int",
    },
    "product_category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_carrier_date": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp_ntz",
        "price": "decimal(10,2)",
        "freight_value": "decimal(10,2)",
    },
    "order_payments": {
        "order_id": "string",
        "payment_sequential": "int",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "decimal(10,2)",
    },
    "order_reviews": {
        "review_id": "string",
        "order_id": "string",
        "review_score": "int",
        "review_comment_title": "string",
        "review_comment_message": "string",
        "review_creation_date": "timestamp_ntz",
        "review_answer_timestamp": "timestamp_ntz",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "string",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
        "geolocation_city": "string",
        "geolocation_state": "string",
    },
    "geolocation_by_zip": {
        "geolocation_zip_code_prefix": "string",
        "geolocation_lat": "double",
        "geolocation_lng": "double",
        "geolocation_city": "string",
        "geolocation_state": "string",
    },
}

# Primary keys. Raw geolocation has none.
TABLE_KEYS = {
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "product_category_translation": ["product_category_name"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id"],
    "geolocation_by_zip": ["geolocation_zip_code_prefix"],
}

# Minimum row counts a complete load must reach.
MINIMUM_ROWS = {
    "customers": 99000,
    "sellers": 3000,
    "products": 32000,
    "product_category_translation": 70,
    "orders": 99000,
    "order_items": 110000,
    "order_payments": 100000,
    "order_reviews": 98000,
    "geolocation": 900000,
}

# Relationships between tables that no constraint enforces.
SOFT_FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
    ("products", "product_category_name", "product_category_translation", "product_category_name"),
]

# Columns of the evaluation result file, in file order.
RESULT_COLUMNS = [
    "query_id", "question", "em", "ex", "latency_sec", "input_tokens",
    "output_tokens", "cost_usd", "status", "table", "time_frame", "filters",
    "aggregation", "join", "difficulty", "gold_sql", "predicted_sql",
    "error", "ground_truth_rows",
]

# Graded dimensions of a result, in report order.
RESULT_DIMENSIONS = ["table", "filters", "aggregation", "join", "time_frame"]

# Difficulty levels and the letter each gives to a case id.
DIFFICULTY_LETTERS = {"easy": "e", "medium": "m", "hard": "h"}

# Model prices in USD per million tokens (input, output).
MODEL_PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-4.1": (10.00, 40.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "o4-mini": (4.00, 16.00),
    "gpt-5.4": (2.50, 15.00),
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
