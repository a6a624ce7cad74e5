"""Semantic types, business roles, domain and schema matching.

Names are judged on the driver (a schema is small); values are judged by two scans: one wide
aggregate of conditional sums and one distinct count per column. The rule cascade then runs as
column expressions over one row per column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    FractionalType,
    IntegralType,
    NumericType,
    TimestampNTZType,
    TimestampType,
)

from .profile import column_counts
from .rules import rate

# Name parts and value sets the type rules look for.
GEO_PARTS = [
    "state", "region", "country", "city", "zip", "postal", "province", "territory", "location", "lat", "latitude", "lon", "longitude",
]
CURRENCY_PARTS = [
    "price", "revenue", "sales", "cost", "salary", "payroll", "amount", "spend", "income", "profit", "freight", "fee",
    "budget", "expense", "cogs", "turnover", "billed", "payments", "compensation",
]
PERCENT_PARTS = ["pct", "percent", "ratio", "margin", "share", "discount", "rate", "ctr", "roi", "cpa"]
RATE_PARTS = ["rate", "pct", "ratio"]
EMAIL_PARTS = ["mail"]
PHONE_PARTS = ["phone", "tel", "mobile", "cell", "fax"]
DATE_PARTS = ["date", "time", "created_at", "updated_at", "dob"]
ID_PARTS = ["_id", "id_", "uuid", "guid", "hash", "sku", "code", "key", "token", "ssn", "passport"]
NUMERIC_ID_PARTS = ["id", "code", "key", "number"]
TEXT_PARTS = ["note", "description", "comment", "summary", "text", "body", "message", "details", "feedback", "review"]
BOOLEAN_TEXT = ["0", "1", "True", "False", "true", "false", "Y", "N", "yes", "no"]
CURRENCY_SIGNS = r"[$€£¥]"
EMAIL_PATTERN = r"^[\w.-]+@[\w.-]+\.\w+$"
SHARE_NEEDED = 0.7
LONG_TEXT_MEAN = 35
CATEGORY_VALUES, CATEGORY_SHARE = 50, 0.2
SMALL_NUMBER = 1000

# Name parts of the simple classifier.
SIMPLE_DATE_PARTS = ["date", "timestamp", "created", "purchase", "time", "day", "period", "year_month"]
SIMPLE_ID_ENDS = ("id", "_key", "_code")
SIMPLE_VALUES = 100

# Patterns per business role in the order they are tried.
ROLE_PATTERNS: dict[str, list[str]] = {
    "revenue": [
        "revenue", "sales", "sales_amount", "amount", "total_sales", "total_amount", "price", "net_sales", "gross_sales", "income",
        "turnover", "spend", "monetary", "subtotal", "grand_total", "salary", "compensation", "budget", "cost_total", "billed", "payments",
    ],
    "profit": ["profit", "net_profit", "gross_profit", "margin", "net_margin", "gain", "earnings", "operating_income", "ebitda"],
    "cost": ["cost", "freight", "shipping", "shipping_cost", "expense", "fee", "tax", "cogs", "unit_cost", "operational_cost"],
    "quantity": [
        "quantity", "qty", "units", "units_sold", "volume", "count", "items", "item_count", "pieces", "shares", "headcount",
        "impressions", "clicks", "conversions",
    ],
    "date": [
        "date", "order_date", "transaction_date", "invoice_date", "created_at", "timestamp", "purchase_date", "joining_date",
        "hire_date", "event_time", "day", "period", "year_month", "datetime", "closed_at", "shipped_date", "launch_date",
    ],
    "customer": [
        "customer", "customer_id", "client", "client_id", "client_name", "buyer", "buyer_id", "user_id", "account_id", "member_id",
        "subscriber_id", "patient_id", "lead_id", "contact",
    ],
    "product": [
        "product", "product_id", "product_name", "item", "item_name", "sku", "stock_code", "service", "article", "good",
        "part_number", "course", "project", "campaign", "campaign_id",
    ],
    "category": [
        "category", "product_category", "department", "dept", "genre", "class", "segment", "type", "division", "channel", "group",
        "tier", "role", "designation",
    ],
    "region": [
        "region", "state", "city", "country", "location", "territory", "province", "zone", "hub", "district", "market", "area", "zip",
        "postal_code", "branch", "office", "site",
    ],
    "order_id": [
        "order_id", "transaction_id", "invoice", "invoice_id", "trans_id", "receipt_id", "bill_id", "ticket_id", "booking_id",
        "deal_id", "order_no", "order_number",
    ],
    "status": ["status", "order_status", "stage", "state_label", "delivery_status", "performance_score", "rating"],
}
NUMERIC_ROLES = {"revenue", "profit", "cost", "quantity"}

# Patterns of the simple KPI mapping.
SIMPLE_ROLES: dict[str, list[str]] = {
    "revenue": ["revenue", "sales", "gross", "amount", "total_amount", "price", "val", "spend"],
    "profit": ["profit", "margin", "net_margin", "gain"],
    "cost": ["cost", "freight", "expense", "fee", "tax"],
    "quantity": ["quantity", "qty", "units", "items", "count", "volume"],
    "order_id": ["order_id", "invoice_id", "transaction_id", "trans_id", "receipt_id"],
    "customer_id": ["customer_id", "user_id", "client_id", "buyer_id", "account_id"],
}

# Domains in the order they are tried: keywords, confidence step, decisive keywords.
DOMAINS: list[tuple[str, list[str], int, list[str]]] = [
    (
        "HR / Workforce Analytics",
        [
            "salary", "employee", "emp_id", "department", "dept", "job_title", "joining_date", "hire_date", "headcount",
            "performance_rating", "attrition", "tenure",
        ],
        12,
        [],
    ),
    (
        "Marketing & Campaigns",
        [
            "campaign", "clicks", "impressions", "leads", "conversions", "ad_spend", "spend", "ctr", "cpc", "roi", "cpa", "channel",
            "ad_group",
        ],
        12,
        ["campaign"],
    ),
    (
        "Inventory & Supply Chain",
        [
            "stock", "inventory", "warehouse", "sku", "reorder", "quantity_on_hand", "supplier", "freight", "shipment", "carrier",
            "lead_time",
        ],
        12,
        [],
    ),
    (
        "Financial & Banking",
        [
            "expense", "income", "budget", "ebitda", "cash_flow", "assets", "liabilities", "tax", "payroll", "dividend",
            "interest_rate", "credit_score", "loan",
        ],
        12,
        [],
    ),
    (
        "Healthcare & Clinical Analytics",
        [
            "patient", "diagnosis", "admission", "discharge", "hospital", "doctor", "physician", "prescription", "dosage", "medical",
            "treatment",
        ],
        12,
        [],
    ),
    (
        "Retail & E-Commerce",
        ["price", "revenue", "product", "order", "sales", "freight", "customer", "category", "item", "quantity", "sku", "store", "cart"],
        10,
        [],
    ),
]
GENERAL_DOMAIN = ("Enterprise Operations / General Tabular", 65)

# Groups of names that mean the same, in the order they are tried.
SYNONYMS: list[list[str]] = [
    ["revenue", "sales", "turnover", "total_amount", "amount", "total_sales", "gross_sales", "income"],
    ["profit", "net_profit", "net_income", "earnings", "margin"],
    ["cost", "cogs", "expenses", "expense", "spend", "spending", "total_cost", "freight_value"],
    ["customer", "customer_id", "cust_id", "client", "client_id", "user_id", "account_id", "customer_name"],
    ["product", "product_name", "product_id", "item", "item_name", "item_id", "sku", "product_title"],
    ["category", "product_category", "product_category_name", "department", "dept", "segment", "division", "group"],
    ["date", "order_date", "purchase_date", "transaction_date", "order_purchase_timestamp", "created_at", "timestamp", "dt"],
    ["quantity", "qty", "units", "count", "volume", "items_count", "order_item_id"],
    ["region", "state", "city", "country", "territory", "location", "area", "customer_state", "customer_city"],
    ["id", "order_id", "transaction_id", "invoice_id", "record_id", "row_id", "emp_id", "employee_id"],
]
SHORT_SYNONYM = 3


def clean_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def _has(name: str, parts: list[str]) -> bool:
    return any(p in name for p in parts)


def kind_of(data_type: DataType) -> str:
    if isinstance(data_type, BooleanType):
        return "boolean"
    if isinstance(data_type, (DateType, TimestampType, TimestampNTZType)):
        return "temporal"
    if isinstance(data_type, IntegralType):
        return "integer"
    if isinstance(data_type, (FractionalType, NumericType)):
        return "float"
    return "text"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column_evidence(name: str, kind: str) -> str:
    """SQL of one column's evidence; as text it costs one call, whatever the number of measures."""
    c = _quoted(name)
    numeric = kind in ("integer", "float")
    number = f"cast({c} AS double)" if numeric else "cast(NULL AS double)"
    flags = ", ".join(_text_literal(v) for v in BOOLEAN_TEXT)
    # Only texts are looked at as text, and parsed as dates only when the name suggests one: no
    # rule asks for more, and turning every number into text would dominate the scan.
    dated = _has(clean_name(name), [*DATE_PARTS, *SIMPLE_DATE_PARTS])
    if kind == "text":
        measures = {
            "boolean_like": f"{c} IN ({flags})",
            "with_at": f"contains({c}, '@')",
            "email_like": f"contains({c}, '@') AND trim({c}) RLIKE {_text_literal(EMAIL_PATTERN)}",
            "parsed": f"try_to_timestamp({c}) IS NOT NULL" if dated else "false",
            "with_colon": f"contains({c}, ':')",
            "with_clock": "false",
            "with_currency": f"{c} RLIKE {_text_literal(CURRENCY_SIGNS)}",
            "fractions": "false",
        }
    else:
        measures = {
            "boolean_like": f"{number} IN (0.0D, 1.0D)" if numeric else "false",
            "with_at": "false",
            "email_like": "false",
            "parsed": f"{c} IS NOT NULL" if kind == "temporal" else "false",
            "with_colon": "false",
            "with_clock": f"date_format({c}, 'HH:mm:ss') <> '00:00:00'" if kind == "temporal" else "false",
            "with_currency": "false",
            "fractions": f"{number} % 1 <> 0" if numeric else "false",
        }
    length = f"avg(length({c}))" if kind == "text" else "cast(NULL AS double)"
    counted = ", ".join(f"'{alias}', count_if({cond})" for alias, cond in measures.items())
    return (
        f"named_struct('column', {_text_literal(name)}, 'kind', '{kind}', 'filled', count({c}), {counted}, "
        f"'low', min({number}), 'high', max({number}), 'mean_length', {length})"
    )


COLUMNS_PER_PASS = 100


def value_evidence(df: DataFrame) -> DataFrame:
    """One row per column with what its values show, from one aggregate per hundred columns and
    without a shuffle of values."""
    out = None
    fields = df.schema.fields
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        parts = [_column_evidence(f.name, kind_of(f.dataType)) for f in fields[start : start + COLUMNS_PER_PASS]]
        rows = df.agg(F.expr(f"array({', '.join(parts)})").alias("a")).select(F.explode("a").alias("e")).select("e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def name_evidence(df: DataFrame) -> DataFrame:
    """What the column names show, as one constant row per column."""
    rules = {
        "n_email": EMAIL_PARTS,
        "n_phone": PHONE_PARTS,
        "n_date": DATE_PARTS,
        "n_time": ["time"],
        "n_percent": PERCENT_PARTS,
        "n_rate": RATE_PARTS,
        "n_currency": CURRENCY_PARTS,
        "n_id": ID_PARTS,
        "n_number_id": NUMERIC_ID_PARTS,
        "n_geo": GEO_PARTS,
        "n_text": TEXT_PARTS,
        "n_simple_date": SIMPLE_DATE_PARTS,
    }
    header = ["column", "position", "n_year", "n_paid", "n_simple_id", *rules]
    rows = []
    for position, name in enumerate(df.columns):
        clean = clean_name(name)
        simple_id = name.lower().endswith(SIMPLE_ID_ENDS) or name.lower() == "sku"
        flags = [clean == "year", clean == "paid", simple_id, *[_has(clean, parts) for parts in rules.values()]]
        rows.append(f"({_text_literal(name)}, {position}, {', '.join(str(f).lower() for f in flags)})")
    return df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({', '.join(_quoted(h) for h in header)})")


def evidence(df: DataFrame) -> DataFrame:
    return name_evidence(df).join(value_evidence(df), "column").join(column_counts(df), "column")


def fine_type() -> Column:
    """The ordered type rules over one row of evidence."""
    filled, unique, rows = F.col("filled"), F.col("unique_count"), F.col("row_count")
    numeric = F.col("kind").isin("integer", "float")

    def share(c: str) -> Column:
        return F.col(c) >= F.greatest(F.lit(1.0), filled * SHARE_NEEDED)

    any_value = filled > 0
    boolean = (F.col("kind") == "boolean") | (any_value & (F.col("boolean_like") == filled) & (unique <= 2))
    email = F.col("n_email") | (any_value & (F.col("with_at") > 0) & share("email_like"))
    small = numeric & any_value & (F.col("high") < SMALL_NUMBER)
    dated_name = (~small & F.col("n_date")) | (F.col("n_year") & numeric & any_value & (F.col("low") > 1900))
    year_range = F.coalesce((F.col("low") >= 1900) & (F.col("high") <= 2100), F.lit(False))
    dated = dated_name & ((~numeric & share("parsed")) | (numeric & year_range)) & any_value
    clock = F.col("n_time") | (F.col("with_colon") > 0)
    in_unit = numeric & any_value & (F.col("low") >= 0) & (F.col("high") <= 1)
    whole = (F.col("kind") == "integer") | (any_value & (F.col("fractions") == 0))
    few = (unique <= CATEGORY_VALUES) | (unique / F.greatest(F.lit(1), rows) < CATEGORY_SHARE)
    return (
        F.when(boolean, "boolean")
        .when(email, "email")
        .when(F.col("n_phone"), "phone")
        .when((F.col("kind") == "temporal") & (F.col("with_clock") > 0), "datetime")
        .when(F.col("kind") == "temporal", "date")
        .when(dated & clock, "datetime")
        .when(dated, "date")
        .when(F.col("n_percent") | (in_unit & F.col("n_rate")), "percentage")
        .when(F.col("n_currency") & (numeric | (F.col("with_currency") > 0)), "currency")
        .when(F.col("n_id") & ~F.col("n_paid"), "id")
        .when(numeric & F.col("n_number_id") & (unique > rows * 0.8), "id")
        .when(numeric & whole, "integer")
        .when(numeric, "float")
        .when(F.col("n_geo"), "geographic")
        .when(F.col("n_text") | (F.col("mean_length") > LONG_TEXT_MEAN), "text")
        .when(few, "categorical")
        .otherwise("text")
    )


def base_type(fine: Column) -> Column:
    return (
        F.when(fine.isin("currency", "percentage", "integer", "float", "numeric"), "numeric")
        .when(fine.isin("date", "datetime"), "date")
        .when(fine.isin("categorical", "geographic"), "categorical")
        .when(fine.isin("boolean", "id"), fine)
        .otherwise("text")
    )


def catalog(df: DataFrame) -> DataFrame:
    """Type, cardinality class, gaps and distinct values of every column."""
    rows = evidence(df).withColumn("fine_type", fine_type())
    unique, total = F.col("unique_count"), F.col("row_count")
    cardinality = F.when(unique / total > 0.5, "high").when(unique > 20, "medium").otherwise("low")
    return rows.select(
        "position",
        "column",
        "kind",
        "fine_type",
        base_type(F.col("fine_type")).alias("base_type"),
        cardinality.alias("cardinality"),
        "null_count",
        rate(F.col("null_count"), total, 2).alias("null_pct"),
        "unique_count",
    )


def simple_types(df: DataFrame) -> DataFrame:
    """The workspace classifier: date, id, numeric, categorical, boolean or text."""
    filled, unique = F.col("filled"), F.col("unique_count")
    numeric = F.col("kind").isin("integer", "float")
    boolean = (F.col("kind") == "boolean") | (~numeric & (filled > 0) & (F.col("boolean_like") == filled) & (unique <= 2))
    dated = F.col("n_simple_date") & (filled > 0) & (numeric | (F.col("parsed") == filled))
    few = (unique <= SIMPLE_VALUES) | ((filled > 0) & (unique / filled < CATEGORY_SHARE))
    kind = (
        F.when(boolean, "boolean")
        .when((F.col("kind") == "temporal") | dated, "date")
        .when(F.col("n_simple_id"), "id")
        .when(numeric, "numeric")
        .when(few, "categorical")
        .otherwise("text")
    )
    return evidence(df).select("column", kind.alias("semantic_type"), "null_count", "unique_count")


def _fits(df: DataFrame, column: str, role: str, dates: set[str]) -> bool:
    kind = kind_of(df.schema[column].dataType)
    if role in NUMERIC_ROLES:
        return kind in ("integer", "float")
    if role == "date":
        return kind == "temporal" or column in dates
    return True


def match_role(df: DataFrame, role: str, patterns: list[str], dates: set[str] | None = None) -> str | None:
    """First fitting column by exact name, then by substring, in pattern order."""
    names = {clean_name(c): c for c in df.columns}
    for exact in (True, False):
        for pattern in patterns:
            for name, column in names.items():
                hit = name == pattern if exact else pattern in name
                if hit and _fits(df, column, role, dates or set()):
                    return column
    return None


def roles(df: DataFrame, types: dict[str, str] | None = None) -> dict[str, str | None]:
    """Column of each business role; ``types`` (column to fine type) supplies the fallbacks."""
    types = types or {}

    def first(*wanted: str) -> str | None:
        return next((c for c in df.columns if types.get(c) in wanted), None)

    dates = {c for c, t in types.items() if t in ("date", "datetime")}
    found = {role: match_role(df, role, patterns, dates) for role, patterns in ROLE_PATTERNS.items()}
    found["revenue"] = found["revenue"] or first("currency") or first("currency", "percentage", "integer", "float")
    found["date"] = found["date"] or first("date", "datetime")
    found["category"] = found["category"] or first("categorical", "geographic")
    found["region"] = found["region"] or first("geographic")
    return found


def simple_roles(df: DataFrame) -> dict[str, str | None]:
    def find(role: str, patterns: list[str]) -> str | None:
        for pattern in patterns:
            for column in df.columns:
                if pattern in column.lower() and _fits(df, column, role, set()):
                    return column
        return None

    return {role: find(role, patterns) for role, patterns in SIMPLE_ROLES.items()}


def role_rows(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """The mapping as rows, with the number of filled cells behind every role."""
    entries = [
        F.struct(F.lit(role).alias("role"), F.lit(column).alias("column"), F.count(column).alias("filled"))
        for role, column in mapping.items()
        if column
    ]
    return df.agg(F.array(*entries).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def classify_domain(columns: list[str]) -> tuple[str, int, list[str]]:
    """Domain, confidence and matched keywords from column names alone."""
    names = [c.lower() for c in columns]

    def seen(word: str) -> bool:
        return any(word in n for n in names)

    for domain, keywords, step, decisive in DOMAINS:
        matched = [k for k in keywords if seen(k)]
        workforce = domain.startswith("HR") and seen("salary") and (seen("dept") or seen("department"))
        if len(matched) >= 2 or any(seen(d) for d in decisive) or workforce:
            return domain, min(98, 60 + len(matched) * step), matched
    return (*GENERAL_DOMAIN, [])


def _norm(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def synonym_groups(name: str) -> list[int]:
    """Groups a name belongs to: by whole name, then by token, then by a contained synonym."""
    norm = _norm(name)
    tokens = {t for t in re.split(r"[^a-z0-9]+", name.lower()) if t}
    whole = [i for i, g in enumerate(SYNONYMS) if norm in {_norm(s) for s in g}]
    token = [i for i, g in enumerate(SYNONYMS) if tokens & set(g)]
    part = [i for i, g in enumerate(SYNONYMS) if any(len(_norm(s)) >= SHORT_SYNONYM and _norm(s) in norm for s in g)]
    return list(dict.fromkeys([*whole, *token, *part]))


def match_schemas(columns_a: list[str], columns_b: list[str]) -> dict:
    """Pair the columns of two tables: equal names (100), normalized names (95), synonyms (85)."""
    pairs: list[tuple[str, str, str, int]] = []
    left, right = list(columns_a), list(columns_b)

    def take(a: str, b: str, method: str, confidence: int) -> None:
        pairs.append((a, b, method, confidence))
        left.remove(a)
        right.remove(b)

    for a in columns_a:
        if a in right:
            take(a, a, "Exact Name", 100)
    for a in list(left):
        b = next((b for b in right if _norm(a) == _norm(b)), None)
        if b:
            take(a, b, "Normalized Match", 95)
    for a in list(left):
        for group in synonym_groups(a):
            b = next((b for b in right if group in synonym_groups(b)), None)
            if b:
                take(a, b, "Semantic Synonym", 85)
                break
    rate_pct = round(len(pairs) / max(1, len(columns_a)) * 100, 1)
    return {"pairs": pairs, "only_in_a": left, "only_in_b": right, "match_rate_pct": rate_pct}


def match_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The schema match as rows, with the filled cells of both sides as evidence."""
    found = match_schemas(a.columns, b.columns)
    rows = [*found["pairs"], *[(c, None, "Only in A", 0) for c in found["only_in_a"]], *[(None, c, "Only in B", 0) for c in found["only_in_b"]]]

    def filled(df: DataFrame) -> Column:
        return df.agg(F.struct(*[F.count(c).alias(c) for c in df.columns]).alias("s")).scalar()

    fa, fb = filled(a), filled(b)
    none = F.lit(None).cast("bigint")
    entries = [
        F.struct(
            F.lit(ca).cast("string").alias("col_a"),
            F.lit(cb).cast("string").alias("col_b"),
            F.lit(method).alias("method"),
            F.lit(confidence).alias("confidence"),
            (F.col("_fa")[ca] if ca else none).alias("filled_a"),
            (F.col("_fb")[cb] if cb else none).alias("filled_b"),
        )
        for ca, cb, method, confidence in rows
    ]
    return a.sparkSession.range(1).select(fa.alias("_fa"), fb.alias("_fb")).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
