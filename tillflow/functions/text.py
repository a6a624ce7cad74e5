"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters a Unicode-aware strip removes, not only the blank that trim() removes.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
EDGE_SPACE = rf"\A{SPACE}+|{SPACE}+\z"
LEFT_SPACE = r"\A[\t\r\n ]+"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def is_blank(c: Column) -> Column:
    """NULL or empty, the negation of a required value."""
    return F.coalesce(F.length(c) == 0, F.lit(True))


def required(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (F.length(col) > 0)


def capitalize(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def change_case(c: Column | str, case: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "title": F.initcap, "capitalize": capitalize}[case](c)


# What may start a spreadsheet formula.
FORMULA_START = "^[=@]"
SIGN_START = r"^[+\-]"
SIGNED_NUMBER = r"^[+\-](\d+\.?\d*|\.\d+)$"


def spreadsheet_safe(c: Column | str) -> Column:
    """Prefix ``'`` to text a spreadsheet would run as a formula; signed numbers stay as they are."""
    col = F.col(c) if isinstance(c, str) else c
    body = F.regexp_replace(col, LEFT_SPACE, "")
    formula = body.rlike(FORMULA_START) | (body.rlike(SIGN_START) & ~body.rlike(SIGNED_NUMBER))
    return F.when(formula, F.concat(F.lit("'"), col)).otherwise(col)


# Patterns of secrets and their replacements ({1}.. are capture groups).
SECRET_PATTERNS = [
    (r"(?i)(postgres(?:ql)?://[^:\s'\"]+:)[^@\s'\"]+(@)", "{1}****{2}"),
    (
        r"(?i)((?:api[_-]?key|secret[_-]?key|password|passwd|token|auth_token|client_secret)"
        r"\s*[:=]\s*[\"']?)([^\"'\s,;{}]+)([\"']?)",
        "{1}****{3}",
    ),
    (r"(?i)(Bearer\s+)[a-zA-Z0-9_\-.]{15,}", "{1}****"),
    (r"\b(AIza[0-9A-Za-z\-_]{15,}|sk-[a-zA-Z0-9]{15,}|ghp_[0-9a-zA-Z]{15,})\b", "****"),
]


def mask_secrets(c: Column | str) -> Column:
    """Mask passwords in database URLs, key=value secrets, bearer tokens and known API keys."""
    col = F.col(c) if isinstance(c, str) else c

    def apply(acc: Column, rule: tuple[str, str]) -> Column:
        pattern, target = rule
        return F.regexp_replace(acc, pattern, target.replace("{", "$").replace("}", ""))

    return reduce(apply, SECRET_PATTERNS, col)
