"""What a failed call means: wait, step down the output format, or stop."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Statuses and error names by meaning.
TERMINAL_STATUS = (401, 402, 403)
SCHEMA_REJECTIONS = ("BadRequestError", "UnprocessableEntityError")
TRANSIENT_ERRORS = (
    "RateLimitError", "APITimeoutError", "APIConnectionError", "InternalServerError",
    "APIStatusError", "ConnectionError", "ReadTimeout", "Timeout", "ServiceUnavailable",
)
STATUS_PATTERN = r"Error code:\s*(\d{3})"


def classify(name: str, message: str, status: int | None = None) -> str:
    """One of terminal, schema, transient, other. `status` is the one the error itself carries."""
    found = re.search(STATUS_PATTERN, message)
    code = status if status is not None else int(found.group(1)) if found else None
    if code in TERMINAL_STATUS:
        return "terminal"
    if name in SCHEMA_REJECTIONS or status == 400:
        return "schema"
    if code is not None:
        return "transient" if code == 429 or code >= 500 else "other"
    return "transient" if name in TRANSIENT_ERRORS else "other"


def classify_column(error: Column) -> Column:
    """The same over ledger text `Name: message`."""
    name = F.substring_index(error, ":", 1)
    found = F.regexp_extract(error, STATUS_PATTERN, 1)
    code = F.when(found != "", found.cast("int"))
    return (F.when(code.isin(*TERMINAL_STATUS), F.lit("terminal"))
            .when(name.isin(*SCHEMA_REJECTIONS), F.lit("schema"))
            .when(code.isNotNull(), F.when((code == 429) | (code >= 500), F.lit("transient"))
                  .otherwise(F.lit("other")))
            .when(name.isin(*TRANSIENT_ERRORS), F.lit("transient"))
            .otherwise(F.lit("other")))


def refusal_status(last_error: Column) -> Column:
    """refused_transport when the last error names a transient failure, else refused_parse."""
    named = F.lit(False)
    for name in TRANSIENT_ERRORS:
        named = named | last_error.contains(name)
    return F.when(named, F.lit("refused_transport")).otherwise(F.lit("refused_parse"))
