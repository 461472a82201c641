"""The functions under SQL names, as Arrow UDFs, for ad-hoc use."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .pyrules import Redactor
from .rules import DEFAULT, Policy


def register(spark: SparkSession, policy: Policy = DEFAULT) -> None:
    """Eight names in the session's SQL: redact_text and scan_redactions of a string; redact_payload, redact_messages (a JSON list) and
    redact_params (a JSON mapping, whose own names are not classified) of JSON text, and scan_payload, scan_messages and
    scan_params, which say how many hits. Null stays null; what is malformed, of another kind or has colliding keys becomes null."""

    kinds = {
        "payload": lambda r, v: r.json(v),
        "messages": lambda r, v: r.parts(v),
        "params": lambda r, v: r.parts(v, named=True),
        "text": lambda r, v: (r.text(v, hits := Counter()), hits, None),
    }

    for kind, f in kinds.items():

        def redact(values: pd.Series, f=f) -> pd.Series:
            redactor = Redactor(policy)
            return values.map(lambda v: f(redactor, v)[0], na_action="ignore")

        def count(values: pd.Series, f=f) -> pd.Series:
            redactor = Redactor(policy)
            done = [None if v is None else f(redactor, v) for v in values]
            return pd.Series([None if d is None or d[0] is None else d[1].total() for d in done], dtype="Int64")

        spark.udf.register(f"redact_{kind}", _series_udf(redact, "string"))
        spark.udf.register("scan_redactions" if kind == "text" else f"scan_{kind}", _series_udf(count, "long"))


def _series_udf(body, returned: str):
    def one(values: pd.Series) -> pd.Series:
        return body(values)

    return F.pandas_udf(one, returned)
