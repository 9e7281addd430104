"""Python functions as options. Column expressions stay inside the JVM; these go through Arrow batches and are slower."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_filter(keep: Callable[[dict[str, Any]], Any]) -> Callable[[DataFrame], Column]:
    """A ``filter`` from a function of a result as a dict: id, score, terms, query_terms, match and the stored fields."""

    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(keep(r)) for r in rows.to_dict("records")], dtype=bool)

    return lambda df: run(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("ord", "doc_ord")]))


def document_boost(boost: Callable[[Any, str, dict[str, Any] | None], float | None]) -> Callable[[Column, Column, Column], Column]:
    """A ``boost_document`` from a function of (id, index term, stored fields); None, 0 and NaN drop the posting."""

    @F.pandas_udf("double")
    def run(rows: pd.DataFrame) -> pd.Series:
        ids, terms = rows["i"], rows["t"]
        stored = rows["s"] if "s" in rows else [None] * len(rows)
        return pd.Series([boost(i, t, s) for i, t, s in zip(ids, terms, stored, strict=True)], dtype="float64")

    return lambda ident, term, stored: run(F.struct(ident.alias("i"), term.alias("t"), stored.alias("s")))
