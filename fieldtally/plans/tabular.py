"""Tabular classification: train and test frames to aligned, numeric feature frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_only
from ..operators.columns import (
    blanks_to_null,
    clean_names,
    extra_columns,
    numeric_columns,
    recode,
    shared_columns,
    text_columns,
)
from ..operators.prepare import fit_mean_impute, fit_median_impute, fit_mode_impute, fit_onehot, fit_pca, fit_standardize
from ..operators.pruning import prune_columns, prune_rows
from ..operators.sets import transform_together

MISSING = "Missing_value"


def prepare_classification(
    train: DataFrame, test: DataFrame, id_column: str, label: str, lookups: Mapping[str, Mapping[str, str]] | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Mean-impute and scale numbers with training statistics, tidy text, one-hot both frames.

    Lookups apply to both frames.  Columns the test frame lacks are dropped.
    """
    drop = [c for c in extra_columns(train, test) if c != label]
    train = train.drop(*drop)
    numbers = numeric_columns(train, [id_column, label])
    texts = text_columns(train, [id_column, label])
    filled = fit_mean_impute(train, numbers)
    scaled = fit_standardize(filled.apply(train), numbers)

    def tidy(df):
        out = scaled.apply(filled.apply(df))
        cells = {c: F.coalesce(alnum_only(recode(c, (lookups or {}).get(c, {})) if (lookups or {}).get(c) else F.col(c)), F.lit(MISSING)) for c in texts}
        return out.withColumns(cells)

    hot = {}

    def encode(both):
        fitted = fit_onehot(both, texts)
        hot["names"] = fitted.names()
        return fitted.apply(both)

    ready_train, ready_test = transform_together(tidy(train), tidy(test), encode)
    return ready_train, ready_test.drop(label), [*numbers, *hot["names"]]


def prepare_survey(
    train: DataFrame, test: DataFrame, label: str, left_out: Sequence[str] = (), max_column_nulls: float = 0.7,
    max_row_nulls: float = 0.4, components: Mapping[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sparse columns and rows dropped, median and mode imputed, dummies, components per prefix.

    ``components``: name prefix -> number of raw (unscaled, uncentred) principal components.
    """
    train = blanks_to_null(train.where(F.col(label).isNotNull()))
    train = clean_names(prune_rows(prune_columns(train, max_column_nulls), max_row_nulls)).drop(*left_out)
    test = clean_names(blanks_to_null(test)).drop(*left_out)
    common = [c for c in shared_columns(train, test) if c != label]
    train, test = train.select(*common, label), test.select(*common)
    numbers, texts = numeric_columns(train, [label]), text_columns(train, [label])
    medians, modes = fit_median_impute(train, numbers), fit_mode_impute(train, texts)
    filled = [modes.apply(medians.apply(df)) for df in (train, test)]
    hot = fit_onehot(filled[0], texts)
    out = [hot.apply(df) for df in filled]
    for prefix, k in (components or {}).items():
        group = [c for c in numbers if c.lower().startswith(prefix.lower())]
        fitted = fit_pca(out[0], group, min(k, len(group)), scale=False, center=False)
        out = [fitted.apply(df, f"{prefix}_PC").drop(*group) for df in out]
    return out[0], out[1]
