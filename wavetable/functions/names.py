"""Scalar functions on names, ids, stamps and logged values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_id(*parts: Column | str) -> Column:
    """Parts joined by ``_``; a missing part prints as ``nan`` instead of vanishing."""
    return F.concat_ws("_", *[F.coalesce(_col(p).cast("string"), F.lit("nan")) for p in parts])


def decimal_comma(text: Column | str) -> Column:
    """Number with a decimal comma or point; NULL when it is not a number."""
    return F.replace(_col(text), F.lit(","), F.lit(".")).try_cast("double")


def channel_number(name: Column | str) -> Column:
    """Integer after ``wl_`` up to the next underscore; NULL for any other name."""
    return F.nullif(F.regexp_extract(_col(name), "^wl_([^_]*)", 1), F.lit("")).try_cast("int")


def model_file_parts(path: Column | str) -> Column:
    """``rf_Brix_20250101_120000.pkl`` -> struct(model_name, model_type, target, training_date)."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    parts = F.split(name, "_")
    rest = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return F.struct(
        name.alias("model_name"),
        parts.getItem(0).alias("model_type"),
        F.get(parts, F.lit(1)).alias("target"),
        F.when(F.size(parts) > 2, F.replace(rest, F.lit(".pkl"), F.lit(""))).alias("training_date"),
    )


def experiment_name(
    model: Column | str,
    transform: Column | str,
    savgol: Column,
    tuned: Column,
    selection: Column,
    n_features: Column,
    window: Column | None = None,
) -> Column:
    """``rf_snv_savgol_tuned_vip20``; with ``window`` the other form, ``rf_snv_sg15_vip20_tuned``."""
    selected = F.when(
        selection.isNotNull() & (selection != "none"), F.concat(selection, n_features.cast("string"))
    )
    tag = F.when(tuned, F.lit("tuned"))
    if window is None:
        return F.concat_ws("_", _col(model), _col(transform), F.when(savgol, F.lit("savgol")), tag, selected)
    smooth = F.when(savgol, F.concat(F.lit("sg"), window.cast("string")))
    return F.concat_ws("_", _col(model), _col(transform), smooth, selected, tag)


def stamp(ts: Column | str) -> Column:
    """``20250131_235959``."""
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Duration in seconds, microsecond exact."""
    micros = [F.unix_micros(_col(c).cast("timestamp")) for c in (start, end)]
    return (micros[1] - micros[0]) / F.lit(1e6)


def seconds_between_millis(start_ms: Column | str, end_ms: Column | str) -> Column:
    """Run duration in seconds from epoch milliseconds."""
    return (_col(end_ms) - _col(start_ms)) / F.lit(1000.0)


def short_label(name: Column | str, longest: int = 15, kept: int = 12) -> Column:
    """Names longer than ``longest`` keep ``kept`` characters and get ``...``."""
    name = _col(name)
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, kept), F.lit("..."))).otherwise(name)


def log_text(value: Column) -> Column:
    """Scalars as plain text (parameters of the run log)."""
    return value.cast("string")


def log_json(value: Column) -> Column:
    """Lists, maps and structs as JSON text."""
    return F.to_json(value)


def log_number(value: Column) -> Column:
    """Metric values as double; text that is not a number becomes NULL."""
    return value.try_cast("double")
