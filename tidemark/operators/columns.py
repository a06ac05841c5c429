"""Which columns of a table become features, and in what form.

All decisions are made once, on the training table, and kept in a ``FeatureSpec``; scoring
applies the saved spec and decides nothing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import ClassifyConfig
from tidemark.functions.calendar import NTZ, expand_datetime
from tidemark.functions.metrics import finite_or_null
from tidemark.functions.text import numeric_like
from tidemark.operators.dates import parse_any, parse_as
from tidemark.operators.values import value_counts

# Shapes of a date in text, the format each stands for (None: ISO), and the
# lengths it can have.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(:\d{2})?)?$", None, (10, 16, 19)),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy", (10,)),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy", (10,)),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd", (10,)),
)
EPOCHS = {"epoch_s": (r"^\d{10}$", 10), "epoch_ms": (r"^\d{13}$", 13)}
SHAPE_RATIO = 0.6  # fixed value: share of values a shape must reach


@dataclass
class ColumnProfile:
    name: str
    dtype: T.DataType
    n: int = 0
    nulls: int = 0
    distinct: int = 0
    mean_length: float = 0.0
    numeric_ratio: float = 0.0
    shape: str | None = None
    shape_ratio: float = 0.0
    parse_ratio: float = 0.0

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _has_shape(c: Column, pattern: str, sizes: tuple[int, ...]) -> Column:
    """Length first: most values are settled without a regular expression."""
    return F.when(F.char_length(c).isin(*sizes), c.rlike(pattern)).otherwise(F.when(c.isNotNull(), False))


def _parse_shape(c: Column, shape: str | None) -> Column:
    if shape == "epoch_s":
        return F.timestamp_seconds(c.try_cast("bigint")).cast(NTZ)
    if shape == "epoch_ms":
        return F.timestamp_millis(c.try_cast("bigint")).cast(NTZ)
    return parse_any(c, False) if shape is None else parse_as(c, shape)


def profile_columns(df: DataFrame, columns: list[str] | None = None,
                    cfg: ClassifyConfig = ClassifyConfig()) -> dict[str, ColumnProfile]:
    """Everything the pruning and typing rules need.

    One scan counts the distinct values of all columns; shapes and ratios are then read once per
    distinct value and weighted by its rows.  A second scan, of the columns that look like dates
    only, tells how many of their values parse.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    fields = [f for f in fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    out = {f.name: ColumnProfile(f.name, f.dataType) for f in fields}
    if not fields:
        return out
    for row in _facts(df, fields).collect():  # one row per column
        p = out[fields[row["i"]].name]
        p.n, p.nulls, p.distinct = row["n"], row["nulls"], row["distinct"]
        if p.is_text:
            p.mean_length, p.numeric_ratio = row["len"] or 0.0, row["num"] or 0.0
            p.shape, p.shape_ratio = _best_shape(row["shapes"], row["epochs"], cfg)
    dated = [p for p in out.values() if p.shape_ratio >= SHAPE_RATIO]
    if dated:
        row = df.agg(*[F.avg(_parse_shape(F.col(f"`{p.name}`"), p.shape).isNotNull().cast("int")).alias(f"p{i}")
                       for i, p in enumerate(dated)]).first()
        for i, p in enumerate(dated):
            p.parse_ratio = row[f"p{i}"] or 0.0
    return out


def _facts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(i, n, nulls, distinct, len, num, shapes, epochs) per column; the last four for text."""
    counts = value_counts(df, fields, lambda c: numeric_like(c).isNotNull())
    text_ids = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    text = F.col("i").isin(text_ids) & F.col("value").isNotNull()
    short = F.when(text & F.col("size").isNull(), F.col("value"))
    rows = F.when(text, F.col("n"))
    share = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(F.lit(0))) / F.sum(rows)
    return counts.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        (F.sum(rows * F.coalesce("size", F.char_length("value"))) / F.sum(rows)).alias("len"),
        share(text & F.coalesce("mark", numeric_like(short).isNotNull())).alias("num"),
        F.array(*[share(_has_shape(short, p, sizes)) for p, _, sizes in DATE_SHAPES]).alias("shapes"),
        F.array(*[share(_has_shape(short, p, (n,))) for p, n in EPOCHS.values()]).alias("epochs"))


def _best_shape(shapes: list, epochs: list, cfg: ClassifyConfig) -> tuple[str | None, float]:
    found = dict(zip(EPOCHS, (v or 0.0 for v in epochs)))
    if sum(found.values()) >= SHAPE_RATIO:
        # without the option an epoch is found but never parsed, so the column stays numeric
        return (max(found, key=found.get), sum(found.values())) if cfg.parse_epochs else (None, 0.0)
    ratios = [v or 0.0 for v in shapes]
    best = max(range(len(ratios)), key=lambda j: ratios[j])
    return DATE_SHAPES[best][1], ratios[best]


def is_datetime(p: ColumnProfile, cfg: ClassifyConfig) -> bool:
    return p.is_text and p.shape_ratio >= SHAPE_RATIO and p.parse_ratio >= cfg.datetime_ratio


def is_textual(p: ColumnProfile, cfg: ClassifyConfig) -> bool:
    return p.is_text and p.distinct >= cfg.text_min_unique and p.mean_length >= cfg.text_min_avg_len


def drop_reason(p: ColumnProfile, cfg: ClassifyConfig) -> str | None:
    if p.n and p.nulls / p.n > cfg.missing_drop:
        return f"missing>{int(cfg.missing_drop * 100)}%"
    if p.distinct <= 1:
        return "constant"
    if p.distinct <= 2:
        return None
    if p.distinct / max(1, p.n) >= cfg.id_ratio:
        number = not p.is_text and not p.is_time
        if not (number or p.is_time or is_datetime(p, cfg) or p.numeric_ratio >= cfg.numeric_like_ratio):
            return "likely_id"
    return None


def dropped_columns(profiles: dict[str, ColumnProfile], target: str | None = None,
                    cfg: ClassifyConfig = ClassifyConfig()) -> list[dict]:
    found = [(c, drop_reason(p, cfg)) for c, p in profiles.items() if c != target]
    return [{"column": c, "reason": r} for c, r in found if r]


# --- the spec ------------------------------------------------------------------------

KINDS = ("numeric", "datetime", "numeric_like", "text", "categorical")


@dataclass
class FeatureSpec:
    """Source columns in order with their kind; ``shape`` is set for datetime text."""

    columns: list[dict] = field(default_factory=list)  # {"name", "kind", "shape"}
    dropped: list[dict] = field(default_factory=list)

    def of_kind(self, *kinds: str) -> list[str]:
        return [c["name"] for c in self.columns if c["kind"] in kinds]

    @property
    def groups(self) -> dict[str, list[str]]:
        derived = [n for c in self.of_kind("datetime") for n in expand_datetime(c, F.lit(None))]
        return {"numeric": self.of_kind("numeric", "numeric_like") + derived,
                "categorical": self.of_kind("categorical"), "text": self.of_kind("text"),
                "datetime_original": self.of_kind("datetime")}

    def to_dict(self) -> dict:
        return asdict(self)


def feature_spec(df: DataFrame, target: str, cfg: ClassifyConfig = ClassifyConfig(),
                 ignore: list[str] = ()) -> FeatureSpec:
    names = [c for c in df.columns if c != target and c not in ignore]
    profiles = profile_columns(df, names, cfg)
    dropped = dropped_columns(profiles, target, cfg)
    gone = {d["column"] for d in dropped}
    columns = []
    for c, p in profiles.items():
        if c in gone:
            continue
        if p.is_time:
            kind = "datetime"
        elif not p.is_text:
            kind = "numeric"
        elif is_datetime(p, cfg):
            kind = "datetime"
        elif p.numeric_ratio >= cfg.numeric_like_ratio:
            kind = "numeric_like"
        else:
            kind = "text" if is_textual(p, cfg) else "categorical"
        columns.append({"name": c, "kind": kind, "shape": p.shape if p.is_text and kind == "datetime" else None})
    return FeatureSpec(columns, dropped)


def normalize(df: DataFrame, spec: FeatureSpec, keep: list[str] = ()) -> DataFrame:
    """Feature columns of the spec in training order; absent ones are null, extra ones go."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out: list[Column] = []
    for entry in spec.columns:
        name, kind = entry["name"], entry["kind"]
        have = name in types
        c = F.col(f"`{name}`") if have else F.lit(None)
        if kind == "numeric":
            out.append(finite_or_null(c.try_cast("double")).alias(name))
        elif kind == "numeric_like":
            out.append(finite_or_null(numeric_like(c)).alias(name))
        elif kind == "datetime":
            text = have and isinstance(types[name], T.StringType)
            ts = _parse_shape(c, entry["shape"]) if text else c.cast(NTZ)
            out += [v.cast("double").alias(k) for k, v in expand_datetime(name, ts).items()]
        else:
            out.append(c.cast("string").alias(name))
    return df.select(*keep, *out)
