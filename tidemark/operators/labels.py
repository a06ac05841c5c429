"""Binary labels: mapping values to 0 and 1, and finding the label column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import LIKELY_TARGET_NAMES, NO_WORDS, YES_WORDS


@dataclass(frozen=True)
class LabelRule:
    """How a column becomes 0/1: ``bool``, ``numeric``, ``words`` or a ``pair`` of two values."""

    kind: str
    low: str | None = None
    high: str | None = None

    def describe(self) -> str:
        if self.kind == "pair":
            return f"{self.low!r} is 0, {self.high!r} is 1"
        return {"bool": "false is 0, true is 1", "numeric": "as it is", "words": "no-words are 0, yes-words are 1"}[self.kind]


def normal_form(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def apply_rule(c: Column, rule: LabelRule) -> Column:
    """0/1 as INT; null labels stay null and are left out of training."""
    if rule.kind == "bool":
        return c.cast("int")
    if rule.kind == "numeric":
        return c.cast("int")
    s = normal_form(c)
    if rule.kind == "words":
        return F.when(s.isin(*YES_WORDS), 1).when(s.isin(*NO_WORDS), 0)
    return F.when(s == rule.low, 0).when(s == rule.high, 1)


def label_rules(df: DataFrame, columns: list[str] | None = None) -> dict[str, LabelRule | None]:
    """Rule for each column, None when it is not binary.

    One aggregate over all columns settles numbers and yes/no words.  Text columns with a
    handful of values get two more: the smallest and largest value, then whether any value
    differs from both.  No set of values is ever gathered.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    rules: dict[str, LabelRule | None] = {f.name: None for f in fields}
    rules.update({f.name: LabelRule("bool") for f in fields if isinstance(f.dataType, T.BooleanType)})
    numbers = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if not numbers and not texts:
        return rules
    aggs = []
    for c in numbers:
        v = F.col(f"`{c}`")
        aggs += [F.count_if(~v.isin(0, 1)).alias(f"other_{c}"),
                 F.bool_or(v == 0).alias(f"no_{c}"), F.bool_or(v == 1).alias(f"yes_{c}")]
    for c in texts:
        s = normal_form(F.col(f"`{c}`"))
        aggs += [F.count_if(~s.isin(*YES_WORDS, *NO_WORDS)).alias(f"other_{c}"),
                 F.bool_or(s.isin(*YES_WORDS)).alias(f"yes_{c}"), F.bool_or(s.isin(*NO_WORDS)).alias(f"no_{c}"),
                 F.approx_count_distinct(s).alias(f"d_{c}")]
    row = df.agg(*aggs).first()
    few = []
    for c in numbers:
        if row[f"other_{c}"] == 0 and row[f"no_{c}"] and row[f"yes_{c}"]:
            rules[c] = LabelRule("numeric")
    for c in texts:
        if row[f"other_{c}"] == 0 and row[f"no_{c}"] and row[f"yes_{c}"]:
            rules[c] = LabelRule("words")
        elif 1 <= row[f"d_{c}"] <= 5:
            few.append(c)
    open_pairs = []
    if few:
        s = {c: normal_form(F.col(f"`{c}`")) for c in few}
        row = df.agg(*[F.min(s[c]).alias(f"lo_{c}") for c in few], *[F.max(s[c]).alias(f"hi_{c}") for c in few]).first()
        open_pairs = [c for c in few if row[f"lo_{c}"] != row[f"hi_{c}"]]
    if open_pairs:
        between = df.agg(*[F.count_if(~normal_form(F.col(f"`{c}`")).isin(row[f"lo_{c}"], row[f"hi_{c}"]))
                           .alias(c) for c in open_pairs]).first()
        rules.update({c: LabelRule("pair", row[f"lo_{c}"], row[f"hi_{c}"]) for c in open_pairs if between[c] == 0})
    return rules


@dataclass
class TargetChoice:
    column: str | None
    rule: LabelRule | None
    reason: str | None
    checked: list[dict]


# Why a column may be the label, best reason first; rules of one kind rank by the kind of column.
REASONS = ("likely_name", "boolean", "zero_one", "two_texts")
_BY_KIND = {"bool": "boolean", "numeric": "zero_one", "words": "two_texts", "pair": "two_texts"}


def infer_target(df: DataFrame) -> TargetChoice:
    """The candidate with the best rank.

    Every column with a rule is a candidate; its rank is its reason's, then the place of its
    name among the likely ones, then its place in the table.  Yes/no words under another name
    count as two texts only when just two spellings occur.
    """
    rules = label_rules(df)
    likely = {name: k for k, name in enumerate(LIKELY_TARGET_NAMES)}
    ranked = []
    for place, c in enumerate(df.columns):
        rule, name = rules.get(c), likely.get(c.lower())
        if rule is not None:
            reason = "likely_name" if name is not None else _BY_KIND[rule.kind]
            ranked.append(((REASONS.index(reason), name or 0, place), c, reason))
    checked = [{"column": c, "reason": reason, "rule": rules[c].kind} for _, c, reason in sorted(ranked)]
    for _, c, reason in sorted(ranked):
        if reason != "two_texts" or rules[c].kind == "pair" or _two_values(df, c):
            return TargetChoice(c, rules[c], reason, checked)
    return TargetChoice(None, None, None, checked)


def _two_values(df: DataFrame, c: str) -> bool:
    return df.select(normal_form(F.col(f"`{c}`")).alias("v")).dropna().distinct().limit(3).count() == 2


def choose_target(df: DataFrame, target: str | None = None) -> TargetChoice:
    """The caller's column when it can be a label, else inference."""
    if target and target in df.columns:
        rule = label_rules(df, [target])[target]
        if rule is not None:
            return TargetChoice(target, rule, "user_provided", [])
    return infer_target(df)
