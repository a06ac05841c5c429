"""Numbers from features: imputation, one-hot with rare bucketing, TF-IDF.

Vocabularies are computed by Spark and only their bounded result (at most 50 categories per
column, 3000 terms per text column) reaches the driver.
"""

from __future__ import annotations

from math import log

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import ClassifyConfig
from tidemark.operators.keyed import quantiles

RARE = "infrequent"
WORD = r"[\p{L}\p{N}_]{2,}"  # fixed value: a token is two or more word characters


# --- categories ----------------------------------------------------------------------


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for all columns at once; one shuffle after map-side counting."""
    slim = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return slim.unpivot([], columns, "column", "value").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def column_modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, the smallest on ties."""
    known = counts.where(F.col("value").isNotNull())
    top = known.groupBy("column").agg(F.max("n").alias("n"))
    return known.join(F.broadcast(top), ["column", "n"]).groupBy("column").agg(F.min("value").alias("mode"))


def imputed_counts(counts: DataFrame) -> DataFrame:
    """Counts after nulls have become the column's mode."""
    filled = counts.join(column_modes(counts), "column", "left")
    return (filled.groupBy("column", F.coalesce("value", "mode").alias("value"))
                  .agg(F.sum("n").alias("n")))


def rare_buckets(counts: DataFrame, cfg: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """(column, value, n, bucket): categories below the minimum share or beyond the maximum
    number fall into one bucket, which takes one of the places.

    Places are given by count, then by value, largest first.
    """
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("levels"))
    shares = counts.join(F.broadcast(totals), "column")
    frequent = F.col("n") >= cfg.ohe_min_freq * F.col("total")
    places = W.partitionBy("column").orderBy(F.desc("n"), F.desc("value"))
    # at most 1 / min_freq categories can be frequent, so the ranked group is bounded
    ranked = (shares.where(frequent)
              .withColumn("place", F.row_number().over(places))
              .withColumn("n_frequent", F.count(F.lit(1)).over(W.partitionBy("column"))))
    used = F.col("n_frequent") + F.when(F.col("n_frequent") < F.col("levels"), 1).otherwise(0)
    kept = ranked.where((used <= cfg.ohe_max_categories) | (F.col("place") < cfg.ohe_max_categories))
    marks = kept.select("column", "value", F.lit(True).alias("kept"))
    return (counts.join(marks, ["column", "value"], "left")
                  .select("column", "value", "n", F.when(F.col("kept"), F.col("value")).otherwise(RARE)
                          .alias("bucket")))


def kept_categories(buckets: DataFrame) -> dict[str, dict]:
    """Per column the kept values in order and whether a rare bucket exists (bounded)."""
    rows = (buckets.groupBy("column").agg(
        F.sort_array(F.collect_set(F.when(F.col("bucket") == F.col("value"), F.col("value")))).alias("kept"),
        F.bool_or(F.col("bucket") != F.col("value")).alias("rare")).collect())
    return {r["column"]: {"kept": list(r["kept"]), "rare": bool(r["rare"])} for r in rows}


def indicator_labels(kept: list[str], rare: bool) -> list[str]:
    """Labels that get a position of their own: a two-level column needs one only."""
    labels = kept + ([RARE] if rare else [])
    return labels[1:] if len(labels) == 2 else labels


def one_hot(c: Column, labels: list[str]) -> Column:
    """0/1 vector over the labels; a value outside them is all zeros."""
    options = F.array(*[F.lit(v) for v in labels])
    return array_to_vector(F.transform(options, lambda v: F.coalesce((v == c).cast("double"), F.lit(0.0))))


# --- text ----------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Lower-case words and pairs of neighbouring words of the whole text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(F.array(words), lambda w: F.when(
        F.size(w) >= 2, F.concat(w, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1),
                                                F.slice(w, F.lit(2), F.size(w) - 1),
                                                lambda a, b: F.concat(a, F.lit(" "), b)))).otherwise(w))[0]


def vocabulary(df: DataFrame, text: str, n_docs: int, cfg: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """(term, df, total, idf): the most frequent terms within the document-frequency limits.

    A row is a document.  Its terms are sorted in place, so that the first of equal ones also counts
    the document: both counts come from one tokenisation and one aggregate by term.
    """
    row = df.select(F.sort_array(tokens(F.col(text))).alias("here"))
    before = F.concat(F.array(F.lit(None).cast("string")),
                      F.slice("here", F.lit(1), F.greatest(F.size("here") - 1, F.lit(0))))
    each = row.select(F.inline(F.arrays_zip("here", before.alias("before")))).toDF("term", "before")
    stats = each.where(F.col("term").isNotNull()).groupBy("term").agg(
        F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("df"), F.count(F.lit(1)).alias("total"))
    ok = (F.col("df") >= cfg.tfidf_min_df) & (F.col("df") <= cfg.tfidf_max_df * n_docs)
    top = stats.where(ok).orderBy(F.desc("total"), "term").limit(cfg.tfidf_max_features)
    return top.withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)


def tfidf(df: DataFrame, key: str, text: str, cfg: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """(key, term, weight): L2-normalised tf-idf in long form; a row is a document, ``key`` names it.

    The vocabulary (at most max_features terms) is settled first; counts, weights and norm are then
    made inside each row, so nothing else is shuffled.  Rows without a known term give none.
    """
    top = vocabulary(df, text, df.count(), cfg).select("term", "idf").collect()
    if not top:
        return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).where(F.lit(False))
    known = df.sparkSession.createDataFrame([(i, r["term"]) for i, r in enumerate(top)], "place int, term string")
    weighted = PipelineModel(term_stages("__tok", "__weights", {r["term"]: r["idf"] for r in top})).transform(
        df.select(key, tokens(F.col(text)).alias("__tok")))
    cells = weighted.select(key, F.posexplode(vector_to_array("__weights")).alias("place", "weight"))
    return (cells.where(F.col("weight") != 0).join(F.broadcast(known), "place").select(key, "term", "weight"))


def term_stages(source: str, out: str, terms: dict[str, float]) -> list:
    """Token lists to L2-normalised weights over fixed terms with their idf."""
    return [CountVectorizerModel.from_vocabulary(list(terms), source, f"{out}_tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(list(terms.values())), inputCol=f"{out}_tf",
                               outputCol=f"{out}_wt"),
            Normalizer(p=2.0, inputCol=f"{out}_wt", outputCol=out)]


# --- the fitted encoder --------------------------------------------------------------


def fit_encoder(train: DataFrame, groups: dict[str, list[str]], cfg: ClassifyConfig = ClassifyConfig()) -> dict:
    """Medians, modes, kept categories and term lists of the training rows."""
    medians = quantiles(train, groups["numeric"], 0.5) if groups["numeric"] else {}
    fitted = {"medians": {c: (0.0 if v is None else v) for c, v in medians.items()},
              "modes": {}, "labels": {}, "terms": {}}
    if groups["categorical"]:
        counts = category_counts(train, groups["categorical"]).persist()  # read several times
        fitted["modes"] = {r["column"]: r["mode"] for r in column_modes(counts).collect()}
        kept = kept_categories(rare_buckets(imputed_counts(counts), cfg))
        fitted["labels"] = {c: {"kept": k["kept"], "rare": k["rare"]} for c, k in kept.items()}
        counts.unpersist()
    n_docs = train.count() if groups["text"] else 0
    for c in groups["text"]:
        top = vocabulary(train.select(F.col(f"`{c}`").alias("__text")), "__text", n_docs, cfg).collect()
        fitted["terms"][c] = {r["term"]: log((1 + n_docs) / (1 + r["df"])) + 1 for r in top}
    return fitted


def rare_values(train: DataFrame, fitted: dict, columns: list[str]) -> DataFrame:
    """(column, value) of the categories seen in training but not kept."""
    counts = category_counts(train, columns).where(F.col("value").isNotNull())
    kept = [((F.col("column") == c) & F.col("value").isin(v["kept"])) for c, v in fitted["labels"].items()]
    condition = F.lit(False)
    for k in kept:
        condition = condition | k
    return counts.where(~condition).select("column", "value")


def encode_columns(df: DataFrame, groups: dict[str, list[str]], fitted: dict, rare: DataFrame | None,
                   keep: list[str] = ()) -> DataFrame:
    """Imputed numbers, one-hot vectors and token lists, ready for ``assembler``.

    A category seen in training but rare goes to the rare bucket, one never seen is all
    zeros.  Only values that are not kept need the lookup; kept ones join under a null key
    of their own slot, so a frequent category never piles up in one task.
    """
    out = df
    for c in groups["categorical"]:
        info = fitted["labels"].get(c, {"kept": [], "rare": False})
        value = F.coalesce(F.col(f"`{c}`"), F.lit(fitted["modes"].get(c)))
        out = out.withColumn(c, value)
        if info["rare"] and rare is not None:
            known = F.col(f"`{c}`").isin(info["kept"])
            slot = F.concat(F.lit("\u0000"), F.pmod(F.spark_partition_id(), F.lit(4096)).cast("string"))
            seen = rare.where(F.col("column") == c).select(F.col("value").alias("__v"), F.lit(RARE).alias("__r"))
            out = (out.withColumn("__v", F.when(known, slot).otherwise(F.col(f"`{c}`")))
                      .join(seen, "__v", "left")
                      .withColumn(c, F.when(F.col("__r").isNotNull(), F.col("__r")).otherwise(F.col(f"`{c}`")))
                      .drop("__v", "__r"))
    columns = [F.coalesce(F.col(f"`{c}`"), F.lit(fitted["medians"][c])).alias(f"num_{i}")
               for i, c in enumerate(groups["numeric"])]
    for i, c in enumerate(groups["categorical"]):
        info = fitted["labels"].get(c, {"kept": [], "rare": False})
        labels = indicator_labels(info["kept"], info["rare"])
        if labels:
            columns.append(one_hot(F.col(f"`{c}`"), labels).alias(f"cat_{i}"))
    columns += [tokens(F.col(f"`{c}`")).alias(f"tok_{i}") for i, c in enumerate(groups["text"])]
    return out.select(*keep, *columns)


def assembler(groups: dict[str, list[str]], fitted: dict) -> PipelineModel:
    """Fixed stages from encoded columns to one ``features`` vector."""
    stages, inputs = [], [f"num_{i}" for i in range(len(groups["numeric"]))]
    for i, c in enumerate(groups["categorical"]):
        info = fitted["labels"].get(c, {"kept": [], "rare": False})
        labels = indicator_labels(info["kept"], info["rare"])
        if labels:
            stages.append(_size(f"cat_{i}", len(labels)))
            inputs.append(f"cat_{i}")
    for i, c in enumerate(groups["text"]):
        terms = fitted["terms"][c]
        if not terms:
            continue
        stages += [*term_stages(f"tok_{i}", f"txt_{i}", terms), _size(f"txt_{i}", len(terms))]
        inputs.append(f"txt_{i}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages)


def _size(column: str, n: int) -> VectorSizeHint:
    """Tells the assembler the length, so it need not look at a row."""
    return VectorSizeHint(inputCol=column, size=n, handleInvalid="optimistic")


def feature_labels(groups: dict[str, list[str]], fitted: dict) -> list[str]:
    """Name of every position of the ``features`` vector."""
    names = list(groups["numeric"])
    for c in groups["categorical"]:
        info = fitted["labels"].get(c, {"kept": [], "rare": False})
        names += [f"{c}={v}" for v in indicator_labels(info["kept"], info["rare"])]
    for c in groups["text"]:
        names += [f"{c}:{t}" for t in fitted["terms"][c]]
    return names
