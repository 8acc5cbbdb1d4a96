"""Parallel text: JSON lines, one file per language, dataset names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import text as X
from lingualoom.operators.spread import dealt_join, staged_with_hot

# ---- fixed values: the pinned corpus revision ----------------------------------------------------
PINNED_NAME = "flores_plus"
PINNED_REVISION = "5fec6c13f9e5a4db2f745d4ec0d7c9721ddc4f06"
# ---- end of fixed values -------------------------------------------------------------------------

_FIELDS = ("id", "source_lang", "target_lang", "source", "reference")


def parse_parallel(lines: DataFrame, value: str = "value", dataset: str = "dataset") -> DataFrame:
    """JSON lines -> dataset, id, source_lang, target_lang, source, reference, error_code.

    Blank lines are skipped.  An id is a text or a whole number and becomes text.  Broken rows
    stay as rows with an error code, for the caller to refuse the dataset.
    """
    doc = F.try_parse_json(F.col(value))
    is_object = F.schema_of_variant(doc).startswith("OBJECT")

    def field(name: str) -> Column:
        return F.try_variant_get(doc, f"$.{name}", "variant")

    def text(name: str) -> Column:
        got = field(name)
        return F.when(F.schema_of_variant(got) == "STRING", F.variant_get(got, "$", "string"))

    key = field("id")
    key_ok = F.schema_of_variant(key).isin("STRING", "BIGINT")
    rows = lines.filter(~X.is_blank(F.col(value))).select(
        dataset,
        F.when(key_ok, F.variant_get(key, "$", "string")).alias("id"),
        *[text(name).alias(name) for name in _FIELDS[1:]],
        F.when(doc.isNull(), F.lit("invalid_json"))
        .when(~is_object, F.lit("not_an_object"))
        .when(~F.coalesce(key_ok, F.lit(False)), F.lit("no_id"))
        .alias("error_code"),
    )
    return rows


def scan_parallel(rows: DataFrame, source: str, target: str, dataset: str = "dataset") -> DataFrame:
    """Rows of one direction of every sound dataset.

    A dataset is refused as a whole for a broken row or a duplicate id anywhere in it, whatever
    the direction.  Ids are counted with map-side combine; what is joined is one row per dataset.  The parsed
    rows are written once, and a dataset that holds a large share of them is dealt out over salts.
    """
    rows, hot = staged_with_hot(rows, [dataset], "parallel")
    wanted = (F.col("source_lang") == source) & (F.col("target_lang") == target)
    lacking = wanted & (F.col("source").isNull() | F.col("reference").isNull())
    per_id = rows.groupBy(dataset, "id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("error_code").isNotNull() | lacking).alias("broken"),
    )
    refused = (
        per_id.filter((F.col("broken") > 0) | (F.col("id").isNotNull() & (F.col("n") > 1)))
        .select(dataset)
        .distinct()
    )
    kept = dealt_join(rows.filter(wanted), hot, refused, [dataset], "left_anti", ["id"])
    return kept.select(dataset, "id", "source", "reference")


def read_parallel(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines files, the file name being the dataset."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("dataset"))
    return parse_parallel(lines)


def aligned_pairs(a: DataFrame, b: DataFrame, dataset: str = "dataset") -> DataFrame:
    """dataset, id, source, reference, sound: two language files joined on id.

    A dataset whose id sets differ is marked unsound on each of its rows.  The pairs are joined and written once.
    """
    left = a.select(dataset, "id", F.col("text").alias("source"))
    right = b.select(dataset, "id", F.col("text").alias("reference"))
    pairs, hot = staged_with_hot(left.join(right, [dataset, "id"], "full_outer"), [dataset], "pairs")
    odd = pairs.filter(F.col("source").isNull() | F.col("reference").isNull())
    unsound = odd.select(dataset).distinct().withColumn("_odd", F.lit(True))
    return dealt_join(pairs, hot, unsound, [dataset], "left", ["id"]).select(
        dataset, "id", "source", "reference", F.col("_odd").isNull().alias("sound")
    )


def dataset_spec(specs: DataFrame, spec: str, content: str) -> DataFrame:
    """name, revision and error_code of ``flores`` or ``domain:<path>`` with its file's bytes."""
    s = F.col(spec)
    is_pinned, is_domain = s == "flores", s.startswith("domain:")
    file_name = F.regexp_extract(s, r"([^/\\]*)$", 1)
    return specs.select(
        "*",
        F.when(is_pinned, F.lit(PINNED_NAME))
        .when(is_domain & F.col(content).isNotNull(), F.concat(F.lit("domain:"), file_name))
        .alias("name"),
        F.when(is_pinned, F.lit(PINNED_REVISION))
        .when(is_domain, F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256)))
        .alias("revision"),
        F.when(is_domain & F.col(content).isNull(), F.lit("dataset_not_found"))
        .when(~is_pinned & ~is_domain, F.lit("unknown_dataset"))
        .alias("error_code"),
    )
