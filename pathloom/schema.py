"""The trajectory record and the small label records, as Spark types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TRAJECTORY = _struct(id=_S, instruction=_S, platform=_S, app=_S, success=_B, actions=T.ArrayType(_S), embedding=T.ArrayType(T.FloatType()), source=_S, sourceId=_S, imageCount=_I)
_GROUP = T.ArrayType(_struct(label=_S, rationale=_S, memberIds=T.ArrayType(_S)))
LABELS = _struct(name=_S, version=_S, annotationPolicy=_S, retrievalGroups=_GROUP, duplicateGroups=_GROUP, negativePairs=T.ArrayType(_struct(leftId=_S, rightId=_S, rationale=_S)))
FAILURE_PAIRS = _struct(name=_S, version=_S, generatedAt=_S, generationPolicy=_S, pairs=T.ArrayType(_struct(failureId=_S, successfulId=_S, alternativeSuccessfulIds=T.ArrayType(_S), failureType=_S, originalActionCount=_I, remainingActionCount=_I)))
MESSAGES = T.ArrayType(_struct(role=_S, content=T.ArrayType(_struct(type=_S, text=_S, index=_I)), tool_calls=T.ArrayType(_struct(function=_struct(name=_S, arguments=_struct(status=_S))))))
METADATA = _struct(platform=_S, others=_struct(id=_S, source=_S, source_id=_S))
ROWS_FILE = _struct(row_idx=_L, row=_struct(messages=_S, metadata=_S, images=T.ArrayType(_S)))


def blank(text: Column) -> Column:
    """Null, empty or white space only (any Unicode space character)."""
    return text.isNull() | ~F.regexp_like(text, F.lit(r"[^\p{Z}\x09-\x0D\x1C-\x1F]"))


def strip(text: Column) -> Column:
    """Without the control characters and spaces (up to U+0020) at either end."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalise(df: DataFrame) -> DataFrame:
    """Defaults for optional fields; missing columns are added."""
    for field in TRAJECTORY.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    fixed = {
        "success": F.coalesce("success", F.lit(False)),
        "actions": F.coalesce("actions", F.array().cast("array<string>")),
        "source": F.when(blank(F.col("source")), F.lit("local")).otherwise(F.col("source")),
        "sourceId": F.when(blank(F.col("sourceId")), F.col("id")).otherwise(F.col("sourceId")),
        "imageCount": F.coalesce("imageCount", F.lit(0)),
    }
    return df.select(*[fixed.get(f.name, F.col(f.name)).alias(f.name) for f in TRAJECTORY.fields])


def finite_nonzero(vector: Column) -> Column:
    """Every element finite, at least one not zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def violations(df: DataFrame, dimension: int | None = None) -> DataFrame:
    """(rule, id): each way in which a row of a normalised table is not valid. Ids that repeat are listed once."""
    if dimension is None:
        dimension = df.agg(F.min(F.size("embedding"))).first()[0] or 0
    rules = {name: blank(F.col(name)) for name in ("id", "instruction", "platform", "app")}
    rules |= {
        "actions": F.exists("actions", lambda x: x.isNull()),
        "embedding": F.coalesce(F.size("embedding") == 0, F.lit(True)) | F.col("embedding").isNull(),
        "dimension": F.size("embedding") != dimension,
        "vector": ~finite_nonzero(F.col("embedding")),
        "imageCount": F.col("imageCount") < 0,
    }
    each = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    found = df.select(F.explode(each).alias("rule"), "id")
    repeated = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("unique").alias("rule"), "id")
    return found.unionByName(repeated)


def validate(df: DataFrame) -> DataFrame:
    """``df`` if it has no violation; else ValueError with the first few. An empty table is an error too."""
    if df.isEmpty():
        raise ValueError("no trajectories")
    bad = violations(df).limit(5).collect()
    if bad:
        raise ValueError("invalid trajectories: " + ", ".join(f"{r.rule}: {r.id}" for r in bad))
    return df
