"""Explicit schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L = T.StringType(), T.DoubleType(), T.LongType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


QA = struct(
    sample_id=S, adapter=S, task=S, images=T.ArrayType(S), image_roles=T.ArrayType(S), modality=T.ArrayType(S),
    effective_gsd_m=T.ArrayType(D), question=S, answer=S, answer_type=S, question_type=S, split=S, source=S,
    licence=S, provenance_chain=T.ArrayType(S),
)
FOOTPRINTS = struct(
    features=T.ArrayType(struct(properties=struct(Id=L), geometry=struct(type=S, coordinates=T.ArrayType(T.ArrayType(T.ArrayType(D))))))
)
