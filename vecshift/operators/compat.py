"""Rules that classify how two collections' properties fit, as columns over a table of pairs.

Facts are tri-state text (TRUE, FALSE, UNKNOWN); unknown is a class of its own and never null or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METRICS = ("cosine", "dot", "euclidean", "manhattan")
DATATYPES = ("float32", "float16", "bfloat16", "int8", "binary")
FLOATS, QUANTIZED = ("float32", "float16", "bfloat16"), ("int8", "binary")
#: Output dimensions of models known to keep their meaning when cut short.
MRL_DIMENSIONS = {
    "text-embedding-3-small": (512, 1536),
    "text-embedding-3-large": (256, 1024, 3072),
    "nomic-embed-text-v1.5": (64, 128, 256, 512, 768),
    "jina-embeddings-v3": (32, 64, 128, 256, 512, 768, 1024),
}

EXACT, COMPATIBLE, TRANSFORMABLE, INCOMPATIBLE, UNKNOWN = "exact", "compatible", "transformable", "incompatible", "unknown"


def known(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value in lower case if it is one of ``allowed``, else ``unknown``; never an error."""
    return F.when(F.lower(F.trim(value)).isin(*allowed), F.lower(F.trim(value))).otherwise(UNKNOWN)


def dimension(source: Column, target: Column) -> Column:
    return F.when(source.isNull() | target.isNull(), UNKNOWN).when(source == target, EXACT).otherwise(INCOMPATIBLE)


def datatype(source: Column, target: Column, quantized: Column) -> Column:
    """``quantized`` is the source's tri-state."""
    s, t = known(source, DATATYPES), known(target, DATATYPES)
    return (
        F.when((s == UNKNOWN) | (t == UNKNOWN), UNKNOWN)
        .when(s == t, EXACT)
        .when((F.coalesce(quantized, F.lit("UNKNOWN")) == "TRUE") | s.isin(*QUANTIZED) | t.isin(*QUANTIZED), TRANSFORMABLE)
        .when(s.isin(*FLOATS) & t.isin(*FLOATS), COMPATIBLE)
        .otherwise(UNKNOWN)
    )


def metric(source: Column, target: Column, normalization: Column) -> Column:
    """``normalization``: ``confirmed`` unit norms, ``not_normalized`` or ``unknown``."""
    s, t, n = known(source, METRICS), known(target, METRICS), F.coalesce(normalization, F.lit(UNKNOWN))
    angular, straight = s.isin("cosine", "dot"), t.isin("cosine", "dot")
    mixed = (s == "euclidean") & straight | (t == "euclidean") & angular
    return (
        F.when((s == UNKNOWN) | (t == UNKNOWN), UNKNOWN)
        .when(s == t, EXACT)
        .when(angular & straight, F.when(n == "confirmed", COMPATIBLE).otherwise(UNKNOWN))
        .when(mixed, F.when(n == "confirmed", TRANSFORMABLE).when(n == UNKNOWN, UNKNOWN).otherwise(INCOMPATIBLE))
        .otherwise(INCOMPATIBLE)
    )


def vector_type(source: Column, target: Column) -> Column:
    return F.when(source == target, EXACT).otherwise(INCOMPATIBLE)


def quantization(state: Column) -> Column:
    return F.when(state == "TRUE", TRANSFORMABLE).when(state == "FALSE", EXACT).otherwise(UNKNOWN)


def semantic_space(populated: Column, source: Column, target: Column) -> Column:
    """Spaces are named ``provider/model``; a target without records takes any."""
    return F.when(~populated, EXACT).when(target.isNull(), UNKNOWN).when(source == target, EXACT).otherwise(INCOMPATIBLE)


def direct_copy_possible(*classes: Column) -> Column:
    """Whether dimension, datatype, metric, vector type and semantic space are all exact or compatible."""
    good = F.lit(True)
    for c in classes:
        good = good & F.coalesce(c, F.lit(UNKNOWN)).isin(EXACT, COMPATIBLE)
    return good


def mrl_support(model: str | None) -> str:
    """Whether the model may be cut short; a model that isn't listed is unknown, not unfit."""
    return "TRUE" if model in MRL_DIMENSIONS else "UNKNOWN"


def embedding_identity(provider: str | None, model: str | None, measured: bool) -> dict:
    """What is known of the model that made the vectors; it is only known if the operator says so."""
    if provider and model:
        return {"space": f"{provider}/{model}", "confidence": 1.0}
    return {"space": None, "confidence": 0.5 if measured else 0.0}
