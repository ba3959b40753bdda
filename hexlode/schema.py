"""Tables, edge types and limits of the retrieval engine."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False), T.StructField("text", T.StringType(), False), T.StructField("metadata", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("raw_embedding", T.ArrayType(T.FloatType())),
        T.StructField("parent_id", T.StringType()), T.StructField("is_chunk", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()), T.StructField("deleted_at", T.TimestampNTZType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("edge_id", T.StringType(), False), T.StructField("source_id", T.StringType(), False), T.StructField("target_id", T.StringType(), False),
        T.StructField("type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("metadata", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
    ]
)

#: Edge types of strict mode, those that ingest adds, and the alias of a client call.
EDGE_TYPES = ("led_to", "contradicts", "supports", "caused_by", "retrieved_during", "refined_by", "depends_on", "analogous_to", "invalidated_by", "derived_from")
INGEST_TYPES = {"next_turn": 1.0, "same_session": 0.5, "belongs_to": 1.0}
EDGE_ALIASES = {"related_to": "analogous_to"}

#: Bounds of request parameters.
BOUNDS = {"top_k": (1, 200), "min_score": (0, 1), "vector_weight": (0, 1), "graph_weight": (0, 1), "max_depth": (1, 5), "depth": (1, 5), "weight": (0, 1)}
TEXT_LENGTH = (1, 50_000)
BULK_NODES, BULK_EDGES = 1000, 5000
DEFAULT_ALPHA, DEFAULT_BETA = 0.6, 0.4


def check_bounds(**values: float | None) -> None:
    """Raises ValueError for a parameter outside its bounds."""
    for name, value in values.items():
        low, high = BOUNDS[name]
        if value is not None and not low <= value <= high:
            raise ValueError(f"{name} must be from {low} to {high}, not {value}")
