"""Tables of the engine: one per kind, with the tenant as a partition column."""

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("tenant", T.StringType()), *(T.StructField(n, t) for n, t in fields)])


_long, _text, _vector = T.LongType(), T.StringType(), T.ArrayType(T.FloatType())
FILES = _table(("id", _long), ("name", _text), ("status", _text))
CHUNKS = _table(("id", _long), ("file_id", _long), ("chunk", _text), ("embedding", _vector))
NODES = _table(("id", _long), ("file_id", _long), ("name", _text), ("name_normalized", _text), ("type", _text), ("description", _text))
NODE_VECTORS = _table(("id", _long), ("file_id", _long), ("name", _text), ("name_normalized", _text), ("description", _text), ("embedding", _vector))
EDGES = _table(("id", _long), ("file_id", _long), ("source", _text), ("target", _text), ("description", _text), ("source_normalized", _text), ("target_normalized", _text))
EDGE_VECTORS = _table(("id", _long), ("file_id", _long), ("edge_id", _long), ("embedding", _vector))
TABLES = {"files": FILES, "chunks": CHUNKS, "nodes": NODES, "node_vec": NODE_VECTORS, "edges": EDGES, "edge_vec": EDGE_VECTORS}
