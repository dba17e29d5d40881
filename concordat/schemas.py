"""Table schemas. Unsigned 32-bit source fields are BIGINT, digests text or BINARY."""

from pyspark.sql import types as T

CHUNK = T.StructType([T.StructField("hash", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())])
CHUNKS = T.ArrayType(CHUNK)

_FILE = [
    T.StructField("path", T.StringType()),
    T.StructField("tp", T.StringType()),
    T.StructField("mode", T.LongType()),
    T.StructField("uid", T.LongType()),
    T.StructField("gid", T.LongType()),
    T.StructField("ctime", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("chunks", CHUNKS),
    T.StructField("target", T.StringType()),
]
FILE_FIELDS = [f.name for f in _FILE]
PREV_STATE = T.StructType(_FILE)
INVENTORY = T.StructType([T.StructField("node_idx", T.IntegerType()), *_FILE])
CAPABILITIES = T.StructType(
    [
        T.StructField("node_idx", T.IntegerType()),
        *(T.StructField(c, T.BooleanType()) for c in ("can_chown", "can_chmod", "can_set_xattrs", "can_create_devices", "can_create_fifos")),
        T.StructField("effective_uid", T.LongType()),
        T.StructField("effective_gid", T.LongType()),
        T.StructField("filesystem_type", T.StringType()),
        T.StructField("case_sensitive", T.BooleanType()),
    ]
)
RULES = T.StructType([T.StructField("priority", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("strategy", T.StringType())])
LOCKS = T.StructType([T.StructField("path", T.StringType()), T.StructField("pid", T.LongType()), T.StructField("started", T.LongType()), T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("nodes", T.ArrayType(T.StringType()))])
SCAN_CACHE = T.StructType([f for f in _FILE if f.name not in ("tp", "target")])
RESOLUTIONS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("chosen_node", T.IntegerType())])
#: Entry types by their spelling in listings and snapshots.
TYPE_ALIASES = {"F": "F", "File": "F", "D": "D", "Dir": "D", "L": "L", "S": "L", "SymLink": "L"}
