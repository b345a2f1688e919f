"""Canonical table schemas. All times are UTC."""

INTERACTIONS = (
    "client_id string, channel_id string, ingestion string, bulkfile string, "
    "user_id bigint, item_id bigint, time timestamp, action string, rating double"
)
USER_HISTORY = (
    "channel_id string, user_id bigint, time timestamp, item_id bigint, "
    "action string, rating double, ingest_seq bigint"
)
ROLLUPS = (
    "channel_id string, ingestion string, bulkfile string, action string, day date, "
    "hits bigint, first timestamp, last timestamp, users binary, items binary"
)
SIMILARITY = (
    "channel_id string, algo_id string, version string, "
    "item_id bigint, other_id bigint, score bigint"
)
RECOMMENDATIONS = (
    "channel_id string, algo_id string, version string, "
    "user_id bigint, item_id bigint, score double"
)
JOB_RUNS = (
    "channel_id string, algo_id string, run_id string, version string, "
    "start_ms bigint, end_ms bigint, outcome string, output string"
)
ITEM_SUBMISSIONS = (
    "channel_id string, item_id bigint, seq bigint, attributes map<string,string>"
)
CLIENTS = "client_id string, name string, created_ms bigint"
CHANNELS = "channel_id string, client_id string, name string, created_ms bigint"
ALGORITHMS = (
    "channel_id string, algo_id string, base string, actions string, missing_values string"
)
UPLOADS = "channel_id string, upload_id string, upload_ms bigint, oname string, path string"
VECTORS = (
    "channel_id string, algo_id string, version string, "
    "item_id bigint, numbers array<double>, shared array<string>, norm double"
)
ATTRIBUTES = "channel_id string, key string, name string, type string"
ITEM_REJECTS = "channel_id string, item_id bigint, seq bigint, undeclared string"
CELLS = "rowkey string, family string, qualifier string, value string"
REJECTS = "raw string, reason string, source string"

# The JSON kept per finished job run.
JOB_HISTORY_JSON = (
    "startTime string, endTime string, job string, outcome string, output string"
)
