"""Schemas of the stored tables and of what the readers give."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else _KINDS[kind]))
    return T.StructType(fields)


_KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "double": T.DoubleType(),
    "strings": T.ArrayType(T.StringType()),
}

SOURCES = _struct(
    "id long, name string, url string, region string, priority int, interval_minutes int, max_entries int, enabled boolean, "
    "last_etag string, last_modified string, last_checked_at timestamp, created_at timestamp, updated_at timestamp"
)
ARTICLES = _struct(
    "id long, source_id long, title string, url string, url_hash string, published_at timestamp, published_at_raw string, "
    "scraped_at timestamp, summary string, content string, language string, status string, is_sports boolean, used_count long, "
    "created_at timestamp, updated_at timestamp"
)
BULLETINS = _struct(
    "id string, slot_start timestamp, style_key string, style_label string, title string, summary string, transcript string, "
    "status string, audio_path string, audio_mime_type string, duration_seconds double, warnings strings, error string"
)
BULLETIN_ARTICLES = _struct("bulletin_id string, article_id long")
#: A row for each time that a bulletin takes an article.
ARTICLE_USES = _struct("bulletin_id string, article_id long")
AUDIO_ASSETS = _struct("id long, bulletin_id string, path string, mime_type string, duration_seconds double, created_at timestamp")
PIPELINE_RUNS = _struct("id long, kind string, status string, started_at timestamp, ended_at timestamp, message string")
#: What arrives from feeds, before it is compacted.
ARTICLE_LOG = _struct(
    "arrival long, source_id long, title string, url string, published_at timestamp, published_at_raw string, scraped_at timestamp, "
    "summary string, content string, language string"
)
EVENTS = _struct("event_id long, ts timestamp, user_id long, event_type string, value double, props string")

#: The columns by which a reader fills in what an older table lacks.
DEFAULTS = {"region": "general", "language": "unknown", "status": "new", "summary": "", "content": "", "is_sports": False}


def conform(df, schema: T.StructType, defaults: bool = True):
    """``df`` with exactly the schema's columns: missing ones get their default (or null), others are cast leniently."""
    known = DEFAULTS if defaults else {}
    from pyspark.sql import functions as F

    have = {c.lower() for c in df.columns}
    out = []
    for f in schema.fields:
        if f.name.lower() in have:
            value = F.col(f.name).try_cast(f.dataType)
            if f.name in known:
                value = F.coalesce(value, F.lit(known[f.name]).cast(f.dataType))
        else:
            value = F.lit(known.get(f.name)).cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)
