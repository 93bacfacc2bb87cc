"""Writers: JSON documents, CSV plans, drafts, playlists and publish state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_stem, word_count


def write_document(document: DataFrame, path: str) -> None:
    """A one-row document as one text file."""
    document.select("value").coalesce(1).write.mode("overwrite").text(path)


def write_schedule(plan: DataFrame, path: str) -> None:
    """minute, style, file, source_bulletin, title with a header, by minute."""
    columns = ["minute", "style", "file", "source_bulletin", "title"]
    plan.select(*columns).orderBy(F.col("minute").cast("int")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def drafts(bulletins: DataFrame) -> DataFrame:
    """Drafts with their number of words and a file name."""
    return bulletins.withColumns({"word_count": word_count("transcript"), "file": safe_stem("id")})


def write_drafts(bulletins: DataFrame, path: str) -> None:
    """Transcripts and records side by side, by style."""
    made = drafts(bulletins)
    made.write.mode("overwrite").partitionBy("style_key").json(f"{path}/json")
    made.select("style_key", F.col("transcript").alias("value")).write.mode("overwrite").partitionBy("style_key").text(f"{path}/txt")


def playlist(history: DataFrame, suffixes=(".mp3", ".wav")) -> DataFrame:
    """Lines of a concat list, oldest first."""
    fits = F.lower("audio_path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    line = F.concat(F.lit("file '"), F.replace("audio_path", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    listed = F.array_sort(F.collect_list(F.struct("slot_start", "id", line.alias("line"))))
    return history.filter(fits).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("value"))


def clamp(limit: int, least: int = 1, most: int = 500) -> int:
    return max(least, min(most, limit))


def stored_ids(paths: DataFrame, column: str = "path", suffix: str = ".mp3") -> DataFrame:
    """Ids of stored files: their names without the suffix."""
    name = F.regexp_extract(column, r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    return paths.select(name.alias("id")).filter("id <> ''").distinct()


def publish_state(current_id: Column | None, uploaded: DataFrame, keep: DataFrame, updated_at: str) -> DataFrame:
    """State after publishing: what is uploaded and still kept."""
    kept = uploaded.join(keep.select("id"), "id", "left_semi")
    return kept.agg(
        (F.lit(None).cast("string") if current_id is None else current_id).alias("current_live_id"),
        F.array_sort(F.collect_set("id")).alias("uploaded_bulletins"),
        F.lit(updated_at).alias("updated_at"),
    )


def api(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The rows a serving endpoint returns."""
    return df.orderBy(*order).limit(clamp(limit))
