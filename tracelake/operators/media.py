"""Image safety, faces and reuse of stored detector results. Scores arrive as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import fixed

PEOPLE_TYPE = ("struct<people_scan_status:string,people_detected:boolean,face_count:int,max_confidence:double,"
               "model_version:string>")
SAFETY_TYPE = ("struct<status:string,primary_class:string,nsfl_score:double,nsfw_score:double,sfw_score:double,"
               "model_version:string>")
FINGERPRINT = ["file_size", "file_modified_at", "model_version"]


def safety_class(nsfl: Column, nsfw: Column, sfw: Column) -> Column:
    """SAF-1."""
    return (F.when((nsfl >= nsfw) & (nsfl >= sfw), F.lit("NSFL"))
            .when(nsfw >= sfw, F.lit("NSFW")).otherwise(F.lit("SFW")))


def video_safety(frames: DataFrame, key: str = "video") -> DataFrame:
    """SAF-2: frames (video, frame, nsfl, nsfw, sfw) in order; stop after the first one over the threshold.

    That frame beats every earlier one, so the verdict is that frame, else the earliest frame with the
    greatest score. Both are partial aggregates; no window is needed.
    """
    scores = F.struct("frame", "nsfl", "nsfw", "sfw")
    over = F.when(F.col("nsfw") > fixed.UNSAFE_FRAME_THRESHOLD, F.col("frame"))
    return (frames.groupBy(key).agg(
        F.coalesce(F.min_by(scores, over), F.max_by(scores, F.struct(F.col("nsfw"), -F.col("frame")))).alias("v"))
        .select(key, "v.*").withColumn("primary_class", safety_class(F.col("nsfl"), F.col("nsfw"), F.col("sfw"))))


def video_people(frames: DataFrame, key: str = "video") -> DataFrame:
    """PPL-1."""
    return frames.groupBy(key).agg(F.max("face_count").alias("face_count"),
                                   F.max("confidence").alias("max_confidence"))


def people_result(status: Column, faces: Column, confidence: Column, version: Column) -> Column:
    """PPL-2: errors stay visible with zero scores."""
    done = status == "Completed"
    return F.struct(status.alias("people_scan_status"), (done & (faces > 0)).alias("people_detected"),
                    F.when(done, faces).otherwise(0).cast("int").alias("face_count"),
                    F.when(done, confidence).otherwise(0.0).alias("max_confidence"), version.alias("model_version"))


def reusable(media: DataFrame, stored: DataFrame) -> DataFrame:
    """JN-6: media rows whose unchanged, completed result is already stored."""
    done = stored.filter("status = 'Completed'").withColumn("path_lower", F.lower("path")).drop("path")
    left = media.withColumn("path_lower", F.lower("path"))
    return left.join(done, ["path_lower", *FINGERPRINT]).drop("path_lower")


def to_detect(media: DataFrame, stored: DataFrame) -> DataFrame:
    """JN-6: the rest goes to detection."""
    done = (stored.filter("status = 'Completed'").select(F.lower("path").alias("path_lower"), *FINGERPRINT))
    left = media.withColumn("path_lower", F.lower("path"))
    return left.join(done, ["path_lower", *FINGERPRINT], "left_anti").drop("path_lower")


def run_counters(results: DataFrame) -> DataFrame:
    """AGG-4 over rows (status, primary_class, people_detected)."""
    done = F.col("status") == "Completed"
    return results.agg(
        F.count_if(done & (F.col("primary_class") == "NSFW")).alias("nsfw"),
        F.count_if(done & (F.col("primary_class") == "NSFL")).alias("nsfl"),
        F.count_if(done & F.col("people_detected")).alias("people"),
        F.count_if(done & ~F.col("people_detected")).alias("no_people"),
        F.count_if(F.col("status") == "Error").alias("errors"))
