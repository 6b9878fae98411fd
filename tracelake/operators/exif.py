"""Disclosure found in metadata tags. Tags arrive as rows (path, position, tag, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags that are read.
TAGS = [
    "GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSAltitude", "Make", "Model", "LensModel",
    "Software", "Artist", "XPAuthor", "Copyright", "UserComment", "XPComment", "DateTimeOriginal", "DateTimeDigitized",
]
EXIF_TYPE = ("struct<has_geolocation:boolean,latitude:double,longitude:double,altitude:double,camera_make:string,"
             "camera_model:string,camera_serial_number:string,lens_model:string,software:string,author:string,"
             "last_saved_by:string,copyright:string,user_comment:string,date_taken:string,"
             "disclosed_fields:array<string>,exposure_level:string>")


def rational(text: Column) -> Column:
    """"n/d" to a number; a zero denominator counts as zero."""
    below = F.coalesce(F.substring_index(text, "/", -1).try_cast("double"), F.lit(0.0))
    above = F.coalesce(F.substring_index(text, "/", 1).try_cast("double"), F.lit(0.0))
    plain = F.when(text.contains("/"), above / F.nullif(below, F.lit(0.0))).otherwise(above)
    return F.coalesce(plain, F.lit(0.0))


def degrees(text: Column, reference: Column, negative: str) -> Column:
    """Degrees, minutes, seconds separated by spaces; null unless all three are there."""
    parts = F.filter(F.split(text, " "), lambda p: p != "")
    value = rational(parts[0]) + rational(F.get(parts, F.lit(1))) / 60.0 + rational(F.get(parts, F.lit(2))) / 3600.0
    signed = F.when(F.upper(reference) == negative, -value).otherwise(value)
    return F.when(F.size(parts) == 3, signed)


def exposure_level(has_gps: Column, serial: Column, author: Column, model: Column, software: Column) -> Column:
    """EXF-3."""
    return (F.when(has_gps, F.lit("Critical"))
            .when(serial.isNotNull() | author.isNotNull(), F.lit("High"))
            .when(model.isNotNull() | software.isNotNull(), F.lit("Medium")).otherwise(F.lit("Low")))


def image_disclosure(tags: DataFrame) -> DataFrame:
    """EXF-1 and EXF-3: one `exif` struct per path. Every tag is a partial aggregate, no rows are kept."""
    value = F.trim("value")
    first = [F.min_by(value, F.when(F.col("tag") == t, F.col("position"))).alias(t) for t in TAGS]
    is_serial = F.lower("tag").contains("serial") & (F.length(value) >= 4)
    wide = tags.groupBy("path").agg(
        *first, F.min_by(value, F.when(is_serial, F.col("position"))).alias("Serial"))

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    lat = degrees(F.col("GPSLatitude"), F.col("GPSLatitudeRef"), "S")
    lon = degrees(F.col("GPSLongitude"), F.col("GPSLongitudeRef"), "W")
    placed = wide.withColumn("lat", lat).withColumn("lon", lon)
    gps = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
                     & ~((F.col("lat") == 0) & (F.col("lon") == 0)), F.lit(False))
    make, model = text("Make"), text("Model")
    merged = (F.when(model.isNull(), None)
              .when(F.lower(model).startswith(F.lower(F.coalesce(make, F.lit("")))), model)
              .otherwise(F.concat_ws(" ", make, model)))
    author = F.nullif(F.coalesce("Artist", "XPAuthor"), F.lit(""))
    comment = F.nullif(F.coalesce("UserComment", "XPComment"), F.lit(""))
    taken = F.nullif(F.coalesce("DateTimeOriginal", "DateTimeDigitized"), F.lit(""))
    altitude = F.col("GPSAltitude")
    fields = F.array_compact(F.array(
        F.when(gps, F.lit("GPS")), F.when(model.isNotNull(), F.lit("Device")),
        F.when(F.col("Serial").isNotNull(), F.lit("Serial")),
        F.when(text("Software").isNotNull(), F.lit("Software")),
        F.when(author.isNotNull(), F.lit("Author")), F.when(taken.isNotNull(), F.lit("DateTaken"))))
    return placed.select("path", F.struct(
        gps.alias("has_geolocation"), F.when(gps, F.bround("lat", 6)).alias("latitude"),
        F.when(gps, F.bround("lon", 6)).alias("longitude"),
        F.when(F.substring_index(altitude, "/", -1) != "0", F.bround(rational(altitude), 1)).alias("altitude"),
        make.alias("camera_make"), merged.alias("camera_model"), F.col("Serial").alias("camera_serial_number"),
        text("LensModel").alias("lens_model"), text("Software").alias("software"), author.alias("author"),
        F.lit(None).cast("string").alias("last_saved_by"), text("Copyright").alias("copyright"),
        F.when(~F.upper(comment).startswith("UNICODE"), comment).alias("user_comment"), taken.alias("date_taken"),
        fields.alias("disclosed_fields"),
        exposure_level(gps, F.col("Serial"), author, merged, text("Software")).alias("exposure_level"),
    ).alias("exif"))


def office_disclosure(members: DataFrame) -> DataFrame:
    """EXF-2: elements (path, position, member, piece, element, text) of Office files; only the core properties are used, the
    first element of each name."""
    def element(name: str) -> Column:
        first = F.min(F.when(F.col("element") == name, F.struct("position", "piece", "text")))
        return F.nullif(F.trim(first["text"]), F.lit(""))

    core = members.filter("member = 'docProps/core.xml'").groupBy("path").agg(
        F.max(F.col("error").isNotNull()).alias("bad"), element("creator").alias("author"),
        element("lastModifiedBy").alias("last"), element("created").alias("created")).filter("NOT bad")
    none = F.lit(None).cast("string")
    return (core
            .select("path", F.struct(
                F.lit(False).alias("has_geolocation"), F.lit(None).cast("double").alias("latitude"),
                F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("double").alias("altitude"),
                none.alias("camera_make"), none.alias("camera_model"), none.alias("camera_serial_number"),
                none.alias("lens_model"), none.alias("software"), F.col("author"), F.col("last").alias("last_saved_by"),
                none.alias("copyright"), none.alias("user_comment"), F.col("created").alias("date_taken"),
                F.array_compact(F.array(
                    F.when(F.col("author").isNotNull(), F.lit("Author")),
                    F.when(F.col("last").isNotNull(), F.lit("LastSavedBy")),
                    F.when(F.col("created").isNotNull(), F.lit("DateTaken")))).alias("disclosed_fields"),
                exposure_level(F.lit(False), none, F.col("author"), none, none).alias("exposure_level")).alias("exif")))
