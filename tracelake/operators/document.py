"""Photographed documents, decided from per-image statistics that arrive as columns.

Columns: path, width, height, avg_saturation, high_saturation_ratio, mean_luminance, dark_ratio, paper_ratio,
text_bands, horizontal_transitions, vertical_transitions, face_detected, face_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths

DOCUMENT_TYPE = ("struct<is_document:boolean,is_id_document:boolean,confidence:double,reasons:array<string>,"
                 "aspect_ratio:double,text_density:double>")


def name_has_keyword(path: Column | str) -> Column:
    """DOC-2: whole tokens of the file name, not substrings."""
    tokens = F.split(F.lower(paths.stem(path)), r"[_\- .()\[\]]+")
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in fixed.DOCUMENT_NAME_WORDS]))


def percent(value: Column) -> Column:
    return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit(" %"))


def with_document(images: DataFrame, out: str = "document") -> DataFrame:
    """DOC-1, DOC-3: face evidence only corroborates an image that already looks like a document."""
    c = F.col
    ratio = F.greatest("width", "height") / F.least("width", "height")
    page, card = F.abs(c("_ratio") - 1.414) < 0.10, F.abs(c("_ratio") - 1.586) < 0.10
    strong = (c("paper_ratio") >= 0.45) & c("mean_luminance").between(140, 250)
    moderate = (c("paper_ratio") >= 0.35) & c("mean_luminance").between(125, 250)
    ink = c("dark_ratio").between(0.04, 0.35) & moderate & (c("text_bands") >= 3)
    rows = (c("text_bands") >= 4) & (c("horizontal_transitions") + c("vertical_transitions") > 40)
    colorful = (c("avg_saturation") > 0.32) | (c("high_saturation_ratio") > 0.30)
    staged = (images.withColumn("_ratio", ratio)
              .withColumn("_strong", strong).withColumn("_moderate", moderate).withColumn("_ink", ink)
              .withColumn("_rows", rows).withColumn("_page", page).withColumn("_card", card)
              .withColumn("_word", name_has_keyword("path")).withColumn("_colorful", colorful))
    aspect = c("_page") | c("_card")
    face = c("face_detected") & c("face_count").between(1, 2) & aspect & c("_strong") & c("_ink") & c("_rows")
    points = (F.when(c("_strong"), 30).when(c("_moderate"), 15).otherwise(0) + F.when(c("_ink"), 25).otherwise(0)
              + F.when(c("_rows"), 15).otherwise(0) + F.when(aspect, 15).otherwise(0)
              + F.when(c("_word"), 15).otherwise(0) + F.when(face, 20).otherwise(0))
    geometry = aspect | ((c("paper_ratio") >= 0.60) & (c("text_bands") >= 6)) | c("_word")
    staged = staged.withColumn("_face", face).withColumn("_points", points)
    accepted = ~c("_colorful") & (c("_points") >= 65) & c("_moderate") & c("_ink") & c("_rows") & geometry
    reasons = F.array_compact(F.array(
        F.when(c("_strong"), F.concat(F.lit("Neutral paper/card background ("), percent(c("paper_ratio")),
                                      F.lit(" area, lum "), F.bround("mean_luminance", 0).cast("int").cast("string"),
                                      F.lit(")")))
        .when(c("_moderate"), F.lit("Moderate paper background area")),
        F.when(c("_ink"), F.concat(F.lit("Document text ink proportion ("), percent(c("dark_ratio")), F.lit(")"))),
        F.when(c("_rows"), F.concat(F.lit("Repeated document text bands ("), c("text_bands").cast("string"), F.lit(")"))),
        F.when(c("_page"), F.lit("Standard A4/A5 document aspect ratio (~1.41)"))
        .when(c("_card"), F.lit("ID card / driver license aspect ratio (~1.58)")),
        F.when(c("_word"), F.lit("Document keyword in filename")),
        F.when(c("_face"), F.lit("Face detected on identity document surface"))
        .when(c("face_detected") & (c("face_count") > 0),
              F.lit("Face found, but document surface/text/geometry evidence is insufficient"))))
    cap = F.when(c("_accepted"), F.least(F.lit(98), c("_points"))).otherwise(F.least(F.lit(45), c("_points")))
    staged = staged.withColumn("_accepted", accepted)
    return staged.withColumn(out, F.struct(
        c("_accepted").alias("is_document"), (c("_accepted") & c("_face")).alias("is_id_document"),
        F.when(c("_colorful"), F.lit(0.15)).otherwise(F.bround(cap / 100.0, 2)).alias("confidence"),
        F.when(c("_colorful"), F.array(F.lit("High color saturation / non-paper content"))).otherwise(reasons)
        .alias("reasons"),
        F.bround("_ratio", 3).alias("aspect_ratio"),
        F.when(c("_colorful"), F.lit(0.0)).otherwise(F.bround("dark_ratio", 3)).alias("text_density"),
    )).drop("_ratio", "_strong", "_moderate", "_ink", "_rows", "_page", "_card", "_word", "_colorful", "_face",
            "_points", "_accepted")
