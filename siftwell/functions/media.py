"""Plans for tools that take media apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCENE_THRESHOLD = 0.4


def keyframe_plan(duration_seconds: Column, frames_per_second: Column, most: Column, scene: float = SCENE_THRESHOLD) -> Column:
    """struct<filter, frames>: how to draw at most so many frames evenly from a video. With duration and rate the most telling frame of each of `most` equal batches, with the duration only one
    frame every so many seconds, otherwise wherever the scene changes. Values that are null, zero, negative or not finite are unknown."""
    known = lambda c: F.coalesce((c > 0) & ~F.isnan(c) & (c < float("inf")), F.lit(False))
    batch = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), F.ceil(duration_seconds * frames_per_second)) / most)).cast("string")
    seconds = F.regexp_replace(duration_seconds.cast("string"), r"\.0$", "")
    told = (
        F.when(most == 0, f"select='gt(scene,{scene})'")
        .when(known(duration_seconds) & known(frames_per_second), F.concat(F.lit("thumbnail=n="), batch))
        .when(known(duration_seconds), F.concat(F.lit("fps="), most.cast("string"), F.lit("/"), seconds))
        .otherwise(f"select='gt(scene,{scene})'")
    )
    return F.struct(told.alias("filter"), most.alias("frames"))
