"""Quality, verification and display expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sightweave.functions.vectors import norm

# The weights of the logistic score.
BIAS, W_COSINE, W_RERANK, W_COUNT, W_GAP, W_QUALITY = -13.5, 11.0, 7.0, 0.6, -0.01, 1.0


@dataclass(frozen=True)
class QualityLimits:
    """Limits of the crop gate."""

    min_width: int = 24
    min_height: int = 64
    min_area: int = 2500
    min_frame_share: float = 0.002
    min_aspect: float = 0.20
    max_aspect: float = 1.20
    min_blur: float = 20.0
    min_brightness: float = 20.0
    max_brightness: float = 235.0
    max_occlusion: float = 0.5


def quality_reason(width: Column, height: Column, frame_area: Column, blur: Column, brightness: Column, limits: QualityLimits = QualityLimits()) -> Column:
    """The first check that a crop fails, or ok; aspect is width by height. A measure that is null passes its check."""
    area, aspect = width * height, width / height
    checks = [
        (width < limits.min_width, "too_narrow"),
        (height < limits.min_height, "too_short"),
        (area < limits.min_area, "too_small"),
        (area / frame_area < limits.min_frame_share, "too_tiny_in_frame"),
        ((aspect < limits.min_aspect) | (aspect > limits.max_aspect), "bad_aspect"),
        (blur < limits.min_blur, "blurry"),
        ((brightness < limits.min_brightness) | (brightness > limits.max_brightness), "bad_brightness"),
    ]
    out = F
    for condition, reason in checks:
        out = out.when(condition, F.lit(reason))
    return out.otherwise("ok")


def quality_scalar(quality: Column) -> Column:
    """One number from 0 to 1: 0.5 without a record, 0 if rejected; a missing measure skips its factor."""
    sharp = F.coalesce(F.least(F.lit(1.0), quality["blur"] / 60), F.lit(1.0))
    lit = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(quality["brightness"] - 127.5) / 127.5), F.lit(1.0))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sharp * lit))
    return F.when(quality.isNull(), 0.5).when(~quality["accepted"], 0.0).otherwise(value)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def verifier(cosine: Column, rerank: Column, observations: Column, gap_sec: Column, quality: Column, max_observations: int | None = None) -> Column:
    """Probability that a match is right; max_observations bounds the weight of the count."""
    n = F.greatest(F.lit(0), observations)
    n = F.least(n, F.lit(max_observations)) if max_observations else n
    z = F.lit(BIAS) + W_COSINE * cosine + W_RERANK * rerank + W_COUNT * F.log1p(n) + W_GAP * F.greatest(F.lit(0.0), gap_sec) + W_QUALITY * quality
    return sigmoid(z)


def score_bin(score: Column) -> Column:
    """Six bins: under .5, four of a tenth each, and .9 and over."""
    return F.when(score < 0.5, 0).when(score < 0.6, 1).when(score < 0.7, 2).when(score < 0.8, 3).when(score < 0.9, 4).otherwise(5)


#: The colour of a box that no identity has.
PLAIN = -1


def palette_index(identity: Column) -> Column:
    """Colour of an identity: its number modulo 8, PLAIN without one; an identity that isn't a number goes by the checksum of its text."""
    return F.coalesce(F.pmod(F.when(identity.try_cast("long").isNotNull(), identity.try_cast("long")).otherwise(F.crc32(identity.cast("string").cast("binary"))), F.lit(8)).cast("int"), F.lit(PLAIN))


def two_places(x: Column) -> Column:
    return x.cast("decimal(20,10)").cast("decimal(20,2)").cast("string")


def display_label(reid: Column, score: Column, identity: Column, track: Column, confidence: Column) -> Column:
    """What is written at a box: the reconciled id with its score, else the live one, else the track, else a person; negative ids are pending."""
    suffix = F.coalesce(F.concat(F.lit(" ("), two_places(score), F.lit(")")), F.lit(""))
    own = F.coalesce(F.concat(F.lit("  ID"), track.cast("string")), F.lit(""))
    pending = F.coalesce(reid, identity) < 0
    named = F.when(reid.isNotNull(), F.concat(F.lit("REID "), reid.cast("string"), suffix, own)).when(identity.isNotNull(), F.concat(F.lit("GID "), identity.cast("string"), own))
    bare = F.when(track.isNotNull(), F.concat(F.lit("ID "), track.cast("string"), F.lit("  "))).otherwise("person ")
    return F.when(pending, F.concat(F.lit("REID ..."), own)).otherwise(F.coalesce(named, F.concat(bare, two_places(confidence))))


def register(spark: SparkSession) -> None:
    """The SQL functions reid_unit, reid_cosine, reid_quality and reid_verify for this session."""
    length = "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION reid_unit(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(array({length}), n -> CASE WHEN n > 0 AND n < double('infinity') THEN transform(v, x -> x / n) END)[0]")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reid_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(reid_unit(a), reid_unit(b), (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reid_quality(accepted BOOLEAN, blur DOUBLE, brightness DOUBLE) RETURNS DOUBLE RETURN CASE WHEN accepted IS NULL THEN 0.5D WHEN NOT accepted THEN 0D ELSE least(1D, greatest(0D, coalesce(least(1D, blur / 60), 1D) * coalesce(greatest(0D, 1 - abs(brightness - 127.5D) / 127.5D), 1D))) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION reid_verify(cosine DOUBLE, rerank DOUBLE, n BIGINT, gap DOUBLE, quality DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-({BIAS}D + {W_COSINE}D * cosine + {W_RERANK}D * rerank + {W_COUNT}D * log1p(greatest(0, n)) + {W_GAP}D * greatest(0D, gap) + {W_QUALITY}D * quality)))")


__all__ = ["QualityLimits", "display_label", "norm", "palette_index", "quality_reason", "quality_scalar", "register", "score_bin", "sigmoid", "verifier"]
