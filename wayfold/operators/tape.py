"""Tapes: a codec's tracks and segments as canonical tables, with events and templates; lookups and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TABLES
from .replay import replay
from .sequence import TRACK
from .validate import foreign_key_problems


def track_id(codec: str) -> Column:
    return F.concat(F.lit("track-"), F.substring(F.sha2(F.concat_ws("|", F.lit(codec), *TRACK), 256), 1, 32))


def tape_id(codec: str) -> Column:
    return F.concat(F.lit("tape-"), F.substring(F.sha2(F.concat_ws("|", F.lit(codec), F.lit("scenario"), "scenario_id"), 256), 1, 32))



def segment_table(segs: DataFrame, codec: str) -> DataFrame:
    """procedural_segments."""
    ids = {"tape_id": tape_id(codec), "procedural_track_id": track_id(codec)}
    s = segs.withColumns(ids | {"source_start_sample_index": F.col("start_sample_index"), "source_end_sample_index": F.col("end_sample_index"), "parameter_values": F.array().cast("array<double>"), "origin_type": F.lit("inferred"), "quality_flags": F.array().cast("array<string>")})
    s = s.withColumn("segment_id", F.concat_ws("#", "procedural_track_id", F.col("run_index").cast("string"), F.col("segment_index").cast("string")))
    return s.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["procedural_segments"].schema])


def track_table(samples: DataFrame, segs: DataFrame, agents: DataFrame, codec: str) -> DataFrame:
    """procedural_tracks.  agents: scenario_id, agent_id, agent_class."""
    valid = F.when(F.col("is_valid"), F.col("timestamp_ns"))
    s = samples.groupBy(*TRACK, "agent_id").agg(F.min(valid).alias("start_time_ns"), F.max(valid).alias("end_time_ns"), F.count("*").alias("source_sample_count"), F.count_if("is_valid").alias("valid_sample_count"), F.bool_or(F.col("is_valid") & F.col("z_m").isNotNull()).alias("has_elevation"))
    g = segs.groupBy(*TRACK).agg(F.count_distinct("run_index").alias("run_count"), F.count("*").alias("segment_count"))
    t = s.join(g, list(TRACK)).join(agents.select("scenario_id", "agent_id", "agent_class"), ["scenario_id", "agent_id"])
    t = t.withColumns({"tape_id": tape_id(codec), "procedural_track_id": track_id(codec), "origin_type": F.lit("inferred"), "quality_flags": F.array().cast("array<string>")})
    return t.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["procedural_tracks"].schema])


def tape_table(tracks: DataFrame, codec: str, version: str, dataset: str, parameters: str) -> DataFrame:
    """procedural_tape_manifest: one row a scenario, whose totals are its tracks'."""
    g = tracks.groupBy("tape_id", "scenario_id").agg(F.min("start_time_ns").alias("start_time_ns"), F.max("end_time_ns").alias("end_time_ns"), F.count("*").alias("track_count"), F.sum("segment_count").alias("segment_count"), F.sum("source_sample_count").alias("source_sample_count"), F.sum("valid_sample_count").alias("encoded_valid_sample_count"), F.bool_or("has_elevation").alias("has_elevation"))
    lits = {"source_dataset_id": dataset, "source_dataset_version": "1", "encoder_name": codec, "encoder_version": version, "encoder_parameters_identity": parameters, "origin_type": "inferred"}
    g = g.withColumns({k: F.lit(v) for k, v in lits.items()} | {"coordinate_frame_id": F.concat(F.lit("frame:"), "scenario_id"), "source_validation_report_identity": F.lit(None).cast("string"), "quality_flags": F.array().cast("array<string>")})
    return g.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["procedural_tape_manifest"].schema])


def tape_problems(tapes: DataFrame, tracks: DataFrame, segments: DataFrame) -> DataFrame:
    """Totals that don't add up and references that lead nowhere: table, key, problem."""
    total = tracks.groupBy("tape_id").agg(F.count("*").alias("n"), F.sum("segment_count").alias("s"), F.sum("source_sample_count").alias("a"), F.sum("valid_sample_count").alias("v"))
    bad = tapes.join(total, "tape_id", "left").where(~(F.col("track_count").eqNullSafe(F.col("n")) & F.col("segment_count").eqNullSafe(F.col("s")) & F.col("source_sample_count").eqNullSafe(F.col("a")) & F.col("encoded_valid_sample_count").eqNullSafe(F.col("v"))))
    per = segments.groupBy("procedural_track_id").agg(F.count("*").alias("n"))
    counts = tracks.join(per, "procedural_track_id", "left").where(~F.col("segment_count").eqNullSafe(F.col("n")))
    row = lambda df, t, k, p: df.select(F.lit(t).alias("table"), F.col(k).alias("key"), F.lit(p).alias("problem"))
    return (
        row(bad, "tapes", "tape_id", "totals").unionByName(row(counts, "tracks", "procedural_track_id", "segments"))
        .unionByName(row(foreign_key_problems(segments, tracks, ["procedural_track_id"]), "segments", "procedural_track_id", "no track"))
        .unionByName(row(foreign_key_problems(tracks, tapes, ["tape_id"]), "tracks", "tape_id", "no tape"))
    )


class Package:
    """Lookups over a tape's tables; every answer is a DataFrame, filters reach the scan."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def _by(self, table: str, order: tuple[str, ...], **keys) -> DataFrame:
        df = self.tables[table]
        for k, v in keys.items():
            df = df.where(F.col(k) == v)
        return df.orderBy(*order) if order else df

    def tape(self, *, scenario_id: str | None = None, tape_id: str | None = None) -> DataFrame:
        if (scenario_id is None) == (tape_id is None):
            raise ValueError("give exactly one of scenario_id and tape_id")
        return self._by("tapes", (), **({"scenario_id": scenario_id} if tape_id is None else {"tape_id": tape_id}))

    def track(self, procedural_track_id: str) -> DataFrame:
        return self._by("tracks", (), procedural_track_id=procedural_track_id)

    def segments(self, procedural_track_id: str) -> DataFrame:
        return self._by("segments", ("run_index", "segment_index"), procedural_track_id=procedural_track_id)

    def waypoints(self, procedural_track_id: str) -> DataFrame:
        return self._by("waypoints", ("waypoint_index",), procedural_track_id=procedural_track_id)

    def events(self, procedural_track_id: str) -> DataFrame:
        return self._by("events", ("event_index",), procedural_track_id=procedural_track_id)

    def memberships(self, procedural_track_id: str) -> DataFrame:
        return self._by("memberships", ("template_id", "membership_index"), procedural_track_id=procedural_track_id)

    def template(self, template_id: str) -> DataFrame:
        return self._by("templates", (), template_id=template_id).join(self.tables["memberships"], "template_id").orderBy("membership_index")

    def category(self, category_id: str) -> DataFrame:
        return self._by("categories", (), category_id=category_id).join(self.tables["templates"].drop("event_signature_json", "origin_type", "quality_flags"), "category_id").orderBy("template_id")

    def replay(self, procedural_track_id: str, timestamps_ns: list[int]) -> DataFrame:
        """States of one track; null where it has none."""
        segs = self.segments(procedural_track_id).withColumns({"scenario_id": F.col("tape_id"), "trajectory_id": F.col("procedural_track_id")})
        one = self.track(procedural_track_id).select(F.col("tape_id").alias("scenario_id"), F.col("procedural_track_id").alias("trajectory_id"))
        return replay(segs, one.withColumn("timestamp_ns", F.explode(F.array(*[F.lit(t).cast("long") for t in timestamps_ns]))))
